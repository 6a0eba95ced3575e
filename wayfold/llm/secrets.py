"""Secret scans: a worklist of decoded layers over each whole text.

The base scan finds three kinds on the text itself.  Then encodings are unwrapped into layers:
the whole text with all its URL escapes decoded, the whole text with all its Unicode and hex
escapes decoded, base64 tokens, and zlib, gzip, bzip2 or xz data inside those.  A layer is
scanned and unwrapped like the text, until nothing new appears; layers seen before end a cycle.
Spans found in a layer are mapped back to the code points of the text that they were decoded
from.  An escaped byte is a character of its own, as all that is looked for is ASCII.

A base64 token is read from each of its first four characters, so that what comes before a secret
(a path, a prefix) doesn't shift it, and tokens that only line breaks separate are also read as
one.  A find behind such a beginning reaches from its own first character to the token's end.

Bytes are scanned whatever they are, each as a character.  Compressed data may begin anywhere in
decoded bytes, also in escaped ones, and all members that follow each other are read.  What
they expand to is scanned to its end, in pieces that overlap and cut no token, so memory stays
small; time grows with what comes out.

Edge cases: a null text is an empty text; decoded bytes that are no UTF-8 and hold nothing don't
count as a layer; a token of over ``max_expanded`` characters within expanded data is scanned in
pieces of about that length; rows are independent, so repeated rows repeat their result; an empty table
gives no rows; very long texts are scanned whole, in a time that grows with their length.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame

from wayfold.llm.arrow import map_batches

KINDS = ("assign", "access", "hex")


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([*map(_either, ("password", "passwd", "secret", "token")), f"{_either('api')}_?{_either('key')}"])
ASSIGN = re.compile(rf"""(?:{_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

#: All that can hold a hex or base64 secret lies in one of these.
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
URL_ESCAPE = re.compile(r"%([0-9A-Fa-f]{2})")
UNI_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|u\{([0-9A-Fa-f]{1,6})\}|x([0-9A-Fa-f]{2}))")
#: Lines of base64: tokens that only line breaks separate.
LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
NO_TOKEN = str.maketrans("-_", "+/", " \t\r\n")
#: Escapes as they stand in written bytes.
BYTE_ESCAPE = re.compile(UNI_ESCAPE.pattern[:-1] + r"""|([abfnrtv0\\"'/]))""")
SIMPLE = dict(zip("abfnrtv0", "\a\b\f\n\r\t\v\0"))
#: Heads of gzip, zlib, bzip2 and xz.
PACKED = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00")
RUN = re.compile(rb"[^ \t\r\n\"'<>]*")
SPACES = re.compile(rb"\x20{64,}")
#: What a token, also one in lines or of escapes, consists of.
UNCUT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-%\\{} \t\r\n"


@dataclass(frozen=True)
class ScanParams:
    max_expanded: int = 64 << 20
    piece: int = 4 << 20
    overlap: int = 4096


class Layer:
    """Decoded text; ``at(i, j)`` is the span of the root text behind its characters i to j.

    A layer has one ``span`` for all of it, or a function ``behind`` for that, or is its
    ``parent`` with escapes decoded: the character ``places[k]`` is the parent's stretch ``escapes[k]``, all others are the parent's own.
    """

    __slots__ = ("behind", "counts", "escapes", "parent", "places", "span", "text")

    def __init__(self, text, span=None, parent=None, places=(), escapes=(), counts=True, behind=None):
        self.text, self.span, self.parent, self.places, self.escapes = text, span, parent, places, escapes
        self.counts, self.behind = counts, behind

    def _behind(self, i: int) -> tuple[int, int]:
        k = bisect_right(self.places, i) - 1
        if k < 0:
            return i, i + 1
        start, end = self.escapes[k]
        beyond = i - self.places[k]
        return (start, end) if beyond == 0 else (end + beyond - 1, end + beyond)

    def at(self, i: int, j: int) -> tuple[int, int]:
        layer = self
        while layer.span is None and layer.parent is not None:
            if layer.behind:
                return layer.behind(i, j)
            i, j = layer._behind(i)[0], layer._behind(j - 1)[1]
            layer = layer.parent
        return layer.span or (i, j)


def base_spans(text: str, tokens: list[tuple[int, int]] | None = None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the three base patterns."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    for i, j in _tokens(text) if tokens is None else tokens:
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text, i, j)]
    return out


def _tokens(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in TOKEN.finditer(text)]


def _opener(head: bytes):
    if head[:1] == b"x":
        return zlib.decompressobj()
    if head[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    return bz2.BZ2Decompressor() if head[:3] == b"BZh" else lzma.LZMADecompressor()


class _Stream:
    """What the members at the start of ``parts`` expand to, in parts; then ``rest`` follows them, or is None if they broke off."""

    def __init__(self, parts: Iterable[bytes], size: int):
        self.parts, self.size, self.rest = iter(parts), size, None

    def __iter__(self) -> Iterator[bytes]:
        rest = b""
        while True:
            while len(rest.lstrip(b"\0")) < 6 and (more := next(self.parts, b"")):
                rest += more
            # Members may have padding between them.
            if not PACKED.match(member := rest.lstrip(b"\0")):
                self.rest = rest
                return
            opened, rest = _opener(member), member
            try:
                while not opened.eof:
                    out = opened.decompress(rest, self.size)
                    rest = getattr(opened, "unconsumed_tail", b"")
                    if out:
                        yield out
                    elif not rest and not opened.eof and not (rest := next(self.parts, b"")):
                        return
            except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
                return
            rest = opened.unused_data


def _pieces(parts: Iterable[bytes], params: ScanParams) -> Iterator[bytes]:
    held, fresh, overlap = b"", 0, min(params.overlap, params.max_expanded // 2)
    for part in parts:
        # Any number of spaces may stand around the sign of an assignment.
        held = SPACES.sub(b" ", held + part)
        fresh += len(part)
        if fresh < min(params.piece, params.max_expanded):
            continue
        token = len(held.rstrip(UNCUT))
        whole = len(held) - token < params.max_expanded
        if whole and token == 0:
            continue
        yield held
        held, fresh = held[max(0, min(token if whole else len(held), len(held) - overlap)) :], 0
    if fresh:
        yield held


def _expanded(make: Callable[[], _Stream], span: tuple[int, int], params: ScanParams, above: tuple[bytes, ...] = ()) -> Iterator[Layer]:
    """Layers of a stream that ``make`` begins anew, and of the streams that it expands to."""
    head = next(iter(make()), None)
    # A stream that expands to itself ends here.
    if head is None or (key := hashlib.sha256(head).digest()) in above:
        return
    for piece in _pieces(make(), params):
        yield Layer(piece.decode("latin-1"), span=span)
    if PACKED.match(head):
        yield from _expanded(lambda: _Stream(make(), params.piece), span, params, (*above, key))


def _from(data: bytes, start: int) -> Iterator[bytes]:
    """``data`` from ``start`` on, in growing parts: most heads break off at once and cost no copy of what follows."""
    size = 256
    while start < len(data):
        yield data[start : start + size]
        start, size = start + size, min(2 * size, 1 << 20)


def _packed(data: bytes, at: Callable[[int, int], tuple[int, int]], params: ScanParams) -> Iterator[Layer]:
    """Layers of compressed data anywhere in ``data``; ``at`` gives the span of its bytes i to j."""
    end, size = 0, min(params.piece, params.max_expanded)
    for m in PACKED.finditer(data):
        start = m.start()
        if start < end:
            continue
        make = lambda start=start: _Stream(_from(data, start), size)
        stream, some = make(), False
        for _ in stream:
            some = True
        if some:
            # Data that breaks off goes as far as its run.
            end = len(data) - len(stream.rest) - sum(map(len, stream.parts)) if stream.rest is not None else RUN.match(data, start).end()
            yield from _expanded(make, at(start, end), params)


def _valid(data: bytes) -> bool:
    try:
        data.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def _unwrap_token(layer: Layer, i: int, j: int, params: ScanParams) -> Iterator[Layer]:
    """Layers of the token or lines at i to j, read in each of the four alignments."""
    written = layer.text[i:j].rstrip("=")
    token = written.translate(NO_TOKEN)
    lines = [k for k, c in enumerate(written) if not c.isspace()] if len(token) < len(written) else range(len(written))
    for first in range(min(4, len(token))):
        own = token[first:]
        if len(own) % 4 == 1:
            own = own[:-1]
        data = binascii.a2b_base64(own + "=" * (-len(own) % 4))

        def at(a: int, b: int, first: int = first) -> tuple[int, int]:
            # Of a token read from its start, all of it.
            return layer.at(i + (lines[first + a * 4 // 3] if first or lines[-1] >= len(lines) else 0), j)

        yield Layer(data.decode("latin-1"), parent=layer, behind=at, counts=_valid(data))
        yield from _packed(data, at, params)


def _unescape(layer: Layer, escape: re.Pattern) -> Layer | None:
    """The whole layer with its escapes decoded, one character each."""
    out, places, escapes, end, n = [], [], [], 0, 0
    for m in escape.finditer(layer.text):
        if escape is BYTE_ESCAPE and m[4]:
            char = SIMPLE.get(m[4], m[4])
        else:
            char = chr(code) if (code := int(next(filter(None, m.groups())), 16)) < 0x110000 else "?"
        n += m.start() - end
        out += [layer.text[end : m.start()], char]
        places.append(n)
        escapes.append(m.span())
        n, end = n + 1, m.end()
    if not places:
        return None
    return Layer("".join([*out, layer.text[end:]]), parent=layer, places=places, escapes=escapes)


def _children(layer: Layer, tokens: list[tuple[int, int]], params: ScanParams) -> Iterator[Layer]:
    in_lines = [m.span() for m in LINES.finditer(layer.text) if m.end() - m.start() >= 16] if "\n" in layer.text else []
    for i, j in tokens + in_lines:
        yield from _unwrap_token(layer, i, j, params)
    for sign, escape, as_bytes in (("%", URL_ESCAPE, URL_ESCAPE), ("\\", UNI_ESCAPE, BYTE_ESCAPE)):
        if sign in layer.text and (child := _unescape(layer, escape)):
            yield child
            written = child if as_bytes is escape else _unescape(layer, as_bytes)
            yield from _packed(written.text.encode("latin-1", "replace"), written.at, params)


def _key(text: str) -> str | bytes:
    return text if len(text) < 4096 else hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()


def scan(text: str | None, params: ScanParams = ScanParams()) -> tuple[list, list, int]:
    """(base spans, all spans, layers decoded); a span is (start, kind number, end), sorted."""
    text = text or ""
    tokens = _tokens(text)
    base = sorted(base_spans(text, tokens))
    found = set(base)
    if not tokens and "%" not in text and "\\" not in text and not ("\n" in text and LINES.search(text)):
        return base, base, 0
    # Children are made one at a time, so of expanded data only a piece is held at each depth.
    seen, decoded = {_key(text)}, 0
    work = [_children(Layer(text), tokens, params)]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        # The same layer at another place has spans of its own.
        key = (_key(layer.text), layer.at(0, len(layer.text)) if layer.text else None)
        if key in seen:
            continue
        seen.add(key)
        own = _tokens(layer.text)
        spans = base_spans(layer.text, own)
        decoded += layer.counts or bool(spans)
        found.update((s, kind, e) for i, kind, j in spans for s, e in [layer.at(i, j)])
        work.append(_children(layer, own, params))
    return base, sorted(found), decoded


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def secret_scan(docs: DataFrame, params: ScanParams = ScanParams()) -> DataFrame:
    """doc_id, counts of the base spans by kind, their digest, all spans, and the layers decoded."""

    def make():
        def work(batch):
            out = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layers")}
            for text in batch["text"].to_pylist():
                base, spans, layers = scan(text, params)
                for kind, name in enumerate(KINDS):
                    out[f"n_{name}"].append(sum(s[1] == kind for s in base))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(spans))
                out["n_layers"].append(layers)
            return out | {"doc_id": batch["doc_id"]}

        return work

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long")


def redact_text(text: str, params: ScanParams = ScanParams(), mark: str = "[SECRET]") -> str:
    """The text with each stretch of overlapping spans replaced by the mark."""
    out, end = [], 0
    stretches: list[list[int]] = []
    for start, _, stop in scan(text, params)[1]:
        if stretches and start < stretches[-1][1]:
            stretches[-1][1] = max(stretches[-1][1], stop)
        else:
            stretches.append([start, stop])
    for start, stop in stretches:
        out += [text[end:start], mark]
        end = stop
    return "".join([*out, text[end:]])


def redact_secrets(docs: DataFrame, params: ScanParams = ScanParams()) -> DataFrame:
    """``docs`` with every secret replaced; n_chars, where there is such a column, follows the text."""

    def make():
        def work(batch):
            texts = [t if t is None else redact_text(t, params) for t in batch["text"].to_pylist()]
            out = batch | {"text": texts}
            if "n_chars" in batch:
                before = zip(batch["text"].to_pylist(), texts, batch["n_chars"].to_pylist())
                out["n_chars"] = [n if old == new else len(new) for old, new, n in before]
            return out

        return work

    return map_batches(docs, make, docs.schema)
