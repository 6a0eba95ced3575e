"""SentencePiece encoding by forward-filtering backward-sampling, and decoding.

A text is cut where no piece can reach across: before each run of spaces, and around characters
that are in no piece.  For each stretch
the lattice of all pieces is weighted by ``exp(sharpness * score)``.  Forward filtering sums
the weights of all segmentations up to each character; backward sampling draws the last piece
in proportion to the mass that reaches it, then the one before, and so on, so a
segmentation comes up with exactly its share of the whole.  Random numbers depend on the row
key, the seed and the place in the text only: any executor, partitioning or retry draws the
same.

Short stretches of known characters are sampled by inverting one uniform number, which makes each segmentation
an interval of [0, 1); intervals met once are remembered, and all stretches of a batch are looked up
among them at once.  Others draw a number for every step, in logarithms.

A character that is no piece goes out as its UTF-8 bytes, and so does U+2581, the mark that
pieces write for a space: decoding gives back the text, bit by bit.

Edge cases: null stays null; the empty text has no pieces; repeated rows with one key get
one segmentation.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wayfold.llm.arrow import map_batches

#: Bytes of texts whose stretches are held at once, beside what is remembered.
AT_ONCE = 1 << 18
MARK = "\u2581"
STRETCH = r" +[^ ]*|[^ ]+"


@dataclass(frozen=True)
class PieceParams:
    """``model`` is a path that executors can read (ship it with ``--files`` where they share none)."""

    model: str = "/opt/tokenizers/piece_bpe_32k.model"
    sharpness: float = 5e-4
    seed: int = 1
    remembered: int = 200_000
    part: int = 100_000
    short: int = 40


_BASE, _SPREAD, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03), np.uint64(44)


def _signs(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Codec:
    def __init__(self, params: PieceParams = PieceParams()):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=params.model)
        self.params = params
        n = sp.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * n
        self.byte_ids = [0] * 256
        usual, scores = {}, []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                text = piece.replace(MARK, " ")
                usual[text] = i
                self.bytes_of[i] = text.encode()
                scores.append(sp.get_score(i))
        # Pieces that a user defined have scores far below all others: they count as the rarest.
        floor = min(s for s in scores if s > -1e8)
        self.log = {t: params.sharpness * max(floor, s) for (t, _), s in zip(usual.items(), scores)}
        self.ids = {t: (i,) for t, i in usual.items()}
        self.single = {t for t in usual if len(t) == 1}
        self.length = np.array([len(t) for t in self.log], np.int64)
        self.weight = np.array([math.exp(x) for x in self.log.values()])
        self.id = np.array([self.ids[t][0] for t in self.log], np.int64)
        self.fallback = params.sharpness * floor
        self.longest = max(map(len, usual))
        self.signs = np.zeros((len(self.log), self.longest), np.uint32)
        hashes = np.zeros(len(self.log), np.uint64)
        for k, t in enumerate(self.log):
            self.signs[k, : len(t)] = _signs(t)
        for column, live in zip(self.signs.T, np.arange(self.longest)[:, None] < self.length):
            hashes[live] = hashes[live] * _BASE + column[live]
        self.by_hash = np.argsort(hashes)
        self.hashes = hashes[self.by_hash]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(hashes * _SPREAD) >> _SHIFT] = True
        self.whole = any(" " in t.lstrip(" ") for t in usual)  # then pieces cross stretches
        within = set().union(*usual)
        alone = [c for c in map(chr, range(128)) if c not in within]
        self.between = next(c for c in map(chr, (*range(128), *range(0xE000, 0xF900))) if c not in within)
        # No piece reaches over a character that is in none: those of ASCII are stretches of their own.
        cut = re.escape("".join(alone))
        self.stretch = re.compile(f" +[^ {cut}]*|[^ {cut}]+|[{cut}]" if cut else STRETCH)
        self.fixed = {c: (self.byte_ids[ord(c)],) for c in alone}
        self._forget()

    def _edge_ids(self, piece: str) -> tuple[int, ...]:
        return self.ids.get(piece) or tuple(self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass"))

    def _pieces(self, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pieces in a text of ``signs``: where they end, in order, and which they are; of equal ends the longest first."""
        h, ends, which = np.zeros(len(signs), np.uint64), [], []
        for n in range(1, min(self.longest, len(signs)) + 1):
            h = h[: len(signs) - n + 1] * _BASE + signs[n - 1 :]
            start = np.flatnonzero(self.maybe[(h * _SPREAD) >> _SHIFT])
            at = np.minimum(np.searchsorted(self.hashes, h[start]), len(self.hashes) - 1)
            piece = self.by_hash[at]
            true = (self.hashes[at] == h[start]) & (self.length[piece] == n)
            start, piece = start[true], piece[true]
            true = (signs[start[:, None] + np.arange(n)] == self.signs[piece, :n]).all(axis=1)
            ends.append(start[true] + n)
            which.append(piece[true])
        to = np.concatenate(ends[::-1])
        order = np.argsort(to, kind="stable")
        return to[order], np.concatenate(which[::-1])[order]

    def _invert(self, words: list[str], of: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The intervals of [0, 1) around each u that one segmentation of ``words[of]`` fills: low, high, how many ids, and all ids.

        Every character of the words is a piece; ``mass`` is that of all segmentations up to each place.
        Words are filtered forwards side by side, character by character, and sampled backwards
        piece by piece.
        """
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(lengths + 1) - lengths - 1
        to, piece = self._pieces(_signs(self.between.join(words)))
        source, weight = to - self.length[piece], self.weight[piece]
        size = int(lengths.sum()) + len(words)
        mass = np.zeros(size + 1)
        mass[starts] = 1.0
        level = (to - np.repeat(starts, lengths + 1)[to - 1]).astype(np.uint16)
        order = np.argsort(level, kind="stable")
        for edges in np.split(order, np.cumsum(np.bincount(level)[:-1])):
            np.add.at(mass, to[edges], mass[source[edges]] * weight[edges])
        last = np.cumsum(np.bincount(to, minlength=size + 1)) - 1
        low, width, n = np.zeros(len(u)), np.ones(len(u)), np.zeros(len(u), np.int64)
        live, j, steps = np.arange(len(u)), (starts + lengths)[of], []
        while len(live):
            total, below = mass[j], np.zeros(len(live))
            target, k, first = (u[live] - low[live]) / width[live] * total, last[j], last[j - 1]
            share = mass[source[k]] * weight[k]
            more = np.flatnonzero((target >= below + share) & (k - 1 > first))
            while len(more):
                below[more] += share[more]
                k[more] -= 1
                share[more] = mass[source[k[more]]] * weight[k[more]]
                more = more[(target[more] >= below[more] + share[more]) & (k[more] - 1 > first[more])]
            low[live] += below / total * width[live]
            width[live] *= share / total
            steps.append((live, self.id[piece[k]]))
            n[live] += 1
            j = source[k]
            on = j > starts[of[live]]
            live, j = live[on], j[on]
        ids, at = np.empty(int(n.sum()), np.int64), np.cumsum(n)
        for back, (who, chosen) in enumerate(steps, 1):
            ids[at[who] - back] = chosen
        return low, low + width, n, ids

    def _forget(self) -> None:
        """Starts the memory anew with what has one way only."""
        self.code: dict[str, int] = {c: k for k, c in enumerate(self.fixed)}
        self.pool = np.array([ids[0] for ids in self.fixed.values()], np.int64)
        self.at = np.arange(len(self.fixed))
        self.n = np.ones(len(self.fixed), np.int64)
        self.key, self.low, self.high = np.arange(len(self.fixed), dtype=float), np.zeros(len(self.fixed)), np.ones(len(self.fixed))

    def _remember(self, code: np.ndarray, low: np.ndarray, high: np.ndarray, n: np.ndarray, ids: np.ndarray) -> None:
        """Intervals stand sorted by code and lower end, for lookups of a whole batch at once."""
        key, order = np.unique(np.concatenate([self.key, code + low]), return_index=True)
        at = np.concatenate([self.at, len(self.pool) + np.cumsum(n) - n])
        self.key, self.at, self.n = key, at[order], np.concatenate([self.n, n])[order]
        self.low, self.high = np.concatenate([self.low, low])[order], np.concatenate([self.high, high])[order]
        self.pool = np.concatenate([self.pool, ids])

    def _long(self, s: str, rng: np.random.Generator) -> list[int]:
        log, longest = self.log, self.longest
        mass, into = np.zeros(len(s) + 1), [()]
        for j in range(1, len(s) + 1):
            edges = [(i, s[i:j], mass[i] + log[s[i:j]]) for i in range(max(0, j - longest), j) if s[i:j] in log]
            if s[j - 1] not in log:
                edges.append((j - 1, s[j - 1], mass[j - 1] + self.fallback))
            top = max(e[2] for e in edges)
            mass[j] = top + math.log(sum(math.exp(e[2] - top) for e in edges))
            into.append(edges)
        draws, j, out = rng.random(len(s)), len(s), []
        while j:
            u, below = draws[j - 1], 0.0
            for i, piece, m in into[j]:
                below += math.exp(m - mass[j])
                if u < below:
                    break
            out.append(piece)
            j = i
        return [i for piece in reversed(out) for i in self._edge_ids(piece)]

    def encode(self, text: str, key: object) -> list[int]:
        return self.encode_batch([text], [key])[0].tolist()

    def encode_batch(self, texts: list[str | None], keys: list) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after another, and how many each text has."""
        stretches: list[str] = []
        rngs, draws, upto = [], [np.empty(0)], []
        for text, key in zip(texts, keys):
            if text:
                seed = hashlib.blake2b(f"{self.params.seed}:{key}".encode(), digest_size=8).digest()
                rng = np.random.Generator(np.random.PCG64(int.from_bytes(seed, "big")))
                own = [" " + text] if self.whole else self.stretch.findall(" " + text)
                stretches += own
                draws.append(rng.random(len(own)))
                rngs.append(rng)
            else:
                rngs.append(None)
            upto.append(len(stretches))
        u, upto = np.concatenate(draws), np.array(upto, np.int64)
        n, ids = [np.empty(0, np.int64)], [np.empty(0, np.int32)]
        # A long text makes several parts, so what is held beside the ids doesn't grow with it.
        for a in range(0, len(stretches), self.params.part):
            b = min(a + self.params.part, len(stretches))
            found = self._encode_part(stretches[a:b], u[a:b], lambda i, a=a: rngs[np.searchsorted(upto, a + i, side="right")])
            ids.append(found[0])
            n.append(found[1])
        ends = np.cumsum(np.concatenate([[0], *n]))
        return np.concatenate(ids), np.diff(ends[np.concatenate([[0], upto])])

    def _encode_part(self, stretches: list[str], u: np.ndarray, rng_of) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some stretches, one after another, and how many each has."""
        code = np.fromiter(map(self.code.get, stretches, repeat(-1)), np.int64, len(stretches))
        # Where the interval below a key isn't the one around it, the draw is inverted by itself.
        k = np.maximum(np.searchsorted(self.key, code + u, side="right") - 1, 0)
        hit = (np.floor(self.key[k]) == code) & (self.low[k] <= u) & (u < self.high[k])
        at, n = self.at[k], self.n[k]
        missed = np.flatnonzero(~hit)
        words = list(map(stretches.__getitem__, missed.tolist()))
        short, single = self.params.short, self.single
        new = [s for s in dict.fromkeys(words) if len(s) <= short and single.issuperset(s)]
        numbers = {s: k for k, s in enumerate(new)}
        of = np.fromiter(map(numbers.get, words, repeat(-1)), np.int64, len(words))
        draw, of, long = missed[of >= 0], of[of >= 0], missed[of < 0].tolist()
        extra = [self.pool]
        beyond = len(self.pool)
        if len(draw):
            low, high, n[draw], ids = self._invert(new, of, u[draw])
            at[draw] = beyond + np.cumsum(n[draw]) - n[draw]
            extra.append(ids)
            beyond += len(ids)
            codes = np.array([self.code.setdefault(s, len(self.code)) for s in new], np.int64)[of]
            fits = (low <= u[draw]) & (u[draw] < high)
            self._remember(codes[fits], low[fits], high[fits], n[draw][fits], ids[np.repeat(fits, n[draw])])
        more: list[int] = []
        for i in long:
            ids = self._long(stretches[i], rng_of(i))
            at[i], n[i] = beyond + len(more), len(ids)
            more += ids
        pool = np.concatenate([*extra, np.array(more, np.int64)])
        ends = np.cumsum(n)
        out = pool[np.arange(int(ends[-1])) + np.repeat(at - (ends - n), n)].astype(np.int32)
        if len(self.code) >= self.params.remembered:
            self._forget()
        return out, n

    def decode(self, ids) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids))
        return (text[1:] if text[:1] == b" " else text).decode("utf-8", "surrogatepass")


@lru_cache(maxsize=2)
def _codec(params: PieceParams) -> Codec:
    """One codec for all tasks of a worker, which so share its memory."""
    return Codec(params)


def encode_pieces(docs: DataFrame, params: PieceParams = PieceParams(), key: str = "doc_id") -> DataFrame:
    """doc_id, piece_ids, n_pieces, and lossless: whether decoding gave the text back."""

    def make():
        codec = _codec(params)

        def work(batch):
            texts = batch["text"].to_pylist()
            ids, n = codec.encode_batch(texts, batch[key].to_pylist())
            upto = [0, *np.cumsum(n).tolist()]
            null = np.array([t is None for t in texts], bool)
            flat = ids.tolist()
            back = (codec.decode(flat[a:b]) for a, b in zip(upto, upto[1:]))
            return {
                "doc_id": batch["doc_id"], "piece_ids": pa.ListArray.from_arrays(pa.array(upto, pa.int32(), mask=np.append(null, False)), pa.array(ids)),
                "n_pieces": pa.array(n, pa.int64(), mask=null), "lossless": [None if t is None else t == b for t, b in zip(texts, back)],
            }

        return work

    return map_batches(docs.select(*dict.fromkeys(["doc_id", key, "text"])), make, "doc_id long, piece_ids array<int>, n_pieces long, lossless boolean", AT_ONCE)


def decode_pieces(encoded: DataFrame, params: PieceParams = PieceParams()) -> DataFrame:
    """doc_id and text of (doc_id, piece_ids)."""

    def make():
        codec = _codec(params)

        def work(batch):
            return {"doc_id": batch["doc_id"], "text": [None if x is None else codec.decode(x) for x in batch["piece_ids"].to_pylist()]}

        return work

    return map_batches(encoded.select("doc_id", "piece_ids"), make, "doc_id long, text string")
