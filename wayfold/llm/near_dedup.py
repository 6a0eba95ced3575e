"""Near-duplicate groups by one-permutation MinHash, with every link confirmed on full sets.

1.  Each text becomes its set of distinct word shingles (64-bit hashes), a one-permutation
    sketch (the least hash in each of ``bands * rows`` bins) densified optimally (an empty bin
    borrows from the first filled one in a permutation of its own), and one key per band.
2.  Equal sets are one node from here on, named by a 64-bit hash of the set: copies by the
    thousand cost one row each and no pair.
3.  Documents that share a band key are a bucket.  The member that meets the most others
    over all its buckets is the bucket's hub, and the bucket emits a star: an edge from each
    other member to the hub, never all pairs.  An original is met by all its edited copies,
    so it becomes the hub of them.
4.  Star edges are confirmed on full sets; confirmed ones make components.
5.  Two members of a star may be linked though one or both aren't linked with its hub.  Where
    a star still spans components, its members outside the hub's component are compared
    with all other members of the star, exactly, in blocks of bounded size; only links that
    join components are emitted.

What can be missed is a pair that meets in no bucket: at a similarity of 0.8,
``(1 - 0.8 ** rows) ** bands``, 3e-6 with the defaults, and less for closer pairs.

Rows have numbers that hold whenever they are read (``rows.numbered``): what is joined again later
is joined by that number, so neither null nor repeated ids make a hot key or multiply rows, and no
copy of the texts is written.  A hub with many leaves is dealt out under several salts, ``leaves`` of
them each.  Tables of the shared folder are deleted as soon as nothing reads them again.

Edge cases: null and empty texts have empty sets and are linked with nothing; a text of
fewer words than a shingle is one shingle; rows with the same doc_id are judged each by its own
text; a null doc_id never names a component and is kept only if nothing in its group has an
id; further columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.arrow import map_batches
from wayfold.llm.components import components
from wayfold.llm.rows import maybe, numbered, without
from wayfold.plans.staging import stage, unstage

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_UPPER = re.compile("[A-Z]+")
_M = np.uint64(0xFF51AFD7ED558CCD)
_N = np.uint64(0xC4CEB9FE1A85EC53)


@dataclass(frozen=True)
class DedupParams:
    """Links have ``100 * intersection >= percent * union``.  ``leaves`` of a hub are confirmed together,
    and ``block_tokens`` is how many shingles a block holds in step 5."""

    shingle: int = 5
    percent: int = 80
    bands: int = 24
    rows: int = 4
    seed: int = 1
    leaves: int = 500
    block_tokens: int = 100_000


def ascii_lower(text: str) -> str:
    return _UPPER.sub(lambda m: m[0].lower(), text)


class WordHashes(dict):
    """64-bit hashes of words with A-Z lower-cased; forgets all when full."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(ascii_lower(word).encode("utf-8", "surrogatepass"))
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * _M
    x = x ^ (x >> np.uint64(29))
    x = x * _N
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the text's k-word shingles; of all its words if there are fewer."""
    words = WORD.findall(text) if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.array([hashes[w] for w in words], np.uint64)
    k = min(k, len(h))
    out = h[: len(h) - k + 1]
    for i in range(1, k):
        out = _mix(out * np.uint64(3)) + h[i : len(h) - k + 1 + i]
    return np.unique(_mix(out + np.uint64(k)))


class Sketcher:
    """One-permutation sketches of sorted distinct hashes, and their band keys."""

    def __init__(self, bands: int, rows: int, seed: int):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        rng = np.random.Generator(np.random.PCG64(seed))
        self.salt = np.uint64(rng.integers(1, 1 << 62))
        self.probes = np.stack([rng.permutation(self.bins) for _ in range(self.bins)])
        self.probes[:, :] = np.where(self.probes == np.arange(self.bins)[:, None], self.probes[:, :1], self.probes)
        self.probes[:, 0] = np.arange(self.bins)
        self.columns = np.arange(1, bands + 1, dtype=np.uint64)

    def sketch(self, h: np.ndarray) -> np.ndarray:
        """The least value in each bin, or of the bin that an empty one borrows from."""
        with np.errstate(over="ignore"):
            v = _mix(h ^ self.salt)
        bin_of = (v % np.uint64(self.bins)).astype(np.int64)
        least = np.full(self.bins, np.iinfo(np.uint64).max, np.uint64)
        order = np.lexsort((v, bin_of))
        filled, first = np.unique(bin_of[order], return_index=True)
        least[filled] = v[order][first]
        has = np.zeros(self.bins, bool)
        has[filled] = True
        return least[self.probes[np.arange(self.bins), has[self.probes].argmax(axis=1)]]

    def keys(self, sketch: np.ndarray) -> np.ndarray:
        out = self.columns.copy()
        with np.errstate(over="ignore"):
            for column in sketch.reshape(self.bands, self.rows).T:
                out = _mix(out * np.uint64(31) + column)
        return out.view(np.int64)


def _name(s: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _sketches(docs: DataFrame, p: DedupParams) -> DataFrame:
    def make():
        hashes, sketcher = WordHashes(), Sketcher(p.bands, p.rows, p.seed)

        def work(batch):
            n, node, bands = [], [], []
            for text in batch["text"].to_pylist():
                with np.errstate(over="ignore"):
                    s = shingles(text, p.shingle, hashes)
                n.append(len(s))
                node.append(_name(s) if len(s) else None)
                bands.append(sketcher.keys(sketcher.sketch(s)) if len(s) else None)
            return {"row": batch["row"], "doc_id": batch["doc_id"], "n_shingles": n, "node": node, "bands": bands}

        return work

    return map_batches(docs.select("row", "doc_id", "text"), make, "row long, doc_id long, n_shingles long, node long, bands array<long>")


_HUBS = "array<struct<hub:bigint,salt:int>>"


def _sets(texts: DataFrame, p: DedupParams) -> DataFrame:
    """(node, hubs, tokens) of (node, hubs, text), where the text is the node's."""

    def make():
        hashes = WordHashes()

        def work(batch):
            with np.errstate(over="ignore"):
                sets = [shingles(t, p.shingle, hashes) for t in batch["text"].to_pylist()]
            return {"node": batch["node"], "hubs": batch["hubs"], "tokens": [s.view(np.int64) for s in sets]}

        return work

    return map_batches(texts.select("node", "hubs", "text"), make, f"node long, hubs {_HUBS}, tokens array<long>")


def _stars(nodes: DataFrame, p: DedupParams) -> tuple[DataFrame, DataFrame]:
    """From (node, bands): (leaf, hub, salt) for each node and the hubs of its buckets other than itself; (hub, salts)."""
    met = nodes.select("node", F.explode("bands").alias("key"))
    sizes = met.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    met = stage(met.join(sizes, "key"), "dedup-buckets")
    popular = met.groupBy("node").agg(F.sum("size").alias("met"))
    hubs = (
        met.select("key", "node").join(popular, "node").groupBy("key")
        .agg(F.max(F.struct("met", "node")).alias("top"))
        .select("key", F.col("top.node").alias("hub"))
    )
    edges = met.select("key", "node").join(hubs, "key").where("node <> hub")
    edges = stage(edges.select(F.col("node").alias("leaf"), "hub").distinct(), "dedup-edges")
    unstage(met)
    salts = stage(edges.groupBy("hub").agg(F.ceil(F.count("*") / p.leaves).cast("int").alias("salts")), "dedup-hubs")
    return edges.join(salts, "hub").select("leaf", "hub", F.pmod(F.xxhash64("leaf", F.lit(19)), "salts").cast("int").alias("salt")), salts


def _linked(p: DedupParams, inter: str = "inter", a: str = "n_a", b: str = "n_b"):
    return F.expr(f"100 * {inter} >= {p.percent} * ({a} + {b} - {inter})")


def _within_stars(confirmed: DataFrame, sets: DataFrame, labels: DataFrame, p: DedupParams) -> DataFrame:
    """Step 5: (a, b) links between components that meet in one star; empty in most cases.

    ``confirmed`` has leaf, hub, inter, n_a (of the leaf), n_b (of the hub).
    """
    label = labels.select(F.col("node").alias("leaf"), F.col("component").alias("own"))
    members = confirmed.select("leaf", "hub", "n_a", (1 - F.expr("inter / (n_a + n_b - inter)")).alias("far"))
    members = members.join(label, "leaf", "left").withColumn("own", F.coalesce("own", "leaf"))
    hub_label = labels.select(F.col("node").alias("hub"), F.col("component").alias("of_hub"))
    members = members.join(hub_label, "hub", "left").withColumn("of_hub", F.coalesce("of_hub", "hub"))
    members = stage(members, "dedup-members")
    # Two members at distances f and g from their hub are at least |f - g| apart.
    mixed = (
        members.groupBy("hub").agg(F.count("*").alias("n"), F.sum("n_a").alias("total"), F.sum((F.col("own") != F.col("of_hub")).cast("int")).alias("out"), F.min("own").alias("lo"), F.max("own").alias("hi"))
        .where("n > 1 and out > 0 and lo <> hi")
        .select("hub", F.expr(f"cast(ceil(total / {p.block_tokens}) as int)").alias("blocks"))
    )
    rows = members.join(mixed, "hub").join(sets.select(F.col("node").alias("leaf"), "tokens"), "leaf")
    block = F.pmod(F.xxhash64("leaf"), F.col("blocks")).cast("int")
    every = F.expr("sequence(0, blocks - 1)")
    cols = ["hub", "leaf", "own", "far", "tokens"]
    outside = rows.where("own <> of_hub").select(*cols, F.lit(True).alias("probe"), block.alias("i"), F.explode(every).alias("j"))
    others = rows.select(*cols, F.lit(False).alias("probe"), F.explode(every).alias("i"), block.alias("j"))
    percent = p.percent

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        probes, rest = pdf[pdf.probe], pdf[~pdf.probe]
        found: list[tuple[int, int]] = []
        if len(probes) and len(rest):
            lengths = rest.tokens.map(len).to_numpy()
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            vocabulary, at = np.unique(np.concatenate(rest.tokens.to_list()), return_inverse=True)
            own, far, ids = rest.own.to_numpy(), rest.far.to_numpy(), rest.leaf.to_numpy()
            for u in probes.itertuples():
                may = (own != u.own) & (np.abs(far - u.far) <= 1 - percent / 100 + 1e-9)
                if not may.any():
                    continue
                flags = np.zeros(len(vocabulary), np.int64)
                k = np.searchsorted(vocabulary, u.tokens)
                k[k == len(vocabulary)] = 0
                flags[k[vocabulary[k] == u.tokens]] = 1
                inter = np.add.reduceat(flags[at], starts)
                hit = may & (100 * inter >= percent * (len(u.tokens) + lengths - inter))
                # One link into each other component is enough here.
                _, first = np.unique(own[hit], return_index=True)
                found += [(u.leaf, b) for b in ids[hit][first]]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    found = stage(outside.union(others).groupBy("hub", "i", "j").applyInPandas(compare, "a long, b long").distinct(), "dedup-more")
    unstage(members)
    return found


def _judged(rows: DataFrame, p: DedupParams) -> DataFrame:
    """row, doc_id, n_shingles, component_id and root (of the same component; null for empty sets) for each of the numbered ``rows``."""
    sketched = stage(_sketches(rows, p), "dedup-sketches")
    filled = sketched.where("n_shingles > 0")
    # Any row of a node has its set: the first one stands for it.
    nodes = stage(filled.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("row").alias("row")), "dedup-nodes")
    stars, salts = _stars(filled.join(nodes.select("row"), "row", "left_semi").select("node", "bands"), p)
    leaves = stars.groupBy(F.col("leaf").alias("node")).agg(F.collect_list(F.struct("hub", "salt")).alias("hubs"))
    wanted = leaves.join(salts.select(F.col("hub").alias("node"), "salts"), "node", "full")
    wanted = stage(wanted.join(nodes, "node").select("row", "node", F.coalesce("hubs", F.array().cast(_HUBS)).alias("hubs")), "dedup-wanted")
    # Most texts are in no star, and aren't shuffled.
    sets = stage(_sets(rows.select("row", "text").where(maybe(wanted)).join(wanted, "row"), p), "dedup-sets")
    unstage(wanted)
    salted = salts.select("hub", F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"))
    hub_sets = sets.select(F.col("node").alias("hub"), F.col("tokens").alias("tb")).join(salted, "hub")
    confirmed = stage(
        sets.select(F.col("node").alias("leaf"), F.explode("hubs").alias("of"), F.col("tokens").alias("ta")).select("leaf", "of.*", "ta")
        .join(hub_sets, ["hub", "salt"])
        .select("leaf", "hub", F.size(F.array_intersect("ta", "tb")).cast("long").alias("inter"), F.size("ta").cast("long").alias("n_a"), F.size("tb").cast("long").alias("n_b")),
        "dedup-confirmed",
    )
    unstage(stars)
    links = stage(confirmed.where(_linked(p)).select(F.col("leaf").alias("a"), F.col("hub").alias("b")), "dedup-links")
    labels = components(links)
    more = _within_stars(confirmed, sets, labels, p)
    unstage(sets)
    unstage(confirmed)
    if more.limit(1).count():
        unstage(labels)
        labels = components(links.union(more))
    unstage(links)
    unstage(more)
    rooted = nodes.join(labels, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("root"))
    named = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_node = rooted.select("node", "root").join(named, "root")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    judged = sketched.select("row", "doc_id", "n_shingles", "node").join(by_node, "node", "left").select("row", "doc_id", "n_shingles", component.alias("component_id"), "root")
    judged = stage(judged, "dedup-judged")
    for table in (sketched, nodes, labels):
        unstage(table)
    return judged


def near_duplicates(docs: DataFrame, params: DedupParams = DedupParams()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs``."""
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return _judged(numbered(docs).select("row", "body.doc_id", "body.text"), params).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame, params: DedupParams = DedupParams()) -> DataFrame:
    """The rows of ``docs`` that stay, with all columns: one of each group, and all without words.

    It is a row with the group's smallest doc_id; the first such row, if there are several, and the
    first of all, if none has an id.
    """
    rows = numbered(docs)
    names = F.col("component_id").isNull() | F.col("doc_id").eqNullSafe(F.col("component_id"))
    judged = _judged(rows.select("row", "body.doc_id", "body.text"), params)
    grouped = judged.where("root is not null")
    chosen = grouped.where(names).groupBy("root").agg(F.min("row").alias("row")).select("row")
    gone = stage(grouped.select("row").join(chosen, "row", "left_anti"), "dedup-gone")
    unstage(judged)
    return without(rows, gone).select("body.*")
