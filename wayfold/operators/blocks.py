"""Blocks of a network: nodes that lie together, some thousands to a block.

Searches of bounded reach run block by block over what the block's points can reach, so no
task holds the whole network and no label crosses the cluster.  Which node is in which block
changes nothing but the cost: any dealing gives the same results.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.plans.staging import stage

#: Links that the driver's Python deals out itself (16 bytes each); in a larger network neighbours are joined first.
DRIVER_LINKS = 1_000_000
#: Nodes in a block, and the blocks that a small network is dealt into at least.
LEAST, MOST, BLOCKS = 1_000, 4_000, 24


def blocks(arcs: DataFrame, driver_links: int = DRIVER_LINKS) -> DataFrame:
    """(node, block), staged; nodes that are linked with no other may be missing."""
    links = arcs.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    links, within, level = stage(links.distinct(), "block-links"), None, 0
    while links.count() > driver_links:
        joined = _joined(links, level)
        within = joined if within is None else stage(within.join(joined.select(F.col("a").alias("part"), "to"), "part", "left").select("a", F.coalesce("to", "part").alias("to")), "block-parts")
        within = within.select("a", F.col("to").alias("part"))
        one, two = joined.select("a", F.col("to").alias("ta")), joined.select(F.col("a").alias("b"), F.col("to").alias("tb"))
        crossing = links.join(one, "a").join(two, "b").where("ta <> tb")
        links = stage(crossing.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "block-links")
        level += 1
    table = links.toArrow()
    a, b = table["a"].to_numpy(), table["b"].to_numpy()
    ids, sizes, alone = np.unique(np.concatenate([a, b])), None, 1
    if within is not None:
        parts = within.groupBy("part").agg(F.count("*").alias("n"))
        linked = links.select(F.col("a").alias("part")).union(links.select("b")).distinct()
        counted = parts.join(linked, "part").toArrow()
        sizes = np.zeros(len(ids), np.int64)
        sizes[np.searchsorted(ids, counted["part"].to_numpy())] = counted["n"].to_numpy()
        alone = max(1, within.count() // MOST)
    dealt = pa.table({"part": pa.array(ids, pa.int64()), "block": pa.array(deal(a, b, ids, sizes), pa.int64())})
    dealt = stage(arcs.sparkSession.createDataFrame(dealt), "blocks-dealt")
    if within is None:
        return dealt.withColumnRenamed("part", "node")
    # What has become one part without links is dealt by number.
    rest = -1 - F.pmod(F.xxhash64("part"), F.lit(alone))
    return stage(within.join(dealt, "part", "left").select(F.col("a").alias("node"), F.coalesce("block", rest).alias("block")), "blocks")


def _joined(links: DataFrame, level: int) -> DataFrame:
    """(a, to), staged: each end with the least nearby, by a hash of the level; about a fifth of the ends remain."""
    both = links.union(links.select("b", "a"))
    key = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(level)).alias("h"), F.col(c).alias("id"))
    out = stage(both.groupBy("a").agg(F.min(key("b")).alias("m")).select("a", F.least(key("a"), "m")["id"].alias("to")), "block-joined")
    for _ in range(2):
        out = stage(out.join(out.select(F.col("a").alias("to"), F.col("to").alias("next")), "to").select("a", F.col("next").alias("to")), "block-joined")
    return out


def deal(a: np.ndarray, b: np.ndarray, ids: np.ndarray, sizes: np.ndarray | None = None) -> list[int]:
    """The block of each of ``ids``: grown breadth first to its size, the next one from what was left beside it."""
    n = len(ids)
    x, y = np.searchsorted(ids, a), np.searchsorted(ids, b)
    src, dst = np.concatenate([x, y]), np.concatenate([y, x])
    order = np.argsort(src, kind="stable")
    first, beside = np.searchsorted(src[order], np.arange(n + 1)).tolist(), dst[order].tolist()
    size = [1] * n if sizes is None else sizes.tolist()
    target = min(MOST, max(LEAST, sum(size) // BLOCKS))
    block, k, held, waiting = [-1] * n, 0, 0, deque()
    for start in range(n):
        waiting.append(start)
        while waiting:
            grown = deque([waiting.popleft()])
            if held >= target:
                k, held = k + 1, 0
            while grown and held < target:
                p = grown.popleft()
                if block[p] < 0:
                    block[p] = k
                    held += size[p]
                    grown.extend(q for q in beside[first[p] : first[p + 1]] if block[q] < 0)
            waiting.extend(q for q in grown if block[q] < 0)
    return block
