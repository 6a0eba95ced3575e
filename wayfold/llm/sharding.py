"""Balanced label propagation: linked documents gather in one shard, shards stay even.

Documents with equal texts are linked: each with its group, so links are as many as rows.  All
start with the label (shard) of a hash of what they are.  In each round the labels of a group's
members are counted over the links; the group wants the shard where most of them are, of
those that can hold it whole; wishes are granted in a fixed order until a shard's quota is
full.  A join hands the granted labels to the members, and groups that still have cut links
turn to shards with room in the next round, until no shard can hold any of them.  Documents
without links then fill what is free.  The law is ``rows``: counts of shards differ by one at
most.

Groups of over a quarter of a shard (a few for each shard at most) are placed one by one
before the others: those that fit a quota whole, the largest first, after those that none
could hold, which fill shard by shard.  What fits nowhere is split over the shards with most
room; only its links are cut, and ``apart`` marks the rows beyond them.

Ranks and slots never sort a whole shard: rows are numbered within hash buckets, and
offsets of the buckets (of a bounded number) are joined to them.  Groups of over one in
``max_buckets`` rows, fewer than that, are joined by broadcast, so none of them fills a task.

Nothing depends on how the files are split: hashes are of doc_id, text and a number that tells
equal rows apart.

Edge cases: a null text has size 1 and the checksum of no bytes, and links to other null
texts; empty texts link to each other; repeated rows are rows of their own; an empty table
gives no rows; further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.skew import split_by_count
from wayfold.plans.staging import stage


@dataclass(frozen=True)
class ShardParams:
    shards: int = 16
    bucket_rows: int = 4096
    max_buckets: int = 4096


def _buckets(n: int, p: ShardParams) -> int:
    return max(8, min(p.max_buckets, -(-n // (p.shards * p.bucket_rows))))


#: What a row is; equal rows differ in ``dup``.
KEY = ["doc_id", "group", "dup"]


def _hash(salt: int) -> Column:
    return F.xxhash64(*KEY, F.lit(salt))


def _numbered(rows: DataFrame, by: list[str], key: Column, order: list, buckets: int, weight: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``weight`` over the earlier rows of the same ``by``.

    Rows come in the order of a hash bucket of ``key`` and then of ``order``.  The running sum is
    within a bucket; the buckets before it add an offset.
    """
    rows = rows.withColumn("__b", F.pmod(key, F.lit(buckets)).cast("int")).withColumn("__w", weight.cast("long"))
    sums = rows.groupBy(*by, "__b").agg(F.sum("__w").alias("__s"))
    before = F.sum("__s").over(Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select(*by, "__b", F.coalesce(before, F.lit(0)).alias("__o"))
    inner = F.sum("__w").over(Window.partitionBy(*by, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    # At most shards * max_buckets rows of a few numbers: a proven bound.
    out = rows.withColumn("__i", F.coalesce(inner, F.lit(0))).join(F.broadcast(offsets), [*by, "__b"])
    return out.withColumn(name, F.col("__i") + F.col("__o")).drop("__b", "__w", "__i", "__o")


def _counted(rows: DataFrame, by: str, n: int, p: ShardParams) -> tuple[DataFrame, DataFrame, int]:
    """The rows whose ``by`` others have too, with ``n``, how many they are: those of heavy keys, those of others, and the number of heavy keys."""
    counts = stage(rows.groupBy(by).agg(F.count("*").alias("n")).where("n > 1"), "shards-counts")
    return *split_by_count(rows, counts, by, n, most=p.max_buckets), counts.where(F.col("n") > n // p.max_buckets).count()


def _met(rows: DataFrame, groups: DataFrame, n: int, p: ShardParams, how: str = "inner") -> DataFrame:
    """Join by ``group`` of rows and groups that both have its size ``n``."""
    heavy = F.col("n") > n // p.max_buckets
    few = F.broadcast(groups.where(heavy).drop("n"))
    return rows.where(heavy).join(few, "group", how).unionByName(rows.where(~heavy).join(groups.where(~heavy).drop("n"), "group", how))


def _rows(docs: DataFrame, p: ShardParams) -> tuple[DataFrame, int]:
    """row, KEY, size and text_crc32 of each row of ``docs``, staged, and how many there are."""
    text = F.coalesce("text", F.lit(""))
    base = stage(
        docs.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
            F.xxhash64(F.col("text").isNull(), "text").alias("group"),
        ).withColumn("key", F.xxhash64("doc_id", "group")),
        "shards-rows",
    )
    n = base.count()
    heavy, light, keys = _counted(base, "key", n, p)
    heavy = _numbered(heavy, ["key"], F.xxhash64("row"), ["row"], max(1, p.shards * p.max_buckets // max(1, keys)), F.lit(1), "dup")
    light = light.withColumn("dup", F.row_number().over(Window.partitionBy("key").orderBy("row")) - 1)
    equal = stage(heavy.select("row", F.col("dup").cast("long")).union(light.select("row", F.col("dup").cast("long"))), "shards-equal")
    if not equal.limit(1).count():
        return base.withColumn("dup", F.lit(0).cast("long")).drop("key"), n
    return base.join(equal, "row", "left").fillna(0, ["dup"]).drop("key"), n


def _quotas(n: int, shards: int) -> list[int]:
    return [n // shards + (s < n % shards) for s in range(shards)]


def _wish(votes: list[str], room: list[int]) -> Column:
    """Of the shards that can hold the group, the one with most votes; of equals the first from a hash of the group on."""
    k = len(votes)
    best = F.lit(None).cast("struct<v:bigint,t:int,s:int>")
    for s, v in enumerate(votes):
        if room[s] > 0:
            tie = F.pmod(F.xxhash64("group") - s, F.lit(k)).cast("int")
            best = F.greatest(best, F.when(F.col("n") <= room[s], F.struct(F.col(v).alias("v"), tie.alias("t"), F.lit(s).alias("s"))))
    return best["s"]


def _pack(groups: list[tuple[int, int, list[int]]], room: list[int]) -> list[tuple[int, int, int, int]]:
    """Pieces (group, shard, first row, row after the last) of groups (group, n, votes); takes them from ``room``.

    A group that no shard can hold, even empty, fills the emptiest ones; then the others are
    placed whole, the largest first; at last what fits nowhere is split like the first.
    """
    pieces = []

    def split(group: int, n: int) -> None:
        at = 0
        while at < n:
            left = n - at
            # What remains goes whole into the fullest shard that can hold it, or else fills the emptiest one.
            holds = [s for s in range(len(room)) if room[s] >= left]
            shard = min(holds, key=lambda s: (room[s], s)) if holds and at else max(range(len(room)), key=lambda s: (room[s], -s))
            take = min(left, room[shard])
            pieces.append((group, shard, at, at + take))
            room[shard] -= take
            at += take

    most, split_later = max(room), []
    ordered = sorted(groups, key=lambda g: (-g[1], g[0]))
    for group, n, votes in ordered:
        if n > most:
            split(group, n)
            continue
        holds = [s for s in range(len(room)) if room[s] >= n]
        if not holds:
            split_later.append((group, n))
            continue
        shard = max(holds, key=lambda s: (votes[s], -s))
        pieces.append((group, shard, 0, n))
        room[shard] -= n
    for group, n in split_later:
        split(group, n)
    return pieces


def balanced_shards(docs: DataFrame, params: ShardParams = ShardParams()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and apart for each row of ``docs``.

    ``apart`` says that the row's shard isn't that of the first of its group: a cut link.
    """
    p = params
    base, n = _rows(docs, p)
    quotas = _quotas(n, p.shards)
    start = F.pmod(_hash(5), F.lit(p.shards)).cast("int")
    heavy, light, _ = _counted(base.select("row", *KEY), "group", n, p)
    labels = stage(heavy.unionByName(light).withColumn("shard", start), "shards-labels")

    room = list(quotas)
    votes = [f"v{s}" for s in range(p.shards)]

    def counted(labels: DataFrame) -> DataFrame:
        """Labels of each group's members: what each of them sees over its links."""
        of = [F.sum((F.col("shard") == s).cast("int")).alias(v) for s, v in enumerate(votes)]
        return stage(labels.groupBy("group").agg(F.count("*").alias("n"), *of), "shards-votes")

    def packed(big: DataFrame) -> list[tuple[int, int, int, int]]:
        return _pack([(r["group"], r["n"], [r[v] for v in votes]) for r in big.collect()], room)

    # More than a quarter of a shard: at most eight groups for each shard.
    large = F.col("n") * 4 > quotas[-1]
    pieces = packed(counted(labels.where(large)))
    dealt = [_dealt(labels.where(large), pieces, n, p)]
    waiting = labels.where(~large)
    while True:
        seen = counted(waiting)
        wishing = stage(seen.withColumn("wish", _wish(votes, room)).where("wish is not null").select("group", "n", "wish"), "shards-wishes")
        count = wishing.count()
        if not count:
            break
        ranked = _numbered(wishing, ["wish"], F.xxhash64("group", F.lit(3)), [F.desc("n"), "group"], _buckets(count, p), F.col("n"), "before")
        # The first of each shard's wishes fits, so every round grants some.
        fits = F.col("before") + F.col("n") <= F.element_at(F.array(*map(F.lit, room)), F.col("wish") + 1)
        granted = stage(ranked.where(fits).select("group", F.col("wish").alias("to"), "n"), "shards-granted")
        for r in granted.groupBy("to").agg(F.sum("n").alias("n")).collect():
            room[r["to"]] -= r["n"]
        moved = _met(waiting, granted, n, p).select("row", F.col("to").alias("shard"), F.lit(False).alias("apart"))
        dealt.append(stage(moved, "shards-moved"))
        waiting = stage(_met(waiting, granted, n, p, "left_anti"), "shards-waiting")
    # Each is larger than any room that is left, and all together are not: fewer than there are shards.
    rest = packed(seen)
    dealt.append(_dealt(waiting, rest, n, p))
    moved = dealt[0]
    for more in dealt[1:]:
        moved = moved.union(more)
    labels = stage(base.join(moved, "row", "left"), "shards-placed")
    filled = _fill(labels.where("shard is null"), room, n, p)
    placed = stage(labels.where("shard is not null").unionByName(filled), "shards-filled")
    out = _numbered(placed, ["shard"], _hash(13), KEY, _buckets(n, p), F.lit(1), "slot")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.coalesce("apart", F.lit(False)).alias("apart"),
    )


def _dealt(labels: DataFrame, pieces: list[tuple[int, int, int, int]], n: int, p: ShardParams) -> DataFrame:
    """(row, shard, apart) of the groups that have pieces, their rows in the order of their rank."""
    spark = labels.sparkSession
    at = F.broadcast(spark.createDataFrame(pieces, "group long, to int, first long, after long"))
    own = labels.select("row", *KEY).join(F.broadcast(at.select("group").distinct()), "group")
    ranked = _numbered(own, ["group"], _hash(11), KEY, _buckets(n, p) * p.shards, F.lit(1), "rank")
    return ranked.join(at, "group").where("rank >= first and rank < after").select("row", F.col("to").alias("shard"), (F.col("first") > 0).alias("apart"))


def _fill(free: DataFrame, room: list[int], n: int, p: ShardParams) -> DataFrame:
    """Rows without a shard, dealt in the order of their rank to the shards with room."""
    ranked = _numbered(free.withColumn("all", F.lit(0)), ["all"], _hash(7), KEY, _buckets(n, p) * p.shards, F.lit(1), "rank")
    shard, upto = F.lit(None).cast("int"), sum(room)
    for s in reversed(range(p.shards)):
        shard = F.when(F.col("rank") < upto, s).otherwise(shard) if room[s] else shard
        upto -= room[s]
    return ranked.withColumn("shard", shard).drop("all", "rank")
