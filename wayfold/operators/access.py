"""Accessibility of origins from a table of pairs (o, dest, d) and weighted destinations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.decay import exponential, logistic_gravity
from wayfold.params import Settings

METRICS = ["reach", "gravity_exponential", "gravity_logistic", "knn_access"]


def weighted(pairs: DataFrame, destinations: DataFrame) -> DataFrame:
    return pairs.join(destinations.select(F.col("pt_id").alias("dest"), F.col("weight").alias("w")), "dest")


def _decay(kind: str, d: Column, s: Settings) -> Column:
    if kind == "exponential":
        return exponential(d, s.gravity_beta, s.gravity_plateau)
    if kind == "logistic":
        return logistic_gravity(d, s.logistic_slope, s.gravity_logistic_midpoint, s.gravity_plateau)
    return F.lit(1.0)


def _coefficient(weights: tuple[float, ...], rank: Column) -> Column:
    return F.element_at(F.array(*(F.lit(float(c)) for c in weights)), rank)


def accessibility(pairs: DataFrame, origins: DataFrame, destinations: DataFrame, s: Settings = Settings(), suffix: str = "") -> DataFrame:
    """pt_id with the four metrics, 0 where no destination is in reach.

    One pass: ranks for the nearest destinations come from a window over the origin, whose
    partitioning the aggregation then reuses.
    """
    d = F.col("d")
    rank = F.row_number().over(Window.partitionBy("o").orderBy("d", "dest"))
    rows = weighted(pairs.where(d <= s.search_radius), destinations).withColumn("rank", rank)
    k = len(s.knn_weights)
    near = F.when(F.col("rank") <= k, _coefficient(s.knn_weights, F.least("rank", F.lit(k))) * F.col("w") * _decay(s.knn_decay, d, s))
    reach = F.sum("w")
    got = rows.groupBy(F.col("o").alias("pt_id")).agg(
        (F.floor(reach) if s.profile == "legacy" else reach).cast("double").alias("reach"),
        F.sum(F.col("w") * _decay("exponential", d, s)).alias("gravity_exponential"),
        F.sum(F.col("w") * _decay("logistic", d, s)).alias("gravity_logistic"),
        F.sum(near).alias("knn_access"),
    )
    out = origins.select("pt_id").join(got, "pt_id", "left").fillna(0.0, METRICS)
    return out.select("pt_id", *(F.col(m).alias(m + suffix) for m in METRICS))


def gravity_cap(pairs: DataFrame, origins: DataFrame, destinations: DataFrame, s: Settings) -> float:
    """The cap as a number: given, or a percentile of the origins' gravity, 99th and maximum behind it while it is 0."""
    cap = s.flow_gravity_cap
    if not isinstance(cap, str):
        return float(cap)
    column = "gravity_logistic" if s.flow_decay_curve == "logistic" else "gravity_exponential"
    got = cap_candidates(pairs, origins, destinations, s, column, 1.0 if cap == "max" else int(cap[1:]) / 100).first()
    return next((x for x in got if x), 1.0)


def cap_candidates(pairs: DataFrame, origins: DataFrame, destinations: DataFrame, s: Settings, column: str, q: float) -> DataFrame:
    """One row: the percentile, the 99th and the maximum of the origins' gravity, rounded to four places."""
    g = accessibility(pairs, origins, destinations, s).select(F.col(column).alias("g")).where(~F.isnan("g") & (F.abs("g") < float("inf")))
    return g.agg(F.round(F.percentile("g", q), 4).alias("cap"), F.round(F.percentile("g", 0.99), 4).alias("p99"), F.round(F.max("g"), 4).alias("largest"))


def power_gravity(pairs: DataFrame, destinations: DataFrame, alpha: float, beta: float) -> DataFrame:
    """o with reach and the gravity of weights to a power."""
    return weighted(pairs, destinations).groupBy("o").agg(F.sum("w").alias("reach"), F.sum(F.pow("w", F.lit(alpha)) * F.exp(-beta * F.col("d"))).alias("gravity"))


def unweighted_knn(pairs: DataFrame, origins: DataFrame, weights: tuple[float, ...], beta: float, plateau: float) -> DataFrame:
    """o with the access to its nearest destinations whatever their weights, and that times its own weight."""
    rank = F.row_number().over(Window.partitionBy("o").orderBy("d", "dest"))
    c = _coefficient(weights, F.col("rank"))
    near = pairs.withColumn("rank", rank).where(F.col("rank") <= len(weights))
    got = near.groupBy("o").agg(F.sum(c * exponential(F.col("d"), beta, plateau)).alias("knn_access"))
    return got.join(origins.select(F.col("pt_id").alias("o"), "weight"), "o").select("o", "knn_access", (F.col("knn_access") * F.col("weight")).alias("knn_weight"))


def nearest(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest destinations of each origin."""
    rank = F.row_number().over(Window.partitionBy("o").orderBy("d", "dest"))
    return pairs.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def pair_stats(pairs: DataFrame) -> DataFrame:
    """o with the count, the closest and the furthest of its destinations."""
    return pairs.groupBy("o").agg(F.count("*").alias("n_dests"), F.min("d").alias("closest"), F.max("d").alias("furthest"), F.min_by("dest", F.struct("d", "dest")).alias("closest_dest"))


def closest_facility(pairs: DataFrame) -> DataFrame:
    """Each destination with its nearest origin (the smaller id of equals)."""
    return pairs.groupBy("dest").agg(F.min(F.struct("d", "o")).alias("b")).select("dest", "b.o", "b.d")


def min_max(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with the column scaled to 0..1; the extremes come from one aggregation, joined as a single row."""
    ends = rows.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    out = rows.join(F.broadcast(ends))
    return out.withColumn(f"{column}_normalised", F.when(F.col("hi") > F.col("lo"), (F.col(column) - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)).drop("lo", "hi")


def striped_sum(rows: DataFrame, key: str, column: str, stripes: int = 32) -> DataFrame:
    """A sum per key whose bits don't depend on partitioning: ordered within stripes, then over the stripes.

    ``rows`` have a position ``i`` that is unique within the key.
    """
    total = "aggregate(transform(array_sort(collect_list(struct({0}, {1}))), x -> x.{1}), 0D, (a, x) -> a + x)"
    part = rows.withColumn("stripe", F.pmod("i", F.lit(stripes))).groupBy(key, "stripe").agg(F.expr(total.format("i", column)).alias("part"))
    return part.groupBy(key).agg(F.expr(total.format("stripe", "part")).alias(column))
