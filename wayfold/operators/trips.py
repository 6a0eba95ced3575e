"""Trip generation: how many trips each origin sends to each destination.

Two families differ by design: the one of the aggregate engine and the one of enumerated
alternatives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.decay import LN99, exponential, logistic, radius_logistic
from wayfold.operators.access import weighted
from wayfold.params import Settings


def _rows(pairs: DataFrame, origins: DataFrame, destinations: DataFrame, s: Settings) -> DataFrame:
    """o, dest, d, w (destination), ow (origin); origins without weight send nothing."""
    own = origins.select(F.col("pt_id").alias("o"), (F.col("weight") if s.flow_origin_weights else F.lit(1.0)).alias("ow"))
    rows = weighted(pairs.where(F.col("d") <= s.search_radius), destinations)
    if not s.flow_destination_weights:
        rows = rows.withColumn("w", F.lit(1.0))
    if s.flow_k_nearest_destinations and s.flow_engine == "k_alternatives":
        k = s.flow_k_nearest_destinations
        rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("o").orderBy("d", "dest"))).where(F.col("k") <= k).drop("k")
    return rows.join(own, "o").where(F.col("ow") > 0)


def trips(pairs: DataFrame, origins: DataFrame, destinations: DataFrame, s: Settings = Settings(), cap: float = 1.0) -> DataFrame:
    """(o, dest, d, trips) by the settings' engine; pairs without trips are no rows."""
    rows = _rows(pairs, origins, destinations, s)
    out = (_aggregate if s.flow_engine == "aggregate_flow" else _alternatives)(rows, s, cap)
    return out.where(F.col("trips") > 0).select("o", "dest", "d", "trips")


def _nearest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("o", "ow").agg(F.min(F.struct("d", "dest", "w")).alias("b")).select("o", "ow", "b.d", "b.dest", "b.w")


def _aggregate(rows: DataFrame, s: Settings, cap: float) -> DataFrame:
    d, by = F.col("d"), Window.partitionBy("o")

    def decay(x: Column) -> Column:
        return radius_logistic(x, s.search_radius) if s.flow_decay_curve == "logistic" else F.exp(-s.gravity_beta * x)

    if s.use_nearest_destination:
        near = _nearest(rows)
        return near.withColumn("trips", F.col("ow") * (decay(d) if s.flow_decay else F.col("w")))
    if not s.flow_decay:
        return rows.withColumn("trips", F.col("ow") * F.col("w") / F.sum("w").over(by))
    rows = rows.withColumn("g", F.col("w") * decay(d)).withColumns({"all": F.sum("g").over(by), "least": F.min("d").over(by)})
    share = F.when(F.col("all") > 0, F.col("g") / F.col("all")).otherwise(0.0)
    factor = {
        "closest": decay(F.col("least")),
        "gravity_cap": F.least(F.col("all") / cap, F.lit(1.0)),
        "destination_decay": decay(d),
    }[s.flow_decay_method]
    return rows.withColumn("trips", F.col("ow") * factor * share)


def _alternatives(rows: DataFrame, s: Settings, cap: float) -> DataFrame:
    d, by = F.col("d"), Window.partitionBy("o")
    slope = LN99 / s.gravity_logistic_midpoint if s.flow_decay_method == "closest" else s.gravity_beta

    def curve(x: Column) -> Column:
        x = F.greatest(x - s.gravity_plateau, F.lit(0.0))
        return logistic(x, slope, s.gravity_logistic_midpoint) if s.flow_decay_curve == "logistic" else F.exp(-s.gravity_beta * x)

    if s.use_nearest_destination:
        rows = _nearest(rows).withColumn("share", F.lit(1.0))
    elif s.flow_destination_weights:
        # The share is always exponential, whatever curve the factor has.
        rows = rows.withColumn("g", F.col("w") * exponential(d, s.gravity_beta, s.gravity_plateau))
        rows = rows.withColumn("share", F.when(F.sum("g").over(by) > 0, F.col("g") / F.sum("g").over(by)).otherwise(0.0))
    else:
        rows = rows.withColumn("share", 1 / F.count("*").over(by))
    if not s.flow_decay:
        factor = F.lit(1.0)
    elif s.flow_decay_method == "closest":
        factor = curve(F.min("d").over(by))
    elif s.flow_decay_method == "gravity_cap":
        factor = F.least(F.sum(F.col("w") * curve(d)).over(by) / cap, F.lit(1.0))
    else:
        factor = curve(d)
    return rows.withColumn("trips", F.col("ow") * factor * F.col("share"))
