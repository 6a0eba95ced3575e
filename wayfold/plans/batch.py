"""Many parameter rows over one network: one path join at the largest radius, refolded for each row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators import access, pathjoin
from wayfold.params import Settings
from wayfold.plans.staging import stage


def shared_pairs(rows: list[Settings], origins: DataFrame, destinations: DataFrame, arcs: DataFrame) -> DataFrame:
    """The staged pairs at the largest radius of the rows; a row takes those within its own."""
    return stage(pathjoin.od(origins, destinations, arcs, max(r.search_radius for r in rows)), "batch-pairs")


def composite_access(rows: list[Settings], origins: DataFrame, destinations: DataFrame, arcs: DataFrame, metric: str) -> DataFrame:
    """pt_id with ``<metric>_<name>`` per row and their sum."""
    names = [r.name for r in rows]
    if len(set(names)) < len(names):
        raise ValueError("rows of a composite need names of their own")
    pairs = shared_pairs(rows, origins, destinations, arcs)
    out = origins.select("pt_id")
    for r in rows:
        one = access.accessibility(pairs.where(F.col("d") <= r.search_radius), origins, destinations, r)
        out = out.join(one.select("pt_id", F.col(metric).alias(f"{metric}_{r.name}")), "pt_id")
    total = reduce(lambda a, b: a + b, (F.col(f"{metric}_{n}") for n in names))
    return out.withColumn(rows[0].composite_column, total)
