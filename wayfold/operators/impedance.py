"""Costs of arcs beyond length: elevation, obstacles, turns.  All of them add up."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.geometry import straightness, via_angle


def with_elevation(arcs: DataFrame, nodes: DataFrame, penalty: float) -> DataFrame:
    """Uphill costs ``penalty`` per unit of height; unknown heights cost nothing."""
    z = nodes.select("node_id", "z")
    out = arcs.join(z.select(F.col("node_id").alias("src"), F.col("z").alias("z1")), "src", "left")
    out = out.join(z.select(F.col("node_id").alias("dst"), F.col("z").alias("z2")), "dst", "left")
    climb = F.coalesce(F.greatest(F.col("z2") - F.col("z1"), F.lit(0.0)), F.lit(0.0))
    return out.select(*[c for c in arcs.columns if c != "w"], (F.col("w") + penalty * climb).alias("w"))


def _direction() -> Column:
    """What the obstacle holds in: ab, ba, or anything else (nothing, too) for both."""
    return F.coalesce(F.lower(F.trim("direction")), F.lit("both")).alias("direction")


def arc_penalties(obstacles: DataFrame) -> DataFrame:
    """(edge_id, dir, penalty) of obstacles on edges: the sum over those that hold in the direction."""
    both = F.explode(F.array(F.struct(F.lit(0).alias("dir"), F.lit("ab").alias("of")), F.struct(F.lit(1).alias("dir"), F.lit("ba").alias("of"))))
    rows = obstacles.select("edge_id", "penalty", _direction(), both.alias("b"))
    held = rows.where((F.col("direction") == F.col("b.of")) | ~F.col("direction").isin("ab", "ba"))
    return held.groupBy("edge_id", F.col("b.dir").alias("dir")).agg(F.sum("penalty").alias("penalty"))


def with_obstacles(arcs: DataFrame, obstacles: DataFrame) -> DataFrame:
    out = arcs.join(arc_penalties(obstacles), ["edge_id", "dir"], "left")
    return out.select(*[c for c in arcs.columns if c != "w"], (F.col("w") + F.coalesce("penalty", F.lit(0.0))).alias("w"))


def with_node_obstacles(arcs: DataFrame, obstacles: DataFrame) -> DataFrame:
    """Obstacles at nodes (node_id, penalty) are paid on entering."""
    held = obstacles.groupBy(F.col("node_id").alias("dst")).agg(F.sum("penalty").alias("penalty"))
    out = arcs.join(held, "dst", "left")
    return out.select(*[c for c in arcs.columns if c != "w"], (F.col("w") + F.coalesce("penalty", F.lit(0.0))).alias("w"))


def crossed_between(points: DataFrame, obstacles: DataFrame, leaving: bool) -> DataFrame:
    """Points with what obstacles on their own edge add on the way to each end.

    An obstacle is crossed on the way to an end if it is strictly nearer to that end than the
    point.  An origin leaves for the start backwards (ba) and for the end forwards (ab); a
    destination is reached from the start forwards and from the end backwards.
    """
    to_start, to_end = ("ba", "ab") if leaving else ("ab", "ba")
    o = obstacles.select("edge_id", F.col("w_start").alias("os"), F.col("w_end").alias("oe"), "penalty", _direction())
    met = points.select("pt_id", "edge_id", "w_start", "w_end").join(o, "edge_id")

    def paid(way: str, nearer):
        return F.sum(F.when(nearer & ((F.col("direction") == way) | ~F.col("direction").isin("ab", "ba")), F.col("penalty")).otherwise(0.0))

    extra = met.groupBy("pt_id").agg(
        paid(to_start, F.col("os") < F.col("w_start")).alias("xs"), paid(to_end, F.col("oe") < F.col("w_end")).alias("xe")
    )
    out = points.join(extra, "pt_id", "left")
    return out.withColumns({
        "w_start": F.col("w_start") + F.coalesce("xs", F.lit(0.0)), "w_end": F.col("w_end") + F.coalesce("xe", F.lit(0.0))
    }).drop("xs", "xe")


def transitions(arcs: DataFrame, nodes: DataFrame, rule: str, threshold: float, penalty: float, u_turns: bool = True) -> DataFrame:
    """Moves from arc to arc: (edge, dir) states a to b, the via node, and the cost of the turn.

    ``rule`` is one of three, which differ on purpose.  ``geometry``: penalised where the
    cosine of the change of direction is below that of the threshold; turning back always is.
    ``node``: penalised where the rounded turn deviates from straight on by more than the
    threshold.  ``folded``: the deviation is folded at 90 degrees, so sharp reversals stop
    counting.
    """
    xy = nodes.select("node_id", "x", "y")
    a = arcs.select(F.col("src").alias("n1"), F.col("dst").alias("via"), F.col("edge_id").alias("from_edge"), F.col("dir").alias("from_dir"))
    b = arcs.select(F.col("src").alias("via"), F.col("dst").alias("n3"), F.col("edge_id").alias("to_edge"), F.col("dir").alias("to_dir"), "w")
    moves = a.join(b, "via")
    back = F.col("from_edge") == F.col("to_edge")
    if not u_turns:
        moves = moves.where(~back)
    for k, n in (("1", "n1"), ("2", "via"), ("3", "n3")):
        moves = moves.join(xy.select(F.col("node_id").alias(n), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}")), n)
    p = [F.col(c) for c in ("x1", "y1", "x2", "y2", "x3", "y3")]
    if rule == "geometry":
        turned = back | (F.round(straightness(*p), 12) < round(math.cos(math.radians(threshold)), 12))
    else:
        angle = via_angle(*p)
        turned = (angle if rule == "node" else F.least(angle, F.abs(angle - 180))) > threshold
    return moves.select(
        "from_edge", "from_dir", "via", "to_edge", "to_dir", "n3",
        F.when(turned, penalty).otherwise(0.0).alias("turn"), "w",
    )
