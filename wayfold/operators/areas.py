"""Areas around points: convex hulls, clusters of origins and their masks, and nodes snapped within a tolerance."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.plans.staging import stage, unstage


def _chain(xy: np.ndarray) -> np.ndarray:
    """The convex hull of distinct points, anticlockwise from the smallest, without points on its sides."""
    xy = np.unique(xy, axis=0)
    if len(xy) < 3:
        return xy

    def half(rows) -> list:
        out: list = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    lower, upper = half(xy.tolist()), half(xy[::-1].tolist())
    return np.array(lower[:-1] + upper[:-1])


def hulls(points: DataFrame, group: str) -> DataFrame:
    """(group, ring): the convex hull of each group's points (x, y), its first point not repeated.

    Each batch of rows is reduced to its own hulls first, so what meets for a group is little, however
    many points it has.
    """
    kind = dict(points.dtypes)[group]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            for key, rows in batch.groupby(group, sort=False):
                xy = rows[["x", "y"]].to_numpy(float)
                held[key] = _chain(np.concatenate([held[key], xy]) if key in held else xy)
        parts = [pd.DataFrame({group: key, "x": ring[:, 0], "y": ring[:, 1]}) for key, ring in held.items()]
        yield pd.concat(parts) if parts else pd.DataFrame({group: [], "x": [], "y": []})

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        ring = _chain(rows[["x", "y"]].to_numpy(float))
        return pd.DataFrame({group: [rows[group].iloc[0]], "ring": [[{"x": x, "y": y} for x, y in ring.tolist()]]})

    rows = points.where(f"`{group}` is not null and x is not null and y is not null").select(group, "x", "y")
    return rows.mapInPandas(partial, f"`{group}` {kind}, x double, y double").groupBy(group).applyInPandas(whole, f"`{group}` {kind}, ring array<struct<x:double,y:double>>")


def clusters(points: DataFrame, n: int = 10, seed: int = 42) -> DataFrame:
    """``points`` (x, y) with ``cluster``, by k-means from a fixed seed."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=["x", "y"], outputCol="__xy").transform(points)
    model = KMeans(k=n, seed=seed, featuresCol="__xy", predictionCol="cluster").fit(rows)
    return model.transform(rows).drop("__xy")


def within_ring(ring: np.ndarray, x: np.ndarray, y: np.ndarray, radius: float) -> np.ndarray:
    """Whether points are inside a convex ring or no further than the radius from it."""
    inside, least = np.full(len(x), len(ring) > 2), np.full(len(x), np.inf)
    for (x1, y1), (x2, y2) in zip(ring.tolist(), np.roll(ring, -1, axis=0).tolist()):
        dx, dy = x2 - x1, y2 - y1
        square = dx * dx + dy * dy
        t = np.clip(((x - x1) * dx + (y - y1) * dy) / square, 0.0, 1.0) if square > 0 else 0.0
        ex, ey = x - (x1 + t * dx), y - (y1 + t * dy)
        inside &= dx * (y - y1) - dy * (x - x1) >= 0
        least = np.minimum(least, ex * ex + ey * ey)
    return inside | (np.sqrt(least) <= radius)


def within_masks(clustered: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """(cluster, pt_id) of the points within the radius of a cluster's convex hull: a hint of what belongs together, not a filter.

    There are as many hulls as clusters, a small number that was chosen, so all of them go to every task, and a batch of
    points is held against a side of a hull at a time.
    """
    kinds = dict(clustered.dtypes) | {"pt_id": dict(points.dtypes)["pt_id"]}
    masks = [(r["cluster"], np.array([(p["x"], p["y"]) for p in r["ring"]])) for r in hulls(clustered, "cluster").collect()]
    shared = points.sparkSession.sparkContext.broadcast(masks)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, y = batch["x"].to_numpy(float), batch["y"].to_numpy(float)
            for cluster, ring in shared.value:
                got = batch.loc[within_ring(ring, x, y, radius), ["pt_id"]]
                yield got.assign(cluster=cluster)[["cluster", "pt_id"]]

    rows = points.where("x is not null and y is not null").select("pt_id", "x", "y")
    return rows.mapInPandas(run, f"cluster {kinds['cluster']}, pt_id {kinds['pt_id']}")


#: Cells on a side of the tiles that are worked on as a whole.
_TILE = 16


def _decide(rows: pd.DataFrame, tolerance: float) -> pd.DataFrame:
    """The ends of a tile in their order: nodes, covered ones (left out), and those that an undecided end before them leaves open."""
    nodes: dict[tuple, tuple] = {}
    open_: dict[tuple, list] = {}
    out = []
    around = [(i, j) for i in range(-2, 3) for j in range(-2, 3)]
    rows = rows.sort_values("end")
    for end, x, y, cx, cy, node, own in zip(*(rows[c].tolist() for c in ("end", "x", "y", "cx", "cy", "node", "own"))):
        if node == 1:
            nodes[cx, cy] = (x, y)
        elif not own:
            open_.setdefault((cx, cy), []).append((x, y))
        elif (cx, cy) in nodes or any(p and math.hypot(x - p[0], y - p[1]) <= tolerance for i, j in around if (p := nodes.get((cx + i, cy + j)))):
            continue
        elif (cx, cy) in open_ or any(math.hypot(x - p[0], y - p[1]) <= tolerance for i, j in around for p in open_.get((cx + i, cy + j), ())):
            open_.setdefault((cx, cy), []).append((x, y))
        else:
            nodes[cx, cy], node = (x, y), 1
        if own:
            out.append((end, x, y, cx, cy, node))
    return pd.DataFrame(out, columns=["end", "x", "y", "cx", "cy", "node"])


def snapped_ends(ends: DataFrame, tolerance: float) -> DataFrame:
    """(end, node): line ends (end, x, y) that lie within the tolerance of each other become one node.

    In the order of ``end``, an end that no earlier node covers becomes a node, and an end belongs to the
    first node that covers it.  Of ends in one place only the first can become a node.  Places lie in cells whose points
    cover each other, so a cell has one node at most, however many ends are in it.  Tiles of cells are worked through in the
    order of ends, in rounds, as far as no undecided end of another tile comes before.
    """
    known = F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")
    ends = stage(ends.select("end", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), "ends")
    side = tolerance / math.sqrt(2) * (1 - 1e-9)
    cell = lambda x: F.floor(F.col(x) / side).alias(f"c{x}")
    places = stage(ends.where(known).groupBy("x", "y").agg(F.min("end").alias("end")).select("end", "x", "y", cell("x"), cell("y")), "ends-places")
    kind = dict(places.dtypes)["end"]
    state = stage(places.withColumn("node", F.lit(0)), "ends-state")
    tile = lambda c: F.array_distinct(F.transform(F.array(F.lit(-2), F.lit(0), F.lit(2)), lambda k: F.floor((F.col(c) + k) / _TILE)))
    while state.where("node = 0").limit(1).count():
        copies = state.withColumn("tx", F.explode(tile("cx"))).withColumn("ty", F.explode(tile("cy")))
        copies = copies.withColumn("own", (F.col("tx") == F.floor(F.col("cx") / _TILE)) & (F.col("ty") == F.floor(F.col("cy") / _TILE)))
        new = copies.groupBy("tx", "ty").applyInPandas(lambda rows: _decide(rows, tolerance), f"end {kind}, x double, y double, cx long, cy long, node int")
        new = stage(new, "ends-state")
        unstage(state)
        state = new
    reach = F.array(*(F.lit(k) for k in range(-2, 3)))
    at = state.select(F.col("end").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), "cx", "cy")
    at = at.withColumn("i", F.explode(reach)).withColumn("j", F.explode(reach)).select("a", "ax", "ay", (F.col("cx") + F.col("i")).alias("cx"), (F.col("cy") + F.col("j")).alias("cy"))
    near = places.join(at, ["cx", "cy"]).where((F.col("a") <= F.col("end")) & (F.hypot(F.col("ax") - F.col("x"), F.col("ay") - F.col("y")) <= tolerance))
    # Nodes cover themselves, and no earlier node does.
    first = near.groupBy("x", "y").agg(F.min("a").alias("node"))
    return ends.where(known).join(first, ["x", "y"]).select("end", "node").union(ends.where(~known).select("end", F.col("end").alias("node")))


def snapped_network(lines: DataFrame, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of lines (edge_id, coords, weight) whose ends within the tolerance meet in one node.

    Nodes form from the heaviest lines on: all starts by falling weight, then all ends.  A line's first and last
    point move to its nodes; ``snapped`` says so, and ``moved`` by how much its length changed.
    """
    n = lines.count()
    order = stage(_ranked_by_weight(lines), "ends-order")
    at = lambda i, side: order.select((F.col("rank") + side * n).alias("end"), F.col("edge_id"), F.lit(side).alias("side"), F.element_at("coords", i)["x"].alias("x"), F.element_at("coords", i)["y"].alias("y"))
    ends = stage(at(1, 0).unionByName(at(-1, 1)), "ends")
    node_of = stage(ends.join(snapped_ends(ends, tolerance), "end"), "ends-nodes")
    place = ends.select(F.col("end").alias("node"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    both = node_of.join(place, "node")
    side = lambda k, name: both.where(f"side = {k}").select("edge_id", F.col("node").alias(name), F.struct(F.col("nx").alias("x"), F.col("ny").alias("y"), F.lit(None).cast("double").alias("z")).alias(f"p{name}"))
    edges = lines.join(side(0, "u"), "edge_id").join(side(1, "v"), "edge_id")
    flat = "transform(slice(coords, 2, greatest(size(coords) - 2, 0)), p -> named_struct('x', p.x, 'y', p.y, 'z', cast(null as double)))"
    edges = edges.withColumn("line", F.concat(F.array("pu"), F.expr(flat), F.array("pv")))
    length = "aggregate(zip_with(slice({0}, 1, size({0}) - 1), slice({0}, 2, size({0})), (a, b) -> hypot(b.x - a.x, b.y - a.y)), 0D, (s, d) -> s + d)"
    edges = edges.withColumns({"length": F.expr(length.format("coords")), "new": F.expr(length.format("line"))})
    edges = edges.withColumn("moved", F.abs(F.col("new") - F.col("length")))
    nodes = node_of.groupBy("node").agg(F.count("*").cast("int").alias("degree")).join(place, "node").select(F.col("node").alias("node_id"), F.col("nx").alias("x"), F.col("ny").alias("y"), F.lit(None).cast("double").alias("z"), "degree")
    return edges.select("edge_id", F.col("line").alias("coords"), "u", "v", "weight", "length", (F.col("moved") > 0).alias("snapped"), "moved"), nodes


def _ranked_by_weight(lines: DataFrame) -> DataFrame:
    """``lines`` with ``rank`` from 0 by falling weight, then edge_id; dealt to partitions by ranges, numbered within them."""
    from pyspark.sql import Window

    dealt = stage(lines.repartitionByRange(F.desc("weight"), F.asc("edge_id")).withColumn("__part", F.spark_partition_id()), "ranked")
    before = F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    parts = dealt.groupBy("__part").agg(F.count("*").alias("n")).select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(F.desc("weight"), "edge_id")) - 1
    return dealt.withColumn("__within", within).join(F.broadcast(parts), "__part").withColumn("rank", F.col("__before") + F.col("__within")).drop("__part", "__before", "__within")
