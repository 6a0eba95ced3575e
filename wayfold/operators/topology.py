"""Nodes, edges and arcs of a line network, and points snapped to it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.geometry import line_length, project
from wayfold.plans.staging import stage


def cost(edges: DataFrame, column: str, length: str = "length") -> DataFrame:
    """``edges`` with ``weight``: the column, or the length where that is null, NaN, infinite or not positive."""
    c = F.col(column).cast("double")
    good = c.isNotNull() & ~F.isnan(c) & (c > 0) & (c < float("inf"))
    return edges.withColumn("weight", F.when(good, c).otherwise(F.col(length)))


def floor_cost(edges: DataFrame, column: str, length: str = "length", least: float = 0.01) -> DataFrame:
    """The other weight rule: the column, at least ``least``, or the length where it is zero or null."""
    c = F.col(column).cast("double")
    return edges.withColumn("weight", F.when(c.isNull() | (c == 0), F.col(length)).otherwise(F.greatest(c, F.lit(least))))


def point_weight(points: DataFrame, column: str) -> DataFrame:
    """``points`` with ``weight``: the column as double, or 1 where there is no such column."""
    return points.withColumn("weight", F.col(column).cast("double") if column in points.columns else F.lit(1.0))


def endpoints(lines: DataFrame, precision: int = 3) -> DataFrame:
    """``lines`` (edge_id, coords) with rounded end coordinates x1, y1, x2, y2 (and z1, z2) and the length."""
    first, last = F.element_at("coords", 1), F.element_at("coords", -1)
    ends = {f"{c}{i}": F.bround(p[c], precision) for i, p in ((1, first), (2, last)) for c in ("x", "y")}
    ends |= {"z1": first["z"], "z2": last["z"]}
    return lines.where(F.size("coords") > 1).withColumns(ends | {"length": line_length("coords")})


def node_key(x: str, y: str) -> Column:
    """A node id from coordinates alone: no rank over all nodes is needed."""
    return F.xxhash64(x, y)


def build(lines: DataFrame, precision: int = 3) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of lines: nodes are distinct end coordinates, with degree and the first elevation.

    A node's id is a hash of its rounded coordinates; ``ranked`` gives ids in coordinate order.
    """
    e = endpoints(lines, precision).withColumns({"u": node_key("x1", "y1"), "v": node_key("x2", "y2")})
    ends = e.select(F.col("u").alias("node_id"), F.col("x1").alias("x"), F.col("y1").alias("y"), F.col("z1").alias("z"), F.struct(F.lit(0), "edge_id").alias("at")).union(
        e.select("v", "x2", "y2", "z2", F.struct(F.lit(1), F.col("edge_id")))
    )
    nodes = ends.groupBy("node_id").agg(
        F.first("x").alias("x"), F.first("y").alias("y"), F.min_by("z", "at").alias("z"), F.count("*").cast("int").alias("degree")
    )
    return e.drop("x1", "y1", "x2", "y2", "z1", "z2"), nodes


def ranked(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``rank``: the position in (x, y) order.

    Nodes are dealt to partitions by ranges and numbered within them; what lies before a partition
    is a sum over the few partitions.
    """
    dealt = stage(nodes.repartitionByRange("x", "y").withColumn("__part", F.spark_partition_id()), "ranked")
    before = F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    parts = dealt.groupBy("__part").agg(F.count("*").alias("n")).select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy("x", "y")) - 1
    out = dealt.withColumn("__within", within).join(F.broadcast(parts), "__part")
    return out.withColumn("rank", F.col("__before") + F.col("__within")).drop("__part", "__before", "__within")


def degrees(edges: DataFrame) -> DataFrame:
    """(node_id, degree): how many edge ends meet; a loop counts twice."""
    ends = edges.select(F.explode(F.array("u", "v")).alias("node_id"))
    return ends.groupBy("node_id").agg(F.count("*").alias("degree"))


def edge_degrees(edges: DataFrame) -> DataFrame:
    """edge_id with the degrees of its ends, the smaller and the larger one."""
    d = degrees(edges)
    out = edges.join(d.select(F.col("node_id").alias("u"), F.col("degree").alias("start_degree")), "u")
    out = out.join(d.select(F.col("node_id").alias("v"), F.col("degree").alias("end_degree")), "v")
    return out.select(
        "edge_id", "start_degree", "end_degree",
        F.least("start_degree", "end_degree").alias("min_degree"), F.greatest("start_degree", "end_degree").alias("max_degree"),
    )


def _first_of(edges: DataFrame, by: list[Column], order: Column) -> DataFrame:
    """The first row of each group, carried whole through one aggregation."""
    return edges.groupBy(*by).agg(F.min_by(F.struct(*edges.columns), order).alias("__row")).select("__row.*")


def _ends() -> list[Column]:
    return [F.least("u", "v").alias("__lo"), F.greatest("u", "v").alias("__hi")]


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Of edges with the same ends and weight, the one with the smallest id."""
    return _first_of(edges, [*_ends(), F.col("weight").alias("__w")], F.col("edge_id"))


def lightest_edges(edges: DataFrame) -> DataFrame:
    """Of parallel edges, the lightest one (the smallest id of equals)."""
    return _first_of(edges, _ends(), F.struct("weight", "edge_id"))


def split_parallel(edges: DataFrame) -> DataFrame:
    """All but the lightest of parallel edges as two halves that meet in a new node.

    Returns part_of, half (0 whole, 1 and 2 halves), u, v, weight; the new node's id is
    ``-1 - edge_id``, which no node has.
    """
    order = Window.partitionBy(F.least("u", "v"), F.greatest("u", "v")).orderBy("weight", "edge_id")
    part = lambda half, u, v: F.struct(F.lit(half).alias("half"), u.alias("u"), v.alias("v"))
    middle = -1 - F.col("edge_id")
    parts = F.when(F.col("k") == 1, F.array(part(0, F.col("u"), F.col("v")))).otherwise(F.array(part(1, F.col("u"), middle), part(2, middle, F.col("v"))))
    weight = F.when(F.col("k") == 1, F.col("weight")).otherwise(F.col("weight") / 2)
    rows = edges.withColumn("k", F.row_number().over(order)).select(F.col("edge_id").alias("part_of"), weight.alias("weight"), F.explode(parts).alias("h"))
    return rows.select("part_of", "h.half", "h.u", "h.v", "weight")


def tags(edges: DataFrame, tolerance: float) -> DataFrame:
    """edge_id with what is odd about the edge: short, near the tolerance, a loop, redundant."""
    twins = F.count("*").over(Window.partitionBy(F.least("u", "v"), F.greatest("u", "v")))
    tag = F.when(F.col("length") <= tolerance, "short").when(F.col("u") == F.col("v"), "cycle").when(F.col("twins") > 1, "redundant")
    return edges.withColumn("twins", twins).select("edge_id", tag.when(F.col("length") <= 3 * tolerance, "near").otherwise("ok").alias("tag"))


def arcs(edges: DataFrame) -> DataFrame:
    """Both directions of each edge: src, dst, w, edge_id, dir (0 from u to v, 1 back)."""
    both = F.explode(F.array(
        F.struct(F.col("u").alias("src"), F.col("v").alias("dst"), F.lit(0).alias("dir")),
        F.struct(F.col("v").alias("src"), F.col("u").alias("dst"), F.lit(1).alias("dir")),
    ))
    return edges.select("edge_id", F.col("weight").alias("w"), both.alias("a")).select("a.src", "a.dst", "w", "edge_id", "a.dir")


def lightest_arcs(arc_rows: DataFrame) -> DataFrame:
    """One arc for each pair of nodes: the lightest, by edge id among equals."""
    best = arc_rows.groupBy("src", "dst").agg(F.min(F.struct("w", "edge_id", "dir")).alias("b"))
    return best.select("src", "dst", "b.w", "b.edge_id", "b.dir")


def connectors(points: DataFrame, to_network: bool) -> DataFrame:
    """Arcs between points and the ends of their edges: node, pt_id, w, edge_id, dir of the edge travelled.

    Leaving for the start runs the edge backwards, leaving for the end forwards; arriving is
    the other way round.
    """
    start, end = (1, 0) if to_network else (0, 1)
    both = F.explode(F.array(
        F.struct(F.col("u").alias("node"), F.col("w_start").alias("w"), F.lit(start).alias("dir")),
        F.struct(F.col("v").alias("node"), F.col("w_end").alias("w"), F.lit(end).alias("dir")),
    ))
    return points.select("pt_id", "edge_id", both.alias("c")).select("c.node", "pt_id", "c.w", "edge_id", "c.dir")


def snapped_node(points: DataFrame) -> DataFrame:
    """pt_id and the nearer end of its edge (the start of equals)."""
    return points.select("pt_id", F.when(F.col("w_start") <= F.col("w_end"), F.col("u")).otherwise(F.col("v")).alias("node_id"))


def chain(points: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges cut at the points on them: edge_id, piece, src, dst (text ids of nodes and points), w.

    Points are ordered by their distance from the start; pieces keep the edge's weight in sum.
    """
    on = points.select("edge_id", "w_start", F.concat(F.lit("p"), "pt_id").alias("id"))
    ends = edges.join(points.select("edge_id").distinct(), "edge_id", "left_semi")
    stops = on.unionByName(ends.select("edge_id", F.lit(-1.0).alias("w_start"), F.concat(F.lit("n"), "u").alias("id"))).unionByName(
        ends.select("edge_id", F.lit(float("inf")).alias("w_start"), F.concat(F.lit("n"), "v").alias("id"))
    )
    order = Window.partitionBy("edge_id").orderBy("w_start", "id")
    out = stops.select(
        "edge_id", (F.row_number().over(order) - 1).cast("long").alias("piece"), F.col("id").alias("src"), F.lead("id").over(order).alias("dst"),
        F.greatest(F.col("w_start"), F.lit(0.0)).alias("a"), F.lead("w_start").over(order).alias("b"),
    )
    out = out.where("dst is not null").join(edges.select("edge_id", "weight"), "edge_id")
    return out.select("edge_id", "piece", "src", "dst", (F.least("b", "weight") - F.col("a")).alias("w"))


def segments(lines: DataFrame) -> DataFrame:
    """The straight pieces of lines (edge_id, coords, weight): edge_id, seg, x1, y1, x2, y2, before, total, weight."""
    steps = "zip_with(slice(coords, 1, size(coords) - 1), slice(coords, 2, size(coords)), (a, b) -> hypot(b.x - a.x, b.y - a.y))"
    # Lengths up to each point, summed once for the line.
    upto = F.expr(f"aggregate({steps}, array(0D), (s, d) -> concat(s, array(element_at(s, -1) + d)))")
    rows = lines.where(F.size("coords") > 1).select("edge_id", "weight", "coords", upto.alias("upto"))
    pieces = rows.select("*", F.explode(F.expr("sequence(1, size(coords) - 1)")).alias("seg"))
    a, b = F.element_at("coords", F.col("seg")), F.element_at("coords", F.col("seg") + 1)
    return pieces.select(
        "edge_id", "seg", a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"),
        F.element_at("upto", F.col("seg")).alias("before"), F.element_at("upto", -1).alias("total"), "weight",
    )


def _cells(pieces: DataFrame, cell: float) -> DataFrame:
    """``pieces`` once for each grid cell (cx, cy) that they run through: column by column, the rows between entry and exit."""
    at = lambda x: F.floor(x / cell)
    flip = F.col("x1") > F.col("x2")
    xa, ya, xb, yb = (F.when(flip, F.col(p)).otherwise(F.col(q)) for p, q in (("x2", "x1"), ("y2", "y1"), ("x1", "x2"), ("y1", "y2")))
    columns = pieces.withColumns({"xa": xa, "ya": ya, "xb": xb, "yb": yb}).withColumn("cx", F.explode(F.sequence(at(F.col("xa")), at(F.col("xb")))))
    share = lambda x: F.when(F.col("xb") > F.col("xa"), F.least(F.greatest((x - F.col("xa")) / (F.col("xb") - F.col("xa")), F.lit(0.0)), F.lit(1.0)))
    y = lambda t: F.col("ya") + t * (F.col("yb") - F.col("ya"))
    first, last = y(F.coalesce(share(F.col("cx") * cell), F.lit(0.0))), y(F.coalesce(share((F.col("cx") + 1) * cell), F.lit(1.0)))
    edge = cell * 1e-9
    rows = F.sequence(at(F.least(first, last) - edge), at(F.greatest(first, last) + edge))
    return columns.withColumn("cy", F.explode(rows)).drop("xa", "ya", "xb", "yb")


def snap(points: DataFrame, pieces: DataFrame, cell: float | None = None) -> DataFrame:
    """The nearest edge of each point (pt_id, x, y), by (distance, edge_id), at whatever distance.

    Segments are entered in the grid cells that they run through, and a point looks at its cell and the eight
    around it.  A distance of at most a cell's width is final, since anything nearer would have
    been seen; the other points look again in a grid four times as coarse, until all are
    done.  The first width is the mean extent of the segments, so units don't matter.
    Points without finite coordinates have no nearest edge.  Returns pt_id, edge_id, frac (of the line's
    length), snap_dist, w_start, w_end.
    """
    pieces = stage(pieces, "snap-pieces")
    size = pieces.agg(F.avg(F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))).alias("size"), F.count("*").alias("n")).first()
    cell = cell or size["size"] or 1.0
    finite = lambda x: F.col(x).isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    waiting, done = points.select("pt_id", "x", "y").where(finite("x") & finite("y")), []
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    while True:
        at = lambda x: F.floor(F.col(x) / cell)  # noqa: E731, B023
        looked = waiting.withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around))
        looked = looked.select("pt_id", "x", "y", (at("x") + F.col("dx")).alias("cx"), (at("y") + F.col("dy")).alias("cy"))
        t, d2 = project(*(F.col(q) for q in ("x", "y", "x1", "y1", "x2", "y2")))
        near = looked.join(_cells(pieces, cell), ["cx", "cy"]).withColumns({"t": t, "d2": d2})
        along = F.when(F.col("total") > 0, (F.col("before") + F.col("t") * F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))) / F.col("total")).otherwise(0.0)
        best = near.groupBy("pt_id").agg(F.min(F.struct("d2", "edge_id", "seg", along.alias("frac"), "weight")).alias("b"))
        best = best.select("pt_id", "b.edge_id", "b.frac", F.sqrt("b.d2").alias("snap_dist"), (F.col("b.weight") * F.col("b.frac")).alias("w_start"), (F.col("b.weight") * (1 - F.col("b.frac"))).alias("w_end"))
        final = stage(best.where(F.col("snap_dist") <= cell), "snap-best")
        done.append(final)
        waiting = stage(waiting.join(final.select("pt_id"), "pt_id", "left_anti"), "snap-waiting")
        if not size["n"] or not waiting.limit(1).count():
            return reduce(DataFrame.unionByName, done)
        cell *= 4
