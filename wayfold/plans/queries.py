"""Registered queries over the derived city, each beside the SQL that it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import decay, geometry
from wayfold.operators import access, areas, flow, impedance, pathjoin, routes, topology, trips, turnflow, viaflow
from wayfold.params import Settings
from wayfold.plans import sql
from wayfold.plans.city import City
from wayfold.plans.sql import R, with_city, with_od
from wayfold.plans.staging import stage
from wayfold.sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

S = Settings(search_radius=float(R), gravity_beta=0.002, gravity_logistic_midpoint=300.0, gravity_plateau=100.0, flow_detour_ratio=1.1)


def query(name: str, oracle: str | None = None):
    def register(f: Callable[[City], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(City(spark, sf_dir))
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return register


def r4(*names: str) -> list[Column]:
    return [F.round(n, 4).alias(n) for n in names]


def _r4(*names: str) -> str:
    return ", ".join(f"round({n}, 4) AS {n}" for n in names)


def _arcs(c: City) -> DataFrame:
    return topology.arcs(c.edges)


def _od(c: City, arcs: DataFrame | None = None, radius: float = R, **more) -> DataFrame:
    return pathjoin.od(c.origins, c.destinations, _arcs(c) if arcs is None else arcs, radius, **more)


def _once(df: DataFrame, label: str) -> DataFrame:
    """A result that several branches read, computed once."""
    return stage(df, label)


# ---------------------------------------------------------------- accessibility

_WEIGHTED = "SELECT od.o, od.dest, od.d, t.weight AS w FROM od JOIN destinations t ON t.pt_id = od.dest"
_METRICS = """
  coalesce(sum(w), 0.0::DOUBLE) AS reach,
  coalesce(sum(w * exp(-0.002::DOUBLE * greatest(d - 100, 0))), 0.0::DOUBLE) AS gravity_exponential,
  coalesce(sum(w * (1 - 1 / (1 + exp(-(ln(99) / 300) * (d - 100 - 300))))), 0.0::DOUBLE) AS gravity_logistic,
  coalesce(sum(CASE WHEN rk = 1 THEN 1.0 WHEN rk = 2 THEN 1.0 WHEN rk = 3 THEN 0.5 ELSE 0 END * w * (1 - 1 / (1 + exp(-(ln(99) / 300) * (d - 100 - 300))))), 0.0::DOUBLE) AS knn_access"""


def _access_sql(head: str) -> str:
    return f"""{head}, ranked AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY d, dest) AS rk FROM ({_WEIGHTED})),
m AS (SELECT s.pt_id, {_METRICS} FROM origins s LEFT JOIN ranked r ON r.o = s.pt_id GROUP BY s.pt_id)
SELECT pt_id, {_r4("reach", "gravity_exponential", "gravity_logistic", "knn_access")} FROM m"""


@query("A1_A5_access_all", _access_sql(with_od()))
def access_all(c: City) -> DataFrame:
    return access.accessibility(_od(c), c.origins, c.destinations, S).select("pt_id", *r4(*access.METRICS))


@query("A_access_elevation", _access_sql(with_od(sql.CLIMBING)))
def access_elevation(c: City) -> DataFrame:
    arcs = impedance.with_elevation(_arcs(c), c.nodes, 4.0)
    return access.accessibility(_od(c, arcs), c.origins, c.destinations, S).select("pt_id", *r4(*access.METRICS))


@query("A_access_obstacles", _access_sql(with_od(sql.OBSTRUCTED)))
def access_obstacles(c: City) -> DataFrame:
    arcs = impedance.with_obstacles(_arcs(c), c.obstacles)
    return access.accessibility(_od(c, arcs), c.origins, c.destinations, S).select("pt_id", *r4(*access.METRICS))


@query(
    "A10_gravity_cap",
    f"""{_access_sql(with_od()).rpartition("SELECT")[0]}
SELECT round(quantile_cont(gravity_exponential, 0.95), 4) AS cap, round(quantile_cont(gravity_exponential, 0.99), 4) AS p99, round(max(gravity_exponential), 4) AS largest FROM m""",
)
def gravity_cap(c: City) -> DataFrame:
    return access.cap_candidates(_od(c), c.origins, c.destinations, S, "gravity_exponential", 0.95)


@query(
    "A11_power_gravity",
    f"{with_od()} SELECT o, round(sum(w), 4) AS reach, round(sum(pow(w, 0.5::DOUBLE) * exp(-0.003::DOUBLE * d)), 4) AS gravity FROM ({_WEIGHTED}) GROUP BY o",
)
def power_gravity(c: City) -> DataFrame:
    return access.power_gravity(_od(c), c.destinations, 0.5, 0.003).select("o", *r4("reach", "gravity"))


@query(
    "A12_M6_unweighted_knn",
    f"""{with_od()}, n AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY d, dest) AS rk FROM od),
s AS (SELECT o, sum(CASE rk WHEN 1 THEN 1.0 WHEN 2 THEN 0.6 ELSE 0.3 END * exp(-0.002::DOUBLE * greatest(d - 150, 0))) AS k FROM n WHERE rk <= 3 GROUP BY o)
SELECT o, round(k, 4) AS knn_access, round(k * weight, 4) AS knn_weight FROM s JOIN origins ON pt_id = o""",
)
def unweighted_knn(c: City) -> DataFrame:
    return access.unweighted_knn(_od(c), c.origins, (1.0, 0.6, 0.3), 0.002, 150.0).select("o", *r4("knn_access", "knn_weight"))


@query(
    "A13_pair_stats",
    f"{with_od()} SELECT o, count(*) AS n_dests, round(min(d), 4) AS closest, round(max(d), 4) AS furthest, (min({{'d': d, 'dest': dest}})).dest AS closest_dest FROM od GROUP BY o",
)
def pair_stats(c: City) -> DataFrame:
    return access.pair_stats(_od(c)).select("o", "n_dests", *r4("closest", "furthest"), "closest_dest")


@query(
    "A15_normalised_knn",
    f"""{_access_sql(with_od()).rpartition("SELECT")[0]}
SELECT pt_id, round((knn_access - min(knn_access) OVER ()) / (max(knn_access) OVER () - min(knn_access) OVER ()), 4) AS knn_access_normalised FROM m""",
)
def normalised(c: City) -> DataFrame:
    rows = access.accessibility(_od(c), c.origins, c.destinations, S)
    return access.min_max(rows, "knn_access").select("pt_id", *r4("knn_access_normalised"))


@query("A9_striped_sum", f"{with_od()} SELECT o, round(sum(w), 4) AS w FROM ({_WEIGHTED}) GROUP BY o")
def striped_sum(c: City) -> DataFrame:
    return access.striped_sum(access.weighted(_od(c), c.destinations).withColumnRenamed("dest", "i"), "o", "w").select("o", *r4("w"))


@query(
    "A16_distinct_counts",
    f"{with_od()} SELECT count(DISTINCT o) AS n_origins, count(DISTINCT dest) AS n_dests, count(*) AS n_pairs FROM od",
)
def distinct_counts(c: City) -> DataFrame:
    return _od(c).agg(F.count_distinct("o").alias("n_origins"), F.count_distinct("dest").alias("n_dests"), F.count("*").alias("n_pairs"))


# ---------------------------------------------------------------- path joins

_LABELS = f"WITH RECURSIVE {sql.CITY_SQL}, {sql.ARCS}, {sql.seeds('seeds', 'destinations')}, {sql.label('lab', 'seeds')}"


@query("J2_labels", f"{_LABELS} SELECT o, node, round(d, 4) AS d FROM lab")
def labels(c: City) -> DataFrame:
    return pathjoin.labels(c.destinations, _arcs(c), R).select("o", "node", *r4("d"))


@query("J13_labels_relational", f"{_LABELS} SELECT o, node, round(d, 4) AS d FROM lab")
def labels_relational(c: City) -> DataFrame:
    return pathjoin.labels(c.destinations, _arcs(c), R, "relational").select("o", "node", *r4("d"))


@query("J5_K4_od_matrix", f"{with_od()} SELECT o AS origin, dest AS destination, round(d, 4) AS distance, round(d / (5 * 1000 / 60.0::DOUBLE), 4) AS duration FROM od")
def od_matrix(c: City) -> DataFrame:
    out = _od(c).select(F.col("o").alias("origin"), F.col("dest").alias("destination"), F.col("d").alias("distance"))
    return out.withColumn("duration", decay.minutes(F.col("distance"), 5.0)).select("origin", "destination", *r4("distance", "duration"))


@query("J3_od_network_only", f"{with_od(same_edge=False)} SELECT o, dest, round(d, 4) AS d FROM od")
def od_network(c: City) -> DataFrame:
    return _od(c, same_edge=False).select("o", "dest", *r4("d"))


@query("J6_assigned", f"{with_od()} SELECT o, dest, round(d, 4) AS d FROM od WHERE o % 5 = dest % 5")
def assigned(c: City) -> DataFrame:
    o = c.origins.select(F.col("pt_id").alias("o"), (F.col("pt_id") % 5).alias("grp"))
    d = c.destinations.select(F.col("pt_id").alias("dest"), (F.col("pt_id") % 5).alias("grp"))
    return pathjoin.assigned(_od(c), o, d).select("o", "dest", *r4("d"))


@query("J7_W1_nearest", f"{with_od()} SELECT * FROM (SELECT o, dest, round(d, 4) AS d, row_number() OVER (PARTITION BY o ORDER BY od.d, dest) AS rank FROM od) WHERE rank <= 2")
def nearest(c: City) -> DataFrame:
    return access.nearest(_od(c), 2).select("o", "dest", F.round("d", 4).alias("d"), "rank")


@query("J9_predecessors", f"{_LABELS}, {sql.tree('t', 'lab')} SELECT o, node, round(d, 4) AS d, pred, edge_id, CAST(dir AS INTEGER) AS dir FROM t_tree WHERE pred IS NOT NULL")
def predecessors(c: City) -> DataFrame:
    arcs = _arcs(c)
    return pathjoin.predecessors(_once(pathjoin.labels(c.destinations, arcs, R), "labels"), arcs).select("o", "node", F.round("d", 4).alias("d"), "pred", "edge_id", "dir")


_STATES = """start AS (SELECT pt_id AS o, 2 * edge_id + 1 AS state, w_start AS d FROM origins UNION ALL SELECT pt_id, 2 * edge_id, w_end FROM origins),
steps AS (SELECT 2 * from_edge + from_dir AS src, 2 * to_edge + to_dir AS dst, turn, turn + w AS w FROM moves)"""


@query(
    "J8_J10_turn_od",
    f"""WITH RECURSIVE {sql.CITY_SQL}, {sql.ARCS}, {sql.moves("geometry")}, {_STATES},
lab(o, state, d) USING KEY (o, state) AS (
  SELECT o, state, min(d) FROM start WHERE d <= {R} GROUP BY o, state
  UNION
  SELECT l.o, a.dst, min(l.d + a.w) FROM lab l JOIN steps a ON a.src = l.state LEFT JOIN recurring.lab q ON q.o = l.o AND q.state = a.dst
  WHERE l.d + a.w <= {R} AND (q.d IS NULL OR l.d + a.w < q.d) GROUP BY l.o, a.dst
), goals AS (SELECT pt_id AS dest, 2 * edge_id AS dst, w_start AS c FROM destinations UNION ALL SELECT pt_id, 2 * edge_id + 1, w_end FROM destinations),
got AS (
  SELECT l.o, g.dest, l.d + t.turn + g.c AS d FROM lab l JOIN steps t ON t.src = l.state JOIN goals g ON g.dst = t.dst
  UNION ALL SELECT a.pt_id, b.pt_id, abs(a.w_start - b.w_start) FROM origins a JOIN destinations b ON a.edge_id = b.edge_id)
SELECT o, dest, round(min(d), 4) AS d FROM got GROUP BY o, dest HAVING min(d) <= {R}""",
)
def turn_od(c: City) -> DataFrame:
    arcs = _arcs(c)
    moves = impedance.transitions(arcs, c.nodes, "geometry", 45.0, 32.0)
    return pathjoin.turn_od(c.origins, c.destinations, arcs, _once(moves, "moves"), float(R)).select("o", "dest", *r4("d"))


@query("J12_closest_facility", f"{with_od()} SELECT dest, (min({{'d': d, 'o': o}})).o AS o, round(min(d), 4) AS d FROM od GROUP BY dest")
def closest_facility(c: City) -> DataFrame:
    return access.closest_facility(_od(c)).select("dest", "o", *r4("d"))


@query(
    "M3_service_area",
    f"{_LABELS} SELECT o, edge_id, round(least(sum(least({R} - d, w)) / max(w), 1), 4) AS share FROM lab JOIN arcs ON src = node GROUP BY o, edge_id",
)
def service_area(c: City) -> DataFrame:
    arcs = _arcs(c)
    return routes.service_area(pathjoin.labels(c.destinations, arcs, R), arcs, R).select("o", "edge_id", *r4("share"))


# ---------------------------------------------------------------- topology

@query("G7_arcs", with_city(sql.ARCS) + " SELECT src, dst, w, edge_id, CAST(dir AS INTEGER) AS dir FROM arcs")
def arcs(c: City) -> DataFrame:
    return _arcs(c)


@query(
    "G3_edge_degrees",
    with_city("deg AS (SELECT node_id, count(*) AS degree FROM (SELECT u AS node_id FROM edges UNION ALL SELECT v FROM edges) GROUP BY node_id)")
    + " SELECT e.edge_id, a.degree AS start_degree, b.degree AS end_degree, least(a.degree, b.degree) AS min_degree, greatest(a.degree, b.degree) AS max_degree"
    " FROM edges e JOIN deg a ON a.node_id = e.u JOIN deg b ON b.node_id = e.v",
)
def edge_degrees(c: City) -> DataFrame:
    return topology.edge_degrees(c.edges)


def _coords(c: City) -> DataFrame:
    """Edges as lines; every third one bends through the corner of its box."""
    n = c.nodes
    e = c.edges.join(n.select(F.col("node_id").alias("u"), F.col("x").alias("xa"), F.col("y").alias("ya"), F.col("z").alias("za")), "u")
    e = e.join(n.select(F.col("node_id").alias("v"), F.col("x").alias("xb"), F.col("y").alias("yb"), F.col("z").alias("zb")), "v")
    point = lambda x, y, z: F.struct(x.alias("x"), y.alias("y"), z.alias("z"))
    a, b = point(F.col("xa"), F.col("ya"), F.col("za")), point(F.col("xb"), F.col("yb"), F.col("zb"))
    bend = point(F.col("xa") + 30, F.col("ya") + 40, F.lit(0.0))
    return e.select("edge_id", "weight", F.when(F.col("edge_id") % 3 == 0, F.array(a, bend, b)).otherwise(F.array(a, b)).alias("coords"))


@query(
    "G1_G12_line_lengths",
    with_city()
    + """ SELECT edge_id, round(CASE WHEN edge_id % 3 = 0 THEN 50 + sqrt((b.x - a.x - 30) ** 2 + (b.y - a.y - 40) ** 2) ELSE 100 END, 4) AS length,
  a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM edges JOIN nodes a ON a.node_id = u JOIN nodes b ON b.node_id = v""",
)
def line_lengths(c: City) -> DataFrame:
    return topology.endpoints(_coords(c)).select("edge_id", F.round("length", 4).alias("length"), "x1", "y1", "x2", "y2")


@query(
    "G2_nodes",
    with_city("ends AS (SELECT u AS n FROM edges UNION ALL SELECT v FROM edges)")
    + " SELECT x, y, z, CAST(count(*) AS INTEGER) AS degree, row_number() OVER (ORDER BY x, y) - 1 AS rank FROM ends JOIN nodes ON node_id = n GROUP BY x, y, z",
)
def nodes(c: City) -> DataFrame:
    _, found = topology.build(_coords(c))
    return topology.ranked(found).select("x", "y", "z", "degree", F.col("rank").cast("long").alias("rank"))


_PARALLEL = "par AS (SELECT o_orderkey AS edge_id, o_orderkey % 50 AS u, (o_orderkey // 50) % 50 AS v, CAST(o_orderkey % 7 + 1 AS DOUBLE) AS weight, CAST(o_orderkey % 13 AS DOUBLE) AS length FROM orders)"


def _parallel(c: City) -> DataFrame:
    k = F.col("o_orderkey")
    return c.table("orders").select(
        k.alias("edge_id"), (k % 50).alias("u"), (F.floor(k / 50) % 50).alias("v"), (k % 7 + 1).cast("double").alias("weight"), (k % 13).cast("double").alias("length")
    )


@query("G6_distinct_edges", f"WITH {_PARALLEL} SELECT min(edge_id) AS edge_id, least(u, v) AS lo, greatest(u, v) AS hi, weight FROM par GROUP BY least(u, v), greatest(u, v), weight")
def distinct_edges(c: City) -> DataFrame:
    return topology.distinct_edges(_parallel(c)).select("edge_id", F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi"), "weight")


@query(
    "G15_lightest_edges",
    f"WITH {_PARALLEL} SELECT edge_id, u, v, weight FROM (SELECT *, row_number() OVER (PARTITION BY least(u, v), greatest(u, v) ORDER BY weight, edge_id) AS k FROM par) WHERE k = 1",
)
def lightest_edges(c: City) -> DataFrame:
    return topology.lightest_edges(_parallel(c)).select("edge_id", "u", "v", "weight")


@query(
    "G15_split_parallel",
    f"""WITH {_PARALLEL}, r AS (SELECT *, row_number() OVER (PARTITION BY least(u, v), greatest(u, v) ORDER BY weight, edge_id) AS k FROM par)
SELECT edge_id AS part_of, CAST(0 AS INTEGER) AS half, u, v, weight FROM r WHERE k = 1
UNION ALL SELECT edge_id, CAST(1 AS INTEGER), u, -1 - edge_id, weight / 2 FROM r WHERE k > 1 UNION ALL SELECT edge_id, CAST(2 AS INTEGER), -1 - edge_id, v, weight / 2 FROM r WHERE k > 1""",
)
def split_parallel(c: City) -> DataFrame:
    return topology.split_parallel(_parallel(c))


@query(
    "G16_tags",
    f"""WITH {_PARALLEL} SELECT edge_id, CASE WHEN length <= 2 THEN 'short' WHEN u = v THEN 'cycle'
  WHEN count(*) OVER (PARTITION BY least(u, v), greatest(u, v)) > 1 THEN 'redundant' WHEN length <= 6 THEN 'near' ELSE 'ok' END AS tag FROM par""",
)
def tags(c: City) -> DataFrame:
    return topology.tags(_parallel(c), 2.0)


@query(
    "G8_lightest_arcs",
    f"""WITH {_PARALLEL}, a AS (SELECT edge_id, u AS src, v AS dst, weight AS w, 0 AS dir FROM par UNION ALL SELECT edge_id, v, u, weight, 1 FROM par)
SELECT src, dst, w, edge_id, CAST(dir AS INTEGER) AS dir FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY w, edge_id, dir) AS k FROM a) WHERE k = 1""",
)
def lightest_arcs(c: City) -> DataFrame:
    return topology.lightest_arcs(topology.arcs(_parallel(c)))


@query(
    "I1_G14_cost_rules",
    """SELECT o_orderkey AS edge_id, CASE WHEN o_orderkey % 4 = 0 THEN 100.0::DOUBLE WHEN o_orderkey % 4 = 1 THEN 100.0::DOUBLE ELSE o_totalprice END AS weight,
  CASE WHEN o_orderkey % 4 = 1 THEN 0.01::DOUBLE WHEN o_orderkey % 4 = 0 THEN 100.0::DOUBLE ELSE greatest(o_totalprice, 0.01) END AS floored FROM orders""",
)
def cost_rules(c: City) -> DataFrame:
    k = F.col("o_orderkey")
    e = c.table("orders").select(
        k.alias("edge_id"), F.lit(100.0).alias("length"), F.when(k % 4 == 0, F.lit(None)).when(k % 4 == 1, -1.0).otherwise(F.col("o_totalprice")).alias("c")
    )
    a = topology.cost(e, "c").withColumnRenamed("weight", "first")
    return topology.floor_cost(a, "c").select("edge_id", F.col("first").alias("weight"), F.col("weight").alias("floored"))


@query(
    "G9_connectors",
    with_city()
    + """ SELECT u AS node, pt_id, round(w_start, 4) AS w, edge_id, CAST(0 AS INTEGER) AS dir FROM destinations
UNION ALL SELECT v, pt_id, round(w_end, 4), edge_id, CAST(1 AS INTEGER) FROM destinations""",
)
def connectors(c: City) -> DataFrame:
    return topology.connectors(c.destinations, False).select("node", "pt_id", F.round("w", 4).alias("w"), "edge_id", "dir")


@query("G5_snapped_nodes", with_city() + " SELECT pt_id, CASE WHEN w_start <= w_end THEN u ELSE v END AS node_id FROM origins")
def snapped_nodes(c: City) -> DataFrame:
    return topology.snapped_node(c.origins)


@query(
    "G17_G18_chain",
    with_city("stops AS (SELECT edge_id, w_start, 'p' || pt_id AS id FROM origins UNION ALL SELECT edge_id, -1.0, 'n' || u FROM edges WHERE edge_id IN (SELECT edge_id FROM origins)"
              " UNION ALL SELECT edge_id, 'infinity'::DOUBLE, 'n' || v FROM edges WHERE edge_id IN (SELECT edge_id FROM origins))")
    + """ SELECT s.edge_id, piece, src, dst, round(least(b, e.weight) - a, 4) AS w FROM (
  SELECT edge_id, row_number() OVER (PARTITION BY edge_id ORDER BY w_start, id) - 1 AS piece, id AS src, lead(id) OVER (PARTITION BY edge_id ORDER BY w_start, id) AS dst,
    greatest(w_start, 0) AS a, lead(w_start) OVER (PARTITION BY edge_id ORDER BY w_start, id) AS b FROM stops) s JOIN edges e ON e.edge_id = s.edge_id WHERE dst IS NOT NULL""",
)
def chain(c: City) -> DataFrame:
    return topology.chain(c.origins, c.edges).select("edge_id", "piece", "src", "dst", *r4("w"))


_OFF = "off AS (SELECT s_suppkey AS pt_id, CAST((s_suppkey * 137) % 1000 AS DOUBLE) + 3 AS x, CAST((s_suppkey * 71) % 1000 AS DOUBLE) + 7 AS y FROM supplier)"


@query(
    "G4_nearest_edge_snap",
    with_city(
        _OFF,
        """seg AS (
  SELECT edge_id, weight, a.x AS x1, a.y AS y1, CASE WHEN edge_id % 3 = 0 THEN a.x + 30 ELSE b.x END AS x2, CASE WHEN edge_id % 3 = 0 THEN a.y + 40 ELSE b.y END AS y2,
    0.0::DOUBLE AS before, CASE WHEN edge_id % 3 = 0 THEN 50 + sqrt((b.x - a.x - 30) ** 2 + (b.y - a.y - 40) ** 2) ELSE 100 END AS total, 1 AS seg
  FROM edges JOIN nodes a ON a.node_id = u JOIN nodes b ON b.node_id = v
  UNION ALL
  SELECT edge_id, weight, a.x + 30, a.y + 40, b.x, b.y, 50.0, 50 + sqrt((b.x - a.x - 30) ** 2 + (b.y - a.y - 40) ** 2), 2
  FROM edges JOIN nodes a ON a.node_id = u JOIN nodes b ON b.node_id = v WHERE edge_id % 3 = 0
)""",
        """pr AS (SELECT pt_id, x, y, s.*, least(greatest(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 0), 1) AS t FROM off CROSS JOIN seg s)""",
        """ex AS (SELECT *, x - (x1 + t * (x2 - x1)) AS ex, y - (y1 + t * (y2 - y1)) AS ey FROM pr)""",
        """best AS (SELECT *, ex * ex + ey * ey AS d2, row_number() OVER (PARTITION BY pt_id ORDER BY ex * ex + ey * ey, edge_id, seg) AS k FROM ex)""",
        """found AS (SELECT *, (before + t * sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)) / total AS frac FROM best WHERE k = 1)""",
    )
    + " SELECT pt_id, edge_id, round(frac, 4) AS frac, round(sqrt(d2), 4) AS snap_dist, round(weight * frac, 4) AS w_start, round(weight * (1 - frac), 4) AS w_end FROM found",
)
def nearest_edge(c: City) -> DataFrame:
    k = F.col("s_suppkey")
    off = c.table("supplier").select(k.alias("pt_id"), ((k * 137 % 1000).cast("double") + 3).alias("x"), ((k * 71 % 1000).cast("double") + 7).alias("y"))
    return topology.snap(off, topology.segments(_coords(c))).select("pt_id", "edge_id", *r4("frac", "snap_dist", "w_start", "w_end"))


# ---------------------------------------------------------------- impedance

@query("I2_elevation_arcs", with_city(sql.CLIMBING) + " SELECT src, dst, edge_id, CAST(dir AS INTEGER) AS dir, w FROM arcs")
def elevation_arcs(c: City) -> DataFrame:
    return impedance.with_elevation(_arcs(c), c.nodes, 4.0).select("src", "dst", "edge_id", "dir", "w")


@query("I3_obstacle_arcs", with_city(sql.OBSTRUCTED) + " SELECT src, dst, edge_id, CAST(dir AS INTEGER) AS dir, w FROM arcs")
def obstacle_arcs(c: City) -> DataFrame:
    return impedance.with_obstacles(_arcs(c), c.obstacles).select("src", "dst", "edge_id", "dir", "w")


@query(
    "I4_partial_edges",
    with_city()
    + """ SELECT p.pt_id, round(p.w_start + coalesce(sum(o.penalty) FILTER (o.w_start < p.w_start AND o.direction <> 'ab'), 0), 4) AS w_start,
  round(p.w_end + coalesce(sum(o.penalty) FILTER (o.w_end < p.w_end AND o.direction <> 'ba'), 0), 4) AS w_end
FROM origins p LEFT JOIN obstacles o ON o.edge_id = p.edge_id GROUP BY p.pt_id, p.w_start, p.w_end""",
)
def partial_edges(c: City) -> DataFrame:
    return impedance.crossed_between(c.origins, c.obstacles, True).select("pt_id", *r4("w_start", "w_end"))


@query(
    "I4_partial_edges_destinations",
    with_city()
    + """ SELECT p.pt_id, round(p.w_start + coalesce(sum(o.penalty) FILTER (o.w_start < p.w_start AND o.direction <> 'ba'), 0), 4) AS w_start,
  round(p.w_end + coalesce(sum(o.penalty) FILTER (o.w_end < p.w_end AND o.direction <> 'ab'), 0), 4) AS w_end
FROM origins p LEFT JOIN obstacles o ON o.edge_id = p.edge_id GROUP BY p.pt_id, p.w_start, p.w_end""",
)
def partial_edges_in(c: City) -> DataFrame:
    """The customers as destinations: there are more of them beside obstacles."""
    return impedance.crossed_between(c.origins, c.obstacles, False).select("pt_id", *r4("w_start", "w_end"))


@query(
    "I3_node_obstacle_arcs",
    with_city(sql.ARCS, "held AS (SELECT CASE WHEN w_start <= w_end THEN u ELSE v END AS node, sum(penalty) AS penalty FROM obstacles GROUP BY 1)")
    + " SELECT src, dst, edge_id, CAST(dir AS INTEGER) AS dir, w + coalesce(penalty, 0.0::DOUBLE) AS w FROM arcs LEFT JOIN held ON node = dst",
)
def node_obstacle_arcs(c: City) -> DataFrame:
    at = topology.snapped_node(c.obstacles).join(c.obstacles.select("pt_id", "penalty"), "pt_id")
    return impedance.with_node_obstacles(_arcs(c), at).select("src", "dst", "edge_id", "dir", "w")


@query("I8_stacked_od", f"{with_od(sql.STACKED)} SELECT o, dest, round(d, 4) AS d FROM od")
def stacked_od(c: City) -> DataFrame:
    arcs = impedance.with_obstacles(impedance.with_elevation(_arcs(c), c.nodes, 4.0), c.obstacles)
    return _od(c, arcs).select("o", "dest", *r4("d"))


for _id, _rule in (("I5", "geometry"), ("I6", "node"), ("I7", "folded")):

    @query(
        f"{_id}_turns_{_rule}",
        with_city(sql.ARCS, sql.moves(_rule)) + " SELECT from_edge, CAST(from_dir AS INTEGER) AS from_dir, via, to_edge, CAST(to_dir AS INTEGER) AS to_dir, turn FROM moves",
    )
    def turns(c: City, rule: str = _rule) -> DataFrame:
        return impedance.transitions(_arcs(c), c.nodes, rule, 45.0, 32.0).select("from_edge", "from_dir", "via", "to_edge", "to_dir", "turn")


@query(
    "X9_X10_angles",
    with_city()
    + """ SELECT edge_id, round(degrees(atan2(b.y - a.y, b.x - a.x)), 4) AS bearing, round((degrees(atan2(b.x - a.x, b.y - a.y)) + 360) % 360, 4) AS north
FROM edges JOIN nodes a ON a.node_id = u JOIN nodes b ON b.node_id = v""",
)
def angles(c: City) -> DataFrame:
    n = c.nodes
    e = c.edges.join(n.select(F.col("node_id").alias("u"), F.col("x").alias("xa"), F.col("y").alias("ya")), "u").join(n.select(F.col("node_id").alias("v"), F.col("x").alias("xb"), F.col("y").alias("yb")), "v")
    p = [F.col(q) for q in ("xa", "ya", "xb", "yb")]
    return e.select("edge_id", F.round(geometry.bearing(*p), 4).alias("bearing"), F.round(geometry.north_angle(*p), 4).alias("north"))


@query(
    "X1_X7_decay_functions",
    f"""{with_od()} SELECT o, dest, round(exp(-0.002::DOUBLE * greatest(d - 100, 0)), 4) AS exponential, round(1 / (1 + exp(ln(99) / 300 * (d - 300))), 4) AS logistic,
  round(1 / (1 + exp(ln(99) / 600 * (d - 300))), 4) AS whole_radius, round(1 / (1 + exp(ln(99) / 150 * (d - 100))), 4) AS via_penalty,
  round(1 / (1 + exp(0.01::DOUBLE * (greatest(d, 0) - 150))), 4) AS route_penalty, round(least(d * 1.05::DOUBLE, d + 100), 4) AS budget,
  round(greatest(0.0001::DOUBLE, abs(d) * 0.00001::DOUBLE), 9) AS tolerance, CASE WHEN d - 200 <= 0 THEN 1 ELSE round(exp(-0.01::DOUBLE * (d - 200)), 4) END AS via_exponential,
  round(exp(-0.01::DOUBLE * greatest(d - 200, 0)), 4) AS route_exponential, round(least(d + 100, d * 9), 4) AS buffered FROM od""",
)
def decay_functions(c: City) -> DataFrame:
    d = F.col("d")
    return _od(c).select(
        "o", "dest", F.round(decay.exponential(d, 0.002, 100.0), 4).alias("exponential"), F.round(decay.logistic(d, decay.LN99 / 300, 300.0), 4).alias("logistic"),
        F.round(decay.radius_logistic(d, 600.0), 4).alias("whole_radius"), F.round(decay.detour_penalty(d - 100, "logistic", 0.0, 150.0), 4).alias("via_penalty"),
        F.round(decay.route_penalty(d, "logistic", 0.01, 150.0), 4).alias("route_penalty"), F.round(decay.detour_budget(d, "min", 1.05, 100.0), 4).alias("budget"),
        F.round(decay.cost_tolerance(d), 9).alias("tolerance"), F.round(decay.detour_penalty(d - 200, "exponential", 0.01, 150.0), 4).alias("via_exponential"),
        F.round(decay.route_penalty(d - 200, "exponential", 0.01, 150.0), 4).alias("route_exponential"),
        F.round(F.least(decay.detour_budget(d, "buffer", 1.05, 100.0), decay.detour_budget(d, "ratio", 9.0, 100.0)), 4).alias("buffered"),
    )


# ---------------------------------------------------------------- trips

_TRIPS = "SELECT o, dest, round(trips, 4) AS trips FROM trips"
_AGG = {
    "F2_F3_trips_closest": ({}, sql.trips()),
    "F4_trips_gravity_cap": ({"flow_decay_method": "gravity_cap"}, sql.trips(factor="least(sum(g) OVER (PARTITION BY o) / 5000, 1)")),
    "F5_trips_destination_decay": ({"flow_decay_method": "destination_decay"}, sql.trips(factor="exp(-0.002::DOUBLE * d)")),
    "F1_trips_no_decay": ({"flow_decay": False}, sql.trips("w", "1")),
    "F2_trips_logistic": (
        {"flow_decay_curve": "logistic"},
        sql.trips("w * (1 / (1 + exp(ln(99) / 600 * (d - 300))))", "min(1 / (1 + exp(ln(99) / 600 * (d - 300)))) OVER (PARTITION BY o) * 0 + 1 / (1 + exp(ln(99) / 600 * (min(d) OVER (PARTITION BY o) - 300)))"),
    ),
}


def _register_trips(name: str, change: dict, text: str) -> None:
    @query(name, f"{with_od()}, {text} {_TRIPS}")
    def generated(c: City) -> DataFrame:
        s = Settings(**(S.changed() | change))
        return trips.trips(_od(c), c.origins, c.destinations, s, 5000.0).select("o", "dest", *r4("trips"))


for _name, (_change, _text) in _AGG.items():
    _register_trips(_name, _change, _text)

_ALT = {"flow_engine": "k_alternatives"}
_SHARE = "w * exp(-0.002::DOUBLE * greatest(d - 100, 0))"
_register_trips("F3_alt_trips_closest", _ALT, sql.trips(_SHARE, "exp(-0.002::DOUBLE * greatest(min(d) OVER (PARTITION BY o) - 100, 0))"))
_register_trips(
    "F4_alt_trips_gravity_cap", _ALT | {"flow_decay_method": "gravity_cap"},
    sql.trips(_SHARE, "least(sum(w * exp(-0.002::DOUBLE * greatest(d - 100, 0))) OVER (PARTITION BY o) / 5000, 1)"),
)
_register_trips("F5_alt_trips_destination_decay", _ALT | {"flow_decay_method": "destination_decay"}, sql.trips(_SHARE, "exp(-0.002::DOUBLE * greatest(d - 100, 0))"))
_register_trips("F1_alt_trips_uniform", _ALT | {"flow_decay": False, "flow_destination_weights": False}, sql.trips("1.0::DOUBLE", "1"))


@query(
    "F6_trips_nearest_only",
    f"""{with_od()}, n AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY d, dest) AS k FROM od)
SELECT o, dest, round(s.weight * exp(-0.002::DOUBLE * d), 4) AS trips FROM n JOIN origins s ON s.pt_id = o WHERE k = 1 AND s.weight * exp(-0.002::DOUBLE * d) > 0""",
)
def trips_nearest(c: City) -> DataFrame:
    s = Settings(**(S.changed() | {"use_nearest_destination": True}))
    return trips.trips(_od(c), c.origins, c.destinations, s).select("o", "dest", *r4("trips"))


@query("W3_W5_shares", f"{with_od()}, {sql.trips()} SELECT o, dest, round(g / sum(g) OVER (PARTITION BY o), 4) AS share, round(min(d) OVER (PARTITION BY o), 4) AS least FROM shared")
def shares(c: City) -> DataFrame:
    from pyspark.sql import Window

    by = Window.partitionBy("o")
    rows = access.weighted(_od(c), c.destinations).join(c.origins.where("weight > 0").select(F.col("pt_id").alias("o")), "o").withColumn("g", F.col("w") * F.exp(-0.002 * F.col("d")))
    return rows.select("o", "dest", F.round(F.col("g") / F.sum("g").over(by), 4).alias("share"), F.round(F.min("d").over(by), 4).alias("least"))


@query("W6_percent_rank", f"{with_od()} SELECT dest, n, round(percent_rank() OVER (ORDER BY n), 4) AS rank FROM (SELECT dest, count(*) AS n FROM od GROUP BY dest)")
def percent_ranks(c: City) -> DataFrame:
    """Ranks come from counts of the distinct values, so no row is sorted among all others."""
    from pyspark.sql import Window

    rows = _once(_od(c).groupBy("dest").agg(F.count("*").alias("n")), "ranks")
    values = rows.groupBy("n").agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = rows.agg(F.greatest(F.count("*") - 1, F.lit(1)).alias("whole"))
    at = values.select("n", before.alias("before")).join(F.broadcast(whole))
    return rows.join(at, "n").select("dest", "n", F.round(F.col("before") / F.col("whole"), 4).alias("rank"))


# ---------------------------------------------------------------- flow

def _trips(c: City) -> DataFrame:
    return _once(trips.trips(_od(c, same_edge=False), c.origins, c.destinations, S), "trips")


def _via(c: City, sent: DataFrame) -> DataFrame:
    return viaflow.via_arcs(sent, c.origins, c.destinations, _arcs(c), S, flow.tree_radius(S))


_FLOW = f"{with_od(same_edge=False, reach=R * S.flow_detour_ratio)}, {sql.trips()}, {sql.flow(S.flow_detour_ratio)}"


@query("F8_F9_via_arcs", f"{_FLOW} SELECT o, dest, coalesce(src, -1) AS src, coalesce(dst, -1) AS dst, edge_id, CAST(dir AS INTEGER) AS dir, round(q, 4) AS q FROM via")
def via_arcs(c: City) -> DataFrame:
    """Stretches have no src or no dst: -1."""
    ends = [F.coalesce(n, F.lit(-1)).cast("long").alias(n) for n in ("src", "dst")]
    return _via(c, _trips(c)).select("o", "dest", *ends, "edge_id", "dir", F.round("q", 4).alias("q"))


@query("F11_delivered", f"{_FLOW} SELECT t.o, t.dest, round(any_value(t.trips), 4) AS trips, round(coalesce(sum(q), 0), 4) AS delivered, abs(coalesce(sum(q), 0) - any_value(t.trips)) > 1e-6 * greatest(1, any_value(t.trips)) AS gap FROM trips t LEFT JOIN via v ON v.o = t.o AND v.dest = t.dest GROUP BY t.o, t.dest")
def delivered(c: City) -> DataFrame:
    sent = _trips(c)
    return flow.delivered(sent, _via(c, sent)).select("o", "dest", *r4("trips", "delivered"), "gap")


def _totals(c: City) -> tuple[DataFrame, DataFrame]:
    edge_flow, node_flow = viaflow.load(_trips(c), c.origins, c.destinations, _arcs(c), S, flow.tree_radius(S))
    return flow.undirected(edge_flow, c.edges), node_flow


@query("F10_F18_F20_K5_edge_flow", f"{_FLOW} SELECT edge_id, {_r4('flow', 'flow_ab', 'flow_ba')} FROM total")
def edge_flow(c: City) -> DataFrame:
    return _totals(c)[0].select("edge_id", *r4("flow", "flow_ab", "flow_ba"))


@query("F19_K6_node_flow", f"{_FLOW} SELECT node_id, {_r4('flow')} FROM node_flow")
def node_flow(c: City) -> DataFrame:
    return _totals(c)[1].select("node_id", *r4("flow"))


@query("F21_K7_observers_edge", f"{_FLOW} SELECT pt_id, {_r4('flow', 'flow_ab', 'flow_ba')} FROM observers o JOIN total t ON t.edge_id = o.edge_id")
def observers_edge(c: City) -> DataFrame:
    return flow.observed(_totals(c)[0], c.observers, c.edges).select("pt_id", *r4("flow", "flow_ab", "flow_ba"))


@query(
    "F21_K7_observers_node",
    f"""{_FLOW}, arrive AS (SELECT v AS node_id, flow_ab AS f FROM total JOIN edges USING (edge_id) UNION ALL SELECT u, flow_ba FROM total JOIN edges USING (edge_id))
SELECT pt_id, round(sum(f), 4) AS flow, CAST(NULL AS DOUBLE) AS flow_ab, CAST(NULL AS DOUBLE) AS flow_ba
FROM observers JOIN arrive ON node_id = CASE WHEN w_start <= w_end THEN u ELSE v END GROUP BY pt_id""",
)
def observers_node(c: City) -> DataFrame:
    return flow.observed(_totals(c)[0], c.observers, c.edges, "node").select("pt_id", *r4("flow", "flow_ab", "flow_ba"))


@query("F22_K8_obstacle_usage", f"{_FLOW} SELECT pt_id, round(CASE direction WHEN 'ab' THEN flow_ab WHEN 'ba' THEN flow_ba ELSE flow END, 4) AS usage FROM obstacles o JOIN total t ON t.edge_id = o.edge_id")
def obstacle_usage(c: City) -> DataFrame:
    return flow.obstacle_usage(_totals(c)[0], c.obstacles).select("pt_id", *r4("usage"))


@query(
    "F23_K9_used_origins",
    f"""{with_od()}, {sql.trips()} SELECT dest, string_agg(o, '|' ORDER BY o) AS origins, count(*) AS n_origins, round(sum(weight), 4) AS origin_weight FROM trips JOIN origins ON pt_id = o GROUP BY dest""",
)
def used_origins(c: City) -> DataFrame:
    t = trips.trips(_od(c), c.origins, c.destinations, S)
    return flow.used_origins(t, c.origins).select("dest", "origins", "n_origins", *r4("origin_weight"))


# ---------------------------------------------------------------- routes

_ALL_R, _DETOUR = 350, 1.15
_ALL = f"""{with_od(r=_ALL_R)}, {sql.seeds("dseeds", "destinations")}, {sql.label("dlab", "dseeds", _ALL_R * _DETOUR, "dst", "src")},
goal AS (SELECT od.o, od.dest, od.d, od.d * {_DETOUR}::DOUBLE + 0.00001::DOUBLE AS budget, s.edge_id AS oe, e.edge_id AS de, e.u AS du, e.v AS dv, e.w_start AS ds, e.w_end AS dw
  FROM od JOIN origins s ON s.pt_id = od.o JOIN destinations e ON e.pt_id = od.dest),
grown(o, dest, node, cost, nodes, es) AS (
  SELECT g.o, g.dest, s.node, s.d, [s.node], [g.oe] FROM goal g JOIN seeds s ON s.o = g.o JOIN dlab b ON b.o = g.dest AND b.node = s.node WHERE s.d + b.d <= g.budget
  UNION ALL
  SELECT p.o, p.dest, a.dst, p.cost + a.w, list_append(p.nodes, a.dst), list_append(p.es, a.edge_id)
  FROM grown p JOIN goal g ON g.o = p.o AND g.dest = p.dest JOIN arcs a ON a.src = p.node JOIN dlab b ON b.o = p.dest AND b.node = a.dst
  WHERE a.edge_id <> g.oe AND a.edge_id <> g.de AND NOT list_contains(p.nodes, a.dst) AND p.cost + a.w + b.d <= g.budget
), allp AS (
  SELECT p.o, p.dest, p.cost + x.c AS cost, list_append(p.es, g.de) AS es FROM grown p JOIN goal g ON g.o = p.o AND g.dest = p.dest
  JOIN (SELECT pt_id, u AS n, w_start AS c FROM destinations UNION ALL SELECT pt_id, v, w_end FROM destinations) x ON x.pt_id = p.dest AND x.n = p.node
  WHERE p.cost + x.c <= g.budget AND g.oe <> g.de
)"""


def _all_paths(c: City) -> DataFrame:
    pairs = _once(_od(c, radius=float(_ALL_R)), "pairs")
    return routes.all_paths(pairs, c.origins, c.destinations, _arcs(c), _DETOUR, float(_ALL_R))


@query("M1_M2_all_paths", f"{_ALL} SELECT o, dest, round(cost, 4) AS cost, array_to_string(es, '-') AS edges FROM allp")
def all_paths(c: City) -> DataFrame:
    return _all_paths(c).select("o", "dest", F.round("cost", 4).alias("cost"), F.concat_ws("-", F.col("edges").cast("array<string>")).alias("edges"))


@query(
    "M5_betweenness",
    f"""{_ALL}, {sql.trips()}, n AS (SELECT *, count(*) OVER (PARTITION BY o, dest) AS n FROM allp)
SELECT edge_id, round(sum(q), 4) AS flow FROM (SELECT unnest(es) AS edge_id, trips / n AS q FROM n JOIN trips t ON t.o = n.o AND t.dest = n.dest) GROUP BY edge_id""",
)
def betweenness(c: City) -> DataFrame:
    s = Settings(**(S.changed() | {"search_radius": float(_ALL_R)}))
    t = trips.trips(_od(c, radius=float(_ALL_R)), c.origins, c.destinations, s)
    return routes.betweenness(_all_paths(c), t).select("edge_id", *r4("flow"))


@query(
    "M7_exposure",
    f"""{_ALL}, p AS (SELECT o, row_number() OVER () AS p, es FROM allp), e AS (SELECT o, p, unnest(es) AS edge_id FROM p),
x AS (SELECT o, p, sum(weight * length) / sum(length) AS e FROM e JOIN edges USING (edge_id) GROUP BY o, p)
SELECT o, round(avg(e), 4) AS exposure, count(*) AS n_paths FROM x GROUP BY o""",
)
def exposure(c: City) -> DataFrame:
    return routes.exposure(_all_paths(c), c.edges, "weight").select("o", F.round("exposure", 4).alias("exposure"), "n_paths")


_SHARED = f"""{_ALL}, hs AS (
  SELECT o, dest, g / sum(g) OVER (PARTITION BY o) AS share, min(d) OVER (PARTITION BY o) AS least
  FROM (SELECT od.o, od.dest, od.d, t.weight * exp(-0.003::DOUBLE * od.d) AS g FROM od JOIN destinations t ON t.pt_id = od.dest)
), sh AS (
  SELECT row_number() OVER () AS p, a.o, a.es, a.len, a.pen / sum(a.pen) OVER (PARTITION BY a.o, a.dest) * h.share AS prob, exp(-0.003::DOUBLE * h.least) AS decay, s.weight AS ow
  FROM (SELECT o, dest, es, greatest(cost, 0.01) AS len, 1 / (greatest(cost, 0.01) * greatest(cost, 0.01)) AS pen FROM allp) a
  JOIN hs h ON h.o = a.o AND h.dest = a.dest JOIN origins s ON s.pt_id = a.o
)"""


def _path_shares(c: City) -> DataFrame:
    pairs = _once(_od(c, radius=float(_ALL_R)), "pairs")
    paths = routes.all_paths(pairs, c.origins, c.destinations, _arcs(c), _DETOUR, float(_ALL_R))
    nearest = pairs.groupBy("o").agg(F.min("d").alias("least"))
    weights = c.origins.select(F.col("pt_id").alias("o"), "weight")
    return _once(routes.path_shares(paths, routes.huff(pairs, c.destinations, 0.003), nearest, weights, "exponent", 0.003, "power"), "shares")


@query("M5_path_flow_power", f"{_SHARED} SELECT edge_id, round(sum(q), 4) AS flow FROM (SELECT unnest(es) AS edge_id, prob * decay * ow AS q FROM sh) GROUP BY edge_id")
def path_flow(c: City) -> DataFrame:
    return routes.path_flow(_path_shares(c)).select("edge_id", *r4("flow"))


@query(
    "M7_exposures",
    f"""{_SHARED}, mean AS (SELECT p, sum(weight * (edge_id % 7)) / sum(weight) AS e FROM (SELECT p, unnest(es) AS edge_id FROM sh) JOIN edges USING (edge_id) GROUP BY p)
SELECT o, round(sum(prob * e), 4) AS mean_exposure, round(sum(prob * decay * e), 4) AS decayed_mean_exposure, round(sum(prob * e * len), 4) AS expected_exposure,
  round(sum(prob * decay * e * len), 4) AS decayed_expected_exposure, round(sum(prob * len), 4) AS mean_path_length, round(sum(prob * decay * len), 4) AS probable_travel_distance, count(*) AS n_paths
FROM sh JOIN mean USING (p) GROUP BY o""",
)
def exposures(c: City) -> DataFrame:
    got = routes.exposures(_path_shares(c), c.edges.withColumn("a", F.col("edge_id") % 7), "a")
    names = [n for n in got.columns if n not in ("o", "n_paths")]
    return got.select("o", *r4(*names), "n_paths")


_K = Settings(**(S.changed() | _ALT | {"flow_n_alternatives": 8, "flow_alternative_penalty_factor": 1.05, "flow_path_detour_penalty": "equal"}))


def _alternatives(c: City) -> tuple[DataFrame, DataFrame]:
    pairs = _once(_od(c, same_edge=False), "pairs")
    return routes.alternatives(pairs, c.origins, c.destinations, _arcs(c), _K), trips.trips(pairs, c.origins, c.destinations, _K)


@query("F14_F15_W2_K10_alternatives")
def k_alternatives(c: City) -> DataFrame:
    out, _ = _alternatives(c)
    return out.select("o", "dest", "alt", F.round("cost", 4).alias("cost"), F.size("legs").alias("n_legs"))


@query("F17_W4_route_shares")
def route_shares(c: City) -> DataFrame:
    out, t = _alternatives(c)
    return routes.probabilities(out, t, _K).select("o", "dest", "alt", F.round("share", 6).alias("share"), F.round("volume", 4).alias("volume"))


@query("F18_alternatives_edge_flow")
def alternatives_flow(c: City) -> DataFrame:
    out, t = _alternatives(c)
    by_edge, _ = routes.load_routes(routes.probabilities(out, t, _K))
    return flow.undirected(by_edge, c.edges).select("edge_id", *r4("flow", "flow_ab", "flow_ba"))


_T = Settings(**(S.changed() | {"turns": True, "turn_threshold": 45.0, "turn_penalty": 32.0}))


def _turn_flow(c: City) -> tuple[DataFrame, DataFrame]:
    arcs = _once(topology.lightest_arcs(_arcs(c)), "arcs")
    forward, backward = turnflow.gradients(c.origins, c.destinations, arcs, turnflow.transitions(arcs, c.nodes, _T, False), flow.tree_radius(_T))
    pairs = turnflow.shortest(c.origins, c.destinations, arcs, forward, _T.search_radius)
    sent = _once(trips.trips(pairs, c.origins, c.destinations, _T), "trips")
    via = _once(turnflow.via_states(sent, c.origins, c.destinations, arcs, forward, backward, _T), "via")
    return turnflow.load(via, c.origins, c.destinations, arcs, forward, backward)


@query("F13_turn_edge_flow")
def turn_edge_flow(c: City) -> DataFrame:
    """Without SQL: tests hold the operator against searches written out in plain Python, as they do for alternatives."""
    return flow.undirected(_turn_flow(c)[0], c.edges).select("edge_id", *r4("flow", "flow_ab", "flow_ba"))


@query("F16_turn_alternatives")
def turn_alternatives(c: City) -> DataFrame:
    s = Settings(**(_K.changed() | {"turns": True, "turn_threshold": 45.0, "turn_penalty": 32.0}))
    arcs = _once(topology.lightest_arcs(_arcs(c)), "arcs")
    pairs = _once(_od(c, same_edge=False), "pairs")
    out = routes.alternatives(pairs, c.origins, c.destinations, arcs, s, turnflow.transitions(arcs, c.nodes, s, True))
    return out.select("o", "dest", "alt", F.round("cost", 4).alias("cost"), F.size("legs").alias("n_legs"))


# ---------------------------------------------------------------- areas

def _places(c: City) -> DataFrame:
    """Customers beside the network, in the groups of their nations."""
    k = F.col("c_custkey")
    return c.table("customer").select(
        k.alias("pt_id"), F.col("c_nationkey").alias("grp"), (k * 37 % 1009 + F.col("c_nationkey") * 20).cast("double").alias("x"), (k * k * 11 % 997).cast("double").alias("y")
    )


@query("G19_hulls")
def group_hulls(c: City) -> DataFrame:
    """Corners of each group's convex hull, in order."""
    return areas.hulls(_places(c), "grp").select("grp", F.posexplode("ring").alias("corner", "p")).select("grp", "corner", "p.x", "p.y")


@query("G10_clusters")
def origin_clusters(c: City) -> DataFrame:
    clustered = _once(areas.clusters(_places(c), 10), "clusters")
    return areas.within_masks(clustered, _places(c), 50.0)


@query("G13_snapped_ends")
def snapped_ends(c: City) -> DataFrame:
    return areas.snapped_ends(_places(c).withColumnRenamed("pt_id", "end"), 12.0)


@query(
    "G11_evaluation",
    with_city(_OFF)
    + """, n AS (SELECT min(x) AS x1, max(x) AS x2, min(y) AS y1, max(y) AS y2 FROM nodes), p AS (SELECT min(x) AS x1, max(x) AS x2, min(y) AS y1, max(y) AS y2 FROM off)
SELECT 'network_loaded' AS check_name, true AS passed UNION ALL SELECT 'bbox_overlap_points', p.x1 <= n.x2 AND n.x1 <= p.x2 AND p.y1 <= n.y2 AND n.y1 <= p.y2 FROM n, p
UNION ALL SELECT 'coord_system_points', (greatest(abs(n.x1), abs(n.x2)) <= 180 AND greatest(abs(n.y1), abs(n.y2)) <= 90) = (greatest(abs(p.x1), abs(p.x2)) <= 180 AND greatest(abs(p.y1), abs(p.y2)) <= 90) FROM n, p
UNION ALL SELECT 'snap_distance_points', 50 <= 0.05 * greatest(n.x2 - n.x1, n.y2 - n.y1) FROM n""",
)
def evaluation(c: City) -> DataFrame:
    """Points whose distances to the network are 50, whatever they are."""
    k = F.col("s_suppkey")
    off = c.table("supplier").select(((k * 137 % 1000).cast("double") + 3).alias("x"), ((k * 71 % 1000).cast("double") + 7).alias("y"), F.lit(50.0).alias("snap_dist"))
    found = readers.evaluate(c.nodes, {"points": off})
    return c.spark.createDataFrame([(n, bool(ok)) for n, (ok, _) in found.items()], "check_name string, passed boolean")


# ---------------------------------------------------------------- scenarios

@query(
    "A14_B5_B7_composite",
    f"""{with_od()}, s AS (SELECT pt_id, {", ".join(f"(SELECT coalesce(sum(t.weight), 0) FROM od JOIN destinations t ON t.pt_id = od.dest WHERE od.o = p.pt_id AND d <= {x}) AS r{x}" for x in (200, 400, 600))} FROM origins p)
SELECT pt_id, round(r200, 4) AS reach_near, round(r400, 4) AS reach_middle, round(r600, 4) AS reach_far, round(r200 + r400 + r600, 4) AS composite_sum FROM s""",
)
def composite(c: City) -> DataFrame:
    from wayfold.plans.batch import composite_access

    rows = [Settings(**(S.changed() | {"name": n, "search_radius": float(x)})) for n, x in (("near", 200), ("middle", 400), ("far", 600))]
    out = composite_access(rows, c.origins, c.destinations, _arcs(c), "reach")
    return out.select("pt_id", *r4("reach_near", "reach_middle", "reach_far", "composite_sum"))
