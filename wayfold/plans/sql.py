"""The operators in SQL over the derived city: common table expressions that the oracle composes."""

from __future__ import annotations

from wayfold.plans.city import CITY_SQL

R = 600

ARCS = """arcs AS (
  SELECT edge_id, u AS src, v AS dst, weight AS w, 0 AS dir FROM edges UNION ALL SELECT edge_id, v, u, weight, 1 FROM edges
)"""

CLIMBING = """arcs AS (
  SELECT a.edge_id, a.src, a.dst, a.w + 4.0::DOUBLE * greatest(n2.z - n1.z, 0.0::DOUBLE) AS w, a.dir
  FROM (SELECT edge_id, u AS src, v AS dst, weight AS w, 0 AS dir FROM edges UNION ALL SELECT edge_id, v, u, weight, 1 FROM edges) a
  JOIN nodes n1 ON n1.node_id = a.src JOIN nodes n2 ON n2.node_id = a.dst
)"""

PENALTIES = """penalties AS (
  SELECT edge_id, dir, sum(penalty) AS penalty FROM (
    SELECT edge_id, 0 AS dir, penalty FROM obstacles WHERE direction <> 'ba' UNION ALL SELECT edge_id, 1, penalty FROM obstacles WHERE direction <> 'ab')
  GROUP BY edge_id, dir
)"""

OBSTRUCTED = f"""{PENALTIES},
arcs AS (
  SELECT a.edge_id, a.src, a.dst, a.w + coalesce(p.penalty, 0.0::DOUBLE) AS w, a.dir
  FROM (SELECT edge_id, u AS src, v AS dst, weight AS w, 0 AS dir FROM edges UNION ALL SELECT edge_id, v, u, weight, 1 FROM edges) a
  LEFT JOIN penalties p ON p.edge_id = a.edge_id AND p.dir = a.dir
)"""


STACKED = f"""{PENALTIES},
arcs AS (
  SELECT a.edge_id, a.src, a.dst, a.w + 4.0::DOUBLE * greatest(n2.z - n1.z, 0.0::DOUBLE) + coalesce(p.penalty, 0.0::DOUBLE) AS w, a.dir
  FROM (SELECT edge_id, u AS src, v AS dst, weight AS w, 0 AS dir FROM edges UNION ALL SELECT edge_id, v, u, weight, 1 FROM edges) a
  JOIN nodes n1 ON n1.node_id = a.src JOIN nodes n2 ON n2.node_id = a.dst LEFT JOIN penalties p ON p.edge_id = a.edge_id AND p.dir = a.dir
)"""


def seeds(name: str, points: str) -> str:
    return f"""{name} AS (
  SELECT o, node, min(d) AS d FROM (SELECT pt_id AS o, u AS node, w_start AS d FROM {points} UNION ALL SELECT pt_id, v, w_end FROM {points}) GROUP BY o, node
)"""


def label(name: str, start: str, r: float = R, src: str = "src", dst: str = "dst") -> str:
    """A recursive expression (o, node, d); swapped ends give distances to points."""
    return f"""{name}(o, node, d) USING KEY (o, node) AS (
  SELECT o, node, d FROM {start} WHERE d <= {r}
  UNION
  SELECT l.o, a.{dst}, min(l.d + a.w) FROM {name} l JOIN arcs a ON a.{src} = l.node LEFT JOIN recurring.{name} q ON q.o = l.o AND q.node = a.{dst}
  WHERE l.d + a.w <= {r} AND (q.d IS NULL OR l.d + a.w < q.d) GROUP BY l.o, a.{dst}
)"""


def od(r: float = R, same_edge: bool = True) -> str:
    direct = "UNION ALL SELECT a.pt_id, b.pt_id, abs(a.w_start - b.w_start) FROM origins a JOIN destinations b ON a.edge_id = b.edge_id" if same_edge else ""
    return f"""dends AS (SELECT pt_id AS dest, u AS node, w_start AS c FROM destinations UNION ALL SELECT pt_id, v, w_end FROM destinations),
od AS (
  SELECT o, dest, min(d) AS d FROM (SELECT l.o, e.dest, l.d + e.c AS d FROM lab l JOIN dends e ON e.node = l.node {direct}) GROUP BY o, dest HAVING min(d) <= {r}
)"""


def with_od(arcs: str = ARCS, r: float = R, same_edge: bool = True, reach: float = 0) -> str:
    """Pairs within ``r``; labels reach as far as ``reach``, if that is further."""
    return f"WITH RECURSIVE {CITY_SQL}, {arcs}, {seeds('seeds', 'origins')}, {label('lab', 'seeds', max(r, reach))}, {od(r, same_edge)}"


def with_city(*more: str) -> str:
    return "WITH RECURSIVE " + ", ".join([CITY_SQL, *more])


def tree(name: str, labels: str, src: str = "src", dst: str = "dst") -> str:
    """Chains of arcs from the seeds (o, node, d, pred, root, path)."""
    return f"""{name}_tree AS (
  SELECT l.o, l.node, l.d, b.b.s AS pred, b.b.e AS edge_id, b.b.r AS dir FROM {labels} l LEFT JOIN (
    SELECT x.o, x.node, min({{'s': a.{src}, 'e': a.edge_id, 'r': a.dir}}) AS b FROM {labels} x JOIN arcs a ON a.{dst} = x.node
    JOIN {labels} y ON y.o = x.o AND y.node = a.{src} WHERE y.d + a.w = x.d GROUP BY x.o, x.node
  ) b ON b.o = l.o AND b.node = l.node
), {name}(o, node, d, pred, root, path) AS (
  SELECT o, node, d, pred, node, CAST([] AS STRUCT(edge_id BIGINT, dir INTEGER, node BIGINT)[]) FROM {name}_tree WHERE pred IS NULL
  UNION ALL
  SELECT t.o, t.node, t.d, t.pred, p.root, list_append(p.path, {{'edge_id': t.edge_id, 'dir': t.dir, 'node': t.node}})
  FROM {name}_tree t JOIN {name} p ON p.o = t.o AND p.node = t.pred
)"""


def trips(share: str = "w * exp(-0.002::DOUBLE * d)", factor: str = "exp(-0.002::DOUBLE * min(d) OVER (PARTITION BY o))") -> str:
    """trips (o, dest, d, trips): weight times factor times the destination's share of what the origin's sum to."""
    return f"""pairs AS (SELECT od.o, od.dest, od.d, t.weight AS w, s.weight AS ow FROM od JOIN destinations t ON t.pt_id = od.dest JOIN origins s ON s.pt_id = od.o WHERE s.weight > 0),
shared AS (SELECT *, {share} AS g FROM pairs),
trips AS (SELECT o, dest, d, trips FROM (SELECT o, dest, d, ow * ({factor}) * g / sum(g) OVER (PARTITION BY o) AS trips FROM shared) WHERE trips > 0)"""


def flow(ratio: float = 1.1) -> str:
    """via, edge_flow (edge_id, dir, flow), node_flow, total (edge_id, flow, flow_ab, flow_ba) on top of od and trips."""
    return f"""{seeds('dseeds', 'destinations')}, {label('dlab', 'dseeds', R * ratio, 'dst', 'src')},
{tree('fwd', 'lab')}, {tree('bwd', 'dlab', 'dst', 'src')},
fe AS (SELECT o, node, d, pred, list_transform(path, lambda p: p.edge_id) AS es FROM fwd),
be AS (SELECT o, node, d, pred, list_transform(path, lambda p: p.edge_id) AS es FROM bwd),
net AS (
  SELECT t.o, t.dest, a.src, a.dst, a.edge_id, a.dir, t.trips, t.d, f.d + a.w + b.d AS cost
  FROM trips t JOIN origins s ON s.pt_id = t.o JOIN destinations e ON e.pt_id = t.dest
  JOIN fe f ON f.o = t.o JOIN arcs a ON a.src = f.node JOIN be b ON b.o = t.dest AND b.node = a.dst
  WHERE f.d + a.w + b.d <= t.d * {ratio}::DOUBLE + 1e-9::DOUBLE
    AND coalesce(b.pred <> a.src, true) AND coalesce(f.pred <> a.dst, true) AND a.edge_id <> s.edge_id AND a.edge_id <> e.edge_id
    AND NOT list_contains(f.es, e.edge_id) AND NOT list_contains(b.es, s.edge_id) AND NOT list_contains(f.es, s.edge_id) AND NOT list_contains(b.es, e.edge_id)
), leave AS (
  SELECT t.o, t.dest, CAST(NULL AS BIGINT) AS src, c.node AS dst, c.edge_id, c.dir, t.trips, t.d, c.w + b.d AS cost
  FROM trips t JOIN (SELECT pt_id, edge_id, u AS node, w_start AS w, 1 AS dir FROM origins UNION ALL SELECT pt_id, edge_id, v, w_end, 0 FROM origins) c ON c.pt_id = t.o
  JOIN be b ON b.o = t.dest AND b.node = c.node WHERE c.w + b.d <= t.d * {ratio}::DOUBLE + 1e-9::DOUBLE AND NOT list_contains(b.es, c.edge_id)
), arrive AS (
  SELECT t.o, t.dest, c.node AS src, CAST(NULL AS BIGINT) AS dst, c.edge_id, c.dir, t.trips, t.d, f.d + c.w AS cost
  FROM trips t JOIN (SELECT pt_id, edge_id, u AS node, w_start AS w, 0 AS dir FROM destinations UNION ALL SELECT pt_id, edge_id, v, w_end, 1 FROM destinations) c ON c.pt_id = t.dest
  JOIN fe f ON f.o = t.o AND f.node = c.node WHERE f.d + c.w <= t.d * {ratio}::DOUBLE + 1e-9::DOUBLE AND NOT list_contains(f.es, c.edge_id)
), cand AS (
  SELECT *, 1 / (1 + exp(ln(99) / 150 * greatest(cost - d, 0))) AS pen FROM (SELECT * FROM net UNION ALL SELECT * FROM leave UNION ALL SELECT * FROM arrive)
), via AS (SELECT o, dest, src, dst, edge_id, dir, trips * pen / sum(pen) OVER (PARTITION BY o, dest) AS q FROM cand),
leg1 AS (SELECT v.q, f.o, f.root, f.path FROM via v JOIN fwd f ON f.o = v.o AND f.node = v.src),
leg2 AS (SELECT v.q, b.o, b.root, b.path FROM via v JOIN bwd b ON b.o = v.dest AND b.node = v.dst),
steps AS (SELECT q, unnest(path) AS p FROM leg1 UNION ALL SELECT q, unnest(path) FROM leg2),
loaded AS (
  SELECT edge_id, dir, q FROM via UNION ALL SELECT p.edge_id, p.dir, q FROM steps
  UNION ALL SELECT s.edge_id, CASE WHEN l.root = s.u AND (l.root <> s.v OR s.w_start <= s.w_end) THEN 1 ELSE 0 END, q FROM leg1 l JOIN origins s ON s.pt_id = l.o
  UNION ALL SELECT s.edge_id, CASE WHEN l.root = s.u AND (l.root <> s.v OR s.w_start <= s.w_end) THEN 0 ELSE 1 END, q FROM leg2 l JOIN destinations s ON s.pt_id = l.o
), edge_flow AS (SELECT edge_id, dir, sum(q) AS flow FROM loaded GROUP BY edge_id, dir),
node_flow AS (SELECT node_id, sum(q) AS flow FROM (SELECT root AS node_id, q FROM leg1 UNION ALL SELECT root, q FROM leg2 UNION ALL SELECT p.node, q FROM steps) GROUP BY node_id),
total AS (
  SELECT e.edge_id, coalesce(sum(flow), 0) AS flow, coalesce(sum(flow) FILTER (dir = 0), 0) AS flow_ab, coalesce(sum(flow) FILTER (dir = 1), 0) AS flow_ba
  FROM edges e LEFT JOIN edge_flow f ON f.edge_id = e.edge_id GROUP BY e.edge_id
)"""


def moves(rule: str) -> str:
    """moves (from_edge, from_dir, via, to_edge, to_dir, n3, turn, w) with threshold 45 and penalty 32."""
    sharp = {
        "geometry": "a.edge_id = b.edge_id OR round(((m.x - p.x) * (q.x - m.x) + (m.y - p.y) * (q.y - m.y)) / (sqrt((m.x - p.x) ** 2 + (m.y - p.y) ** 2) * sqrt((q.x - m.x) ** 2 + (q.y - m.y) ** 2)), 12) < round(cos(radians(45)), 12)",
        "node": "abs(abs(round(degrees(atan2(q.y - m.y, q.x - m.x)) - degrees(atan2(p.y - m.y, p.x - m.x)))) - 180) > 45",
    }
    dev = "abs(abs(round(degrees(atan2(q.y - m.y, q.x - m.x)) - degrees(atan2(p.y - m.y, p.x - m.x)))) - 180)"
    sharp["folded"] = f"least({dev}, abs({dev} - 180)) > 45"
    return f"""moves AS (
  SELECT a.edge_id AS from_edge, a.dir AS from_dir, a.dst AS via, b.edge_id AS to_edge, b.dir AS to_dir, b.dst AS n3,
    CASE WHEN {sharp[rule]} THEN 32.0::DOUBLE ELSE 0.0::DOUBLE END AS turn, b.w
  FROM arcs a JOIN arcs b ON b.src = a.dst JOIN nodes p ON p.node_id = a.src JOIN nodes m ON m.node_id = a.dst JOIN nodes q ON q.node_id = b.dst
)"""
