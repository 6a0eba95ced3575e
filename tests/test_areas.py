"""Points near hulls, held against a plain search."""

import math
import random

import numpy as np

from wayfold.operators import areas


def apart(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = min(1.0, max(0.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
    return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


def test_points_within_a_ring():
    rnd = random.Random(4)
    for ring in ([(0, 0), (50, -5), (60, 40), (20, 70), (-10, 30)], [(0, 0), (40, 30)], [(5, 5)]):
        ring = [(float(x), float(y)) for x, y in ring]
        at = [(rnd.uniform(-60, 110), rnd.uniform(-60, 110)) for _ in range(400)]
        sides = list(zip(ring, ring[1:] + ring[:1]))
        inside = [len(ring) > 2 and all((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) >= 0 for a, b in sides) for p in at]
        want = [i or min(apart(p, a, b) for a, b in sides) <= 25 for i, p in zip(inside, at)]
        got = areas.within_ring(np.array(ring), np.array([p[0] for p in at]), np.array([p[1] for p in at]), 25.0)
        assert got.tolist() == want and 0 < sum(want) < len(at)


def test_masks_cost_no_expression_for_each_side_and_point(spark):
    rows = spark.range(40).selectExpr("id as pt_id", "cast(id % 2 as int) as cluster", "cast(id * 7 % 11 as double) as x", "cast(id * 5 % 13 as double) as y")
    got = areas.within_masks(rows, rows.unionByName(rows.selectExpr("99L as pt_id", "cluster", "cast(null as double) as x", "y")), 1.0)
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and {r["pt_id"] for r in got.collect()} == set(range(40))


def test_ends_snap_in_their_order_however_dense(spark):
    rnd = random.Random(8)
    rows = [(k, float(rnd.randrange(60)), float(rnd.randrange(60)) if k % 3 else k * 0.5) for k in rnd.sample(range(5000), 1500)] + [(9000, None, 1.0), (9001, None, 1.0)]
    nodes, want = [], {}
    for end, x, y in sorted(rows, key=lambda r: r[0]):
        got = None if x is None else next((n for n, a, b in nodes if math.hypot(x - a, y - b) <= 6.0), None)
        want[end] = end if got is None else got
        if got is None and x is not None:
            nodes.append((end, x, y))
    got = areas.snapped_ends(spark.createDataFrame(rows, "end long, x double, y double"), 6.0).collect()
    assert {r["end"]: r["node"] for r in got} == want and len(got) == len(rows)
