"""The network engine on small fixtures with hand-worked and brute-force values."""

import itertools
import json
import math
import types

import pytest
from pyspark.sql import functions as F

from wayfold import facade
from wayfold.operators import access, flow, impedance, pathjoin, routes, topology, trips
from wayfold.params import Settings, export_project
from wayfold.plans import queries
from wayfold.sources import readers, writers

EDGE = "edge_id long, u long, v long, length double, weight double"
POINT = "pt_id long, weight double, edge_id long, u long, v long, w_start double, w_end double"


@pytest.fixture(scope="module")
def lattice(spark):
    """3 x 3 nodes, 100 apart; node id = 3 * row + column."""
    edges, k = [], 0
    for r, c in itertools.product(range(3), range(3)):
        for dr, dc in ((0, 1), (1, 0)):
            if r + dr < 3 and c + dc < 3:
                edges.append((k, 3 * r + c, 3 * (r + dr) + c + dc, 100.0, 100.0))
                k += 1
    nodes = [(3 * r + c, 100.0 * c, 100.0 * r, 0.0) for r, c in itertools.product(range(3), range(3))]
    return spark.createDataFrame(edges, EDGE), spark.createDataFrame(nodes, "node_id long, x double, y double, z double"), edges


def points(spark, edges, rows):
    """(pt_id, weight, edge, distance from its start)."""
    ends = {e[0]: e for e in edges}
    return spark.createDataFrame([(i, w, e, ends[e][1], ends[e][2], d, ends[e][4] - d) for i, w, e, d in rows], POINT)


def distances(edges, start):
    best = {n: d for n, d in start}
    for _ in range(20):
        for _, u, v, _, w in edges:
            for a, b in ((u, v), (v, u)):
                if a in best and best[a] + w < best.get(b, math.inf):
                    best[b] = best[a] + w
    return best


@pytest.mark.parametrize("strategy", ["arrow", "relational"])
def test_labels_equal_relaxation(spark, lattice, strategy):
    edges, _, rows = lattice
    o = points(spark, rows, [(1, 1.0, 0, 30.0), (2, 1.0, 5, 0.0)])
    got = pathjoin.labels(o, topology.arcs(edges), 250.0, strategy).collect()
    want = {}
    for r in o.collect():
        for n, d in distances(rows, [(r["u"], r["w_start"]), (r["v"], r["w_end"])]).items():
            if d <= 250:
                want[r["pt_id"], n] = d
    assert {(r["o"], r["node"]): r["d"] for r in got} == want


def test_pairs_within_closed_radius_and_along_the_edge(spark, lattice):
    edges, _, rows = lattice
    o, d = points(spark, rows, [(1, 1.0, 0, 5.0)]), points(spark, rows, [(7, 30.0, 0, 95.0), (8, 10.0, 1, 95.0), (9, 1.0, 11, 50.0)])
    got = {r["dest"]: r["d"] for r in pathjoin.od(o, d, topology.arcs(edges), 100.0).collect()}
    assert got == {7: 90.0, 8: 100.0}
    near = access.accessibility(pathjoin.od(o, d, topology.arcs(edges), 100.0), o, d, Settings(search_radius=100.0, knn_decay="none", knn_weights=(1.0, 0.5)))
    r = near.first()
    assert r["reach"] == 40.0 and r["knn_access"] == 35.0
    assert r["gravity_exponential"] == pytest.approx(30 * math.exp(-0.09) + 10 * math.exp(-0.1)) and r["gravity_exponential"] <= r["reach"]


def test_unreachable_origins_are_zero(spark, lattice):
    edges, _, rows = lattice
    o, d = points(spark, rows, [(1, 1.0, 0, 5.0)]), points(spark, rows, [(9, 1.0, 11, 50.0)])
    got = access.accessibility(pathjoin.od(o, d, topology.arcs(edges), 10.0), o, d, Settings(search_radius=10.0)).first()
    assert [got[m] for m in access.METRICS] == [0.0] * 4


def test_turns_cost_and_straight_on_is_free(spark, lattice):
    edges, nodes, rows = lattice
    moves = impedance.transitions(topology.arcs(edges), nodes, "geometry", 45.0, 32.0)
    o = points(spark, rows, [(1, 1.0, 0, 50.0)])
    d = points(spark, rows, [(2, 1.0, next(e[0] for e in rows if e[1:3] == (1, 2)), 50.0), (3, 1.0, next(e[0] for e in rows if e[1:3] == (1, 4)), 50.0)])
    got = {r["dest"]: r["d"] for r in pathjoin.turn_od(o, d, topology.arcs(edges), moves, 1000.0).collect()}
    assert got == {2: 100.0, 3: 132.0}


def test_whole_turn_pairs_are_of_all_origins_at_the_radius(spark, lattice):
    edges, nodes, rows = lattice
    at = [(i, 1.0, i % len(rows), 10.0 * (i % 9) + 5) for i in range(1, 12)]
    o, d = points(spark, rows, at), points(spark, rows, [(100 + i, w, e, 100.0 - x) for i, w, e, x in at])
    xy = {n: (n % 3, n // 3) for n in range(9)}
    ends = {(e, k): (b, a) if k else (a, b) for e, a, b, _, _ in rows for k in (0, 1)}
    state, goal = {}, {}
    for e, k in ends:
        a, b = ends[e, k]
        state[e, k], goal[e, k] = [], (xy[b][0] - xy[a][0], xy[b][1] - xy[a][1])
    turn = lambda s, t: 0.0 if goal[s] == goal[t] else 32.0
    for s in state:
        state[s] = [t for t in state if ends[t][0] == ends[s][1] and t[0] != s[0]]
    want = {}
    for i, _, e, x in at:
        best = {(e, 1): x, (e, 0): 100.0 - x}
        for _ in range(30):
            for s in list(best):
                for t in state[s]:
                    best[t] = min(best.get(t, math.inf), best[s] + turn(s, t) + 100.0)
        for j, _, f, y in at:
            y = 100.0 - y
            found = [best[s] + turn(s, t) + (100.0 - y if t[1] else y) for s in best for t in state[s] if t[0] == f] + [abs(x - y)] * (e == f)
            if min(found) <= queries.R:
                want[i, 100 + j] = min(found)
    city = types.SimpleNamespace(edges=edges, nodes=nodes, origins=o, destinations=d)
    got = {(r["o"], r["dest"]): r["d"] for r in queries.turn_od(city).collect()}
    assert got == pytest.approx(want) and {i for i, _ in got} == set(range(1, 12)) and max(got.values()) > 400


def test_flow_loads_both_snap_edges_with_all_trips(spark, lattice):
    edges, _, rows = lattice
    o, d = points(spark, rows, [(1, 10.0, 0, 50.0)]), points(spark, rows, [(2, 1.0, 11, 50.0)])
    arcs = topology.arcs(edges)
    s = Settings(search_radius=1000.0, flow_decay=False, flow_detour_ratio=1.4)
    sent = trips.trips(pathjoin.od(o, d, arcs, 1000.0), o, d, s)
    assert sent.first()["trips"] == 10.0
    forward, backward = flow.trees(o, d, arcs, 1000.0)
    via = flow.via_arcs(sent, o, d, arcs, forward, backward, s)
    assert via.agg(F.sum("q")).first()[0] == pytest.approx(10.0)
    by_edge, _ = flow.load(via, o, d, forward, backward)
    total = {r["edge_id"]: r["flow"] for r in flow.undirected(by_edge, edges).collect()}
    assert total[0] == pytest.approx(10.0) and total[11] == pytest.approx(10.0) and len(total) == len(rows)
    assert not flow.delivered(sent, via).first()["gap"]


def test_flow_trees_reach_as_far_as_the_detour_budget(spark):
    # Two ways of 2,900 and 3,300; the budget is 1.2 x 2,920, and the longer way's far end is beyond radius + buffer.
    rows = [(k, u, v, w, w) for k, (u, v, w) in enumerate([(0, 1, 20.0), (1, 2, 2900.0), (1, 3, 50.0), (3, 2, 3250.0), (2, 4, 20.0)])]
    edges = spark.createDataFrame(rows, EDGE)
    o, d = points(spark, rows, [(1, 10.0, 0, 10.0)]), points(spark, rows, [(2, 1.0, 4, 10.0)])
    arcs, flows = topology.arcs(edges), []
    for buffer in (100.0, 5000.0):
        s = Settings(search_radius=3000.0, flow_decay=False, flow_detour_ratio=1.2, flow_detour_buffer=buffer, flow_node_flow=False)
        network = types.SimpleNamespace(arcs=arcs, edges=edges)
        session = types.SimpleNamespace(settings=s, network=network, pairs=pathjoin.od(o, d, arcs, 3000.0), origins=o, destinations=d)
        flows.append({r["edge_id"]: r["flow"] for r in facade.run_flow(session)["edge_flow"].collect()})
    assert flows[0] == pytest.approx(flows[1]) and flows[0][2] > 0
    assert [flow.tree_radius(Settings(search_radius=3000.0, flow_detour_ratio=1.2, flow_detour_mode=m)) for m in ("ratio", "buffer", "min")] == [3600.0, 3100.0, 3100.0]


def test_all_paths_of_a_lattice_and_the_cap(spark, lattice):
    edges, _, rows = lattice
    arcs = topology.arcs(edges)
    o, d = points(spark, rows, [(1, 1.0, 0, 50.0)]), points(spark, rows, [(2, 1.0, 11, 50.0)])
    pairs = pathjoin.od(o, d, arcs, 1000.0)
    got = routes.all_paths(pairs, o, d, arcs, 1.0, 1000.0).collect()
    shortest = pairs.first()["d"]
    assert got and all(r["cost"] == pytest.approx(shortest) for r in got) and len({tuple(r["edges"]) for r in got}) == len(got)
    with pytest.raises(RuntimeError):
        routes.all_paths(pairs, o, d, arcs, 3.0, 1000.0, max_paths=3).count()


def test_alternatives_repeat_and_stay_within_budget(spark, lattice):
    edges, _, rows = lattice
    arcs = topology.arcs(edges)
    o, d = points(spark, rows, [(1, 1.0, 0, 50.0)]), points(spark, rows, [(2, 1.0, 11, 50.0), (3, 2.0, 8, 10.0)])
    s = Settings(search_radius=1000.0, flow_engine="k_alternatives", flow_n_alternatives=6, flow_alternative_penalty_factor=1.2, flow_path_detour_penalty="equal")
    pairs = pathjoin.od(o, d, arcs, 1000.0, same_edge=False)
    found = routes.alternatives(pairs, o, d, arcs, s)
    base = {r["dest"]: r["d"] for r in pairs.collect()}
    rows_ = found.collect()
    assert {r["alt"] for r in rows_} <= set(range(1, 7)) and all(r["cost"] <= base[r["dest"]] * 1.05 + 1e-2 for r in rows_)
    shares = routes.probabilities(found, trips.trips(pairs, o, d, s), s)
    assert all(r["s"] == pytest.approx(1.0) for r in shares.groupBy("o", "dest").agg(F.sum("share").alias("s")).collect())


def test_settings_rows_and_projects(tmp_path):
    path = tmp_path / "pairings.csv"
    path.write_text("name,search_radius,elevation,knn_weights,flow_n_alternatives,unknown\na,600,Yes,\"[1, 0.5]\",5.0,x\nb,,nan,,,\n")
    a, b = readers.read_pairings(str(path))
    assert (a.search_radius, a.elevation, a.knn_weights, a.flow_n_alternatives) == (600.0, True, (1.0, 0.5), 5)
    assert b == Settings(name="b")
    assert export_project([a, b])[1] == {"name": "b", "search_radius": 1500.0, "knn_weights": (1.0, 1.0, 0.5), "elevation": False, "flow_n_alternatives": 30}
    a.save(str(tmp_path / "s.json"))
    assert Settings.load(str(tmp_path / "s.json")) == a
    for bad in ({"search_radius": 0.0}, {"flow_detour_ratio": 0.9}, {"flow_decay_curve": "linear"}, {"flow_gravity_cap": "p101"}, {"knn_weights": ()}):
        with pytest.raises(ValueError):
            Settings(**bad)


def test_writers(spark, tmp_path):
    import sqlite3

    df = spark.createDataFrame([(1, "a", [(0.0, 0.0, None), (1.5, 2.0, None)])], "edge_id long, name string, coords array<struct<x:double,y:double,z:double>>")
    writers.write_geojson(df, str(tmp_path / "g"))
    line = json.loads(next(p for p in (tmp_path / "g").glob("part*") if p.stat().st_size).read_text())
    assert line["geometry"] == {"type": "LineString", "coordinates": [[0.0, 0.0], [1.5, 2.0]]} and line["properties"] == {"edge_id": 1, "name": "a"}
    writers.write_sqlite(df.select("edge_id", "name"), str(tmp_path / "x" / "a.sqlite"), "od")
    with sqlite3.connect(tmp_path / "x" / "a.sqlite") as db:
        assert db.execute("SELECT * FROM od").fetchall() == [(1, "a")]
    writers.write_feather(df.select("edge_id", "name"), str(tmp_path / "a.feather"))
    assert readers.feather_table(str(tmp_path / "a.feather")).num_rows == 1


def test_entry_lists_every_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) >= 69
