"""The stepwise session over a small lattice, against paths written out in plain Python."""

import collections
import csv
import itertools
import json
import math

import pytest
from pyspark.sql import functions as F

from wayfold import zonal

EDGES = [(3 * r + c, 3 * (r + dr) + c + dc) for r, c in itertools.product(range(3), range(3)) for dr, dc in ((0, 1), (1, 0)) if r + dr < 3 and c + dc < 3]
COST = {k: 100.0 + 7 * k for k in range(len(EDGES))}
HAZARD = {k: float(k % 4) for k in range(len(EDGES))}
ORIGINS = [(40.0, 2.0, 2.0), (30.0, 202.0, 0.0), (170.0, 97.0, 5.0)]
DESTINATIONS = [(160.0, 3.0, 1.0), (198.0, 150.0, 4.0), (60.0, 98.0, 2.0)]


def write(folder):
    def layer(name, kind, rows):
        made = [{"type": "Feature", "properties": p, "geometry": {"type": kind, "coordinates": c}} for c, p in rows]
        (folder / name).write_text(json.dumps({"type": "FeatureCollection", "features": made}))

    xy = lambda n: [100.0 * (n % 3), 100.0 * (n // 3)]
    layer("streets.geojson", "LineString", [([xy(u), xy(v)], {"cost": COST[k], "hazard": HAZARD[k]}) for k, (u, v) in enumerate(EDGES)])
    layer("origins.geojson", "Point", [([x, y], {"people": w}) for x, y, w in ORIGINS])
    layer("destinations.geojson", "Point", [([x, y], {"jobs": w}) for x, y, w in DESTINATIONS])


@pytest.fixture
def city(spark, tmp_path):
    write(tmp_path)
    z = zonal.Zonal(spark)
    z.load_layer("streets", str(tmp_path / "streets.geojson"), {"cost": "double", "hazard": "double"})
    z.load_layer("homes", str(tmp_path / "origins.geojson"), {"people": "double"})
    z.load_layer("work", str(tmp_path / "destinations.geojson"), {"jobs": "double"})
    z.create_street_network("streets", "cost", 0.0, "discard")
    z.insert_node("homes", "origin", "people")
    z.insert_node("work", "destination", "jobs")
    z.create_graph()
    return z


def placed(rows):
    """(edge, share of it) of points beside the lattice."""
    out = []
    for x, y, w in rows:
        best = None
        for k, (u, v) in enumerate(EDGES):
            ax, ay, bx, by = 100 * (u % 3), 100 * (u // 3), 100 * (v % 3), 100 * (v // 3)
            t = min(max(((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / 10_000, 0), 1)
            d = math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay))
            if best is None or d < best[0]:
                best = (d, k, t)
        out.append((best[1], best[2], w))
    return out


def simple_paths(o, d, budget):
    """(cost, edges) over nodes visited once; along the common edge where there is one."""
    (oe, ot, _), (de, dt, _) = o, d
    out, ends = [], {EDGES[de][0]: dt * COST[de], EDGES[de][1]: (1 - dt) * COST[de]}

    def grow(node, cost, nodes, edges):
        if node in ends and cost + ends[node] <= budget:
            out.append((cost + ends[node], (*edges, de)))
        for k, (u, v) in enumerate(EDGES):
            if k not in (oe, de) and node in (u, v) and (other := u + v - node) not in nodes and cost + COST[k] <= budget:
                grow(other, cost + COST[k], nodes | {other}, (*edges, k))

    if oe != de:
        for node, c in ((EDGES[oe][0], ot * COST[oe]), (EDGES[oe][1], (1 - ot) * COST[oe])):
            grow(node, c, {node}, (oe,))
    return out


def nearest_cost(o, d):
    direct = [abs(o[1] - d[1]) * COST[o[0]]] if o[0] == d[0] else []
    return min([c for c, _ in simple_paths(o, d, 1e9)] + direct)


def test_access_and_closest_facility(city):
    os, ds = placed(ORIGINS), placed(DESTINATIONS)
    dist = {(i, j): nearest_cost(o, d) for i, o in enumerate(os) for j, d in enumerate(ds)}
    got = {r["o"]: r for r in city.accessibility(400.0, 0.5, 0.002, (1.0, 0.5), 120.0, save_reach_as="r", save_knn_access_as="k").collect()}
    for i, o in enumerate(os):
        near = sorted(((dist[i, j], d[2]) for j, d in enumerate(ds) if dist[i, j] <= 400.0))
        assert got[i]["reach"] == pytest.approx(sum(w for _, w in near))
        assert got[i]["gravity"] == pytest.approx(sum(w**0.5 * math.exp(-0.002 * x) for x, w in near))
        knn = sum(c * math.exp(-0.002 * max(x - 120.0, 0)) for c, (x, _) in zip((1.0, 0.5), near))
        assert got[i]["knn_access"] == pytest.approx(knn) and got[i]["knn_weight"] == pytest.approx(knn * o[2])
    saved = {r["id"]: r for r in city.layers["homes"].collect()}
    assert all(saved[i]["r"] == got[i]["reach"] and saved[i]["k"] == got[i]["knn_access"] for i in got)
    city.accessibility(1000.0, closest_facility=True, save_closest_facility_as="who", save_closest_facility_distance_as="far")
    for r in city.layers["work"].collect():
        assert r["far"] == pytest.approx(min(dist[i, r["id"]] for i in range(3))) and dist[r["who"], r["id"]] == pytest.approx(r["far"])


def test_paths_areas_and_scope(city):
    os, ds = placed(ORIGINS), placed(DESTINATIONS)
    got = collections.defaultdict(set)
    for r in city.alternative_paths(500.0, 1.3).collect():
        got[r["o"], r["dest"]].add((round(r["cost"], 6), tuple(r["edges"])))
        assert len(r["lines"]) == len(r["edges"])
    for i, o in enumerate(os):
        for j, d in enumerate(ds):
            least = nearest_cost(o, d)
            want = simple_paths(o, d, least * 1.3 + 1e-5) if least <= 500.0 else []
            assert got.get((i, j), set()) == {(round(c, 6), e) for c, e in want}
    found, parts, rings = city.service_area(250.0, [0])
    assert {r["dest"] for r in found.collect()} == {j for j, d in enumerate(ds) if nearest_cost(os[0], d) <= 250.0}
    assert rings.count() == 1 and all(0 < r["share"] <= 1 for r in parts.where("share > 0").collect())
    pairs, nodes = city.scope(250.0, 1.2)
    assert nodes.agg(F.max("d")).first()[0] <= 300.0 and pairs.agg(F.max("d")).first()[0] <= 250.0
    assert city.describe()["edges"] == len(EDGES) and city.describe()["origin"] == 3


@pytest.mark.parametrize("decay, penalty, closest, elastic", [("exponent", "equal", False, False), ("power", "power", False, False), ("exponent", "exponent", True, False), (None, "equal", False, True)])
def test_betweenness_by_all_modes(city, decay, penalty, closest, elastic):
    os, ds = placed(ORIGINS), placed(DESTINATIONS)
    beta, detour, radius = 0.003, 1.25, 700.0
    flows, stats = city.betweenness(
        radius, detour, decay is not None, decay or "exponent", beta, closest, elastic, (1.0, 0.5) if elastic else None, 50.0, path_detour_penalty=penalty,
        path_exposure_attribute="hazard", save_betweenness_as="flow", save_elastic_weight_as="sent" if elastic else None, save_path_exposure_as="hazards",
    )
    want, seen = collections.Counter(), {}
    for i, o in enumerate(os):
        dist = {j: x for j, d in enumerate(ds) if (x := nearest_cost(o, d)) <= radius}
        if o[2] == 0 or not dist:
            continue
        least, sums = min(dist.values()), collections.Counter()
        gravity = {j: ds[j][2] * math.exp(-beta * x) for j, x in dist.items()}
        share = {min(dist, key=dist.get): 1.0} if closest else {j: g / sum(gravity.values()) for j, g in gravity.items()}
        weight = o[2]
        if elastic:
            weight *= sum(c * math.exp(-beta * max(x - 50.0, 0)) for c, x in zip((1.0, 0.5), sorted(dist.values())))
        for j, p in share.items():
            paths = simple_paths(o, ds[j], dist[j] * detour + 1e-5)
            pen = [{"equal": 1.0, "exponent": math.exp(-beta * c), "power": 1 / c**2}[penalty] for c, _ in paths]
            for (c, edges), x in zip(paths, pen):
                fade = {None: 1.0, "exponent": math.exp(-beta * least), "power": 1 / c**2}[decay]
                prob = p * x / sum(pen)
                mean = sum(COST[k] * HAZARD[k] for k in edges) / sum(COST[k] for k in edges)
                sums.update({"mean_exposure": prob * mean, "expected_exposure": prob * mean * c, "decayed_mean_exposure": prob * fade * mean, "mean_path_length": prob * c, "n_paths": 1})
                for k in edges:
                    want[k] += prob * fade * weight
        seen[i] = sums
    assert {r["edge_id"]: r["flow"] for r in flows.collect() if r["flow"]} == pytest.approx(dict(want))
    for r in stats.collect():
        for name, x in seen.get(r["o"], {}).items():
            assert r[name] == pytest.approx(x)
    saved = {r["id"]: r["flow"] for r in city.layers["streets"].collect()}
    assert saved == pytest.approx({k: want.get(k, 0.0) for k in COST})


def test_redundant_edges_and_steps_out_of_order(spark, tmp_path):
    z = zonal.Zonal(spark)
    with pytest.raises(ValueError):
        z.insert_node("x", "origin")
    row = "array<struct<x:double,y:double,z:double>>"
    lines = [("LineString", [(0.0, 0.0, 1.0), (100.0, 0.0, 1.0)]), ("LineString", [(0.0, 0.0, 1.0), (50.0, 30.0, 1.0), (100.0, 0.0, 1.0)]), ("Polygon", [(0.0, 0.0, 1.0), (0.0, 60.0, 1.0)])]
    z.load_layer("s", spark.createDataFrame(lines, f"kind string, coords {row}"))
    counts = {}
    for treatment in ("keep", "discard", "split"):
        z.create_street_network("s", None, 0.0, treatment)
        counts[treatment] = (z.edges.count(), z.nodes.count())
    assert counts == {"keep": (3, 3), "discard": (2, 3), "split": (4, 4)}
    assert z.edges.agg(F.sum("weight")).first()[0] == pytest.approx(160 + 2 * math.hypot(50, 30))
    with pytest.raises(ValueError):
        z.create_street_network("s", None, -1.0)


def test_workflows(spark, tmp_path):
    write(tmp_path)
    fields = ["Flow_Name", "Network_File", "Network_Cost", "Origin_Name", "Origin_File", "Origin_Weight", "Destination_Name", "Destination_File", "Destination_Weight", "Radius", "Detour", "Decay",
              "Decay_Mode", "Beta", "Closest_destination", "Elastic_Weights", "KNN_Weight", "Plateau", "Turns", "Turn_Penalty", "Turn_Threshold", "Exposure_Attribute"]
    base = dict.fromkeys(fields, "") | {"Network_File": "streets.geojson", "Network_Cost": "cost", "Origin_Name": "homes", "Origin_File": "origins.geojson", "Origin_Weight": "Count", "Destination_Name": "work",
            "Destination_File": "destinations.geojson", "Destination_Weight": "jobs", "Radius": "600", "Detour": "1.1", "Decay": "True", "Decay_Mode": "exponent", "Beta": "0.002", "Closest_destination": "False",
            "Elastic_Weights": "False", "KNN_Weight": "[1, 0.5]", "Plateau": "100", "Turns": "False", "Turn_Penalty": "30", "Turn_Threshold": "45", "Exposure_Attribute": "hazard"}
    with open(tmp_path / "pairings.csv", "w", newline="") as f:
        w = csv.DictWriter(f, fields)
        w.writeheader()
        w.writerows([base | {"Flow_Name": "one"}, base | {"Flow_Name": "two", "Elastic_Weights": "True", "Turns": "True"}])
    z = zonal.flow_simulation(spark, str(tmp_path), str(tmp_path / "flow"))
    assert {"one", "two"} <= set(z.layers["streets"].columns) and {"reach_one", "gravity_two", "elastic_weight_two", "exposure_one"} <= set(z.layers["homes"].columns)
    assert len(json.loads((tmp_path / "flow" / "betweenness_record.geojson").read_text())["features"]) == len(EDGES)
    assert (tmp_path / "flow" / "one" / "origin_record.csv").exists() and "betweenness estimated" in (tmp_path / "flow" / "time_log.csv").read_text()
    got = zonal.access_simulation(spark, str(tmp_path), str(tmp_path / "knn"), "pairings.csv").collect()
    assert all(r["total_knn_access"] == pytest.approx(r["one_knn_access"] + r["two_knn_access"]) for r in got)
    assert {min(r["normalized_knn_access"] for r in got), max(r["normalized_knn_access"] for r in got)} == {0.0, 1.0}
