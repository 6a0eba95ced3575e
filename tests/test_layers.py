"""Layers in every format, topology tables, results with their geometry, and batches."""

import json
import sqlite3
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wayfold import facade
from wayfold.operators import areas, topology
from wayfold.params import Settings, write_project
from wayfold.plans.staging import stage
from wayfold.sources import readers, wkb, writers

LINES = [
    ([(100.0 * c, 100.0 * r), (100.0 * (c + dc), 100.0 * (r + dr))], {"Length": 100.0})
    for r in range(4) for c in range(3) for dr, dc in ((0, 1), (1, 0)) if c + dc < 3 and r + dr < 4
]
ORIGINS = [([(205.0, 205.0)], {"OID": "O1", "Count": 20}), ([(5.0, 5.0)], {"OID": "O0", "Count": 10})]
DESTINATIONS = [([(205.0, 5.0)], {"DID": "D0", "Count": 30})]
#: The destination stands 5 from two edges; the smaller id is the horizontal one, so the way is 100 - 5 + 100 + 5.
O1_TO_D0 = 200.0


def binary(kind, coords):
    head = struct.pack("<BI", 1, 1 if kind == "Point" else 2) + (b"" if kind == "Point" else struct.pack("<I", len(coords)))
    return head + b"".join(struct.pack("<2d", *c) for c in coords)


def write_layer(spark, folder, name, kind, features, form, crs="EPSG:3857"):
    path, props = folder / f"{name}.{form}", list(features[0][1])
    shape = lambda c: list(c[0]) if kind == "Point" else [list(p) for p in c]
    made = [{"type": "Feature", "properties": p, "geometry": {"type": kind, "coordinates": shape(c)}} for c, p in features]
    columns = {p: [f[1][p] for f in features] for p in props}
    table = pa.table(columns | {"geometry": pa.array([binary(kind, c) for c, _ in features], pa.binary())})
    geo = {"primary_column": "geometry", "columns": {"geometry": {"crs": {"id": {"authority": "EPSG", "code": int(crs[5:])}}}}}
    table = table.replace_schema_metadata({"geo": json.dumps(geo)})
    if form == "geojson":
        path.write_text(json.dumps({"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": f"urn:ogc:def:crs:EPSG::{crs[5:]}"}}, "features": made}))
    elif form == "geojsonl":
        path.write_text("\n".join(map(json.dumps, made)))
    elif form == "parquet":
        import pyarrow.parquet

        pyarrow.parquet.write_table(table, path)
    elif form == "feather":
        import pyarrow.feather

        pyarrow.feather.write_feather(table, path)
    else:
        with sqlite3.connect(path) as db:
            db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, srs_id INTEGER)")
            db.execute("CREATE TABLE gpkg_spatial_ref_sys (srs_id INTEGER, organization TEXT, organization_coordsys_id INTEGER)")
            db.execute("INSERT INTO gpkg_geometry_columns VALUES ('layer', 'geom', 1)")
            db.execute("INSERT INTO gpkg_spatial_ref_sys VALUES (1, 'EPSG', ?)", (int(crs[5:]),))
            db.execute(f"CREATE TABLE layer (fid INTEGER, geom BLOB, {', '.join(props)})")
            for k, (c, p) in enumerate(features):
                db.execute(f"INSERT INTO layer VALUES (?, ?, {', '.join('?' * len(p))})", (k, b"GP\0\1" + struct.pack("<i", 1) + binary(kind, c), *p.values()))
    return path.name


def settings(folder, spark, form="geojson", **more):
    files = {n: write_layer(spark, folder, n, k, rows, form) for n, k, rows in (("network", "LineString", LINES), ("origins", "Point", ORIGINS), ("destinations", "Point", DESTINATIONS))}
    return Settings(**({
        "name": "a", "data_folder": str(folder), "network_file": files["network"], "origins_file": files["origins"], "destinations_file": files["destinations"],
        "origin_uid_column": "OID", "destination_id_column": "DID", "search_radius": 1000.0, "output_folder": str(folder / "out"), "output_wStamp": False, "knn_decay": "none",
    } | more))


@pytest.mark.parametrize("form", ["geojson", "geojsonl", "parquet", "feather", "gpkg"])
def test_the_smoke_grid_from_every_format(spark, tmp_path, form):
    s = settings(tmp_path, spark, form, destination_weight_column="Count")
    session = facade.Session(spark, s)
    assert session.network.edges.count() == 17 and session.network.nodes.count() == 12
    odm = {r["origin"]: r for r in facade.run_odm(session).collect()}
    assert odm["O1"]["distance"] == O1_TO_D0 and odm["O1"]["destination"] == "D0" and odm["O1"]["duration"] == pytest.approx(200 / (5000 / 60))
    got = {r["uid"]: r for r in facade.run_accessibility(session).collect()}
    assert got["O1"]["reach"] == 1.0 and got["O1"]["coords"][0]["x"] == 205.0
    # The destination lies just outside the network's box.
    assert {k for k, (ok, _) in session.evaluation.items() if not ok} == {"bbox_overlap_destinations"}
    if form != "geojsonl":
        assert readers.crs_of(spark, str(tmp_path / s.network_file)) == "EPSG:3857"
        other = write_layer(spark, tmp_path, "elsewhere", "Point", ORIGINS, form, "EPSG:4326")
        with pytest.raises(readers.LayerError):
            _ = facade.Session(spark, Settings(**(s.changed() | {"origins_file": other}))).origins


def test_binary_geometry_of_all_kinds():
    point, line = binary("Point", [(1.0, 2.0)]), binary("LineString", [(0.0, 0.0), (3.0, 4.0)])
    assert wkb.parse(point) == ("Point", [(1.0, 2.0, None)]) and wkb.parse(None) == (None, None)
    assert wkb.parse(struct.pack("<BI", 1, 5) + struct.pack("<I", 1) + line) == ("MultiLineString", [(0.0, 0.0, None), (3.0, 4.0, None)])
    assert wkb.parse(struct.pack(">BI", 0, 1001) + struct.pack(">3d", 1, 2, 3)) == ("Point", [(1.0, 2.0, 3.0)])
    assert wkb.parse(struct.pack("<BII", 1, 0xA0000001, 3857) + struct.pack("<3d", 1, 2, 3)) == ("Point", [(1.0, 2.0, 3.0)])
    ring = struct.pack("<BI", 1, 3) + struct.pack("<II", 1, 4) + struct.pack("<8d", 0, 0, 1, 0, 1, 1, 0, 0)
    assert wkb.parse(ring)[0] == "Polygon" and len(wkb.parse(ring)[1]) == 4


def test_shapefiles(tmp_path, spark):
    records, n = b"", 0
    for points in ([(0.0, 0.0), (100.0, 0.0)], [(100.0, 0.0), (100.0, 50.0), (100.0, 100.0)]):
        n += 1
        body = struct.pack("<I4dII", 3, 0, 0, 100, 100, 1, len(points)) + struct.pack("<I", 0) + b"".join(struct.pack("<2d", *p) for p in points)
        records += struct.pack(">II", n, len(body) // 2) + body
    (tmp_path / "a.shp").write_bytes(b"\0" * 100 + records)
    field = b"cost".ljust(11, b"\0") + b"N" + b"\0" * 4 + bytes([8, 2]) + b"\0" * 14
    (tmp_path / "a.dbf").write_bytes(b"\3" + b"\0" * 3 + struct.pack("<IHH", 2, 32 + 32 + 1, 9) + b"\0" * 20 + field + b"\r" + b"     1.50" + b" " * 9)
    got = readers.read_layer(spark, str(tmp_path / "a.shp")).orderBy("row").collect()
    assert [(r["row"], r["cost"], r["kind"], len(r["coords"])) for r in got] == [(0, 1.5, "LineString", 2), (1, None, "LineString", 3)]


def test_rows_of_several_files_have_numbers_of_their_own(spark, tmp_path):
    for k in range(3):
        write_layer(spark, tmp_path, f"part{k}", "LineString", LINES[k::3], "geojson")
    layer = readers.network_layer(readers.read_layer(spark, f"{tmp_path}/*.geojson"))
    assert sorted(r["edge_id"] for r in layer.collect()) == list(range(17))


def test_layers_that_cannot_be_used(spark, tmp_path):
    mixed = write_layer(spark, tmp_path, "mixed", "Point", ORIGINS, "geojson")
    with pytest.raises(readers.LayerError):
        readers.network_layer(readers.read_layer(spark, str(tmp_path / mixed)))
    with pytest.raises(readers.LayerError):
        readers.read_layer(spark, "a.txt")
    far = spark.createDataFrame([(1, 5.0, 50.0, 9.0)], "pt_id long, x double, y double, snap_dist double")
    nodes = spark.createDataFrame([(0.0, 0.0), (1000.0, 100.0)], "x double, y double")
    found = readers.evaluate(nodes, {"good": far, "bad": far.withColumns({"x": F.lit(1e7), "snap_dist": F.lit(900.0)})})
    assert {k for k, (ok, _) in found.items() if not ok} == {"bbox_overlap_bad", "snap_distance_bad"} | {"coord_system_good"}


def test_far_points_snap_and_match_brute_force(spark):
    import math
    import random

    rnd = random.Random(3)
    lines = [(k, [(rnd.uniform(0, 1000), rnd.uniform(0, 1000)) for _ in range(rnd.randint(2, 5))]) for k in range(60)]
    lines.append((60, [(-5000.0, -5000.0), (9000.0, 7000.0)]))
    pts = [(k, rnd.uniform(-200, 1200), rnd.uniform(-200, 1200)) for k in range(80)] + [(100, 2e6, -3e6), (101, 1e5, 1e5), (102, float("nan"), 0.0)]
    layer = spark.createDataFrame([(k, [(x, y, None) for x, y in c]) for k, c in lines], "edge_id long, coords array<struct<x:double,y:double,z:double>>").withColumn("weight", F.lit(10.0))
    points = spark.createDataFrame(pts, "pt_id long, x double, y double")

    def nearest(x, y):
        best = (math.inf, None, None)
        for k, c in lines:
            steps = [math.hypot(b[0] - a[0], b[1] - a[1]) for a, b in zip(c, c[1:])]
            for i, (a, b) in enumerate(zip(c, c[1:])):
                t = ((x - a[0]) * (b[0] - a[0]) + (y - a[1]) * (b[1] - a[1])) / steps[i] ** 2
                t = min(max(t, 0.0), 1.0)
                d = math.hypot(x - a[0] - t * (b[0] - a[0]), y - a[1] - t * (b[1] - a[1]))
                if d < best[0]:
                    best = (d, k, (sum(steps[:i]) + t * steps[i]) / sum(steps))
        return best

    for scale in (1.0, 1e-5):
        scaled = layer.withColumn("coords", F.transform("coords", lambda p: F.struct((p["x"] * scale).alias("x"), (p["y"] * scale).alias("y"), p["z"].alias("z"))))
        got = {r["pt_id"]: r for r in topology.snap(points.withColumns({"x": F.col("x") * scale, "y": F.col("y") * scale}), topology.segments(scaled)).collect()}
        assert set(got) == {p[0] for p in pts} - {102}
        for k, x, y in pts[:-1]:
            d, edge, frac = nearest(x, y)
            assert got[k]["edge_id"] == edge and got[k]["snap_dist"] == pytest.approx(d * scale) and got[k]["frac"] == pytest.approx(frac, abs=1e-6)
            assert got[k]["w_start"] + got[k]["w_end"] == pytest.approx(10.0)
    assert topology.snap(points, topology.segments(layer.limit(0))).count() == 0


def test_ranks_of_many_nodes(spark):
    nodes = spark.range(500).select(F.col("id").alias("node_id"), (F.col("id") * 7919 % 101).cast("double").alias("x"), (F.col("id") * 31 % 499).cast("double").alias("y"))
    got = topology.ranked(nodes).collect()
    assert [r["rank"] for r in sorted(got, key=lambda r: (r["x"], r["y"]))] == list(range(500))


# ---------------------------------------------------------------- outputs

def test_results_with_their_geometry(spark, tmp_path):
    s = settings(tmp_path, spark, flow_node_flow=True, flow_directional=True, flow_track_origins=True, observers_file="origins.geojson", result_prefix="x_", calculate_reach=False)
    got = facade.run_flow(session := facade.Session(spark, s))
    assert set(got) == {"edge_flow", "node_flow", "observers", "used_origins"} and got["node_flow"].count() == 12
    writers.write_collection(got["edge_flow"], str(tmp_path / "flow.geojson"))
    whole = json.loads((tmp_path / "flow.geojson").read_text())
    assert whole["type"] == "FeatureCollection" and len(whole["features"]) == 17 and whole["features"][0]["geometry"]["type"] == "LineString"
    back = readers.read_layer(spark, str(tmp_path / "flow.geojson"), {"flow": "double"})
    assert back.agg(F.sum("flow")).first()[0] == pytest.approx(got["edge_flow"].agg(F.sum("flow")).first()[0])
    named = writers.access_named(facade.run_accessibility(session), s)
    assert {"pt_id", "uid", "x_gravity_logistic", "x_gravity_exponential", "x_knn", "coords", "kind"} == set(named.columns)
    k = Settings(**(s.changed() | {"flow_engine": "k_alternatives", "flow_n_alternatives": 3, "flow_routes": True, "flow_detour_ratio": 1.5}))
    lines = facade.run_flow(facade.Session(spark, k))["routes"].collect()
    assert lines == sorted(lines, key=lambda r: (r["o"], r["dest"], r["alt"])) and {r["origin"] for r in lines} <= {"O0", "O1"}
    for r in lines:
        # Each edge begins where the one before it ended, from the second on.
        xy = [(p["x"], p["y"]) for p in r["coords"]]
        assert all(xy[i] == xy[i + 1] for i in range(3, len(xy) - 2, 2))
    assert facade.run_flow(facade.Session(spark, Settings(**(s.changed() | {"turns": True}))))["edge_flow"].count() == 17
    writers.write_feather(got["edge_flow"].select("edge_id", "flow"), str(tmp_path / "f" / "a.feather"), chunk=5)
    assert readers.feather_table(str(tmp_path / "f" / "a.feather")).num_rows == 17


def test_topology_tables_and_store(spark, tmp_path):
    s = settings(tmp_path, spark)
    session = facade.Session(spark, s)
    got = facade.topology_tables(session, [0])
    assert {n: df.count() for n, df in got.items()} == {"nodes": 12, "links": 17, "network": 17, "connectors": 3}
    near = {(r["x"], r["y"]): r["gradient_0"] for r in got["nodes"].collect()}
    assert near[200.0, 0.0] == 5.0 or near[200.0, 0.0] == 0.0
    ends = [r["coords"] for r in got["connectors"].where("layer = 'destination'").collect()][0]
    assert abs(ends[0]["x"] - ends[1]["x"]) + abs(ends[0]["y"] - ends[1]["y"]) == pytest.approx(5.0)
    facade.save_topology(session, str(tmp_path / "store"))
    again = facade.load_topology(spark, s, str(tmp_path / "store"))
    assert sorted(facade.run_odm(again).collect()) == sorted(facade.run_odm(session).collect())


def test_a_cache_sees_changed_files(spark, tmp_path):
    s = settings(tmp_path, spark, "parquet")
    cache = str(tmp_path / "cache")
    assert facade.run_odm(facade.Session(spark, s, cache)).count() == 2
    made = sorted(p.name for p in (tmp_path / "cache").iterdir())
    assert facade.run_odm(facade.Session(spark, s, cache)).count() == 2
    assert sorted(p.name for p in (tmp_path / "cache").iterdir()) == made
    write_layer(spark, tmp_path, "origins", "Point", ORIGINS * 2, "parquet")
    assert facade.run_odm(facade.Session(spark, s, cache)).count() == 4


def test_batches_publish_in_order_resume_and_see_changed_inputs(spark, tmp_path):
    s = settings(tmp_path, spark, output_geojson=False, output_wStamp=True, composite=True, composite_metric="reach", composite_prefix="c_")
    rows = [s, Settings(**(s.changed() | {"name": "b", "search_radius": 150.0})), Settings(name="none"), s, Settings(**(s.changed() | {"name": "loop", "origins_file": "out/a.parquet"}))]
    first = facade.run_batch(spark, rows)
    assert first.rows["none"].startswith("skipped") and first.rows["loop"].startswith("conflict") and first.resumed == []
    planned = [v for _, v in facade.plan_batch(rows)]
    assert planned[3].startswith("conflict: output") and [v for v in planned if v == "run"] == ["run"] * 2
    assert spark.read.parquet(first.rows["b"]).agg(F.sum("reach")).first()[0] < spark.read.parquet(first.rows["a"]).agg(F.sum("reach")).first()[0] + 1
    assert len(first.composites) == 1
    whole = spark.read.parquet(first.composites[0]).first()
    assert whole["composite_sum"] == whole["c_reach_a"] + whole["c_reach_b"]
    again = facade.run_batch(spark, rows[:2])
    assert again.resumed == ["a", "b"] and again.rows["a"] == first.rows["a"]
    write_layer(spark, tmp_path, "origins", "Point", ORIGINS * 2, "geojson")
    changed = facade.run_batch(spark, rows[:1])
    assert changed.resumed == [] and spark.read.parquet(changed.rows["a"]).count() == 4


def test_batches_of_flow(spark, tmp_path):
    s = settings(tmp_path, spark, output_wStamp=False, composite=True, composite_metric="edge_flow", flow_node_flow=True, output_feather=False, output_geojson=False)
    rows = [s, Settings(**(s.changed() | {"name": "b", "flow_detour_ratio": 1.5}))]
    got = facade.run_batch(spark, rows, analysis="flow")
    assert spark.read.parquet(got.rows["a"]).count() == 17 and (tmp_path / "out" / "a_network_nodes.parquet").exists()
    assert len(got.composites) == 1 and got.composites[0].endswith("composite.csv")
    flows = spark.read.option("header", True).option("inferSchema", True).csv(got.composites[0])
    assert {"edge_flow_a", "edge_flow_b", "composite_sum"} <= set(flows.columns) and flows.count() == 17
    with pytest.raises(ValueError):
        facade.run_batch(spark, rows, analysis="other")


def test_errors_stop_what_comes_after(spark, tmp_path):
    s = settings(tmp_path, spark)
    rows = [s, Settings(**(s.changed() | {"name": "bad", "origins_file": "network.geojson"})), Settings(**(s.changed() | {"name": "c"}))]
    with pytest.raises(readers.LayerError):
        facade.run_batch(spark, rows)
    assert (tmp_path / "out" / "a.parquet" / "_SUCCESS").exists() and not (tmp_path / "out" / "c.parquet").exists()


def test_projects_as_files(tmp_path):
    rows = [Settings(name="a", search_radius=600.0), Settings(name="b", knn_weights=(1.0, 0.5))]
    for form in ("json", "csv"):
        write_project(rows, str(tmp_path / f"p.{form}"))
        assert readers.read_pairings(str(tmp_path / f"p.{form}")) == rows
    assert readers.convert_project(str(tmp_path / "p.csv"), str(tmp_path / "q.json")) == 2
    assert readers.read_pairings(str(tmp_path / "q.json")) == rows
    assert Settings(flow_path_detour_penalty="off").flow_path_detour_penalty == "equal" and Settings(knn_decay="False").knn_decay == "none"
    assert Settings(flow_decay_curve="Exponent").flow_decay_curve == "exponential"


# ---------------------------------------------------------------- areas

def test_hulls_and_masks(spark):
    import random

    rnd = random.Random(2)
    pts = [(k % 2, k, (k % 2) * 5000 + rnd.uniform(0, 100), rnd.uniform(0, 100)) for k in range(400)]
    corners = [(g, 1000 + 4 * g + i, g * 5000.0 + x, y) for g in (0, 1) for i, (x, y) in enumerate([(0.0, 0.0), (100.0, 0.0), (100.0, 100.0), (0.0, 100.0)])]
    rows = spark.createDataFrame(pts + corners, "g long, pt_id long, x double, y double").repartition(7)
    got = {r["g"]: [(p["x"], p["y"]) for p in r["ring"]] for r in areas.hulls(rows, "g").collect()}
    assert got == {g: [(5000.0 * g, 0.0), (5000.0 * g + 100, 0.0), (5000.0 * g + 100, 100.0), (5000.0 * g, 100.0)] for g in (0, 1)}
    clustered = stage(areas.clusters(rows, 2), "clusters")
    assert clustered.groupBy("g").agg(F.count_distinct("cluster").alias("n")).where("n > 1").count() == 0
    probes = spark.createDataFrame([(1, 50.0, 50.0), (2, 109.0, 50.0), (3, 108.0, 107.0), (4, 5200.0, 50.0)], "pt_id long, x double, y double")
    assert {r["pt_id"] for r in areas.within_masks(clustered, probes, 10.0).collect()} == {1, 2}


def test_ends_within_a_tolerance_meet(spark):
    import random

    rnd = random.Random(9)
    ends = [(k, rnd.uniform(0, 60), rnd.uniform(0, 60)) for k in range(300)]
    got = {r["end"]: r["node"] for r in areas.snapped_ends(spark.createDataFrame(ends, "end long, x double, y double"), 4.0).collect()}
    want: dict[int, int] = {}
    for k, x, y in ends:
        if k in want:
            continue
        want[k] = k
        for j, a, b in ends:
            if j not in want and (a - x) ** 2 + (b - y) ** 2 <= 16.0:
                want[j] = k
    assert got == want
    lines = [(0, [(0.0, 0.0, None), (100.0, 0.0, None)], 100.0), (1, [(100.4, 0.0, None), (100.4, 90.0, None)], 90.0), (2, [(0.0, 0.3, None), (50.0, 5.0, None), (100.0, 90.2, None)], 130.0)]
    edges, nodes = areas.snapped_network(spark.createDataFrame(lines, "edge_id long, coords array<struct<x:double,y:double,z:double>>, weight double"), 1.0)
    by = {r["edge_id"]: r for r in edges.collect()}
    assert nodes.count() == 3 and by[1]["snapped"] and not by[2]["snapped"] and by[0]["v"] == by[1]["u"] and by[0]["u"] == by[2]["u"]
