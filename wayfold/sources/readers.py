"""Reading layers into tables with line or point coordinates: GeoJSON, parquet, feather, GeoPackage and shapefile."""

from __future__ import annotations

import csv
import json
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.params import Settings, project_rows
from wayfold.plans.staging import stage
from wayfold.sources import wkb

_COORDS = "array<struct<x:double,y:double,z:double>>"
_SHAPE = f"struct<kind:string,coords:{_COORDS}>"


class LayerError(ValueError):
    """A layer that can't be used as it is."""


def read_layer(spark: SparkSession, path: str, properties: dict[str, str] | None = None) -> DataFrame:
    """A vector layer by its extension: ``row``, its properties, ``kind`` and ``coords`` (points have one).

    ``row`` numbers the features from 0.  GeoJSON is read by Spark as one JSON document per file, or line by
    line where the extension is .geojsonl (or .ndjson), which splits; give the types of the properties that
    are needed (all are text otherwise).  Parquet tables have a ``coords`` column, ``x`` and ``y``
    columns, or well-known binary in ``geometry``; they are the form for large layers.  Feather, GeoPackage
    and shapefile are read on the driver: they hold one table that fits there.
    """
    suffix = path.rpartition(".")[2].lower()
    if suffix in ("geojson", "json", "geojsonl", "ndjson"):
        return _geojson(spark, path, properties or {}, suffix in ("geojsonl", "ndjson"))
    if suffix == "parquet":
        return numbered(_with_coords(spark.read.parquet(path)))
    if suffix == "feather":
        return numbered(_with_coords(spark.createDataFrame(feather_table(path))))
    if suffix in ("gpkg", "shp"):
        names, rows, _ = (wkb.read_geopackage if suffix == "gpkg" else wkb.read_shapefile)(path)
        return numbered(_frame(spark, names, rows))
    raise LayerError(f"{path}: layers are .geojson, .geojsonl, .parquet, .feather, .gpkg or .shp")


def feather_table(path: str):
    from pyarrow import feather

    return feather.read_table(path)


def crs_of(spark: SparkSession, path: str) -> str | None:
    """The layer's reference system as AUTHORITY:CODE, where it says so."""
    suffix = path.rpartition(".")[2].lower()
    if suffix in ("geojson", "json"):
        name = spark.read.text(path, wholetext=True).select(F.get_json_object("value", "$.crs.properties.name").alias("n")).first()
        return _crs(name["n"]) if name else None
    if suffix == "gpkg":
        return wkb.read_geopackage(path)[2]
    if suffix in ("parquet", "feather") and Path(path).is_file():
        from pyarrow import feather, parquet

        schema = parquet.read_schema(path) if suffix == "parquet" else feather.read_table(path, columns=[]).schema
        geo = json.loads((schema.metadata or {}).get(b"geo", b"{}"))
        crs = geo.get("columns", {}).get(geo.get("primary_column", "geometry"), {}).get("crs")
        known = crs.get("id") if isinstance(crs, dict) else None
        return f"{known['authority']}:{known['code']}" if known else _crs(crs) if isinstance(crs, str) else None
    return None


def _crs(name: str | None) -> str | None:
    """``urn:ogc:def:crs:EPSG::3857`` and ``EPSG:3857`` are the same name."""
    parts = [p for p in (name or "").split(":") if p]
    return ":".join(parts[-2:]).upper() if len(parts) > 1 else None


def same_crs(network: str | None, layer: str | None, name: str) -> None:
    """A layer without a reference system takes the network's; another one is an error, as nothing is reprojected here."""
    if network and layer and network != layer:
        raise LayerError(f"{name} is in {layer}, the network in {network}; bring them into one reference system first")


def _frame(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    kinds = {int: "long", float: "double", bytes: "binary"}
    types = []
    for k, name in enumerate(names[:-2]):
        found = {type(r[k]) for r in rows if r[k] is not None}
        types.append(f"`{name}` {kinds.get(found.pop(), 'string') if len(found) == 1 else 'double' if found == {int, float} else 'string'}")
    return spark.createDataFrame(rows, ", ".join([*types, "kind string", f"coords {_COORDS}"]))


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with ``row``, a number from 0 in the order of the files, unless it has one."""
    if "row" in df.columns:
        return df.withColumn("row", F.col("row").cast("long"))
    place = F.monotonically_increasing_id()
    held = stage(df.withColumns({"__at": place, "__part": F.shiftright(place, 33)}), "layer")
    parts = held.groupBy("__part").agg(F.min("__at").alias("__first"), F.count("*").alias("n")).collect()
    before, total = {}, 0
    for r in sorted(parts, key=lambda r: r["__part"]):
        before[r["__part"]] = total - r["__first"]
        total += r["n"]
    offsets = held.sparkSession.createDataFrame(list(before.items()), "__part long, __before long")
    return held.join(F.broadcast(offsets), "__part").withColumn("row", F.col("__at") + F.col("__before")).drop("__part", "__at", "__before")


def _with_coords(df: DataFrame) -> DataFrame:
    if "coords" in df.columns:
        return df if "kind" in df.columns else df.withColumn("kind", F.when(F.size("coords") == 1, "Point").otherwise("LineString"))
    if "geometry" in df.columns:
        return df.withColumn("__shape", _from_wkb("geometry")).select(*(c for c in df.columns if c not in ("geometry", "kind")), "__shape.*")
    if {"x", "y"} <= set(df.columns):
        z = F.col("z").cast("double") if "z" in df.columns else F.lit(None).cast("double")
        one = F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), z.alias("z"))
        return df.withColumns({"kind": F.lit("Point"), "coords": F.array(one)})
    raise LayerError("a table of a layer has coords, geometry, or x and y")


def _from_wkb(column: str) -> Column:
    @F.pandas_udf(_SHAPE)
    def shapes(data: pd.Series) -> pd.DataFrame:
        kinds, coords = [], []
        for d in data:
            kind, points = wkb.parse(d)
            kinds.append(kind)
            coords.append(None if points is None else [{"x": x, "y": y, "z": z} for x, y, z in points])
        return pd.DataFrame({"kind": kinds, "coords": coords})

    return shapes(column)


def _geojson(spark: SparkSession, path: str, properties: dict[str, str], lines: bool) -> DataFrame:
    feature = "struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"
    if lines:
        read = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", feature).alias("f")).select("f.*")
    else:
        whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"struct<features:array<{feature}>>").alias("f"))
        read = whole.select(F.posexplode("f.features").alias("i", "f")).select("f.*")
    pairs = F.from_json("geometry.coordinates", "array<array<double>>")
    one = F.from_json("geometry.coordinates", "array<double>")
    raw = F.when(F.col("geometry.type") == "Point", F.array(one)).when(F.col("geometry.type") == "LineString", pairs)
    parts = F.from_json("geometry.coordinates", "array<array<array<double>>>")
    raw = raw.when(F.col("geometry.type").isin("Polygon", "MultiLineString"), F.get(parts, F.lit(0)))
    coords = F.transform(raw, lambda c: F.struct(F.get(c, F.lit(0)).alias("x"), F.get(c, F.lit(1)).alias("y"), F.get(c, F.lit(2)).alias("z")))
    own = [F.col("properties")[n].cast(t).alias(n) for n, t in properties.items()]
    return numbered(read.select(*own, "properties", F.col("geometry.type").alias("kind"), coords.cast(_COORDS).alias("coords")))


def network_layer(layer: DataFrame, precision: int = 3) -> DataFrame:
    """(edge_id, coords, ...) of a line layer; anything else in it is an error."""
    bad = layer.where(F.col("kind").isNull() | (F.col("kind") != "LineString") | F.col("coords").isNull()).limit(1).count()
    if bad:
        raise LayerError("a network has LineStrings only")
    return layer.drop("edge_id").withColumnRenamed("row", "edge_id")


def cleaned_lines(layer: DataFrame) -> DataFrame:
    """Lines for a network of the other API: boundaries of polygons, first parts, no heights."""
    flat = F.transform("coords", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), F.lit(None).cast("double").alias("z")))
    return layer.where("coords is not null").withColumns({"coords": flat, "kind": F.lit("LineString")})


def point_layer(layer: DataFrame, uid: str = "") -> DataFrame:
    """(pt_id, uid, x, y, coords, ...) of a point layer; the uid is the row's number where no column is named."""
    if layer.where(F.col("kind").isNull() | (F.col("kind") != "Point") | F.col("coords").isNull()).limit(1).count():
        raise LayerError("a point layer has points only")
    first = F.element_at("coords", 1)
    name = F.col(uid).cast("string") if uid else F.col("row").cast("string")
    return layer.withColumns({"pt_id": F.col("row"), "uid": name, "x": first["x"], "y": first["y"]})


def read_pairings(path: str, base: Settings = Settings()) -> list[Settings]:
    """A project: one Settings per row of a CSV, TSV or JSON file (small by nature, read on the driver)."""
    text = Path(path).read_text()
    if path.lower().endswith(".json"):
        rows = json.loads(text)
    else:
        rows = list(csv.DictReader(text.splitlines(), delimiter="\t" if path.lower().endswith((".tsv", ".txt")) else ","))
    return project_rows(rows, base)


def convert_project(source: str, target: str) -> int:
    """A project of text rows as a JSON file of the rows' own cells; returns how many rows."""
    rows = list(csv.DictReader(Path(source).read_text().splitlines(), delimiter="\t" if source.lower().endswith((".tsv", ".txt")) else ","))
    Path(target).write_text(json.dumps(rows, indent=1))
    return len(rows)


def evaluate(network: DataFrame, layers: dict[str, DataFrame]) -> dict[str, tuple[bool, str]]:
    """Checks of point layers (x, y, snap_dist) against a network (x, y of its nodes), by name: passed, and what was found.

    Boxes have to meet, coordinates have to look alike (degrees or not), and the median distance
    to the network is at most a twentieth of its extent.
    """
    sides = [F.min("x").alias("x1"), F.max("x").alias("x2"), F.min("y").alias("y1"), F.max("y").alias("y2")]
    n = network.agg(*sides).first()
    if n["x1"] is None:
        return {"network_loaded": (False, "the network is empty")}
    looks = lambda r: "degrees" if max(abs(r["x1"]), abs(r["x2"])) <= 180 and max(abs(r["y1"]), abs(r["y2"])) <= 90 else "projected"
    extent = max(n["x2"] - n["x1"], n["y2"] - n["y1"])
    out = {"network_loaded": (True, f"extent {extent:g}")}
    for name, layer in layers.items():
        p = layer.agg(*sides, F.percentile_approx("snap_dist", 0.5, 10_000).alias("median")).first()
        if p["x1"] is None:
            out[f"layer_loaded_{name}"] = (False, "no points")
            continue
        meet = p["x1"] <= n["x2"] and n["x1"] <= p["x2"] and p["y1"] <= n["y2"] and n["y1"] <= p["y2"]
        out[f"bbox_overlap_{name}"] = (meet, "the boxes meet" if meet else "the boxes don't meet")
        out[f"coord_system_{name}"] = (looks(n) == looks(p), f"network {looks(n)}, {name} {looks(p)}")
        out[f"snap_distance_{name}"] = (p["median"] <= 0.05 * extent, f"median {p['median']:g} of an extent of {extent:g}")
    return out
