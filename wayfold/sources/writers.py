"""Writing results: parquet, CSV, GeoJSON, feather and SQLite, in folders that may carry the time."""

from __future__ import annotations

import datetime
import sqlite3
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.params import Settings


def output_folder(s: Settings, prefix: str = "", now: datetime.datetime | None = None) -> str:
    """The settings' folder, or Results beside the data; with a folder for the time of the run in it if wanted."""
    folder = s.output_folder or f"{s.data_folder.rstrip('/')}/Results"
    stamp = (now or datetime.datetime.now()).strftime("%Y-%m-%d_%H%M")
    return f"{folder}/{prefix}{stamp}" if s.output_wStamp else folder


def _geometry(coords: str, kind: str, digits: int = 6) -> Column:
    pair = F.transform(coords, lambda p: F.array(F.round(p["x"], digits), F.round(p["y"], digits)))
    text = F.to_json(F.element_at(pair, 1)) if kind == "Point" else F.to_json(pair)
    return F.concat(F.lit(f'{{"type":"{kind}","coordinates":'), text, F.lit("}"))


def _features(df: DataFrame, kind: str) -> DataFrame:
    props = [c for c in df.columns if c not in ("coords", "kind")]
    line = F.concat(F.lit('{"type":"Feature","geometry":'), _geometry("coords", kind), F.lit(',"properties":'), F.to_json(F.struct(*props), {"ignoreNullFields": "false"}), F.lit("}"))
    return df.select(line.alias("value"))


def write_geojson(df: DataFrame, path: str, kind: str = "LineString") -> None:
    """A folder of newline-delimited features, six digits; each task writes its own part.  ``write_collection`` makes one document."""
    _features(df, kind).write.mode("overwrite").text(path)


def write_collection(df: DataFrame, path: str, kind: str = "LineString") -> None:
    """One GeoJSON document (a FeatureCollection), streamed through the driver feature by feature."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    lines = (r["value"] for r in _features(df, kind).toLocalIterator())
    with open(path, "w") as f:
        f.write('{"type":"FeatureCollection","features":[')
        for k, line in enumerate(lines):
            f.write(("," if k else "") + "\n" + line)
        f.write("\n]}\n")


def write(df: DataFrame, path: str, s: Settings, kind: str | None = None) -> list[str]:
    """Every wanted format; parquet stands in for feather where results are distributed.  Returns the paths."""
    out = []
    if s.output_feather:
        df.write.mode("overwrite").parquet(out.append(f"{path}.parquet") or out[-1])
    if s.output_csv:
        flat = df.drop("coords", "kind")
        flat.write.mode("overwrite").option("header", True).option("sep", s.csv_delimiter).csv(out.append(f"{path}.csv") or out[-1])
    if s.output_geojson and kind and "coords" in df.columns:
        write_geojson(df, out.append(f"{path}.geojson") or out[-1], kind)
    return out


def write_feather(df: DataFrame, path: str, chunk: int = 100_000) -> None:
    """One feather file, streamed through the driver in chunks of rows."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(df.schema)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with pa.OSFile(path, "wb") as f, pa.ipc.new_file(f, schema) as out:
        rows = []
        for row in df.toLocalIterator():
            rows.append(row.asDict(recursive=True))
            if len(rows) >= chunk:
                out.write_batch(pa.RecordBatch.from_pylist(rows, schema=schema))
                rows = []
        out.write_batch(pa.RecordBatch.from_pylist(rows, schema=schema))


def write_sqlite(df: DataFrame, path: str, table: str, chunk: int = 50_000) -> None:
    """One SQLite file, streamed through the driver partition by partition."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with sqlite3.connect(path) as db:
        columns = ", ".join(f'"{c}"' for c in df.columns)
        db.execute(f'DROP TABLE IF EXISTS "{table}"')
        db.execute(f'CREATE TABLE "{table}" ({columns})')
        rows, marks = [], ", ".join("?" * len(df.columns))
        for row in df.toLocalIterator():
            rows.append(tuple(row))
            if len(rows) >= chunk:
                db.executemany(f'INSERT INTO "{table}" VALUES ({marks})', rows)
                rows = []
        db.executemany(f'INSERT INTO "{table}" VALUES ({marks})', rows)


def prefixed(df: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
    """``df`` with the prefix before every column but the keys and the geometry."""
    return df.select(*(F.col(c) if c in [*keys, "coords", "kind"] else F.col(c).alias(prefix + c) for c in df.columns))


#: Ids, which keep their names.
KEYS = ["pt_id", "uid", "edge_id", "node_id", "o", "dest", "alt", "origin", "destination", "x", "y", "z"]

#: Tables of a flow run besides the edges: what they are called in files, and their geometry.
FLOW_TABLES = [
    ("node_flow", "network_nodes", None), ("observers", "observer_points", "Point"), ("obstacles", "obstacle_points_usage", "Point"),
    ("used_origins", "destinations_used_origins", None), ("routes", "routes", "LineString"),
]


def access_name(metric: str, s: Settings) -> str:
    """A metric's column in files: that of the nearest destinations tells its decay."""
    return metric if metric != "knn_access" else "knn" if s.knn_decay == "none" else f"knn_{s.knn_decay}"


def access_named(df: DataFrame, s: Settings) -> DataFrame:
    return prefixed(df.withColumnsRenamed({"knn_access": access_name("knn_access", s)}), s.result_prefix, KEYS)


def point_along(coords: str, share: str) -> Column:
    """The point of a line at a share of its length."""
    steps = f"zip_with(slice({coords}, 1, size({coords}) - 1), slice({coords}, 2, size({coords})), (a, b) -> hypot(b.x - a.x, b.y - a.y))"
    upto = f"aggregate({steps}, array(0D), (s, d) -> concat(s, array(element_at(s, -1) + d)))"
    # The last piece that begins no further along than the share.
    found = f"""aggregate(sequence(1, size({coords}) - 1), named_struct('x', {coords}[0].x, 'y', {coords}[0].y, 'z', cast(null as double)), (s, i) ->
      if(({upto})[i - 1] <= {share} * element_at({upto}, -1), named_struct(
        'x', {coords}[i - 1].x + ({coords}[i].x - {coords}[i - 1].x) * coalesce(least(1D, ({share} * element_at({upto}, -1) - ({upto})[i - 1]) / nullif(({upto})[i] - ({upto})[i - 1], 0D)), 0D),
        'y', {coords}[i - 1].y + ({coords}[i].y - {coords}[i - 1].y) * coalesce(least(1D, ({share} * element_at({upto}, -1) - ({upto})[i - 1]) / nullif(({upto})[i] - ({upto})[i - 1], 0D)), 0D),
        'z', cast(null as double)), s))"""
    return F.expr(found)


def named_routes(routes: DataFrame, edges: DataFrame, origins: DataFrame, destinations: DataFrame) -> DataFrame:
    """Routes with the uids of both ends and their line, in the order of origin, destination and rank."""
    lines = route_lines(routes, edges)
    rows = routes.select("o", "dest", "alt", "cost", "share", "volume").join(lines, ["o", "dest", "alt"])
    rows = rows.join(origins.select(F.col("pt_id").alias("o"), F.col("uid").alias("origin")), "o").join(destinations.select(F.col("pt_id").alias("dest"), F.col("uid").alias("destination")), "dest")
    return rows.select("o", "dest", "alt", "origin", "destination", "cost", "share", "volume", "coords", F.lit("LineString").alias("kind")).orderBy("o", "dest", "alt")


def route_lines(routes: DataFrame, edges: DataFrame) -> DataFrame:
    """(o, dest, alt, coords): the points of each route's edges, in the order of travel, turned where travelled backwards."""
    legs = routes.select("o", "dest", "alt", F.posexplode("legs").alias("pos", "leg"))
    lines = legs.join(edges.select("edge_id", "coords"), legs["leg.edge_id"] == edges["edge_id"])
    way = F.when(F.col("leg.dir") == 1, F.reverse("coords")).otherwise(F.col("coords"))
    parts = lines.groupBy("o", "dest", "alt").agg(F.array_sort(F.collect_list(F.struct("pos", way.alias("coords")))).alias("parts"))
    return parts.select("o", "dest", "alt", F.flatten(F.transform("parts", lambda p: p["coords"])).alias("coords"))


def gradient_columns(labelled: DataFrame, sources: list[int]) -> DataFrame:
    """node_id with a column of distances for each named source."""
    wide = labelled.where(F.col("o").isin(sources)).groupBy(F.col("node").alias("node_id")).pivot("o", sources).agg(F.min("d"))
    return wide.select("node_id", *(F.col(f"`{x}`").alias(f"gradient_{x}") for x in sources))
