"""A street network with origins and destinations as a session of steps: layers, network, points, analyses.

Distances go along an edge that both points stand on, as points cut their edge.  Turns follow the folded rule and
cost exactly, over states.  Results are tables and also become columns of their layer.
"""

from __future__ import annotations

import csv
import datetime
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators import access, areas, impedance, pathjoin, routes, topology
from wayfold.plans.staging import stage
from wayfold.sources import readers, writers


@dataclass
class Zonal:
    spark: SparkSession
    layers: dict[str, DataFrame] = field(default_factory=dict)
    turn_amount: float = 0.0
    turn_threshold: float = 0.0
    edges: DataFrame | None = None
    nodes: DataFrame | None = None
    points: dict[str, DataFrame] = field(default_factory=dict)
    source: dict[str, str] = field(default_factory=dict)
    arcs: DataFrame | None = None

    # ---------------------------------------------------------------- building

    def load_layer(self, name: str, source: str | DataFrame, properties: dict[str, str] | None = None) -> None:
        """A file or a table (with kind and coords) as a layer; features are numbered by ``id`` from 0."""
        layer = readers.read_layer(self.spark, source, properties) if isinstance(source, str) else readers.numbered(source)
        self.layers[name] = stage(layer.withColumnRenamed("row", "id"), "layer")

    def create_street_network(self, source_layer: str, weight_attribute: str | None = None, node_snapping_tolerance: float = 0.0, redundant_edge_treatment: str = "keep") -> None:
        if node_snapping_tolerance < 0:
            raise ValueError("a tolerance is zero or positive")
        if redundant_edge_treatment not in ("keep", "discard", "split"):
            raise ValueError("redundant edges are kept, discarded or split")
        lines = readers.cleaned_lines(self.layers[source_layer]).withColumnRenamed("id", "edge_id")
        measured = topology.endpoints(lines)
        weighted = topology.floor_cost(measured, weight_attribute) if weight_attribute else measured.withColumn("weight", F.col("length"))
        weighted = stage(weighted, "street-lines")
        if node_snapping_tolerance:
            edges, nodes = areas.snapped_network(weighted, node_snapping_tolerance)
        else:
            built, nodes = topology.build(lines)
            edges = built.drop("length").join(weighted.select("edge_id", "weight", "length"), "edge_id").withColumns({"snapped": F.lit(False), "moved": F.lit(0.0)})
        edges = edges.select("edge_id", "coords", "u", "v", "weight", "length", "snapped", "moved", F.col("edge_id").alias("street"))
        edges, nodes = stage(edges, "streets"), stage(nodes, "street-nodes")
        if redundant_edge_treatment == "discard":
            edges = topology.lightest_edges(edges)
        elif redundant_edge_treatment == "split":
            edges, nodes = _split(edges, nodes)
        self.edges, self.nodes = stage(edges, "streets"), stage(nodes, "street-nodes")
        self.source["network"] = source_layer
        self.clear_nodes()

    def set_turn_parameters(self, turn_penalty_amount: float, turn_threshold_degree: float) -> None:
        self.turn_amount, self.turn_threshold = float(turn_penalty_amount), float(turn_threshold_degree)

    def insert_node(self, layer_name: str, label: str, weight_attribute: str | None = None) -> None:
        """A point layer as origins or destinations, on the nearest edge."""
        if label not in ("origin", "destination"):
            raise ValueError("points are an origin or a destination")
        if self.edges is None:
            raise ValueError("create the street network first")
        layer = readers.point_layer(self.layers[layer_name].withColumnRenamed("id", "row"))
        layer = topology.point_weight(layer, weight_attribute or "")
        snapped = topology.snap(layer, topology.segments(self.edges))
        out = layer.select("pt_id", "weight", "x", "y").join(snapped, "pt_id").join(self.edges.select("edge_id", "u", "v"), "edge_id")
        self.points[label], self.source[label] = stage(out, label), layer_name

    def create_graph(self) -> None:
        self.arcs = stage(topology.lightest_arcs(topology.arcs(self.edges)), "street-arcs")

    def clear_nodes(self) -> None:
        self.points, self.arcs = {}, None

    def describe(self) -> dict[str, int]:
        """How many features each layer has, and edges, nodes and points the network."""
        out = {f"layer {n}": df.count() for n, df in self.layers.items()}
        if self.edges is not None:
            out |= {"edges": self.edges.count(), "nodes": self.nodes.count()}
        return out | {label: df.count() for label, df in self.points.items()}

    # ---------------------------------------------------------------- analyses

    def _ready(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        if self.arcs is None or {"origin", "destination"} - set(self.points):
            raise ValueError("insert origins and destinations and create the graph first")
        return self.points["origin"], self.points["destination"], self.arcs

    def pairs(self, radius: float, turns: bool = False, closest_facility: bool = False) -> DataFrame:
        """(o, dest, d) within the radius; with closest facility each destination belongs to its nearest origin alone."""
        o, d, arcs = self._ready()
        if turns:
            moves = stage(impedance.transitions(arcs, self.nodes, "folded", self.turn_threshold, self.turn_amount), "moves")
            found = pathjoin.turn_od(o, d, arcs, moves, radius)
        else:
            found = pathjoin.od(o, d, arcs, radius)
        found = stage(found, "pairs")
        return access.closest_facility(found).select("o", "dest", "d") if closest_facility else found

    def scope(self, radius: float, detour: float = 1.0) -> tuple[DataFrame, DataFrame]:
        """(o, dest, d) within the radius, and (o, node, d) within radius times detour but for nodes where only one edge ends."""
        o, _, arcs = self._ready()
        reached = pathjoin.labels(o, arcs, radius * detour)
        through = topology.degrees(self.edges).where("degree > 1").select(F.col("node_id").alias("node"))
        return self.pairs(radius), reached.join(through, "node", "left_semi").select("o", "node", "d")

    def _save(self, label: str, table: DataFrame, key: str, names: dict[str, str | None]) -> None:
        """Columns of a result as columns of the layer that its points come from; what the layer had by that name goes."""
        wanted = {c: n for c, n in names.items() if n}
        if not wanted:
            return
        layer = self.layers[self.source[label]].drop(*wanted.values())
        own = table.select(F.col(key).alias("id"), *(F.col(c).alias(n) for c, n in wanted.items()))
        sums = [n for c, n in wanted.items() if c not in ("o", "d")]
        self.layers[self.source[label]] = stage(layer.join(own, "id", "left").fillna(0, sums), "layer")

    def accessibility(
        self, search_radius: float, alpha: float = 1.0, beta: float = 0.003, knn_weights: tuple[float, ...] | None = None, knn_plateau: float = 0.0,
        closest_facility: bool = False, turn_penalty: bool = False, save_reach_as: str | None = None, save_gravity_as: str | None = None,
        save_knn_access_as: str | None = None, save_closest_facility_as: str | None = None, save_closest_facility_distance_as: str | None = None,
    ) -> DataFrame:
        """o with reach, gravity and access to the nearest destinations, 0 where none is in reach."""
        o, d, _ = self._ready()
        pairs = self.pairs(search_radius, turn_penalty, closest_facility)
        out = o.select(F.col("pt_id").alias("o")).join(access.power_gravity(pairs, d, alpha, beta), "o", "left")
        if knn_weights:
            out = out.join(access.unweighted_knn(pairs, o, tuple(knn_weights), beta, knn_plateau), "o", "left")
        out = stage(out.fillna(0.0), "zonal-access")
        names = {"reach": save_reach_as, "gravity": save_gravity_as} | ({"knn_access": save_knn_access_as} if knn_weights else {})
        self._save("origin", out, "o", names)
        if closest_facility:
            self._save("destination", pairs, "dest", {"o": save_closest_facility_as, "d": save_closest_facility_distance_as})
        return out

    def service_area(self, search_radius: float, origin_ids: list[int] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(o, dest, d); (o, edge_id, share, coords) of the edges in reach; (o, ring), the hull of the nodes and destinations reached."""
        o, d, arcs = self._ready()
        chosen = o if origin_ids is None else o.where(F.col("pt_id").isin(origin_ids))
        reached = stage(pathjoin.labels(chosen, arcs, search_radius), "zonal-reached")
        found = stage(pathjoin.od(chosen, d, arcs, search_radius), "zonal-pairs")
        parts = routes.service_area(reached, arcs, search_radius).join(self.edges.select("edge_id", "coords"), "edge_id")
        xy = reached.join(self.nodes.select(F.col("node_id").alias("node"), "x", "y"), "node").select("o", "x", "y")
        xy = xy.union(found.join(d.select(F.col("pt_id").alias("dest"), "x", "y"), "dest").select("o", "x", "y"))
        return found, parts, areas.hulls(xy, "o")

    def alternative_paths(self, search_radius: float, detour_ratio: float = 1.0, origin_ids: list[int] | None = None) -> DataFrame:
        """(o, dest, cost, edges, lines) of all simple paths, by falling nearness; lines has the coordinates of each edge."""
        o, d, arcs = self._ready()
        chosen = o if origin_ids is None else o.where(F.col("pt_id").isin(origin_ids))
        pairs = stage(pathjoin.od(chosen, d, arcs, search_radius), "zonal-pairs")
        paths = routes.all_paths(pairs, chosen, d, arcs, detour_ratio, search_radius).withColumn("path", F.monotonically_increasing_id())
        legs = paths.select("path", F.posexplode("edges").alias("at", "edge_id")).join(self.edges.select("edge_id", "coords"), "edge_id")
        lines = legs.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("at", "coords"))).alias("l"))
        out = stage(paths, "zonal-paths").join(lines.select("path", F.transform("l", lambda x: x["coords"]).alias("lines")), "path")
        return out.select("o", "dest", "cost", "edges", "lines").orderBy("o", "cost", "dest")

    def betweenness(
        self, search_radius: float, detour_ratio: float = 1.0, decay: bool = False, decay_method: str = "exponent", beta: float = 0.003,
        closest_destination: bool = True, elastic_weight: bool = False, knn_weight: tuple[float, ...] | None = None, knn_plateau: float = 0.0,
        turn_penalty: bool = False, path_detour_penalty: str = "equal", path_exposure_attribute: str | None = None, save_betweenness_as: str | None = None,
        save_reach_as: str | None = None, save_gravity_as: str | None = None, save_elastic_weight_as: str | None = None, save_path_exposure_as: str | None = None,
    ) -> tuple[DataFrame, DataFrame]:
        """(edge_id, flow) for every edge, and what is known of each origin.

        Trips of an origin go to its nearest destination or to all by their gravity, evenly (or by the penalty) over all simple
        paths within the detour; elastic weights are the access to the nearest destinations times the weight.
        Origins of weight 0 send nothing.  With turns, destinations are those in reach with turns.
        """
        if decay_method not in ("exponent", "power"):
            raise ValueError("decay is by exponent or power")
        o, d, arcs = self._ready()
        senders = o.where("weight <> 0")
        pairs = self.pairs(search_radius, turn_penalty).join(senders.select(F.col("pt_id").alias("o")), "o", "left_semi")
        pairs = stage(pairs, "zonal-pairs")
        shares = routes.huff(pairs, d, beta, closest_destination)
        weights = senders.select(F.col("pt_id").alias("o"), "weight")
        if elastic_weight:
            weights = access.unweighted_knn(pairs, senders, tuple(knn_weight or (1.0,)), beta, knn_plateau).select("o", F.col("knn_weight").alias("weight"))
        nearest = pairs.groupBy("o").agg(F.min("d").alias("least"))
        paths = routes.all_paths(shares.select("o", "dest", "d"), senders, d, arcs, detour_ratio, search_radius)
        shared = stage(routes.path_shares(paths, shares, nearest, weights, decay_method if decay else None, beta, path_detour_penalty), "zonal-shares")
        flows = stage(self.edges.select("edge_id", "street").join(routes.path_flow(shared), "edge_id", "left").fillna(0.0, ["flow"]), "zonal-flow")
        if save_betweenness_as:
            source = self.source["network"]
            by_street = flows.groupBy(F.col("street").alias("id")).agg(F.max("flow").alias(save_betweenness_as))
            self.layers[source] = stage(self.layers[source].drop(save_betweenness_as).join(by_street, "id", "left").fillna(0.0, [save_betweenness_as]), "layer")
        stats = pairs.groupBy("o").agg(
            F.count("*").cast("double").alias("reach"), F.sum(F.exp(-beta * F.col("d"))).alias("gravity"), F.min("d").alias("closest"), F.max("d").alias("furthest")
        )
        stats = o.select(F.col("pt_id").alias("o")).join(stats, "o", "left").join(weights.withColumnRenamed("weight", "sent"), "o", "left")
        if path_exposure_attribute:
            streets = self.layers[self.source["network"]].select(F.col("id").alias("street"), F.col(path_exposure_attribute).cast("double").alias("attribute"))
            stats = stats.join(routes.exposures(shared, self.edges.join(streets, "street"), "attribute"), "o", "left")
        stats = stage(stats.fillna(0.0), "zonal-origins")
        names = {"reach": save_reach_as, "gravity": save_gravity_as, "sent": save_elastic_weight_as if elastic_weight else None}
        names |= {"expected_exposure": save_path_exposure_as} if path_exposure_attribute else {}
        self._save("origin", stats, "o", names)
        return flows.select("edge_id", "flow"), stats


def _split(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parallel edges but the lightest in two halves, with ids of their own beyond all others; the nodes in their middles."""
    top = edges.agg(F.max("edge_id").alias("m")).first()["m"] or 0
    parts = topology.split_parallel(edges).join(edges.select(F.col("edge_id").alias("part_of"), "coords", "length", "snapped", "moved", "street"), "part_of")
    parts = stage(parts, "street-parts")
    # The second half has an id of its own; the first keeps the edge's.
    number = F.when(F.col("half") == 2, top + 1 + F.col("part_of")).otherwise(F.col("part_of"))
    middle = writers.point_along("coords", "0.5D")
    line = F.when(F.col("half") == 0, F.col("coords")).when(F.col("half") == 1, F.array(F.element_at("coords", 1), middle)).otherwise(F.array(middle, F.element_at("coords", -1)))
    length = F.when(F.col("half") == 0, F.col("length")).otherwise(F.col("length") / 2)
    out = parts.select(number.alias("edge_id"), line.alias("coords"), "u", "v", "weight", length.alias("length"), "snapped", "moved", "street")
    new = parts.where("half = 1").select(F.col("v").alias("node_id"), middle.alias("m")).select("node_id", "m.x", "m.y", F.lit(None).cast("double").alias("z"), F.lit(2).alias("degree"))
    return out, nodes.select("node_id", "x", "y", F.col("z").cast("double").alias("z"), "degree").unionByName(new)


# ---------------------------------------------------------------- workflows

class _Log:
    """What happened when, as rows of a table."""

    def __init__(self):
        self.rows: list[dict[str, str]] = []

    def __call__(self, event: str, pairing: str = "") -> None:
        self.rows.append({"time": datetime.datetime.now().isoformat(timespec="seconds"), "pairing": pairing, "event": event})

    def save(self, path: Path) -> None:
        with open(path, "w", newline="") as f:
            w = csv.DictWriter(f, ["time", "pairing", "event"])
            w.writeheader()
            w.writerows(self.rows)


def _pairings(path: str) -> list[dict[str, str]]:
    return list(csv.DictReader(Path(path).read_text().splitlines()))


def _true(cell: str | None) -> bool:
    return str(cell).strip().lower() in {"true", "t", "1", "yes", "y"}


def _numbers(cell: str | None) -> tuple[float, ...]:
    return tuple(float(x) for x in str(cell or "").strip("[]() ").replace(";", ",").split(",") if x.strip())


def _prepare(z: Zonal, row: dict[str, str], before: dict[str, str] | None, folder: Path, log: _Log, treatment: str) -> None:
    """Layers, network and points of a pairing; what it shares with the one before is kept."""
    name = row["Flow_Name"]
    exposure = row.get("Exposure_Attribute") or ""
    if before is None or before["Network_File"] != row["Network_File"]:
        wanted = {c: "double" for c in {row["Network_Cost"], exposure} - {"Geometric", ""}}
        z.load_layer("streets", str(folder / row["Network_File"]), wanted)
        log("network file loaded", name)
    if before is None or any(before[c] != row[c] for c in ("Network_File", "Network_Cost")):
        z.create_street_network("streets", None if row["Network_Cost"] == "Geometric" else row["Network_Cost"], 1e-5, treatment)
        log("network topology created", name)
    z.clear_nodes()
    z.set_turn_parameters(float(row.get("Turn_Penalty") or 0), float(row.get("Turn_Threshold") or 0))
    for side, label in (("Origin", "origin"), ("Destination", "destination")):
        weight = None if row[f"{side}_Weight"] == "Count" else row[f"{side}_Weight"]
        if row[f"{side}_Name"] not in z.layers:
            z.load_layer(row[f"{side}_Name"], str(folder / row[f"{side}_File"]), {weight: "double"} if weight else {})
        z.insert_node(row[f"{side}_Name"], label, weight)
    z.create_graph()
    log("origins and destinations inserted, graph created", name)


def flow_simulation(spark: SparkSession, data_folder: str, output_folder: str, pairings_file: str = "pairings.csv") -> Zonal:
    """Betweenness of every pairing of a table; writes edges after each one, the last state of all layers, and a log of times."""
    rows, z, log, out = _pairings(str(Path(data_folder) / pairings_file)), Zonal(spark), _Log(), Path(output_folder)
    out.mkdir(parents=True, exist_ok=True)
    before = None
    for row in rows:
        name = row["Flow_Name"]
        _prepare(z, row, before, Path(data_folder), log, "keep")
        elastic, exposure = _true(row["Elastic_Weights"]), row.get("Exposure_Attribute") or None
        z.betweenness(
            float(row["Radius"]), float(row["Detour"]), False if elastic else _true(row["Decay"]), row["Decay_Mode"], float(row["Beta"]), _true(row["Closest_destination"]), elastic,
            _numbers(row["KNN_Weight"]) or None, float(row["Plateau"] or 0), _true(row["Turns"]), "equal", exposure, name, f"reach_{name}", f"gravity_{name}",
            f"elastic_weight_{name}" if elastic else None, f"exposure_{name}" if exposure else None,
        )
        (out / name).mkdir(exist_ok=True)
        _write_layer(z.layers["streets"], str(out / name / "betweenness_record"), "LineString")
        _write_layer(z.layers[row["Origin_Name"]], str(out / name / "origin_record"), "Point")
        log("betweenness estimated", name)
        before = row
    _write_layer(z.layers["streets"], str(out / "betweenness_record"), "LineString")
    log("output saved")
    log.save(out / "time_log.csv")
    return z


def access_simulation(spark: SparkSession, data_folder: str, output_folder: str, pairings_file: str = "pairing.csv") -> DataFrame:
    """Access of the origins of every pairing of a table, the sum over all pairings and that scaled to 0..1; written as the origins' layer."""
    rows, z, log, out = _pairings(str(Path(data_folder) / pairings_file)), Zonal(spark), _Log(), Path(output_folder)
    out.mkdir(parents=True, exist_ok=True)
    before = None
    for row in rows:
        name = row["Flow_Name"]
        _prepare(z, row, before, Path(data_folder), log, "discard")
        z.accessibility(
            float(row["Radius"]), 1.0, float(row["Beta"]), _numbers(row["KNN_Weight"]) or (1.0,), float(row["Plateau"] or 0), False, _true(row["Turns"]),
            f"{name}_reach", f"{name}_gravity", f"{name}_knn_access",
        )
        log("accessibility calculated", name)
        before = row
    layer = z.layers[rows[-1]["Origin_Name"]]
    columns = [c for c in (f"{r['Flow_Name']}_knn_access" for r in rows) if c in layer.columns]
    total = sum((F.col(f"`{c}`") for c in columns[1:]), F.col(f"`{columns[0]}`"))
    layer = stage(access.min_max(layer.withColumn("total_knn_access", total), "total_knn_access").withColumnRenamed("total_knn_access_normalised", "normalized_knn_access"), "layer")
    z.layers[rows[-1]["Origin_Name"]] = layer
    _write_layer(layer, str(out / "origin_record"), "Point")
    log("output saved")
    log.save(out / "time_log.csv")
    return layer


def _write_layer(layer: DataFrame, path: str, kind: str) -> None:
    """As one GeoJSON document, and without the geometry as CSV."""
    plain = layer.drop("properties")
    writers.write_collection(plain, f"{path}.geojson", kind)
    plain.drop("coords", "kind").write.mode("overwrite").option("header", True).csv(f"{path}.csv")
