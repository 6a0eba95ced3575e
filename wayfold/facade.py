"""Whole runs from files: accessibility, OD matrix, flow, topology, and projects of many rows."""

from __future__ import annotations

import hashlib
import json
import os
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators import access, flow, impedance, pathjoin, routes, topology, trips, turnflow
from wayfold.params import Settings
from wayfold.plans.staging import cached, exists, publish, stage, stamp_of
from wayfold.sources import readers, writers


@dataclass
class Network:
    edges: DataFrame
    nodes: DataFrame
    arcs: DataFrame


@dataclass
class Session:
    """Layers of one parameter row, read and snapped on first use.

    With ``cache``, a shared folder, tables stand there under a hash of the parameters and the files that they
    are made from, and sessions to come take them from there.
    """

    spark: SparkSession
    settings: Settings
    cache: str = ""
    _layers: dict = field(default_factory=dict)

    def _path(self, name: str) -> str:
        return os.path.join(self.settings.data_folder, name)

    def _table(self, name: str, files: list[str], parts: list, build) -> DataFrame:
        if not self.cache:
            return stage(build(), name)
        key = json.dumps([name, [(f, stamp_of(self.spark, f)) for f in map(self._path, files)], [str(p) for p in parts]])
        return cached(self.spark, self.cache, name, key, build)

    @property
    def _network_parts(self) -> list:
        s = self.settings
        return [s.network_weight_column, s.network_precision]

    @property
    def network(self) -> Network:
        if "network" not in self._layers:
            s = self.settings
            wanted = {} if s.network_weight_column == "Geometric" else {s.network_weight_column: "double"}

            def build() -> tuple[DataFrame, DataFrame]:
                layer = readers.network_layer(readers.read_layer(self.spark, self._path(s.network_file), wanted))
                edges, nodes = topology.build(layer, s.network_precision)
                return topology.cost(edges, s.network_weight_column) if wanted else edges.withColumn("weight", F.col("length")), nodes

            edges = self._table("network-edges", [s.network_file], self._network_parts, lambda: build()[0])
            nodes = self._table("network-nodes", [s.network_file], self._network_parts, lambda: build()[1])
            arcs = topology.arcs(edges)
            if s.elevation:
                arcs = impedance.with_elevation(arcs, nodes, s.elevation_penalty)
            self._layers["network"] = Network(edges, nodes, arcs)
            if s.obstacles_file:
                self._layers["network"].arcs = self._obstructed(arcs)
        return self._layers["network"]

    def _obstructed(self, arcs: DataFrame) -> DataFrame:
        s, rows = self.settings, self.obstacles
        if s.obstacle_snap_to == "edge":
            return impedance.with_obstacles(arcs, rows)
        nodes = topology.snapped_node(rows).join(rows.select("pt_id", "penalty"), "pt_id")
        return impedance.with_node_obstacles(arcs, nodes)

    def points(self, name: str, weight_column: str = "", uid: str = "", more: dict[str, str] | None = None) -> DataFrame:
        """A point layer on the network: pt_id, uid, weight, x, y, coords, edge_id, u, v, w_start, w_end, frac, snap_dist."""
        wanted = {weight_column: "double"} if weight_column and weight_column != "Count" else {}
        wanted |= {uid: "string"} if uid else {}
        key = (name, weight_column, uid, *(more or {}))
        if key not in self._layers:
            s = self.settings
            readers.same_crs(readers.crs_of(self.spark, self._path(s.network_file)), readers.crs_of(self.spark, self._path(name)), name)

            def build() -> DataFrame:
                layer = readers.point_layer(readers.read_layer(self.spark, self._path(name), wanted | (more or {})), uid)
                layer = topology.point_weight(layer, weight_column if weight_column in wanted else "")
                layer = stage(layer.select("pt_id", "uid", "weight", "x", "y", "coords", "kind", *(more or {})), "layer")
                edges = self.network.edges
                snapped = topology.snap(layer, topology.segments(edges))
                return layer.join(snapped, "pt_id").join(edges.select("edge_id", "u", "v"), "edge_id")

            self._layers[key] = self._table("points", [s.network_file, name], [*self._network_parts, *key], build)
        return self._layers[key]

    @property
    def origins(self) -> DataFrame:
        s = self.settings
        out = self.points(s.origins_file, s.origin_weight_column, s.origin_uid_column)
        return impedance.crossed_between(out, self.obstacles, True) if s.obstacles_file and s.obstacle_snap_to == "edge" else out

    @property
    def destinations(self) -> DataFrame:
        s = self.settings
        out = self.points(s.destinations_file, s.destination_weight_column, s.destination_id_column)
        return impedance.crossed_between(out, self.obstacles, False) if s.obstacles_file and s.obstacle_snap_to == "edge" else out

    @property
    def observers(self) -> DataFrame:
        return self.points(self.settings.observers_file)

    @property
    def obstacles(self) -> DataFrame:
        s = self.settings
        more = {s.obstacle_penalty_column: "double"} | ({s.obstacle_direction_column: "string"} if s.obstacle_direction_column else {})
        rows = self.points(s.obstacles_file, more=more)
        if rows.where(F.col(s.obstacle_penalty_column).isNull() | (F.col(s.obstacle_penalty_column) < 0)).limit(1).count():
            raise readers.LayerError("penalties of obstacles are numbers from 0 on")
        direction = F.coalesce(F.col(s.obstacle_direction_column), F.lit("both")) if s.obstacle_direction_column else F.lit("both")
        return rows.withColumns({"penalty": F.col(s.obstacle_penalty_column), "direction": direction})

    @property
    def pairs(self) -> DataFrame:
        if "pairs" not in self._layers:
            s, n = self.settings, self.network
            if s.turns:
                moves = stage(impedance.transitions(n.arcs, n.nodes, "geometry", s.turn_threshold, s.turn_penalty), "moves")
                found = pathjoin.turn_od(self.origins, self.destinations, n.arcs, moves, s.search_radius)
            else:
                found = pathjoin.od(self.origins, self.destinations, n.arcs, s.search_radius, s.profile == "corrected")
            self._layers["pairs"] = stage(found, "pairs")
        return self._layers["pairs"]

    @property
    def evaluation(self) -> dict[str, tuple[bool, str]]:
        """Whether origins and destinations lie on the network; see ``readers.evaluate``."""
        return readers.evaluate(self.network.nodes, {"origins": self.origins, "destinations": self.destinations})


_CALCULATED = {"reach": "calculate_reach", "gravity_logistic": "calculate_logistic_gravity", "gravity_exponential": "calculate_exponential_gravity", "knn_access": "calculate_knn_access"}


def access_columns(got: DataFrame, session: Session, s: Settings) -> DataFrame:
    """The metrics that are wanted, beside each origin's id, uid and place."""
    wanted = [m for m, flag in _CALCULATED.items() if getattr(s, flag)]
    return session.origins.select("pt_id", "uid", "coords", "kind").join(got.select("pt_id", *wanted), "pt_id")


def run_accessibility(session: Session) -> DataFrame:
    """uid and the metrics of every origin."""
    s = session.settings
    return access_columns(access.accessibility(session.pairs, session.origins, session.destinations, s), session, s)


def run_odm(session: Session) -> DataFrame:
    """origin, destination, distance, duration, by uid; both layers need a uid column."""
    s = session.settings
    if not (s.origin_uid_column and s.destination_id_column):
        raise ValueError("an OD matrix needs uid columns of origins and destinations")
    o = session.origins.select(F.col("pt_id").alias("o"), F.col("uid").alias("origin"))
    d = session.destinations.select(F.col("pt_id").alias("dest"), F.col("uid").alias("destination"))
    rows = session.pairs.join(o, "o").join(d, "dest").withColumnRenamed("d", "distance")
    return rows.select("origin", "destination", "distance", (F.col("distance") / (s.walking_speed * 1000 / 60)).alias("duration"))


def run_flow(session: Session) -> dict[str, DataFrame]:
    """Tables of a flow run: edge_flow, node_flow, and routes, observers, obstacles and used origins where asked for.

    Flow goes over the network only: two points on one edge are as far apart as over its ends.
    """
    s, n = session.settings, session.network
    arcs = stage(topology.lightest_arcs(n.arcs), "flow-arcs")
    o, d = session.origins, session.destinations
    out: dict[str, DataFrame] = {}
    by_states = s.turns and s.flow_engine == "aggregate_flow"
    if by_states:
        forward, backward = turnflow.gradients(o, d, arcs, turnflow.transitions(arcs, n.nodes, s, False), flow.tree_radius(s))
        pairs = stage(turnflow.shortest(o, d, arcs, forward, s.search_radius), "pairs")
    else:
        pairs = stage(pathjoin.od(o, d, arcs, s.search_radius, same_edge=False), "pairs")
    cap = access.gravity_cap(pairs, o, d, s) if s.flow_decay_method == "gravity_cap" else 1.0
    sent = stage(trips.trips(pairs, o, d, s, cap), "trips")
    if by_states:
        via = stage(turnflow.via_states(sent, o, d, arcs, forward, backward, s), "via")
        by_edge, by_node = turnflow.load(via, o, d, arcs, forward, backward)
    elif s.flow_engine == "aggregate_flow":
        forward, backward = flow.trees(o, d, arcs, flow.tree_radius(s))
        via = stage(flow.via_arcs(sent, o, d, arcs, forward, backward, s), "via")
        by_edge, by_node = flow.load(via, o, d, forward, backward)
    else:
        moves = turnflow.transitions(arcs, n.nodes, s, True) if s.turns else None
        found = routes.alternatives(sent.drop("trips"), o, d, arcs, s, moves)
        found = stage(routes.probabilities(found, sent, s), "routes")
        by_edge, by_node = routes.load_routes(found)
        if s.flow_routes:
            out["routes"] = writers.named_routes(found, n.edges, o, d)
    flows = stage(flow.undirected(by_edge, n.edges), "edge-flow")
    shape = ["coords", "kind"]
    out["edge_flow"] = flows.join(n.edges.select("edge_id", *[c for c in shape if c in n.edges.columns]), "edge_id")
    if not s.flow_directional:
        out["edge_flow"] = out["edge_flow"].drop("flow_ab", "flow_ba")
    if s.flow_node_flow:
        at = [c for c in ("x", "y", "z") if c in n.nodes.columns]
        out["node_flow"] = n.nodes.select("node_id", *at).join(by_node, "node_id", "left").fillna(0.0, ["flow"])
    if s.observers_file:
        out["observers"] = flow.observed(flows, session.observers, n.edges, s.observer_snap_to).join(session.observers.select("pt_id", *shape), "pt_id")
    if s.obstacles_file:
        out["obstacles"] = flow.obstacle_usage(flows, session.obstacles).join(session.obstacles.select("pt_id", *shape), "pt_id")
    if s.flow_track_origins:
        out["used_origins"] = flow.used_origins(sent, session.origins)
    return out


def topology_tables(session: Session, gradients: list[int] | None = None) -> dict[str, DataFrame]:
    """The topology as layers: nodes (with a column of distances for each destination asked for), links, network and connectors."""
    n, s = session.network, session.settings
    nodes = n.nodes
    if gradients:
        wanted = session.destinations.where(F.col("pt_id").isin(gradients))
        near = pathjoin.labels(wanted, pathjoin.reversed_arcs(n.arcs), s.search_radius)
        nodes = nodes.join(writers.gradient_columns(near, gradients), "node_id", "left")
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.lit(None).cast("double").alias("z"))
    ends = n.edges.select("edge_id", "u", "v", "weight")
    for name, x, y in (("u", "x1", "y1"), ("v", "x2", "y2")):
        ends = ends.join(n.nodes.select(F.col("node_id").alias(name), F.col("x").alias(x), F.col("y").alias(y)), name)
    line = F.lit("LineString").alias("kind")
    stops = [session.origins.select(F.lit("origin").alias("layer"), "*"), session.destinations.select(F.lit("destination").alias("layer"), "*")]
    on = reduce(DataFrame.unionByName, [p.select("layer", "pt_id", "x", "y", "edge_id", "frac") for p in stops]).join(n.edges.select("edge_id", F.col("coords").alias("along")), "edge_id")
    return {
        "nodes": nodes.withColumns({"coords": F.array(point("x", "y")), "kind": F.lit("Point")}),
        "links": ends.select("edge_id", "u", "v", "weight", F.array(point("x1", "y1"), point("x2", "y2")).alias("coords"), line),
        "network": n.edges,
        "connectors": on.select("layer", "pt_id", "edge_id", F.array(point("x", "y"), writers.point_along("along", "frac")).alias("coords"), line),
    }


def save_topology(session: Session, folder: str) -> None:
    """Edges and nodes as parquet; ``load_topology`` reads them."""
    session.network.edges.write.mode("overwrite").parquet(f"{folder}/edges")
    session.network.nodes.write.mode("overwrite").parquet(f"{folder}/nodes")


def load_topology(spark: SparkSession, s: Settings, folder: str) -> Session:
    """A session over a saved topology instead of the network's file; impedance is that of the settings."""
    session = Session(spark, s)
    edges, nodes = spark.read.parquet(f"{folder}/edges"), spark.read.parquet(f"{folder}/nodes")
    arcs = topology.arcs(edges)
    session._layers["network"] = Network(edges, nodes, impedance.with_elevation(arcs, nodes, s.elevation_penalty) if s.elevation else arcs)
    if s.obstacles_file:
        session._layers["network"].arcs = session._obstructed(session._layers["network"].arcs)
    return session


# ---------------------------------------------------------------- projects

_INPUTS = ("network_file", "origins_file", "destinations_file", "observers_file", "obstacles_file")


def fingerprint(spark: SparkSession, s: Settings, analysis: str = "accessibility") -> str:
    """Of the parameters, the analysis, and what the input files are now."""
    files = {f: stamp_of(spark, os.path.join(s.data_folder, getattr(s, f))) for f in _INPUTS if getattr(s, f)}
    return hashlib.sha256(json.dumps([asdict(s), analysis, files], sort_keys=True).encode()).hexdigest()[:16]


def _base(s: Settings) -> str:
    return s.output_folder or f"{s.data_folder.rstrip('/')}/Results"


def plan_batch(rows: list[Settings]) -> list[tuple[Settings, str]]:
    """Each row with ``run``, or why it won't.

    Rows without one of the three files are skipped.  A row conflicts if an earlier one has its output (also
    by being the same row), or if it reads what an earlier one writes.
    """
    taken, out = set(), []
    for s in rows:
        target = (_base(s), s.name)
        missing = [f for f in _INPUTS[:3] if not getattr(s, f)]
        reads = {os.path.normpath(os.path.join(s.data_folder, getattr(s, f))) for f in _INPUTS if getattr(s, f)}
        written = {os.path.normpath(folder) for folder, _ in taken}
        if missing:
            verdict = "skipped: no " + ", ".join(missing)
        elif target in taken:
            verdict = "conflict: output of an earlier row"
        elif any(r == w or r.startswith(w + os.sep) for r in reads for w in written):
            verdict = "conflict: reads what an earlier row writes"
        else:
            verdict = "run"
        taken.add(target)
        out.append((s, verdict))
    return out


@dataclass
class BatchReport:
    """What became of each row (its path, or why there is none), which were found done, and the composites' paths."""

    analysis: str
    workers: int
    rows: dict[str, str] = field(default_factory=dict)
    resumed: list[str] = field(default_factory=list)
    composites: list[str] = field(default_factory=list)


def run_batch(spark: SparkSession, rows: list[Settings], workers: int = 4, analysis: str = "accessibility", cache: str = "") -> BatchReport:
    """Runs the analysis (accessibility or flow) for every row, rows side by side, and writes each.

    Accessibility rows over the same files share one path join at their largest radius.  Results are
    written aside and put in their place in the order of the rows; the first error stops that, and is raised when the
    rows before it are in place.  A journal beside the results names, for each fingerprint, where its result
    stands: a row that is found there is not run again, whatever the time in its folder's name.
    """
    if analysis not in ("accessibility", "flow"):
        raise ValueError("analysis is accessibility or flow")
    report = BatchReport(analysis, workers)
    planned = plan_batch(rows)
    report.rows |= {s.name: verdict for s, verdict in planned if verdict != "run"}
    groups: dict[tuple, list[Settings]] = {}
    for s, verdict in planned:
        if verdict == "run":
            same = replace(s, name="", search_radius=1.0, gravity_beta=0.0, gravity_plateau=0.0, gravity_logistic_midpoint=1.0, knn_weights=(1.0,), knn_decay="none", output_folder="", result_prefix="") if analysis == "accessibility" else s
            groups.setdefault(tuple(map(str, asdict(same).values())), []).append(s)

    def journal(s: Settings) -> str:
        return f"{_base(s)}/_journal/{fingerprint(spark, s, analysis)}"

    def done(s: Settings) -> str | None:
        path = journal(s)
        known = spark.read.text(path).first()["value"] if exists(spark, f"{path}/_SUCCESS") else None
        return known if known and all(exists(spark, f"{p}/_SUCCESS") for p in known.split("|")) else None

    def compute(own: list[Settings]) -> dict[str, list[tuple[str, str]] | str]:
        made: dict[str, list[tuple[str, str]] | str] = {}
        shared = Session(spark, replace(own[0], search_radius=max(s.search_radius for s in own)), cache)
        for s in own:
            if found := done(s):
                made[s.name] = found
                continue
            target = f"{writers.output_folder(s)}/{s.name}"
            half = f"{_base(s)}/_unfinished/{s.name}-{fingerprint(spark, s, analysis)}"
            moves = []
            for name, table, kind in _tables(shared, s, analysis):
                ending = f"_{name}" if name else ""
                for path in writers.write(table, f"{half}{ending}", replace(s, output_feather=True), kind):
                    moves.append((path, target + path[len(half) :]))
            made[s.name] = moves
        return made

    with ThreadPoolExecutor(workers) as pool:
        running = {id(own): pool.submit(compute, own) for own in groups.values()}
        of_row = {s.name: running[id(own)] for own in groups.values() for s in own}
        for s, verdict in planned:
            if verdict != "run":
                continue
            made = of_row[s.name].result()[s.name]
            if isinstance(made, str):
                report.resumed.append(s.name)
                report.rows[s.name] = made.split("|")[0]
                continue
            for source, target in made:
                publish(spark, source, target)
            spark.createDataFrame([("|".join(t for _, t in made),)], "value string").coalesce(1).write.mode("overwrite").text(journal(s))
            report.rows[s.name] = made[0][1]
    report.composites = _composites(spark, [s for s, v in planned if v == "run" and s.composite], report.rows, analysis)
    return report


def _tables(shared: Session, s: Settings, analysis: str):
    """(name, table, kind of geometry) of one row's results; the first is the main one."""
    if analysis == "accessibility":
        got = access.accessibility(shared.pairs, shared.origins, shared.destinations, s)
        yield "", writers.access_named(access_columns(got, shared, s), s), "Point"
        return
    found = run_flow(shared)
    main = found.pop("edge_flow")
    yield "", writers.prefixed(main, s.result_prefix, ["edge_id"]), "LineString"
    for name, ending, kind in writers.FLOW_TABLES:
        if name in found:
            yield ending, writers.prefixed(found[name], s.result_prefix, writers.KEYS), kind


#: (metric, main column, id column) of what a composite can be made of.
_PER_EDGE, _PER_NODE = ("edge_flow",), ("node_flow",)


def _composites(spark: SparkSession, rows: list[Settings], paths: dict[str, str], analysis: str) -> list[str]:
    """One table for each layer that results belong to: a column for each row and their sum; its paths.

    Rows whose results lack the metric are left out.  Where no format is wanted, it is written as CSV.
    """
    groups: dict[str, list[tuple[Settings, DataFrame, str, str]]] = {}
    for s in rows:
        m = s.composite_metric
        if (m in _PER_EDGE + _PER_NODE) != (analysis == "flow"):
            continue
        path = paths[s.name] if m not in _PER_NODE else paths[s.name].replace(".parquet", "_network_nodes.parquet")
        key, column = ("edge_id", "flow") if m in _PER_EDGE else ("node_id", "flow") if m in _PER_NODE else ("pt_id", writers.access_name(m, s))
        if not exists(spark, f"{path}/_SUCCESS"):
            continue
        layer = s.network_file if m in _PER_EDGE else s.origins_file if m not in _PER_NODE else ""
        target = os.path.normpath(os.path.join(s.data_folder, layer)) if layer else "nodes"
        groups.setdefault(target, []).append((s, spark.read.parquet(path), key, s.result_prefix + column))
    out: list[str] = []
    for target, own in groups.items():
        first, table, key, _ = own[0]
        shape = [c for c in ("coords", "kind") if c in table.columns]
        whole = table.select(key, *shape)
        names = []
        for s, table, key, column in own:
            name = f"{s.composite_prefix}{s.composite_metric}_{s.name}"
            if name in names:
                raise ValueError("rows of a composite need names of their own")
            names.append(name)
            whole = whole.join(table.select(key, F.col(column).alias(name)), key)
        whole = whole.withColumn(first.composite_column, reduce(lambda a, b: a + b, map(F.col, names)))
        ending = f"_{os.path.splitext(os.path.basename(target))[0]}" if len(groups) > 1 else ""
        formats = first if first.output_geojson or first.output_feather or first.output_csv else replace(first, output_csv=True)
        kind = "LineString" if key == "edge_id" else "Point"
        out += writers.write(whole, f"{writers.output_folder(first, 'composite_')}/composite{ending}", formats, kind if shape else None)
    return out
