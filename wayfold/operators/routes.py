"""Enumerated routes: alternatives by penalties, and all simple paths within a detour."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.decay import cost_tolerance, detour_budget, route_penalty
from wayfold.operators import pathjoin
from wayfold.operators.pathjoin import Graph, reversed_arcs, search, seeds, shared_graph
from wayfold.params import Settings
from wayfold.plans.staging import stage

#: Arcs that the origins of one block may reach within their largest budget.
MAX_ARCS = 2_000_000

_ROUTE = "o long, dest long, alt long, cost double, legs array<struct<edge_id:bigint,dir:int,node:bigint>>"


class _Goals:
    """``bound``: what no way to any goal that is still unknown can undercut; infinite while a goal hasn't been reached."""

    def __init__(self, ends: dict[int, list]):
        """``ends``: for each goal, (node position, cost, ...) per end of its edge."""
        self.at: dict[int, list[tuple[int, float]]] = {}
        for dest, own in ends.items():
            for e in own:
                if e[0] is not None:
                    self.at.setdefault(e[0], []).append((dest, e[1]))
        self.best: dict[int, float] = {}
        self.many, self.bound = len(ends), np.inf

    def reached(self, node: int, d: float) -> None:
        for dest, c in self.at[node]:
            if d + c < self.best.get(dest, np.inf):
                self.best[dest] = d + c
        if len(self.best) == self.many:
            self.bound = max(self.best.values())


class Alternatives:
    """Rounds of shortest paths from one origin, each making dearer what the last one used.

    The costs of arcs are working copies shared by all destinations of the origin, so one
    destination's routes steer those of the others.  A route that turns back onto its first or
    last edge, or exceeds its budget by its real cost, is not emitted but made dearer all the
    same.  A path that stays best is emitted again: repetitions carry probability.
    """

    def __init__(self, graph: Graph, rounds: int, factor: float):
        self.graph, self.rounds, self.factor = graph, rounds, factor

    def routes(self, start: list[tuple[int, float, int, int]], goals: list[dict]) -> Iterator[tuple]:
        """``start``: (node position, cost, edge, dir) per end of the origin's edge; yields (dest, round, cost, legs)."""
        g, work = self.graph, {}
        begin = [list(s) for s in start]
        base_begin = [s[1] for s in start]
        ends = {q["dest"]: [[g.position(n), c, e, d] for n, c, e, d in q["ends"]] for q in goals}
        for number in range(self.rounds):
            best, came = self._search(begin, work, max(q["budget"] for q in goals) * self.factor**self.rounds + 1, ends)
            used: list[int] = []
            used_begin: list[int] = []
            used_end: list[list] = []
            for q in goals:
                choice = min(((best[e[0]] + e[1], k) for k, e in enumerate(ends[q["dest"]]) if e[0] in best), default=None)
                if choice is None:
                    continue
                end = ends[q["dest"]][choice[1]]
                node, arcs = end[0], []
                while came[node][0] >= 0:
                    arcs.append(came[node][0])
                    node = came[node][1]
                first = came[node][1]
                arcs.reverse()
                used += arcs
                used_begin.append(first)
                used_end.append(end)
                legs = [(begin[first][2], begin[first][3], g.names[begin[first][0]])]
                legs += [(g.edge[k], g.way[k], g.names[g.dst[k]]) for k in arcs]
                legs.append((end[2], end[3], None))
                if legs[0][0] == legs[1][0] or legs[-1][0] == legs[-2][0]:
                    continue
                cost = base_begin[first] + sum(g.w[k] for k in arcs) + q["ends"][choice[1]][1]
                if cost <= q["budget"] + q["slack"]:
                    yield q["dest"], number, cost, legs
            if not used_begin:
                return
            for k in used:
                work[k] = work.get(k, g.w[k]) * self.factor
            for k in used_begin:
                begin[k][1] *= self.factor
            for end in used_end:
                end[1] *= self.factor

    def _search(self, begin: list[list], work: dict[int, float], limit: float, ends: dict[int, list]):
        """Least working costs by node, and (arc, node before), or (-1, end of the origin's edge) at a seed.

        It ends once every goal's best way is known.
        """
        g = self.graph
        best: dict[int, float] = {}
        came: dict[int, tuple[int, int]] = {}
        heap = []
        for k, (node, cost, _, _) in enumerate(begin):
            if cost < best.get(node, np.inf):
                best[node], came[node] = cost, (-1, k)
                heap.append((cost, node))
        heapq.heapify(heap)
        goals = _Goals(ends)
        while heap:
            d, a = heapq.heappop(heap)
            if d > best[a] or d > limit:
                continue
            if d > goals.bound:
                break
            if a in goals.at:
                goals.reached(a, d)
            for k in range(g.first[a], g.first[a + 1]):
                nd, b = d + work.get(k, g.w[k]), g.dst[k]
                if nd < best.get(b, np.inf):
                    best[b], came[b] = nd, (k, a)
                    heapq.heappush(heap, (nd, b))
        return best, came


class TurnAlternatives:
    """The same rounds over states (arcs being travelled), where a turn between two arcs costs.

    What is made dearer are the arcs and the stretches at both ends; turns keep their cost.  The first
    arc and the last stretch are entered without a turn.
    """

    def __init__(self, graph: Graph, moves: dict[int, list[tuple[int, float]]], rounds: int, factor: float):
        """``moves``: for each arc's position in the graph, the arcs that follow and the cost of the turn."""
        self.graph, self.moves, self.rounds, self.factor = graph, moves, rounds, factor

    def routes(self, start: list[tuple[int, float, int, int]], goals: list[dict]) -> Iterator[tuple]:
        g, work = self.graph, {}
        begin = [list(s) for s in start]
        ends = {q["dest"]: [[g.position(n), c, e, d] for n, c, e, d in q["ends"]] for q in goals}
        limit = max(q["budget"] for q in goals) * self.factor**self.rounds + 1
        for number in range(self.rounds):
            best, came = self._search(begin, work, limit, ends)
            at: dict[int, tuple[float, int]] = {}
            for k, d in best.items():
                head = g.dst[k]
                if head not in at or (d, k) < at[head]:
                    at[head] = (d, k)
            used: list[int] = []
            used_begin: list[int] = []
            used_end: list[list] = []
            for q in goals:
                own = ends[q["dest"]]
                # Over arcs, or straight from one stretch to the other.
                found = [(at[e[0]][0] + e[1], k, at[e[0]][1], None) for k, e in enumerate(own) if e[0] in at]
                found += [(b[1] + e[1], k, -1, i) for k, e in enumerate(own) for i, b in enumerate(begin) if b[0] == e[0]]
                if not found:
                    continue
                _, k, last, first = min(found, key=lambda x: x[:2])
                end, arcs = own[k], []
                while last >= 0:
                    arcs.append(last)
                    last, first = came[last]
                arcs.reverse()
                used += arcs
                used_begin.append(first)
                used_end.append(end)
                legs = [(begin[first][2], begin[first][3], g.names[begin[first][0]])]
                legs += [(g.edge[a], g.way[a], g.names[g.dst[a]]) for a in arcs]
                legs.append((end[2], end[3], None))
                if legs[0][0] == legs[1][0] or legs[-1][0] == legs[-2][0]:
                    continue
                turns = sum(dict(self.moves[a])[b] for a, b in zip(arcs, arcs[1:]))
                cost = start[first][1] + sum(g.w[a] for a in arcs) + turns + q["ends"][k][1]
                if cost <= q["budget"] + q["slack"]:
                    yield q["dest"], number, cost, legs
            if not used_begin:
                return
            for a in used:
                work[a] = work.get(a, g.w[a]) * self.factor
            for i in used_begin:
                begin[i][1] *= self.factor
            for end in used_end:
                end[1] *= self.factor

    def _search(self, begin: list[list], work: dict[int, float], limit: float, ends: dict[int, list]):
        """Least working costs up to the end of each arc, and (arc before or -1, end of the origin's edge).

        It ends once every goal's best way is known.
        """
        g = self.graph
        best: dict[int, float] = {}
        came: dict[int, tuple[int, int | None]] = {}
        heap = []
        for i, (node, cost, _, _) in enumerate(begin):
            for k in range(g.first[node], g.first[node + 1]):
                d = cost + work.get(k, g.w[k])
                if d < best.get(k, np.inf):
                    best[k], came[k] = d, (-1, i)
                    heap.append((d, k))
        heapq.heapify(heap)
        goals = _Goals(ends)
        for node, cost, _, _ in begin:
            if node in goals.at:
                goals.reached(node, cost)
        while heap:
            d, a = heapq.heappop(heap)
            if d > best[a] or d > limit:
                continue
            if d > goals.bound:
                break
            if g.dst[a] in goals.at:
                goals.reached(g.dst[a], d)
            for b, turn in self.moves.get(a, ()):
                nd = d + turn + work.get(b, g.w[b])
                if nd < best.get(b, np.inf):
                    best[b], came[b] = nd, (a, None)
                    heapq.heappush(heap, (nd, b))
        return best, came


_GRAPH = ("src", "dst", "w", "edge_id", "dir")
#: Routes that a Python task holds before it hands them on.
_HELD = 10_000


def alternatives(pairs: DataFrame, origins: DataFrame, destinations: DataFrame, arcs: DataFrame, s: Settings, moves: DataFrame | None = None) -> DataFrame:
    """(o, dest, alt, cost, legs) for pairs (o, dest, d); alt numbers a pair's routes in the order they came.

    With ``moves`` (transitions by the node rule) turns cost.  Sequential for each origin, so a Python task per
    batch of origins.  The adjacency of a small network goes to the executors; in a larger one each block of origins
    comes with what it can reach within the largest budget.  If that is over MAX_ARCS arcs, it is refused.
    """
    budget = detour_budget(F.col("d"), s.flow_detour_mode, s.flow_detour_ratio, s.flow_detour_buffer)
    goal = pairs.withColumns({"budget": budget, "slack": cost_tolerance(F.col("d")) + 1e-9}).join(
        destinations.select(F.col("pt_id").alias("dest"), F.col("u").alias("du"), F.col("v").alias("dv"), F.col("w_start").alias("ds"), F.col("w_end").alias("de"), F.col("edge_id").alias("dedge")), "dest"
    )
    arcs = arcs.select(*_GRAPH)
    goals = F.array_sort(F.collect_list(F.struct("d", "dest", "budget", "slack", "du", "dv", "ds", "de", "dedge"))).alias("goals")
    rows = goal.groupBy("o").agg(goals).join(origins.select(F.col("pt_id").alias("o"), "u", "v", "w_start", "w_end", "edge_id"), "o")
    rounds, factor = s.flow_n_alternatives, s.flow_alternative_penalty_factor
    schema = pa.schema([("o", pa.int64()), ("dest", pa.int64()), ("alt", pa.int64()), ("cost", pa.float64()),
                        ("legs", pa.list_(pa.struct([("edge_id", pa.int64()), ("dir", pa.int32()), ("node", pa.int64())])))])

    def work(g: Graph, after: dict | None, batch: list[dict]) -> Iterator[pa.RecordBatch]:
        finder = Alternatives(g, rounds, factor) if after is None else TurnAlternatives(g, after, rounds, factor)
        position = g.position
        out = []
        for row in batch:
            start = [(position(row["u"]), row["w_start"], row["edge_id"], 1), (position(row["v"]), row["w_end"], row["edge_id"], 0)]
            wanted = [
                {"dest": q["dest"], "budget": q["budget"], "slack": q["slack"], "ends": [(q["du"], q["ds"], q["dedge"], 0), (q["dv"], q["de"], q["dedge"], 1)]}
                for q in row["goals"]
            ]
            seen: dict[int, int] = {}
            for dest, _, cost, legs in finder.routes([x for x in start if x[0] is not None], wanted):
                seen[dest] = seen.get(dest, 0) + 1
                out.append({"o": row["o"], "dest": dest, "alt": seen[dest], "cost": cost, "legs": [dict(zip(("edge_id", "dir", "node"), x)) for x in legs]})
            if len(out) >= _HELD:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema=schema)

    if pathjoin.chosen(arcs, "auto", min(MAX_ARCS, pathjoin.MAX_ARCS)) == "blocks":
        # Costs that were made dearer only grow, so nothing further out is ever used.
        reach = (pairs.agg(F.max(budget).alias("b")).first()["b"] or 0.0) * factor**rounds + 1
        home, near = pathjoin.around(seeds(origins).join(pairs.select("o").distinct(), "o", "left_semi"), arcs, reach)
        reached = stage(pathjoin.reached_arcs(near, arcs), "routes-arcs")
        if (reached.groupBy("block").count().agg(F.max("count").alias("n")).first()["n"] or 0) > MAX_ARCS:
            raise ValueError(f"alternatives search over at most {MAX_ARCS} arcs; take origins that lie closer together, or a smaller radius")
        more = None
        if moves is not None:
            turns = moves.select("via", F.col("from_edge").alias("src"), F.col("to_edge").alias("dst"), F.col("turn").alias("w"), (2 * F.col("from_dir") + F.col("to_dir")).alias("edge_id"))
            more = near.join(turns, F.col("node") == F.col("via")).select("block", "src", "dst", "w", "edge_id")
        return pathjoin.by_block(reached, rows.join(home, "o"), work, _ROUTE, more, None if moves is None else _following)
    graph = shared_graph(arcs, _GRAPH)
    known = None
    if moves is not None:
        table = moves.select("from_edge", "to_edge", "turn", (2 * F.col("from_dir") + F.col("to_dir")).cast("long").alias("ways")).toArrow()
        known = arcs.sparkSession.sparkContext.broadcast(tuple(table[c].to_numpy() for c in table.column_names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = graph()
        after = None if known is None else _following(g, *known.value)
        for batch in batches:
            yield from work(g, after, batch.to_pylist())

    return rows.mapInArrow(run, _ROUTE)


def _following(g: Graph, from_edge=(), to_edge=(), turn=(), ways=()) -> dict[int, list[tuple[int, float]]]:
    """Moves by the positions of their arcs; ``ways`` has both directions: 2 * from + to.  Moves of arcs that aren't in the graph are left out."""
    place = {(e, w): k for k, (e, w) in enumerate(zip(g.edge, g.way))}
    out: dict[int, list[tuple[int, float]]] = {}
    for fe, te, t, w in zip(*(x.tolist() for x in (from_edge, to_edge, turn, ways)), strict=True) if len(from_edge) else ():
        a, b = place.get((fe, w // 2)), place.get((te, w % 2))
        if a is not None and b is not None:
            out.setdefault(a, []).append((b, t))
    for follow in out.values():
        follow.sort()
    return out


def all_paths(pairs: DataFrame, origins: DataFrame, destinations: DataFrame, arcs: DataFrame, detour: float, radius: float, max_paths: int = 5_000_000) -> DataFrame:
    """(o, dest, cost, edges): every simple path of at most ``detour`` times the shortest, for pairs (o, dest, d).

    Grown arc by arc; what can't reach the destination within the budget, by the distances
    from it, is dropped at once.  Beyond ``max_paths`` partial paths it fails: their number can
    grow exponentially, and a silent cut would be wrong.
    """
    back = stage(search(seeds(destinations), reversed_arcs(arcs), radius * detour).select(F.col("o").alias("dest"), "node", F.col("d").alias("left")), "all-back")
    goal = pairs.select("o", "dest", (F.col("d") * detour + 1e-5).alias("budget"))
    goal = goal.join(origins.select(F.col("pt_id").alias("o"), F.col("edge_id").alias("oe")), "o").join(
        destinations.select(F.col("pt_id").alias("dest"), F.col("edge_id").alias("de"), F.col("u").alias("du"), F.col("v").alias("dv"), F.col("w_start").alias("ds"), F.col("w_end").alias("dw")), "dest"
    )
    first = goal.join(seeds(origins), "o").join(back, ["dest", "node"]).where("d + left <= budget")
    grown = stage(first.select("o", "dest", "budget", "oe", "de", "du", "dv", "ds", "dw", "node", F.col("d").alias("cost"), F.array("node").alias("nodes"), F.array(F.col("oe")).alias("edges")), "all-paths")
    parts = []
    while True:
        n = grown.count()
        if n > max_paths:
            raise RuntimeError(f"over {max_paths} partial paths; use a smaller detour or radius")
        if not n:
            break
        ends = F.explode(F.array(F.struct(F.col("du").alias("at"), F.col("ds").alias("c")), F.struct(F.col("dv").alias("at"), F.col("dw").alias("c"))))
        arrived = grown.select("*", ends.alias("e")).where("node = e.at and cost + e.c <= budget and oe <> de")
        parts.append(arrived.select("o", "dest", (F.col("cost") + F.col("e.c")).alias("cost"), F.concat("edges", F.array("de")).alias("edges")))
        step = grown.join(arcs.select(F.col("src").alias("node"), F.col("dst").alias("to"), "w", "edge_id"), "node")
        step = step.where("edge_id <> oe and edge_id <> de and not array_contains(nodes, to)")
        step = step.join(back.withColumnRenamed("node", "to"), ["dest", "to"]).where("cost + w + left <= budget")
        grown = stage(
            step.select("o", "dest", "budget", "oe", "de", "du", "dv", "ds", "dw", F.col("to").alias("node"), (F.col("cost") + F.col("w")).alias("cost"),
                        F.concat("nodes", F.array("to")).alias("nodes"), F.concat("edges", F.array("edge_id")).alias("edges")),
            "all-paths",
        )
    empty = goal.select("o", "dest", F.lit(0.0).alias("cost"), F.array("oe").alias("edges")).limit(0)
    out = empty
    for p in parts:
        out = out.unionByName(p)
    return stage(out, "all-routes")


def probabilities(routes: DataFrame, trips: DataFrame, s: Settings) -> DataFrame:
    """``routes`` with share (of the pair's trips) and volume, by the route penalty on the excess over the shortest."""
    rows = routes.join(trips.select("o", "dest", "d", "trips"), ["o", "dest"])
    pen = route_penalty(F.col("cost") - F.col("d"), s.flow_path_detour_penalty, s.flow_route_enumeration_beta, s.flow_route_logistic_midpoint)
    share = F.col("pen") / F.sum("pen").over(Window.partitionBy("o", "dest"))
    rows = rows.withColumn("pen", pen).withColumn("share", share)
    return rows.withColumn("volume", F.col("share") * F.col("trips")).drop("pen")


def load_routes(routes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edge flows: edge_id, dir, flow), (node flows: node_id, flow) of routes with legs and volume."""
    legs = routes.select("volume", F.explode("legs").alias("l"))
    edges = legs.groupBy("l.edge_id", "l.dir").agg(F.sum("volume").alias("flow"))
    nodes = legs.where("l.node is not null").groupBy(F.col("l.node").alias("node_id")).agg(F.sum("volume").alias("flow"))
    return edges, nodes


def betweenness(paths: DataFrame, trips: DataFrame) -> DataFrame:
    """edge_id with its flow where a pair's trips are split evenly over all its paths."""
    n = F.count("*").over(Window.partitionBy("o", "dest"))
    rows = paths.withColumn("n", n).join(trips.select("o", "dest", "trips"), ["o", "dest"])
    return rows.select(F.explode("edges").alias("edge_id"), (F.col("trips") / F.col("n")).alias("q")).groupBy("edge_id").agg(F.sum("q").alias("flow"))


def huff(pairs: DataFrame, destinations: DataFrame, beta: float, closest: bool = False) -> DataFrame:
    """(o, dest, d, share): the probability of each destination, by weighted gravity, or 1 for the nearest one."""
    if closest:
        near = pairs.groupBy("o").agg(F.min(F.struct("d", "dest")).alias("b"))
        return near.select("o", "b.dest", "b.d", F.lit(1.0).alias("share"))
    rows = pairs.join(destinations.select(F.col("pt_id").alias("dest"), F.col("weight").alias("w")), "dest").withColumn("g", F.col("w") * F.exp(-beta * F.col("d")))
    return rows.select("o", "dest", "d", (F.col("g") / F.sum("g").over(Window.partitionBy("o"))).alias("share"))


def path_shares(paths: DataFrame, shares: DataFrame, nearest: DataFrame, weights: DataFrame, decay: str | None, beta: float, penalty: str = "equal") -> DataFrame:
    """``paths`` with probability (of the path among all of its origin), decay and volume.

    ``shares`` (o, dest, share), ``nearest`` (o, least), ``weights`` (o, weight).  A path's cost counts as
    0.01 at least.  The penalty splits a pair's trips: ``equal``, ``exponent`` or ``power`` (the inverse square).
    Decay by ``exponent`` is that of the origin's nearest destination, by ``power`` that of the path.
    """
    cost = F.greatest("cost", F.lit(0.01))
    pen = {"equal": F.lit(1.0), "exponent": F.exp(-beta * cost), "power": 1 / (cost * cost)}[penalty]
    fade = {None: F.lit(1.0), "exponent": F.exp(-beta * F.col("least")), "power": 1 / (cost * cost)}[decay]
    rows = paths.withColumn("pen", pen).withColumn("p", F.col("pen") / F.sum("pen").over(Window.partitionBy("o", "dest")))
    rows = rows.join(shares.select("o", "dest", "share"), ["o", "dest"]).join(nearest, "o").join(weights, "o")
    rows = rows.withColumns({"probability": F.col("p") * F.col("share"), "decay": fade, "length": cost})
    return rows.withColumn("volume", F.col("probability") * F.col("decay") * F.col("weight")).drop("pen", "p", "share", "least", "weight")


def path_flow(shared: DataFrame) -> DataFrame:
    """edge_id with the volumes of all paths over it."""
    return shared.select(F.explode("edges").alias("edge_id"), "volume").groupBy("edge_id").agg(F.sum("volume").alias("flow"))


def exposures(shared: DataFrame, edges: DataFrame, attribute: str) -> DataFrame:
    """o with what its paths are exposed to, by the weighted mean attribute of a path's edges.

    Four sums: the mean, the mean after decay, the expected amount along the way, and that after decay; beside them the
    expected length with and without decay.
    """
    numbered = shared.select(F.monotonically_increasing_id().alias("path"), "*")
    rows = numbered.select("path", F.explode("edges").alias("edge_id")).join(edges.select("edge_id", F.col("weight").alias("w"), F.col(attribute).cast("double").alias("a")), "edge_id")
    mean = rows.groupBy("path").agg((F.sum(F.col("w") * F.col("a")) / F.sum("w")).alias("mean"))
    p, e = F.col("probability"), F.col("mean")
    return numbered.join(mean, "path").groupBy("o").agg(
        F.sum(p * e).alias("mean_exposure"), F.sum(p * F.col("decay") * e).alias("decayed_mean_exposure"), F.sum(p * e * F.col("length")).alias("expected_exposure"),
        F.sum(p * F.col("decay") * e * F.col("length")).alias("decayed_expected_exposure"), F.sum(p * F.col("length")).alias("mean_path_length"),
        F.sum(p * F.col("decay") * F.col("length")).alias("probable_travel_distance"), F.count("*").alias("n_paths"),
    )


def exposure(paths: DataFrame, edges: DataFrame, attribute: str) -> DataFrame:
    """(o, exposure, n_paths): the mean over an origin's paths of the length-weighted mean attribute of a path."""
    numbered = paths.select("o", "edges", F.monotonically_increasing_id().alias("path"))
    rows = numbered.select("o", "path", F.explode("edges").alias("edge_id"))
    rows = rows.join(edges.select("edge_id", "length", F.col(attribute).alias("a")), "edge_id")
    each = rows.groupBy("o", "path").agg((F.sum(F.col("a") * F.col("length")) / F.sum("length")).alias("e"))
    return each.groupBy("o").agg(F.avg("e").alias("exposure"), F.count("*").alias("n_paths"))


def service_area(labelled: DataFrame, arcs: DataFrame, radius: float) -> DataFrame:
    """(o, edge_id, share): the edges within reach and how much of each is, counted from both ends."""
    rows = labelled.join(arcs, F.col("node") == F.col("src"))
    reached = F.least(radius - F.col("d"), F.col("w"))
    return rows.groupBy("o", "edge_id").agg(F.least(F.sum(reached) / F.max("w"), F.lit(1.0)).alias("share"))
