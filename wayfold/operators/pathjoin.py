"""Joins along shortest network paths within a radius.

Three strategies give the same rows, bit by bit, since all add costs from the origin outwards:

``relational``  joins the frontier with the arcs, round by round, keeping what got shorter;
                labels stand in staged tables.  Works for a network of any size.
``arrow``       searches from each origin in a Python task over the whole adjacency, which is
                sent to the executors.  Taken only if the network has at most ``max_arcs`` arcs.
``blocks``      searches from each origin in a Python task over what the origins of its block
                can reach; that part of the network comes to the task with the origins.  Works for
                a network of any size; labels never cross the cluster.

Labels are closed: a node at exactly the radius is in.  Seeds at both ends of the origin's
edge combine by the smaller one.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators.blocks import blocks
from wayfold.plans.staging import stage, unstage

#: Arcs that are sent to every Python worker as a whole at most: about 10 MB.
MAX_ARCS = 200_000


def seeds(points: DataFrame) -> DataFrame:
    """(o, node, d) at both ends of each point's edge."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("w_start").alias("d")), F.struct(F.col("v").alias("node"), F.col("w_end").alias("d"))))
    return points.select(F.col("pt_id").alias("o"), ends.alias("s")).groupBy("o", F.col("s.node").alias("node")).agg(F.min("s.d").alias("d"))


def labels(points: DataFrame, arcs: DataFrame, radius: float, strategy: str = "auto", max_arcs: int = MAX_ARCS, only: DataFrame | None = None) -> DataFrame:
    """(o, node, d): every node within the radius of each point, from the point outwards.

    For distances to points, give the reversed arcs (``reversed_arcs``).  With ``only`` (node), labels of
    other nodes are left out of the result.
    """
    return search(seeds(points), arcs, radius, strategy, max_arcs, only)


def chosen(arcs: DataFrame, strategy: str, max_arcs: int) -> str:
    """The strategy: by choice, or a shared adjacency where there are few enough arcs and blocks elsewhere."""
    if strategy == "auto":
        return "arrow" if arcs.limit(max_arcs + 1).count() <= max_arcs else "blocks"
    if strategy not in ("arrow", "blocks", "relational"):
        raise ValueError(f"no strategy {strategy}")
    return strategy


def search(start: DataFrame, arcs: DataFrame, radius: float, strategy: str = "auto", max_arcs: int = MAX_ARCS, only: DataFrame | None = None) -> DataFrame:
    strategy, arcs = chosen(arcs, strategy, max_arcs), arcs.select("src", "dst", "w")
    if strategy == "relational":
        out = _relational(start, arcs, radius)
    else:
        run = _over_blocks if strategy == "blocks" else _over_all
        out = run(start, _with_seeds(start), arcs, radius, _labels(radius), "o long, node long, d double", only)
    # Seeds at nodes without arcs come whatever is wanted.
    return out if only is None else out.join(only.select("node").distinct(), "node", "left_semi").select("o", "node", "d")


def reversed_arcs(arcs: DataFrame) -> DataFrame:
    return arcs.withColumns({"src": F.col("dst"), "dst": F.col("src")})


def _relational(start: DataFrame, arcs: DataFrame, radius: float, parts_at_most: int = 8) -> DataFrame:
    """Rounds write only the labels that got shorter; what is known is the least of all parts, made one again now and then."""
    arcs = stage(arcs.groupBy("src", "dst").agg(F.min("w").alias("w")), "path-arcs")
    frontier = stage(start.where(F.col("d") <= radius), "path-labels")
    parts = [frontier]
    while True:
        known = reduce(DataFrame.unionByName, parts).groupBy("o", "node").agg(F.min("d").alias("d"))
        step = frontier.join(arcs, F.col("node") == F.col("src")).select("o", F.col("dst").alias("node"), (F.col("d") + F.col("w")).alias("d")).where(F.col("d") <= radius)
        step = step.groupBy("o", "node").agg(F.min("d").alias("new"))
        better = step.join(known, ["o", "node"], "left").where("d is null or new < d")
        frontier = stage(better.select("o", "node", F.col("new").alias("d")), "path-labels")
        if not frontier.limit(1).count() or len(parts) >= parts_at_most:
            whole = stage(reduce(DataFrame.unionByName, [*parts, frontier]).groupBy("o", "node").agg(F.min("d").alias("d")), "path-labels")
            for p in parts:
                unstage(p)
            if not frontier.limit(1).count():
                return whole
            parts = [whole]
        else:
            parts.append(frontier)


class Graph:
    """Adjacency by node position, built from the arcs as columns."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, w: np.ndarray, edge: np.ndarray | None = None, way: np.ndarray | None = None):
        self.ids = np.unique(np.concatenate([src, dst]))
        s, d = np.searchsorted(self.ids, src), np.searchsorted(self.ids, dst)
        keys = (d, w) if edge is None else (edge, d, w)
        order = np.lexsort((*keys, s))
        self.first = np.searchsorted(s[order], np.arange(len(self.ids) + 1)).tolist()
        self.dst, self.w = d[order].tolist(), w[order].tolist()
        self.edge = None if edge is None else edge[order].tolist()
        self.way = None if way is None else way[order].tolist()
        self.names = self.ids.tolist()

    def position(self, node: int) -> int | None:
        k = int(np.searchsorted(self.ids, node))
        return k if k < len(self.ids) and self.names[k] == node else None

    def within(self, start: list[tuple[int, float]], radius: float) -> dict[int, float]:
        best: dict[int, float] = {}
        heap: list[tuple[float, int]] = []
        for node, d in start:
            if d <= radius and d < best.get(node, np.inf):
                best[node] = d
                heap.append((d, node))
        heapq.heapify(heap)
        first, dst, w = self.first, self.dst, self.w
        while heap:
            d, a = heapq.heappop(heap)
            if d > best[a]:
                continue
            for k in range(first[a], first[a + 1]):
                nd, b = d + w[k], dst[k]
                if nd <= radius and nd < best.get(b, np.inf):
                    best[b] = nd
                    heapq.heappush(heap, (nd, b))
        return best


#: Rows that a Python task holds before it hands them on.
_HELD = 100_000


def shared_graph(arcs: DataFrame, columns: tuple[str, ...]):
    """A function that gives the Graph of ``arcs`` in a Python task, built once in each."""
    table = arcs.select(*columns).toPandas()
    shared = arcs.sparkSession.sparkContext.broadcast(tuple(table[c].to_numpy() for c in columns))
    built: list[Graph] = []

    def graph() -> Graph:
        if not built:
            built.append(Graph(*shared.value))
        return built[0]

    return graph


def _starts(graph: Graph, own: list[dict], radius: float) -> tuple[list[tuple[int, float]], dict[int, float]]:
    """Seeds by node position, and those at nodes that no arc touches, by node."""
    begin, outside = [], {}
    for s in own:
        k = graph.position(s["node"])
        if k is not None:
            begin.append((k, s["d"]))
        elif s["d"] <= radius:
            outside[s["node"]] = min(s["d"], outside.get(s["node"], np.inf))
    return begin, outside


def _with_seeds(start: DataFrame) -> DataFrame:
    return start.groupBy("o").agg(F.collect_list(F.struct("node", "d")).alias("s"))


def _labels(radius: float):
    def work(g: Graph, kept: set[int] | None, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        names = g.names
        o, node, d = [], [], []

        def held() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(o, pa.int64()), pa.array(node, pa.int64()), pa.array(d, pa.float64())], ["o", "node", "d"])
            o.clear(), node.clear(), d.clear()
            return out

        for row in rows:
            begin, outside = _starts(g, row["s"], radius)
            found = g.within(begin, radius)
            if kept is not None:
                found = {k: x for k, x in found.items() if k in kept}
            o += [row["o"]] * (len(found) + len(outside))
            node += [names[k] for k in found]
            node += outside
            d += found.values()
            d += outside.values()
            if len(o) >= _HELD:
                yield held()
        yield held()

    return work


def _over_all(start: DataFrame, items: DataFrame, arcs: DataFrame, radius: float, work, schema: str, only: DataFrame | None = None) -> DataFrame:
    """``work(graph, wanted positions or None, rows)`` over batches of ``items``, each with the whole network."""
    graph, wanted = shared_graph(arcs, tuple(arcs.columns)), None
    if only is not None:
        # At most as many as the arcs have ends.
        ends = arcs.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        wanted = arcs.sparkSession.sparkContext.broadcast(only.select("node").distinct().join(ends, "node", "left_semi").toPandas()["node"].to_numpy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = graph()
        kept = None if wanted is None else set(np.searchsorted(g.ids, wanted.value).tolist())
        for batch in batches:
            yield from work(g, kept, batch.to_pylist())

    return items.mapInArrow(run, schema)


def around(start: DataFrame, arcs: DataFrame, radius: float) -> tuple[DataFrame, DataFrame]:
    """(o, block) of each o of ``start``, and (block, node): what any o of the block has within the radius; both staged."""
    dealt = start.join(blocks(arcs), "node", "left").groupBy("o").agg(F.min(F.struct("d", "node", "block")).alias("s"))
    # Where no arc starts or ends, any block will do.
    home = stage(dealt.select("o", F.coalesce("s.block", -1 - F.pmod(F.xxhash64("o"), F.lit(64))).alias("block")), "block-homes")
    first = start.join(home, "o").groupBy(F.col("block").alias("o"), "node").agg(F.min("d").alias("d"))
    return home, _relational(first, arcs.select("src", "dst", "w"), radius).select(F.col("o").alias("block"), "node")


def _over_blocks(start: DataFrame, items: DataFrame, arcs: DataFrame, radius: float, work, schema: str, only: DataFrame | None = None) -> DataFrame:
    """``_over_all``, where a row of ``items`` comes with what its block can reach: every arc that starts within the radius of its o."""
    home, near = around(start, arcs, radius)
    arcs, items = reached_arcs(near, arcs), items.join(home, "o")
    if only is None:
        return by_block(arcs, items, work, schema)
    wanted = near.join(only.select("node").distinct(), "node", "left_semi").select("block", F.col("node").alias("src"))
    return by_block(arcs, items, work, schema, wanted, _positions)


def _positions(g: Graph, nodes: np.ndarray | None = None) -> set[int]:
    return set() if nodes is None else {k for n in nodes.tolist() if (k := g.position(n)) is not None}


def reached_arcs(near: DataFrame, arcs: DataFrame) -> DataFrame:
    """(block, *arcs): every arc that starts at a node of ``near`` (block, node)."""
    return near.join(arcs, F.col("node") == F.col("src")).drop("node")


def by_block(arcs: DataFrame, items: DataFrame, work, schema: str, more: DataFrame | None = None, prepared=None) -> DataFrame:
    """``work(graph, prepared, rows)`` for the rows of each block over the arcs of the block.

    All tables have ``block``.  A block's arcs come first in its task, then what else it needs, then its rows, which are
    worked on batch by batch.  ``more`` has some columns of arcs, in their order; ``prepared(graph, *columns)`` is called once
    for a block with what it has of it, or with the graph alone.
    """
    columns = [c for c in ("src", "dst", "w", "edge_id", "dir") if c in arcs.columns]
    kinds = dict(arcs.dtypes) | {"item": items.select(F.struct(*(c for c in items.columns if c != "block"))).dtypes[0][1]}
    names = [*columns, "item"]

    def tagged(df: DataFrame, kind: int, **given) -> DataFrame:
        return df.select("block", F.lit(kind).alias("kind"), *(given.get(n, F.lit(None)).cast(kinds[n]).alias(n) for n in names))

    rows = tagged(arcs, 0, **{c: F.col(c) for c in columns}).union(tagged(items, 2, item=F.struct(*(c for c in items.columns if c != "block"))))
    given = [] if more is None else [c for c in columns if c in more.columns]
    if more is not None:
        rows = rows.union(tagged(more, 1, **{c: F.col(c) for c in given}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, others, g, kept = None, [], [], None, None
        for batch in batches:
            block, kind = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            cuts = (np.flatnonzero((np.diff(block) != 0) | (np.diff(kind) != 0)) + 1).tolist()
            for a, b in zip([0, *cuts], [*cuts, len(block)]):
                if a == b:
                    continue
                if block[a] != at:
                    at, parts, others, g = block[a], [], [], None
                part = batch.slice(a, b - a)
                if kind[a] == 0:
                    parts.append([part.column(c).to_numpy() for c in columns])
                elif kind[a] == 1:
                    others.append([part.column(c).to_numpy() for c in given])
                else:
                    if g is None:
                        g = Graph(*(np.concatenate(x) for x in zip(*parts))) if parts else Graph(*(np.zeros(0, np.int64) for _ in columns))
                        kept = None if prepared is None else prepared(g, *(np.concatenate(x) for x in zip(*others)))
                        parts, others = [], []
                    yield from work(g, kept, part.column("item").to_pylist())

    dealt = rows.repartition(int(arcs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block").sortWithinPartitions("block", "kind")
    return dealt.mapInArrow(run, schema)


_PATH = "array<struct<edge_id:bigint,dir:int,node:bigint>>"


def trees(points: DataFrame, arcs: DataFrame, radius: float, strategy: str = "auto", max_arcs: int = MAX_ARCS) -> DataFrame:
    """(o, node, d, pred, root, path): labels with the arcs (edge_id, dir, node reached) from a seed to them.

    Predecessors are those of ``predecessors``.  One pass where the adjacency is shared; else rounds of joins.
    """
    return trees_from(seeds(points), arcs, radius, strategy, max_arcs)


def trees_from(start: DataFrame, arcs: DataFrame, radius: float, strategy: str = "auto", max_arcs: int = MAX_ARCS) -> DataFrame:
    """``trees`` from seeds (o, node, d)."""
    strategy = chosen(arcs, strategy, max_arcs)
    if strategy == "relational":
        return paths(stage(_relational(start, arcs.select("src", "dst", "w"), radius), "path-labels"), arcs)
    run = _over_blocks if strategy == "blocks" else _over_all
    return run(start, _with_seeds(start), arcs.select("src", "dst", "w", "edge_id", "dir"), radius, _trees(radius), f"o long, node long, d double, pred long, root long, path {_PATH}")


def tree(g: Graph, found: dict[int, float]) -> dict[int, tuple[int, int]]:
    """By node position, the arc over which a label was reached and where it starts: the smallest start, then edge, of those that made the label."""
    came: dict[int, tuple] = {}
    for a, d in found.items():
        for k in range(g.first[a], g.first[a + 1]):
            b = g.dst[k]
            if found.get(b) == d + g.w[k]:
                this = (g.names[a], g.edge[k], g.way[k], a, k)
                if b not in came or this < came[b]:
                    came[b] = this
    return {b: (k, a) for b, (_, _, _, a, k) in came.items()}


def _trees(radius: float):
    def work(g: Graph, kept: set[int] | None, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        held = _Paths()
        for row in rows:
            origin = row["o"]
            begin, outside = _starts(g, row["s"], radius)
            found = g.within(begin, radius)
            came = tree(g, found)
            roots: dict[int, int] = {}
            path: dict[int, list] = {}
            for k in sorted(found, key=found.get):
                if k in came:
                    arc, before = came[k]
                    name = g.names[before]
                    roots[k], path[k] = roots[before], [*path[before], (g.edge[arc], g.way[arc], g.names[k])]
                else:
                    name, roots[k], path[k] = None, g.names[k], []
                held.add(origin, g.names[k], found[k], name, roots[k], path[k])
            for n, d in outside.items():
                held.add(origin, n, d, None, n, [])
            if held.size >= _HELD:
                yield held.batch()
        yield held.batch()

    return work


class _Paths:
    """Rows of ``trees`` until they are handed on."""

    def __init__(self):
        self.rows, self.steps, self.upto, self.size = [], [], [0], 0

    def add(self, o, node, d, pred, root, path) -> None:
        self.rows.append((o, node, d, pred, root))
        self.steps += path
        self.upto.append(len(self.steps))
        self.size += 1 + len(path)

    def batch(self) -> pa.RecordBatch:
        o, node, d, pred, root = zip(*self.rows) if self.rows else ((),) * 5
        edge, way, reached = zip(*self.steps) if self.steps else ((),) * 3
        step = pa.StructArray.from_arrays([pa.array(edge, pa.int64()), pa.array(way, pa.int32()), pa.array(reached, pa.int64())], ["edge_id", "dir", "node"])
        columns = [pa.array(o, pa.int64()), pa.array(node, pa.int64()), pa.array(d, pa.float64()), pa.array(pred, pa.int64()), pa.array(root, pa.int64())]
        out = pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(self.upto, pa.int32()), step)], ["o", "node", "d", "pred", "root", "path"])
        self.__init__()
        return out


def to_points(labelled: DataFrame, destinations: DataFrame) -> DataFrame:
    """(o, dest, d): the nearer way over either end of each destination's edge."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("w_start").alias("c")), F.struct(F.col("v").alias("node"), F.col("w_end").alias("c"))))
    at = destinations.select(F.col("pt_id").alias("dest"), ends.alias("e")).select("dest", "e.node", "e.c")
    return labelled.join(at, "node").groupBy("o", "dest").agg(F.min(F.col("d") + F.col("c")).alias("d"))


def along_edge(origins: DataFrame, destinations: DataFrame) -> DataFrame:
    """(o, dest, d) of pairs on one edge, by the way that doesn't leave it."""
    a = origins.select("edge_id", F.col("pt_id").alias("o"), F.col("w_start").alias("ws"))
    b = destinations.select("edge_id", F.col("pt_id").alias("dest"), F.col("w_start").alias("wd"))
    return a.join(b, "edge_id").select("o", "dest", F.abs(F.col("ws") - F.col("wd")).alias("d"))


def od(origins: DataFrame, destinations: DataFrame, arcs: DataFrame, radius: float, same_edge: bool = True, strategy: str = "auto", max_arcs: int = MAX_ARCS) -> DataFrame:
    """(o, dest, d) of all pairs within the radius; only reachable pairs are rows."""
    ends = destinations.select(F.explode(F.array("u", "v")).alias("node"))
    pairs = to_points(labels(origins, arcs, radius, strategy, max_arcs, ends), destinations)
    if same_edge:
        pairs = pairs.union(along_edge(origins, destinations)).groupBy("o", "dest").agg(F.min("d").alias("d"))
    return pairs.where(F.col("d") <= radius)


def assigned(pairs: DataFrame, origin_group: DataFrame, destination_group: DataFrame) -> DataFrame:
    """Pairs whose ends are assigned to each other: (o, grp) and (dest, grp)."""
    return pairs.join(origin_group, "o").join(destination_group, ["dest", "grp"]).select(pairs.columns)


def predecessors(labelled: DataFrame, arcs: DataFrame) -> DataFrame:
    """(o, node, d, pred, edge_id, dir): the arc over which each label was reached; none at a seed.

    Of several, the smallest predecessor, then edge.  The sum is the one that made the label,
    so equality is exact.
    """
    before = labelled.select("o", F.col("node").alias("src"), F.col("d").alias("dp")).join(arcs, "src")
    reached = labelled.join(before.select("o", F.col("dst").alias("node"), (F.col("dp") + F.col("w")).alias("d"), "src", "edge_id", "dir"), ["o", "node", "d"])
    best = reached.groupBy("o", "node", "d").agg(F.min(F.struct("src", "edge_id", "dir")).alias("b"))
    return best.select("o", "node", "d", F.col("b.src").alias("pred"), "b.edge_id", "b.dir")


def paths(labelled: DataFrame, arcs: DataFrame) -> DataFrame:
    """(o, node, d, pred, root, path): the arcs (edge_id, dir, node reached) from a seed to the label.

    Rounds lengthen the chains by one arc; their number is that of the arcs within the radius.
    """
    tree = stage(
        labelled.join(predecessors(labelled, arcs).drop("d"), ["o", "node"], "left"), "path-tree"
    )
    empty = F.array().cast(_PATH)
    done = stage(tree.where("pred is null").select("o", "node", "d", "pred", F.col("node").alias("root"), empty.alias("path")), "path-rows")
    parts, last = [done], done
    inner = tree.where("pred is not null").select("o", F.col("node").alias("next"), F.col("d").alias("nd"), F.col("pred").alias("node"), "edge_id", F.col("dir").cast("int").alias("dir"))
    while last.limit(1).count():
        grown = inner.join(last.select("o", "node", "root", "path"), ["o", "node"]).select(
            "o", F.col("next").alias("node"), F.col("nd").alias("d"), F.col("node").alias("pred"), "root",
            F.concat("path", F.array(F.struct("edge_id", "dir", F.col("next").alias("node")))).alias("path"),
        )
        last = stage(grown, "path-rows")
        parts.append(last)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def state_search(start: DataFrame, moves: DataFrame, radius: float) -> DataFrame:
    """(o, state, d) over a graph of states: ``start`` (o, state, d), ``moves`` (src, dst, w)."""
    return search(start.select("o", F.col("state").alias("node"), "d"), moves, radius).select("o", F.col("node").alias("state"), "d")


def turn_od(origins: DataFrame, destinations: DataFrame, arcs: DataFrame, moves: DataFrame, radius: float, same_edge: bool = True) -> DataFrame:
    """(o, dest, d) with turn costs.

    A state is an arc being travelled (2 * edge + dir) and its label the cost up to the end of
    it.  An origin starts on its own edge, so the first turn is paid; a destination is reached
    by turning into its edge and going as far as the point.
    """
    state = lambda e, d: 2 * F.col(e) + F.col(d)
    own = F.explode(F.array(F.struct((2 * F.col("edge_id") + 1).alias("state"), F.col("w_start").alias("d")), F.struct((2 * F.col("edge_id")).alias("state"), F.col("w_end").alias("d"))))
    start = origins.select(F.col("pt_id").alias("o"), own.alias("s")).select("o", "s.state", "s.d")
    steps = moves.select(state("from_edge", "from_dir").alias("src"), state("to_edge", "to_dir").alias("dst"), (F.col("turn") + F.col("w")).alias("w"))
    at = state_search(start, steps, radius)
    # Entering the destination's edge from its start takes w_start, from its end w_end.
    into = F.explode(F.array(F.struct((2 * F.col("edge_id")).alias("dst"), F.col("w_start").alias("c")), F.struct((2 * F.col("edge_id") + 1).alias("dst"), F.col("w_end").alias("c"))))
    last = destinations.select(F.col("pt_id").alias("dest"), into.alias("e")).select("dest", "e.dst", "e.c")
    turns = moves.select(state("from_edge", "from_dir").alias("state"), state("to_edge", "to_dir").alias("dst"), "turn")
    pairs = at.join(turns, "state").join(last, "dst").groupBy("o", "dest").agg(F.min(F.col("d") + F.col("turn") + F.col("c")).alias("d"))
    if same_edge:
        pairs = pairs.union(along_edge(origins, destinations)).groupBy("o", "dest").agg(F.min("d").alias("d"))
    return pairs.where(F.col("d") <= radius)
