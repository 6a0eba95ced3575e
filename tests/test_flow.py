"""Flow, alternatives and turns on a lattice of random costs, against searches written out in plain Python."""

import collections
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from wayfold.functions.decay import LN99
from wayfold.operators import flow, impedance, pathjoin, routes, topology, trips, turnflow
from wayfold.params import Settings

N = 4
S = Settings(search_radius=700.0, flow_detour_ratio=1.25, gravity_beta=0.002)
TURNS = Settings(**(S.changed() | {"turns": True, "turn_threshold": 45.0, "turn_penalty": 25.0}))


def city(seed):
    rnd = random.Random(seed)
    edges, k = [], 0
    for r, c in itertools.product(range(N), range(N)):
        for dr, dc in ((0, 1), (1, 0)):
            if r + dr < N and c + dc < N:
                edges.append((k, N * r + c, N * (r + dr) + c + dc, 80 + 60 * rnd.random()))
                k += 1
    at = rnd.sample(range(k), 7)
    place = lambda i, e: (i, 1.0 + i, e, edges[e][1], edges[e][2], (x := edges[e][3] * rnd.uniform(0.1, 0.9)), edges[e][3] - x)
    return edges, [place(i, e) for i, e in enumerate(at[:3], 1)], [place(i, e) for i, e in enumerate(at[3:] + at[:1], 11)]


def tables(spark, edges, origins, destinations):
    point = "pt_id long, weight double, edge_id long, u long, v long, w_start double, w_end double"
    e = spark.createDataFrame([(*x, x[3]) for x in edges], "edge_id long, u long, v long, length double, weight double")
    n = spark.createDataFrame([(N * r + c, 100.0 * c, 100.0 * r, 0.0) for r, c in itertools.product(range(N), range(N))], "node_id long, x double, y double, z double")
    return e, n, spark.createDataFrame(origins, point), spark.createDataFrame(destinations, point)


def arcs_of(edges, o, d):
    """(src, dst, w, edge, dir, of the network) with the stretches of one origin and one destination."""
    out = [(u, v, w, e, 0, True) for e, u, v, w in edges] + [(v, u, w, e, 1, True) for e, u, v, w in edges]
    out += [("O", o[3], o[5], o[2], 1, False), ("O", o[4], o[6], o[2], 0, False)]
    return out + [(d[3], "D", d[5], d[2], 0, False), (d[4], "D", d[6], d[2], 1, False)]


def turn(a, b, c, penalty):
    if penalty == 0 or "O" in (a, b, c) or "D" in (a, b, c):
        return 0.0
    xy = lambda n: (100.0 * (n % N), 100.0 * (n // N))
    (x1, y1), (x2, y2), (x3, y3) = xy(a), xy(b), xy(c)
    raw = math.degrees(math.atan2(y3 - y2, x3 - x2) - math.atan2(y1 - y2, x1 - x2))
    return penalty if abs(abs(round(raw)) - 180) > 45 else 0.0


def relax(n, start, moves):
    """Least costs and predecessors by repeated relaxation."""
    best, came = dict(start), dict.fromkeys(start)
    changed = True
    while changed:
        changed = False
        for a, b, w in moves:
            if a in best and best[a] + w < best.get(b, math.inf) - 1e-12:
                best[b], came[b], changed = best[a] + w, a, True
    return best, came


def chain(came, s):
    out = []
    while s is not None:
        out.append(s)
        s = came[s]
    return out


def brute_nodes(edges, o, d, volume, ratio):
    """Flow of one pair by via-arcs: (edge, dir) and node loads."""
    arcs = arcs_of(edges, o, d)
    arc = {}
    for a in arcs:
        arc[a[0], a[1]] = a
    do, po = relax(None, {"O": 0.0}, [a[:3] for a in arcs])
    dd, pd = relax(None, {"D": 0.0}, [(a[1], a[0], a[2]) for a in arcs])
    shortest, oe, de = do["D"], o[2], d[2]
    ways = {}
    for a in arcs:
        u, x, w, e, _, net = a
        if u not in do or x not in dd or do[u] + w + dd[x] > shortest * ratio + 1e-9:
            continue
        there, on = chain(po, u)[::-1], chain(pd, x)
        steps_to, steps_on = [arc[p] for p in zip(there, there[1:])], [arc[p] for p in zip(on, on[1:])]
        if any(s[5] and s[3] == de for s in steps_to) or any(s[5] and s[3] == oe for s in steps_on):
            continue
        if net and e in (oe, de) or pd[x] == u or po[u] == x:
            continue
        excess = max(do[u] + w + dd[x] - shortest, 0.0)
        ways[a] = (1 / (1 + math.exp(LN99 / 150 * excess)), [*steps_to, a, *steps_on], [n for n in [*there, *on] if n not in ("O", "D")])
    return spread(ways, volume), shortest


def brute_states(edges, o, d, volume, ratio, penalty):
    arcs = arcs_of(edges, o, d)
    index = range(len(arcs))
    steps = [
        (i, j, arcs[j][2] + turn(arcs[i][0], arcs[i][1], arcs[j][1], penalty))
        for i in index for j in index
        if arcs[i][1] == arcs[j][0] and not (arcs[j][1] == arcs[i][0] and arcs[i][3] == arcs[j][3])
    ]
    do, po = relax(None, {i: arcs[i][2] for i in index if arcs[i][0] == "O"}, steps)
    dd, pd = relax(None, {i: 0.0 for i in index if arcs[i][1] == "D"}, [(j, i, w) for i, j, w in steps])
    shortest, oe, de = min(do[i] for i in index if arcs[i][1] == "D" and i in do), o[2], d[2]
    ways = {}
    for i in index:
        if i not in do or i not in dd or do[i] + dd[i] > shortest * ratio + 1e-9:
            continue
        to, on = chain(po, i)[::-1], chain(pd, i)
        if any(arcs[k][5] and arcs[k][3] == de for k in to) or any(arcs[k][5] and arcs[k][3] == oe for k in on) or (arcs[i][5] and arcs[i][3] in (oe, de)):
            continue
        whole = [arcs[k] for k in [*to, *on[1:]]]
        ways[i] = (1 / (1 + math.exp(LN99 / 150 * max(do[i] + dd[i] - shortest, 0.0))), whole, [a[1] for a in whole if a[1] != "D"])
    return spread(ways, volume), shortest


def spread(ways, volume):
    total, by_edge, by_node = sum(w[0] for w in ways.values()), collections.Counter(), collections.Counter()
    for weight, steps, nodes in ways.values():
        for s in steps:
            by_edge[s[3], s[4]] += volume * weight / total
        for n in nodes:
            by_node[n] += volume * weight / total
    return by_edge, by_node


def loads(by_edge, by_node):
    return {(r["edge_id"], r["dir"]): r["flow"] for r in by_edge.collect()}, {r["node_id"]: r["flow"] for r in by_node.collect()}


def summed(parts):
    by_edge, by_node = collections.Counter(), collections.Counter()
    for (e, n), _ in parts:
        by_edge.update(e)
        by_node.update(n)
    return dict(by_edge), dict(by_node)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("strategy", ["arrow", "relational"])
def test_via_arcs_load_what_the_definition_loads(spark, seed, strategy):
    edges, os, ds = city(seed)
    e, _, o, d = tables(spark, edges, os, ds)
    arcs = topology.arcs(e)
    sent = trips.trips(pathjoin.od(o, d, arcs, S.search_radius, same_edge=False), o, d, S)
    forward = pathjoin.trees(o, arcs, flow.tree_radius(S), strategy)
    backward = pathjoin.trees(d, pathjoin.reversed_arcs(arcs), flow.tree_radius(S), strategy)
    via = flow.via_arcs(sent, o, d, arcs, forward, backward, S).cache()
    assert not flow.delivered(sent, via).where("gap").count()
    got = loads(*flow.load(via, o, d, forward, backward))
    of, to = {p[0]: p for p in os}, {p[0]: p for p in ds}
    rows = sent.collect()
    parts = [brute_nodes(edges, of[r["o"]], to[r["dest"]], r["trips"], S.flow_detour_ratio) for r in rows]
    assert [r["d"] for r in rows] == pytest.approx([p[1] for p in parts]) and len(rows) > 8
    assert got == (pytest.approx(summed(parts)[0]), pytest.approx(summed(parts)[1]))


@pytest.mark.parametrize("seed, s", [(3, TURNS), (4, TURNS), (5, Settings(**(TURNS.changed() | {"turn_penalty": 0.0})))])
def test_via_states_load_what_the_definition_loads(spark, seed, s):
    edges, os, ds = city(seed)
    e, n, o, d = tables(spark, edges, os, ds)
    arcs = topology.arcs(e)
    forward, backward = turnflow.gradients(o, d, arcs, turnflow.transitions(arcs, n, s, False), flow.tree_radius(s))
    pairs = turnflow.shortest(o, d, arcs, forward, s.search_radius)
    sent = trips.trips(pairs, o, d, s).cache()
    via = turnflow.via_states(sent, o, d, arcs, forward, backward, s).cache()
    got = loads(*turnflow.load(via, o, d, arcs, forward, backward))
    of, to = {p[0]: p for p in os}, {p[0]: p for p in ds}
    rows = sent.collect()
    parts = [brute_states(edges, of[r["o"]], to[r["dest"]], r["trips"], s.flow_detour_ratio, s.turn_penalty) for r in rows]
    assert [r["d"] for r in rows] == pytest.approx([p[1] for p in parts]) and len(rows) > 8
    assert sum(r["q"] for r in via.collect()) == pytest.approx(sum(r["trips"] for r in rows))
    assert got == (pytest.approx(summed(parts)[0]), pytest.approx(summed(parts)[1]))


def brute_alternatives(edges, o, goals, rounds, factor, ratio, penalty=None):
    """Rounds over working costs; with a penalty, over states where turning back is a turn."""
    net = [(u, v, w, e, 0) for e, u, v, w in edges] + [(v, u, w, e, 1) for e, u, v, w in edges]
    work = [a[2] for a in net]
    begin = [[o[3], o[5], o[2], 1], [o[4], o[6], o[2], 0]]
    ends = {d[0]: [[d[3], d[5], d[2], 0], [d[4], d[6], d[2], 1]] for d, _ in goals}
    out = []
    for _ in range(rounds):
        keys = range(len(net))
        if penalty is None:
            start = {}
            for k, b in enumerate(begin):
                if b[1] < start.get(b[0], (math.inf, 0))[0]:
                    start[b[0]] = (b[1], k)
            best, came = {n: x[0] for n, x in start.items()}, {n: (None, x[1]) for n, x in start.items()}
            changed = True
            while changed:
                changed = False
                for i in keys:
                    a, b = net[i][:2]
                    if a in best and best[a] + work[i] < best.get(b, math.inf) - 1e-12:
                        best[b], came[b], changed = best[a] + work[i], (i, a), True
            reach = dict(best)

            def back(n, came=came):
                steps = []
                while came[n][0] is not None:
                    steps.append(came[n][0])
                    n = came[n][1]
                return steps[::-1], came[n][1]
        else:
            best, came = {}, {}
            for k, b in enumerate(begin):
                for i in keys:
                    if net[i][0] == b[0] and b[1] + work[i] < best.get(i, math.inf):
                        best[i], came[i] = b[1] + work[i], (None, k)
            changed = True
            while changed:
                changed = False
                for i in keys:
                    for j in keys:
                        if i in best and net[i][1] == net[j][0]:
                            c = best[i] + work[j] + turn(net[i][0], net[i][1], net[j][1], penalty)
                            if c < best.get(j, math.inf) - 1e-12:
                                best[j], came[j], changed = c, (i, None), True
            reach, last = {}, {}
            for i in best:
                if best[i] < reach.get(net[i][1], math.inf):
                    reach[net[i][1]], last[net[i][1]] = best[i], i
            for k, b in enumerate(begin):
                if b[1] < reach.get(b[0], math.inf):
                    reach[b[0]], last[b[0]] = b[1], ("bare", k)

            def back(n, came=came, last=last):
                if isinstance(last[n], tuple):
                    return [], last[n][1]
                steps, i = [], last[n]
                while i is not None:
                    steps.append(i)
                    i, k = came[i]
                return steps[::-1], k
        used = []
        for d, shortest in goals:
            own = ends[d[0]]
            found = [(reach[x[0]] + x[1], k) for k, x in enumerate(own) if x[0] in reach]
            if not found:
                continue
            end = own[min(found)[1]]
            steps, first = back(end[0])
            used.append((steps, begin[first], end))
            path = [begin[first][2], *(net[i][3] for i in steps), end[2]]
            if path[0] == path[1] or path[-1] == path[-2]:
                continue
            cost = (o[5], o[6])[first] + sum(net[i][2] for i in steps) + (d[5], d[6])[min(found)[1]]
            if penalty is not None:
                cost += sum(turn(net[i][0], net[i][1], net[j][1], penalty) for i, j in zip(steps, steps[1:]))
            if cost <= shortest * ratio + max(1e-4, shortest * 1e-5) + 1e-9:
                out.append((d[0], round(cost, 6), tuple(path)))
        for steps, b, end in used:
            for i in steps:
                work[i] *= factor
            b[1] *= factor
            end[1] *= factor
    return out


@pytest.mark.parametrize("seed, penalty", [(6, None), (7, None), (8, 25.0), (9, 25.0)])
def test_alternatives_are_the_rounds_of_the_definition(spark, seed, penalty):
    edges, os, ds = city(seed)
    e, n, o, d = tables(spark, edges, os, ds)
    arcs = topology.arcs(e)
    s = Settings(**((S if penalty is None else TURNS).changed() | {"flow_engine": "k_alternatives", "flow_n_alternatives": 6, "flow_alternative_penalty_factor": 1.07, "flow_path_detour_penalty": "equal"}))
    moves = None if penalty is None else turnflow.transitions(arcs, n, s, True)
    pairs = pathjoin.od(o, d, arcs, s.search_radius, same_edge=False).cache()
    rows = routes.alternatives(pairs, o, d, arcs, s, moves).collect()
    shortest = collections.defaultdict(list)
    to = {p[0]: p for p in ds}
    for r in sorted(pairs.collect(), key=lambda r: r["d"]):
        shortest[r["o"]].append((to[r["dest"]], r["d"]))
    for p in os:
        got = collections.defaultdict(list)
        for r in sorted((r for r in rows if r["o"] == p[0]), key=lambda r: r["alt"]):
            got[r["dest"]].append((round(r["cost"], 6), tuple(x["edge_id"] for x in r["legs"])))
        want = collections.defaultdict(list)
        for dest, cost, path in brute_alternatives(edges, p, shortest[p[0]], 6, 1.07, s.flow_detour_ratio, penalty):
            want[dest].append((cost, path))
        assert got == want
    # Shares and loads of what was found.
    found = routes.alternatives(pairs, o, d, arcs, s, moves).cache()
    sent = trips.trips(pairs, o, d, s).cache()
    volume = {(r["o"], r["dest"]): r["trips"] for r in sent.collect()}
    many = collections.Counter((r["o"], r["dest"]) for r in rows)
    load = collections.Counter()
    for r in rows:
        for x in r["legs"]:
            load[x["edge_id"], x["dir"]] += volume[r["o"], r["dest"]] / many[r["o"], r["dest"]]
    by_edge, _ = routes.load_routes(routes.probabilities(found, sent, s))
    assert {(r["edge_id"], r["dir"]): r["flow"] for r in by_edge.collect()} == pytest.approx(dict(load))


def test_alternatives_cut_a_large_network_to_what_is_in_reach(spark, monkeypatch):
    edges, os, ds = city(10)
    e, _, o, d = tables(spark, edges, os, ds)
    far = spark.range(200).select((F.col("id") + 1000).alias("edge_id"), (F.col("id") + 5000).alias("u"), (F.col("id") + 5001).alias("v"), F.lit(10.0).alias("length"), F.lit(10.0).alias("weight"))
    s = Settings(**(S.changed() | {"flow_engine": "k_alternatives", "flow_n_alternatives": 3}))
    arcs = topology.arcs(e)
    pairs = pathjoin.od(o, d, arcs, s.search_radius, same_edge=False).cache()
    want = sorted(map(str, routes.alternatives(pairs, o, d, arcs, s).collect()))
    monkeypatch.setattr(routes, "MAX_ARCS", 2 * len(edges))
    assert sorted(map(str, routes.alternatives(pairs, o, d, topology.arcs(e.unionByName(far)), s).collect())) == want
    monkeypatch.setattr(routes, "MAX_ARCS", len(edges))
    with pytest.raises(ValueError):
        routes.alternatives(pairs, o, d, arcs, s)


def test_labels_of_wanted_nodes_only(spark):
    edges, os, _ = city(11)
    e, _, o, _ = tables(spark, edges, os, os)
    arcs, only = topology.arcs(e), spark.createDataFrame([(0,), (5,), (999,)], "node long")
    whole = {(r["o"], r["node"]): r["d"] for r in pathjoin.labels(o, arcs, 500.0).collect()}
    for strategy in ("arrow", "relational"):
        got = {(r["o"], r["node"]): r["d"] for r in pathjoin.labels(o, arcs, 500.0, strategy, only=only).collect()}
        assert got == {k: x for k, x in whole.items() if k[1] in (0, 5)}


def test_impedance_stacks(spark):
    edges, os, ds = city(12)
    e, n, o, d = tables(spark, edges, os, ds)
    n = n.withColumn("z", F.col("node_id") % 5 * 3.0)
    obstacle = spark.createDataFrame([(1, 0, 7.0, None), (2, 0, 5.0, "ab"), (3, 3, 11.0, " BA ")], "pt_id long, edge_id long, penalty double, direction string")
    arcs = impedance.with_obstacles(impedance.with_elevation(topology.arcs(e), n, 4.0), obstacle)
    extra = {(0, 0): 12.0, (0, 1): 7.0, (3, 1): 11.0}
    z = lambda k: k % 5 * 3.0
    want = {}
    for k, u, v, w in edges:
        want[k, 0] = w + 4 * max(0.0, z(v) - z(u)) + extra.get((k, 0), 0.0)
        want[k, 1] = w + 4 * max(0.0, z(u) - z(v)) + extra.get((k, 1), 0.0)
    assert {(r["edge_id"], r["dir"]): r["w"] for r in arcs.collect()} == pytest.approx(want)
    moves = impedance.transitions(arcs, n, "geometry", 45.0, 32.0)
    found = pathjoin.turn_od(o, d, arcs, moves, 3000.0, same_edge=False).collect()
    entry = impedance.crossed_between(o, obstacle.withColumns({"w_start": F.lit(1.0), "w_end": F.lit(1e6)}), True).where("edge_id = 0")
    assert len(found) == len(os) * len(ds) and entry.where("w_start is null or w_end is null").count() == 0
    plain = {(r["o"], r["dest"]): r["d"] for r in pathjoin.od(o, d, topology.arcs(e), 3000.0, same_edge=False).collect()}
    assert all(r["d"] >= plain[r["o"], r["dest"]] - 1e-9 for r in found)
