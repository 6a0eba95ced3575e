"""Searches block by block: the same rows as over the whole network, and figures that grow with the input."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from wayfold.operators import blocks, pathjoin

W = 14


@pytest.fixture(scope="module")
def lattice(spark):
    """W x W nodes with ids that say nothing about where they lie, two nodes apart from all others, and points at many of them."""
    rnd = random.Random(5)
    ids = rnd.sample(range(10**9), W * W)
    arcs, k = [], 0
    for r, c in itertools.product(range(W), range(W)):
        for dr, dc in ((0, 1), (1, 0)):
            if r + dr < W and c + dc < W:
                u, v, w = ids[W * r + c], ids[W * (r + dr) + c + dc], float(rnd.choice((80, 100, 100, 120)))
                arcs += [(u, v, w, k, 0), (v, u, w, k, 1)]
                k += 1
    arcs += [(1, 2, 50.0, k, 0), (2, 1, 50.0, k, 1)]
    seeds = [(o, ids[rnd.randrange(W * W)], float(rnd.randrange(90))) for o in range(60) for _ in range(2)] + [(900, 2, 5.0), (901, 7, 3.0), (902, 7, 9000.0)]
    start = spark.createDataFrame(seeds, "o long, node long, d double").groupBy("o", "node").agg(F.min("d").alias("d"))
    return spark.createDataFrame(arcs, "src long, dst long, w double, edge_id long, dir int"), start.cache(), ids


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(blocks, "LEAST", 15)
    monkeypatch.setattr(blocks, "MOST", 15)


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


@pytest.mark.parametrize("driver_links", [10**6, 60])
def test_every_linked_node_is_in_one_block(lattice, small_blocks, driver_links):
    arcs, _, ids = lattice
    got = blocks.blocks(arcs, driver_links).collect()
    assert sorted(r["node"] for r in got) == sorted([*ids, 1, 2])
    assert 3 < len({r["block"] for r in got}) < len(ids) / 3


def test_blocks_give_the_rows_of_the_whole_network(lattice, small_blocks):
    arcs, start, ids = lattice
    only = arcs.sparkSession.createDataFrame([(n,) for n in [*ids[::3], 2, 7]], "node long")
    for wanted in (None, only):
        want = rows(pathjoin.search(start, arcs, 450.0, "arrow", only=wanted))
        assert rows(pathjoin.search(start, arcs, 450.0, "blocks", only=wanted)) == want == rows(pathjoin.search(start, arcs, 450.0, "relational", only=wanted))
    want = rows(pathjoin.trees_from(start, arcs, 300.0, "arrow"))
    assert rows(pathjoin.trees_from(start, arcs, 300.0, "blocks")) == want and len(want) > 500


def test_a_network_of_some_size_is_searched_in_blocks(lattice):
    arcs, _, _ = lattice
    assert pathjoin.chosen(arcs, "auto", arcs.count()) == "arrow" and pathjoin.chosen(arcs, "auto", arcs.count() - 1) == "blocks"
