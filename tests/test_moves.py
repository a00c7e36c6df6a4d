"""Searches over tables: they rise at every step, end where no single move improves, and merge blocks of planted graphs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import metrics, moves, partition
from loomgraph.operators.graph import Graph
from loomgraph.operators.objectives import OBJECTIVES, Blocks, merge_deltas, node_deltas
from loomgraph.session import frozen


def planted(spark, n=60, blocks=3, seed=1, directed=False):
    random = np.random.default_rng(seed)
    truth = np.arange(n) * blocks // n
    hit = random.random((n, n)) < np.where(truth[:, None] == truth[None, :], 0.4, 0.04)
    src, dst = np.nonzero(hit if directed else np.triu(hit, 1))
    part = spark.createDataFrame([(i, int(random.integers(blocks))) for i in range(n)], "node long, block int")
    return Graph(spark.createDataFrame([(int(a), int(b), 1.0) for a, b in zip(src, dst)], "src long, dst long, weight double"), directed, part.select("node")).counted(), frozen(part, "part"), truth


def value(graph, part, name):
    return OBJECTIVES[name](Blocks(graph, part)).first().objective


@pytest.mark.parametrize("name, directed", [("dckn", False), ("sps", False), ("skn", True)])
def test_em_ends_where_no_single_move_improves(spark, name, directed):
    graph, part, truth = planted(spark, 16, 2, directed=directed)
    found = moves.em(graph, part, name)
    assert found.status == "done" and (np.diff(found.values) > 0).all()
    assert found.value == pytest.approx(value(graph, found.part, name), abs=1e-7)
    kept = partition.block_sizes(found.part).where("n = 1").select(F.col("block").alias("from_block"))
    assert node_deltas(graph, found.part, name).join(kept, "from_block", "left_anti").agg(F.max("delta")).first()[0] <= 0.001
    assert found.part.select("block").distinct().count() == 2


def test_batches_that_undo_each_other_are_broken_up(spark):
    # two cliques whose halves sit in the wrong blocks: all nodes want to change at once
    rows = [(a + s, b + s, 1.0) for s in (0, 8) for a in range(8) for b in range(a)]
    part = spark.createDataFrame([(i, i % 2) for i in range(16)], "node long, block int")
    graph = Graph(spark.createDataFrame(rows, "src long, dst long, weight double"), False, part.select("node"))
    found = moves.em(graph, part, "dckn")
    assert found.status == "done" and len(found.values) < 30 and (np.diff(found.values) > 0).all()


@pytest.mark.parametrize("name", ["dckn", "dcpu"])
def test_a_round_merges_pairs_that_are_each_others_best(spark, name):
    graph, part, _ = planted(spark, 40, 8, 3)
    deltas = {}
    for r in merge_deltas(graph, part, name, "near").collect():
        deltas[frozenset((r.block, r.into))] = r.delta
    rank = lambda p: (round(deltas[p], 9), -min(p), -max(p))
    best = {b: max((p for p in deltas if b in p), key=rank) for b in {b for p in deltas for b in p}}
    want = {p for p in deltas if all(best[b] == p for b in p)}
    got = moves.merge_round(graph, part, name).collect()
    assert {frozenset((r.block, r.into)) for r in got} == want and len(want) >= 1
    assert all(r.into < r.block and r.delta == pytest.approx(deltas[frozenset((r.block, r.into))]) for r in got)
    assert len(moves.merge_round(graph, part, name, 1).collect()) == 1
    # block edges and sizes after contraction are those of the merged partition
    merges = frozen(moves.merge_round(graph, part, name), "merges")
    after = partition.merge(part, merges)
    now = moves.contracted(Blocks(graph, part), after, merges)
    assert OBJECTIVES[name](now).first().objective == pytest.approx(value(graph, after, name))


def test_agglomeration_finds_planted_blocks(spark):
    graph, _, truth = planted(spark, 60, 3, 5)
    part = moves.agglomerate(graph, 3, "dckn", refine=3)
    labels = np.zeros(60, int)
    for r in part.collect():
        labels[r.node] = r.block
    assert len(set(labels)) == 3 and metrics.nmi_value(labels, truth) > 0.7


def test_agglomeration_goes_on_without_edges_between_blocks(spark):
    rows = [(2 * i, 2 * i + 1, 1.0) for i in range(5)]
    graph = Graph(spark.createDataFrame(rows, "src long, dst long, weight double"), False)
    assert moves.agglomerate(graph, 2, "skn").select("block").distinct().count() == 2
