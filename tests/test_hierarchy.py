"""Levels over tables come and go as the full value says."""

import numpy as np
import pytest

from loomgraph.operators import hierarchy
from loomgraph.operators.graph import Graph
from loomgraph.operators.objectives import hierarchical, level_removal
from loomgraph.session import frozen


def nested(spark, n=48):
    """Six blocks in three pairs."""
    random = np.random.default_rng(4)
    block = np.arange(n) * 6 // n
    p = np.where(block[:, None] == block[None, :], 0.8, np.where(block[:, None] // 2 == block[None, :] // 2, 0.3, 0.02))
    src, dst = np.nonzero(np.triu(random.random((n, n)) < p, 1))
    part = spark.createDataFrame([(i, int(b)) for i, b in enumerate(block)], "node long, block int")
    return Graph(spark.createDataFrame([(int(a), int(b), 1.0) for a, b in zip(src, dst)], "src long, dst long, weight double"), False, part.select("node")).counted(), frozen(part, "part"), block


def test_levels_come_and_go_by_the_full_value(spark):
    graph, part, block = nested(spark)
    value = lambda levels: hierarchical(graph, levels, "dcpu").first().objective
    pairs = spark.createDataFrame([(b, b // 2) for b in range(6)], "node int, block int")
    one = spark.createDataFrame([(b, 0) for b in range(3)], "node int, block int")
    for k in (1, 2):  # the change by a removal is the difference of full values
        levels = [part, pairs, one]
        kept = [part, spark.createDataFrame([(b, 0) for b in range(6)], "node int, block int")] if k == 1 else [part, pairs]
        assert level_removal(graph, levels, k, "dcpu").first().objective == pytest.approx(value(kept) - value(levels), abs=1e-6)
    every = hierarchy.Hierarchy([part, spark.createDataFrame([(b, b) for b in range(6)], "node int, block int")], 0.0)
    every.value = value(every.levels)
    fewer = hierarchy.drop_levels(graph, every, "dcpu")  # a level that repeats the one below costs and goes
    assert len(fewer.levels) == 1 and fewer.value == pytest.approx(value(fewer.levels), abs=1e-6) and fewer.value > every.value


def test_search_keeps_its_value(spark):
    graph, part, block = nested(spark)
    swapped = frozen(spark.createDataFrame([(int(i), int(b ^ 1 if i % 9 == 0 else b)) for i, b in enumerate(block)], "node long, block int"), "part")
    found = hierarchy.search(graph, 6, "dcpu", swapped, most=3, steps=3)
    assert found.value == pytest.approx(hierarchical(graph, found.levels, "dcpu").first().objective, abs=1e-6)
    assert all(gain > 0 for _, gain in found.steps) and found.value >= hierarchical(graph, [swapped], "dcpu").first().objective
    pairs = spark.createDataFrame([(b, b // 2) for b in range(6)], "node int, block int")
    targets = {(r.node, r.to_block) for r in hierarchy.sibling_targets(part, pairs).collect()}
    assert targets == {(i, int(b ^ 1)) for i, b in enumerate(block)}
