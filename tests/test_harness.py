"""The harness: one-block rows, compatibility of stored results, starts from the truth."""

import math

import pytest
from pyspark.sql import functions as F

from loomgraph.functions.special import bernoulli_pmf, poisson_pmf
from loomgraph.operators import generators, search
from loomgraph.operators.objectives import OBJECTIVES, Blocks
from loomgraph.plans import harness


def test_one_block_and_compatibility(spark):
    graph, part = generators.planted(spark, 24, 2, 0.6, 0.05, 3)
    edges = graph.edges.select(F.lit("g").alias("graph_id"), "src", "dst", "weight")
    grid = search.grid_of(spark, ["ma"], ["dckn"], [2], 2)
    runs = search.search(edges, grid, False)
    every = harness.with_one_block(runs, edges, False)
    one = every.where("blocks = 1").collect()
    own = graph.nodes.join(edges.select(F.col("src").alias("node")).union(edges.select("dst")), "node", "left_semi").withColumn("block", F.lit(0))
    assert len(one) == own.count() and one[0].method == "ma"
    assert one[0].value == pytest.approx(OBJECTIVES["dckn"](Blocks(graph, own)).first().objective)
    assert harness.with_one_block(every, edges, False).count() == every.count()
    harness.check_compatible(runs, edges, edges, grid)
    for other in (search.grid_of(spark, ["ma"], ["dckn"], [2, 3], 2), search.grid_of(spark, ["ma"], ["dckn"], [2], 3)):
        with pytest.raises(ValueError, match="trials"):
            harness.check_compatible(runs, edges, edges, other)


def test_sweep_from_the_truth_keeps_it(spark):
    build = lambda p, seed: generators.planted(spark, 30, 3, p, 0.02, seed)
    rows = harness.sweep(spark, build, [0.7], ["kl_g_nn"], 3, 1, start="truth").collect()
    assert rows[0].nmi > 0.95


def test_mass_functions(spark):
    row = spark.range(1).select(*[poisson_pmf(F.lit(k), F.lit(1.5)).alias(f"p{k}") for k in (-1, 0, 3)], poisson_pmf(F.lit(0), F.lit(0.0)).alias("z"), *[bernoulli_pmf(F.lit(k), F.lit(0.3)).alias(f"b{k}") for k in (0, 1, 2)]).first()
    assert tuple(row) == pytest.approx((0, math.exp(-1.5), math.exp(-1.5) * 1.5**3 / 6, 1, 0.7, 0.3, 0))
