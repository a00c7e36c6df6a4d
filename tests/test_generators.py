"""Gap-skipping generators: every cell has its own chance, and work follows the edges."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import generators


@pytest.mark.parametrize("n2, same, loops, count", [(7, False, False, 35), (0, True, False, 45), (0, True, True, 55)])
def test_cells_are_numbered_once_each(n2, same, loops, count):
    i, j = generators._cells(np.arange(count), n2, same, loops)
    pairs = set(zip(i.tolist(), j.tolist()))
    assert len(pairs) == count
    want = {(a, b) for a in range(5) for b in range(7)} if not same else {(a, b) for a in range(10) for b in range(10) if a < b or loops and a == b}
    assert pairs == want
    big = 10**15
    i, j = generators._cells(np.array([big, big + 1]), 0, True, True)
    assert (i + j * (j + 1) // 2 == [big, big + 1]).all() and (i <= j).all()


def test_gaps_hit_every_cell_with_the_chance():
    random = np.random.default_rng(0)
    counts = np.zeros(50)
    for _ in range(4000):
        counts[generators._hits(random, 0.3, 10, 60) - 10] += 1
    assert abs(counts / 4000 - 0.3).max() < 0.04
    assert generators._hits(random, 1.0, 2, 5).tolist() == [2, 3, 4] and len(generators._hits(random, 1e-12, 0, 10)) == 0


@pytest.mark.parametrize("directed, loops", [(False, False), (False, True), (True, False), (True, True)])
def test_edges_have_their_own_chances(spark, monkeypatch, directed, loops):
    monkeypatch.setattr(generators, "STRETCH", 20)
    weights, copies = [0.4, 1.0, 1.7, 3.0, 5.0], 120
    # many copies of five nodes, each copy with blocks of its own
    nodes = spark.createDataFrame([(100 * c + 10 * i, 2 * c + i % 2, w) for c in range(copies) for i, w in enumerate(weights)], "node long, block int, weight double")
    p = np.array([[0.05, 0.02], [0.03 if directed else 0.02, 0.08]])
    edges = generators.bernoulli(nodes, np.kron(np.eye(copies), p), 5, directed, loops).edges
    counts = {(r.i, r.j): r.n for r in edges.groupBy((F.col("src") % 100 / 10).cast("int").alias("i"), (F.col("dst") % 100 / 10).cast("int").alias("j")).agg(F.count("*").alias("n")).collect()}
    for i in range(5):
        for j in range(5):
            allowed = (loops or i != j) and (directed or i <= j)
            want = min(1.0, p[i % 2, j % 2] * weights[i] * weights[j]) if allowed else 0.0
            assert abs(counts.get((i, j), 0) / copies - want) < 4 * (want * (1 - want) / copies) ** 0.5 + 1e-9, (i, j)


def test_work_follows_the_edges(spark):
    n, degree = 100_000, 10
    nodes = generators.degree_weights(generators.equal_blocks(spark, n, 4), 2.0, 30.0, 2.5, 1)
    total = nodes.agg(F.sum("weight")).first()[0]
    p = np.full((4, 4), degree * n / total**2)
    began = time.perf_counter()
    graph = generators.bernoulli(nodes, p, 3)
    rows = graph.edges.join(nodes.select(F.col("node").alias("src"), "weight"), "src").agg(F.count("*").alias("n"), F.countDistinct("src", "dst").alias("d")).first()
    assert rows.n == rows.d and abs(rows.n / (degree * n / 2) - 1) < 0.02
    assert time.perf_counter() - began < 200  # 5 x 10^9 pairs


def test_girvan_newman_series(spark):
    for z in (0, 0.5, 8, 16):
        _, p_in, p_out = generators.chances(z)
        assert p_out == pytest.approx(z / 96) and p_in == pytest.approx((16 - z) * 128 / 4224)
    assert generators.chances(2, True)[1] == pytest.approx(0.25) and generators.chances(8, True)[1] == 0
    edges, blocks = generators.girvan_newman(spark, 1, most=1, networks=2)
    assert blocks.select("graph_id").distinct().count() == 6 and blocks.count() == 6 * 128
    sizes = {r.graph_id: r["count"] for r in edges.groupBy("graph_id").count().collect()}
    assert all(abs(c - 16 * 64 * 31 / 33) < 150 for c in sizes.values())
