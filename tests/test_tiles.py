"""Products by tiles against dense numpy, and the leading space of a matrix whose eigenvalues are crowded."""

import numpy as np
from pyspark.sql import functions as F

from loomgraph.operators import factor, starts, tiles
from test_starts import dense, symmetric, table


def test_products_by_many_tiles_are_the_dense_ones(spark, monkeypatch):
    monkeypatch.setattr(tiles, "TILE", 150)
    a, _ = symmetric(60, 3)
    a[np.arange(0, 60, 7), np.arange(0, 60, 7)] = 2.0
    x = tiles.tiled(table(spark, a))
    assert x.parts > 1
    q = np.random.default_rng(0).normal(size=(60, 3))
    q[::5] = 0  # these nodes have no row
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q) if v.any()], "node long, q array<double>")
    assert np.allclose(dense(tiles.times(x, rows, 3), 60), a @ q)


def test_crowded_eigenvalues_settle_in_few_products(spark):
    random = np.random.default_rng(2)
    a = np.zeros((400, 400))
    a[:80, 80:] = random.random((80, 320)) < 0.2
    a += a.T
    space, values = starts.leading_space(table(spark, a), 4, tolerance=1e-2, rounds=20)
    q = dense(space, 400)
    assert np.linalg.norm(a @ q - q * values, axis=0).max() <= 1e-2 * np.abs(values).max() * (1 + 1e-6)
    assert np.allclose(np.abs(values), np.sort(np.abs(np.linalg.eigvalsh(a)))[::-1][:4], rtol=0.02)


def test_assignment_by_tiles_is_that_of_row_joins(spark, monkeypatch):
    monkeypatch.setattr(tiles, "TILE", 150)
    a, _ = symmetric(60, 3)
    a[:, 4] = a[4] = np.arange(60) % 3 - 1.0  # negative entries, and sums of 0 that stay rows
    x, random = table(spark, a), np.random.default_rng(5)
    u = spark.createDataFrame([(i, int(v), float(w)) for i in range(60) if i % 7 for v, w in zip(random.permutation(40)[: i % 5], random.integers(-2, 3, 5))], "node long, v int, u double")
    joined = x.join(u.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node"), "v").agg(F.sum(F.col("weight") * F.col("u")).alias("u"))
    got, want = ({(r.node, r.v): round(r.u, 9) + 0.0 for r in rows.collect()} for rows in (tiles.sums(tiles.tiled(x), u), joined))
    assert got == want and 0.0 in want.values()
    plan = factor.assign(x, u)._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroupsInArrow" in plan and "(weight#" not in plan.split("CoGroupsInArrow")[0]  # no row for each entry and block is summed
