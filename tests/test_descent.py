"""Colour steps of the tri-factorisation against dense numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import descent, factor, metrics
from test_starts import symmetric, table


def error2(a, z, s):
    return ((a - z @ s @ z.T) ** 2).sum()


def dense_z(z, n, r):
    out = np.zeros((n, r))
    for row in z.collect():
        out[row.node, row.v] = row.w
    return out


def given(spark, n, r, seed=0):
    random = np.random.default_rng(seed)
    return spark.createDataFrame([(i, int(random.integers(r)) if i >= r else i, float(random.random() + 0.1)) for i in range(n)], "node long, v int, w double")


def dense_s(s, r):
    out = np.zeros((r, r))
    for row in s.collect():
        out[row.k, row.l] = row.val
    return out


def test_colours_are_the_greedy_ones(spark):
    a, _ = symmetric(70, 3)
    x = table(spark, a)
    got = {r.node: r.colour for r in descent.colours(x, 5).collect()}
    order = [r.node for r in x.groupBy(F.col("src").alias("node")).count().orderBy(F.desc("count"), F.desc(F.xxhash64("node", F.lit(5))), F.desc("node")).collect()]
    want = {}
    for i in order:
        used = {want[j] for j in np.flatnonzero(a[i]) if j in want}
        want[i] = min(set(range(len(used) + 1)) - used)
    assert got == want


def test_proposals_and_joint_gains_are_those_of_dense_matrices(spark):
    a, _ = symmetric(40, 3)
    a[np.arange(0, 40, 7), np.arange(0, 40, 7)] = 2.0
    n, r, x = 40, 3, table(spark, a)
    z = factor.normalised(given(spark, n, r))
    s = factor.s_matrix(x, z)
    zd, sd, s = dense_z(z, n, r), dense_s(s, r), descent.coupling(s, z)
    colouring = descent.colours(x, 1)
    big = colouring.groupBy("colour").count().orderBy(F.desc("count")).first().colour
    moves = descent.proposals(x, z, s, colouring.where(F.col("colour") == big)).collect()
    before, after = error2(a, zd, sd), zd.copy()
    for m in moves:
        one = zd.copy()
        one[m.node] = 0
        one[m.node, m.nv] = m.nw
        assert before - error2(a, one, sd) == pytest.approx(m.gain, abs=1e-8)
        for k in range(r):  # no block and weight of a grid does better
            for w in np.linspace(0.01, 2, 60):
                grid = zd.copy()
                grid[m.node] = 0
                grid[m.node, k] = w
                assert error2(a, grid, sd) >= error2(a, one, sd) - 1e-8
        after[m.node] = 0
        after[m.node, m.nv] = m.nw
    rows = spark.createDataFrame(moves)
    assert before - error2(a, after, sd) == pytest.approx(descent.joint_gain(rows, s), abs=1e-8)
    stepped, gain = descent.colour_step(x, z, s, colouring.where(F.col("colour") == big))
    assert gain > 0 and before - error2(a, dense_z(stepped, n, r), sd) == pytest.approx(gain, abs=1e-8)


def test_half_of_the_movers_stay_where_all_would_raise_the_error(spark):
    # many nodes without entries between them that all find block 0 worth the same
    a = np.zeros((12, 12))
    a[0, 1:] = a[1:, 0] = 1.0
    x = table(spark, a)
    z = spark.createDataFrame([(0, 0, 1.0)] + [(i, 1, 0.02) for i in range(1, 12)], "node long, v int, w double")
    s = spark.createDataFrame([(0, 1, 4.0), (1, 0, 4.0), (1, 1, 3.0)], "k int, l int, val double")
    zd, sd = dense_z(z, 12, 2), dense_s(s, 2)
    after, gain = descent.colour_step(x, z, descent.coupling(s, z), spark.createDataFrame([(i,) for i in range(1, 12)], "node long"))
    assert gain > 0 and error2(a, zd, sd) - error2(a, dense_z(after, 12, 2), sd) == pytest.approx(gain, abs=1e-8)


def test_descent_falls_at_every_sweep_and_finds_the_blocks(spark):
    a, truth = symmetric(80, 3)
    x, random = table(spark, a), np.random.default_rng(1)
    noisy = np.where(random.random(80) < 0.35, random.integers(0, 3, 80), truth)
    z = spark.createDataFrame([(i, int(b), 1.0) for i, b in enumerate(noisy)], "node long, v int, w double")
    found = descent.frost(x, z, sweeps=3)
    errors = np.array(found.errors)
    assert (np.diff(errors) <= 1e-12).all() and errors[-1] < errors[0]
    zd, sd = dense_z(found.z, 80, 3), dense_s(found.s, 3)
    assert np.sqrt(error2(a, zd, sd)) / np.linalg.norm(a) == pytest.approx(errors[-1], abs=1e-9)
    assert metrics.nmi_value(zd.argmax(1), truth) > metrics.nmi_value(noisy, truth) + 0.2
