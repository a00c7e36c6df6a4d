"""Starts as tables against dense numpy forms of the same rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import factor, metrics, order, starts
from loomgraph.session import frozen


def planted(n, blocks, seed=3, p_in=0.25, p_out=0.02):
    random = np.random.default_rng(seed)
    truth = np.arange(n) * blocks // n
    hit = np.triu(random.random((n, n)) < np.where(truth[:, None] == truth[None, :], p_in, p_out), 1)
    hit[np.arange(n - 1), np.arange(1, n)] = True
    return (hit | hit.T).astype(float) * random.integers(1, 4, (n, n)).clip(1) ** np.triu(np.ones((n, n)), 1), truth


def symmetric(n, blocks, seed=3):
    a, truth = planted(n, blocks, seed)
    a = np.triu(a, 1)
    return a + a.T, truth


def table(spark, a):
    i, j = np.nonzero(a)
    rows = [(int(p), int(q), float(a[p, q])) for p, q in zip(i, j)]
    return frozen(spark.createDataFrame(rows, "src long, dst long, weight double").repartition(4), "matrix")


def dense(w, n, name="q"):
    out = np.zeros((n, len(w.first()[name])))
    for r in w.collect():
        out[r.node] = r[name]
    return out


def vertex(a, u, p, mean, both):
    order_ = np.lexsort((np.arange(len(u)), -np.round(u, 9)))
    high, low = order_[:p], order_[len(u) - p :]
    at = high if not both or abs(np.median(u[high])) > abs(np.median(u[low])) else low
    return a[:, at].mean(1) if mean else np.median(a[:, at], axis=1)


def extended(basis, w):
    rest = w - basis @ (basis.T @ w)
    return np.column_stack([basis, rest / np.linalg.norm(rest)]) if np.linalg.norm(rest) > 1e-5 * np.linalg.norm(w) else basis


def test_leading_space_is_that_of_a_dense_solver(spark):
    a, _ = symmetric(120, 4)
    space, values = starts.leading_space(table(spark, a), 4, tolerance=1e-6)
    q = dense(space, 120)
    exact, vectors = np.linalg.eigh(a)
    at = np.argsort(-np.abs(exact))[:4]
    assert np.allclose(values, exact[at], rtol=1e-6)
    assert np.allclose(q.T @ q, np.eye(4), atol=1e-8)
    assert np.linalg.norm(q @ q.T - vectors[:, at] @ vectors[:, at].T) < 1e-3
    tiny, values = starts.leading_space(table(spark, np.ones((3, 3))), 5)
    assert np.allclose(np.abs(values[0]), 3) and len(tiny.first().q) <= 3


@pytest.mark.parametrize("mean", [True, False])
def test_svca_agrees_with_brute_force_on_500_nodes(spark, mean):
    a, truth = symmetric(500, 5)
    x, p, r = table(spark, a), 10, 5
    space = frozen(starts.leading_space(x, r, 7)[0], "space")
    got = dense(starts.svca(x, r, p, 7, mean, space), 500)
    q, random, basis = dense(space, 500), np.random.default_rng(7), np.zeros((500, 0))
    for k in range(r):
        d = q @ random.normal(size=r)
        u = a @ (d - basis @ (basis.T @ d))
        w = vertex(a, u, p, mean, True)
        assert np.allclose(got[:, k], w, atol=1e-9)
        basis = extended(basis, w)
    if mean:
        z = starts.assigned(x, starts.svca(x, r, p, 7, mean, space), r)
        labels = np.zeros(500, int)
        for row in z.collect():
            labels[row.node] = row.v
        assert metrics.nmi_value(labels, truth) > 0.9


@pytest.mark.parametrize("p", [1, 8])
def test_sspa_agrees_with_brute_force(spark, p):
    a, _ = symmetric(90, 3)
    got = dense(starts.sspa(table(spark, a), 3, p), 90)
    rest, basis = (a**2).sum(0), np.zeros((90, 0))
    for k in range(3):
        c = a[:, int(np.round(rest, 9).argmax())]
        w = vertex(a, a @ (c - basis @ (basis.T @ c)), p, True, False)
        assert np.allclose(got[:, k], w, atol=1e-9)
        basis = extended(basis, w)
        rest = np.maximum(rest - (a @ basis[:, -1]) ** 2, 0)


def test_medians_count_zeros(spark):
    random = np.random.default_rng(0)
    a = random.integers(-2, 4, (40, 40)) * (random.random((40, 40)) < np.linspace(0.1, 0.95, 40)[:, None])
    a[7] = -np.arange(40)
    x = table(spark, a.astype(float))
    for places in ([1, 2, 5, 8], [0, 3, 4, 9, 30, 31, 39]):
        picked = spark.createDataFrame([(i,) for i in places], "node long")
        got = np.zeros(40)
        for r in starts.column_median(x, picked, len(places)).collect():
            got[r.node] = r.u
        assert np.allclose(got, np.median(a[:, places], axis=1))


def test_assigned_is_the_joined_form(spark):
    a, truth = symmetric(60, 3)
    x = table(spark, a)
    part = spark.createDataFrame([(i, int(b)) for i, b in enumerate(truth)], "node long, block int")
    means = factor.block_means(x, part)
    w = means.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("v", "u"))).alias("m")).select("node", F.array(*[F.coalesce(F.col("m")[k], F.lit(0.0)) for k in range(3)]).alias("q"))
    want = {r.node: (r.v, round(r.w, 9)) for r in factor.assign(x, means).collect()}
    assert {r.node: (r.v, round(r.w, 9)) for r in starts.assigned(x, w, 3).collect()} == want


def test_running_sums_and_best_prefixes(spark):
    random = np.random.default_rng(4)
    values = random.integers(-5, 6, 1000).astype(float)
    rows = spark.createDataFrame([(i, int(random.integers(50)), v) for i, v in enumerate(values.tolist())], "id long, k int, v double").repartition(5)
    order_ = sorted(((r.k, r.id, r.v) for r in rows.collect()))
    sums, tops = np.cumsum([v for _, _, v in order_]), np.maximum.accumulate([v for _, _, v in order_])
    got = {r.id: (r.idx, r.running) for r in order.running(rows, "v", "k", "id").collect()}
    assert got == {i: (n, s) for n, ((_, i, _), s) in enumerate(zip(order_, sums))}
    assert [r.running for r in order.running(rows, "v", "k", "id", kind="max").orderBy("idx").collect()] == tops.tolist()
    best = order.best_prefix(rows, "v", "k", "id").orderBy("idx").collect()
    assert len(best) == sums.argmax() + 1 and best[-1].running == sums.max()
    assert order.best_prefix(rows.withColumn("v", -F.abs("v")), "v", "k", "id").count() == 0
    assert order.best_prefix(rows.where("id < 0"), "v", "k", "id").count() == 0 and order.numbered(rows.where("id < 0"), "id").count() == 0
