"""Spectral partitions as tables against dense solvers."""

import numpy as np
import pytest

from loomgraph.operators import metrics, spectral
from test_starts import symmetric, table


def labels_of(part, n):
    out = np.zeros(n, int)
    for r in part.collect():
        out[r.node] = r.block
    return out


def test_non_backtracking_space_is_that_of_a_dense_solver(spark):
    a, _ = symmetric(150, 3)
    got = np.zeros((150, 3))
    for r in spectral.non_backtracking(table(spark, a), 3, tolerance=1e-6).collect():
        got[r.node] = r.q
    d = a.sum(1)
    values, vectors = np.linalg.eig(np.block([[np.zeros((150, 150)), np.diag(d - 1)], [-np.eye(150), a]]))
    real = np.flatnonzero(np.abs(values.imag) < 1e-9)
    want = vectors[150:, real[np.argsort(-np.abs(values[real].real))][:3]].real
    q, p = (np.linalg.qr(m)[0] for m in (got, want))
    assert np.linalg.norm(q @ q.T - p @ p.T) < 1e-3


@pytest.mark.parametrize("normalised", [False, True])
def test_blocks_of_500_nodes_are_found(spark, normalised):
    a, truth = symmetric(500, 4)
    assert metrics.nmi_value(labels_of(spectral.spectral(table(spark, a), 4, 1, normalised), 500), truth) > 0.98


def test_k_means_rests_at_a_local_optimum(spark):
    random = np.random.default_rng(3)
    points = np.concatenate([random.normal(size=(60, 2)) + c for c in ((0, 0), (9, 0), (0, 9))])
    rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "node long, q array<double>").repartition(3)
    labels = labels_of(spectral.k_means(rows, 3, 2), 180)
    centers = np.array([points[labels == k].mean(0) for k in range(3)])
    assert (((points[:, None] - centers[None]) ** 2).sum(2).argmin(1) == labels).all()
    assert metrics.nmi_value(labels, np.arange(180) // 60) > 0.95
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "node long, q array<double>")
    assert {r.block for r in spectral.k_means(same, 3).collect()} == {0}
