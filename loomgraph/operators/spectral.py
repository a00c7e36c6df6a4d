"""Spectral partitions as tables: embeddings by orthogonal iteration, k-means by grouped sums.

x(src, dst, weight) is the symmetric matrix; points are (node, q array<double>).  The driver holds r x r matrices and the centers only.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.sampling import race
from loomgraph.operators.starts import OVER, _orthonormaliser, gram, leading_space, normal, rotated
from loomgraph.operators.tiles import tiled, times
from loomgraph.session import discard, frozen

#: Imaginary parts up to this share of a value's size count as none.
REAL = 1e-6


def adjacency(x: DataFrame, r: int, seed: int = 0, tolerance: float = 1e-4) -> DataFrame:
    """(node, q): rows of x's r leading eigenvectors, each of norm 1 unless it is zero."""
    space = leading_space(x, r, seed, tolerance)[0]
    norm = F.sqrt(F.aggregate("q", F.lit(0.0), lambda s, v: s + v * v))
    return space.withColumn("__n", norm).select("node", F.transform("q", lambda v: v / F.greatest("__n", F.lit(1e-12))).alias("q"))


def non_backtracking(x: DataFrame, r: int, seed: int = 0, tolerance: float = 1e-4, rounds: int = 100) -> DataFrame:
    """(node, q): lower halves of the eigenvectors of [[0, D - 1], [-1, x]] with the r real eigenvalues of largest size.

    A column of length 2 n is two numbers a node.  The iteration ends once the residuals of these are below tolerance times the largest, or after so many rounds.
    """
    degrees = x.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("d"))
    m, tiles = r + OVER, tiled(x)
    halves = lambda at, size: (F.slice("q", at * size + 1, size))
    start = frozen(degrees.select("node", "d", F.array(*[normal(seed, k) for k in range(2 * m)]).alias("q")), "space")

    def inner(z: DataFrame, parts: int, size: int) -> np.ndarray:
        """Gram matrix of columns that lie as upper and lower halves, one after the other, in q."""
        g = gram(z, 2 * parts * size).reshape(parts, 2, size, parts, 2, size)
        return sum(g[:, h, :, :, h, :] for h in (0, 1)).reshape(parts * size, parts * size)

    def turned(z: DataFrame, by: np.ndarray) -> DataFrame:
        return rotated(z, np.kron(np.eye(2), by))

    fit = _orthonormaliser(inner(start, 1, m))
    held, q, m = start, turned(start, fit), fit.shape[1]
    for _ in range(rounds):
        low = times(tiles, q.select("node", halves(1, m).alias("q")), m).withColumnRenamed("q", "y")
        both = q.join(low, "node").join(degrees, "node")
        up = F.transform(halves(1, m), lambda v: (F.col("d") - 1) * v)
        z = frozen(both.select("node", F.concat("q", up, F.zip_with("y", halves(0, m), lambda a, b: a - b)).alias("q")), "space")
        discard(held)
        held, g = z, inner(z, 2, m)
        qq, qz, zz = g[:m, :m], g[:m, m:], g[m:, m:]
        values, vectors = np.linalg.eig(np.linalg.solve(qq, qz))
        real = np.flatnonzero(np.abs(values.imag) <= REAL * np.abs(values).max())
        top = real[np.argsort(-np.abs(values[real].real))][:r]
        s, v = vectors[:, top].real, values[top].real
        left = np.einsum("ij,ij->j", s, zz @ s) - v * np.einsum("ij,ij->j", s, (qz + qz.T) @ s) + v**2 * np.einsum("ij,ij->j", s, qq @ s)
        own, image = (z.select("node", F.slice("q", 2 * m * k + 1, 2 * m).alias("q")) for k in (0, 1))
        if len(top) == min(r, m) and (np.sqrt(np.maximum(left, 0)) <= tolerance * np.abs(v).max()).all():
            break
        order = np.argsort(-np.sqrt(np.diag(zz)))
        fit = np.eye(m)[:, order] @ _orthonormaliser(zz[np.ix_(order, order)])
        q, m = turned(image, fit), fit.shape[1]
    lower = own.select("node", halves(1, m).alias("q"))
    return frozen(rotated(lower, s), "space")


def _distance(center: np.ndarray):
    return F.aggregate(F.zip_with("q", F.array(*[F.lit(float(c)) for c in center]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)


def k_means(points: DataFrame, k: int, seed: int = 0, rounds: int = 100) -> DataFrame:
    """(node, block) of points(node, q): spread-out starting points, each drawn by its squared distance from those before; then grouped means until these rest.

    A cluster that loses its points keeps its center.  Ties go to the smaller block.
    """
    points = frozen(points.select("node", "q"), "points")
    first = race(points.select("node", F.lit(0).alias("one"), F.lit(1.0).alias("w")), ["one"], ["node"], "w", seed)
    centers = [np.array(points.join(F.broadcast(first), "node").first().q)]  # one row
    size = len(centers[0])
    near = frozen(points.withColumn("d", _distance(centers[0])), "near")
    for j in range(1, k):
        drawn = race(near.select("node", F.lit(0).alias("one"), "d"), ["one"], ["node"], "d", seed + j)
        row = near.join(F.broadcast(drawn), "node").first()
        if row is None:  # fewer distinct points than blocks
            break
        centers.append(np.array(row.q))
        after = frozen(near.withColumn("d", F.least("d", _distance(centers[-1]))), "near")
        discard(near)
        near = after

    def labelled() -> DataFrame:
        return points.withColumn("block", F.array_min(F.array(*[F.struct(_distance(c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centers)]))["i"])

    for _ in range(rounds):
        moved, means = 0.0, labelled().groupBy("block").agg(*[F.avg(F.col("q")[i]).alias(f"q{i}") for i in range(size)]).collect()  # a row a block
        for row in means:
            mean = np.array(row[1:])
            moved = max(moved, float(np.abs(mean - centers[row.block]).max()))
            centers[row.block] = mean
        if moved < 1e-9:
            break
    return labelled().select("node", "block")


def spectral(x: DataFrame, blocks: int, seed: int = 0, normalised: bool = False) -> DataFrame:
    """(node, block) by k-means on the rows of the non-backtracking operator's eigenvectors, or (normalised) of the matrix's own."""
    x = frozen(x, "matrix")
    return k_means(adjacency(x, blocks, seed) if normalised else non_backtracking(x, blocks, seed), blocks, seed)
