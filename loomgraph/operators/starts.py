"""Starts of the tri-factorisation as tables: leading singular space, smoothed vertex components, smoothed successive projection.

x(src, dst, weight) is the symmetric matrix.  Dense columns are arrays, a row a node.  A product with x goes over its tiles
and ends in one grouped sum with as many sums as columns; small matrices, of the columns' number, are solved on the driver.  The nodes at
an end of a direction are chosen by a distributed order, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.order import numbered
from loomgraph.operators.tiles import Tiles, tiled, times
from loomgraph.session import discard, frozen, ship

#: Columns beyond r that the iteration carries, below which a column is taken to depend on the others.
OVER, DEPENDENT = 5, 1e-10
#: Blocks of r + OVER columns that the space is let grow to; residuals under this share of the largest eigenvalue are rounding.
SPAN, LOST = 5, 1e-9
#: Tolerance of the space that random directions are drawn from: where eigenvalues lie closer, directions are as good as random within it.
SPACE = 1e-2


def normal(seed: int, k: int) -> Column:
    """A normal number by node, seed and k, from two hashes."""
    u = [(F.pmod(F.xxhash64("node", F.lit(seed), F.lit(2 * k + j)), F.lit(1 << 52)) + 0.5) / float(1 << 52) for j in (0, 1)]
    return F.sqrt(-2 * F.log(u[0])) * F.cos(2 * np.pi * u[1])


def dot(a: Column, b: Iterable[float]) -> Column:
    """Inner product of an array column and given numbers."""
    b = F.array(*[F.lit(float(v)) for v in b]) if len(b) else F.array().cast("array<double>")
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def _matrix(batch: pa.RecordBatch, at: int) -> np.ndarray:
    column = batch.column(at)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def gram(q: DataFrame, columns: int) -> np.ndarray:
    """Q' Q, from one small matrix a task."""
    ship(q.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((columns, columns))
        for batch in batches:
            m = _matrix(batch, 0)
            total += m.T @ m if len(m) else 0
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["g"])

    rows = q.select("q").mapInArrow(run, "g array<double>").select(F.posexplode("g").alias("i", "g")).groupBy("i").agg(F.sum("g").alias("g")).collect()
    out = np.zeros(columns * columns)
    for r in rows:
        out[r.i] = r.g
    return out.reshape(columns, columns)


def rotated(q: DataFrame, by: np.ndarray) -> DataFrame:
    """(node, q): Q by a small matrix from the right."""
    ship(q.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = np.ascontiguousarray(_matrix(batch, 1) @ by)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * by.shape[1], pa.int32()), pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["node", "q"])

    return q.select("node", "q").mapInArrow(run, "node long, q array<double>")


def _orthonormaliser(g: np.ndarray) -> np.ndarray:
    """M with M' g M = 1, by Gram-Schmidt in the columns' order; columns that depend on earlier ones are left out."""
    scale = np.sqrt(np.maximum(np.diag(g), 1e-300))
    c, found = g / np.outer(scale, scale), []
    for k in range(len(c)):
        e = np.eye(len(c))[k]
        for f in found + found:  # twice is enough
            e = e - f * (f @ c @ e)
        left = float(e @ c @ e)
        if left > DEPENDENT and scale[k] > 1e-150:
            found.append(e / np.sqrt(left))
    return np.stack(found, axis=1) / scale[:, None]


def _joined(frame: DataFrame, image: DataFrame, by: np.ndarray) -> DataFrame:
    """frame(node, q, z) with the columns (Q Z) by appended to q and the image's to z."""
    ship(frame.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                q, z, own = (_matrix(batch, k) for k in (1, 2, 3))
                grown = [np.hstack([q, np.hstack([q, z]) @ by]), np.hstack([z, own])]
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel())) for m in grown]
                yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["node", "q", "z"])

    return frame.join(image.withColumnRenamed("q", "own"), "node").select("node", "q", "z", "own").mapInArrow(run, "node long, q array<double>, z array<double>")


def leading_space(x: DataFrame, r: int, seed: int = 0, tolerance: float = 1e-4, rounds: int = 100, tiles: Tiles | None = None) -> tuple[DataFrame, np.ndarray]:
    """(node, q array of r) and r numbers: the eigenvectors of x with the largest absolute eigenvalues, and these, from a block Krylov space with restarts.

    A round multiplies x with the residuals of those that have not settled and adds them to the space; past SPAN columns the space is cut to its
    best ones.  It ends once the residual of each is below tolerance times the largest eigenvalue, or after so many rounds.  x of a lower
    rank gives fewer columns.  A round is one product with x, in tiles.
    """
    tiles = tiled(x) if tiles is None else tiles
    nodes, m = x.select(F.col("src").alias("node")).distinct(), r + OVER
    start = frozen(nodes.select("node", F.array(*[normal(seed, k) for k in range(m)]).alias("q")), "space")
    m = min(m, start.count())
    fit = _orthonormaliser(gram(start, r + OVER)[:m, :m])
    q, k = rotated(start.select("node", F.slice("q", 1, m).alias("q")), fit), fit.shape[1]
    frame, held = frozen(q.join(times(tiles, q, k).withColumnRenamed("q", "z"), "node"), "space"), start
    for left_rounds in range(rounds, 0, -1):
        discard(held)
        held, g = frame, gram(frame.select(F.concat("q", "z").alias("q")), 2 * k)
        fit = _orthonormaliser(g[:k, :k])
        values, vectors = np.linalg.eigh(fit.T @ (g[:k, k:] + g[k:, :k]) @ fit / 2)
        order = np.argsort(-np.abs(values))
        values, vectors = values[order], fit @ vectors[:, order]
        left = np.sqrt(np.maximum(np.einsum("ij,ij->j", vectors, g[k:, k:] @ vectors) - values**2, 0))
        open_ = np.flatnonzero(left[:r] > tolerance * max(abs(values[0]), 1e-300))
        if not len(open_) or left_rounds == 1:
            break
        if k + len(open_) > SPAN * (r + OVER):
            keep = vectors[:, : 2 * (r + OVER)]
            both = np.block([[keep, np.zeros_like(keep)], [np.zeros_like(keep), keep]])
            g, k = both.T @ g @ both, keep.shape[1]
            cut = rotated(frame.select("node", F.concat("q", "z").alias("q")), both)
            frame = cut.select("node", F.slice("q", 1, k).alias("q"), F.slice("q", k + 1, k).alias("z"))
            fit, vectors = _orthonormaliser(g[:k, :k]), np.eye(k)
        new = np.vstack([-vectors[:, open_] * values[open_], vectors[:, open_]])  # residuals, then without what the space holds of them
        new[:k] -= fit @ fit.T @ (g[:k] @ new)
        inner = new.T @ g @ new
        if np.diag(inner).max() <= (LOST * abs(values[0])) ** 2:
            break  # nothing is left but rounding
        new = new @ _orthonormaliser(inner)
        added = rotated(frame.select("node", F.concat("q", "z").alias("q")), new)
        frame = frozen(_joined(frame, times(tiles, added, new.shape[1]), new), "space")
        k += new.shape[1]
    space = frozen(rotated(frame.select("node", "q"), vectors[:, :r]), "space")
    discard(held)
    return space, values[:r]


def ends(u: DataFrame, p: int, both: bool = True) -> DataFrame:
    """(node) of the p largest u(node, u), the smaller node first on ties; or, if both, of the p smallest unless the largest have the larger absolute median."""
    order = numbered(u.select("node", "u"), F.desc("u"), "node")
    if not both:
        return order.where(F.col("idx") < p).select("node")
    order = frozen(order, "order")
    n = order.count()
    p = min(p, n)
    middle = sorted({(p - 1) // 2, p // 2})
    at = {r.idx: r.u for r in order.where(F.col("idx").isin(*middle, *[n - 1 - i for i in middle])).collect()}
    high, low = (abs(np.mean([at[i] for i in places])) for places in (middle, [n - 1 - i for i in middle]))
    return order.where(F.col("idx") < p if high > low else F.col("idx") >= n - p).select("node")


def column_mean(x: DataFrame, picked: DataFrame, p: int) -> DataFrame:
    """(node, u): mean of the picked columns of x; nodes without a row have 0."""
    return x.join(picked.select(F.col("node").alias("dst")), "dst").groupBy(F.col("src").alias("node")).agg((F.sum("weight") / p).alias("u"))


def column_median(x: DataFrame, picked: DataFrame, p: int) -> DataFrame:
    """(node, u): exact median of the picked columns of x, their zeros included; nodes without a row have 0.

    Zeros decide a row with entries in under half of the columns.  The entries of the others are ordered as one table, so that a row
    with very many is no group in one task.
    """
    own = x.where("weight <> 0").join(picked.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"), "dst", "weight")
    counts = own.groupBy("node").agg(F.count("*").alias("n"), F.sum((F.col("weight") < 0).cast("long")).alias("below")).where(2 * F.col("n") >= p)
    order = frozen(numbered(own.join(counts.select("node"), "node", "left_semi"), "node", "weight", "dst"), "order")
    first = order.groupBy("node").agg(F.min("idx").alias("first"))
    wanted = F.explode(F.array(F.lit((p - 1) // 2), F.lit(p // 2)))  # places among all p values
    places = counts.join(first, "node").select("node", "n", "below", "first", wanted.alias("m"))
    zero = (F.col("m") >= F.col("below")) & (F.col("m") < F.col("below") + p - F.col("n"))
    place = F.when(~zero, F.col("first") + F.when(F.col("m") < F.col("below"), F.col("m")).otherwise(F.col("m") - (p - F.col("n"))))
    found = places.withColumn("idx", place).join(order.select("node", "idx", "weight"), ["node", "idx"], "left")
    return found.groupBy("node").agg(F.avg(F.coalesce("weight", F.lit(0.0))).alias("u")).where("u <> 0")


def along(tiles: Tiles, d: DataFrame) -> DataFrame:
    """(node, u): x d for d(node, d)."""
    return times(tiles, d.select("node", F.array("d").alias("q")), 1).select("node", F.col("q")[0].alias("u"))


def _column(x: DataFrame, tiles: Tiles, u: DataFrame, p: int, mean: bool, both: bool) -> DataFrame:
    picked = frozen(ends(u, p, both), "picked")
    return frozen(along(tiles, picked.select("node", F.lit(1.0 / p).alias("d"))) if mean else column_median(x, picked, p), "column")


def _products(frame: DataFrame, arrays: dict[str, int], w: Column) -> dict[str, np.ndarray]:
    """Inner products of w with every column of the named arrays, and of w with itself (w)."""
    sums = [F.sum(F.col(name)[k] * w).alias(f"{name}{k}") for name, size in arrays.items() for k in range(size)]
    row = frame.agg(F.sum(w * w).alias("w"), *sums).first()
    return {name: np.array([row[f"{name}{k}"] or 0.0 for k in range(size)]) for name, size in arrays.items()} | {"w": row["w"] or 0.0}


def svca(x: DataFrame, r: int, p: int, seed: int = 0, mean: bool = True, space: DataFrame | None = None, tiles: Tiles | None = None) -> DataFrame:
    """(node, q array of r): columns of W by smoothed vertex component analysis.

    r times: a random direction of the leading space, made orthogonal to the columns found so far; the p columns of x at the end
    of its projection with the larger absolute median; their mean or median.
    """
    tiles = tiled(x) if tiles is None else tiles
    space = leading_space(x, r, seed, SPACE, tiles=tiles)[0] if space is None else space
    random, rank = np.random.default_rng(seed), len(space.first().q)
    frame, k, across = space.select("node", "q", F.array().cast("array<double>").alias("v"), F.array().cast("array<double>").alias("w")), 0, np.zeros((rank, 0))
    for _ in range(r):
        g = random.normal(size=rank)
        u = along(tiles, frame.select("node", (dot(F.col("q"), g) - dot(F.col("v"), across.T @ g)).alias("d")))
        frame, k, across = _grown(frame, _column(x, tiles, u, p, mean, True), k, across)
    return frame.select("node", F.col("w").alias("q"))


def _grown(frame: DataFrame, column: DataFrame, k: int, across: np.ndarray) -> tuple[DataFrame, int, np.ndarray]:
    """frame with the column appended to w, and what is orthogonal of it to v; across: Q' V."""
    w = F.coalesce("u", F.lit(0.0))
    both = frame.join(column, "node", "left")
    own = _products(both, {"v": k} | ({"q": len(across)} if len(across) else {}), w)
    h, left = own["v"], own["w"] - own["v"] @ own["v"]
    after = both.withColumn("w", F.concat("w", F.array(w)))
    if left > DEPENDENT * max(own["w"], 1e-300):
        norm = float(np.sqrt(left))
        after = after.withColumn("v", F.concat("v", F.array((w - dot(F.col("v"), h)) / norm)))
        if len(across):
            across = np.column_stack([across, (own["q"] - across @ h) / norm])
        k += 1
    return frozen(after.drop("u"), "frame"), k, across


def sspa(x: DataFrame, r: int, p: int, mean: bool = True, tiles: Tiles | None = None) -> DataFrame:
    """(node, q array of r): columns of W by smoothed successive projection; p = 1 is the plain one.

    The direction is the residual of the column of x with the largest one, the smallest node on ties; the p columns with the largest inner products with it are
    averaged; what is new in the average is taken from all residuals.
    """
    tiles = tiled(x) if tiles is None else tiles
    norms = x.groupBy(F.col("src").alias("node")).agg(F.sum(F.col("weight") * F.col("weight")).alias("rest"))
    empty = F.array().cast("array<double>")
    frame, k = frozen(norms.select("node", F.round("rest", 9).alias("rest"), empty.alias("v"), empty.alias("w")), "frame"), 0
    for _ in range(r):
        top = -frame.agg(F.max(F.struct("rest", (-F.col("node")).alias("m"))).alias("t")).first().t.m
        c = x.where(F.col("src") == top).groupBy(F.col("dst").alias("node")).agg(F.sum("weight").alias("c"))
        both = frame.join(c, "node", "left").withColumn("c", F.coalesce("c", F.lit(0.0)))
        d = both.select("node", (F.col("c") - dot(F.col("v"), _products(both, {"v": k}, F.col("c"))["v"])).alias("d"))
        u = along(tiles, d).withColumn("u", F.round("u", 9))
        before = k
        frame, k, _ = _grown(frame, _column(x, tiles, u, p, mean, False), k, np.zeros((0, 0)))
        if k > before:
            taken = along(tiles, frame.select("node", F.col("v")[k - 1].alias("d"))).withColumnRenamed("u", "t")
            frame = frozen(frame.join(taken, "node").withColumn("rest", F.round(F.greatest(F.col("rest") - F.col("t") * F.col("t"), F.lit(0.0)), 9)).drop("t"), "frame")
    return frame.select("node", F.col("w").alias("q"))


def assigned(x: DataFrame, w: DataFrame, r: int, tiles: Tiles | None = None) -> DataFrame:
    """(node, v, w) from W(node, q array of r): for each column of x the column of W with the largest cosine, the smallest on ties, and its least-squares weight.

    A node's inner products are one array, so that no row is repeated for each block.
    """
    norms = w.agg(*[F.sum(F.col("q")[k] * F.col("q")[k]).alias(f"n{k}") for k in range(r)]).first()
    squares = [float(norms[k] or 0.0) for k in range(r)]
    own = x.groupBy(F.col("src").alias("node")).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("nx"))
    each = times(tiled(x) if tiles is None else tiles, w, r).join(own, "node")
    scores = [F.struct(F.round(F.col("q")[k] / (squares[k] ** 0.5 * F.col("nx")), 9).alias("cos"), F.lit(-k).alias("m"), (F.col("q")[k] / squares[k]).alias("w")) for k in range(r) if squares[k] > 0]
    best = F.array_max(F.array(*scores))
    return each.select("node", best.alias("t")).select("node", (-F.col("t.m")).alias("v"), F.col("t.w").alias("w"))


def start(x: DataFrame, r: int, method: str = "SVCA", seed: int = 0) -> DataFrame:
    """z(node, v, w) by SVCA, SSPA or SPA, each block from the mean of max(2, 0.1 n / r) columns (SPA: of one)."""
    p, tiles = max(2, int(0.1 * x.select("src").distinct().count() / r)), tiled(x)
    if method == "SVCA":
        w = svca(x, r, p, seed, tiles=tiles)
    elif method in ("SSPA", "SPA"):
        w = sspa(x, r, p if method == "SSPA" else 1, tiles=tiles)
    else:
        raise ValueError(f"there is no start {method}")
    return assigned(x, w, r, tiles)
