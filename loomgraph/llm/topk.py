"""Exact top-k by inner product: a ball tree in every shard, searched by branch and bound.

Vectors are dealt into shards by a hash, and each shard builds one ball tree over its distinct vectors, past which
the queries stream in batches.  For a query the tree's nodes are visited in the order of their upper bound
q.c + |q| r and left aside once that falls below the current kth score.  The kth score is shared between shards: a
query visits one shard, then two more, then four and so on, and takes the kth score of all that it has visited along as
its floor.  Partial results hold k rows a query and shard and are merged by a grouped top-k after every round.

Equal vectors of a shard are one point of its tree that lists its 2 k smallest ids, which is all that a
query's own exclusion and ties can need; so a vector that a third of all rows repeat costs one point.

Rules: vectors that are null, empty or hold null or non-finite components take no part, as query or
candidate; vectors of another dimension than a query's are no candidates of it; null ids take no part; a
repeated id is a candidate for each of its rows (of equal rows k) and asks with its least vector; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm import common
from loomgraph.session import ship

#: Vectors of a shard, distinct vectors of a leaf.
SHARD_ROWS, LEAF = 16384, 64


class BallTree:
    """Balanced tree of balls over integer points: a heap of nodes, each with a center, a radius and a range of points."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        self.nodes: list[tuple[int, int, int, int]] = []  # from, to, left child, right child
        centers, radii = [], []
        stack = [(0, len(points), -1, 0)]
        while stack:
            a, b, parent, side = stack.pop()
            own = points[self.order[a:b]].astype(np.float64)
            center = own.mean(axis=0)
            away = np.einsum("ij,ij->i", own - center, own - center)
            at = len(self.nodes)
            self.nodes.append((a, b, -1, -1))
            centers.append(center)
            radii.append(np.sqrt(away.max()))
            if parent >= 0:
                old = self.nodes[parent]
                self.nodes[parent] = (*old[:2], at, old[3]) if side == 0 else (*old[:3], at)
            if b - a > LEAF:
                far = own[away.argmax()]
                other = own[np.einsum("ij,ij->i", own - far, own - far).argmax()]
                half = np.argpartition(own @ (other - far), (b - a) // 2)
                self.order[a:b] = self.order[a:b][half]
                mid = a + (b - a) // 2
                stack += [(mid, b, at, 1), (a, mid, at, 0)]
        self.centers, self.radii = np.array(centers), np.array(radii)
        self.points = np.ascontiguousarray(points[self.order])

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bounds of the inner product, query by node, a little above for rounding."""
        q = queries.astype(np.float64)
        norms = np.sqrt(np.einsum("ij,ij->i", q, q))
        exact = q @ self.centers.T + norms[:, None] * self.radii
        return exact + 1e-9 * (np.abs(exact) + norms[:, None] * (np.linalg.norm(self.centers, axis=1) + self.radii)) + 1e-6


def search(tree: BallTree, ids: list[np.ndarray], queries: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query's place, id, score) of at least the k best candidates of each query that reach its floor.  ids: of each point in the tree's order, ascending."""
    best: list[list[tuple[int, int]]] = [[] for _ in queries]  # (-score, id), sorted
    kth = floor.astype(np.float64).copy()
    bounds = tree.bounds(queries)
    for i in range(len(queries)):
        limit, row, found, heap = kth[i], bounds[i], best[i], [0]
        while heap:
            node = heap.pop()
            if row[node] < limit:
                continue
            a, b, left, right = tree.nodes[node]
            if left >= 0:
                heap += [right, left] if row[left] >= row[right] else [left, right]  # the better one is visited first
                continue
            scores = tree.points[a:b] @ queries[i]
            for j in np.flatnonzero(scores >= limit):
                found += [(-int(scores[j]), int(x)) for x in ids[a + j] if x != own[i]]
            if len(found) >= k:
                found.sort()
                del found[k:]
                limit = max(limit, -found[-1][0])
        best[i] = sorted(found)[:k]
    return [(i, x, -s) for i, found in enumerate(best) for s, x in found]


def quantised(rows: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v array<bigint>) with floor(scale * x) of the rows that take part."""
    v = rows[vector_col].cast("array<double>")
    fine = rows[id_col].isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(fine).select(rows[id_col].cast("long").alias("id"), F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x)).alias("v"))


def _searched(k: int):
    """For rows (shard, dim, kind, id, v, floor) that come sorted by shard, dim and kind: points (kind 0) grow a tree, past which the queries (kind 1) stream in batches."""
    names = ["query_id", "id", "score"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, points, tree, members = None, [], [], None, []
        for batch in batches:
            shard, dim, kind = (batch.column(i).to_numpy() for i in range(3))
            cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(dim) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(shard)]):
                if a == b:
                    continue
                if (shard[a], dim[a]) != last:
                    last, ids, points, tree, members = (shard[a], dim[a]), [], [], None, []
                own = batch.column(3).slice(a, b - a).to_numpy()
                v = batch.column(4).slice(a, b - a).flatten().to_numpy().reshape(b - a, dim[a])
                if not kind[a]:
                    ids.append(own)
                    points.append(v)
                    continue
                if tree is None and points:
                    tree, members = _grown(np.concatenate(ids), np.concatenate(points), k)
                    ids, points = [], []
                if tree is not None:
                    floor = np.array([-np.inf if x is None else x for x in batch.column(5).slice(a, b - a).to_pylist()], dtype=np.float64)
                    found = [(int(own[i]), x, s) for i, x, s in search(tree, members, v, own, floor, k)]
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(3)], names)

    return run


def _grown(ids: np.ndarray, points: np.ndarray, k: int) -> tuple[BallTree, list[np.ndarray]]:
    """A tree of the distinct points, and in its order the ids of each, ascending."""
    order = np.argsort(ids, kind="stable")
    distinct, back = np.unique(points[order], axis=0, return_inverse=True)
    back = back.ravel()
    # a query's own id may come first, k times at most
    members = [g[: 2 * k] for g in np.split(ids[order][np.argsort(back, kind="stable")], np.cumsum(np.bincount(back))[:-1])]
    tree = BallTree(distinct)
    return tree, [members[p] for p in tree.order]


def top_k(rows: DataFrame, is_query, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): each query's k best candidates among all rows but those with its own id.

    is_query: a condition on column id.  Components are floor(scale * x), scores exact 64-bit integers as long
    as they fit.  A query visits one shard, then two more, then four and so on; its kth score so far goes with it.
    """
    spark = rows.sparkSession
    ship(spark)
    plain = quantised(rows, id_col, vector_col, scale)
    # a row that repeats in id and vector can be listed k times at most
    once = plain.groupBy("id", "v").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("copies"))
    own = common.cut(once.select("id", "v", F.size("v").alias("dim"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy"), "quantised")
    queries = common.cut(own.where(is_query).groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")), "questions")
    shards = max(1, -(-own.count() // SHARD_ROWS))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shard = lambda *c: F.pmod(F.xxhash64(*c), F.lit(shards)).cast("int")
    points = own.select(shard("id", "v").alias("shard"), "dim", F.lit(0).alias("kind"), "id", "v", F.lit(None).cast("long").alias("floor"))
    asked, first = queries.withColumn("floor", F.lit(None).cast("long")), 0

    def best(found: DataFrame) -> DataFrame:
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
        return ranked.where(F.col("rank") <= k).select("query_id", "rank", "id", "score")

    found = None
    while first < shards:
        end = min(shards, max(1, 2 * first))
        at = F.explode(F.sequence(F.lit(first), F.lit(end - 1)))
        visits = asked.select("*", at.alias("turn")).select(F.pmod(shard("id") + F.col("turn"), F.lit(shards)).cast("int").alias("shard"), "dim", F.lit(1).alias("kind"), "id", "v", "floor")
        sorted_rows = points.unionByName(visits).repartition(max(n, 1), "shard").sortWithinPartitions("shard", "dim", "kind")
        more = common.map_rows(sorted_rows, _searched(k), "query_id long, id long, score long")
        after = common.cut(best(more if found is None else more.unionByName(found.drop("rank"))), "best")
        if found is not None:
            common.remove(spark, found)
        found, first = after, end
        asked = queries.join(found.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor")), "id", "left")
    return found.withColumnRenamed("id", id_col)
