"""Near-duplicate vectors by NN-descent, with recall audited and dense groups counted exactly.

Vectors with equal components are one node.  Nodes start with neighbours from random hyperplane buckets.  A
round joins every node's list and reverse list at the node they share: members of a list are neighbours of
neighbours, all pairs with a new member are compared there, and what improves a member's own list is
sent to it.  A list whose every entry reaches the threshold is saturated and is enlarged in the next round.
Rounds go on until few lists change and an audit, which compares some nodes with all, finds enough of their links.
Where it doesn't, fresh hyperplanes start more rounds; where that fails too, or the audit meets too few links to tell, all nodes of different components are compared exactly.

Links at the threshold give components.  A saturated list drops partners, so saturated nodes of different
components are compared with each other exactly, in blocks, and what links joins components.  Within a component the links are then counted exactly, in blocks of
rows against blocks of rows, so a list's length never limits what is counted and no pairs of a group are
emitted.  Similarities that decide are computed in double precision.

Rules: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
different dimensions never link; ids are integers; rows that repeat an id are nodes of that id and give a row
each, linked like any others; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import logging
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm import common
from loomgraph.llm.components import components
from loomgraph.session import ship

LOG = logging.getLogger(__name__)

#: Entries of a list at first and after enlarging, tables of hyperplanes and their bucket size, rounds at most.
LIST, LARGER, TABLES, BUCKET, ROUNDS = 12, 48, 6, 64, 8
#: How often fresh hyperplanes are drawn while the audit finds too few links, and the nodes up to which the exact search of all is less work.
AGAIN, SMALL = 3, 65536
#: Nodes that an audit compares with all at first and at most, the links that it needs, the share of them that must be
#: found, and the share of changed lists that ends the rounds.
AUDIT, AUDIT_MOST, AUDIT_LINKS, ENOUGH, FEW_CHANGES = 256, 16384, 256, 0.99, 0.02
#: Rows of a block when links are counted, and when saturated nodes are compared.
BLOCK, BETWEEN = 1024, 4096


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    return np.ascontiguousarray(column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)) if isinstance(column, pa.ChunkedArray) else column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def directions(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array<double>) of all rows; v null for those that link with nothing."""
    v = rows[vector_col].cast("array<double>")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.select(rows[id_col].cast("long").alias("id"), F.when(fine, F.transform(v, lambda x: x + 0.0)).alias("v"))  # -0.0 is 0.0


def _units(v: np.ndarray) -> np.ndarray:
    scaled = v / np.abs(v).max(axis=1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def _codes(nodes: DataFrame, seed: int, bits: int) -> DataFrame:
    """(node, dim, u array<float>, codes array<long>): unit vectors and their side of random hyperplanes, TABLES codes of bits bits."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in _by_dim(batch, 1):
                u = _units(part)
                planes = np.random.Generator(np.random.PCG64([seed, u.shape[1]])).normal(size=(u.shape[1], TABLES * bits))
                side = (u @ planes > 0).reshape(len(u), TABLES, bits) @ (1 << np.arange(bits, dtype=np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array([u.shape[1]] * len(u), pa.int32()), pa.array(list(u.astype(np.float32)), pa.list_(pa.float32())), pa.array(list(side), pa.list_(pa.int64()))],
                    ["node", "dim", "u", "codes"],
                )

    return common.map_rows(nodes.select("node", "v"), run, "node long, dim int, u array<float>, codes array<long>")


def _by_dim(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a batch by the length of their vectors: (places, matrix)."""
    lists = batch.column(column)
    sizes = np.array(pa.compute.list_value_length(lists).to_pylist(), dtype=np.int64)
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield at, lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d)


def _best_pairs(node: np.ndarray, u: np.ndarray, new: np.ndarray, floor: np.ndarray, keep: int, threshold: float) -> tuple[np.ndarray, ...]:
    """Pairs of a group that improve a member's list: for each member its best others above its floor, at most keep."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a in range(0, len(node), BLOCK):
        near = u[a : a + BLOCK] @ u.T
        near[~(new[a : a + BLOCK, None] | new[None, :])] = -2
        near[np.arange(len(near)), np.arange(a, a + len(near))] = -2
        near[near <= floor[a : a + BLOCK, None]] = -2
        k = min(keep, len(node))
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        value = np.take_along_axis(near, best, axis=1)
        i, j = np.nonzero(value > -2)
        out.append((node[a + i], node[best[i, j]], value[i, j]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _compare(groups: DataFrame, keep: int, threshold: float) -> DataFrame:
    """(node, other, s): improving pairs within each group of rows (g, node, dim, u, new, floor)."""

    def run(rows: pa.Table) -> pa.Table:
        d = rows["dim"][0].as_py()
        node = rows["node"].to_numpy()
        _, first = np.unique(node, return_index=True)
        u = _matrix(rows["u"], d)[first]
        a, b, s = _best_pairs(node[first], u, rows["new"].to_numpy(zero_copy_only=False)[first], rows["floor"].to_numpy()[first], keep, threshold)
        return pa.table({"node": pa.array(a, pa.int64()), "other": pa.array(b, pa.int64()), "s": pa.array(s, pa.float32())})

    return groups.groupBy("g", "dim").applyInArrow(run, "node long, other long, s float")


def _trim(pairs: DataFrame, size) -> DataFrame:
    """The best entries of each node's list."""
    best = Window.partitionBy("node").orderBy(F.desc("s"), "other")
    return pairs.withColumn("place", F.row_number().over(best)).where(F.col("place") <= size)


def _sized(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with n, how many have their keys: counted before they are joined, so that Spark can split a large key."""
    return rows.join(rows.groupBy(*keys).agg(F.count("*").alias("n")), keys)


def lists(units: DataFrame, threshold: float, size: int, rounds: int, audit, begun: DataFrame | None = None) -> DataFrame:
    """(node, other, s): neighbour lists refined until they settle and audit(lists), where it can tell, is ENOUGH; begun: lists to start from besides the buckets."""
    bare = units.select("node", "dim", "u")
    bucketed = units.select("node", "dim", F.posexplode("codes").alias("t", "code"))
    # a bucket larger than BUCKET is cut at random; its parts overlap with other tables' buckets
    part = F.pmod(F.xxhash64("node", "t"), F.ceil(F.col("n") / BUCKET))
    start = _sized(bucketed, ["t", "code", "dim"]).select(F.xxhash64("t", "code", part).alias("g"), "node", F.lit(True).alias("new"), F.lit(-1.5).cast("float").alias("floor"))
    first = _compare(start.join(bare, "node"), size, threshold)
    if begun is not None:
        first = first.unionByName(begun)
    now = common.cut(_trim(first.groupBy("node", "other").agg(F.max("s").alias("s")), size).withColumn("new", F.lit(True)).withColumn("size", F.lit(size)).drop("place"), "lists")
    for step in range(rounds):
        state = now.groupBy("node").agg(F.min("s").alias("kth"), F.count("*").alias("n"), F.first("size").alias("size"))
        full = F.col("n") >= F.col("size")
        state = state.withColumn("floor", F.when(full & (F.col("kth") < threshold), F.col("kth")).otherwise(F.lit(-1.5).cast("float"))).withColumn("next", F.when(full & (F.col("kth") >= threshold), LARGER).otherwise(F.col("size")))
        state = common.cut(state, "state")
        both = now.select(F.col("node").alias("g"), F.col("other").alias("node"), "new").unionByName(now.select(F.col("other").alias("g"), "node", "new"))
        own = now.groupBy("node").agg(F.max("new").alias("new")).select(F.col("node").alias("g"), "node", "new")
        members = both.unionByName(own).groupBy("g", "node").agg(F.max("new").alias("new"))
        # a node that very many lists name would make one large group: its members are cut at random into groups
        spread = _sized(members, ["g"])
        spread = spread.withColumn("g", F.xxhash64("g", F.pmod(F.xxhash64("g", "node", F.lit(step)), F.ceil(F.col("n") / (8 * LARGER))))).drop("n")
        groups = spread.join(bare, "node").join(state.select("node", "floor"), "node", "left").withColumn("floor", F.coalesce("floor", F.lit(-1.5).cast("float")))
        found = _compare(groups, size, threshold).groupBy("node", "other").agg(F.max("s").alias("s"))
        old = now.select("node", "other", "s", F.lit(False).alias("new"))
        merged = found.join(old.select("node", "other"), ["node", "other"], "left_anti").withColumn("new", F.lit(True)).unionByName(old)
        sizes = state.select("node", F.col("next").alias("size"))
        merged = merged.join(sizes, "node", "left").withColumn("size", F.coalesce("size", F.lit(size)))
        after = common.cut(_trim(merged, F.col("size")).drop("place"), "lists")
        common.remove(units.sparkSession, now)
        now = after
        changed, total = now.agg(F.sum(F.col("new").cast("long")), F.count("*")).first()
        if (changed or 0) <= FEW_CHANGES * (total or 1):
            share = audit(now)
            if share is None or share >= ENOUGH:
                break
    return now.select("node", "other", "s")


def _true_links(nodes: DataFrame, threshold: float, size: int) -> DataFrame:
    """(node, other): all links of size nodes drawn by a hash."""
    picked = nodes.orderBy(F.xxhash64("node", F.lit(6)), "node").limit(size).select("node", "v").collect()
    by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d in {len(r.v) for r in picked}:
        own = [r for r in picked if len(r.v) == d]
        by_dim[d] = np.array([r.node for r in own], dtype=np.int64), _units(np.array([r.v for r in own], dtype=np.float64))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in _by_dim(batch, 1):
                names, asked = by_dim.get(part.shape[1], (np.empty(0, np.int64), np.empty((0, part.shape[1]))))
                i, j = np.nonzero(_units(part) @ asked.T >= threshold)
                a, b = batch.column(0).to_numpy()[at[i]], names[j]
                yield pa.RecordBatch.from_arrays([pa.array(b[a != b], pa.int64()), pa.array(a[a != b], pa.int64())], ["node", "other"])

    return common.cut(common.map_rows(nodes.select("node", "v"), run, "node long, other long"), "audit")


def _audit(nodes: DataFrame, threshold: float):
    """A check of recall: nodes drawn by a hash are compared with all, more of them until they have AUDIT_LINKS links."""
    size, everything = AUDIT, nodes.count()
    while True:
        truth = _true_links(nodes, threshold, size)
        total = truth.count()
        if total >= AUDIT_LINKS or size >= min(everything, AUDIT_MOST):
            break
        size = min(8 * size, AUDIT_MOST)
    known = total >= AUDIT_LINKS or size >= everything

    def recall(now: DataFrame) -> float | None:
        """The share of links found, None if too few to tell.  One counts if either list names it, or if one list at the threshold names both: components hold it then."""
        if not known:
            return None
        if not total:
            return 1.0
        links = now.where(F.col("s") >= threshold - 1e-3).select("node", "other")
        both = links.unionByName(links.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct()
        near = truth.join(both, ["node", "other"], "left_anti")
        first = near.join(both.select("node", F.col("other").alias("via")), "node").join(both.select(F.col("node").alias("via"), "other"), ["via", "other"], "left_semi").select("node", "other").distinct()
        return 1 - (near.count() - first.count()) / total

    return recall


def _between(members: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links that join the components of which any two members link; members: (node, root, v)."""
    rows = members.withColumn("dim", F.size("v"))
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.countDistinct("root").alias("roots")).where("roots > 1")
    sized = rows.join(F.broadcast(sizes), "dim").withColumn("blocks", F.ceil(F.col("n") / BETWEEN).cast("int"))
    mine = sized.withColumn("mine", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
    # a block meets every block once: as the left side those from its own on, as the right side those up to its own
    left = mine.select("dim", F.col("mine").alias("i"), F.explode(F.sequence(F.col("mine"), F.col("blocks") - 1)).alias("j"), "node", "root", "v")
    right = mine.select(F.col("dim").alias("dim2"), F.explode(F.sequence(F.lit(0), F.col("mine"))).alias("i2"), F.col("mine").alias("j2"), F.col("node").alias("other"), F.col("root").alias("root2"), F.col("v").alias("w"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        found: dict[tuple[int, int], tuple[int, int]] = {}
        if a.num_rows and b.num_rows:
            d = len(a["v"][0])
            x, y = _units(_matrix(a["v"], d)), _units(_matrix(b["w"], d))
            node, root, other, root2 = (t.to_numpy() for t in (a["node"], a["root"], b["other"], b["root2"]))
            for k in range(0, len(node), BLOCK):
                p, q = np.nonzero((x[k : k + BLOCK] @ y.T >= threshold) & (root[k : k + BLOCK, None] != root2[None, :]))
                _, first = np.unique(np.stack([root[k + p], root2[q]]), axis=1, return_index=True)
                for f in first:
                    found[int(root[k + p[f]]), int(root2[q[f]])] = int(node[k + p[f]]), int(other[q[f]])
        return pa.table({"a": pa.array([u for u, _ in found.values()], pa.int64()), "b": pa.array([w for _, w in found.values()], pa.int64())})

    return left.groupBy("dim", "i", "j").cogroup(right.groupBy("dim2", "i2", "j2")).applyInArrow(run, "a long, b long").distinct()


def _counted(members: DataFrame, threshold: float) -> DataFrame:
    """(node, n): the copies of other nodes that a node links with, counted in blocks; members: (g, node, v, copies), one g a component and dimension."""
    sizes = common.cut(members.groupBy("g").agg(F.count("*").alias("n")), "sizes")
    sized = common.join_hot(members.select("g", "node", "v", "copies"), sizes, ["g"]).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    own = sized.withColumn("mine", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
    left = own.select("g", "node", "v", "copies", F.col("mine").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    right = own.select(F.col("g").alias("g2"), F.col("node").alias("other"), F.col("v").alias("w"), F.col("copies").alias("more"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i2"), F.col("mine").alias("j2"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"node": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        d = len(a["v"][0])
        x, y = _units(_matrix(a["v"], d)), _units(_matrix(b["w"], d))
        node, other, more = a["node"].to_numpy(), b["other"].to_numpy(), b["more"].to_numpy()
        n = np.empty(len(node), dtype=np.int64)
        for k in range(0, len(node), BLOCK):
            near = (x[k : k + BLOCK] @ y.T >= threshold) & (node[k : k + BLOCK, None] != other[None, :])
            n[k : k + BLOCK] = near @ more
        return pa.table({"node": pa.array(node), "n": pa.array(n)})

    pairs = left.groupBy("g", "i", "j").cogroup(right.groupBy("g2", "i2", "j2")).applyInArrow(run, "node long, n long")
    return pairs.groupBy("node").agg(F.sum("n").alias("n"))


def near_duplicates(rows: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component): one row for every row: links to other rows, the smallest id that links reach."""
    spark = rows.sparkSession
    ship(spark)
    own = common.cut(directions(rows, id_col, vector_col), "vectors")
    copies = own.where("v is not null").groupBy("v").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    nodes = common.cut(copies.withColumn("node", F.xxhash64("v")), "nodes")
    total = nodes.count()
    bits = max(1, (max(1, total) // (BUCKET // 2)).bit_length())
    units = common.cut(_codes(nodes, 11, min(60, bits)), "units")
    recall = _audit(nodes, threshold)
    found = lists(units, threshold, LIST, ROUNDS, recall)
    share = recall(found)
    for again in range(1, AGAIN + 1):
        if share is None or share >= ENOUGH or total <= SMALL:
            break
        # fresh hyperplanes bring together what the first did not
        more = common.cut(_codes(nodes, 11 + again, min(60, bits)), "units")
        found = lists(more, threshold, LIST if again == 1 else LARGER, ROUNDS, recall, found)
        share = recall(found)
    sure = share is not None and share >= ENOUGH
    LOG.info("share of audited links found: %s; exact search of all nodes: %s", share, not sure)
    # lists hold single precision: candidates are taken a little below the threshold and decided in double
    vectors = nodes.select("node", "v")
    close = found.where(F.col("s") >= threshold - 1e-3).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    linked = common.cut(_decided(close, vectors, threshold), "links")
    roots = common.cut(components(linked), "roots")
    full = found.groupBy("node").agg(F.count("*").alias("n"), F.min("s").alias("kth")).where((F.col("n") >= LIST) & (F.col("kth") >= threshold - 1e-3)).select("node")
    asked = full.join(roots, "node") if sure else nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    saturated = common.cut(asked.join(vectors, "node").select("node", "root", "v"), "saturated")
    lost = common.cut(_between(saturated, threshold), "between")
    if lost.take(1):
        roots = common.cut(components(linked.unionByName(lost)), "roots")
    members = roots.join(nodes, "node").select(F.xxhash64("root", F.size("v")).alias("g"), "root", "node", "v", "copies", "first")
    counted = common.cut(_counted(members, threshold), "counted")
    least = members.groupBy("root").agg(F.min("first").alias("component"))
    named = members.select("node", "root").join(least, "root").join(counted, "node", "left").select("node", "component", F.coalesce("n", F.lit(0)).alias("n"))
    table = nodes.join(named, "node", "left").select("node", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "first").alias("component"))
    fine = common.join_hot(own.where("v is not null").select("id", F.xxhash64("v").alias("node")), table, ["node"]).select("id", "n_links", "component")
    return fine.unionByName(own.where("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component")))


def _decided(pairs: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the pairs whose cosine in double precision reaches the threshold."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _by_dim(batch, 2):
                y = batch.column(3).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(x.shape)
                keep = pa.array(at[np.einsum("ij,ij->i", _units(x), _units(y)) >= threshold])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], ["a", "b"])

    joined = pairs.join(vectors.select(F.col("node").alias("a"), F.col("v").alias("x")), "a").join(vectors.select(F.col("node").alias("b"), F.col("v").alias("y")), "b")
    return common.map_rows(joined.select("a", "b", "x", "y"), run, "a long, b long")
