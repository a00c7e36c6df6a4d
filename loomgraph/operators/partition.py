"""Block statistics of a partition(node, block) of a graph, as joins and group-bys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.graph import Graph, reindexed


def _with_blocks(adj: DataFrame, part: DataFrame) -> DataFrame:
    p = part.select(F.col("node").alias("src"), F.col("block").alias("r"))
    q = part.select(F.col("node").alias("dst"), F.col("block").alias("s"))
    return adj.join(p, "src").join(q, "dst")


def block_sizes(part: DataFrame) -> DataFrame:
    """(block, n)."""
    return part.groupBy("block").agg(F.count("*").alias("n"))


def block_edges(graph: Graph, part: DataFrame) -> DataFrame:
    """(r, s, e): edges from block r to s; an undirected graph's table is symmetric and its diagonal doubled.  Pairs without edges have no row."""
    return _with_blocks(graph.adj_count(), part).groupBy("r", "s").agg(F.sum("weight").alias("e"))


def block_stats(graph: Graph, part: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(block, n, k_out, k_in): sizes and degrees; undirected: k_out = k_in."""
    edges = block_edges(graph, part) if edges is None else edges
    out = edges.groupBy(F.col("r").alias("block")).agg(F.sum("e").alias("k_out"))
    into = edges.groupBy(F.col("s").alias("block")).agg(F.sum("e").alias("k_in"))
    sizes = block_sizes(part).select("block", F.col("n").cast("double").alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return sizes.join(out, "block", "left").join(into, "block", "left").select("block", "n", zero("k_out"), zero("k_in"))


def covariate_sums(graph: Graph, part: DataFrame) -> DataFrame:
    """(r, s, cov): sums of the edges' covariates; undirected: symmetric, the diagonal not doubled."""
    own = graph.edges.select("src", "dst", F.col("covariate").alias("weight"))
    both = _with_blocks(own, part)
    if not graph.directed:
        both = both.unionByName(both.where("r <> s").select("dst", "src", "weight", F.col("s").alias("r"), F.col("r").alias("s")))
    return both.groupBy("r", "s").agg(F.sum("weight").alias("cov"))


def move_context(graph: Graph, part: DataFrame) -> DataFrame:
    """(node, block, k_out, k_in): weight between a node and each block, self-loops left out; undirected: k_out = k_in."""
    plain = graph.adj_count().where("src <> dst")
    to = part.select(F.col("node").alias("other"), "block")
    out = plain.select(F.col("src").alias("node"), F.col("dst").alias("other"), F.col("weight").alias("k_out"), F.lit(0.0).alias("k_in"))
    into = plain.select(F.col("dst").alias("node"), F.col("src").alias("other"), F.lit(0.0).alias("k_out"), F.col("weight").alias("k_in"))
    return out.unionByName(into).join(to, "other").groupBy("node", "block").agg(F.sum("k_out").alias("k_out"), F.sum("k_in").alias("k_in"))


def edge_means(graph: Graph, part: DataFrame) -> DataFrame:
    """(src, dst, weight, mean): each edge of an undirected graph with what the degree-corrected model of its blocks expects: d_src d_dst e_rs / (k_r k_s)."""
    edges = block_edges(graph, part)
    k = block_stats(graph, part, edges).select("block", "k_out")
    d = graph.degrees()
    at = lambda a, b: part.join(d, "node").join(k, "block").select(F.col("node").alias(a), F.col("block").alias(b), (F.col("degree") / F.col("k_out")).alias(f"share_{a}"))
    rows = graph.edges.select("src", "dst", "weight").join(at("src", "r"), "src").join(at("dst", "s"), "dst").join(edges, ["r", "s"])
    return rows.select("src", "dst", "weight", (F.col("share_src") * F.col("share_dst") * F.col("e")).alias("mean"))


def self_loops(graph: Graph) -> DataFrame:
    """(node, loops)."""
    return graph.edges.where("src = dst").groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("loops"))


def degree_distribution(graph: Graph, part: DataFrame, probability: bool = False) -> DataFrame:
    """(block, degree, n) or, as shares of the block, (block, degree, p)."""
    seen = graph.degrees().join(part, "node").groupBy("block", "degree").agg(F.count("*").alias("n"))
    if not probability:
        return seen
    sizes = block_sizes(part).select("block", F.col("n").alias("size"))
    return seen.join(sizes, "block").select("block", "degree", (F.col("n") / F.col("size")).alias("p"))


def joint_degree_distribution(graph: Graph, part: DataFrame) -> DataFrame:
    """(block, din, dout, n)."""
    return graph.in_out_degrees().join(part, "node").groupBy("block", "din", "dout").agg(F.count("*").alias("n"))


def neighbour_blocks(edges: DataFrame) -> DataFrame:
    """(block, other): blocks joined by edges, from block_edges()."""
    both = edges.select(F.col("r").alias("block"), F.col("s").alias("other")).union(edges.select("s", "r"))
    return both.where("block <> other").distinct()


def quotient(graph: Graph, part: DataFrame) -> Graph:
    """The graph of blocks; an undirected edge between two blocks has the weight of the edges between them, a loop that of those within."""
    r, s = (F.col("r"), F.col("s")) if graph.directed else (F.least("r", "s"), F.greatest("r", "s"))
    edges = _with_blocks(graph.edges.select("src", "dst", "weight"), part).groupBy(r.alias("src"), s.alias("dst")).agg(F.sum("weight").alias("weight"))
    return Graph(edges, graph.directed, part.select(F.col("block").alias("node")).distinct())


def merge(part: DataFrame, merges: DataFrame) -> DataFrame:
    """part after merges(block, into) of blocks."""
    to = merges.select("block", "into")
    return part.join(to, "block", "left").select("node", F.coalesce("into", "block").alias("block"))


def relabelled_blocks(blocks: DataFrame) -> DataFrame:
    """(block, idx): the blocks numbered from 0 without gaps, in their order."""
    return reindexed(blocks.select("block"), "block")


def relabelled(part: DataFrame) -> DataFrame:
    """part with blocks numbered from 0 without gaps, in their order."""
    number = relabelled_blocks(part)
    return part.join(number, "block").select("node", F.col("idx").cast("int").alias("block"))


def zoom(part: DataFrame, above: DataFrame) -> DataFrame:
    """The nodes' blocks one level up; above: partition of part's blocks as nodes."""
    up = above.select(F.col("node").alias("block"), F.col("block").alias("up"))
    return part.join(up, "block").select("node", F.col("up").alias("block"))


def siblings(above: DataFrame) -> DataFrame:
    """(block, target): blocks of one level that have the same parent and so are allowed targets of each other's nodes."""
    a = above.select(F.col("node").alias("block"), F.col("block").alias("parent"))
    return a.join(a.select(F.col("block").alias("target"), "parent"), "parent").select("block", "target")


def random_partition(nodes: DataFrame, blocks: int, seed: int) -> DataFrame:
    """A random partition in which every block has a node: the first nodes of a random order take one block each."""
    order = nodes.select("node", F.xxhash64("node", F.lit(seed)).alias("u"))
    first = order.orderBy("u", "node").limit(blocks)
    named = first.select("node", (F.row_number().over(Window.orderBy("u", "node")) - 1).alias("own"))
    return nodes.select("node").join(F.broadcast(named), "node", "left").select("node", F.coalesce("own", F.pmod(F.xxhash64("node", F.lit(seed + 1)), F.lit(blocks)).cast("int")).alias("block"))
