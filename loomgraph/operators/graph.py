"""Graphs as tables: edges(src, dst, weight[, covariate]) and what follows from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _both_ways() -> tuple[Column, Column]:
    """An edge as it is, and turned round."""
    return F.struct("src", "dst", "weight"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")


@dataclass(frozen=True)
class Graph:
    """A graph.  edges: one row per edge (undirected: in either direction), parallel edges add up; nodes: column node, or null for the ends of edges."""

    edges: DataFrame
    directed: bool
    vertices: DataFrame | None = None

    @property
    def nodes(self) -> DataFrame:
        if self.vertices is not None:
            return self.vertices.select("node").distinct()
        return self.edges.select(F.col("src").alias("node")).union(self.edges.select("dst")).distinct()

    def adj_count(self) -> DataFrame:
        """(src, dst, weight) as counted for blocks: undirected edges in both directions, a self-loop twice."""
        return self.edges.select("src", "dst", "weight") if self.directed else self.edges.select(F.inline(F.array(*_both_ways())))  # the edges are read once

    def adj_matrix(self) -> DataFrame:
        """(src, dst, weight) as a symmetric matrix: a self-loop once."""
        there, back = _both_ways()
        pairs = self.edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("weight").alias("weight"))  # half of the rows
        return pairs.select(F.inline(F.when(F.col("src") == F.col("dst"), F.array(there)).otherwise(F.array(there, back))))

    def multiplicities(self) -> DataFrame:
        """(i, j, a): edges between two nodes, undirected pairs once."""
        i, j = (F.col("src"), F.col("dst")) if self.directed else (F.least("src", "dst"), F.greatest("src", "dst"))
        return self.edges.groupBy(i.alias("i"), j.alias("j")).agg(F.sum("weight").alias("a"))

    def counted(self) -> Graph:
        """The graph with one row of edges for each pair of nodes, undirected pairs with the smaller node first, frozen: the edges are read once."""
        from loomgraph.session import frozen

        rows = self.multiplicities().select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("a").alias("weight"))
        return Graph(frozen(rows, "edges"), self.directed, self.vertices)

    def degrees(self) -> DataFrame:
        """(node, degree): of an undirected graph, self-loops count 2; of a directed one, in and out together."""
        if not self.directed:
            seen = self.adj_count().groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("degree"))
        else:
            ends = self.edges.select(F.col("src").alias("node"), "weight").unionByName(self.edges.select(F.col("dst").alias("node"), "weight"))
            seen = ends.groupBy("node").agg(F.sum("weight").alias("degree"))
        return self.nodes.join(seen, "node", "left").select("node", F.coalesce("degree", F.lit(0.0)).alias("degree"))

    def in_out_degrees(self) -> DataFrame:
        """(node, din, dout)."""
        out = F.struct(F.col("src").alias("node"), F.lit(0.0).alias("i"), F.col("weight").cast("double").alias("o"))
        into = F.struct(F.col("dst").alias("node"), F.col("weight").cast("double").alias("i"), F.lit(0.0).alias("o"))
        ends = self.adj_count().select(F.inline(F.array(out, into)))
        seen = ends.groupBy("node").agg(F.sum("i").alias("din"), F.sum("o").alias("dout"))
        return self.nodes.join(seen, "node", "left").select("node", F.coalesce("din", F.lit(0.0)).alias("din"), F.coalesce("dout", F.lit(0.0)).alias("dout"))

    def isolated(self) -> DataFrame:
        """Nodes without any edge."""
        ends = self.edges.select(F.col("src").alias("node")).union(self.edges.select("dst"))
        return self.nodes.join(ends, "node", "left_anti")

    def connected(self) -> Graph:
        """The graph without isolated nodes."""
        return Graph(self.edges, self.directed, self.nodes.join(self.isolated(), "node", "left_anti"))

    def neighbours(self) -> DataFrame:
        """(node, other): successors and predecessors without repetition, without the node itself."""
        both = self.edges.select("src", "dst").union(self.edges.select("dst", "src")).toDF("node", "other")
        return both.where("node <> other").distinct()

    def collapsed(self) -> Graph:
        """Simple graph: parallel edges and directions of undirected pairs become one edge of weight 1, self-loops stay."""
        return Graph(self.multiplicities().select(F.col("i").alias("src"), F.col("j").alias("dst"), F.lit(1.0).alias("weight")), self.directed, self.vertices)

    def xor(self, noise: DataFrame) -> Graph:
        """Edges of exactly one of this simple graph and noise(src, dst)."""
        own = self.collapsed().edges.select("src", "dst")
        i, j = (F.col("src"), F.col("dst")) if self.directed else (F.least("src", "dst"), F.greatest("src", "dst"))
        other = noise.select(i.alias("src"), j.alias("dst")).distinct()
        left = own.join(other, ["src", "dst"], "left_anti").unionByName(other.join(own, ["src", "dst"], "left_anti"))
        return Graph(left.withColumn("weight", F.lit(1.0)), self.directed, self.vertices)

    def largest_component(self) -> Graph:
        """The largest (weakly) connected component, the one of the smallest node on ties."""
        from loomgraph.operators.components import components

        roots = components(self.edges, "src", "dst")
        named = self.nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
        best = named.groupBy("root").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "root").limit(1)
        kept = named.join(F.broadcast(best), "root").select("node")
        return Graph(self.edges.join(kept, self.edges.src == kept.node, "left_semi"), self.directed, kept)


def reindexed(nodes: DataFrame, by: str = "node") -> DataFrame:
    """(by, idx): dense numbers from 0 in order, without gathering the rows in one task: offsets of range partitions."""
    spark = nodes.sparkSession
    from loomgraph.session import frozen

    # frozen, as the numbers of its partitions are used twice
    dealt = frozen(nodes.select(by).distinct().repartitionByRange(by).sortWithinPartitions(by).withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id()), "dealt")
    sizes = dealt.groupBy("__p").agg(F.count("*").alias("n"), F.min("__m").alias("__first")).orderBy("__p").collect()
    at, rows = 0, []
    for r in sizes:
        rows.append((r["__p"], at - r["__first"]))
        at += r.n
    shift = F.broadcast(spark.createDataFrame(rows, "__p int, shift long")) if rows else spark.createDataFrame([], "__p int, shift long")
    return dealt.join(shift, "__p").select(by, (F.col("__m") + F.col("shift")).alias("idx"))
