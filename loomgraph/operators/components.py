"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import discard, frozen


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(links: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """(node, root) of every node that a link names; root is the smallest node that links reach.

    Links with a null end are ignored, repeated links and loops do no harm; a node of loops only has no row.
    Each round is two grouped minima joined back to the links, so that a node with very many links is
    summed before it is shuffled; rounds grow with the logarithm of the longest path.  The table is written to the
    shared folder after every round.
    """
    x, y = F.col(a), F.col(b)
    edges = frozen(links.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct(), "links")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = frozen(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        before, last = state, edges
        edges, state = after, _state(after)
        discard(last)
        if state == before:
            break
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
