"""Block edge counts of a stream of edges, kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_edges(edges: DataFrame, part: DataFrame, directed: bool) -> DataFrame:
    """(r, s, e) of a streaming edge table joined to a static partition; for the update or complete mode."""
    p = part.select(F.col("node").alias("src"), F.col("block").alias("r"))
    q = part.select(F.col("node").alias("dst"), F.col("block").alias("s"))
    both = edges.select("src", "dst", "weight").join(p, "src").join(q, "dst").select("r", "s", "weight")
    if not directed:
        ends = F.explode(F.array(F.struct("r", "s"), F.struct(F.col("s").alias("r"), F.col("r").alias("s"))))
        both = both.select(ends.alias("x"), "weight").select("x.r", "x.s", "weight")
    return both.groupBy("r", "s").agg(F.sum("weight").alias("e"))
