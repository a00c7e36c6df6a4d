"""Experiment grids: run what is not finished, keep results, score them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import metrics, search
from loomgraph.operators.selection import APPLICABLE
from loomgraph.session import ship

KEY = ["graph_id", "method", "objective", "blocks", "trial"]


def unfinished(grid: DataFrame, finished: DataFrame | None) -> DataFrame:
    """Cells of a grid that finished results do not have."""
    return grid if finished is None else grid.join(finished.select(*(c for c in KEY if c in grid.columns and c in finished.columns)).distinct(), [c for c in KEY if c in grid.columns and c in finished.columns], "left_anti")


def run(edges: DataFrame, grid: DataFrame, directed: bool, store: str, seed: int = 0, seconds: float | None = None) -> DataFrame:
    """Results of the grid in Parquet at store; a second call runs only what is missing there.  Rows of errors count as finished with their status."""
    spark = edges.sparkSession
    cells = edges.select("graph_id").distinct().join(F.broadcast(grid), F.lit(True))
    try:
        done = spark.read.parquet(store)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = None
    left = unfinished(cells, done)
    per_graph = left.select("graph_id", "method", "objective", "blocks", "trial")
    if per_graph.take(1):
        one = edges.join(per_graph.select("graph_id").distinct(), "graph_id", "left_semi")
        results = search.search(one, grid, directed, seed, seconds=seconds).join(F.broadcast(per_graph), KEY, "left_semi")
        results.write.mode("append").parquet(store)
    return spark.read.parquet(store)


def check_compatible(stored: DataFrame, edges: DataFrame, old_edges: DataFrame, grid: DataFrame | None = None) -> None:
    """Raise if stored results have unknown methods or objectives, or their graphs' edges differ, or if they were run for other numbers of blocks or of trials than the grid's."""
    known = {*search.METHODS, *search.WHOLE}
    for r in stored.select("method", "objective").distinct().collect():
        if r.method not in known or (r.objective not in APPLICABLE):
            raise ValueError(f"stored results have an unknown method or objective: {r.method}, {r.objective}")
    own, old = edges.select("graph_id", "src", "dst", "weight"), old_edges.select("graph_id", "src", "dst", "weight")
    if own.exceptAll(old).take(1) or old.exceptAll(own).take(1):
        raise ValueError("the graphs of the stored results differ")
    if grid is not None:
        each = lambda df: df.groupBy("method", "objective").agg(F.sort_array(F.collect_set("blocks")).alias("blocks"), F.countDistinct("trial").alias("trials"))
        both = each(stored).join(each(grid), ["method", "objective"]).toDF("method", "objective", "blocks", "trials", "new_blocks", "new_trials")
        for r in both.where("blocks <> new_blocks or trials <> new_trials").limit(1).collect():
            raise ValueError(f"stored results of {r.method}, {r.objective} have blocks {r.blocks} and {r.trials} trials; the grid has {r.new_blocks} and {r.new_trials}")


def with_one_block(runs: DataFrame, edges: DataFrame, directed: bool) -> DataFrame:
    """runs and, for every graph, method and objective without one, the result of a single block: what a choice of the number of blocks compares with."""
    cells = runs.groupBy("graph_id", "method", "objective").agg(F.min("blocks").alias("least")).where("least > 1").drop("least")
    objectives = [r.objective for r in cells.select("objective").distinct().collect()]
    if not objectives:
        return runs
    one = search.search(edges, search.grid_of(edges.sparkSession, ["ma"], objectives, [1], 1), directed).drop("method")
    return runs.unionByName(one.join(cells, ["graph_id", "objective"]).select(*runs.columns))


def scored(runs: DataFrame, truth: DataFrame) -> DataFrame:
    """A row for each run: value, seconds, moves, nmi, nmi_arithmetic, ami, ami_max, armi against truth(graph_id, node, block)."""
    ship(runs.sparkSession)

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf["truth"].to_numpy(), pdf["block"].to_numpy()
        first = pdf.iloc[0]
        return pd.DataFrame([[*key, first["value"], first["seconds"], int(first["moves"]), first["status"], metrics.nmi_value(a, b), metrics.nmi_value(a, b, "arithmetic"), metrics.ami_value(a, b), metrics.ami_value(a, b, "max"), metrics.armi_value(b, a)]])

    both = runs.join(truth.select("graph_id", "node", F.col("block").alias("truth")), ["graph_id", "node"])
    return both.groupBy(*KEY).applyInPandas(one, "graph_id string, method string, objective string, blocks int, trial int, value double, seconds double, moves long, status string, nmi double, nmi_arithmetic double, ami double, ami_max double, armi double")


def report(scores: DataFrame) -> DataFrame:
    """Mean and sample deviation of the measures by method."""
    return metrics.summary(scores, ["method"], ["nmi", "ami", "armi", "seconds"])


def sweep(spark, build, settings: list, methods: list[str], blocks: int, graphs: int, seed: int = 0, start: str = "random") -> DataFrame:
    """scored() rows of methods over graphs build(setting, seed) -> (Graph, partition), with the setting.

    start: as in search(), or truth, from the partition that was built.
    """
    edges, truth, index = None, None, []
    for k, setting in enumerate(settings):
        for g in range(graphs):
            graph, part = build(setting, seed + 1000 * k + g)
            name = F.lit(f"{k}-{g}")
            lone = graph.isolated().select(F.col("node").alias("src"), F.lit(None).cast("long").alias("dst"), F.lit(0.0).alias("weight"))
            e = graph.edges.select("src", "dst", "weight").unionByName(lone).withColumn("graph_id", name)
            t = part.select("node", "block").withColumn("graph_id", name)
            edges, truth = (e, t) if edges is None else (edges.unionByName(e), truth.unionByName(t))
            index.append((f"{k}-{g}", float(setting) if np.isscalar(setting) else float(k)))
    grid = search.grid_of(spark, methods, ["dckn"], [blocks], 1)
    given = truth if start == "truth" else None
    rows = scored(search.search(edges, grid, False, seed, "random" if given is not None else start, given=given), truth)
    return rows.join(F.broadcast(spark.createDataFrame(index, "graph_id string, setting double")), "graph_id")
