"""Factorisation X ~ Z S Z' with one non-zero in each row of Z, on a sparse symmetric X(src, dst, weight); z(node, v, w)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.special import least_quartic
from loomgraph.operators.tiles import Tiles, sums, tiled


def check_rows(nodes: DataFrame, x: DataFrame) -> None:
    """Raise if a row of X is zero."""
    if nodes.join(x.where("weight <> 0").select(F.col("src").alias("node")), "node", "left_anti").take(1):
        raise ValueError("the matrix has a zero row: leave isolated nodes out first")


def normalised(z: DataFrame) -> DataFrame:
    """z with columns of norm 1; a zero column stays."""
    norm = z.groupBy("v").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("nw"))
    return z.join(norm, "v").select("node", "v", F.when(F.col("nw") != 0, F.col("w") / F.col("nw")).otherwise(0.0).alias("w"))


def s_matrix(x: DataFrame, z: DataFrame) -> DataFrame:
    """(k, l, val): S = Z' X Z."""
    a = z.select(F.col("node").alias("src"), F.col("v").alias("k"), F.col("w").alias("wk"))
    b = z.select(F.col("node").alias("dst"), F.col("v").alias("l"), F.col("w").alias("wl"))
    return x.join(a, "src").join(b, "dst").groupBy("k", "l").agg(F.sum(F.col("wk") * F.col("weight") * F.col("wl")).alias("val"))


def relative_error(x: DataFrame, s: DataFrame) -> DataFrame:
    """(error): norm of X - Z S Z' over that of X, from the two norms."""
    nx = x.agg(F.sum(F.col("weight") * F.col("weight")).alias("x2"))
    ns = s.agg(F.coalesce(F.sum(F.col("val") * F.col("val")), F.lit(0.0)).alias("s2"))
    return nx.join(F.broadcast(ns), F.lit(True)).select((F.sqrt(F.greatest(F.col("x2") - F.col("s2"), F.lit(0.0))) / F.sqrt("x2")).alias("error"))


def block_means(x: DataFrame, part: DataFrame, tiles: Tiles | None = None) -> DataFrame:
    """(node, v, u): the mean column of X over each block's nodes."""
    sizes = part.groupBy("block").agg(F.count("*").alias("n"))
    found = sums(tiled(x) if tiles is None else tiles, part.select("node", F.col("block").alias("v"), F.lit(1.0).alias("u")))
    return found.join(sizes.withColumnRenamed("block", "v"), "v").select("node", "v", (F.col("u") / F.col("n")).alias("u"))


def assign(x: DataFrame, columns: DataFrame, tiles: Tiles | None = None) -> DataFrame:
    """(node, v, w): each column of X goes to the column of U(node, v, u) with the largest cosine, with weight its inner product over that column's squared norm; the smallest v on ties."""
    norms = columns.groupBy("v").agg(F.sum(F.col("u") * F.col("u")).alias("q"))
    own = x.groupBy("src").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("nx"))
    inner = sums(tiled(x) if tiles is None else tiles, columns).select(F.col("node").alias("src"), "v", F.col("u").alias("ip"))
    scored = inner.join(norms, "v").join(own, "src").withColumn("cos", F.round(F.col("ip") / F.sqrt("q") / F.col("nx"), 9))
    top = scored.groupBy("src").agg(F.max(F.struct("cos", (-F.col("v")).alias("m"), (F.col("ip") / F.col("q")).alias("w"))).alias("t"))
    return top.select(F.col("src").alias("node"), (-F.col("t.m")).alias("v"), F.col("t.w").alias("w"))


def jacobi_sweep(x: DataFrame, z: DataFrame, s: DataFrame, nodes: int, blocks: int) -> DataFrame:
    """z after every node chose its best block and weight given the others as they were: the distributed form of a sweep.

    For node i and block k the error changes by S_kk^2 w^4 + b_k w^2 + c_k w, which a cubic's roots minimise.
    """
    val = s
    diagonal = val.where("k = l").select("k", F.col("val").alias("skk"))
    zs = z.join(val, z.v == val.k).select("node", F.col("l").alias("k"), (F.col("w") * F.col("val")).alias("zs"))
    reach = zs.groupBy("k").agg(F.sum(F.col("zs") * F.col("zs")).alias("wp2"))
    pull = x.where("src <> dst").join(zs.select(F.col("node").alias("dst"), "k", "zs"), "dst").groupBy(F.col("src").alias("node"), "k").agg((-4 * F.sum(F.col("weight") * F.col("zs"))).alias("c"))
    own = x.where("src = dst").select(F.col("src").alias("node"), F.col("weight").alias("xii"))
    table = pull.join(zs, ["node", "k"], "left").join(own, "node", "left").join(reach, "k").join(diagonal, "k").na.fill(0.0, ["zs", "xii"])
    b = 2 * (F.col("wp2") - F.col("zs") * F.col("zs")) - 2 * F.col("xii") * F.col("skk")
    a = F.col("skk") * F.col("skk")
    best = least_quartic(F.when(a > 1e-12, a).otherwise(1e-12), b, F.col("c"))
    valued = table.withColumn("b", b).withColumn("a", a).withColumn("w", best).where("w is not null")
    valued = valued.withColumn("value", F.col("a") * F.pow("w", 4) + F.col("b") * F.pow("w", 2) + F.col("c") * F.col("w"))
    chosen = valued.withColumn("rn", F.row_number().over(Window.partitionBy("node").orderBy("value", "k"))).where("rn = 1").select("node", F.col("k").alias("nv"), F.col("w").alias("nw"))
    return normalised(z.join(chosen, "node", "left").select("node", F.coalesce("nv", "v").alias("v"), F.coalesce("nw", F.lit((blocks / nodes) ** 0.5)).alias("w")))
