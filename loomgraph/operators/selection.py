"""Penalties and the choice of the number of blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.special import lgamma, log_binom, mdl_entropy
from loomgraph.operators import partition as P
from loomgraph.operators.objectives import Blocks, columns, total


def _free(b: Blocks):
    B = F.col("B")
    return B * B if b.graph.directed else B * (B + 1) / 2


def aic(b: Blocks, corrected: bool = False) -> DataFrame:
    B = F.col("B")
    return total([b.of_totals(_free(b) + (2 * B if corrected else B))])


def bic(b: Blocks, sparse: bool = False) -> DataFrame:
    N = F.col("N")
    return total([b.of_totals(0.5 * _free(b) * (3 if sparse else 2) * F.log(N))])


def bic_sparse(b: Blocks) -> DataFrame:
    return bic(b, True)


def icl(b: Blocks, corrected: bool = False) -> DataFrame:
    B, N = columns("B", "N")
    if corrected:
        raise NotImplementedError("there is no such score for degree-corrected models")
    pairs = B * B / 2 * F.log(N * N) if b.graph.directed else B * (B + 1) / 4 * F.log(N * (N - 1) / 2)
    return total([b.of_totals((B - 1) / 2 * F.log(N) + pairs)])


def mdl_traditional(b: Blocks) -> DataFrame:
    B, E = columns("B", "E")
    return total([b.of_totals(E * F.log(B) + _free(b) * F.log(E))])


def mdl_first(b: Blocks) -> DataFrame:
    B, E, N = columns("B", "E", "N")
    return total([b.of_totals(E * mdl_entropy(_free(b) / E) + N * F.log(B))])


def mdl(b: Blocks, corrected: bool = False) -> DataFrame:
    B, E, N, n = columns("B", "E", "N", "n")
    graph = b.count_edges() if corrected else b.graph
    parts = [b.of_totals(log_binom(B + N - 1, N) + log_binom(_free(b) + E - 1, E)), b.of_blocks(-lgamma(n + 1))]
    if corrected:
        if b.graph.directed:
            both = graph.in_out_degrees().join(b.part, "node")
            tables = [both.groupBy("block", c).agg(F.count("*").alias("m")) for c in ("din", "dout")]
        else:
            tables = [P.degree_distribution(graph, b.part).withColumnRenamed("n", "m")]
        sizes = b.stats.select("block", "n")
        parts += [t.join(sizes, "block").agg(F.sum(-F.col("m") * F.log(F.col("m") / n)).alias("v")) for t in tables]
    return total(parts)


def mdl_corrected(b: Blocks) -> DataFrame:
    return mdl(b, True)


PENALTIES = {"aic": aic, "bic": bic, "bic_sparse": bic_sparse, "icl": icl, "mdl": mdl, "mdl_corrected": mdl_corrected, "mdl_traditional": mdl_traditional, "mdl_first": mdl_first}

#: Which penalties go with an objective: Bayesian ones need none.
PLAIN, CORRECTED = ("aic", "bic", "bic_sparse", "icl", "mdl", "mdl_traditional", "mdl_first"), ("aic", "bic", "bic_sparse", "mdl_corrected", "mdl_traditional", "mdl_first")
APPLICABLE = {o: ("none",) for o in ("iclexj", "iclexu", "snr", "dcnr", "spc", "dcpu", "dcpuh")} | {"skn": PLAIN, "sps": PLAIN, "spd": PLAIN, "dckn": CORRECTED, "dcp": CORRECTED}


def select(scores: DataFrame) -> DataFrame:
    """(blocks, score): the number of blocks with the largest objective less penalty; scores: (blocks, objective, penalty), the smallest number on ties."""
    value = F.col("objective") - F.col("penalty")
    return scores.agg(F.max(F.struct(value.alias("v"), (-F.col("blocks")).alias("b"))).alias("x")).select((-F.col("x.b")).alias("blocks"), F.col("x.v").alias("score"))


def exponential_search(value, most: int) -> int:
    """The number of blocks from 1 to most with the least value(blocks): doubling while it falls, then every number between the neighbours of the best."""
    tried: dict[int, float] = {}
    get = lambda k: tried.setdefault(k, value(k)) if k not in tried else tried[k]
    k = 1
    while k * 2 <= most and get(k * 2) <= get(k):
        k *= 2
    return min(range(max(1, k // 2), min(most, 2 * k) + 1), key=lambda j: (get(j), j))
