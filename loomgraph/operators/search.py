"""Searches fanned out over graphs, methods and trials: one task holds one graph and trial.

A search is order-dependent within a graph, so the graph is the unit; more graphs, methods and trials spread over
the cluster.  Trial t starts from seed s + 10 t (t + 1) / 2.
"""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators import frost as FR
from loomgraph.operators import kernels as K
from loomgraph.session import ship

#: Short name: what runs on (state, random).  STEPS of the sampling names are in thousands.
METHODS = {
    "ma": lambda s, r, end: K.metropolis(s, r, 5000, end),
    **{f"mha_{k}k": (lambda s, r, end, k=k: K.metropolis_hastings(s, r, 1000 * k, end=end)) for k in (1, 10, 50, 100, 250, 500)},
    **{f"mhac_{k}k": (lambda s, r, end, k=k: K.metropolis_hastings(s, r, 1000 * k, beta=K.annealing(s, r, 1000 * k, "cauchy"), end=end)) for k in (1, 50, 250)},
    **{f"mhab_{k}k": (lambda s, r, end, k=k: K.metropolis_hastings(s, r, 1000 * k, beta=K.annealing(s, r, 1000 * k, "boltzmann"), end=end)) for k in (1, 50, 250)},
    "kl_g": lambda s, r, end: K.karrer(s, r, end=end),  # staying put is a change of 0, so no worse move is taken here either
    "kl_g_nn": lambda s, r, end: K.karrer(s, r, negative=False, end=end),
    "kl_em": lambda s, r, end: K.em(s, r, end=end),
    "kl": lambda s, r, end: K.kernighan_lin(s, r, end=end),
    "kl_nn": lambda s, r, end: K.kernighan_lin(s, r, bad_moves=3, end=end),
}
#: Those that build their own state.
WHOLE = ("pah", "pah_1k", "spectral", "spectral_norm", "frost", "svca")

RUNS = "graph_id string, method string, objective string, blocks int, trial int, node long, block int, weight double, value double, moves long, deltas long, seconds double, sweeps array<double>, status string"


def _dense(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(node ids, src, dst, weight) with nodes numbered in order; rows without dst only name a node."""
    some = pdf[pdf["dst"].notna()]
    ids = np.unique(np.concatenate([pdf["src"].to_numpy(np.int64), some["dst"].to_numpy(np.int64)]))
    return ids, np.searchsorted(ids, some["src"].to_numpy(np.int64)), np.searchsorted(ids, some["dst"].to_numpy(np.int64)), some["weight"].to_numpy(float)


def search_one(n: int, src, dst, weight, directed: bool, method: str, objective: str, blocks: int, seed: int, start: str = "random", truth=None, seconds: float | None = None):
    """(labels, weights, value, tally) of one search."""
    random, end = np.random.default_rng(seed), None if seconds is None else time.monotonic() + seconds
    if method in ("frost", "svca"):
        plain = src != dst
        x = FR.Sparse(n, np.concatenate([src, dst[plain]]), np.concatenate([dst, src[plain]]), np.concatenate([weight, weight[plain]]))
        found = FR.frost(x, blocks, random, "SVCA" if start == "random" else start, sweeps=0 if method == "svca" else 1000, delta=1e-7, seconds=seconds or 300.0)
        return found.v, found.w, -found.error, K.Tally(sweeps=found.sweeps, status=found.status)
    if method in ("spectral", "spectral_norm"):
        labels, tally = K.spectral(n, src, dst, weight, blocks, random, method.endswith("norm")), K.Tally()
    elif method in ("pah", "pah_1k"):
        s, tally = K.agglomerative(n, src, dst, weight, directed, blocks, objective, random, steps=1000 if method.endswith("1k") else 100, end=end)
        return s.b, np.ones(n), s.value(), tally
    else:
        if truth is not None:
            labels = truth
        elif start == "random":
            labels = K.random_labels(n, blocks, random)
        else:
            plain = src != dst
            x = FR.Sparse(n, np.concatenate([src, dst[plain]]), np.concatenate([dst, src[plain]]), np.concatenate([weight, weight[plain]]))
            labels = FR.initial(x, blocks, start, random)[0]
        s = K.State(n, src, dst, weight, directed, labels, blocks, objective)
        before, kept = s.value(), s.b.copy()
        tally = METHODS[method](s, random, end)
        if s.value() < before:  # the start counts too
            s.b = kept
            s.refill()
        return s.b, np.ones(n), s.value(), tally
    s = K.State(n, src, dst, weight, directed, labels, blocks, objective)
    return labels, np.ones(n), s.value(), tally


def search(edges: DataFrame, grid: DataFrame, directed: bool, seed: int = 0, start: str = "random", seconds: float | None = None, given: DataFrame | None = None) -> DataFrame:
    """RUNS rows, a row per node, of every graph and every row of grid(method, objective, blocks, trial).

    edges: (graph_id, src, dst, weight), dst null for isolated nodes.  given: partitions (graph_id, node, block) to start from, blocks
    from 0; nodes without a row are in block 0.  An error of a search is its status.
    """
    ship(edges.sparkSession)
    edges = edges.select("graph_id", "src", "dst", "weight", F.lit(None).cast("int").alias("block0"))
    if given is not None:
        edges = edges.unionByName(given.select("graph_id", F.col("node").alias("src"), F.lit(None).cast("long").alias("dst"), F.lit(0.0).alias("weight"), F.col("block").cast("int").alias("block0")))
    keys = ["graph_id", "method", "objective", "blocks", "trial"]

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        graph, method, objective, blocks, trial = key
        ids, src, dst, weight = _dense(pdf)
        began, truth = time.perf_counter(), None
        known = pdf[pdf["block0"].notna()]
        if len(known):
            truth = np.zeros(len(ids), dtype=np.int64)
            truth[np.searchsorted(ids, known["src"].to_numpy(np.int64))] = known["block0"].to_numpy(np.int64)
        try:
            b, w, value, tally = search_one(len(ids), src, dst, weight, directed, method, objective, int(blocks), seed + 5 * int(trial) * (int(trial) + 1), start, truth, seconds)
        except Exception as e:  # the other cells of the grid go on
            b, w, value, tally = np.zeros(len(ids), dtype=int), np.zeros(len(ids)), -np.inf, K.Tally(status=f"error: {e}")
        n = len(ids)
        return pd.DataFrame({
            "graph_id": [graph] * n, "method": [method] * n, "objective": [objective] * n, "blocks": np.int32(blocks), "trial": np.int32(trial), "node": ids, "block": b.astype(np.int32), "weight": w,
            "value": float(value), "moves": np.int64(tally.moves), "deltas": np.int64(tally.deltas), "seconds": time.perf_counter() - began, "sweeps": [tally.sweeps] * n, "status": [tally.status] * n,
        })

    return edges.join(F.broadcast(grid), F.lit(True)).groupBy(*keys).applyInPandas(run, RUNS)


def hierarchies(edges: DataFrame, directed: bool, kind: str = "dcpu", seed: int = 0, steps: int = 100) -> DataFrame:
    """(graph_id, level, node, block, value): nested partitions of every graph, levels from 0, each with the nodes' blocks; one task a graph."""
    ship(edges.sparkSession)

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, src, dst, weight = _dense(pdf)
        levels, _ = K.hierarchical(len(ids), src, dst, weight, directed, np.random.default_rng(seed), kind, steps=steps)
        value, labels, out = K.hierarchy_value(levels, len(ids), src, dst, weight, directed, kind), np.arange(len(ids)), []
        for at, level in enumerate(levels):
            labels = np.asarray(level)[labels]
            out.append(pd.DataFrame({"graph_id": key[0], "level": np.int32(at), "node": ids, "block": labels.astype(np.int32), "value": value}))
        return pd.concat(out)

    return edges.select("graph_id", "src", "dst", "weight").groupBy("graph_id").applyInPandas(run, "graph_id string, level int, node long, block int, value double")


def grid_of(spark, methods: list[str], objectives: list[str], blocks: list[int], trials: int) -> DataFrame:
    """All combinations."""
    return spark.createDataFrame([(m, o, b, t) for m in methods for o in objectives for b in blocks for t in range(trials)], "method string, objective string, blocks int, trial int")


def best_trials(runs: DataFrame) -> DataFrame:
    """The rows of the best trial of each search, the first on ties."""
    w = Window.partitionBy("graph_id", "method", "objective", "blocks").orderBy(F.desc("value"), "trial")
    return runs.withColumn("rank", F.dense_rank().over(w)).where("rank = 1").drop("rank")


def em_step(graph, part: DataFrame, objective: str = "dckn") -> DataFrame:
    """part after all best moves of one state at once, as tables; the last node of a block stays."""
    from loomgraph.operators.objectives import best_moves, node_deltas
    from loomgraph.operators.partition import block_sizes

    moves = best_moves(node_deltas(graph, part, objective))
    # a block that all its nodes would leave keeps the one with the largest number
    leaving = moves.groupBy("from_block").agg(F.count("*").alias("leaving"), F.max("node").alias("stays"))
    emptied = block_sizes(part).join(leaving, F.col("block") == F.col("from_block")).where("n = leaving").select("stays")
    kept = moves.join(emptied, F.col("node") == F.col("stays"), "left_anti")
    return part.join(kept.select("node", "to_block"), "node", "left").select("node", F.coalesce("to_block", "block").alias("block"))


def em_tables(graph, part: DataFrame, objective: str = "dckn", steps: int = 100) -> tuple[DataFrame, int]:
    """(partition, steps): em_step() until the objective no longer improves, the state cut in the shared folder at every step."""
    from loomgraph.operators.objectives import OBJECTIVES, Blocks
    from loomgraph.session import shared_root

    shared_root(part.sparkSession)
    now = part.select("node", "block").checkpoint()
    value = OBJECTIVES[objective](Blocks(graph, now)).first().objective
    for step in range(steps):
        after = em_step(graph, now, objective).checkpoint()
        better = OBJECTIVES[objective](Blocks(graph, after)).first().objective
        if better <= value + 1e-9:
            return now, step
        now, value = after, better
    return now, steps
