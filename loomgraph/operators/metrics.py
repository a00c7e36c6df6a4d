"""Agreement of two partitions, modularity, and summaries of runs."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.special import lgamma, xlogx
from loomgraph.operators.graph import Graph
from loomgraph.session import frozen, sized

#: Deviations from its mean within which a count of the hypergeometric distribution is summed.
SPREAD = 15.0


def contingency(a: DataFrame, b: DataFrame) -> DataFrame:
    """(x, y, n): nodes in block x of a and y of b."""
    both = a.select("node", F.col("block").alias("x")).join(b.select("node", F.col("block").alias("y")), "node")
    return both.groupBy("x", "y").agg(F.count("*").alias("n"))


def entropy(part: DataFrame) -> DataFrame:
    """(h): entropy of block sizes, natural logarithm."""
    sizes = part.groupBy("block").agg(F.count("*").cast("double").alias("n"))
    return sizes.agg((F.log(F.sum("n")) - F.sum(xlogx(F.col("n"))) / F.sum("n")).alias("h"))


def information(table: DataFrame) -> DataFrame:
    """(n, hx, hy, i): nodes, entropies and mutual information of a contingency table, each margin grouped once."""
    sums = table.agg(F.sum("n").cast("double").alias("n"), F.sum(xlogx(F.col("n").cast("double"))).alias("xy"))
    x = table.groupBy("x").agg(F.sum("n").cast("double").alias("m")).agg(F.sum(xlogx(F.col("m"))).alias("x"))
    y = table.groupBy("y").agg(F.sum("n").cast("double").alias("m")).agg(F.sum(xlogx(F.col("m"))).alias("y"))
    one = sums.join(F.broadcast(x), F.lit(True)).join(F.broadcast(y), F.lit(True))  # one row each
    n, ln = F.col("n"), F.log("n")
    return one.select("n", (ln - F.col("x") / n).alias("hx"), (ln - F.col("y") / n).alias("hy"), (ln + (F.col("xy") - F.col("x") - F.col("y")) / n).alias("i"))


def nmi(a: DataFrame, b: DataFrame, average: str = "sqrt") -> DataFrame:
    """(nmi): mutual information over the geometric (sqrt), arithmetic, or larger (max) entropy; 0 where that is 0, for the arithmetic one 1 if both are 0."""
    row = information(contingency(a, b))
    of = {"sqrt": F.sqrt(F.greatest(F.col("hx") * F.col("hy"), F.lit(0.0))), "arithmetic": (F.col("hx") + F.col("hy")) / 2, "max": F.greatest("hx", "hy")}[average]
    return row.select(F.when(of > 1e-15, F.col("i") / of).otherwise(0.0 if average == "sqrt" else 1.0).alias("nmi"))


def modularity_by_block(graph: Graph, part: DataFrame) -> DataFrame:
    """(block, q): each block's share of the modularity of an undirected graph."""
    from loomgraph.operators.partition import block_edges, block_stats

    edges = block_edges(graph, part)
    inside = edges.where("r = s").select(F.col("r").alias("block"), F.col("e").alias("inside"))
    total = F.broadcast(edges.agg(F.sum("e").alias("m2")))
    rows = block_stats(graph, part, edges).join(inside, "block", "left").join(total, F.lit(True))
    return rows.select("block", (F.coalesce("inside", F.lit(0.0)) / F.col("m2") - F.pow(F.col("k_out") / F.col("m2"), 2)).alias("q"))


def modularity(graph: Graph, part: DataFrame) -> DataFrame:
    """(q)."""
    return modularity_by_block(graph, part).agg(F.sum("q").alias("q"))


def expected_information_table(t: DataFrame) -> DataFrame:
    """(e): mean mutual information over all tables with the margins of contingency() t (hypergeometric).

    Blocks of equal size share their terms, so pairs of distinct sizes are joined.  A pair's counts k are taken within
    SPREAD deviations of their mean, beyond which less than e^-100 of them lies: their number grows with the root of the sizes.
    """
    margins = {c: t.groupBy(c).agg(F.sum("n").cast("double").alias("s")).groupBy("s").agg(F.count("*").alias(f"m{c}")).withColumnRenamed("s", f"s{c}") for c in ("x", "y")}
    a, b, n, k = F.col("sx"), F.col("sy"), F.col("N"), F.col("k")
    pairs = margins["x"].crossJoin(sized(margins["y"], 32)).crossJoin(F.broadcast(t.agg(F.sum("n").cast("double").alias("N"))))
    mean = a * b / n
    wide = SPREAD * F.sqrt(mean * (1 - a / n) * (1 - b / n)) + SPREAD**2
    low, high = F.greatest(F.lit(1.0), a + b - n, F.floor(mean - wide)), F.least(a, b, F.ceil(mean + wide))
    terms = pairs.select("*", F.explode(F.sequence(low.cast("long"), high.cast("long"))).alias("k"))
    chance = lgamma(a + 1) + lgamma(b + 1) + lgamma(n - a + 1) + lgamma(n - b + 1) - lgamma(n + 1) - lgamma(k + 1) - lgamma(a - k + 1) - lgamma(b - k + 1) - lgamma(n - a - b + k + 1)
    return terms.agg(F.coalesce(F.sum(F.col("mx") * F.col("my") * k / n * F.log(n * k / (a * b)) * F.exp(chance)), F.lit(0.0)).alias("e"))


def ami(a: DataFrame, b: DataFrame, average: str = "arithmetic") -> DataFrame:
    """(ami): mutual information adjusted for chance of two labellings (node, block), as tables; 1 for two labellings of one block."""
    t = frozen(contingency(a, b), "contingency")
    of = {"arithmetic": (F.col("hx") + F.col("hy")) / 2, "max": F.greatest("hx", "hy")}[average]
    both = information(t).crossJoin(expected_information_table(t))
    gap = of - F.col("e")
    least = F.when(F.abs(gap) > 1e-15, gap).when(gap < 0, -1e-15).otherwise(1e-15)
    return both.select(F.when((F.col("hx") == 0) & (F.col("hy") == 0), 1.0).otherwise((F.col("i") - F.col("e")) / least).alias("ami"))


# kernels on small tables of counts: rows and columns are blocks, of which a table has a bounded number here


def table_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Contingency table of two label arrays."""
    (_, x), (_, y) = np.unique(a, return_inverse=True), np.unique(b, return_inverse=True)
    return np.bincount(x * (y.max() + 1) + y, minlength=(x.max() + 1) * (y.max() + 1)).reshape(x.max() + 1, y.max() + 1)


def _entropies(t: np.ndarray) -> tuple[float, float, float]:
    n = t.sum()
    h = lambda c: math.log(n) - float((c[c > 0] * np.log(c[c > 0])).sum()) / n
    hx, hy = h(t.sum(1)), h(t.sum(0))
    return hx, hy, hx + hy - h(t.ravel())


def nmi_value(a, b, average: str = "sqrt") -> float:
    hx, hy, i = _entropies(table_of(np.asarray(a), np.asarray(b)))
    of = {"sqrt": math.sqrt(max(hx * hy, 0)), "arithmetic": (hx + hy) / 2, "max": max(hx, hy)}[average]
    return i / of if of > 1e-15 else 0.0 if average == "sqrt" else 1.0


def expected_information(t: np.ndarray) -> float:
    """Mean mutual information over all tables with these margins (hypergeometric)."""
    x, y, n = t.sum(1), t.sum(0), int(t.sum())
    lf = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])
    value = 0.0
    for a, ca in zip(*np.unique(x, return_counts=True)):
        for b, cb in zip(*np.unique(y, return_counts=True)):
            k = np.arange(max(1, a + b - n), min(a, b) + 1)
            p = np.exp(lf[a] + lf[b] + lf[n - a] + lf[n - b] - lf[n] - lf[k] - lf[a - k] - lf[b - k] - lf[n - a - b + k])
            value += ca * cb * float((k / n * np.log(n * k / (a * b)) * p).sum())
    return value


def ami_value(a, b, average: str = "arithmetic") -> float:
    """Mutual information adjusted for chance."""
    t = table_of(np.asarray(a), np.asarray(b))
    hx, hy, i = _entropies(t)
    if min(t.shape) == 1 and max(t.shape) == 1:
        return 1.0
    of = {"arithmetic": (hx + hy) / 2, "max": max(hx, hy)}[average]
    expected = expected_information(t)
    gap = of - expected
    return (i - expected) / (gap if abs(gap) > 1e-15 else math.copysign(1e-15, gap or 1.0))


def _log_tables(x: np.ndarray, y: np.ndarray) -> float:
    """ln of the number of tables with margins x and y, by the effective-columns approximation."""
    n, r, s = x.sum(), len(x), len(y)
    if r == 1 or s == 1:
        return 0.0
    w = n / (n + 0.5 * r * s)
    u, v = (1 - w) / r + w * x / n, (1 - w) / s + w * y / n
    mu, nu = (r + 1) / (r * (v**2).sum()) - 1 / r, (s + 1) / (s * (u**2).sum()) - 1 / s
    value = (r - 1) * (s - 1) * math.log(n + 0.5 * r * s) + 0.5 * (r + nu - 2) * np.log(v).sum() + 0.5 * (s + mu - 2) * np.log(u).sum()
    return float(value + 0.5 * (math.lgamma(mu * r) + math.lgamma(nu * s) - s * (math.lgamma(nu) + math.lgamma(r)) - r * (math.lgamma(mu) + math.lgamma(s))))


def reduced_information_value(a, b) -> float:
    """Mutual information less the cost of the contingency table, in nats a node; approximate."""
    t = table_of(np.asarray(a), np.asarray(b))
    n = int(t.sum())
    lf = lambda c: sum(math.lgamma(k + 1) for k in c.ravel())
    return (math.lgamma(n + 1) + lf(t) - lf(t.sum(1)) - lf(t.sum(0)) - _log_tables(t.sum(1), t.sum(0))) / n


def armi_value(a, b) -> float:
    """Reduced mutual information over that of the first labelling with itself; may be negative."""
    own = reduced_information_value(a, a)
    return reduced_information_value(a, b) / own if abs(own) > 1e-15 else 1.0


def random_nmi_values(truth, groups: int, k: int, seed: int) -> list[float]:
    """NMI of k random labellings in which every group occurs."""
    random, truth, out = np.random.default_rng(seed), np.asarray(truth), []
    for _ in range(k):
        labels = random.integers(0, groups, len(truth))
        labels[random.choice(len(truth), groups, replace=False)] = np.arange(groups)
        out.append(nmi_value(truth, labels))
    return out


def angle_removed_mean(x, y) -> float:
    """Angle between two vectors without their means, from 0 to 100."""
    x, y = np.asarray(x, float) - np.mean(x), np.asarray(y, float) - np.mean(y)
    return float(100 / math.pi * math.acos(max(-1.0, min(1.0, abs(x @ y) / (np.linalg.norm(x) * np.linalg.norm(y))))))


def best_assignment(cost: np.ndarray) -> np.ndarray:
    """Column of each row in a least-cost assignment of a square matrix, by shortest augmenting paths."""
    n = len(cost)
    u, v, match = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, dtype=int)
    for i in range(1, n + 1):
        match[0], j, least, way, used = i, 0, np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int), np.zeros(n + 1, dtype=bool)
        while True:
            used[j] = True
            row = match[j]
            reduced = cost[row - 1] - u[row] - v[1:]
            better = ~used[1:] & (reduced < least[1:])
            least[1:][better], way[1:][better] = reduced[better], j
            free = np.where(used, np.inf, least)
            after = int(free[1:].argmin()) + 1
            step = free[after]
            u[match[used]] += step
            v[used] -= step
            least[~used] -= step
            j = after
            if not match[j]:
                break
        while j:
            match[j], j = match[way[j]], way[j]
    out = np.empty(n, dtype=int)
    out[match[1:] - 1] = np.arange(n)
    return out


def best_angles(a: np.ndarray, b: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean angle of the columns of a and b under their best assignment, and that assignment."""
    cost = np.array([[angle_removed_mean(x, y) for y in b.T] for x in a.T])
    to = best_assignment(cost)
    return float(cost[np.arange(len(to)), to].mean()), to


def summary(runs: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    """Mean and sample deviation of measures by columns, rounded to 4."""
    return runs.groupBy(*by).agg(*(f for m in measures for f in (F.round(F.avg(m), 4).alias(f"{m}_mean"), F.round(F.stddev_samp(m), 4).alias(f"{m}_std"))))


def success_rate(runs: DataFrame, by: list[str], measure: str, least: float) -> DataFrame:
    """Share of runs whose measure is least or more."""
    return runs.groupBy(*by).agg(F.avg(F.when(F.col(measure) >= least, 1.0).otherwise(0.0)).alias("success_rate"))
