"""Random graphs from block models.

Draws follow from the seed and the place of a stretch of cells, so a graph is the same on every run and in whatever tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.graph import Graph
from loomgraph.operators.order import numbered
from loomgraph.session import frozen, ship

#: Hits that one row of work draws.
STRETCH = 65536


def equal_blocks(spark: SparkSession, n: int, blocks: int) -> DataFrame:
    """(node, block): nodes in blocks of nearly equal size, in order."""
    return spark.range(n).select(F.col("id").alias("node"), F.floor(F.col("id") * blocks / n).cast("int").alias("block"))


def degree_weights(nodes: DataFrame, low: float, high: float, exponent: float, seed: int) -> DataFrame:
    """nodes with weight: power-law weights on [low, high]."""
    from loomgraph.functions.special import power_law

    u = (F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    return nodes.withColumn("weight", power_law(u, low, high, exponent))


def _cells(u: np.ndarray, n2: int, same: bool, loops: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) in two groups of the cells of these numbers: row by row, or of one group the pairs i < j (i <= j with loops)."""
    if not same:
        return u // n2, u % n2
    half = 0 if loops else 1  # cell numbers of j begin at j (j - 1) / 2, or at j (j + 1) / 2
    j = np.floor((np.sqrt(8.0 * u + 1) - 1) / 2).astype(np.int64)
    j -= j * (j + 1) // 2 > u
    j += (j + 1) * (j + 2) // 2 <= u
    return u - j * (j + 1) // 2, j + half


def _hits(random, chance: float, low: int, high: int) -> np.ndarray:
    """Numbers from low to high - 1, each with the chance, by drawing the gaps between them."""
    if chance >= 1:
        return np.arange(low, high)
    found, at = [], low - 1
    while at < high:
        mean = (high - at) * chance
        steps = np.cumsum(random.geometric(chance, int(mean + 4 * mean**0.5) + 8)) + at
        found.append(steps)
        at = int(steps[-1])
    every = np.concatenate(found) if found else np.empty(0, np.int64)
    return every[every < high]


def bernoulli(nodes: DataFrame, p: np.ndarray, seed: int, directed: bool = False, loops: bool = False) -> Graph:
    """A graph of nodes(node, block[, weight]): an edge of i and j with probability min(1, p[block_i, block_j] w_i w_j).

    Work grows with the edges, not with the pairs.  Nodes of a block with weights between two powers of 2 are a group.  The cells of two
    groups are cut into stretches of about STRETCH hits; a task draws the gaps from hit to hit at the highest chance of the groups, and a hit stays with
    its own chance over that one, a quarter at least unless it is cut at 1.
    """
    spark = nodes.sparkSession
    ship(spark)
    own = nodes if "weight" in nodes.columns else nodes.withColumn("weight", F.lit(1.0))
    own = own.select("node", "block", F.col("weight").cast("double").alias("weight")).where("weight > 0").withColumn("level", F.floor(F.log2("weight")).cast("int"))
    order = frozen(numbered(own, "block", "level", "node"), "members")
    groups = order.groupBy("block", "level").agg(F.count("*").alias("n"), F.min("idx").alias("first"), F.max("weight").alias("top")).orderBy("first").collect()  # a few a block, as p is
    pairs = []
    for x, a in enumerate(groups):
        for b in groups if directed else groups[x:]:
            chance = min(1.0, float(p[a.block, b.block]) * a.top * b.top)
            same = a is b and not directed
            cells = a.n * (a.n + (1 if loops else -1)) // 2 if same else a.n * b.n
            if chance > 0 and cells:
                pairs.append((a.first, b.first, b.n, same, chance, float(p[a.block, b.block]), cells, math.ceil(STRETCH / chance)))
    schema = "a long, b long, nb long, same boolean, chance double, p double, cells long, length long"
    table = spark.createDataFrame(pairs, schema).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("cells") - 1) / F.col("length")))).alias("part"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(frames):
        for frame in frames:
            for r in frame.itertuples():
                random = np.random.default_rng([seed & 0x7FFFFFFF, r.a, r.b, r.part])
                u = _hits(random, r.chance, r.part * r.length, min(r.cells, (r.part + 1) * r.length))
                i, j = _cells(u, r.nb, r.same, loops)
                yield pd.DataFrame({"i": r.a + i, "j": r.b + j, "share": r.p / r.chance})

    hits = table.repartition(tasks, "a", "b", "part").mapInPandas(run, "i long, j long, share double")
    end = lambda i, node, w: order.select(F.col("idx").alias(i), F.col("node").alias(node), F.col("weight").alias(w))
    drawn = hits.join(end("i", "src", "wi"), "i").join(end("j", "dst", "wj"), "j")
    u = (F.pmod(F.xxhash64("src", "dst", F.lit(seed)), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    drawn = drawn.where(u < F.col("share") * F.col("wi") * F.col("wj"))
    if directed and not loops:
        drawn = drawn.where("src <> dst")
    if not directed:
        drawn = drawn.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return Graph(drawn.select("src", "dst", F.lit(1.0).alias("weight")), directed, nodes.select("node"))


def fixed_counts(nodes: DataFrame, counts: np.ndarray, seed: int, directed: bool = False) -> Graph:
    """A multigraph with exactly counts[r, s] edges from block r to s, ends uniform in the blocks (by weight if there is one).  Undirected: the upper triangle counts."""
    spark = nodes.sparkSession
    ship(spark)
    cells = [(int(r), int(s), int(counts[r, s])) for r in range(len(counts)) for s in range(len(counts)) if counts[r, s] and (directed or r <= s)]
    wanted = spark.createDataFrame(cells or [(0, 0, 0)], "r int, s int, n long").select("r", "s", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("k")) if cells else spark.createDataFrame([], "r int, s int, k long")
    members = nodes.withColumn("weight", F.col("weight") if "weight" in nodes.columns else F.lit(1.0))
    from pyspark.sql import Window

    upto = members.withColumn("high", F.sum("weight").over(Window.partitionBy("block").orderBy("node"))).withColumn("low", F.col("high") - F.col("weight"))
    totals = members.groupBy("block").agg(F.sum("weight").alias("total"))
    unit = lambda end: (F.pmod(F.xxhash64("r", "s", "k", F.lit(seed), F.lit(end)), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    drawn = wanted
    for end, block in (("src", "r"), ("dst", "s")):
        t = totals.select(F.col("block").alias(block), F.col("total").alias(f"{end}_total"))
        m = upto.select(F.col("block").alias(block), F.col("node").alias(end), "low", "high")
        drawn = drawn.join(F.broadcast(t), block).withColumn("at", unit(end) * F.col(f"{end}_total")).drop(f"{end}_total")
        drawn = drawn.join(m, (drawn[block] == m[block]) & (drawn["at"] >= m["low"]) & (drawn["at"] < m["high"])).drop(m[block]).drop("low", "high", "at")
    return Graph(drawn.select("src", "dst", F.lit(1.0).alias("weight")), directed, nodes.select("node"))


def planted(spark: SparkSession, n: int, blocks: int, p_in: float, p_out: float, seed: int, directed: bool = False) -> tuple[Graph, DataFrame]:
    """Equal blocks with constant chances within and between."""
    nodes = equal_blocks(spark, n, blocks)
    return bernoulli(nodes, np.full((blocks, blocks), p_out) + np.eye(blocks) * (p_in - p_out), seed, directed), nodes


def degree_corrected(spark: SparkSession, n: int, p: np.ndarray, degree: float, exponent: float, seed: int, noise: float = 0.0) -> tuple[Graph, DataFrame]:
    """Equal blocks, power-law weights on [2, 30], chances p scaled to the average degree; noise: share of pairs that are flipped."""
    blocks = len(p)
    nodes = degree_weights(equal_blocks(spark, n, blocks), 2.0, 30.0, exponent, seed).checkpoint() if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else degree_weights(equal_blocks(spark, n, blocks), 2.0, 30.0, exponent, seed)
    sums = {r.block: r.w for r in nodes.groupBy("block").agg(F.sum("weight").alias("w")).collect()}
    w = np.array([sums[k] for k in range(blocks)])
    scale = degree * n / float(w @ p @ w)
    graph = bernoulli(nodes, p * scale, seed)
    if noise:
        graph = graph.xor(bernoulli(nodes.select("node", "block"), np.full((blocks, blocks), noise), seed + 1).edges)
    return graph, nodes.select("node", "block")


def girvan_newman(spark: SparkSession, seed: int = 0, most: int = 8, networks: int = 10, directed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Edges (graph_id, src, dst, weight) and blocks (graph_id, node, block, z_out, p_in, p_out) of the benchmark of four blocks of 32 nodes.

    z_out, a node's expected edges to other blocks, goes from 0 to most (8, or 16 in the longer series) by halves; with all in all 16 edges a
    node (directed: 4) that gives the chances within and between.  Every z_out has so many networks.
    """
    series = [chances(z / 2, directed) for z in range(2 * most + 1)]
    edges, blocks = None, None
    for k, (z, p_in, p_out) in enumerate(series):
        for network in range(networks):
            graph, part = planted(spark, 128, 4, p_in, p_out, seed + 1000 * k + network, directed)
            name = F.lit(f"gn_{z:g}_{network}").alias("graph_id")
            e, b = graph.edges.select(name, "src", "dst", "weight"), part.select(name, "node", "block", F.lit(z).alias("z_out"), F.lit(p_in).alias("p_in"), F.lit(p_out).alias("p_out"))
            edges, blocks = (e, b) if edges is None else (edges.unionByName(e), blocks.unionByName(b))
    return edges, blocks


def chances(z: float, directed: bool = False) -> tuple[float, float, float]:
    """(z, p_in, p_out) of the benchmark: 128 nodes, 6 pairs of blocks of 32 x 32 cells, 4 blocks of 32 x 33 / 2 pairs with loops (directed: 32 x 32 cells in all)."""
    p_out = z * 128 / (2 * 6 * 32 * 32)
    outer = p_out * 2 * 6 * 32 * 32
    inner = (128 * 4 - outer) / (32 * 32) if directed else (128 * 16 - outer) / (4 * 32 * 33)
    return z, min(1.0, max(0.0, inner)), p_out


def _power_law_integers(random, size: int, low: float, high: int, exponent: float) -> np.ndarray:
    u = random.random(size)
    k = 1 - exponent
    return np.minimum(np.floor((low**k + u * ((high + 1) ** k - low**k)) ** (1 / k)).astype(np.int64), high)


def _least_degree(mean: float, high: int, exponent: float) -> float:
    """The lower end of a power law on [low, high] with the mean."""
    a, b = 1.0, float(high)
    for _ in range(60):
        low = (a + b) / 2
        x = np.linspace(low, high + 1, 4001)
        p = x**-exponent
        a, b = (low, b) if (np.floor(x) * p).sum() / p.sum() < mean else (a, low)
    return a


def benchmark_arrays(n: int, mixing: float, degree: float, most: int, smallest: int, largest: int, random, t1: float = 2.0, t2: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(src, dst, labels) of one graph with power-law degrees (exponent t1) and block sizes (t2), a share mixing of each node's edges leading out of its block.

    Ends are paired at random within blocks and between them; pairs that repeat or join a node or block to itself are
    exchanged with other pairs, and dropped if that keeps failing.
    """
    k = _power_law_integers(random, n, _least_degree(degree, most, t1), most, t1)
    inner = np.minimum(np.round((1 - mixing) * k).astype(np.int64), largest - 1)
    sizes: list[int] = []
    while sum(sizes) < n:
        sizes.append(int(_power_law_integers(random, 1, smallest, largest, t2 + 1e-9)[0]))
    over = sum(sizes) - n
    while over:  # the blocks share what is too much
        i = int(random.integers(len(sizes)))
        if sizes[i] > smallest:
            sizes[i] -= 1
            over -= 1
        elif all(x <= smallest for x in sizes):
            over = 0
    room, labels = np.array(sizes), np.full(n, -1)
    size = room.copy()
    for v in np.argsort(-inner, kind="stable"):  # those with many inner edges first, while large blocks have room
        fit = np.flatnonzero((room > 0) & (size > inner[v]))
        c = int(random.choice(fit)) if len(fit) else int(np.argmax(room))
        labels[v] = c
        room[c] -= 1
    inner = np.minimum(inner, size[labels] - 1)

    def paired(ends: np.ndarray, wrong, tries: int = 60) -> np.ndarray:
        ends = random.permutation(ends)[: len(ends) // 2 * 2].reshape(-1, 2)
        for _ in range(tries):
            low, high = ends.min(1), ends.max(1)
            repeated = np.ones(len(ends), dtype=bool)
            repeated[np.unique(low * n + high, return_index=True)[1]] = False
            bad = np.flatnonzero(repeated | wrong(low, high))
            if not len(bad):
                break
            other = random.integers(0, len(ends), len(bad))
            for i, j in zip(bad, other):
                ends[i, 1], ends[j, 1] = ends[j, 1], ends[i, 1]
        low, high = ends.min(1), ends.max(1)
        keep = np.zeros(len(ends), dtype=bool)
        keep[np.unique(low * n + high, return_index=True)[1]] = True
        return np.stack([low, high], 1)[keep & ~wrong(low, high)]

    parts = [paired(np.repeat(np.flatnonzero(labels == c), inner[labels == c]), lambda a, b: a == b) for c in range(len(size))]
    parts.append(paired(np.repeat(np.arange(n), k - inner), lambda a, b: labels[a] == labels[b]))
    src, dst = np.concatenate([x for x in parts if len(x)]).T
    return src, dst, labels


def benchmark(spark: SparkSession, graphs: int, n: int, mixing: float, degree: float = 20.0, most: int = 50, smallest: int = 10, largest: int = 50, seed: int = 0) -> DataFrame:
    """(graph_id, src, dst, weight, block): edges of graphs of benchmark_arrays(), and a row with dst null for every node with its block; a task a graph."""
    ship(spark)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = int(pdf["g"].iloc[0])
        src, dst, labels = benchmark_arrays(n, mixing, degree, most, smallest, largest, np.random.default_rng([seed, g]))
        none = lambda k, kind: pd.array([pd.NA] * k, dtype=kind)
        edges = pd.DataFrame({"graph_id": str(g), "src": src, "dst": pd.array(dst, dtype="Int64"), "weight": 1.0, "block": none(len(src), "Int32")})
        nodes = pd.DataFrame({"graph_id": str(g), "src": np.arange(n), "dst": none(n, "Int64"), "weight": 0.0, "block": pd.array(labels, dtype="Int32")})
        return pd.concat([edges, nodes])

    ids = spark.range(graphs).withColumnRenamed("id", "g")
    return ids.groupBy("g").applyInPandas(run, "graph_id string, src long, dst long, weight double, block int")
