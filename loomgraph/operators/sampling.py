"""Weighted choice and batched Metropolis-Hastings sampling of partitions, as tables.

Choice: of every key's rows the one with the least -ln(u) / weight, an exponential race, wins with a chance in proportion to its weight.
It takes one grouped minimum, and the same seed gives the same draw anywhere: u comes from an MD5 of the row's names.

A batch of Metropolis-Hastings proposes a move for every node on one frozen state.  Only proposals that touch no common pair of
blocks are looked at further: each has a random place in line and goes on where it is first on every pair that it touches.  Their
changes add up, so each is accepted or not as a single step would be.  Which proposals go on depends on the proposals,
so the order of steps is not that of a sampler that draws one node at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import partition as P
from loomgraph.operators.graph import Graph
from loomgraph.operators.moves import apart
from loomgraph.operators.objectives import OBJECTIVES, TERMS, Blocks, node_deltas
from loomgraph.session import frozen, sized

ROW = 48


def uniform(*names: Column | str, seed: int) -> Column:
    """A number between 0 and 1, both excluded, by the names' values and the seed: 52 bits of an MD5."""
    text = F.concat_ws("/", F.lit(str(seed)), *[F.coalesce(F.col(n) if isinstance(n, str) else n, F.lit("null")).cast("string") for n in names])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def race(rows: DataFrame, keys: list[str], items: list[str], weight: str, seed: int) -> DataFrame:
    """(keys, items) of the winning row of every key; rows without a weight above 0 do not run.  Keys and items name a row."""
    own = rows.where(F.col(weight) > 0).withColumn("__time", -F.log(uniform(*keys, *items, seed=seed)) / F.col(weight))
    won = own.groupBy(*keys).agg(F.min(F.struct("__time", *items)).alias("__won"))
    return won.select(*keys, *[F.col(f"__won.{i}").alias(i) for i in items])


@dataclass(frozen=True)
class State:
    """Block edges e(r, s, e) both ways, stats(block, n, k), and the nodes' context(node, u, w) without loops; all frozen."""

    graph: Graph
    part: DataFrame
    edges: DataFrame
    stats: DataFrame
    context: DataFrame
    blocks: int


def state_of(graph: Graph, part: DataFrame) -> State:
    """graph must be undirected; its counted form is cheapest."""
    if graph.directed:
        raise ValueError("batched sampling takes undirected graphs")
    edges = frozen(P.block_edges(graph, part), "edges")
    stats = frozen(P.block_stats(graph, part, edges).select("block", "n", F.col("k_out").alias("k")), "stats")
    context = frozen(P.move_context(graph, part).select("node", F.col("block").alias("u"), F.col("k_out").alias("w")), "context")
    return State(graph, part, edges, stats, context, stats.count())


def proposals(s: State, seed: int, epsilon: float = 0.1) -> DataFrame:
    """(node, r, t): a proposal for every node, t <> r, whose block keeps another node: by the blocks of a random neighbour, or uniform.

    A neighbour is chosen by weight, its block u found; t is uniform with chance eps B / (k_u + eps B), else
    by the weights of u's edges.  Nodes without neighbours choose uniformly.
    """
    plain = s.graph.adj_count().where("src <> dst").groupBy(F.col("src").alias("node"), F.col("dst").alias("other")).agg(F.sum("weight").alias("weight"))
    neighbour = race(plain, ["node"], ["other"], "weight", 4 * seed).join(s.part.select(F.col("node").alias("other"), F.col("block").alias("u")), "other")
    chosen = s.part.select("node", F.col("block").alias("r")).join(neighbour.select("node", "u"), "node", "left").join(sized(s.stats.select(F.col("block").alias("u"), "k"), ROW), "u", "left")
    spread = epsilon * s.blocks
    chosen = frozen(chosen.withColumn("any", F.col("u").isNull() | (uniform("node", seed=4 * seed + 1) < spread / (F.col("k") + spread))), "chosen")
    order = frozen(P.relabelled_blocks(s.stats.select("block")), "numbers")
    at = (F.floor(uniform("node", seed=4 * seed + 2) * s.blocks)).cast("long").alias("idx")
    free = chosen.where("any").select("node", "r", at).join(sized(order, ROW), "idx").select("node", "r", F.col("block").alias("t"))
    near = chosen.where("not any").select("node", "r", "u").join(sized(s.edges.select(F.col("r").alias("u"), F.col("s").alias("t"), "e"), ROW), "u")
    moved = free.unionByName(race(near, ["node", "r"], ["t"], "e", 4 * seed + 3))
    kept = sized(s.stats.where("n > 1").select(F.col("block").alias("r")), ROW)
    return moved.where("r <> t").join(kept, "r").select("node", "r", "t")


def chances(s: State, moves: DataFrame, epsilon: float = 0.1) -> DataFrame:
    """moves(node, r, t) with forth and back: the chances that node, once chosen, is proposed t, and in the state after the move r."""
    loops = P.self_loops(s.graph)
    rows = moves.join(s.context, "node").join(sized(s.stats.select(F.col("block").alias("u"), "k"), ROW), "u")
    for c in ("r", "t"):
        rows = rows.join(sized(s.edges.select(F.col("r").alias("u"), F.col("s").alias(c), F.col("e").alias(f"e{c}")), ROW), ["u", c], "left")
    degree = s.context.groupBy("node").agg(F.sum("w").alias("d"))
    to = F.sum(F.when(F.col("u") == F.col("t"), F.col("w")).otherwise(0.0))
    inside = F.sum(F.when(F.col("u") == F.col("r"), F.col("w")).otherwise(0.0))
    ends = moves.join(s.context, "node", "left").groupBy("node", "r", "t").agg(F.coalesce(to, F.lit(0.0)).alias("wt"), F.coalesce(inside, F.lit(0.0)).alias("wr"))
    # a node with neighbours in neither block still changes both
    rows = rows.join(degree, "node").join(ends, ["node", "r", "t"]).join(loops, "node", "left").na.fill(0.0, ["er", "et", "loops"])
    own, spread = F.col("d") + 2 * F.col("loops"), epsilon * s.blocks
    is_r, is_t = F.col("u") == F.col("r"), F.col("u") == F.col("t")
    after = F.when(is_r, F.col("er") - 2 * F.col("wr") - 2 * F.col("loops")).when(is_t, F.col("er") - F.col("wt") + F.col("wr")).otherwise(F.col("er") - F.col("w"))
    k_after = F.col("k") + F.when(is_r, -own).when(is_t, own).otherwise(0.0)
    share = F.col("w") / F.col("d")
    sums = rows.groupBy("node", "r", "t").agg(F.sum(share * (F.col("et") + epsilon) / (F.col("k") + spread)).alias("forth"), F.sum(share * (after + epsilon) / (k_after + spread)).alias("back"))
    return moves.join(sums, ["node", "r", "t"], "left").na.fill(1.0 / s.blocks, ["forth", "back"])


@dataclass(frozen=True)
class Sampled:
    """The best partition that was seen and its value, the last one, how many moves were looked at and made."""

    best: DataFrame
    value: float
    last: DataFrame
    looked_at: int
    moves: int


def metropolis_hastings(graph: Graph, part: DataFrame, name: str = "dckn", batches: int = 100, seed: int = 0, epsilon: float = 0.1, beta=lambda batch: 1.0) -> Sampled:
    """batches of proposals from part; of those apart from each other each is accepted with chance min(1, exp(beta delta) back / forth)."""
    graph = graph.counted()
    part = frozen(part.select("node", "block"), "part")
    value = best = OBJECTIVES[name](Blocks(graph, part)).first().objective
    kept, looked_at, made = part, 0, 0
    for batch in range(batches):
        s, at = state_of(graph, part), seed + 1000 * batch
        moves = frozen(apart(s.edges, s.context, frozen(proposals(s, at, epsilon), "proposed"), at, TERMS[name](False).dense), "moves")
        n = moves.count()
        looked_at += n
        if not n:
            continue
        deltas = node_deltas(graph, part, name, moves.select("node", F.col("t").alias("to_block")))
        valued = chances(s, moves, epsilon).join(deltas.select("node", "delta"), "node")
        chance = F.exp(F.least(F.lit(700.0), float(beta(batch)) * F.col("delta"))) * F.col("back") / F.col("forth")
        accepted = frozen(valued.where(uniform("node", seed=at + 7) < chance).select("node", "t", "delta"), "accepted")
        row = accepted.agg(F.count("*").alias("n"), F.sum("delta").alias("d")).first()
        if row.n:
            part = frozen(part.join(accepted, "node", "left").select("node", F.coalesce("t", "block").alias("block")), "part")
            value, made = value + row.d, made + row.n
            if value > best + 1e-9:
                best, kept = value, part
    return Sampled(kept, best, part, looked_at, made)
