"""Moves and merges that can be made at once: which of them do not meet, searches that end where no single one improves, and agglomeration."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import partition as P
from loomgraph.operators.graph import Graph
from loomgraph.operators.objectives import OBJECTIVES, TERMS, Blocks, best_moves, merge_deltas, node_deltas
from loomgraph.operators.order import numbered
from loomgraph.session import frozen, sized

ROW = 48


def apart(edges: DataFrame, context: DataFrame, moves: DataFrame, seed: int, dense: bool = False) -> DataFrame:
    """Those of the moves(node, r, t) that are first in line, by a hash, on every pair of blocks that they touch; so no two touch one pair and their changes add up.

    A move touches the pairs of r and of t with blocks that have edges(r, s) with them or that the node has neighbours in, by context(node, u),
    and each with itself.  dense: an objective of pairs without edges couples all blocks, and one move is left.
    """
    line = F.struct(F.xxhash64("node", F.lit(seed)).alias("h"), "node")
    if dense:
        first = moves.agg(F.min(line).alias("first"))
        return moves.join(F.broadcast(first), line == F.col("first")).drop("first")  # one row
    own = moves.select("node", "r", "t", F.explode(F.array("r", "t")).alias("a"))
    linked = own.join(sized(edges.select(F.col("r").alias("a"), F.col("s").alias("b")), ROW), "a").select("node", "a", "b")
    brought = own.join(context.select("node", F.col("u").alias("b")), "node").select("node", "a", "b")
    between = moves.select("node", F.col("r").alias("a"), F.col("t").alias("b"))
    touched = linked.unionByName(brought).unionByName(between).unionByName(own.select("node", "a", F.col("a").alias("b")))
    touched = frozen(touched.select("node", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "touched")
    first = touched.groupBy("a", "b").agg(F.min(line).alias("first"))
    late = touched.join(first, ["a", "b"]).where(line > F.col("first")).select("node").distinct()
    return moves.join(late, "node", "left_anti")


@dataclass
class Search:
    """A partition, its value, the values after every step, how many steps were taken as a whole batch, and why the search ended."""

    part: DataFrame
    value: float
    values: list[float] = field(default_factory=list)
    batches: int = 0
    status: str = "step limit"


def _signature(part: DataFrame) -> int:
    """A hash of a state, in whatever order its rows come."""
    return int(part.agg(F.sum(F.xxhash64("node", "block").cast("decimal(38,0)"))).first()[0] or 0)


def _stays(moves: DataFrame, sizes: DataFrame) -> DataFrame:
    """moves without one of each block that all its nodes would leave: that of the largest node."""
    leaving = moves.groupBy("from_block").agg(F.count("*").alias("leaving"), F.max("node").alias("stays"))
    emptied = sizes.withColumnRenamed("block", "from_block").join(leaving, "from_block").where("n = leaving").select(F.col("stays").alias("node"))
    return moves.join(emptied, "node", "left_anti")


def em(graph: Graph, part: DataFrame, name: str = "dckn", steps: int = 200, candidates: str | Callable[[DataFrame], DataFrame] = "all", seed: int = 0) -> Search:
    """Best moves of one state at once while that improves, else those of them that do not meet, until no single move does.

    A whole batch counts only if its value rises and its state, by a hash, is new: moves that undo each other would else go to and fro.  Otherwise the moves
    that are apart() are made, whose gains add up, so that the value rises at every step.  Nodes do not leave a block empty.
    candidates: as in node_deltas(), or a function of the partition that gives the table of moves.
    """
    graph = graph.counted()
    both = graph.edges.select("src", "dst")
    links = frozen(both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct(), "links")
    part = frozen(part.select("node", "block"), "part")
    value = OBJECTIVES[name](Blocks(graph, part)).first().objective
    found, seen = Search(part, value, [value]), {_signature(part)}
    for step in range(steps):
        sizes = P.block_sizes(part)
        alone = sizes.where("n = 1").select(F.col("block").alias("from_block"))
        moves = frozen(best_moves(node_deltas(graph, part, name, candidates(part) if callable(candidates) else candidates)).join(alone, "from_block", "left_anti"), "moves")
        if moves.isEmpty():
            found.status = "done"
            break
        batch = _stays(moves, sizes)
        after = frozen(part.join(batch.select("node", "to_block"), "node", "left").select("node", F.coalesce("to_block", "block").alias("block")), "part")
        better, mark = OBJECTIVES[name](Blocks(graph, after)).first().objective, _signature(after)
        if better <= value + 1e-9 or mark in seen:
            blocks = P.block_edges(graph, part)
            pairs = blocks.select("r", "s").unionByName(blocks.select(F.col("s").alias("r"), F.col("r").alias("s"))).distinct()
            context = links.join(part.select(F.col("node").alias("dst"), F.col("block").alias("u")), "dst").select(F.col("src").alias("node"), "u").distinct()
            own = frozen(apart(pairs, context, moves.select("node", F.col("from_block").alias("r"), F.col("to_block").alias("t"), "delta"), seed + step, TERMS[name](graph.directed).dense), "apart")
            after = frozen(part.join(own.select("node", "t"), "node", "left").select("node", F.coalesce("t", "block").alias("block")), "part")
            better, mark = value + own.agg(F.sum("delta")).first()[0], _signature(after)
        else:
            found.batches += 1
        part, value = after, better
        seen.add(mark)
        found.part, found.value = part, value
        found.values.append(value)
    return found


def merge_round(graph: Graph, part: DataFrame, name: str = "dckn", most: int | None = None, blocks: Blocks | None = None) -> DataFrame:
    """(block, into, delta) of merges that do not meet: pairs of blocks, joined by edges, of which each is the other's best; the best of these if there are more than most.

    The larger block goes into the smaller number.  The best pair of all is always among them.
    """
    deltas = frozen(merge_deltas(graph, part, name, "near", blocks), "merges")
    if deltas.isEmpty():  # no edges between blocks: neighbours by size
        order = frozen(numbered(P.block_sizes(part), "n", "block"), "sizes")
        deltas = frozen(merge_deltas(graph, part, name, order.select(F.col("block"), "idx").join(order.select(F.col("block").alias("into"), (F.col("idx") - 1).alias("idx")), "idx").select("block", "into"), blocks), "merges")
    pairs = deltas.groupBy(F.least("block", "into").alias("a"), F.greatest("block", "into").alias("b")).agg(F.max("delta").alias("delta"))
    rank = F.struct(F.round("delta", 9).alias("d"), (-F.col("a")).alias("x"), (-F.col("b")).alias("y"))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("block"), "a", "b", "delta")
    best = ends.groupBy("block").agg(F.max(F.struct(rank.alias("rank"), "a", "b", "delta")).alias("t"))
    mutual = best.groupBy("t.a", "t.b").agg(F.count("*").alias("ends"), F.max("t.delta").alias("delta")).where("ends = 2")
    chosen = mutual.select(F.col("b").alias("block"), F.col("a").alias("into"), "delta")
    if most is not None and (chosen := frozen(chosen, "chosen")).count() > most:
        chosen = numbered(chosen, F.desc("delta"), "block").where(F.col("idx") < most).drop("idx")
    return chosen


def contracted(blocks: Blocks, part: DataFrame, merges: DataFrame) -> Blocks:
    """The blocks after the merges, from the block edges alone."""
    to = sized(frozen(merges.select("block", "into"), "into"), ROW)
    at = lambda c: to.select(F.col("block").alias(c), F.col("into").alias(f"{c}_into"))
    edges = blocks.edges.join(at("r"), "r", "left").join(at("s"), "s", "left").select(F.coalesce("r_into", "r").alias("r"), F.coalesce("s_into", "s").alias("s"), "e")
    after = Blocks(blocks.count_edges(), part)
    after._counted = blocks._counted
    after.__dict__["edges"] = frozen(edges.groupBy("r", "s").agg(F.sum("e").alias("e")), "edges")
    sums = [F.sum(c).alias(c) for c in ("n", "k_out", "k_in")]
    stats = blocks.stats.join(at("block"), "block", "left").groupBy(F.coalesce("block_into", "block").alias("block")).agg(*sums)
    after.__dict__["stats"] = frozen(stats, "stats")
    return after


def agglomerate(graph: Graph, blocks: int, name: str = "dckn", part: DataFrame | None = None, refine: int = 0) -> DataFrame:
    """Partition into so many blocks: from one block a node, or from part, rounds of merges that do not meet on ever smaller tables of block edges.

    refine: so many steps of em() once the number is reached.
    """
    graph = graph.counted()
    part = frozen(graph.nodes.select("node", F.col("node").alias("block")) if part is None else part.select("node", "block"), "part")
    now = Blocks(graph, part)
    left = now.stats.count()
    while left > blocks:
        merges = frozen(merge_round(graph, part, name, left - blocks, now), "merges")
        count = merges.count()
        part = frozen(P.merge(part, sized(merges, ROW)), "part")
        now, left = contracted(now, part, merges), left - count
    return em(graph, part, name, refine, "near").part if refine else part
