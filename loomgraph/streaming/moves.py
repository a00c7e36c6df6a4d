"""Block edges under a stream of edges and moves, by two keyed states.

Events(at, kind, src, dst, weight, block): kind edge adds weight (or takes it, if below 0) between src and dst; kind move puts src into block.
at orders the events of one node; edges may come before their nodes have blocks.  The first state, by node and by a share of its
neighbours, knows the node's block and those neighbours, and tells every edge of a new block.  The second, by edge, knows its weight
and both blocks and gives signed changes (r, s, e): what it counted before, negative, and what it counts now.  Their sums are the block edges of the
graph and the partition so far, in whatever order edges and moves came.  A node's moves go to SHARES states, so that one with very many neighbours
is none in one row.  The two states are two queries with a table of news between them, as Spark runs one such operator a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomgraph.session import ship

#: States a node.
SHARES = 8
NEWS = "a long, b long, end long, block long, turn long, weight double"


def _at_node(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A node's rows to news of its edges (a, b): its block as of its turn; weight comes along once, with the smaller end."""
    node = key[0]
    block, turn, known = state.get if state.exists else (None, 0, [])
    known, out = set(known), []
    for r in pd.concat(list(frames)).sort_values(["at", "is_move"], kind="stable").itertuples():
        if r.is_move:
            block, turn = int(r.block), turn + 1
            out += [(min(node, o), max(node, o), node, block, turn, 0.0) for o in sorted(known)]
        else:
            other = int(r.other)
            known.add(other)
            out.append((min(node, other), max(node, other), node, block, turn, r.weight if node <= other else 0.0))
    state.update((block, turn, sorted(known)))
    yield pd.DataFrame(out, columns=["a", "b", "end", "block", "turn", "weight"]).astype({"block": "Int64", "weight": "float64"})


def _at_edge(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """An edge's news to what it counted before, negative, and what it counts now."""
    weight, blocks = 0.0, {}
    if state.exists:
        weight, ra, ta, rb, tb = state.get
        blocks = {key[0]: (ra, ta), key[1]: (rb, tb)}
    old = (weight, *(blocks.get(k, (None, -1))[0] for k in key))
    for r in pd.concat(list(frames)).itertuples():
        weight += r.weight
        block = None if pd.isna(r.block) else int(r.block)
        if int(r.turn) > blocks.get(int(r.end), (None, -1))[1]:
            blocks[int(r.end)] = (block, int(r.turn))
    a, b = (blocks.get(k, (None, -1)) for k in key)
    state.update((weight, *a, *b))
    out = []
    for sign, (w, r, s) in ((-1.0, old), (1.0, (weight, a[0], b[0]))):
        if r is not None and s is not None and w:
            out += [(r, s, sign * w), (s, r, sign * w)]
    yield pd.DataFrame(out, columns=["r", "s", "e"]).astype({"r": "int64", "s": "int64", "e": "float64"})


def news(events: DataFrame) -> DataFrame:
    """What edges hear of their ends, see NEWS; for the append mode."""
    ship(events.sparkSession)
    share = lambda c: F.pmod(F.xxhash64(c), F.lit(SHARES))
    row = lambda node, other, to, is_move: F.struct(node.alias("node"), other.alias("other"), to.alias("share"), is_move.alias("is_move"))
    no, yes, none = F.lit(0), F.lit(1), F.lit(None).cast("long")
    ends = F.array(row(F.col("src"), F.col("dst"), share("dst"), no), row(F.col("dst"), F.col("src"), share("src"), no))
    once = F.array(row(F.col("src"), F.col("dst"), share("dst"), no))
    moves = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long")), lambda k: row(F.col("src"), none, k, yes))
    rows = F.when(F.col("kind") == "move", moves).when(F.col("src") == F.col("dst"), once).otherwise(ends)
    dealt = events.select("at", "weight", "block", F.explode(rows).alias("x")).select("x.node", "x.share", "x.other", "x.is_move", "at", "weight", "block")
    return dealt.groupBy("node", "share").applyInPandasWithState(_at_node, NEWS, "block long, turn long, known array<long>", "append", GroupStateTimeout.NoTimeout)


def changes(told: DataFrame) -> DataFrame:
    """(r, s, e): signed changes of an undirected graph's block edges from a stream of news(), in whatever order these come; for the append mode.  A loop counts twice, as in block_edges()."""
    ship(told.sparkSession)
    return told.groupBy("a", "b").applyInPandasWithState(_at_edge, "r long, s long, e double", "weight double, ra long, ta long, rb long, tb long", "append", GroupStateTimeout.NoTimeout)


def start(events: DataFrame, folder: str) -> tuple[StreamingQuery, StreamingQuery]:
    """The two running queries: news of the events, written below folder (shared by the cluster), and signed changes of these, in folder/changes."""
    first = news(events).writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/state-news").start(f"{folder}/news")
    told = events.sparkSession.readStream.schema(NEWS).parquet(f"{folder}/news")
    second = changes(told).writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/state-changes").start(f"{folder}/changes")
    return first, second
