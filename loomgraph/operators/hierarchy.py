"""Nested partitions over tables: levels are added, dropped and refined as the full value of the hierarchical model says.

levels[0] is a partition of the nodes, levels[l] one of the blocks of levels[l - 1].  Upper levels are searched on quotient graphs, which are as small as
the levels; nodes move only between blocks with the same parent, so that no upper level changes its edges.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import partition as P
from loomgraph.operators.graph import Graph
from loomgraph.operators.moves import agglomerate, em
from loomgraph.operators.objectives import hierarchical, level_removal
from loomgraph.session import frozen

#: The plain objective that proposes partitions of the nodes, by kind, and of the blocks.
PROPOSES, ABOVE = {"spc": "spc", "dcpu": "dcpu", "dcpuh": "dcpuh"}, "spc"
#: A change counts from this gain on.
LEAST = 1e-9


@dataclass
class Hierarchy:
    """Levels, the model's value, and what was done with which gain."""

    levels: list[DataFrame]
    value: float
    steps: list[tuple[str, float]] = field(default_factory=list)


def sibling_targets(part: DataFrame, above: DataFrame) -> DataFrame:
    """(node, to_block): moves of nodes to the other blocks of their block's parent; above: partition of part's blocks."""
    allowed = P.siblings(above).where("block <> target")
    return part.join(allowed, "block").select("node", F.col("target").alias("to_block"))


def _value(graph: Graph, levels: list[DataFrame], kind: str) -> float:
    return hierarchical(graph, levels, kind).first().objective


def add_levels(graph: Graph, found: Hierarchy, kind: str = "dcpu", most: int = 10) -> Hierarchy:
    """found with further levels on top while one of half of the top's blocks, or of their square root, raises the value."""
    while len(found.levels) < most:
        at = frozen_graph(reduce(P.quotient, found.levels, graph))
        top = at.nodes.count()
        offers = []
        for count in sorted({max(1, top // 2), max(1, math.isqrt(top))}):
            if count < top:
                level = agglomerate(at, count, ABOVE)
                offers.append((_value(graph, [*found.levels, level], kind), count, level))
        if not offers:
            return found
        value, _, level = max(offers, key=lambda x: (x[0], -x[1]))
        if value <= found.value + LEAST:
            return found
        found = Hierarchy([*found.levels, level], value, [*found.steps, (f"add level {len(found.levels)}", value - found.value)])
    return found


def drop_levels(graph: Graph, found: Hierarchy, kind: str = "dcpu") -> Hierarchy:
    """found without levels above the first whose removal raises the value, the best one first."""
    while len(found.levels) > 1:
        gains = [(level_removal(graph, found.levels, k, kind).first().objective, -k) for k in range(1, len(found.levels))]
        gain, k = max(gains)
        if gain <= LEAST:
            return found
        kept = [*found.levels]
        if -k + 1 < len(kept):
            kept[-k + 1] = frozen(P.zoom(kept[-k], kept[-k + 1]), "level")
        del kept[-k]
        found = Hierarchy(kept, found.value + gain, [*found.steps, (f"drop level {-k}", gain)])
    return found


def refine(graph: Graph, found: Hierarchy, kind: str = "dcpu", steps: int = 10) -> Hierarchy:
    """found with its nodes moved between sibling blocks, if that raises the value."""
    if len(found.levels) < 2:
        return found
    better = em(graph, found.levels[0], PROPOSES[kind], steps, lambda part: sibling_targets(part, found.levels[1])).part
    levels = [better, *found.levels[1:]]
    value = _value(graph, levels, kind)
    return found if value <= found.value + LEAST else Hierarchy(levels, value, [*found.steps, ("refine", value - found.value)])


def frozen_graph(graph: Graph) -> Graph:
    return Graph(frozen(graph.edges.select("src", "dst", "weight"), "edges"), graph.directed, None if graph.vertices is None else frozen(graph.vertices.select("node"), "nodes"))


def search(graph: Graph, blocks: int, kind: str = "dcpu", part: DataFrame | None = None, most: int = 10, steps: int = 10) -> Hierarchy:
    """From part, or from merges down to so many blocks: levels on top while they help, nodes between siblings, levels away that no longer help."""
    graph = graph.counted()
    first = agglomerate(graph, blocks, PROPOSES[kind]) if part is None else frozen(part.select("node", "block"), "part")
    found = Hierarchy([first], _value(graph, [first], kind))
    found = add_levels(graph, found, kind, most)
    return drop_levels(graph, refine(graph, found, kind, steps), kind)
