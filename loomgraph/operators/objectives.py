"""Objectives of a partition, all to be maximised, and their changes by moves and merges, as DataFrames.

An objective is a sum of terms over block pairs, blocks and totals, and of tables that no move changes; Terms names
them once, and full values and changes both follow from it.  Terms that are zero without edges come from the sparse
table of block pairs.  Terms that also count pairs without edges depend there on the two sizes only, so they are
summed over pairs of distinct block sizes with multiplicities, and the pairs that have edges are corrected: the cost grows
with the edges between blocks and the number of distinct sizes, not with the square of the number of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.special import binary_entropy, lgamma, log_binom, log_partitions_column, xlogx
from loomgraph.operators import partition as P
from loomgraph.operators.graph import Graph
from loomgraph.session import frozen, sized

LN2 = math.log(2)
#: Bytes of a row of the tables by block or by size that joins may broadcast.
ROW = 64


def columns(*names: str) -> tuple[Column, ...]:
    """Columns by name; made within functions, as a session must be there."""
    return tuple(F.col(n) for n in names)


class Blocks:
    """What objectives need of a graph and a partition.  The base tables are read once: block edges and, where an objective asks for single edges, the counted edges are frozen in the shared folder."""

    def __init__(self, graph: Graph, part: DataFrame):
        self.graph, self.part, self._counted = graph, part, None

    def count_edges(self) -> Graph:
        """The graph with one row for each pair of nodes, frozen; what is asked for later starts from it."""
        if self._counted is None:
            self._counted = self.graph.counted()
        return self._counted

    @cached_property
    def edges(self) -> DataFrame:
        return frozen(P.block_edges(self._counted or self.graph, self.part))

    @cached_property
    def stats(self) -> DataFrame:
        return frozen(P.block_stats(self.graph, self.part, self.edges))

    @cached_property
    def pairs(self) -> DataFrame:
        """(r, s, e, nr, ns, kr, ks) of the pairs with edges."""
        a = self.stats.select(F.col("block").alias("r"), F.col("n").alias("nr"), F.col("k_out").alias("kr"))
        b = self.stats.select(F.col("block").alias("s"), F.col("n").alias("ns"), F.col("k_in").alias("ks"))
        return self.edges.join(a, "r").join(b, "s")  # Spark broadcasts the sizes where they are small

    @cached_property
    def sizes(self) -> DataFrame:
        """(n, m): how many blocks have n nodes."""
        return self.stats.groupBy("n").agg(F.count("*").cast("double").alias("m"))

    @cached_property
    def totals(self) -> DataFrame:
        """One row: nodes N, blocks B, edges E, and the chance p of an edge between two nodes."""
        ends = self.edges.agg(F.coalesce(F.sum("e"), F.lit(0.0)).alias("ends"))
        edges = F.col("ends") * (1.0 if self.graph.directed else 0.5)
        chance = (1.0 if self.graph.directed else 2.0) * F.col("E") / (F.col("N") * F.col("N"))
        return self.stats.agg(F.sum("n").alias("N"), F.count("*").cast("double").alias("B")).crossJoin(ends).select("N", "B", edges.alias("E")).withColumn("p", chance)

    def of_blocks(self, term: Column) -> DataFrame:
        return self.stats.agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("v"))

    def of_totals(self, term: Column) -> DataFrame:
        return self.totals.select(term.alias("v"))


@dataclass(frozen=True)
class Terms:
    """What an objective adds up.

    pair(e, nr, ns, kr, ks): over ordered block pairs of a directed graph, over r < s of an undirected one; own(e, n, k): over
    an undirected graph's blocks with themselves; block(n, k_out, k_in); totals(N, B, E).  dense: pairs without edges count
    too.  by_degree: the sum of ln m! over the blocks' numbers m of nodes of equal degree counts.  constant: tables of one value that no
    move changes.  pair and own may use the column p of the totals.
    """

    pair: Callable | None = None
    own: Callable | None = None
    block: Callable | None = None
    totals: Callable | None = None
    dense: bool = False
    by_degree: bool = False
    constant: tuple[Callable[[Blocks], DataFrame], ...] = ()

    def __add__(self, other: Terms) -> Terms:
        return Terms(*(_both(getattr(self, k), getattr(other, k)) for k in ("pair", "own", "block", "totals")), self.dense or other.dense, self.by_degree or other.by_degree, self.constant + other.constant)


def _both(f: Callable | None, g: Callable | None) -> Callable | None:
    return g if f is None else f if g is None else lambda *x: f(*x) + g(*x)


def _ordered(directed: bool, f: Callable, half: bool = False) -> dict:
    """pair and own of a sum of f over all ordered pairs, or of half of it if undirected."""
    if directed:
        return {"pair": f}
    weight = 0.5 if half else 1.0
    return {"pair": lambda *x: 2 * weight * f(*x), "own": lambda e, n, k: weight * f(e, n, n, k, k)}


def parts(b: Blocks, terms: Terms) -> list[DataFrame]:
    """The value of the terms as one-row tables (v) to be added."""
    if terms.constant or terms.by_degree:
        b.count_edges()
    zero, found = F.lit(0.0), []
    if terms.pair is not None:
        e, nr, ns, kr, ks = columns("e", "nr", "ns", "kr", "ks")
        own = terms.own or (lambda e, n, k: terms.pair(e, n, n, k, k))
        pair, mine = terms.pair(e, nr, ns, kr, ks), own(e, nr, kr)
        if terms.dense:
            pair, mine = pair - terms.pair(zero, nr, ns, kr, ks), mine - own(zero, nr, kr)
        value = pair if b.graph.directed else F.when(F.col("r") < F.col("s"), pair).when(F.col("r") == F.col("s"), mine).otherwise(0.0)
        found.append(b.pairs.crossJoin(F.broadcast(b.totals.select("p"))).agg(F.coalesce(F.sum(value), zero).alias("v")))
    if terms.dense:
        x = b.sizes.select(F.col("n").alias("nr"), F.col("m").alias("mr"))
        y = sized(b.sizes.select(F.col("n").alias("ns"), F.col("m").alias("ms")), ROW)
        both = F.col("mr") * F.col("ms") * terms.pair(zero, nr, ns, zero, zero)
        if not b.graph.directed:
            same = F.when(nr == ns, F.col("mr") * (own(zero, nr, zero) - 0.5 * terms.pair(zero, nr, nr, zero, zero))).otherwise(0.0)
            both = 0.5 * both + same
        found.append(x.crossJoin(y).crossJoin(F.broadcast(b.totals.select("p"))).agg(F.coalesce(F.sum(both), zero).alias("v")))
    if terms.block is not None:
        found.append(b.of_blocks(terms.block(*columns("n", "k_out", "k_in"))))
    if terms.totals is not None:
        found.append(b.of_totals(terms.totals(*columns("N", "B", "E"))))
    if terms.by_degree:
        found.append(_degree_counts(b).agg(F.coalesce(F.sum(lgamma(F.col("m") + 1)), zero).alias("v")))
    return found + [f(b) for f in terms.constant]


def _degree_counts(b: Blocks) -> DataFrame:
    """(block, d, m): nodes of a block by degree; directed: by the pair of degrees."""
    graph = b.count_edges()
    if b.graph.directed:
        return P.joint_degree_distribution(graph, b.part).select("block", F.struct("din", "dout").alias("d"), F.col("n").alias("m"))
    return P.degree_distribution(graph, b.part).select("block", F.struct("degree").alias("d"), F.col("n").alias("m"))


def total(parts: list[DataFrame]) -> DataFrame:
    """(objective): the sum of one-row tables."""
    return reduce(DataFrame.unionByName, parts).agg(F.sum("v").alias("objective"))


# the terms of each objective, by whether the graph is directed


def skn_terms(directed: bool) -> Terms:
    return Terms(**_ordered(directed, lambda e, nr, ns, kr, ks: _where(e, e * F.log(e / (nr * ns)))))


def dckn_terms(directed: bool) -> Terms:
    return Terms(**_ordered(directed, lambda e, nr, ns, kr, ks: _where(e, e * F.log(e / (kr * ks)))))


def sps_terms(directed: bool) -> Terms:
    return Terms(**_ordered(directed, lambda e, nr, ns, kr, ks: xlogx(e), True), block=lambda n, o, i: -_degree(directed, o, i) * F.log(n))


def spd_terms(directed: bool) -> Terms:
    return Terms(**_ordered(directed, lambda e, nr, ns, kr, ks: _where(e, -e * binary_entropy(e / (nr * ns))), True))


def dcp_terms(directed: bool) -> Terms:
    return Terms(**_ordered(directed, lambda e, nr, ns, kr, ks: _where(e, e * F.log(e / (kr * ks))), True))


def _where(e: Column, value: Column) -> Column:
    return F.when(e > 0, value).otherwise(0.0)


def _degree(directed: bool, out: Column, into: Column) -> Column:
    return out + into if directed else out


def iclex_terms(directed: bool, prior: float) -> Terms:
    def beta(hits: Column, room: Column) -> Column:
        return lgamma(hits + prior) + lgamma(room - hits + prior) - lgamma(room + 2 * prior) - 2 * math.lgamma(prior)

    return Terms(
        pair=lambda e, x, y, kr, ks: beta(e, x * y),
        own=None if directed else lambda e, x, k: beta(e / 2, x * (x + 1) / 2),
        block=lambda n, o, i: lgamma(n + prior) - math.lgamma(prior),
        totals=lambda N, B, E: lgamma(prior * B) - lgamma(prior * B + N),
        dense=True,
    )


def snr_terms(directed: bool) -> Terms:
    p = F.col("p")
    return Terms(
        pair=lambda e, x, y, kr, ks: lgamma(e + 1) - (e + 1) * F.log(p * x * y + 1),
        own=None if directed else lambda e, x, k: lgamma(e + 1) - (e + 1) * F.log(0.5 * p * x * x + 1),
        block=lambda n, o, i: lgamma(n + 1),
        totals=lambda N, B, E: -F.log(N) + lgamma(B) - lgamma(N + B),
        dense=True,
    )


def dcnr_terms(directed: bool) -> Terms:
    def block(n: Column, o: Column, i: Column) -> Column:
        k = _degree(directed, o, i)
        return k * F.log(n) + lgamma(n) - lgamma(n + k)

    return snr_terms(directed) + Terms(block=block)


def arrangement_terms(directed: bool) -> Terms:
    """ln of the edges' permutations within block pairs."""
    return Terms(pair=lambda e, nr, ns, kr, ks: lgamma(e + 1), own=None if directed else lambda e, n, k: LN2 * e / 2 + lgamma(e / 2 + 1))


def _adjacency(b: Blocks) -> DataFrame:
    """-ln of the multiplicities' factorials; an undirected loop also counts ln 2."""
    a = F.col("weight")
    loop = F.lit(0.0) if b.graph.directed else F.when(F.col("src") == F.col("dst"), LN2 * a).otherwise(0.0)
    return b.count_edges().edges.agg(F.coalesce(F.sum(-lgamma(a + 1) - loop), F.lit(0.0)).alias("v"))


def _degrees(b: Blocks) -> DataFrame:
    """ln of the degrees' factorials."""
    graph = b.count_edges()
    if b.graph.directed:
        return graph.in_out_degrees().agg(F.coalesce(F.sum(lgamma(F.col("din") + 1) + lgamma(F.col("dout") + 1)), F.lit(0.0)).alias("v"))
    return graph.degrees().agg(F.coalesce(F.sum(lgamma(F.col("degree") + 1)), F.lit(0.0)).alias("v"))


def prior_terms(directed: bool) -> Terms:
    """ln P(edge counts) + ln P(partition)."""
    def totals(N: Column, B: Column, E: Column) -> Column:
        room = B * B if directed else B * (B + 1) / 2
        return -log_binom(room + E - 1, E) - lgamma(N + 1) - log_binom(N - 1, B - 1) - F.log(N)

    return Terms(block=lambda n, o, i: lgamma(n + 1), totals=totals)


def non_corrected_terms(directed: bool) -> Terms:
    """ln P(graph | edge counts, partition)."""
    return arrangement_terms(directed) + Terms(block=lambda n, o, i: -_degree(directed, o, i) * F.log(n), constant=(_adjacency,))


def corrected_terms(directed: bool) -> Terms:
    """ln P(graph | degrees, edge counts, partition)."""
    ends = (lambda n, o, i: -lgamma(o + 1) - lgamma(i + 1)) if directed else (lambda n, o, i: -lgamma(o + 1))
    return arrangement_terms(directed) + Terms(block=ends, constant=(_degrees, _adjacency))


def uniform_terms(directed: bool) -> Terms:
    """ln P(degrees) under a uniform prior."""
    one = lambda n, k: -log_binom(n + k - 1, k)
    return Terms(block=(lambda n, o, i: one(n, i) + one(n, o)) if directed else (lambda n, o, i: one(n, o)))


def hyperprior_terms(directed: bool) -> Terms:
    """ln P(degrees) under a uniform prior on degree distributions."""
    q = log_partitions_column
    return Terms(block=(lambda n, o, i: -q(i, n) - q(o, n) - lgamma(n + 1)) if directed else (lambda n, o, i: -q(o, n) - lgamma(n + 1)), by_degree=True)


#: Short name: the objective's terms; a name may be added here.
TERMS: dict[str, Callable[[bool], Terms]] = {
    "skn": skn_terms,
    "dckn": dckn_terms,
    "sps": sps_terms,
    "spd": spd_terms,
    "dcp": dcp_terms,
    "iclexj": lambda directed: iclex_terms(directed, 0.5),
    "iclexu": lambda directed: iclex_terms(directed, 1.0),
    "snr": snr_terms,
    "dcnr": dcnr_terms,
    "spc": lambda directed: non_corrected_terms(directed) + prior_terms(directed),
    "dcpu": lambda directed: corrected_terms(directed) + uniform_terms(directed) + prior_terms(directed),
    "dcpuh": lambda directed: corrected_terms(directed) + hyperprior_terms(directed) + prior_terms(directed),
}


def objective(b: Blocks, name: str, fixed: float = 0.0) -> DataFrame:
    """(objective) of one row: skn and dckn, block model log-likelihoods; sps, spd and dcp, microcanonical entropies, sign flipped; iclexj and
    iclexu, exact integrated likelihoods of simple graphs with priors 1/2 and 1; snr and dcnr, likelihoods with a prior on group
    sizes; spc, dcpu and dcpuh, flat microcanonical models.  fixed: a constant of the entropies to take off."""
    return total(parts(b, TERMS[name](b.graph.directed) + Terms(totals=lambda N, B, E: F.lit(-float(fixed)))))


def _named(name: str) -> Callable[..., DataFrame]:
    return lambda b, fixed=0.0: objective(b, name, fixed)


#: Short name: full objective.
OBJECTIVES: dict[str, Callable[..., DataFrame]] = {name: _named(name) for name in TERMS}
skn, dckn = OBJECTIVES["skn"], OBJECTIVES["dckn"]


def edge_and_partition_prior(b: Blocks) -> list[DataFrame]:
    return parts(b, prior_terms(b.graph.directed))


def non_corrected(b: Blocks) -> list[DataFrame]:
    return parts(b, non_corrected_terms(b.graph.directed))


def corrected(b: Blocks) -> list[DataFrame]:
    return parts(b, corrected_terms(b.graph.directed))


def uniform_degrees(b: Blocks) -> list[DataFrame]:
    return parts(b, uniform_terms(b.graph.directed))


def hyperprior_degrees(b: Blocks) -> list[DataFrame]:
    return parts(b, hyperprior_terms(b.graph.directed))


def level_terms(directed: bool) -> Terms:
    """ln of the priors of a level: edges between its blocks and its partition."""
    return Terms(
        pair=lambda e, x, y, kr, ks: -log_binom(x * y + e - 1, e),
        own=None if directed else lambda e, x, k: -log_binom(x * (x + 1) / 2 + e / 2 - 1, e / 2),
        block=lambda n, o, i: lgamma(n + 1),
        totals=lambda N, B, E: -lgamma(N + 1) - log_binom(N - 1, B - 1) - F.log(N),
        dense=True,
    )


def hierarchy_prior(graph: Graph, levels: list[DataFrame]) -> list[DataFrame]:
    """ln of the priors of all levels; levels[l] is a partition of the blocks of levels[l - 1], levels[0] of the nodes."""
    B, E = columns("B", "E")
    found, at, below = [], graph, None
    for level in levels:
        below = Blocks(at, level)
        found += parts(below, level_terms(graph.directed))
        at = P.quotient(at, level)
    room = B * B if graph.directed else B * (B + 1) / 2
    return [*found, below.of_totals(-log_binom(room + E - 1, E) - F.log(B))]


def hierarchical(graph: Graph, levels: list[DataFrame], kind: str = "dcpu") -> DataFrame:
    """Hierarchical microcanonical model: kind spc, dcpu or dcpuh for the nodes, priors by level."""
    b = Blocks(graph, levels[0])
    of = {"spc": [non_corrected], "dcpu": [corrected, uniform_degrees], "dcpuh": [corrected, hyperprior_degrees]}[kind]
    return total([x for f in of for x in f(b)] + hierarchy_prior(graph, levels))


def level_removal(graph: Graph, levels: list[DataFrame], level: int, kind: str = "dcpu") -> DataFrame:
    """(objective): the change of hierarchical() by taking out one level above the first; the level above it then groups the one below, and only those two levels' priors are new."""
    joined = P.zoom(levels[level], levels[level + 1]) if level + 1 < len(levels) else None
    at = reduce(P.quotient, levels[:level], graph)
    above = [levels[level]] if joined is None else [levels[level], levels[level + 1]]
    before = _suffix(at, above, joined is None)
    if joined is None:
        below = Blocks(reduce(P.quotient, levels[: level - 1], graph), levels[level - 1])
        after = [_top(below)]
    else:
        after = _suffix(at, [joined], False)
    return total([*after, *(x.select((-F.col("v")).alias("v")) for x in before)])


def _suffix(graph: Graph, levels: list[DataFrame], top: bool) -> list[DataFrame]:
    found, below = [], None
    for level in levels:
        below = Blocks(graph, level)
        found += parts(below, level_terms(graph.directed))
        graph = P.quotient(graph, level)
    return [*found, _top(below)] if top else found


def _top(below: Blocks) -> DataFrame:
    """ln of the prior of the edges between the blocks of the last level."""
    B, E = columns("B", "E")
    room = B * B if below.graph.directed else B * (B + 1) / 2
    return below.of_totals(-log_binom(room + E - 1, E) - F.log(B))


# changes


def _changes(b: Blocks, terms: Terms, movers: DataFrame, context: DataFrame, targets: DataFrame, by_degree: Callable | None) -> DataFrame:
    """(mover, r, t, delta): the change of the objective when movers change from block r to block t.

    movers: (mover, r, c, do, di, l): c nodes with degrees do and di and l edges among themselves (counted twice if undirected);
    context: (mover, u, wo, wi): edges to and from the rest of block u; targets: (mover, t), t null for a block of its own.
    Only pairs with r or t change.  Of the other blocks u, those joined to r, to t or to the mover are joined one by one; the rest
    differ by sizes only and are summed by distinct sizes.
    """
    directed, zero = b.graph.directed, F.lit(0.0)
    stats = b.stats
    # equal joins with the frozen tables: Spark broadcasts them where their files are small
    of = lambda c, *names: stats.select(F.col("block").alias(c), *(F.col(k).alias(v) for k, v in zip(("n", "k_out", "k_in"), names)))
    ends = lambda x, y, e: b.edges.select(F.col("r").alias(x), F.col("s").alias(y), F.col("e").alias(e))
    moves = movers.join(targets, "mover").where(~F.col("r").eqNullSafe(F.col("t"))).join(of("r", "nr", "or_", "ir_"), "r").join(of("t", "nt", "ot_", "it_"), "t", "left")
    own = context.select("mover", F.col("u").alias("r"), F.col("wo").alias("wor"), F.col("wi").alias("wir"))
    there = context.select("mover", F.col("u").alias("t"), F.col("wo").alias("wot"), F.col("wi").alias("wit"))
    inner = moves.join(ends("r", "r2", "err").where("r = r2").drop("r2"), "r", "left").join(ends("t", "t2", "ett").where("t = t2").drop("t2"), "t", "left")
    inner = inner.join(ends("r", "t", "ert"), ["r", "t"], "left").join(ends("t", "r", "etr"), ["r", "t"], "left").join(own, ["mover", "r"], "left").join(there, ["mover", "t"], "left")
    inner = inner.na.fill(0.0, ["nt", "ot_", "it_", "err", "ett", "ert", "etr", "wor", "wir", "wot", "wit"]).crossJoin(F.broadcast(b.totals))
    inner = frozen(inner, "moves")  # read by every kind of term
    c, nr, nt, o_r, i_r, o_t, i_t = columns("c", "nr", "nt", "or_", "ir_", "ot_", "it_")
    do, di, loops = columns("do", "di", "l")
    err, ett, ert, etr, wor, wir, wot, wit = columns("err", "ett", "ert", "etr", "wor", "wir", "wot", "wit")
    nr1, nt1, or1, ir1, ot1, it1 = nr - c, nt + c, o_r - do, i_r - di, o_t + do, i_t + di
    pair, mine = terms.pair, terms.own
    keys, results = ("mover", "r", "t"), []
    if pair is not None and directed:
        entries = [
            (1.0, err - wor - wir - loops, nr1, nr1, or1, ir1), (-1.0, err, nr, nr, o_r, i_r), (1.0, ett + wot + wit + loops, nt1, nt1, ot1, it1), (-1.0, ett, nt, nt, o_t, i_t),
            (1.0, ert - wot + wir, nr1, nt1, or1, it1), (-1.0, ert, nr, nt, o_r, i_t), (1.0, etr - wit + wor, nt1, nr1, ot1, ir1), (-1.0, etr, nt, nr, o_t, i_r),
        ]
    elif pair is not None:
        entries = [(1.0, ert + wor - wot, nr1, nt1, or1, ot1), (-1.0, ert, nr, nt, o_r, o_t)]
        results.append(_evaluated(inner, keys, [(1.0, err - 2 * wor - loops, nr1, or1), (-1.0, err, nr, o_r), (1.0, ett + 2 * wot + loops, nt1, ot1), (-1.0, ett, nt, o_t)], mine))
    if terms.dense:  # all other blocks as if without edges, by size; r and t are not among them
        twice = 2.0 if directed else 1.0
        entries += [(sign * twice, zero, x, y, zero, zero) for y in (nr, nt) for sign, x in ((-1.0, nr1), (1.0, nr), (-1.0, nt1), (1.0, nt))]
        grid = sized(b.sizes.select(F.col("n").alias("ns"), F.col("m").alias("ms")), ROW)
        for size, sign in (("nr", -1.0), ("nt", 1.0)):
            distinct = inner.select(size, "c", "p").distinct().crossJoin(grid)
            own_sizes = _evaluated(distinct, (size, "c"), [(twice * F.col("ms"), zero, F.col(size) + sign * c, F.col("ns"), zero, zero), (-twice * F.col("ms"), zero, F.col(size), F.col("ns"), zero, zero)], pair)
            results.append(inner.select(*keys, size, "c").join(own_sizes.groupBy(size, "c").agg(F.sum("v").alias("v")), [size, "c"]).select(*keys, "v"))
    if pair is not None:
        results.append(_evaluated(inner, keys, entries, pair))
    if terms.block is not None:
        some = lambda n, o, i: F.when(n > 0, terms.block(F.greatest(n, F.lit(1.0)), o, i)).otherwise(0.0)
        results.append(_evaluated(inner, keys, [(1.0, nr1, or1, ir1), (-1.0, nr, o_r, i_r), (1.0, nt1, ot1, it1), (-1.0, nt, o_t, i_t)], some))
    if terms.totals is not None:
        N, B, E = columns("N", "B", "E")
        after = B - F.when(nr1 == 0, 1.0).otherwise(0.0) + F.when(nt == 0, 1.0).otherwise(0.0)
        results.append(_evaluated(inner, keys, [(1.0, N, after, E), (-1.0, N, B, E)], terms.totals))
    if pair is not None:
        near = inner.select("mover", "r", "t", "c", "do", "di", "nr", "or_", "ir_", "nt", "ot_", "it_")
        joined = b.edges.select(F.col("r").alias("x"), F.col("s").alias("u")).union(b.edges.select("s", "r")).distinct()
        touched = context.select("mover", "u").join(near.select("mover", "r", "t"), "mover").select("mover", "r", "t", "u")
        for side in ("r", "t"):
            touched = touched.unionByName(near.select("mover", "r", "t").join(joined, F.col("x") == F.col(side)).select("mover", "r", "t", "u"))
        touched = touched.where((F.col("u") != F.col("r")) & (F.col("t").isNull() | (F.col("u") != F.col("t")))).distinct()
        # a new block's number is null: joins on t must find it again
        rows = touched.withColumn("tt", F.coalesce("t", F.lit(-1))).drop("t").join(near.withColumn("tt", F.coalesce("t", F.lit(-1))), ["mover", "r", "tt"])
        rows = rows.join(of("u", "nu", "ou", "iu"), "u").join(context, ["mover", "u"], "left")
        for x, y, e in (("r", "u", "eru"), ("t", "u", "etu"), *((("u", "r", "eur"), ("u", "t", "eut")) if directed else ())):
            rows = rows.join(ends(x, y, e), [x, y], "left")
        rows = rows.na.fill(0.0, ["wo", "wi", "eru", "etu", *(("eur", "eut") if directed else ())]).crossJoin(F.broadcast(b.totals.select("p")))
        nu, ou, iu, wo, wi, eru, etu = columns("nu", "ou", "iu", "wo", "wi", "eru", "etu")

        def moved(e1: Column, e: Column, x1: tuple, x: tuple) -> list[tuple]:
            found = [(1.0, e1, *x1), (-1.0, e, *x)]
            return found + [(-1.0, zero, x1[0], x1[1], zero, zero), (1.0, zero, x[0], x[1], zero, zero)] if terms.dense else found

        outer = moved(eru - wo, eru, (nr1, nu, or1, iu), (nr, nu, o_r, iu)) + moved(etu + wo, etu, (nt1, nu, ot1, iu), (nt, nu, o_t, iu))
        if directed:
            eur, eut = columns("eur", "eut")
            outer += moved(eur - wi, eur, (nu, nr1, ou, ir1), (nu, nr, ou, i_r)) + moved(eut + wi, eut, (nu, nt1, ou, it1), (nu, nt, ou, i_t))
        results.append(_evaluated(rows, keys, outer, pair))
    if terms.by_degree:
        results.append(by_degree(inner.select("mover", "r", "t")))
    return reduce(DataFrame.unionByName, results).groupBy("mover", "r", "t").agg(F.sum("v").alias("delta"))


def _evaluated(rows: DataFrame, keys: tuple[str, ...], entries: list[tuple], f: Callable) -> DataFrame:
    """(keys, v): weight times f(arguments) for every entry (weight, *arguments) of every row; f is written once, so that generated code stays small."""
    double = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("double")
    every = F.array(*(F.struct(*(double(x).alias(f"a{i}") for i, x in enumerate(entry))) for entry in entries))
    kept = [c for c in (*keys, "p") if c in rows.columns]
    one = rows.select(*kept, F.explode(every).alias("x"))
    return one.select(*keys, (F.col("x.a0") * f(*(F.col(f"x.a{i}") for i in range(1, len(entries[0]))))).alias("v"))


def node_deltas(graph: Graph, part: DataFrame, name: str = "dckn", candidates: str | DataFrame = "all") -> DataFrame:
    """(node, from_block, to_block, delta) of moving each node to each other block.

    candidates: all blocks (nodes times blocks rows); near, those in which the node has a neighbour; new, a block of its own
    (to_block null); or a table of the moves (node, to_block).  A block that the node was alone in is gone afterwards.
    """
    b = Blocks(graph, part)
    counted, terms = b.count_edges(), TERMS[name](graph.directed)
    b.part = part
    degrees = counted.in_out_degrees().select("node", F.col("dout").alias("do"), F.col("din").alias("di"))
    loops = P.self_loops(counted)
    movers = part.join(degrees, "node").join(loops, "node", "left").select(F.col("node").alias("mover"), F.col("block").alias("r"), F.lit(1.0).alias("c"), "do", "di", ((1.0 if graph.directed else 2.0) * F.coalesce("loops", F.lit(0.0))).alias("l"))
    context = frozen(P.move_context(counted, part).select(F.col("node").alias("mover"), F.col("block").alias("u"), F.col("k_out").alias("wo"), F.col("k_in").alias("wi")))
    if isinstance(candidates, DataFrame):
        targets = candidates.select(F.col("node").alias("mover"), F.col("to_block").alias("t"))
    elif candidates == "near":
        targets = context.select("mover", F.col("u").alias("t"))
    elif candidates == "new":
        targets = movers.select("mover", F.lit(None).cast(part.schema["block"].dataType).alias("t"))
    else:
        targets = movers.select("mover").crossJoin(sized(b.stats.select(F.col("block").alias("t")), ROW))

    def by_degree(moves: DataFrame) -> DataFrame:
        counts = _degree_counts(b)
        own = counted.in_out_degrees() if graph.directed else counted.degrees()
        d = F.struct("din", "dout") if graph.directed else F.struct("degree")
        rows = moves.join(own.select(F.col("node").alias("mover"), d.alias("d")), "mover")
        rows = rows.join(counts.select(F.col("block").alias("r"), "d", F.col("m").alias("mr")), ["r", "d"]).join(counts.select(F.col("block").alias("t"), "d", F.col("m").alias("mt")), ["t", "d"], "left")
        return rows.select("mover", "r", "t", (F.log(F.coalesce("mt", F.lit(0)) + 1) - F.log("mr")).alias("v"))

    found = _changes(b, terms, movers, context, targets, by_degree)
    return found.select(F.col("mover").alias("node"), F.col("r").alias("from_block"), F.col("t").alias("to_block"), "delta")


def merge_deltas(graph: Graph, part: DataFrame, name: str = "dckn", candidates: str | DataFrame = "all", blocks: Blocks | None = None) -> DataFrame:
    """(block, into, delta) of merging each block into each other one; candidates near: only blocks joined by edges; or a table (block, into).  blocks: those of graph and part, if known."""
    b = Blocks(graph, part) if blocks is None else blocks
    terms = TERMS[name](graph.directed)
    if terms.constant or terms.by_degree:
        b.count_edges()
    inside = b.edges.where("r = s").select(F.col("r").alias("block"), F.col("e").alias("l"))
    movers = b.stats.join(inside, "block", "left").select(F.col("block").alias("mover"), F.col("block").alias("r"), F.col("n").alias("c"), F.col("k_out").alias("do"), F.col("k_in").alias("di"), F.coalesce("l", F.lit(0.0)).alias("l"))
    apart = b.edges.where("r <> s")
    both = apart.select(F.col("r").alias("mover"), F.col("s").alias("u"), F.col("e").alias("wo"), F.lit(0.0).alias("wi")).unionByName(apart.select(F.col("s").alias("mover"), F.col("r").alias("u"), F.lit(0.0).alias("wo"), F.col("e").alias("wi")))
    context = both.groupBy("mover", "u").agg(F.sum("wo").alias("wo"), F.sum("wi").alias("wi"))
    if isinstance(candidates, DataFrame):
        targets = candidates.select(F.col("block").alias("mover"), F.col("into").alias("t"))
    elif candidates == "near":
        targets = context.select("mover", F.col("u").alias("t"))
    else:
        targets = movers.select("mover").crossJoin(sized(b.stats.select(F.col("block").alias("t")), ROW))

    def by_degree(moves: DataFrame) -> DataFrame:
        counts = _degree_counts(b)
        rows = moves.join(counts.select(F.col("block").alias("r"), "d", F.col("m").alias("mr")), "r").join(counts.select(F.col("block").alias("t"), "d", F.col("m").alias("mt")), ["t", "d"])
        return rows.select("mover", "r", "t", (lgamma(F.col("mr") + F.col("mt") + 1) - lgamma(F.col("mr") + 1) - lgamma(F.col("mt") + 1)).alias("v"))

    found = _changes(b, terms, movers, context, targets, by_degree)
    return found.select(F.col("r").alias("block"), F.col("t").alias("into"), "delta")


def best_moves(deltas: DataFrame, least: float = 0.001) -> DataFrame:
    """(node, from_block, to_block, delta): each node's best move above least, the smallest block on ties."""
    top = deltas.groupBy("node", "from_block").agg(F.max(F.struct(F.round("delta", 9).alias("d"), (-F.col("to_block")).alias("t"), "delta")).alias("x"))
    return top.where(F.col("x.delta") > least).select("node", "from_block", (-F.col("x.t")).alias("to_block"), F.col("x.delta").alias("delta"))
