"""The tri-factorisation X ~ Z S Z' to convergence as tables: one colour of nodes at a time.

With S fixed the error is |X|^2 - 2 L + M.  L sums x_ij w_i w_j S(v_i, v_j) over entries of X, M sums a_k a_l S_kl^2
over blocks, where a block's mass a_k sums w_i^2 over its nodes.  Nodes of one colour share no entry of X, so L is a sum over
them, and M depends on their moves through the masses alone.  So the error after all of a colour's nodes move at once is
exact from two grouped sums; where it would not fall, half of the movers, by a hash, stay, and so on.

z(node, v, w); s(k, l, val) may leave out zeros; x is symmetric.  Sides are broadcast by their counted size only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.special import least_quartic
from loomgraph.operators.factor import normalised, relative_error, s_matrix
from loomgraph.session import BROADCAST_BYTES, discard, frozen, sized

#: A gain counts from this share of the norm's square on; halvings of a colour's movers before it is left as it is.
LEAST, HALVINGS = 1e-13, 40
ROW = 48


def colours(x: DataFrame, seed: int = 0) -> DataFrame:
    """(node, colour): neighbours in x have different colours, from 0 on.

    A node takes the first colour that no neighbour has once all neighbours of a higher priority have theirs: the greedy colouring in the
    order of priorities, in as many rounds as a chain of falling priorities is long.  More neighbours go first, which keeps colours
    and chains few, then a hash by seed.
    """
    links = frozen(x.where("src <> dst").select(F.col("src").alias("node"), F.col("dst").alias("other")).distinct(), "links")
    degrees = frozen(links.groupBy("node").agg(F.count("*").alias("d")), "degrees")
    ranked = links.join(degrees, "node").join(degrees.select(F.col("node").alias("other"), F.col("d").alias("e")), "other")
    rank = lambda d, c: F.struct(d, F.xxhash64(c, F.lit(seed)), c)
    above = frozen(ranked.where(rank("e", "other") > rank("d", "node")).select("node", "other"), "above")
    nodes = x.select(F.col("src").alias("node")).distinct()
    done = frozen(nodes.join(above, "node", "left_anti").select("node", F.lit(0).alias("colour")), "colours")
    rest = frozen(above.groupBy("node").agg(F.count("*").alias("waits"), F.lit(0).alias("known")).select("node", "waits", F.array().cast("array<int>").alias("used")), "waiting")
    new, found = done, done
    while not rest.isEmpty():
        seen = above.join(sized(new.select(F.col("node").alias("other"), "colour"), ROW), "other").groupBy("node").agg(F.count("*").alias("n"), F.collect_set("colour").alias("more"))
        after = rest.join(seen, "node", "left").select("node", (F.col("waits") - F.coalesce("n", F.lit(0))).alias("waits"), F.array_union("used", F.coalesce("more", F.array().cast("array<int>"))).alias("used"))
        after = frozen(after, "waiting")
        discard(rest)
        free = F.array_min(F.array_except(F.sequence(F.lit(0), F.size("used")), F.col("used")))
        new = frozen(after.where("waits = 0").select("node", free.alias("colour")), "colours")
        found, rest = found.unionByName(new), after.where("waits > 0")
    return found


@dataclass(frozen=True)
class Coupling:
    """S without zeros, frozen, and whether its rows and the blocks are few enough, as counted, to broadcast."""

    rows: DataFrame
    few: bool

    def side(self, df: DataFrame) -> DataFrame:
        """df, of at most as many rows, with a broadcast hint if they are few."""
        return F.broadcast(df) if self.few else df


def coupling(s: DataFrame, z: DataFrame) -> Coupling:
    rows = frozen(s.where("val <> 0").select("k", "l", "val", (F.col("val") * F.col("val")).alias("q")), "s")
    return Coupling(rows, max(rows.count(), z.select("v").distinct().count()) * ROW <= BROADCAST_BYTES)


def _reach(z: DataFrame, s: Coupling) -> DataFrame:
    """(k, wp2): sum of a_l S_kl^2, what every node's weight in k meets in M."""
    mass = z.groupBy("v").agg(F.sum(F.col("w") * F.col("w")).alias("a"))
    return s.rows.join(s.side(mass), F.col("k") == F.col("v")).groupBy(F.col("l").alias("k")).agg(F.sum(F.col("a") * F.col("q")).alias("wp2"))


def _quartic(a: Column, b: Column, c: Column, w: Column) -> Column:
    return a * w**4 + b * w**2 + c * w


def proposals(x: DataFrame, z: DataFrame, s: Coupling, movers: DataFrame) -> DataFrame:
    """(node, v, w, nv, nw, gain) of the movers(node) that gain: each one's best block and weight given all others, the smaller block on ties.

    Candidates are the node's own block and those that S joins to a neighbour's block.  gain: the fall of the error's square.
    """
    rows = s.side(s.rows.select(F.col("k").alias("v"), F.col("l"), "val"))
    near = x.where("src <> dst").join(movers.select(F.col("node").alias("src")), "src", "left_semi")
    pulls = near.join(z.select(F.col("node").alias("dst"), "v", "w"), "dst").groupBy("src", "v").agg(F.sum(F.col("weight") * F.col("w")).alias("t"))
    c = pulls.join(rows, "v").groupBy(F.col("src").alias("node"), F.col("l").alias("k")).agg((-4 * F.sum(F.col("t") * F.col("val"))).alias("c"))
    own = z.join(movers.select("node"), "node", "left_semi")
    every = c.unionByName(own.select("node", F.col("v").alias("k"), F.lit(0.0).alias("c"))).groupBy("node", "k").agg(F.sum("c").alias("c"))
    diagonal = s.side(s.rows.where("k = l").select("k", F.col("val").alias("skk")))
    loops = x.where("src = dst").groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("xii"))
    table = every.join(own, "node").join(s.side(s.rows.select(F.col("k").alias("v"), F.col("l").alias("k"), "val")), ["v", "k"], "left")
    table = table.join(loops, "node", "left").join(s.side(_reach(z, s)), "k", "left").join(diagonal, "k", "left").na.fill(0.0, ["val", "xii", "wp2", "skk"])
    a = F.greatest(F.col("skk") * F.col("skk"), F.lit(1e-12))
    met = F.col("w") * F.col("val")
    b = 2 * (F.col("wp2") - met * met) - 2 * F.col("xii") * F.col("skk")
    table = table.withColumns({"a": a, "b": b}).withColumn("nw", least_quartic(F.col("a"), F.col("b"), F.col("c")))
    value = F.when(F.col("nw").isNotNull(), _quartic(F.col("a"), F.col("b"), F.col("c"), F.col("nw"))).otherwise(0.0)
    now = F.max(F.when(F.col("k") == F.col("v"), _quartic(F.col("a"), F.col("b"), F.col("c"), F.col("w")))).alias("now")
    best = F.min(F.when(F.col("nw").isNotNull(), F.struct(F.round(value, 9).alias("r"), F.col("k"), F.col("nw").alias("x"), value.alias("f")))).alias("t")
    return table.groupBy("node", "v", "w").agg(now, best).where("t is not null").select("node", "v", "w", F.col("t.k").alias("nv"), F.col("t.x").alias("nw"), (F.col("now") - F.col("t.f")).alias("gain"))


def joint_gain(moves: DataFrame, s: Coupling) -> float:
    """The fall of the error's square if all moves, of nodes that share no entry of x, are made at once.

    The moves' own gains, less what their masses meet of each other: m' S2 m of the summed changes of mass, without each mover's own.
    """
    old, new = F.col("w") * F.col("w"), F.col("nw") * F.col("nw")
    change = moves.select(F.explode(F.array(F.struct(F.col("v").alias("k"), (-old).alias("m")), F.struct(F.col("nv").alias("k"), new.alias("m")))).alias("e")).select("e.k", "e.m")
    mass = change.groupBy("k").agg(F.sum("m").alias("m"))
    joint = s.rows.join(s.side(mass), "k").join(s.side(mass.select(F.col("k").alias("l"), F.col("m").alias("ml"))), "l").agg(F.sum(F.col("m") * F.col("ml") * F.col("q")).alias("joint"))
    at = lambda a, b, name: s.side(s.rows.select(F.col("k").alias(a), F.col("l").alias(b), F.col("q").alias(name)))
    on = lambda a, name: s.side(s.rows.where("k = l").select(F.col("k").alias(a), F.col("q").alias(name)))
    each = moves.join(on("v", "qo"), "v", "left").join(on("nv", "qn"), "nv", "left").join(at("v", "nv", "qx"), ["v", "nv"], "left").na.fill(0.0, ["qo", "qn", "qx"])
    alone = F.sum(old * old * F.col("qo") + new * new * F.col("qn") - 2 * old * new * F.col("qx"))
    row = each.agg(F.sum("gain").alias("g"), alone.alias("a")).join(F.broadcast(joint), F.lit(True)).first()  # one row each
    return (row.g or 0.0) + (row.a or 0.0) - (row.joint or 0.0)


def colour_step(x: DataFrame, z: DataFrame, s: Coupling, movers: DataFrame, least: float = 0.0, seed: int = 0) -> tuple[DataFrame, float]:
    """(z, gain) after the movers, nodes that share no entry of x, took their best blocks and weights, all at once or the half of them, a quarter ... with which the error falls by more than least."""
    moves = frozen(proposals(x, z, s, movers).where(F.col("gain") > least), "moves")
    share = F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    for k in range(HALVINGS):
        taken = moves.where(share < 0.5**k) if k else moves
        if taken.isEmpty():
            if k == 0:
                return z, 0.0
            taken = moves.orderBy(F.desc("gain"), "node").limit(1)  # one mover's gain is exact
        gain = joint_gain(taken, s)
        if gain > least:
            after = z.join(taken.select("node", "nv", "nw"), "node", "left").select("node", F.coalesce("nv", "v").alias("v"), F.coalesce("nw", "w").alias("w"))
            return frozen(after, "z"), gain
    return z, 0.0


@dataclass
class Descent:
    """Factors z(node, v, w) and s(k, l, val), the error after every sweep, and why it ended."""

    z: DataFrame
    s: DataFrame
    errors: list[float] = field(default_factory=list)
    status: str = "sweep limit"


def frost(x: DataFrame, z: DataFrame, sweeps: int = 100, delta: float = 1e-7, seed: int = 0, colouring: DataFrame | None = None) -> Descent:
    """Block coordinate descent from z until the error changes by under delta: in every sweep each colour once, then weights of norm 1 and S anew.

    Neither part of a sweep lets the error rise: S = Z'XZ is the best for its Z.  Freeze x first.
    """
    colouring = frozen(colours(x, seed) if colouring is None else colouring, "colours")
    count = (colouring.agg(F.max("colour")).first()[0] or 0) + 1
    norm2 = x.agg(F.sum(F.col("weight") * F.col("weight"))).first()[0] or 0.0
    z = frozen(normalised(z), "z")
    s = frozen(s_matrix(x, z), "s")
    found = Descent(z, s, [relative_error(x, s).first().error])
    for sweep in range(sweeps):
        moved, own = z, coupling(s, z)
        for c in range(count):
            after, _ = colour_step(x, moved, own, colouring.where(F.col("colour") == c), LEAST * norm2, seed + sweep)
            if moved is not z and after is not moved:
                discard(moved)
            moved = after
        if moved is z:
            found.status = "done"
            break
        z = frozen(normalised(moved), "z")
        s = frozen(s_matrix(x, z), "s")
        error = relative_error(x, s).first().error
        last = found.errors[-1]
        found = Descent(z, s, [*found.errors, error])
        if error < delta or math.fabs(last - error) < delta:
            found.status = "done"
            break
    return found
