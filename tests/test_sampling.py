"""Exponential races and batches of sampling steps against counts, a sequential kernel and full objective values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import kernels as K
from loomgraph.operators import sampling
from loomgraph.operators.graph import Graph
from loomgraph.operators.objectives import OBJECTIVES, Blocks
from loomgraph.session import frozen

# 0.999 quantiles of chi-square by degrees of freedom.
CHI2 = {1: 10.83, 2: 13.82, 3: 16.27, 4: 18.47, 5: 20.52, 6: 22.46, 7: 24.32}


def random_graph(spark, n=24, blocks=4, seed=2, loops=True):
    random = np.random.default_rng(seed)
    pairs = {(int(min(p)), int(max(p))) for p in random.integers(0, n, (3 * n, 2)) if loops or p[0] != p[1]}
    rows = [(a, b, float(random.integers(1, 4))) for a, b in sorted(pairs)] + [(i, (i + 1) % n, 1.0) for i in range(n)]
    labels = random.permutation(np.arange(n) % blocks)
    part = spark.createDataFrame([(i, int(b)) for i, b in enumerate(labels)], "node long, block int")
    return Graph(spark.createDataFrame(rows, "src long, dst long, weight double"), False, part.select("node")).counted(), frozen(part, "part"), rows, labels


def state(rows, labels, blocks=4, name="dckn"):
    src, dst, w = (np.array(x) for x in zip(*rows))
    return K.State(len(labels), src, dst, w, False, labels.copy(), blocks, name)


def chance(s, i, t, epsilon):
    weights = s.context(i)[0]
    return float((weights / weights.sum() * (s.E[:, t] + epsilon) / (s.E.sum(1) + epsilon * s.B)).sum()) if weights.sum() else 1 / s.B


def test_races_draw_in_proportion(spark):
    weights = [5.0, 1.0, 0.0, 2.5, 1.5]
    rows = spark.range(6000).select(F.col("id").alias("key"), F.posexplode(F.array(*map(F.lit, weights))).alias("item", "w"))
    won = sampling.race(rows, ["key"], ["item"], "w", 3)
    counts = {r.item: r["count"] for r in won.groupBy("item").count().collect()}
    assert sum(counts.values()) == 6000 and 2 not in counts
    want = {i: 6000 * w / sum(weights) for i, w in enumerate(weights) if w}
    assert sum((counts[i] - e) ** 2 / e for i, e in want.items()) < CHI2[3]
    assert won.exceptAll(sampling.race(rows.repartition(7), ["key"], ["item"], "w", 3)).count() == 0  # the same seed, the same draw
    assert won.exceptAll(sampling.race(rows, ["key"], ["item"], "w", 4)).count() > 1000


def test_chances_are_those_of_the_sequential_sampler(spark):
    graph, part, rows, labels = random_graph(spark)
    s = sampling.state_of(graph, part)
    moves = part.select("node", F.col("block").alias("r")).join(spark.range(4).select(F.col("id").cast("int").alias("t")), F.col("r") != F.col("t"))
    own = state(rows, labels)
    for m in sampling.chances(s, moves, 0.2).collect():
        forth = chance(own, m.node, m.t, 0.2)
        kit = own.context(m.node)
        own.move(m.node, m.t, kit)
        back = chance(own, m.node, m.r, 0.2)
        own.move(m.node, m.r, kit)
        assert (m.forth, m.back) == pytest.approx((forth, back), abs=1e-12)


def test_proposals_are_drawn_by_their_chances(spark):
    graph, part, rows, labels = random_graph(spark, 10, 4, loops=False)
    copies, shift = 900, 100
    edges = spark.range(copies).crossJoin(graph.edges).select((F.col("src") + shift * F.col("id")).alias("src"), (F.col("dst") + shift * F.col("id")).alias("dst"), "weight")
    many = spark.range(copies).crossJoin(part).select((F.col("node") + shift * F.col("id")).alias("node"), "block")
    s = sampling.state_of(Graph(edges, False, many.select("node")), frozen(many, "part"))
    seen = {(r.i, r.t): r.n for r in sampling.proposals(s, 5, 300.0).groupBy((F.col("node") % shift).alias("i"), "t").agg(F.count("*").alias("n")).collect()}
    moves = part.select("node", F.col("block").alias("r")).join(spark.range(4).select(F.col("id").cast("int").alias("t")), F.col("r") != F.col("t"))
    forth = {(r.node, r.t): r.forth for r in sampling.chances(s, moves, 300.0).collect()}
    for i in range(10):
        own = {t: copies * p for (j, t), p in forth.items() if j == i}
        stay = copies - sum(own.values())
        x = sum((seen.get((i, t), 0) - e) ** 2 / e for t, e in own.items()) + (copies - sum(seen.get((i, t), 0) for t in own) - stay) ** 2 / stay
        assert x < CHI2[3], i


@pytest.mark.parametrize("name", ["dckn", "skn", "sps"])
def test_moves_that_go_on_together_add_up(spark, name):
    random = np.random.default_rng(1)
    rows = [(i, (i + k) % 150, 1.0) for i in range(150) for k in (1, 2)] + [(int(a), int(b), 2.0) for a, b in random.integers(0, 150, (12, 2))]
    part = frozen(spark.createDataFrame([(i, i // 3) for i in range(150)], "node long, block int"), "part")
    graph = Graph(spark.createDataFrame(rows, "src long, dst long, weight double"), False, part.select("node")).counted()
    s = sampling.state_of(graph, part)
    moves = frozen(sampling.apart(s.edges, s.context, frozen(sampling.proposals(s, 1), "proposed"), 1, sampling.TERMS[name](False).dense), "moves")
    chosen = moves.collect()
    assert len(chosen) == 1 if sampling.TERMS[name](False).dense else len(chosen) > 3
    deltas = sampling.node_deltas(graph, part, name, moves.select("node", F.col("t").alias("to_block")))
    total = deltas.agg(F.sum("delta")).first()[0]
    after = part.join(moves, "node", "left").select("node", F.coalesce("t", "block").alias("block"))
    value = lambda p: OBJECTIVES[name](Blocks(graph, p)).first().objective
    assert value(after) - value(part) == pytest.approx(total, abs=1e-7)


def test_sampling_improves_and_keeps_its_value(spark):
    graph, part, _, _ = random_graph(spark, 40, 4, 3)
    found = sampling.metropolis_hastings(graph, part, "dckn", 8, 2, beta=lambda t: 50.0)
    value = lambda p: OBJECTIVES["dckn"](Blocks(graph, p)).first().objective
    assert found.value == pytest.approx(value(found.best), abs=1e-7)
    assert found.value >= value(part) and found.looked_at >= 8 and found.moves >= 1
    assert found.best.select("block").distinct().count() == 4
