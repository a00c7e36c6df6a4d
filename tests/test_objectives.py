import math

import numpy as np
import pytest

from loomgraph.operators import kernels as K
from loomgraph.operators import selection
from loomgraph.operators.graph import Graph
from loomgraph.operators.objectives import OBJECTIVES, Blocks, corrected, edge_and_partition_prior, hierarchical, hyperprior_degrees, node_deltas, non_corrected, total, uniform_degrees
from loomgraph.sources.readers import karate

WALKS = [[0, 0, 1, 2, 3], [0, 1, 2, 3, 0], [0, 1, 2, 3, 0, 0], [0, 1, 2, 3, 0, 0], [0, 1, 2, 3, 0, 4]]


def walk(spark, nodes, directed, extra=(), mod=2):
    edges = [(a, b, 1.0) for a, b in zip(nodes, nodes[1:])] + [(a, b, 1.0) for a, b in extra]
    part = [(i, i % mod) for i in sorted({x for e in edges for x in e[:2]})]
    table = spark.createDataFrame(part, "node long, block int")
    return Blocks(Graph(spark.createDataFrame(edges, "src long, dst long, weight double"), directed, table.select("node")), table)


def flat(spark, k, directed):
    return walk(spark, WALKS[k], directed, [(2, 2)] if k == 3 else [])


def value(df):
    return df.first().objective


UNDIRECTED = {
    "corrected": [12 / 60, 16 / 24, 96 / 360, 576 / 5040, 48 / 360],
    "non_corrected": [3 / 128, 3 / 32, 3 / 128, 3 / 256, 1 / 243],
    "uniform": [1 / 24, 1 / 25, 1 / 35, 1 / 45, 1 / 140],
    "hyper": [1 / 24, 1 / 9, 1 / 24, 1 / 15, 1 / 126],
    "prior": [1 / (15 * 72), 1 / (15 * 72), 1 / (21 * 72), 1 / (28 * 72), 1 / (21 * 200)],
}
DIRECTED = {"corrected": [1 / 6, 1 / 4, 1 / 9, 1 / 18, 1 / 18], "non_corrected": [1 / 128, 1 / 64, 1 / 256, 1 / 512, 1 / 2916], "uniform": [1 / 72, 1 / 81, 1 / 144, 1 / 225, 1 / 900]}
TERMS = {"corrected": corrected, "non_corrected": non_corrected, "uniform": uniform_degrees, "hyper": hyperprior_degrees, "prior": edge_and_partition_prior}


@pytest.mark.parametrize("directed, table", [(False, UNDIRECTED), (True, DIRECTED)])
def test_flat_terms(spark, directed, table):
    for k in (0, 1, 3, 4):
        b = flat(spark, k, directed)
        for term, want in table.items():
            assert value(total(TERMS[term](b))) == pytest.approx(math.log(want[k]), abs=1e-9), (term, k)


def test_exact_likelihood_and_group_sizes(spark):
    ln = math.log
    assert value(OBJECTIVES["iclexj"](walk(spark, [0, 1, 2, 3, 0], True))) == pytest.approx(2 * ln(3 / 128) + 2 * ln(35 / 128) + ln(3 / 128))
    assert value(OBJECTIVES["iclexj"](walk(spark, [0, 1, 2, 3, 0, 0], True))) == pytest.approx(2 * ln(3 / 128) + ln(5 / 128) + ln(35 / 128) + ln(3 / 128))
    assert value(OBJECTIVES["snr"](walk(spark, [0, 1, 2, 3, 0], False))) == pytest.approx(ln(1 / 4860))
    assert value(OBJECTIVES["snr"](walk(spark, [0, 1, 2, 3, 0, 0], False))) == pytest.approx(ln(2.9715955350507e-5), rel=1e-9)


def test_penalties(spark):
    ln = math.log
    path4, star4 = walk(spark, [0, 1, 2, 3], False), walk(spark, [], True, [(0, 1), (0, 2), (0, 3)])
    graph, _ = karate(spark)
    club = Blocks(graph, graph.nodes.selectExpr("node", "cast(node % 3 as int) as block"))
    h = lambda x: (1 + x) * ln(1 + x) - x * ln(x)
    want = {
        "mdl_traditional": (3 * ln(2) + 3 * ln(3), 3 * ln(2) + 4 * ln(3), 78 * ln(3) + 6 * ln(78)),
        "mdl": (-2 * ln(2) + ln(5) + ln(10), -2 * ln(2) + ln(5) + ln(20), ln(630) + ln(29034396) - 2 * ln(39916800) - ln(479001600)),
        "aic": (5, 6, 9),
        "bic": (1.5 * ln(16), 2 * ln(16), 3 * ln(34**2)),
        "bic_sparse": (1.5 * ln(64), 2 * ln(64), 3 * ln(34**3)),
        "icl": (0.5 * ln(4) + 1.5 * ln(6), 0.5 * ln(4) + 2 * ln(16), ln(34) + 3 * ln(561)),
        "mdl_first": (10 * ln(2), 3 * h(4 / 3) + 4 * ln(2), 78 * h(1 / 13) + 34 * ln(3)),
    }
    for name, values in want.items():
        for b, v in zip((path4, star4, club), values):
            assert value(selection.PENALTIES[name](b)) == pytest.approx(v, rel=1e-9), name
    assert value(selection.mdl(path4, True)) - value(selection.mdl(path4)) == pytest.approx(-4 * ln(0.5))
    assert value(selection.mdl(club, True)) - value(selection.mdl(club)) == pytest.approx(53.4782992808356)
    assert [len(selection.APPLICABLE[o]) for o in ("snr", "dckn", "skn")] == [1, 6, 7]
    assert selection.exponential_search(lambda k: (k - 11) ** 2, 40) == 11


def random_graph(random, n, m, directed):
    src, dst = random.integers(0, n, m), random.integers(0, n, m)
    return src, dst, random.integers(1, 3, m).astype(float)


@pytest.mark.parametrize("directed", [False, True])
@pytest.mark.parametrize("name", sorted(OBJECTIVES))
def test_kernels_agree_with_tables_and_deltas_with_values(spark, name, directed):
    random = np.random.default_rng(4)
    src, dst, w = random_graph(random, 14, 40, directed)
    if name.startswith("iclex") or name == "spd":
        pairs = np.unique(np.stack([src, dst] if directed else [np.minimum(src, dst), np.maximum(src, dst)]), axis=1)
        (src, dst), w = pairs, np.ones(pairs.shape[1])
    labels = np.arange(14) % 3
    s = K.State(14, src, dst, w, directed, labels, 3, name)
    part = spark.createDataFrame([(i, int(b)) for i, b in enumerate(labels)], "node long, block int")
    graph = Graph(spark.createDataFrame([(int(a), int(b), float(x)) for a, b, x in zip(src, dst, w)], "src long, dst long, weight double"), directed, part.select("node"))
    assert s.value() == pytest.approx(value(OBJECTIVES[name](Blocks(graph, part))), rel=1e-9)
    for i in range(14):
        for t in range(3):
            d, before = s.delta(i, t), s.value()
            r = int(s.b[i])
            s.move(i, t)
            assert s.value() - before == pytest.approx(d, abs=1e-6)
            s.move(i, r)
            assert s.value() == pytest.approx(before, abs=1e-9)


def test_delta_tables(spark):
    graph, _ = karate(spark)
    part = graph.nodes.selectExpr("node", "cast(node % 3 as int) as block")
    e = graph.edges.toPandas()
    for name in ("skn", "dckn"):
        s = K.State(34, e.src, e.dst, e.weight, False, np.arange(34) % 3, 3, name)
        rows = node_deltas(graph, part, name).collect()
        assert len(rows) == 68
        for r in rows:
            assert r.delta == pytest.approx(s.delta(r.node, r.to_block), abs=1e-8)


@pytest.mark.parametrize("directed", [False, True])
def test_hierarchy(spark, directed):
    edges = [(a, b, 1.0) for a in range(6) for b in range(6) if (a < b or (directed and a != b)) and (a + b) % 3]
    levels = [[0, 0, 1, 1, 2, 2], [0, 1, 1]]
    graph = Graph(spark.createDataFrame(edges, "src long, dst long, weight double"), directed)
    tables = [spark.createDataFrame([(i, b) for i, b in enumerate(level)], "node int, block int") for level in levels]
    src, dst, w = (np.array(x) for x in zip(*edges))
    for kind in ("spc", "dcpu", "dcpuh"):
        assert value(hierarchical(graph, tables, kind)) == pytest.approx(K.hierarchy_value([np.array(x) for x in levels], 6, src, dst, w, directed, kind), rel=1e-9)
    # one level with the singleton on top is the flat model
    flat_value = value(OBJECTIVES["dcpu"](Blocks(graph, tables[0])))
    assert math.isfinite(flat_value)
