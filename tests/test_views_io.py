import math

import numpy as np
import pytest

from loomgraph.functions import special
from loomgraph.operators import generators, metrics
from loomgraph.operators import partition as P
from loomgraph.operators.components import components
from loomgraph.operators.graph import Graph, reindexed
from loomgraph.sources import readers
from loomgraph.streaming.blocks import block_edges as streamed


def graph_of(spark, edges, directed):
    return Graph(spark.createDataFrame([(*e, 1.0)[:3] if len(e) == 2 else e for e in edges], "src long, dst long, weight double"), directed)


def test_block_views(spark):
    ring = [(i, (i + 1) % 10) for i in range(10)] + [(0, 5), (1, 4)]
    g = graph_of(spark, ring, True)
    part = spark.createDataFrame([(i, i % 3) for i in range(10)], "node long, block int")
    e = {(r.r, r.s): r.e for r in P.block_edges(g, part).collect()}
    assert [[e.get((r, s), 0) for s in range(3)] for r in range(3)] == [[1, 3, 1], [0, 1, 3], [3, 0, 0]]
    stats = {r.block: (r.n, r.k_out, r.k_in) for r in P.block_stats(g, part).collect()}
    assert stats == {0: (4, 5, 4), 1: (3, 4, 4), 2: (3, 3, 4)}
    cycle = graph_of(spark, [(1, 2), (2, 3), (3, 4), (4, 1)], False)
    two = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (4, 1)], "node long, block int")
    assert {(r.r, r.s): r.e for r in P.block_edges(cycle, two).collect()} == {(0, 1): 4, (1, 0): 4}
    multi = graph_of(spark, [e for e in [(1, 2, 0.5), (2, 3, 0.5), (3, 4, 0.5), (4, 1, 0.5)] for _ in range(2)], False)
    assert {(r.r, r.s): r.e for r in P.block_edges(multi, two).collect()} == {(0, 1): 4, (1, 0): 4}
    loop = graph_of(spark, [(0, 0), (0, 1), (1, 2), (2, 3)], False)
    assert {r.node: r.degree for r in loop.degrees().collect()}[0] == 3
    assert loop.adj_matrix().where("src = 0 and dst = 0").first().weight == 1
    rand = P.random_partition(g.nodes, 4, 3)
    assert P.block_sizes(rand).count() == 4
    with_cov = Graph(spark.createDataFrame([(0, 1, 1.0, 5.0), (1, 1, 1.0, 2.0)], "src long, dst long, weight double, covariate double"), False)
    same = spark.createDataFrame([(0, 0), (1, 1)], "node long, block int")
    assert {(r.r, r.s): r["cov"] for r in P.covariate_sums(with_cov, same).collect()} == {(0, 1): 5, (1, 0): 5, (1, 1): 2}


def test_components_and_numbers(spark):
    g = graph_of(spark, [(1, 2), (2, 3), (10, 11), (20, 20)], True)
    assert {r.node: r.root for r in components(g.edges).collect()} == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10}
    assert sorted(r.node for r in g.largest_component().nodes.collect()) == [1, 2, 3]
    assert {r.node: r.idx for r in reindexed(spark.createDataFrame([(7,), (3,), (9,), (3,)], "node long")).collect()} == {3: 0, 7: 1, 9: 2}


def test_special_functions(spark):
    xs = [0.5, 1.0, 1.5, 2.0, 7.25, 100.0, 12345.5, 1e7]
    row = spark.range(1).select(*(special.lgamma(x).alias(f"c{i}") for i, x in enumerate(xs)), special.log_binom(10.0, 3.0).alias("b"), special.log_binom(3.0, 10.0).alias("z"), special.least_quartic(2.0, -3.0, -1.0).alias("q")).first()
    for i, x in enumerate(xs):
        assert row[i] == pytest.approx(math.lgamma(x), rel=1e-12, abs=1e-12)
    assert row.b == pytest.approx(math.log(120)) and row.z == 0
    grid = np.linspace(1e-6, 3, 100001)
    assert row.q == pytest.approx(grid[(2 * grid**4 - 3 * grid**2 - grid).argmin()], abs=1e-3)
    table = [[1] * 11] + [[0] + [sum(1 for _ in parts(m, n)) for n in range(1, 11)] for m in range(1, 11)]
    for m in range(11):
        for n in range(11):
            want = table[m][n]
            assert special.log_partitions(m, n) == (pytest.approx(math.log(want)) if want else -math.inf)
    assert special.log_partitions(1000, 1) == 0 == special.log_partitions(999, 1)
    for n in (3, 40, 600):
        assert special.log_partitions(1001, n) == pytest.approx(special.log_partitions(999, n), rel=0.02)
    assert special.dilogarithm(1.0) == 0 and special.dilogarithm(0.5) == pytest.approx(math.pi**2 / 12 - math.log(2) ** 2 / 2)


def parts(m, most, largest=None):
    """Partitions of m into at most so many parts."""
    if m == 0:
        yield ()
        return
    if most == 0:
        return
    for k in range(min(m, largest or m), 0, -1):
        for rest in parts(m - k, most - 1, k):
            yield (k, *rest)


def test_agreement(spark):
    a, b = [0, 0, 1, 1], [0, 1, 2, 3]
    frame = lambda x: spark.createDataFrame([(i, v) for i, v in enumerate(x)], "node int, block int")
    assert metrics.nmi(frame(a), frame(b)).first().nmi == pytest.approx(math.log(2) / math.sqrt(math.log(2) * math.log(4)))
    assert metrics.nmi(frame(a), frame([0] * 4)).first().nmi == 0
    assert metrics.nmi(frame([0] * 4), frame([0] * 4), "arithmetic").first().nmi == 1
    assert metrics.nmi_value(a, b) == pytest.approx(math.log(2) / math.sqrt(math.log(2) * math.log(4)))
    random = np.random.default_rng(1)
    x, y = random.integers(0, 3, 300), random.integers(0, 3, 300)
    assert abs(metrics.ami_value(x, y)) < 0.05 and metrics.ami_value(x, x) == pytest.approx(1)
    shuffled = np.mean([metrics.nmi_value(x, random.permutation(y), "arithmetic") for _ in range(200)])
    t = metrics.table_of(x, y)
    assert metrics.expected_information(t) == pytest.approx(shuffled * (metrics._entropies(t)[0] + metrics._entropies(t)[1]) / 2, rel=0.1)
    assert metrics.armi_value(x, x) == pytest.approx(1) and metrics.armi_value(x, y) < 0.02
    assert len(metrics.random_nmi_values(x, 3, 5, 1)) == 5


def test_readers(spark, tmp_path):
    (tmp_path / "network_0_0.dat").write_text("1\t3\n1\t5\n2\t4\n3\t5\n4\t5\n5\t4\n")
    (tmp_path / "community_0_0.dat").write_text("1\t2 \n2\t1\n3\t4\n4\t4\n5\t3\n")
    rows = readers.lfr_network(spark, f"{tmp_path}/network_*.dat", 1).collect()
    assert sorted((r.src, r.dst) for r in rows) == [(0, 2), (0, 4), (1, 3), (2, 4), (3, 4)] and rows[0].graph_id == "0_0"
    assert {r.node: r.block for r in readers.lfr_community(spark, f"{tmp_path}/community_*.dat", 1).collect()} == {0: 1, 1: 0, 2: 3, 3: 3, 4: 2}
    assert readers.lfr_strict(spark, f"{tmp_path}/network_0_0.dat").count() == 6
    (tmp_path / "bad.dat").write_text("1 2 3\n")
    with pytest.raises(Exception):
        readers.lfr_strict(spark, f"{tmp_path}/bad.dat").collect()
    (tmp_path / "x.net").write_text('*Vertices 3\n% note\n1 "a b" 0.1 0.2 0.3\n2 "c" 0 0 0\n3 "d" 0 0 0\n*Arcs\n1 2 1\n*Edges\n2 3 2\n')
    nodes, edges = readers.pajek(spark, f"{tmp_path}/x.net")
    assert [(r.node, r.label, r.pos) for r in nodes.orderBy("node").collect()] == [(1, "a b", 0), (2, "c", 1), (3, "d", 2)]
    assert sorted((r.src, r.dst, r.weight, r.directed) for r in edges.collect()) == [(1, 2, 1.0, True), (2, 3, 2.0, False)]
    (tmp_path / "w.edgelist").write_text(" \t1\t2\t0.5\n3 4\n2\t3\t1.5\n")
    assert sorted((r.src, r.weight) for r in readers.edge_list(spark, f"{tmp_path}/w.edgelist").collect()) == [(1, 0.5), (2, 1.5)]
    (tmp_path / "types").write_text("1\n2\n2\n")
    assert [r.block for r in readers.labels_by_line(spark, f"{tmp_path}/types").orderBy("node").collect()] == [1, 2, 2]
    (tmp_path / "g.gml").write_text('Creator "x"\ngraph [\n directed 1\n node [ id 0 label "a ] b" value 1 ]\n node [\n id 1 label "b" value 0 ]\n edge [ source 0 target 1 ]\n]\n')
    nodes, edges, directed = readers.gml(spark, f"{tmp_path}/g.gml")
    assert directed and nodes.count() == 2 and edges.first().weight == 1
    assert readers.karate(spark)[0].edges.count() == 78 and readers.southern_women(spark)[0].edges.count() == 89
    runs = spark.createDataFrame([("k", "kl", "skn", 2, True, 0.5, 3, 9, -1.5, [0, 1, 1]), ("k", "h", "skn", 2, False, 0.5, 3, 9, -1.5, [0, 1, 1, 0, 0])], ", ".join(f"{c} {t}" for c, t in zip(readers.FLAT, ["string", "string", "string", "int", "boolean", "double", "long", "long", "double"])) + ", blocks array<int>")
    readers.write_flat(runs, f"{tmp_path}/flat")
    assert sorted(map(str, readers.read_flat(spark, f"{tmp_path}/flat").collect())) == sorted(map(str, runs.collect()))
    assert readers.levels_of([0, 1, 1, 0, 0], 3) == [[0, 1, 1], [0, 0]]


def test_generators(spark):
    g, part = generators.planted(spark, 200, 4, 0.5, 0.02, 7)
    again, _ = generators.planted(spark, 200, 4, 0.5, 0.02, 7)
    assert sorted(map(tuple, g.edges.collect())) == sorted(map(tuple, again.edges.collect()))
    e = {(r.r, r.s): r.e for r in P.block_edges(g, part).collect()}
    assert 0.4 < e[0, 0] / (50 * 49) < 0.6 and 0 < e.get((0, 1), 0) / 2500 < 0.05
    counts = np.array([[5, 7], [7, 9]])
    fixed = generators.fixed_counts(generators.equal_blocks(spark, 40, 2), counts, 3)
    e = {(r.r, r.s): r.e for r in P.block_edges(fixed, generators.equal_blocks(spark, 40, 2)).collect()}
    assert e == {(0, 0): 10, (0, 1): 7, (1, 0): 7, (1, 1): 18}
    g, _ = generators.degree_corrected(spark, 300, np.full((3, 3), 0.1) + np.eye(3), 12.0, 2.5, 5, noise=0.001)
    assert 8 < 2 * g.edges.count() / 300 < 16


def test_block_edges_of_a_stream(spark, tmp_path):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 2, 1.0)], "src long, dst long, weight double")
    edges.write.parquet(f"{tmp_path}/in")
    part = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "node long, block int")
    stream = spark.readStream.schema(edges.schema).parquet(f"{tmp_path}/in")
    query = streamed(stream, part, False).writeStream.outputMode("complete").format("memory").queryName("block_edges").start()
    query.processAllAvailable()
    query.stop()
    got = sorted(map(tuple, spark.table("block_edges").collect()))
    assert got == sorted(map(tuple, P.block_edges(Graph(edges, False), part).select("r", "s", "e").collect()))
