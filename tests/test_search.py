import numpy as np
import pytest

from loomgraph.operators import frost as FR
from loomgraph.operators import kernels as K
from loomgraph.operators import metrics, search
from loomgraph.operators.factor import assign, block_means, check_rows, jacobi_sweep, normalised, relative_error, s_matrix
from loomgraph.operators.graph import Graph
from loomgraph.plans import harness
from loomgraph.session import shared_root
from loomgraph.sources.readers import karate, southern_women


def planted(n=60, blocks=3, p_in=0.4, p_out=0.03, seed=1):
    random = np.random.default_rng(seed)
    truth = np.arange(n) * blocks // n
    hit = np.triu(random.random((n, n)) < np.where(truth[:, None] == truth[None, :], p_in, p_out), 1)
    src, dst = np.nonzero(hit)
    return n, src, dst, np.ones(len(src)), truth


@pytest.mark.parametrize("method", ["ma", "mha_1k", "mhac_1k", "mhab_1k", "kl_g", "kl_g_nn", "kl_em", "kl_nn", "pah", "spectral", "spectral_norm", "frost", "svca"])
def test_searches_find_planted_blocks(method):
    n, src, dst, w, truth = planted()
    best = max((search.search_one(n, src, dst, w, False, method, "dckn", 3, seed)[2::-2] for seed in range(4)), key=lambda x: x[0])
    assert metrics.nmi_value(best[1], truth) > (0.25 if method in ("ma", "mhac_1k", "mhab_1k", "mha_1k") else 0.5), method


@pytest.mark.parametrize("normalised", [False, True])
def test_spectral_search_by_iteration_finds_what_dense_matrices_do(normalised):
    n, src, dst, w, truth = planted(90, 3)
    for dense in (2000, 10):
        assert metrics.nmi_value(K.spectral(n, src, dst, w, 3, np.random.default_rng(1), normalised, dense), truth) > 0.8


def test_kernighan_lin_reaches_the_known_optimum():
    found = []
    graph = [tuple(int(x) - 1 for x in e.split("-")) for e in __import__("loomgraph.sources.readers", fromlist=["KARATE"]).KARATE.split()]
    src, dst = (np.array(x) for x in zip(*graph))
    for seed in range(6):
        found.append(search.search_one(34, src, dst, np.ones(78), False, "kl", "skn", 2, seed)[2])
    assert max(found) > -330 and max(found) == max(found)
    start = K.State(34, src, dst, np.ones(78), False, np.arange(34) % 2, 2, "skn").value()
    assert max(found) > start


def test_hierarchical_search_improves():
    n, src, dst, w, truth = planted(48, 4)
    levels, _ = K.hierarchical(n, src, dst, w, False, np.random.default_rng(2), steps=20, most=6)
    flat = K.hierarchy_value([np.zeros(n, dtype=int)], n, src, dst, w, False)
    assert K.hierarchy_value(levels, n, src, dst, w, False) > flat
    assert metrics.nmi_value(levels[0], truth) > 0.6


def test_factorisation(spark):
    n, src, dst, w, truth = planted()
    x = FR.Sparse(n, np.concatenate([src, dst]), np.concatenate([dst, src]), np.concatenate([w, w]))
    random = np.random.default_rng(0)
    for method in ("random", "SVCA", "SSPA", "SPA"):
        found = FR.frost(x, 3, random, method)
        start = FR.frost(x, 3, np.random.default_rng(0), method, sweeps=0)
        assert found.error <= start.error + 1e-9
        dense = np.zeros((n, n))
        dense[x.i, x.j] = x.x
        z = np.zeros((n, 3))
        z[np.arange(n), found.v] = found.w
        assert found.error == pytest.approx(np.linalg.norm(dense - z @ found.s @ z.T) / np.linalg.norm(dense), rel=1e-6)
    with pytest.raises(ValueError):
        FR.Sparse(3, [0, 1], [1, 0], [1.0, 1.0])
    graph = Graph(spark.createDataFrame([(int(a), int(b), 1.0) for a, b in zip(src, dst)], "src long, dst long, weight double"), False)
    table = graph.adj_matrix().cache()
    check_rows(graph.nodes, table)
    part = spark.createDataFrame([(i, int(b)) for i, b in enumerate(truth)], "node long, block int")
    shared_root(spark)
    z = normalised(assign(table, block_means(table, part))).checkpoint()
    first = relative_error(table, s_matrix(table, z)).first().error
    for _ in range(2):
        z = jacobi_sweep(table, z.checkpoint(), s_matrix(table, z).checkpoint(), n, 3).checkpoint()
    assert z.count() == n
    assert relative_error(table, s_matrix(table, z)).first().error <= first + 0.02
    table.unpersist()


def test_small_solvers():
    random = np.random.default_rng(3)
    a, v = random.random((20, 4)), np.abs(random.normal(size=(4, 6))) * (random.random((4, 6)) < 0.6)
    for fast in (False, True):
        assert np.abs(FR.nnls(a, a @ v, 20000, 1e-12, fast) - v).max() < 1e-3
    u, t = FR.l1_low_rank(np.outer(np.arange(1, 7), np.arange(1, 6)).astype(float), 1, random)
    assert np.abs(u @ t - np.outer(np.arange(1, 7), np.arange(1, 6))).max() < 1e-6
    cost = random.random((6, 6))
    import itertools

    best = min(sum(cost[i, p[i]] for i in range(6)) for p in itertools.permutations(range(6)))
    assert cost[np.arange(6), metrics.best_assignment(cost)].sum() == pytest.approx(best)
    assert FR.dirichlet(np.ones(3), 50, random).sum(1) == pytest.approx(np.ones(50))
    m = random.random((10, 3))
    angle, to = metrics.best_angles(m, m[:, [2, 0, 1]])
    assert angle < 1e-4 and to.tolist() == [1, 2, 0]
    x, value = FR.positive_minimum(2.0, np.array([-3.0, 1.0, 0.5]), np.array([-1.0, -2.0, 4.0]))
    grid = np.linspace(1e-6, 5, 200001)
    for k, (b, c) in enumerate(((-3.0, -1.0), (1.0, -2.0), (0.5, 4.0))):
        assert value[k] == pytest.approx(min(0, (2 * grid**4 + b * grid**2 + c * grid).min()), abs=1e-6)


def test_grid_resumes_and_scores(spark, tmp_path):
    graph, part = karate(spark)
    women, kinds = southern_women(spark)
    edges = graph.edges.selectExpr("'karate' as graph_id", "src", "dst", "weight").unionByName(women.edges.selectExpr("'women' as graph_id", "src", "dst", "weight"))
    truth = part.selectExpr("'karate' as graph_id", "node", "block").unionByName(kinds.selectExpr("'women' as graph_id", "node", "block"))
    store = f"file://{tmp_path}/runs"
    first = harness.run(edges, search.grid_of(spark, ["kl_g"], ["dckn"], [2], 2), False, store)
    assert first.select("graph_id", "trial").distinct().count() == 4
    more = harness.run(edges, search.grid_of(spark, ["kl_g", "kl_em", "nonsense"], ["dckn"], [2], 2), False, store)
    assert more.groupBy("graph_id", "method", "trial", "node").count().where("count > 1").count() == 0
    assert more.where("status like 'error%'").select("method").distinct().first().method == "nonsense"
    scores = harness.scored(more.where("status not like 'error%'"), truth)
    assert scores.count() == 8 and scores.where("nmi < -1e-9 or nmi > 1.000001").count() == 0
    assert harness.report(scores).count() == 2
    with pytest.raises(ValueError):
        harness.check_compatible(more, edges, edges)
    best = search.best_trials(first)
    assert best.groupBy("graph_id").count().count() == 2


def test_em_as_tables(spark):
    graph, _ = karate(spark)
    start = graph.nodes.selectExpr("node", "cast(node % 2 as int) as block")
    found, steps = search.em_tables(graph, start, "dckn", 10)
    e = graph.edges.toPandas()
    labels = found.orderBy("node").toPandas().block.to_numpy()
    value = lambda b: K.State(34, e.src, e.dst, e.weight, False, b, 2, "dckn").value()
    assert value(labels) >= value(np.arange(34) % 2) and steps <= 10


def test_benchmark_graphs_have_the_wanted_shape():
    from loomgraph.operators.generators import benchmark_arrays

    src, dst, labels = benchmark_arrays(600, 0.3, 16, 40, 15, 60, np.random.default_rng(4))
    degree, sizes = np.bincount(np.concatenate([src, dst]), minlength=600), np.bincount(labels)
    assert len(np.unique(src * 600 + dst)) == len(src) and (src < dst).all()
    assert sizes.sum() == 600 and sizes.min() >= 15 and sizes.max() <= 60 and degree.max() <= 40
    assert 14 < degree.mean() < 18 and 0.25 < (labels[src] != labels[dst]).mean() < 0.36
