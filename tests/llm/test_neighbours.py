import numpy as np

from loomgraph.llm import neighbours


def brute(rows, threshold):
    fine = [(k, np.array(v, dtype=float)) for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (a, x) in enumerate(fine):
        for b, y in fine[:i]:
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                n[a] += 1
                n[b] += 1
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return [(rows[k][0], n[k], least[find(k)]) for k in range(len(rows))]


def test_links_are_brute_force_s(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    random = np.random.default_rng(5)
    rows = []
    for _ in range(150):
        base = random.normal(size=16)
        for _ in range(int(random.choice([1, 1, 1, 2, 3]))):
            rows.append((base + random.normal(size=16) * 0.03).tolist())
    dense = random.normal(size=16)
    rows += [(dense + random.normal(size=16) * 0.02).tolist() for _ in range(90)]  # more than a list holds
    rows += [rows[3]] * 25 + [[2 * x for x in rows[4]]] + [None, [], [0.0] * 16, [1.0, None], [float("nan")] * 16, [float("inf")] * 16, [1.0, 2.0], [2.0, 4.0]]
    order = random.permutation(len(rows) * 2)[: len(rows)]
    rows = [(int(i), v) for i, v in zip(order, rows)]
    rows.append((rows[0][0], rows[0][1]))  # a repeated row
    table = spark.createDataFrame([(i, v, "x", 3) for i, v in rows], "vec_id long, embedding array<double>, n_links string, node int").repartition(4)
    got = [(r.id, r.n_links, r.component) for r in neighbours.near_duplicates(table).collect()]
    assert sorted(got) == sorted(brute(rows, 0.95))


def test_dense_groups_that_link_below_their_own(spark, monkeypatch):
    random = np.random.default_rng(8)
    base, side = np.linalg.qr(random.normal(size=(16, 2)))[0].T
    rows = []
    for centre in (base, 0.967 * base + (1 - 0.967**2) ** 0.5 * side):  # inner cosines about 0.99, cross ones about 0.957
        rows += [(centre + random.normal(size=16) * 0.025).tolist() for _ in range(90)]
    rows += [(-base + 0.02 * random.normal(size=16)).tolist() for _ in range(60)]  # a third that is far away
    rows = list(enumerate(rows))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    want = sorted(brute(rows, 0.95))
    assert {c for _, _, c in want} == {0, 180}
    for size in (neighbours.BETWEEN, 64):
        monkeypatch.setattr(neighbours, "BETWEEN", size)
        assert sorted((r.id, r.n_links, r.component) for r in neighbours.near_duplicates(table).collect()) == want


def test_rare_links_are_found_where_the_search_fails(spark, monkeypatch):
    random = np.random.default_rng(15)
    rows = [random.normal(size=16).tolist() for _ in range(600)]
    rows += [(np.array(v) + random.normal(size=16) * 0.03).tolist() for v in rows[:3]]  # most draws have no link
    rows = list(enumerate(rows))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    monkeypatch.setattr(neighbours, "AUDIT", 8)
    monkeypatch.setattr(neighbours, "lists", lambda units, *_: spark.createDataFrame([], "node long, other long, s float"))
    for most in (8, 16384):  # too few links to tell, and a recall of nothing
        monkeypatch.setattr(neighbours, "AUDIT_MOST", most, raising=False)
        assert sorted((r.id, r.n_links, r.component) for r in neighbours.near_duplicates(table).collect()) == sorted(brute(rows, 0.95))


def test_empty(spark):
    assert neighbours.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
