import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import topk


def brute(rows, k, is_query):
    fine = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            fine.setdefault(i, []).append([math.floor(256 * x) for x in v])
    out = {}
    for q, vs in fine.items():
        if is_query(q):
            scores = sorted((-sum(a * b for a, b in zip(vs[0], w)), i) for i, ws in fine.items() if i != q for w in ws if len(w) == len(vs[0]))
            out[q] = [(i, -s) for s, i in scores[:k]]
    return out


@pytest.mark.parametrize("shard_rows", [16384, 60, 25])
def test_results_are_brute_force_s(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(topk, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(topk, "LEAF", 5)
    random = np.random.default_rng(3)
    rows = [(i, random.normal(size=6).astype(np.float32).tolist()) for i in range(220)]
    rows += [(300 + i, [0.5] * 6) for i in range(90)] + [(400, None), (402, []), (404, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (406, [float("nan")] * 6), (410, [1.0, 2.0]), (411, [3.0, -2.0]), (None, [1.0] * 6), (430, [float("inf")] * 6)] + [(310, [0.5] * 6)] * 3
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).repartition(3)
    got = {}
    for r in topk.top_k(table, F.col("id") % 10 == 0, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    want = {q: x for q, x in brute(rows, 5, lambda i: i % 10 == 0).items() if x}
    assert got == want


def test_empty(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("id") % 2 == 0).count() == 0
