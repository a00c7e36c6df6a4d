"""Signed changes of a stream of edges and moves add up to the batch value."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import partition as P
from loomgraph.operators.graph import Graph
from loomgraph.streaming import moves

SCHEMA = "at long, kind string, src long, dst long, weight double, block long"


@pytest.mark.parametrize("seed", [0, 1])
def test_any_interleaving_ends_at_the_batch_value(spark, tmp_path, seed):
    random = np.random.default_rng(seed)
    pairs = [(int(a), int(b), float(w)) for a, b, w in random.integers(1, 9, (25, 3))]
    events = [("edge", a, b, w, None) for a, b, w in pairs] + [("edge", *pairs[0][:2], -pairs[0][2], None)] + [("move", n, None, None, int(random.integers(3))) for n in range(1, 9) for _ in range(2)]
    events = [(at, *events[i]) for at, i in enumerate(random.permutation(len(events)))]
    for k, part in enumerate(np.array_split(np.arange(len(events)), 3)):
        spark.createDataFrame([events[i] for i in part], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", "1").parquet(f"{tmp_path}/in")
    first, second = moves.start(stream, f"{tmp_path}/state")
    first.processAllAvailable()
    first.stop()
    second.processAllAvailable()
    second.stop()
    got = {(r.r, r.s): r.e for r in spark.read.parquet(f"{tmp_path}/state/changes").groupBy("r", "s").agg(F.sum("e").alias("e")).collect() if abs(r.e) > 1e-9}
    last = {e[2]: e[5] for e in events if e[1] == "move"}
    edges = spark.createDataFrame([(e[2], e[3], e[4]) for e in events if e[1] == "edge"], "src long, dst long, weight double")
    part = spark.createDataFrame(list(last.items()), "node long, block long")
    want = {(r.r, r.s): r.e for r in P.block_edges(Graph(edges, False), part).collect() if abs(r.e) > 1e-9}
    assert got == want
