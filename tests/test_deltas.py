"""Changes by moves and merges as tables: each is the full value after it less the one before."""

import numpy as np
import pytest

from loomgraph.operators import kernels as K
from loomgraph.operators.graph import Graph
from loomgraph.operators.objectives import OBJECTIVES, Blocks, merge_deltas, node_deltas


def example(spark, name, directed):
    random = np.random.default_rng(8)
    src, dst, w = random.integers(0, 12, 34), random.integers(0, 12, 34), random.integers(1, 3, 34).astype(float)
    if name.startswith("iclex") or name == "spd":
        pairs = np.unique(np.stack([src, dst] if directed else [np.minimum(src, dst), np.maximum(src, dst)]), axis=1)
        (src, dst), w = pairs, np.ones(pairs.shape[1])
    labels = np.array([0, 1, 2, 0, 1, 2, 0, 1, 0, 1, 1, 3])  # node 11 is alone in its block
    part = spark.createDataFrame([(i, int(b)) for i, b in enumerate(labels)], "node long, block int")
    graph = Graph(spark.createDataFrame([(int(a), int(b), float(x)) for a, b, x in zip(src, dst, w)], "src long, dst long, weight double"), directed, part.select("node"))
    return graph, part, labels, (src, dst, w)


def worth(name, directed, labels, ends):
    labels = np.unique(labels, return_inverse=True)[1]
    return K.State(len(labels), *ends, directed, labels, int(labels.max()) + 1, name).value()


# the others are compared by SQL on the driver's tables
@pytest.mark.parametrize("name, directed", [("snr", False), ("dcpuh", True), ("spd", False), ("iclexj", True)])
def test_every_change_is_the_difference_of_full_values(spark, name, directed):
    graph, part, labels, ends = example(spark, name, directed)
    before = worth(name, directed, labels, ends)
    assert OBJECTIVES[name](Blocks(graph, part)).first().objective == pytest.approx(before, rel=1e-9)
    rows = [*node_deltas(graph, part, name).collect(), *node_deltas(graph, part, name, "new").collect()]
    assert len(rows) == 12 * 3 + 12
    for r in rows:
        after = labels.copy()
        after[r.node] = 9 if r.to_block is None else r.to_block
        assert r.from_block == labels[r.node]
        assert r.delta == pytest.approx(worth(name, directed, after, ends) - before, abs=1e-7), r
    merges = merge_deltas(graph, part, name).collect()
    assert len(merges) == 12
    for r in merges:
        assert r.delta == pytest.approx(worth(name, directed, np.where(labels == r.block, r.into, labels), ends) - before, abs=1e-7), r
    if name == "spd":
        near = {(r.node, r.to_block): r.delta for r in node_deltas(graph, part, name, "near").collect()}
        assert len(near) < 36 and all(any((r.node, r.to_block) == k and r.delta == pytest.approx(d) for r in rows) for k, d in near.items())
