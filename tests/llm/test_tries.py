import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import queries, tries


def brute(rows, rebuild):
    """Nodes by dictionaries of beginnings; rows (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16], text))
    own = {c: [(x[1], x[3]) for x in sorted(v)] for c, v in own.items()}
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9 if rebuild else 0
        convs[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    members, children, ends = defaultdict(list), defaultdict(set), defaultdict(list)
    for c, s in convs.items():
        ends[s].append(c)
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
            if d:
                children[s[: d - 1]].add(s[:d])
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in sorted(members, key=len, reverse=True):
        leaves[p] += not children[p]
        saved[p] += (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        if p:
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], digest(p)) for p, m in members.items())


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def given():
    random = np.random.default_rng(5)
    rows = []
    for c in range(120):  # a third begins alike, and so does a third of these for six turns
        begin = ["same"] * (1 if c % 3 == 0 else 0) + [f"long {i}" for i in range(6)] * (c % 9 == 0)
        turns = begin + [f"{'é' * (i % 3)}{random.integers(3)}" for i in range(int(random.integers(0, 9)))]
        rows += [(c, i, "user" if i % 2 else "bot", t) for i, t in enumerate(turns)]
    rows += [(1000 + c, i, "user", f"copy {i}") for c in range(60) for i in range(4)]  # copies
    rows += [(2003, i, None, "y" * (i % 7)) for i in range(300)]  # one long conversation without its first
    rows += [(3000, None, "user", None), (3000, None, None, None), (3000, 1, "user", "a"), (3000, 1, "user", "a"), (3000, 1, "user", "b"), (None, 0, "user", "lost"), (3002, 0, "", ""), (3003, 0, None, None)]
    return rows


@pytest.mark.parametrize("shard_turns", [32768, 200, 5])
@pytest.mark.parametrize("rebuild", [False, True])
def test_nodes_are_brute_force_s(spark, tmp_path, monkeypatch, shard_turns, rebuild):
    monkeypatch.setattr(tries, "SHARD_TURNS", shard_turns)
    rows = given()
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).withColumn("key", F.lit(1)).withColumn("depth", F.lit("x"))
    table.write.parquet(f"{tmp_path}/conversations.parquet")
    nodes = queries.op13_tries(spark, str(tmp_path)) if rebuild else tries.trie(tries.turn_lists(table))
    got = sorted((tuple(r[c] for c in COLUMNS) for r in nodes.collect()), key=lambda r: tuple(-1 if x is None else x for x in r))
    assert got == sorted(brute(rows, rebuild), key=lambda r: tuple(-1 if x is None else x for x in r))


def test_double_array_holds_what_it_was_given():
    random = np.random.default_rng(1)
    for _ in range(60):
        sequences = sorted({tuple(random.integers(1, 1 + random.integers(2, 60), int(random.integers(0, 7))).tolist()) for _ in range(int(random.integers(1, 80)))})
        sizes, flat = np.array([len(s) for s in sequences]), np.array([x for s in sequences for x in s], np.int64)
        trie = tries.DoubleArray(flat, sizes)
        nodes, starts = trie.walk(flat, sizes), np.cumsum(sizes) - sizes
        named = {}
        for s, a in zip(sequences, starts):
            for d in range(len(s)):
                assert named.setdefault(int(nodes[a + d]), s[: d + 1]) == s[: d + 1]
        assert len(named) == len({s[: d + 1] for s in sequences for d in range(len(s))}) == (trie.check >= 0).sum()
    wide = tries.DoubleArray(np.arange(1, 5001), np.ones(5000, np.int64))
    assert wide.end <= 5002  # siblings lie close together
    with pytest.raises(KeyError):
        wide.walk(np.array([6000, 1]), np.array([2])) if 6000 < len(wide.check) else wide.walk(np.array([1, 1]), np.array([2]))


def test_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert tries.trie(tries.turn_lists(empty)).count() == 0
