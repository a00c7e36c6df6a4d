import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    bags = [(i, Counter(terms_of(t))) for i, t in docs if i is not None and terms_of(t)]
    count, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    wanted = {}
    for item, text in items:
        if item is not None:
            wanted.setdefault(item, set()).update(terms_of(text))
    out = []
    for item, own in wanted.items():
        scores = []
        for i, bag in bags:
            m = 50 + (50 * sum(bag.values()) * count) // length
            s = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 20 * m)) for t in own if t in bag)
            if s > 0:
                scores.append((-s, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def given():
    random = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "é", "Straße", "日本", "x1"]
    weights = 1 / np.arange(1, len(vocabulary) + 1)
    draw = lambda n: random.choice(vocabulary, n, p=weights / weights.sum()).tolist()
    docs = [(i, " ".join(draw(int(random.integers(1, 60))))) for i in range(400)]
    docs += [(1000 + i, "W0, w3! é W17 w3") for i in range(60)]  # copies: ties
    docs += [(5, "w40 w41"), (5, "w40"), (None, "w40 w40"), (900, None), (901, ""), (902, "-- !!"), (903, " ".join(draw(5000))), (904, "w3" * 3000)]
    items = [(i, " ".join(draw(int(random.integers(1, 12))))) for i in range(25)] + [(30, None), (31, "?"), (None, "w1"), (32, "w1"), (32, "W2 w1"), (33, "nowhere"), (34, "w0 w0 w3 W17 é")]
    return docs, items


@pytest.mark.parametrize("shard_docs, block, k", [(8192, 128, 50), (40, 8, 7), (100, 4, 3)])
def test_ranks_are_brute_force_s(spark, shard_docs, block, k):
    docs, items = given()
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumn("term", F.lit(1)).withColumn("score", F.lit("x"))
    index = lexical.build(table, shard_docs=shard_docs, block=block)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(0))
    assert sorted(tuple(r) for r in lexical.search(index, asked, k).collect()) == brute(docs, items, k)


def test_items_in_blocks_and_empty_tables(spark, monkeypatch):
    docs, items = given()
    table, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    index = lexical.build(table)
    monkeypatch.setattr(lexical, "ITEM_BYTES", 400)
    assert sorted(tuple(r) for r in lexical.search(index, asked, 4).collect()) == brute(docs, items, 4)
    assert lexical.search(index, asked.where("item_id < 0")).count() == 0
    assert lexical.search(lexical.build(table.where("doc_id < 0")), asked).count() == 0
    assert lexical.search(lexical.build(table.where("doc_id = 901")), asked).count() == 0


def test_rejected_documents_are_not_decompressed():
    texts = [" ".join(["common"] * (1 if i % 500 else 9) + ["rare"] * (i == 7) + [f"f{i}"] * 5) for i in range(4000)]
    row, terms = lexical.words(pa.array(texts))
    batches = list(lexical._index(0, list(range(4000)), row, terms, 16))
    sizes = np.array(batches[0].to_pylist()[0]["sizes"])
    m = lexical.length_norm(sizes, 4000, int(sizes.sum()))
    lists = {r["term"]: lexical.Postings(r, m, 4000, int(sizes.sum())) for b in batches[1:] for r in b.to_pylist() if r["term"] in ("common", "rare")}
    own = [(lists["common"], 20), (lists["rare"], 9000)]
    docs, scores = lexical.search_shard(own, 4000, lists["rare"].top * 9000)
    assert docs.tolist() == [7] and lists["common"].all is None and list(lists["common"].blocks) == [0]
    assert lexical.search_shard(own, 4000, int(scores[0]) + 1)[0].tolist() == []


def test_varints():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**21, 2**28, 2**31])
    data, starts = lexical.varints(values)
    assert lexical.numbers(data).tolist() == values.tolist() and lexical.numbers(data[starts[3] :]).tolist() == values[3:].tolist()
