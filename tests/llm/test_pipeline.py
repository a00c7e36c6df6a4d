import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from loomgraph.llm import quality, simhash, toxicity

DATA = os.environ.get("LOOMGRAPH_TEST_TABLES", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage got and gave, over the smallest tables."""
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, DATA).cache()
        out.append((name, docs, after))
        docs = after
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").distinct().collect())


def test_stages_keep_what_their_operators_keep(spark, stages):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    (_, docs, good), (_, _, harmless), (_, _, single), (_, _, packed) = stages
    assert [n for n, *_ in stages] == ["quality", "toxicity", "simhash", "packing"]
    assert good.columns == harmless.columns == single.columns == docs.columns
    assert ids(good) == sorted(r.id for r in quality.classify(docs, labels).where("kept").collect())
    model = toxicity.fit(good, labels.where(~toxicity.held_out()))
    assert ids(harmless) == sorted(r.doc_id for r in toxicity.score(good, model).where(f"score < {corpus_pipeline.TOXIC}").collect())
    texts = {r.doc_id: r.text for r in harmless.collect()}
    kept = ids(single)
    groups = {r.id: r.component for r in simhash.similar(harmless).collect()}
    assert kept == sorted(set(groups.values()))
    words = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))}
    shingles = {i: words(t) for i, t in texts.items()}
    left = [(a, b) for k, a in enumerate(kept) for b in kept[:k] if len(shingles[a] & shingles[b]) >= 0.85 * len(shingles[a] | shingles[b])]
    assert not left
    assert ids(packed) == kept


def test_packed_pieces_are_the_documents(stages):
    _, docs, packed = stages[-1]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    total = 0
    for r in packed.collect():
        want = np.array(library.encode(texts[r.doc_id], add_special_tokens=False).ids + [2], dtype="<u4")
        assert r.doc_tokens == len(want) and r.ids_crc32 == zlib.crc32(want[r.start : r.start + r.length].tobytes())
        total += r.length
    sequences = packed.select("sequence_id").distinct().count()
    assert total > 0.8 * 4096 * (sequences - 1)


def test_clean_documents_stay(spark, stages):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    _, docs, good = stages[0]
    clean = [i for i in ids(docs) if i in labels and labels[i].quality == 1]
    assert len(set(clean) & set(ids(good))) >= 0.97 * len(clean)


def test_single_leaves_no_near_fingerprints(spark):
    refrain = "one two three four five six seven " * 50
    texts = [refrain + tail for tail in ("red green blue grey pink", "spring summer autumn winter", "north south east west")] + ["other words", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert len(simhash.shingled(texts[0].encode())[1]) < 20
    fps = [simhash.fingerprint((t or "").encode(), 3) for t in texts]
    assert all((fps[0] ^ f).bit_count() <= simhash.RADIUS for f in fps[1:3])
    assert ids(corpus_pipeline.single(spark, docs, DATA)) == [0, 3, 4]
