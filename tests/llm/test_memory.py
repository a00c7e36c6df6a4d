"""What a Python worker holds: two share an executor with its JVM."""

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard

from loomgraph.llm import bpe, common, packing, quality


def peak_mb(work):
    tracemalloc.start()
    try:
        got = work()
        return got, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_pieces_of_a_batch_are_not_held_together():
    own = bpe.TrieBpe(public_tokenizers.path("word_bpe_49k.json"), 150_000)
    text = " ".join(f"word{k % 500}" for k in range(20_000))
    alone = own.encode([text])[0]
    got, mb = peak_mb(lambda: own.encode([text] * 20))
    assert got == [alone] * 20
    # what comes back, and the 20,000 pieces of a text; those of all take over 20 MB
    assert mb < sum(map(len, got)) / 1e6 + 6


def test_the_store_keeps_what_it_is_told():
    path = public_tokenizers.path("word_bpe_49k.json")
    own, plain = bpe.TrieBpe(path, 30_000), bpe.TrieBpe(path)
    for k in range(4):
        texts = [" ".join(f"{k}x{i}" for i in range(20_000)), "0x7 plain words"]
        assert own.encode(texts) == plain.encode(texts)
    assert len(own.young) + len(own.old) <= 60_000 < len(plain.young)


def test_batches_that_come_back_are_bounded():
    batch = pa.RecordBatch.from_pydict({"a": pa.array(np.arange(1_000_000)), "b": pa.array(["x"] * 1_000_000)})
    parts = list(common.bounded([batch, batch.slice(0, 0), batch.slice(5, 3)]))
    assert max(p.nbytes for p in parts) <= common.BACK_BYTES and parts[-2].num_rows == 0
    assert pa.Table.from_batches(parts[:-2]).equals(pa.Table.from_batches([batch]))
    assert parts[-1].equals(batch.slice(5, 3))
    long = pa.RecordBatch.from_pydict({"t": pa.array(["y" * (5 << 20), "z"])})
    assert [p.num_rows for p in common.bounded([long])] == [1, 1]


def test_sums_of_a_shard_make_no_string_for_each_n_gram():
    text = "some words of a text"
    grams = np.unique(quality.codes(text))
    many = np.unique(np.concatenate([grams, np.arange(1 << 40, (1 << 40) + 300_000)]))
    squeezed = zstandard.ZstdCompressor().compress(text.encode())
    docs = pa.table({"lang": ["en", "de"], "z": pa.array([squeezed, squeezed], pa.binary())})
    answers = pa.table({"lang": pa.array(["en"] * len(many) + ["de"] * len(grams)), "gram": pa.array([*many, *grams]), "b": pa.array([1.0] * len(many) + [2.0] * len(grams), pa.float32())})
    got, mb = peak_mb(lambda: {int(at[0]): bits[0] for at, bits, _ in quality._summed(docs, answers)})
    assert got == {0: 1.0, 1: 2.0}
    assert mb < 16


def test_the_coder_is_let_go_before_groups_are_packed(spark):
    released = []
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string").repartition(2)
    rows = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), group=8)
    assert rows.count() == 40
    common.HELD["a test's"] = lambda: released.append(1)
    try:
        bpe.coder(public_tokenizers.path("word_bpe_49k.json"))
        common.release(None)
        assert bpe.coder.cache_info().currsize == 0 and released
    finally:
        del common.HELD["a test's"]
