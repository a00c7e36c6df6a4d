import time

import numpy as np
import public_tokenizers
import pyarrow as pa
from test_tokens_and_shards import ODD
from tokenizers import Tokenizer

from loomgraph.llm import bpe, merges, packing

WORD = public_tokenizers.path("word_bpe_49k.json")


def ids(packed):
    return [np.frombuffer(p, "<u4").tolist() for p in packed]


def test_ids_are_the_library_s():
    library, own = Tokenizer.from_file(WORD), merges.MergeBpe(WORD)
    texts = [t or "" for t in ODD] + [
        "x" * 64 + " " + "x" * 65, "é" * 32 + " " + "é" * 33, "12,345.67% a1b2 <a href='x'>it's</a> 's's ''s'll", "<|endoftext|", "a <|endoftext|> b<|", "\x7f\x01 ab\x1c\x1d1", "​ word᠎s a b\x85c　d",
        "aaaa" * 9 + " abababab " + "!?" * 20, "Ϊ́ ǰ ΐ", "naïve—café, straße: “quoted” 1½ ²", "\n", "\x1c",
    ]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids(own.encode(texts)) == want
    assert [ids(own.encode([t]))[0] for t in texts] == want
    assert own.encode([]) == []


def test_ids_of_random_strings_and_of_every_letter():
    library, own = Tokenizer.from_file(WORD), merges.MergeBpe(WORD)
    random = np.random.default_rng(11)
    letters = list("abcdeinorst'éß.,!3 ü<|")
    texts = ["".join(random.choice(letters, random.integers(1, 90))) for _ in range(3000)]
    assert ids(own.encode(texts)) == [library.encode(t, add_special_tokens=False).ids for t in texts]
    every = [chr(c) for c in range(1 << 16) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{c}b {c}1" for c in every[i : i + 256]) for i in range(0, len(every), 256)]
    assert own.encode(texts) == bpe.TrieBpe(WORD).encode(texts)


def test_pairs_that_collide_are_found():
    random = np.random.default_rng(2)
    ranks = {(int(a), int(b)): i for i, (a, b) in enumerate(random.integers(0, 300, (5000, 2)))}
    pairs = merges.Pairs(ranks)
    a, b = np.divmod(np.arange(300 * 300), 300)
    assert pairs.of(a, b).tolist() == [ranks.get(p, int(merges.NEVER)) for p in zip(a.tolist(), b.tolist())]


def made_up(n, seed):
    random = np.random.default_rng(seed)
    word = lambda: "".join(random.choice(list("aabcdeeefghiiklmnoooprsttu"), random.integers(4, 12)))
    words = [word() for _ in range(n)]
    return [" ".join(random.choice(words, 400)) for _ in range(n // 100)]


def test_packing_s_coder_takes_less_time_than_the_trie_walk_on_new_words(spark, monkeypatch):
    used = []
    monkeypatch.setattr(packing.common, "map_rows", lambda df, run, schema, keeps=None: used.append(run) or df.limit(0).selectExpr("id", "0L start", "0L length", "0L ids_crc32", "0L doc_tokens", "0L draw"))
    packing.pack(spark.createDataFrame([(1, "a")], "doc_id long, text string"), WORD)
    (run,) = used
    trie, took = bpe.TrieBpe(WORD), [[], []]
    for seed in range(4):
        texts = made_up(20_000, seed)
        batch = pa.RecordBatch.from_pydict({"id": pa.array(range(len(texts))), "text": texts})
        began = time.process_time()
        got = [x for b in run(iter([batch])) for x in b["doc_tokens"].to_pylist()]
        between = time.process_time()
        want = [len(p) // 4 + 1 for p in trie.encode(texts)]
        took[0].append(between - began)
        took[1].append(time.process_time() - between)
        assert len(got) >= len(want) and got == want
    assert min(took[0][1:]) < 0.7 * min(took[1][1:])
