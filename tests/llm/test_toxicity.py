import itertools
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from loomgraph.llm import toxicity

BAD, GOOD = ["grumbler", "snarlet", "fleeb", "dratted"], ["river", "stone", "paper", "window", "garden", "silver", "morning", "letter", "winter", "table"]


def corpus(n=400):
    random = np.random.default_rng(1)
    texts, labels = [], []
    for i in range(n):
        words = random.choice(GOOD, 30).tolist()
        if i % 4 == 0:
            words[int(random.integers(0, 30))] = str(random.choice(BAD))
        texts.append(" ".join(words))
        labels.append(int(i % 4 == 0))
    return texts, labels


def model_of(words, n=5):
    model = toxicity.CharModel()
    for w in words:
        model.add(w, n)
    return model.ready()


def brute_cost(word, model):
    padded = "\x02\x02" + word + "\x03"
    return sum(model.cost(padded[i : i + 3]) for i in range(len(padded) - 2))


def brute_decode(token, model):
    """Least cost over every reading, by enumeration."""
    choices = [toxicity.options_of(c, len(list(g))) for c, g in itertools.groupby(token)]
    best = None
    for pick in itertools.product(*choices):
        words = "".join(x for x, _ in pick).split()
        cost = sum(c for _, c in pick) + sum(brute_cost(w, model) for w in words)
        best = min(best, (cost, " ".join(words))) if best else (cost, " ".join(words))
    return best


def test_viterbi_is_the_best_reading():
    model = model_of(BAD + GOOD)
    for token in ("f1eeb", "fl33b", "fleeeeb", "s.n.a.r.l.e.t", "dr@tt3d", "gr u m bl er", "5nar1et", "x1!0", "---", "r1ver", "a f l e", "1984", "river.stone", "4$$"):
        assert toxicity.decode(token, model) == brute_decode(token, model)[1], token


def test_disguises_are_read():
    model = model_of([*BAD, *GOOD, "a", "ass"], 50)
    for piece, word in {
        "fl33b": "fleeb", "s n a r l e t": "snarlet", "d r 4 t t e d": "dratted", "$ n a r l e t": "snarlet", "f.  l.\ne. e. b.": "fleeb", "snnarlet": "snarlet", "gruuuumbler": "grumbler",
        "a f l e e b": "fleeb", "a s s": "ass", "4$$": "ass", "f-l-e-e-b!": "fleeb", "dr@tt3d,": "dratted", "s\tn\na  r l e t": "snarlet",
    }.items():
        reader = toxicity.Reader(model, {"=" + word: 0})
        assert reader.vector(f"river {piece} stone") == [0], piece
    reader = toxicity.Reader(model, {"=" + w: i for i, w in enumerate([*BAD, "ass"])})
    for plain in ("river stone", "1984", "2 x 3", "it is so", "12,500.00", "letter table window", ""):
        assert reader.vector(plain) == [], plain


def test_held_out_rows_and_disguises(spark):
    texts, labels = corpus()
    extra = [None, "", "fl33b river", "s n a r l e t window", "gruuumbler", "river river", "table " * 30000, "dr@tted paper"]
    docs = spark.createDataFrame([(i, t, 0.5, 1) for i, t in enumerate(texts + extra)], "doc_id long, text string, score double, y int").repartition(4)
    table = spark.createDataFrame([(i, y) for i, y in enumerate(labels)] + [(3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, table.where(~toxicity.held_out()))
    got = {r.doc_id: r for r in toxicity.score(docs, model).withColumn("held_out", toxicity.held_out()).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    held = [i for i in range(len(texts)) if got[i].held_out]
    assert np.mean([(got[i].score >= 0.5) == bool(labels[i]) for i in held]) > 0.95
    at = {t: got[len(texts) + i].score for i, t in enumerate(extra)}
    assert all(0 <= s <= 1 for s in at.values())
    assert at[None] == at[""] < 0.5 and at["river river"] < 0.5 and at["table " * 30000] < 0.5
    assert min(at["fl33b river"], at["s n a r l e t window"], at["gruuumbler"], at["dr@tted paper"]) >= 0.5


def test_score_is_brute_force_s(spark):
    texts, labels = corpus(240)
    extra = [None, "", "fl33b river", "d r 4 t t e d window", "$ n a r l e t", "river river", "gruumbler, stone", "1984 5nar1et"]
    docs = spark.createDataFrame(list(enumerate(texts + extra)), "doc_id long, text string").repartition(3)
    model = toxicity.fit(docs, spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int"))
    letters = Counter(k for t in texts + extra for w in re.findall(r"[^\W\d_]+", (t or "").lower()) for k in toxicity.trigrams(w))
    counted = {r.key: r.n for r in toxicity.letters_of(docs).collect()}
    assert counted == dict(letters)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for i, text in enumerate(texts + extra):
        lower = (text or "").lower()
        pieces = lower.split() + [" ".join(m.split()) for m in re.findall(r"(?<!\S)\S{1,2}(?:\s+\S{1,2})+(?!\S)", lower)]
        words = {w for p in pieces for w in re.findall(r"[^\W\d_]+", p) + brute_decode(p, model.chars)[1].split()}
        found = {f for w in words for f in ["=" + w, *(w[:k] for k in (4, 5, 6) if len(w) >= k)]} & set(model.known)
        want = 1 / (1 + np.exp(-np.clip(model.bias + sum(model.weights[model.known[f]] for f in found), -30, 30)))
        assert abs(got[i] - want) < 1e-9, text


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(docs, none) is None
    assert [r.score for r in toxicity.score(docs, None).collect()] == [0.0]
    assert toxicity.score(docs.where(F.lit(False)), None).count() == 0
