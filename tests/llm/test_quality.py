import math
from collections import Counter, defaultdict

import numpy as np

from loomgraph.llm import quality


def symbols(text):
    return list(np.frombuffer(text.encode("utf-16-le"), "<u2").tolist())


def brute_model(texts):
    """Probability of an n-gram under interpolated modified Kneser-Ney, written out from the formulas."""
    S, N = quality.SYMBOLS, quality.ORDER
    counts = {N: Counter()}
    for t in texts:
        s = [0] * (N - 1) + symbols(t) + [0]
        for i in range(len(s) - N + 1):
            counts[N][tuple(s[i : i + N])] += 1
    for n in range(N - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    discounts = {}
    for n in counts:
        of = Counter(counts[n].values())
        y = of[1] / (of[1] + 2 * of[2]) if of[1] else 0
        discounts[n] = [0] + [max(0, min(k, k - (k + 1) * y * of[k + 1] / of[k])) if of[k] and of[1] else k / 2 for k in (1, 2, 3)]
    sums, left = defaultdict(float), defaultdict(float)
    for n in counts:
        for g, c in counts[n].items():
            sums[g[:-1], n] += c
            left[g[:-1], n] += discounts[n][min(c, 3)]

    def p(gram):
        n = len(gram)
        if not n:
            return 1 / S
        lower = p(gram[1:]) if n > 1 else 1 / S
        if (gram[:-1], n) not in sums:
            return lower
        c = counts[n][gram]
        total = sums[gram[:-1], n]
        return max(c - discounts[n][min(c, 3)], 0) / total + left[gram[:-1], n] / total * lower

    return p


def brute_bits(t, p):
    s = [0] * (quality.ORDER - 1) + symbols(t) + [0]
    grams = Counter(tuple(s[i : i + quality.ORDER]) for i in range(len(s) - quality.ORDER + 1))
    return -sum(n * math.log2(p(g)) for g, n in grams.items()) / sum(grams.values())


def test_model_is_brute_force_s(spark):
    random = np.random.default_rng(3)
    words = ["river", "stone", "the", "of", "Paper", "ein", "für", "naïve", "it's", "12", "a-b"]
    good = [" ".join(random.choice(words, int(random.integers(1, 40)))) + "." for _ in range(300)]
    odd = [None, "", "### $$$ ***", "THE! OF! RIVER!", "日本語", "river\nstone\tthe", "😀", "the of " * 30000, "Q"]
    texts = good + odd
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else None, 1.0, True) for i, t in enumerate(texts)], "doc_id long, text string, lang string, bits double, kept boolean").repartition(4)
    labels = spark.createDataFrame([(i, 1) for i in range(280)] + [(281, 0), (5, 1), (None, 1), (282, None)], "doc_id long, quality int")
    held = {r["__id"] for r in quality.trusted(docs, labels, "doc_id", "quality").where("held").collect()}
    assert 10 < len(held) < 60
    got = {r.id: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == len(texts)
    learnt = {lang: [t for i, t in enumerate(texts) if i % 2 == lang and i < 280 and i not in held] for lang in (0, 1)}
    pooled = brute_model(learnt[0] + learnt[1])

    def measures(lang=None):
        return [math.ceil((math.log2(got[i].perplexity) - quality.SLACK / math.sqrt(1 + len(texts[i]))) * 1000) for i in held if lang is None or i % 2 == lang]

    for lang, name in ((1, "en"), (0, "und")):
        alone, share = brute_model(learnt[lang]), len(learnt[lang]) / (len(learnt[lang]) + quality.FEW)

        def mixed(gram, alone=alone, share=share):
            return share * alone(gram) + (1 - share) * pooled(gram)

        for i, t in enumerate(texts):
            if i % 2 == lang:
                assert got[i].model == name
                assert math.isclose(math.log2(got[i].perplexity), brute_bits(t or "", mixed), rel_tol=1e-4, abs_tol=1e-4), (i, t)
                assert got[i].kept == (got[i].perplexity <= got[i].threshold)
        own = measures(lang)
        share = len(own) / (len(own) + quality.FEW)
        want = (share * np.percentile(own, 100 * quality.QUANTILE) + (1 - share) * np.percentile(measures(), 100 * quality.QUANTILE)) / 1000
        i = 3 if lang else 2
        assert math.isclose(math.log2(got[i].threshold), want + quality.SLACK / math.sqrt(1 + len(texts[i])), abs_tol=2e-3)
    kept = {i for i in got if got[i].kept}
    assert len(kept & set(range(300))) >= 295 and {300, 301} <= kept and not {302, 303} & kept
    rest = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    assert rest == kept


def test_a_language_with_few_rows_leans_on_all(spark):
    """One trusted row of its own counts for 1 / (1 + FEW); a language without any is judged by the pooled model."""
    rows = [(i, f"the river and stone {i}", "en") for i in range(60)] + [(100, "le fleuve", "fr"), (101, "the river", "fr"), (102, "the river", "xx"), *((None, "", "fr") for _ in range(50))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1) for i in range(60)] + [(100, 1)], "doc_id long, quality int")
    held = {r["__id"] for r in quality.trusted(docs, labels, "doc_id", "quality").where("held").collect()}
    assert 100 not in held
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows) and sum(r.id is None and r.kept for r in got) == 50
    of = {r.id: r for r in got if r.id is not None}
    french, pooled = brute_model(["le fleuve"]), brute_model([t for i, t, _ in rows if i is not None and i <= 100 and i not in held])
    want = brute_bits("the river", lambda g: (french(g) + quality.FEW * pooled(g)) / (1 + quality.FEW))
    assert math.isclose(math.log2(of[101].perplexity), want, rel_tol=1e-4) and of[101].model == "fr"
    assert math.isclose(math.log2(of[102].perplexity), brute_bits("the river", pooled), rel_tol=1e-4) and of[102].model == quality.ALL


def test_probabilities_sum_to_one(spark):
    texts = spark.createDataFrame([("en", t) for t in ("abab", "abba", "日本", "a" * 40)], "lang string, text string")
    tables, weights = quality.smoothed(quality.counts(texts))
    model = quality.Model(tables, weights, None)
    for context in ("aba", "zzz", "日"):
        head = int(quality.codes(context)[len(context) - 1]) & (1 << 48) - 1 if len(context) == 3 else 0x65E5
        asked = spark.range(quality.SYMBOLS).selectExpr("'en' AS lang", f"({head}L << 16) | id AS gram")
        assert math.isclose(model.probabilities(asked).agg({"p": "sum"}).first()[0], 1, abs_tol=1e-6)


def test_rows_of_one_id_are_judged_each_for_itself(spark):
    random = np.random.default_rng(5)
    good = [" ".join(random.choice(["river", "stone", "the", "of", "paper"], 30)) for _ in range(120)]
    rows = [(i, t, "en") for i, t in enumerate(good)] + [(7, "#$%@ " * 40, "en"), (None, "#$%@ " * 40, "en"), (None, good[0], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1) for i in range(10, 120)], "doc_id long, quality int")
    kept = [(r.doc_id, r.text) for r in quality.keep_good(docs, labels, quantile=1.0).collect()]
    assert len(kept) > 110 and not any("#" in t for _, t in kept)
    assert (7, good[7]) in kept and ((None, good[0]) in kept) == ((0, good[0]) in kept)


def test_nothing_trusted_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a", "en"), (1, "a", "en")], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.kept for r in quality.classify(docs, none).collect()] == [True, True]
    assert quality.keep_good(docs, none).count() == 2
    assert quality.classify(docs.limit(0), none).count() == 0
