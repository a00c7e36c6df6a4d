"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

Symbols are UTF-16 units, so every character of every script is its own symbol (or two), and an n-gram of order 4
fills a 64-bit number: its context is the number shifted right, what is below it the number masked.  Counts cover
all trusted rows and grow with them: each task counts its texts, the partial counts are summed by n-gram over
the shards, continuation counts are grouped from the order above, and joins of the counts with their contexts'
sums on (language, order, context) give the probability of every seen n-gram and the weight of every context.

Scoring is a sharded count join as well.  Documents are dealt to shards of about SHARD characters by a hash;
a shard asks for each of its distinct n-grams once.  Distinct n-grams of all shards are joined to the model, order
by order, and the answers go back to the shards that asked, where every document's bits are summed.  Nothing of the
model passes through the driver.  The two lowest orders, whose joins have few and frequent keys, are broadcast where
their counted size allows it; the others are shuffled on keys of three and more symbols.

A language's model is interpolated with that of all languages together: with r trusted rows of its own, its
probabilities weigh r / (r + FEW), the pooled ones the rest; so does its threshold with h held-out rows.  No
number of rows switches from one to the other.

A share of the trusted rows, drawn by a hash of the id, is left out of the counts.  A text's measure is the bits
per symbol less SLACK / sqrt(symbols), so that short texts, which say little, are not judged by chance; the
threshold is the given quantile of the held-out rows' measures, by language.

Rules: null and empty texts have one symbol (the end) and are kept; null languages form a language of their
own; a language without trusted rows uses the model and threshold of all languages together; without
trusted rows everything is kept; a row labelled more than once is trusted if all its labels are 1; repeated
ids are judged row by row, rows without an id like any others, dealt by their place and not by their key; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import common

#: Units of an n-gram, bits of a unit, and the number of symbols that are possible.
ORDER, UNIT, SYMBOLS = 4, 16, 1 << 16
#: Trusted rows of a language at which its own counts and the pooled ones weigh the same.
FEW = 25
#: The quantile of held-out trusted rows, and one in how many is held out.
QUANTILE, FOLDS = 0.99, 5
#: Slack of a text of n symbols, as SLACK / sqrt(n) bits: about two and a half deviations of a symbol's bits, which vary by 2.5.
SLACK = 6.0
#: Slack of a text without characters: more bits than a symbol can have.
NO_TEXT = 64.0
#: The name of the model of all languages together.
ALL = "*"
#: Orders of the model that are broadcast where they are small: their keys are one or two symbols, so few.
LOW = 2
#: Characters of a shard, about, and symbols that a task holds before it counts them.
SHARD, PENDING = 32 << 20, 4 << 20


def codes(text: str) -> np.ndarray:
    """The text's n-grams as numbers: one for each unit and one for the end."""
    units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), dtype="<u2")
    n = len(units) + 1
    s = np.zeros(n + ORDER - 1, dtype=np.int64)
    s[ORDER - 1 : -1] = units
    out = s[:n].copy()
    for k in range(1, ORDER):
        out <<= UNIT
        out |= s[k : k + n]
    return out


def below(gram: Column, n: int) -> Column:
    """The last n symbols of an n-gram."""
    return gram if n >= ORDER else gram.bitwiseAND(F.lit((1 << UNIT * n) - 1))


def context(gram: Column) -> Column:
    """All but the last symbol."""
    return F.shiftrightunsigned(gram, UNIT)


def counts(texts: DataFrame) -> DataFrame:
    """(lang, gram, c): how often each n-gram occurs; texts: (lang, text).  Tasks count before anything is shuffled."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(lang, []).append(codes(text or ""))
                size += len(text or "") + 1
                if size > PENDING:
                    yield from flush(held)
                    size = 0
        yield from flush(held)

    def flush(held: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            grams, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n.astype(np.int64))], ["lang", "gram", "c"])
        held.clear()

    return common.map_rows(texts, run, "lang string, gram long, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def smoothed(highest: DataFrame) -> tuple[dict[int, DataFrame], DataFrame]:
    """By order (lang, gram, p) of the n-grams seen, and (lang, n, context, weight) of all orders, from the highest order's counts.

    weight: what a context leaves to the order below.
    """
    orders, at = [highest.select("lang", F.lit(ORDER).alias("n"), "gram", "c")], highest
    for n in range(ORDER - 1, 0, -1):
        at = at.groupBy("lang", below(F.col("gram"), n).alias("gram")).agg(F.count("*").alias("c"))
        orders.append(at.select("lang", F.lit(n).alias("n"), "gram", "c"))
    table = orders[0]
    for more in orders[1:]:
        table = table.unionByName(more)
    table = common.cut(table.withColumn("context", context(F.col("gram"))), "ngrams")
    seen = [F.sum((F.col("c") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)]
    of = table.groupBy("lang", "n").agg(*seen)
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))

    def discount(k: int) -> Column:
        fair = k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")
        return F.when((F.col(f"n{k}") > 0) & (F.col("n1") > 0), F.greatest(F.lit(0.0), F.least(F.lit(float(k)), fair))).otherwise(k / 2).alias(f"d{k}")

    discounts = of.select("lang", "n", *(discount(k) for k in (1, 2, 3)))
    own = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    less = table.join(common.maybe_broadcast(discounts, 64), ["lang", "n"]).select("lang", "n", "gram", "context", "c", own.alias("d"))
    sums = less.groupBy("lang", "n", "context").agg(F.sum("c").alias("total"), F.sum("d").alias("left"))
    shared = less.join(sums, ["lang", "n", "context"])
    shared = common.cut(shared.select("lang", "n", "gram", "context", ((F.col("c") - F.col("d")) / F.col("total")).alias("share"), (F.col("left") / F.col("total")).alias("weight")), "shares")
    lower = None
    tables: dict[int, DataFrame] = {}
    for n in range(1, ORDER + 1):
        rows = shared.where(F.col("n") == n)
        if lower is None:
            rows = rows.withColumn("q", F.lit(1 / SYMBOLS))
        else:  # what follows the first symbol was counted in the order below
            rows = rows.withColumn("gram1", below(F.col("gram"), n - 1)).join(lower.select("lang", F.col("gram").alias("gram1"), F.col("p").alias("q")), ["lang", "gram1"])
        tables[n] = lower = common.cut(rows.select("lang", "gram", (F.col("share") + F.col("weight") * F.col("q")).alias("p")), f"order{n}")
    return tables, common.cut(shared.groupBy("lang", "n", "context").agg(F.first("weight").alias("weight")), "weights")


class Model:
    """The tables of all languages' models, in the shared folder: probabilities by order, context weights, and (lang, docs) of the languages that have a model."""

    def __init__(self, tables: dict[int, DataFrame], weights: DataFrame, langs: DataFrame | None):
        self.langs = langs
        self.tables = {n: common.maybe_broadcast(t, 48) if n <= LOW else t for n, t in tables.items()}
        by_order = {n: weights.where(F.col("n") == n).select("lang", "context", "weight") for n in tables}
        self.weights = {n: common.maybe_broadcast(w, 48) if n <= LOW else w for n, w in by_order.items()}

    def probabilities(self, asked: DataFrame) -> DataFrame:
        """(lang, gram, p) of distinct rows (lang, gram): seen n-grams by their own, others by the order below, weighted."""
        rows = asked.select("lang", "gram", F.lit(1.0).alias("left"), F.lit(None).cast("double").alias("p"))
        for n in range(ORDER, 0, -1):
            rows = rows.withColumn("key", below(F.col("gram"), n)).withColumn("context", context(F.col("key")))
            seen = self.tables[n].select("lang", F.col("gram").alias("key"), F.col("p").alias("own"))
            rows = rows.join(seen, ["lang", "key"], "left").join(self.weights[n], ["lang", "context"], "left")
            done = F.coalesce("p", F.col("left") * F.col("own"))
            rows = rows.select("lang", "gram", F.when(done.isNull(), F.col("left") * F.coalesce("weight", F.lit(1.0))).otherwise(F.col("left")).alias("left"), done.alias("p"))
        return rows.select("lang", "gram", F.coalesce("p", F.col("left") / SYMBOLS).alias("p"))

    def interpolated(self, asked: DataFrame) -> DataFrame:
        """(lang, gram, p) of distinct rows (lang, gram): a language's own model and the pooled one, weighted by its trusted rows."""
        own = self.probabilities(asked.where(F.col("lang") != ALL)).select("lang", "gram", F.col("p").alias("own"))
        pooled = self.probabilities(asked.select(F.lit(ALL).alias("lang"), "gram").distinct()).select("gram", F.col("p").alias("pooled"))
        share = common.maybe_broadcast(self.langs.select("lang", (F.col("docs") / (F.col("docs") + FEW)).alias("share")), 32)
        rows = asked.join(own, ["lang", "gram"], "left").join(pooled, "gram").join(share, "lang", "left")
        return rows.select("lang", "gram", F.coalesce(F.col("share") * F.col("own") + (1 - F.col("share")) * F.col("pooled"), "pooled").alias("p"))


def trusted(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(__id, held) of the trusted ids; held: left out of the counts."""
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).alias("q"))
    return marked.where("q = 1").select("__id", (F.pmod(F.xxhash64("__id", F.lit(8)), F.lit(FOLDS)) == 0).alias("held"))


def language(lang_col: str) -> Column:
    return F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality") -> Model | None:
    """The models of the trusted rows of docs that are not held out; None without any."""
    ids = trusted(docs, labels, id_col, label_col).where("not held").select("__id")
    rows = docs.select(docs[id_col].alias("__own"), language(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"))
    grams = common.cut(counts(rows.join(common.maybe_broadcast(ids, 16), F.col("__own") == F.col("__id")).select("lang", "text")), "counts")
    ends = grams.where(below(F.col("gram"), 1) == 0).groupBy("lang").agg(F.sum("c").alias("docs"))
    langs = common.cut(ends.where(F.col("lang") != ALL), "languages")
    pooled = grams.groupBy("gram").agg(F.sum("c").alias("c")).select(F.lit(ALL).alias("lang"), "gram", "c")
    tables, weights = smoothed(grams.where(F.col("lang") != ALL).unionByName(pooled))
    return Model(tables, weights, langs) if weights.take(1) else None


def _squeezed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column's texts compressed each for itself, which halves what a shuffle of them writes."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        texts = pa.array([t and squeeze(t.encode()) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], [*batch.schema.names[:-1], "z"])


def _texts(column: pa.Array | pa.ChunkedArray) -> list[str]:
    loose = zstandard.ZstdDecompressor().decompress
    return [loose(z).decode() if z else "" for z in column.to_pylist()]


def _asked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct n-grams of rows (shard, id, t, lang, z) by shard and language; a task may repeat some."""
    held: dict[tuple[int, str], list[np.ndarray]] = {}
    size = 0

    def merged() -> int:
        for key, parts in held.items():
            held[key] = [np.unique(np.concatenate(parts))]
        return sum(len(p[0]) for p in held.values())

    def flush() -> Iterator[pa.RecordBatch]:
        merged()
        for (shard, lang), (grams,) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([shard] * len(grams), pa.int32()), pa.array([lang] * len(grams), pa.string()), pa.array(grams)], ["shard", "lang", "gram"])
        held.clear()

    for batch in batches:
        for shard, lang, text in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), _texts(batch.column(4))):
            held.setdefault((shard, lang), []).append(codes(text))
            size += len(text) + 1
            if size > PENDING:
                size = merged()
                if size > PENDING / 2:
                    yield from flush()
                    size = 0
    yield from flush()


def _summed(docs: pa.Table, answers: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, bits per symbol, symbols) of a shard's documents, from the bits of its n-grams."""
    langs, texts = np.array(docs["lang"].to_pylist(), dtype=object), docs["z"]
    gram, b = answers["gram"].to_numpy(), answers["b"].to_numpy()
    for lang in sorted(set(langs)):
        mine = pc.equal(answers["lang"], lang).to_numpy()  # a mask, no string for each of a shard's n-grams
        known, first = np.unique(gram[mine], return_index=True)
        bits = b[mine][first].astype(np.float64)
        at, part, size = [], [], 0
        for row in [*np.flatnonzero(langs == lang).tolist(), -1]:
            if row >= 0:
                at.append(row)
                part.append(codes(_texts(texts.slice(row, 1))[0]))
                size += len(part[-1])
            if at and (row < 0 or size > PENDING / 4):
                flat, sizes = np.concatenate(part), np.array([len(x) for x in part])
                place = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                if not (known[place] == flat).all():
                    raise RuntimeError("a shard's n-grams lack an answer")
                yield np.array(at), np.add.reduceat(bits[place], np.cumsum(sizes) - sizes) / sizes, sizes
                at, part, size = [], [], 0


def entropies(docs: DataFrame, model: Model, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(id, t, lang, bits, slack) of every whole text; lang: the language whose model it was, t: a hash of the text and the language given."""
    spark = docs.sparkSession
    text, lang = F.col(text_col).cast("string"), language(lang_col)
    rows = docs.select(docs[id_col].alias("id"), row_hash(docs, text_col, lang_col).alias("t"), lang.alias("own"), text.alias("text"), F.when(docs[id_col].isNull(), F.monotonically_increasing_id()).alias("place"))
    named_langs = common.maybe_broadcast(model.langs.select(F.col("lang").alias("own"), F.col("lang").alias("model")), 32)
    shards = max(1, -(-(docs.agg(F.sum(F.length(text))).first()[0] or 0) // SHARD))
    named = rows.join(named_langs, "own", "left").select(F.pmod(F.xxhash64("id", "t", "place"), F.lit(shards)).cast("int").alias("shard"), "id", "t", F.coalesce("model", F.lit(ALL)).alias("lang"), "text")
    key = docs.schema[id_col].dataType.simpleString()
    squeezed = common.map_rows(named, _squeezed, f"shard int, id {key}, t long, lang string, z binary")
    # both readers of the shards find one exchange of the texts
    dealt = squeezed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard")
    asked = common.map_rows(dealt, _asked, "shard int, lang string, gram long")
    known = model.interpolated(asked.select("lang", "gram").distinct()).select("lang", "gram", (-F.log2("p")).cast("float").alias("b"))
    answers = asked.join(known, ["lang", "gram"]).select("shard", "lang", "gram", "b")

    def run(own: pa.Table, found: pa.Table) -> pa.Table:
        common.release(None)
        bits, slack = np.zeros(own.num_rows), np.zeros(own.num_rows)
        for at, value, symbols in _summed(own, found):
            bits[at] = value
            slack[at] = np.where(symbols > 1, SLACK / np.sqrt(symbols), NO_TEXT)
        return pa.table([own["id"], own["t"], own["lang"], pa.array(bits), pa.array(slack)], ["id", "t", "lang", "bits", "slack"])

    schema = f"id {key}, t long, lang string, bits double, slack double"
    return dealt.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(run, schema)


def row_hash(docs: DataFrame, text_col: str, lang_col: str) -> Column:
    """Tells rows of one id apart."""
    return F.xxhash64(docs[text_col].cast("string"), docs[lang_col].cast("string"))


def thresholds(scored: DataFrame, held: DataFrame, quantile: float) -> DataFrame:
    """(lang, threshold): the quantile of held-out rows' bits less slack, to a thousandth, pooled and by language; a language's is interpolated with the pooled one by its held-out rows."""
    own = scored.join(common.maybe_broadcast(held, 16), scored.id == held["__id"]).select("lang", F.ceil((F.col("bits") - F.col("slack")) * 1000).cast("long").alias("b"))
    each = own.groupBy("lang", "b").agg(F.count("*").alias("n"))
    pooled = each.groupBy("b").agg(F.sum("n").alias("n")).select(F.lit(ALL).alias("lang"), "b", "n")
    cuts = each.where(F.col("lang") != ALL).unionByName(pooled).groupBy("lang").agg((F.percentile("b", quantile, F.col("n")) / 1000).alias("own"), F.sum("n").alias("rows"))
    cuts = common.cut(cuts, "thresholds")
    every = cuts.where(F.col("lang") == ALL).first()
    share = F.when(F.col("lang") == ALL, F.lit(1.0)).otherwise(F.col("rows") / (F.col("rows") + FEW))
    return cuts.select("lang", (share * F.col("own") + (1 - share) * F.lit(every.own if every else None).cast("double")).alias("threshold"))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality") -> DataFrame:
    """(id, t, model, perplexity, threshold, kept) of every row; perplexity and threshold per symbol, the threshold with the text's slack; t as in row_hash()."""
    model = fit(docs, labels, id_col, text_col, lang_col, label_col)
    if model is None:
        return docs.select(docs[id_col].alias("id"), row_hash(docs, text_col, lang_col).alias("t"), F.lit(ALL).alias("model"), F.lit(1.0).alias("perplexity"), F.lit(None).cast("double").alias("threshold"), F.lit(True).alias("kept"))
    scored = common.cut(entropies(docs, model, id_col, text_col, lang_col), "entropies")
    held = trusted(docs, labels, id_col, label_col).where("held").select("__id")
    limits = thresholds(scored, held, quantile)
    pooled = limits.where(F.col("lang") == ALL).first()
    rows = scored.join(common.maybe_broadcast(limits.where(F.col("lang") != ALL), 32), "lang", "left")
    limit = F.coalesce(F.col("threshold"), F.lit(pooled.threshold if pooled else None).cast("double")) + F.col("slack")
    return rows.select("id", "t", F.col("lang").alias("model"), F.pow(F.lit(2.0), "bits").alias("perplexity"), F.pow(F.lit(2.0), limit).alias("threshold"), F.coalesce(F.col("bits") <= limit, F.lit(True)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """docs without the rows that classify() rejects; rows of one id go or stay each for itself."""
    judged = classify(docs, labels, id_col=id_col, text_col=text_col, lang_col=lang_col, **options)
    bad = common.cut(judged.where("not kept").select(F.col("id").alias("__bad"), F.col("t").alias("__t")).distinct(), "rejected")
    return docs.join(common.maybe_broadcast(bad, 24), docs[id_col].eqNullSafe(F.col("__bad")) & (row_hash(docs, text_col, lang_col) == F.col("__t")), "left_anti")
