"""Toxicity: noisy-channel deobfuscation, then a linear score of the restored text.

Every piece between white space becomes a lattice, and so does every run of pieces of one or two characters,
whatever white space lies between them: a character may stand for itself, for the letters it imitates, for
nothing or for a break between words if it only separates; two or more equal letters may stand for one or two.
Viterbi search finds the reading that is most probable under the channel's costs and a character trigram
model; the words of that reading are added to the words of the text.  A lattice with one path, letters none of which
repeat, needs no search.

The trigram model counts the letters of the words of all documents (letters without their marks; any letter beyond a
to z is one class, so that the table has at most 29^3 rows whatever the corpus), and marked words in addition.  The
scorer is fitted on at most SAMPLE labelled rows, drawn by a hash of their id: features are the whole words and the
beginnings of words that occur more in toxic texts by a log-likelihood ratio of LEAST_G2 or more, with weights from a
logistic regression.  Scoring maps over all texts; nothing is shuffled.

Rules: null and empty texts get the score of a text without any feature; a row labelled more than once has its
largest label, null labels do not count; without both kinds of labels every score is 0; repeated rows
give repeated results; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import common

#: Labelled rows to learn from at most, and the least log-likelihood ratio of a feature.
SAMPLE, LEAST_G2 = 20_000, 12.0
#: Lengths of word beginnings that are features.
PREFIXES = (4, 5, 6)
#: Pieces that a worker keeps, and the longest that it keeps: some 100 MB at most.
KEPT, LONGEST = 300_000, 64
#: A marked word counts as often as one word in so many.
MARKED = 1000
#: The letters that a sign may stand for.
IMITATES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
#: Signs that only separate letters.
SEPARATES = set(" .-_*'~,:;/\\#&%^")
#: Costs (negative logarithms) of the channel; AS_ITSELF: a digit or sign that is no letter.
AS_SIGN, AS_NOTHING, RUN_TO_ONE, RUN_TO_TWO, AS_ITSELF = 0.7, 0.2, 0.5, 1.0, 3.0
#: What begins and ends a word, and the class of other letters.
BEGIN, END, OTHER = "\x02", "\x03", "\x04"
START = BEGIN + BEGIN

#: What separates and imitates no letter: at the edges of a piece it changes no reading.
EDGES = "".join(sorted(SEPARATES - set(IMITATES)))
SHORT = re.compile(r"(?<!\S)\S{1,2}(?:\s+\S{1,2})+(?!\S)")
TWICE = re.compile(r"(.)\1")
PARTS = re.compile(r"[^\W\d_]+")


@lru_cache(1 << 16)
def letter(char: str) -> str:
    """A letter as the trigram model counts it."""
    base = unicodedata.normalize("NFD", char)[0]
    return base if "a" <= base <= "z" else OTHER


class CharModel:
    """Trigram model of the letters of words, backed off to bigrams and single letters."""

    def __init__(self, tri: dict[str, float] | None = None):
        self.tri: dict[str, float] = dict(tri or {})
        self._known: dict[str, float] = {}

    def add(self, word: str, n: float) -> None:
        for key in trigrams(word):
            self.tri[key] = self.tri.get(key, 0) + n
        self._known = {}

    def ready(self) -> CharModel:
        """Sum the counts of the shorter contexts."""
        self.bi: dict[str, float] = defaultdict(float)
        self.pair: dict[str, float] = defaultdict(float)
        self.one: dict[str, float] = defaultdict(float)
        for key, n in self.tri.items():
            self.bi[key[:2]] += n
            self.pair[key[1:]] += n
            self.one[key[1]] += n
        self.bi, self.pair, self.one = dict(self.bi), dict(self.pair), dict(self.one)
        return self

    def cost(self, key: str) -> float:
        """Negative logarithm of the probability of the last of three symbols after the first two."""
        known = self._known.get(key)
        if known is None:
            lower = (self.pair.get(key[1:], 0) + 0.05) / (self.one.get(key[1], 0) + 2.0)
            known = self._known[key] = -math.log((self.tri.get(key, 0) + 5 * lower) / (self.bi.get(key[:2], 0) + 5))
        return known


def trigrams(word: str) -> list[str]:
    padded = START + "".join(map(letter, word)) + END
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


def options_of(c: str, n: int) -> list[tuple[str, float]]:
    """What a run of n equal characters may stand for, with its cost; a space is a break between words."""
    options: list[tuple[str, float]] = []
    if c.isalpha():
        options = [(c, 0.0)] if n == 1 else [(c * 2, 0.0), (c, RUN_TO_ONE)] if n == 2 else [(c, RUN_TO_ONE), (c * 2, RUN_TO_TWO)]
    for x in IMITATES.get(c, ""):
        options += [(x, AS_SIGN)] + ([(x * 2, AS_SIGN)] if n > 1 else [])
    if c in SEPARATES:
        options += [("", AS_NOTHING), (" ", 0.0)]
    elif not c.isalpha():
        options.append((" ", AS_ITSELF * min(n, 3)))
    return options


@lru_cache(1 << 12)
def _choices(c: str, n: int) -> tuple[tuple[str, float, tuple[str, ...] | None], ...]:
    """options_of() with the letters as the trigram model counts them, None for a break."""
    return tuple((letters, extra, None if letters == " " else tuple(map(letter, letters))) for letters, extra in options_of(c, n))


def decode(token: str, model: CharModel) -> str:
    """The most probable reading of a token: words with single spaces between them."""
    states: dict[str, tuple[float, tuple]] = {START: (0.0, ())}
    cost, at, end = model.cost, 0, len(token)
    while at < end:
        c, first = token[at], at
        while at < end and token[at] == c:
            at += 1
        after: dict[str, tuple[float, tuple]] = {}
        # longer runs of letters and separators stand for the same as three
        for letters, extra, folded in _choices(c, min(at - first, 3)):
            for state, (total, path) in states.items():
                total += extra
                if folded is None:
                    if state != START:
                        total += cost(state + END)
                    last = START
                else:
                    last = state
                    for x in folded:
                        total += cost(last + x)
                        last = last[1] + x
                if last not in after or total < after[last][0]:
                    after[last] = (total, (path, letters) if letters else path)
        states = after
    _, path = min(((total + (cost(s + END) if s != START else 0.0), path) for s, (total, path) in states.items()), key=lambda x: x[0])
    out = []
    while path:
        path, letters = path
        out.append(letters)
    return " ".join("".join(reversed(out)).split())


def pieces_of(text: str) -> set[str]:
    """Pieces between white space of the lower-case text, and runs of short pieces with one space between them."""
    text = text.lower()
    found = set(text.split())
    found.update(" ".join(m.split()) for m in SHORT.findall(text))
    return found


class Reader:
    """From pieces to words and features, with a bounded store."""

    def __init__(self, model: CharModel, known: dict[str, int] | None = None):
        self.model, self.known, self.store = model, known or {}, {}
        bits = {c: 1 << i for i, c in enumerate(sorted({c for f in self.known for c in f.removeprefix("=")}))}
        masks = {self._mask(f.removeprefix("="), bits) for f in self.known}
        #: Letters of the features; those that another one needs too are left out.
        self.needs = sorted(m for m in masks if not any(o != m and o & m == o for o in masks))
        #: Letters of features that a character may stand for.
        self.gives = {c: self._mask(c + IMITATES.get(c, ""), bits) for c in {*bits, *IMITATES}}

    @staticmethod
    def _mask(letters: str, bits: dict[str, int]) -> int:
        out = 0
        for c in letters:
            out |= bits.get(c, 0)
        return out

    def words(self, piece: str) -> set[str]:
        """The words that a piece holds as it is, and those of its most probable reading."""
        core = piece.strip(EDGES)
        if core.isalpha() and not TWICE.search(core):
            return {core}
        return {*PARTS.findall(piece), *decode(piece, self.model).split()}

    def _features(self, piece: str) -> tuple[int, ...]:
        have, gives = 0, self.gives
        for c in set(piece):
            have |= gives.get(c, 0)
        for need in self.needs:
            if need & have == need:
                return tuple(sorted({self.known[f] for w in self.words(piece) for f in features_of(w) if f in self.known}))
        return ()  # no reading has all letters of any feature

    def features(self, piece: str) -> tuple[int, ...]:
        """Numbers of the known features of a piece."""
        kept = self.store.get(piece)
        if kept is None:
            kept = self._features(piece)
            if len(piece) <= LONGEST:
                if len(self.store) >= KEPT:
                    self.store.clear()
                self.store[piece] = kept
        return kept

    def vector(self, text: str) -> list[int]:
        """Numbers of the features of a text, each once."""
        get, found = self.store.get, set()
        for p in pieces_of(text):
            if (hit := get(p)) is None:
                hit = self.features(p)
            if hit:
                found.update(hit)
        return sorted(found)


#: The reader of the model that this worker used last.
_LAST: dict[str, Reader] = {}
common.HELD["toxicity"] = _LAST.clear


def reader_of(model: Model) -> Reader:
    """A reader whose store stays in the worker between tasks of the same model."""
    if model.name not in _LAST:
        _LAST.clear()
        _LAST[model.name] = Reader(model.chars, model.known)
    return _LAST[model.name]


def features_of(word: str) -> Iterator[str]:
    yield "=" + word
    for n in PREFIXES:
        if len(word) >= n:
            yield word[:n]


class Model:
    """A fitted scorer."""

    def __init__(self, chars: CharModel, known: dict[str, int], weights: np.ndarray, bias: float):
        self.chars, self.known, self.weights, self.bias, self.name = chars, known, weights, bias, uuid.uuid4().hex

    def scores(self, reader: Reader, texts: Iterable[str]) -> list[float]:
        weights = self.weights
        return [1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + sum(weights[i] for i in reader.vector(t)))))) for t in texts]


def letters_of(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, n): the trigrams of the words of all texts, as trigrams() gives them; a task adds up its texts' codes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(KINDS**3, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    total += np.bincount(_codes(text.lower()), minlength=KINDS**3)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([_key(int(c)) for c in found], pa.string()), pa.array(total[found])], ["key", "n"])

    rows = docs.select(docs[text_col].cast("string").alias("text"))
    return common.map_rows(rows, run, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))


#: Symbols of the trigram model: no letter, a to z, other letters, the end of a word.
KINDS = 29


def _kind(char: str) -> int:
    if PARTS.fullmatch(char) is None:
        return 0
    own = letter(char)
    return 27 if own == OTHER else ord(own) - 96


@lru_cache(1)
def _kinds() -> np.ndarray:
    return np.array([0 if 0xD800 <= c < 0xE000 else _kind(chr(c)) for c in range(65536)], dtype=np.int16)


def _codes(text: str) -> np.ndarray:
    """Numbers of the trigrams of a text's words."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    kinds = np.zeros(len(points) + 3, dtype=np.int32)  # no letter before and after the text
    kinds[2:-1] = _kinds()[np.minimum(points, 65535)]
    for at in np.flatnonzero(points > 65535):
        kinds[2 + at] = _kind(chr(points[at]))
    a, b, c = kinds[:-2], kinds[1:-1], kinds[2:]
    some = (b > 0) | (c > 0)
    a, b, c = np.where(b > 0, a, 0)[some], b[some], c[some]
    return (a * KINDS + b) * KINDS + np.where(c > 0, c, KINDS - 1)


def _key(code: int) -> str:
    sign = lambda k: BEGIN if k == 0 else END if k == KINDS - 1 else OTHER if k == 27 else chr(96 + k)
    return sign(code // KINDS**2) + sign(code // KINDS % KINDS) + sign(code % KINDS)


def sample_of(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, limit: int) -> DataFrame:
    """(text, y) of at most limit labelled rows, drawn by a hash of the id; so few that joining them broadcasts a bounded table; copies count once."""
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("y"))
    few = marked.orderBy(F.xxhash64("__id"), "__id").limit(limit)
    rows = docs.select(docs[id_col].alias("__id"), docs[text_col].cast("string").alias("text"))
    return rows.join(F.broadcast(few), "__id").where("text is not null").groupBy("text").agg(F.max("y").alias("y"))


def feature_counts(rows: DataFrame) -> DataFrame:
    """(f, t, n): toxic and other texts with each feature; rows: (text, y)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list[int]] = defaultdict(lambda: [0, 0])

        def full() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"f": pa.array(list(total), pa.string()), "t": pa.array([x[0] for x in total.values()], pa.int64()), "n": pa.array([x[1] for x in total.values()], pa.int64())})
            total.clear()
            return out

        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for f in {f for w in set(PARTS.findall(text.lower())) for f in features_of(w)}:
                    total[f][y <= 0] += 1
            if len(total) > 400_000:
                yield full()
        yield full()

    return common.map_rows(rows, run, "f string, t long, n long").groupBy("f").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", limit: int = SAMPLE) -> Model | None:
    """A model from the labelled rows of docs; None without rows of both kinds."""
    rows = common.cut(sample_of(docs, labels, id_col, text_col, label_col, limit), "labelled")
    sizes = {r.y: r.n for r in rows.groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    positive, negative = sizes.get(1, 0), sizes.get(0, 0)
    if not positive or not negative:
        return None
    t, n = F.col("t"), F.col("n")
    share = positive / (positive + negative)
    part = lambda seen, of: F.when(seen > 0, seen * F.log(seen / of)).otherwise(0.0)
    g2 = 2 * (part(t, (t + n) * share) + part(n, (t + n) * (1 - share)))
    # at most what the sample's texts hold
    chosen = sorted(r.f for r in feature_counts(rows).where((t > (t + n) * share) & (g2 >= LEAST_G2)).select("f").collect())
    known = {f: i for i, f in enumerate(chosen)}
    chars = CharModel({r.key: r.n for r in letters_of(docs, text_col).collect()})  # 29^3 rows at most
    often = max(1.0, sum(v for k, v in chars.tri.items() if k[2] == END) / MARKED)
    for f in chosen:
        if f[0] == "=":
            chars.add(f[1:], often)
    chars.ready()

    def vectors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(chars, known)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([reader.vector(x) for x in batch.column(0).to_pylist()], pa.list_(pa.int32())), batch.column(1)], ["x", "y"])

    patterns = common.map_rows(rows, vectors, "x array<int>, y int").groupBy("x", (F.col("y") > 0).cast("double").alias("y")).agg(F.count("*").alias("n")).collect()
    weights, bias = regression(patterns, len(known))
    return Model(chars, known, weights, bias)


def regression(patterns: list, width: int, penalty: float = 1e-3, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias of a penalised logistic regression; patterns: rows of feature numbers x, label y and count n, at most one for each sampled text."""
    patterns = sorted(patterns, key=lambda r: (r.x, r.y))
    at = np.repeat(np.arange(len(patterns)), [len(r.x) for r in patterns])
    feature = np.array([i for r in patterns for i in r.x], dtype=np.int64)
    y, n = np.array([r.y for r in patterns]), np.array([r.n for r in patterns], dtype=np.float64)
    n = n * np.where(y > 0, 0.5 / n[y > 0].sum(), 0.5 / n[y == 0].sum())
    weights, bias = np.zeros(width), 0.0
    moment, square = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        margin = bias + np.bincount(at, weights[feature], len(patterns)) if len(feature) else np.full(len(patterns), bias)
        error = n * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y)
        slope = np.append(np.bincount(feature, error[at], width) + penalty * weights, error.sum()) if width else np.array([error.sum()])
        moment, square = 0.9 * moment + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        move = 0.1 * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
        weights, bias = weights - move[:-1], bias - move[-1]
    return weights, float(bias)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score double) of every whole text."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    if model is None:
        return rows.select("id", F.lit(0.0).alias("score")).withColumnRenamed("id", id_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample and by 29^3

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        reader = reader_of(own)
        for batch in common.slices(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.scores(reader, [t or "" for t in batch.column(1).to_pylist()]), pa.float64())], ["id", "score"])

    return common.map_rows(rows, run, f"id {docs.schema[id_col].dataType.simpleString()}, score double", "toxicity").withColumnRenamed("id", id_col)


def keep_harmless(docs: DataFrame, model: Model | None, limit: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs without the texts that score limit or more, in one pass: the texts are read and written in the same task."""
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        reader = reader_of(own)
        for batch in common.slices(batches, at):
            scores = own.scores(reader, [t or "" for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array([s < limit for s in scores], pa.bool_()))

    return common.map_rows(docs, run, docs.schema, "toxicity")


def held_out(id_col: str = "doc_id"):
    """Whether a row is never learned from: crc32 of the id as text is divisible by 5."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0
