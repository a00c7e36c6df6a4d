"""Ranked lexical search: Block-Max MaxScore over shards of documents.

Index.  A shard is a run of documents of one task, bounded in rows and bytes.  It keeps a row for its documents (ids,
lengths in terms) and a row for each of its terms: the postings as bytes (gaps and counts as varints) in blocks of
BLOCK documents, and of every block its last document, its place in the bytes and what bounds its scores: the
shortest document among those that hold the term once, twice, three times, and more often, and the highest
count.  So block maxima follow for any number and length of documents, and shards stay valid while others are added.

Search.  A task takes one shard after the other and carries each item's k best and so its kth score along.  In a
shard, the lists of an item whose global bounds together stay below that score are non-essential: a document that
occurs in these only can't get in.  Documents of the essential lists are scored on these; those whose score with the
block maxima of all non-essential lists stays below the kth score are rejected before a block is decompressed.
Of the others, only the blocks that they lie in are, list by list from the highest bound on, with rejection after each.
Each task gives its k best an item, of which a window takes the k best.

Scores: see score() below; 64-bit integers with division rounding down.

Rules: terms are maximal runs of letters and digits of ASCII and of all characters beyond it, A-Z lower-cased; null
texts have none; documents without id take no part; repeated ids are documents of their own; a document without terms
is not counted; other columns are ignored.  Items of one id are one item with the terms of all; items without id
or without terms have no result; without documents there is none.  Texts are taken whole: a task holds a shard's texts
of about SHARD_BYTES, or one longer text.  Equal scores go by ascending id.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm import common

#: Documents and bytes of a shard's texts, postings of a block, bytes of the items that one search takes.
SHARD_DOCS, SHARD_BYTES, BLOCK, ITEM_BYTES = 8192, 16 << 20, 128, 4 << 20
#: Counts in a document that have a bound of their own; the last stands for all from it on.
CLASSES = (1, 2, 3, 4)
#: Bytes that end terms become spaces, capitals small letters.
_ENDS = [b for b in range(128) if not chr(b).isalnum()]
FOLD = bytes.maketrans(bytes([*_ENDS, *range(65, 91)]), b" " * len(_ENDS) + bytes(range(97, 123)))
INDEX = "shard long, term string, df int, last array<int>, at array<int>, shortest array<int>, most array<int>, postings binary, ids array<long>, sizes array<int>, n_docs long, n_terms long"


def words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(place of the text, term) of every term of every text, in order."""
    texts = texts.fill_null("").cast(pa.large_string()).take(pa.array(np.arange(len(texts))))  # a copy without offset
    _, offsets, data = texts.buffers()
    folded = pa.py_buffer(data.to_pybytes().translate(FOLD) if data else b"")
    split = pc.ascii_split_whitespace(pa.LargeStringArray.from_buffers(len(texts), offsets, folded))
    terms = split.flatten()
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    some = pc.greater(pc.binary_length(terms), 0)
    return row[some.to_numpy(zero_copy_only=False)], terms.filter(some)


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of non-negative numbers, seven bits each and the eighth where more follow; and where each number starts."""
    size = 1 + sum((values >> (7 * k) > 0).astype(np.int64) for k in range(1, 5))
    starts = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        own = size > k
        out[starts[own] + k] = ((values[own] >> (7 * k)) & 127) | ((size[own] > k + 1) << 7)
    return out, starts


def numbers(data: np.ndarray) -> np.ndarray:
    """What varints() wrote."""
    ends = np.flatnonzero(data < 128)
    starts = np.r_[0, ends[:-1] + 1]
    place = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), starts)


def _lists(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(flat, pa.int32()))


def _index(shard: int, ids: list[int], row: np.ndarray, terms: pa.Array, block: int) -> Iterator[pa.RecordBatch]:
    """INDEX rows of one shard; row: each term's document."""
    n = np.bincount(row, minlength=len(ids))
    schema = ["shard", "term", "df", "last", "at", "shortest", "most", "postings", "ids", "sizes", "n_docs", "n_terms"]
    types = [pa.int64(), pa.string(), pa.int32(), *[pa.list_(pa.int32())] * 4, pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.int64()]
    of_docs = {"shard": [shard], "ids": [ids], "sizes": [n.tolist()], "n_docs": [int((n > 0).sum())], "n_terms": [int(n.sum())]}
    yield pa.RecordBatch.from_arrays([pa.array(of_docs.get(c, [None]), t) for c, t in zip(schema, types)], schema)
    if not len(row):
        return
    coded = terms.dictionary_encode()
    key, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(ids) + row, return_counts=True)
    term, doc = np.divmod(key, len(ids))
    new = np.r_[True, term[1:] != term[:-1]]
    first = np.flatnonzero(new)
    df = np.diff(np.r_[first, len(key)])
    start = np.flatnonzero((np.arange(len(key)) - np.repeat(first, df)) % block == 0)
    before = np.r_[-1, doc[:-1]]
    before[first] = -1
    data, at = varints(np.stack([doc - before, tf], axis=1).ravel())
    counts, size = -(-df // block), n[doc]
    shortest = [np.minimum.reduceat(np.where(tf == c if c < CLASSES[-1] else tf >= c, size, np.iinfo(np.int32).max), start) for c in CLASSES]
    ends = np.r_[at[2 * first], len(data)]
    columns = {
        "shard": pa.array(np.full(len(first), shard)),
        "term": coded.dictionary.take(pa.array(term[first])).cast(pa.string()),
        "df": pa.array(df, pa.int32()),
        "last": _lists(doc[np.r_[start[1:], len(doc)] - 1], counts),
        "at": _lists(at[2 * start] - np.repeat(ends[:-1], counts), counts),
        "shortest": _lists(np.stack(shortest, axis=1).ravel(), len(CLASSES) * counts),
        "most": _lists(np.maximum.reduceat(tf, start), counts),
        "postings": pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())]),
    }
    whole = pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(len(first), t)) for c, t in zip(schema, types)], schema)
    yield from (whole.slice(i, 4096) for i in range(0, len(first), 4096))


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = SHARD_DOCS, block: int = BLOCK) -> DataFrame:
    """The INDEX table of the documents, written in the shared folder."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, rows, terms, held = TaskContext.get().partitionId() << 32, [], [], [], 0
        for batch in common.slices(batches, 1):
            for a in range(0, batch.num_rows, shard_docs):
                part = batch.slice(a, shard_docs)
                if ids and (len(ids) + part.num_rows > shard_docs or held + part.nbytes > SHARD_BYTES):
                    yield from _index(shard, ids, np.concatenate(rows), pa.concat_arrays(terms), block)
                    shard, ids, rows, terms, held = shard + 1, [], [], [], 0
                row, own = words(part.column(1))
                rows.append(row + len(ids))
                terms.append(own)
                ids += part.column(0).to_pylist()
                held += part.nbytes
        if ids:
            yield from _index(shard, ids, np.concatenate(rows), pa.concat_arrays(terms), block)

    plain = docs.where(docs[id_col].isNotNull()).select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    return common.cut(common.map_rows(plain, run, INDEX), "lexical")


def term_sets(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, terms) of the items that have terms, each term once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 1):
            row, own = words(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), own.cast(pa.string())], ["item", "term"])

    plain = items.where(items[id_col].isNotNull()).select(items[id_col].cast("long").alias("item"), items[text_col].cast("string").alias("text"))
    return common.map_rows(plain, run, "item long, term string").groupBy("item").agg(F.collect_set("term").alias("terms"))


def length_norm(sizes: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of documents with so many terms."""
    return 50 + (50 * sizes.astype(np.int64) * n_docs) // n_terms


def score(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A term's share of a document's score, without its weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Postings:
    """A term's list in one shard: block maxima at once, documents and shares of the score as they are asked for."""

    def __init__(self, row: dict, m: np.ndarray, n_docs: int, n_terms: int):
        self.last, self.at = np.array(row["last"], np.int64), [*row["at"], len(row["postings"])]
        self.data, self.m, self.blocks, self.all = np.frombuffer(row["postings"], np.uint8), m, {}, None
        shortest = np.array(row["shortest"], np.int64).reshape(-1, len(CLASSES))
        tf = np.repeat([CLASSES], len(shortest), axis=0)
        tf[:, -1] = row["most"]
        bounds = score(tf, length_norm(shortest, n_docs, n_terms))
        self.tops = np.where(shortest < np.iinfo(np.int32).max, bounds, 0).max(axis=1)
        self.top = int(self.tops.max())

    def _decoded(self, a: int, b: int, before: int) -> tuple[np.ndarray, np.ndarray]:
        pairs = numbers(self.data[a:b])
        docs = before + np.cumsum(pairs[::2])
        return docs, score(pairs[1::2], self.m[docs])

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        if self.all is None:
            self.all = self._decoded(0, len(self.data), -1)
        return self.all

    def some(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and shares of these blocks, which come in ascending order."""
        if self.all is not None:
            return self.all
        for b in blocks.tolist():
            if b not in self.blocks:
                self.blocks[b] = self._decoded(self.at[b], self.at[b + 1], int(self.last[b - 1]) if b else -1)
        parts = [self.blocks[b] for b in blocks.tolist()]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def search_shard(lists: list[tuple[Postings, int]], n: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents that reach the floor, 1 at least, and their scores.  lists: postings and weights; n: documents of the shard."""
    lists = sorted(lists, key=lambda x: x[0].top * x[1])
    rest = np.cumsum([p.top * w for p, w in lists])
    lead = int(np.searchsorted(rest, floor))  # so many lists are non-essential
    total = np.zeros(n, np.int64)
    for p, w in lists[lead:]:
        docs, shares = p.whole()
        total[docs] += w * shares
    found = np.flatnonzero(total)
    if lead:
        found = found[total[found] + rest[lead - 1] >= floor]
    blocks, tops = [], np.zeros((lead, len(found)), np.int64)
    for i, (p, w) in enumerate(lists[:lead]):
        blocks.append(np.searchsorted(p.last, found))
        inside = blocks[i] < len(p.last)
        tops[i, inside] = w * p.tops[blocks[i][inside]]
    bound = total[found] + tops.sum(axis=0)
    left = np.flatnonzero(bound >= floor)
    for i in reversed(range(lead)):
        p, w = lists[i]
        at = blocks[i][left]
        needed = np.unique(at[at < len(p.last)])
        bound[left] -= tops[i, left]
        if len(needed):
            docs, shares = p.some(needed)
            own = found[left]
            place = np.minimum(np.searchsorted(docs, own), len(docs) - 1)
            gain = np.where(docs[place] == own, w * shares[place], 0)
            bound[left] += gain
        left = left[bound[left] >= floor]
    return found[left], bound[left]


def _searched(items: list[tuple[int, list[str]]], weights: dict[str, int], n_docs: int, n_terms: int, k: int):
    """For INDEX rows of whole shards in order, documents first: the k best (item, id, score) of each item."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {item: (np.empty(0, np.int64), np.empty(0, np.int64)) for item, _ in items}
        ids, m, lists = np.empty(0, np.int64), None, {}

        def close() -> None:
            for item, terms in items:
                own = [(lists[t], weights[t]) for t in terms if t in lists]
                if not own:
                    continue
                old_ids, old = best[item]
                docs, scores = search_shard(own, len(ids), max(1, int(old[-1])) if len(old) == k else 1)
                new_ids, new = np.r_[old_ids, ids[docs]], np.r_[old, scores]
                order = np.lexsort((new_ids, -new))[:k]
                best[item] = new_ids[order], new[order]

        for batch in batches:
            for row in batch.to_pylist():
                if row["term"] is None:
                    close()
                    ids, m, lists = np.array(row["ids"], np.int64), length_norm(np.array(row["sizes"], np.int64), n_docs, n_terms), {}
                else:
                    lists[row["term"]] = Postings(row, m, n_docs, n_terms)
        close()
        for item, (found, scores) in best.items():
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), item)), pa.array(found), pa.array(scores)], ["item", "id", "score"])

    return run


def search(index: DataFrame, items: DataFrame, k: int = 50, item_col: str = "item_id", text_col: str = "text", id_name: str = "doc_id") -> DataFrame:
    """(item, rank, id, score) of each item's k best documents, all if fewer; see the module for the rules.

    Items are taken in blocks of about ITEM_BYTES, of which each is searched against all shards.
    """
    spark = index.sparkSession
    n_docs, n_terms = index.where("term is null").agg(F.sum("n_docs"), F.sum("n_terms")).first()
    sets = common.cut(term_sets(items, item_col, text_col), "items")
    size = sets.select(F.sum(16 + F.aggregate("terms", F.lit(0).cast("long"), lambda a, t: a + 8 + F.octet_length(t)))).first()[0] or 0
    blocks = 1 + size // ITEM_BYTES
    dealt = sets.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    tasks, found = int(spark.conf.get("spark.sql.shuffle.partitions")), None
    for i in range(blocks if n_terms and size else 0):
        own = dealt.where(F.col("block") == i)
        some = own.select(F.explode("terms").alias("term")).distinct()
        frequent = index.select("term", "df").join(F.broadcast(some), "term").groupBy("term").agg(F.sum("df").alias("df"))  # bounded by the block's bytes
        weights = {r.term: weight(r.df, n_docs) for r in frequent.collect()}
        asked = [(r.item, sorted(t for t in r.terms if weights.get(t, 0) > 0)) for r in own.collect()]
        needed = index.where("term is null").unionByName(index.join(F.broadcast(some), "term", "left_semi"))
        in_order = needed.drop("df", "n_docs", "n_terms").repartition(tasks, "shard").sortWithinPartitions("shard", F.col("term").asc_nulls_first())
        more = common.map_rows(in_order, _searched(asked, weights, n_docs, n_terms, k), "item long, id long, score long")
        found = more if found is None else found.unionByName(more)
    if found is None:
        found = spark.createDataFrame([], "item long, id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k).select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_name), "score")
