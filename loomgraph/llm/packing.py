"""Packing documents into sequences: first-fit decreasing with a tournament tree, in randomised groups.

A document's ids (by merges; with the id that ends it) are cut into pieces of the sequence length; full pieces are
sequences of their own.  Pieces are dealt at random into groups of about GROUP, as many as the written table of
pieces asks for however long its documents are, and each group is packed by itself: pieces in decreasing length go to the first open sequence with room for
them, found by walking down a tournament tree whose nodes hold the largest room below them.  Padding is what
stays free in a group's sequences, mostly in its last one: a few thousandths.

Groups are drawn from the place of a piece in its partition, not from its key, so copies and hot keys spread
evenly; the table of pieces and draws is written before it is grouped, so a lost task can't deal pieces anew.  Only
lengths and checksums are shuffled.

Rules: a null or empty text still has the end id (one piece of length 1); repeated rows are packed again each;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import common, merges

#: Pieces in a group, about.
GROUP = 2048
#: Bytes of the texts that are encoded at once, about.
SLICE_BYTES = 4 << 20
PIECE = "doc_id {key}, start long, length long, ids_crc32 long, doc_tokens long"


class Bins:
    """Open sequences; a tournament tree over their free room finds the first with room enough."""

    def __init__(self, most: int, room: int):
        self.leaves = 1 << max(0, (most - 1).bit_length())
        self.tree = [room] * (2 * self.leaves)

    def put(self, length: int) -> int:
        """The first bin with room for length, which it takes."""
        tree, node = self.tree, 1
        while node < self.leaves:
            node *= 2
            if tree[node] < length:
                node += 1
        tree[node] -= length
        bin_, node = node - self.leaves, node >> 1
        while node:
            most = tree[2 * node] if tree[2 * node] > tree[2 * node + 1] else tree[2 * node + 1]
            if tree[node] == most:
                break
            tree[node] = most
            node >>= 1
        return bin_


def first_fit_decreasing(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, longest first and ties in the order given."""
    bins, used = Bins(max(1, len(lengths)), room), {}
    where, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        b = where[i] = bins.put(n)
        offset[i] = used.get(b, 0)
        used[b] = used.get(b, 0) + n
    return where, offset


def pack(docs: DataFrame, tokenizer_path: str, length: int = 4096, end_id: int = 2, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with_ids also the ids."""
    key = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], dtype="<u4").tobytes()
    fields = PIECE.format(key=key).replace("doc_id", "id", 1) + (", ids array<int>" if with_ids else "")

    def cut(batch: pa.RecordBatch, packed: list[bytes]) -> pa.RecordBatch:
        draw = _place_stream()
        out: list[list] = [[] for _ in range(7)]
        for i, p in zip(batch.column(0).to_pylist(), packed):
            p += end
            total = len(p) // 4
            for start in range(0, total, length):
                part = p[4 * start : 4 * (start + length)]
                n = len(part) // 4
                for column, value in zip(out, (i, start, n, zlib.crc32(part), total, next(draw), np.frombuffer(part, "<u4").astype(np.int32) if with_ids else None)):
                    column.append(value)
        arrays = [pa.array(out[0], batch.schema.field(0).type), *(pa.array(c, pa.int64()) for c in out[1:6])]
        names = ["id", "start", "length", "ids_crc32", "doc_tokens", "draw"]
        if with_ids:
            arrays.append(pa.array(out[6], pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(arrays, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = merges.coder(tokenizer_path)
        for batch in common.slices(batches, 1, SLICE_BYTES):
            yield cut(batch, coder.encode([t or "" for t in batch.column(1).to_pylist()]))

    source = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    pieces = common.map_rows(source, run, PIECE.format(key=key).replace("doc_id", "id", 1) + ", draw long" + (", ids array<int>" if with_ids else ""), "merges")

    def pack_group(rows: pa.Table) -> pa.Table:
        if merges.coder.cache_info().currsize:
            common.release(None)  # the coder is done with
        rows = rows.sort_by([("id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        n, bucket = rows["length"].to_numpy(), rows["bucket"][0].as_py()
        where, offset = first_fit_decreasing(n, length)
        return rows.drop_columns(["bucket"]).append_column("sequence_id", pa.array((bucket << 32) + where, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    # the draws are made once: a task that runs again after this reads the same table
    drawn = common.cut(pieces, "pieces")
    dealt = drawn.withColumn("bucket", F.pmod("draw", F.lit(max(1, -(-drawn.count() // group))))).drop("draw")
    packed = dealt.groupBy("bucket").applyInArrow(pack_group, f"{fields}, sequence_id long, offset long")
    return packed.withColumnRenamed("id", id_col)


def _place_stream() -> Iterator[int]:
    """Pseudo-random numbers fixed by the task's partition and, within it, by how many were drawn before."""
    context = TaskContext.get()
    where = (context.partitionId() if context else 0, context.taskAttemptId() if context else 0)
    if _STREAMS.get("task") != where:
        _STREAMS["task"], _STREAMS["draws"] = where, _draws(where[0])
    return _STREAMS["draws"]


_STREAMS: dict = {}


def _draws(partition: int) -> Iterator[int]:
    random = np.random.Generator(np.random.PCG64(partition))
    while True:
        yield from random.integers(0, 1 << 62, 4096).tolist()
