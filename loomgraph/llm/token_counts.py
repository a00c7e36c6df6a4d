"""Token counts: the library encodes in Arrow functions that return lengths only.

Texts are cut at safe boundaries, before a single space that a word follows: the tokenizer's pattern
starts a match there whatever stands before, so counts of the pieces add up to the count of the text.  Pieces
that occur again are encoded once; what is left goes to the library in batches of about equal bytes.

Rules: null text counts as empty (no bytes, no tokens); special strings inside texts are handled as the
library does by default; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from loomgraph.llm import common

#: Bytes that a call of the library gets, and the counts that a worker keeps (two generations of so many).
CALL_BYTES, KEPT = 256 << 10, 400_000
#: Characters of the longest piece that is kept from one batch to the next, which bounds the store in bytes too.
LONGEST = 64
#: White space next to white space: there a text is cut by pattern instead of at every space.
DOUBLE, BOUNDARY = re.compile(r"\s\s"), re.compile(r" (?=\S)")


class Counter:
    """Counts tokens of whole texts for one byte-level vocabulary file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def _lengths(self, pieces: list[str]) -> list[int]:
        """Library counts of pieces, asked for in batches of about CALL_BYTES."""
        out: list[int] = []
        start = size = 0
        for i, p in enumerate(pieces):
            size += (len(p) if p.isascii() else len(p.encode())) + 8
            if size >= CALL_BYTES or i + 1 == len(pieces):
                out += map(len, self.library.encode_batch_fast(pieces[start : i + 1], add_special_tokens=False))
                start, size = i + 1, 0
        return out

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text.  A text's first piece is kept apart: only the others have a space before them."""
        split = [(t.split(" ") if DOUBLE.search(t) is None and not t.endswith(" ") else BOUNDARY.split(t)) for t in texts]
        firsts = [s[0] for s in split]
        needed: set[str] = set()
        for s in split:
            s[0] = ""
            needed.update(s)
        needed.discard("")
        if len(self.young) + len(needed) > KEPT:
            self.old, self.young = self.young, {}
        found, old, new = self.young, self.old, []
        for p in needed.difference(found):
            if (n := old.get(p)) is not None:
                found[p] = n
            else:
                new.append(p)
        found.update(zip(new, self._lengths([" " + p for p in new])))
        found[""] = 0
        get = found.__getitem__
        out = [n + sum(map(get, s)) for n, s in zip(self._lengths(firsts), split)]
        for p in new:
            if len(p) > LONGEST:
                del found[p]
        return out


@lru_cache(4)
def counter(path: str) -> Counter:
    """The worker's counter of a vocabulary file."""
    return Counter(path)


common.HELD["token_counts"] = counter.cache_clear


def count(docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text; over_limit: more than limit tokens."""

    def run(batches):
        own = counter(tokenizer_path)
        for batch in common.slices(batches, 1, 4 << 20):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = own.count(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) if t.isascii() else len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_())],
                ["id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return common.map_rows(rows, run, f"id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean", "token_counts").withColumnRenamed("id", id_col)
