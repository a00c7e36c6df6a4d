"""BPE encoding and decoding by a prefix-sharing trie walk.

The distinct words of a block of texts, in sorted order, are the depth-first order of their trie:
each word keeps the states of the prefix that it shares with the word before and adds states only for
what is new.  The state of a prefix is the last token of its encoding.  A token t that ends at a
prefix is its last token if the last token p of what lies before t stays apart from t, that is if
encoding p and t together gives back p and t.  Following the states from a word's end backwards
gives its encoding.  What a word encodes to is kept for later blocks in a bounded store.

Rules: null text counts as empty and encodes to no ids; strings of special tokens become their ids;
repeated rows give repeated results; other columns are ignored.  Works with vocabularies of the
word kind: white space dropped, lower case, a mark at each word's end.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from loomgraph.llm import common

#: Encoded pieces kept by a worker: two generations of so many.
KEPT = 500_000
#: Characters of the longest piece that is kept from one batch to the next, which bounds the store in bytes too.
LONGEST = 64
#: Control characters that Python's split() takes for white space and the tokenizer's pattern does not.
ODD_SPACE = regex.compile("[\x1c-\x1f]")
#: Letters whose normal form and lower case are alike in every Unicode version; other texts go through the library's normaliser.
PLAIN = regex.compile(r"[\x00-ɏ‐-‧€]*")


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies print for each byte: printable Latin-1 stands for itself, the rest follows from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Sizes to try for a token that ends in an unknown triple of bytes, and what stands for a token that no merge made.
SHORT, NOT_MADE = (2, 1), (-1, -1, -1)


def _sizes(table: dict[str, int]) -> dict[str, tuple[int, ...]]:
    """By the last three bytes of a token: the sizes that such tokens have, longest first, then two and one."""
    found: dict[str, set[int]] = {}
    for token in table:
        if len(token) > 2:
            found.setdefault(token[-3:], set()).add(len(token))
    return {end: (*sorted(sizes, reverse=True), *SHORT) for end, sizes in found.items()}


class Pieces:
    """The normal form of a text and its pieces, by the rules of a vocabulary file."""

    def __init__(self, path: str, spec: dict):
        self.path = path
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"]).findall
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _normal(self, text: str) -> str:
        """The normal form of a text without special tokens, but for the kind of its white space."""
        if not text.isascii():
            if PLAIN.fullmatch(text) and "İ" not in text:
                text = unicodedata.normalize("NFC", text)
            else:
                text = _library(self.path).normalizer.normalize_str(text)
        return text.lower() if "Σ" not in text else text.replace("Σ", "σ").lower()

    def _pieces(self, text: str) -> list[str]:
        """Pieces between white space of a text without special tokens."""
        text = self._normal(text)
        if ODD_SPACE.search(text):
            return [p for p in regex.split(r"[^\S\x1c-\x1f]+", text) if p]
        return text.split()

    def _segments(self, text: str) -> list[str]:
        """Pieces of a raw text; a special token's string is a piece of its own."""
        if self.marks is None or "<|" not in text:
            return self._pieces(text)
        out: list[str] = []
        for part in self.marks.split(text):
            out += [part] if part in self.special else self._pieces(part)
        return out


class TrieBpe(Pieces):
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str, kept: int = KEPT):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        super().__init__(path, spec)
        model, letters = spec["model"], byte_letters()
        self.kept, self.end = kept, model.get("end_of_word_suffix") or ""
        back = {c: b for b, c in letters.items()}
        vocab: dict[str, int] = model["vocab"]
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.printed = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.inner: dict[str, int] = {}
        self.final: dict[str, int] = {}
        for token, i in vocab.items():
            if token in self.special:
                continue
            last = token.endswith(self.end) and len(token) > len(self.end)
            raw = token[: -len(self.end)] if last else token
            if all(c in back for c in raw):
                (self.final if last else self.inner)["".join(chr(back[c]) for c in raw)] = i
        self.letters, self.vocab = [letters[b] for b in range(256)], vocab
        #: Of each merged token: the rank of its merge and its parts; of each pair that merges: the rank.
        self.made, self.joined = {}, {}
        for (x, y), rank in self.rank.items():
            if x in vocab and y in vocab and x + y in vocab:
                self.made.setdefault(vocab[x + y], (rank, vocab[x], vocab[y]))
                self.joined[vocab[x], vocab[y]] = rank
        #: By first token: whether it and a second one stay apart, as far as asked.
        self.apart: list[dict[int, bool] | None] = [None] * (max(vocab.values()) + 1)
        for table in (self.inner, self.final):  # tokens that their own bytes don't encode to never end a prefix
            for raw in [b for b, i in table.items() if len(b) > 1 and self._merge(b, table is self.final) != [i]]:
                del table[raw]
        self.inner_sizes, self.final_sizes = _sizes(self.inner), _sizes(self.final)
        self.young: dict[str, bytes] = {}
        self.long: list[str] = []
        self.old: dict[str, bytes] = {}
        self.decoded = [self.printed.get(i, "").encode() for i in range(max(self.printed) + 1)]

    def _merge(self, raw: str, last: bool) -> list[int]:
        """Plain BPE of a short string: merge the leftmost pair of least rank until none is left."""
        parts = [self.letters[ord(b)] for b in raw]
        if last:
            parts[-1] += self.end
        while len(parts) > 1:
            rank, at = min((self.rank.get((a, b), 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.vocab[p] for p in parts]

    def _stay_apart(self, a: int, b: int) -> bool:
        """Whether encoding the bytes of tokens a and b together gives a and b again: no merge across their border comes before the merges that made them."""
        door = self.apart[a]
        if door is None:
            door = self.apart[a] = {}
        if (known := door.get(b)) is None:
            known = door[b] = not self._crosses(a, b)
        return known

    def _crosses(self, a: int, b: int) -> bool:
        """Undo the merges of a's right edge and b's left edge, latest first; true if the two edges would have merged by then."""
        made, joined = self.made, self.joined
        limit = 1 << 30
        while True:
            if joined.get((a, b), 1 << 30) < limit:
                return True
            (ra, _, right), (rb, left, _) = made.get(a, NOT_MADE), made.get(b, NOT_MADE)
            if ra < 0 and rb < 0:
                return False
            if ra > rb:
                limit, a = ra, right
            else:
                limit, b = rb + 1, left

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Packed ids of distinct words, given as one letter per byte, by the trie walk."""
        token_of, last_of, apart, stay = self.inner.get, self.final.get, self.apart, self._stay_apart
        sizes_of, last_sizes_of = self.inner_sizes.get, self.final_sizes.get
        doors: list[dict[int, bool] | None] = [None]  # of each prefix, what is known of tokens after its last
        states: list[int] = [-1]  # last token of each prefix of the word before
        lengths: list[int] = [0]
        before, out = "", {}
        for word in sorted(words):
            n, shared = len(word), 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            if shared >= n:
                shared = n - 1
            if shared >= len(states):
                shared = len(states) - 1
            del states[shared + 1 :], lengths[shared + 1 :]
            del doors[shared + 1 :]
            for d in range(shared + 1, n):
                for size in sizes_of(word[d - 3 : d], SHORT) if d > 2 else SHORT:
                    start = d - size
                    if start < 0:
                        continue
                    t = token_of(word[start:d])
                    if t is None:
                        continue
                    if start:
                        if (ok := doors[start].get(t)) is None:
                            ok = stay(states[start], t)
                        if not ok:
                            continue
                    states.append(t)
                    lengths.append(size)
                    if (door := apart[t]) is None:
                        door = apart[t] = {}
                    doors.append(door)
                    break
            for size in last_sizes_of(word[n - 3 :], SHORT) if n > 2 else SHORT:
                start = n - size
                if start < 0:
                    continue
                t = last_of(word[start:])
                if t is None:
                    continue
                if start:
                    if (ok := doors[start].get(t)) is None:
                        ok = stay(states[start], t)
                    if not ok:
                        continue
                    ids = [t, states[start]]
                    at = start - lengths[start]
                    while at:
                        ids.append(states[at])
                        at -= lengths[at]
                    ids.reverse()
                    out[word] = array("I", ids).tobytes()
                else:
                    out[word] = array("I", (t,)).tobytes()
                break
            before = word
        return out

    def _learn(self, pieces: set[str]) -> None:
        """Encode pieces not yet in the store."""
        found, old, words, special = self.young, self.old, self.words, self.special
        whole, mixed = [], {}
        for p in pieces.difference(found):
            if (kept := old.get(p)) is not None:
                found[p] = kept
            elif p.isalpha():
                whole.append(p)
            elif p in special:
                found[p] = array("I", [special[p]]).tobytes()
            else:
                mixed[p] = [p[:-1], p[-1]] if p[:-1].isalpha() and p[-1] in ",.!?;:" else words(p)
        needed = set(whole)
        for ws in mixed.values():
            needed.update(ws)
        needed.difference_update(found)
        for w in [w for w in needed if w in old]:
            found[w] = old[w]
            needed.discard(w)
        byte_letters_of = {w if w.isascii() else w.encode().decode("latin-1"): w for w in needed}
        for letters, packed in self.encode_words(byte_letters_of).items():
            found[byte_letters_of[letters]] = packed
        for p, ws in mixed.items():
            found[p] = b"".join([found[w] for w in ws])
        self.long += [w for w in (*needed, *whole, *mixed) if len(w) > LONGEST]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        needed: set[str] = set()
        split = []
        for s in map(self._segments, texts):
            needed.update(s)
            if self.kept >= KEPT:  # else split twice: the pieces of all texts together take many times the texts' memory
                split.append(s)
        if len(self.young) + len(needed) > self.kept:
            self.old, self.young = self.young, {}
        self._learn(needed)
        get = self.young.__getitem__
        out = [b"".join(map(get, s)) for s in split or map(self._segments, texts)]
        for p in self.long:
            self.young.pop(p, None)
        self.long.clear()
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids in UTF-8: the vocabulary's own strings, special ones too, joined by single spaces."""
        return b" ".join(map(self.decoded.__getitem__, ids.tolist()))


@lru_cache(4)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(4)
def coder(path: str, kept: int = KEPT) -> TrieBpe:
    """The worker's coder of a vocabulary file."""
    return TrieBpe(path, kept)


common.HELD["bpe"] = coder.cache_clear


def encoded(path: str, batches: Iterable[pa.RecordBatch], kept: int = KEPT) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """For batches of (key, text): each with the packed ids of its texts."""
    own = coder(path, kept)
    for batch in common.slices(batches, 1, 4 << 20):
        yield batch, own.encode([t or "" for t in batch.column(1).to_pylist()])


def _as_lists(packed: list[bytes]) -> pa.Array:
    sizes = np.fromiter((len(p) // 4 for p in packed), dtype=np.int64, count=len(packed))
    offsets = np.zeros(len(packed) + 1, dtype=np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), dtype="<u4").astype(np.int32)))


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every text."""

    def run(batches):
        for batch, packed in encoded(tokenizer_path, batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), _as_lists(packed)], ["id", "ids"])

    return common.map_rows(docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")), run, f"id {docs.schema[id_col].dataType.simpleString()}, ids array<int>", "bpe").withColumnRenamed("id", id_col)


def decode(encodings: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of every list of ids; null ids give an empty text."""

    def run(batches):
        own = coder(tokenizer_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(np.array(x or [], dtype=np.int64)).decode() for x in batch.column(1).to_pylist()], pa.string())], ["id", "text"])

    return common.map_rows(encodings.select(encodings[id_col].alias("id"), encodings[ids_col].alias("ids")), run, f"id {encodings.schema[id_col].dataType.simpleString()}, text string", "bpe").withColumnRenamed("id", id_col)


def encode_and(docs: DataFrame, tokenizer_path: str, derive: Callable, schema: str, id_col: str = "doc_id", text_col: str = "text", kept: int = KEPT) -> DataFrame:
    """Encode every text and hand (coder, batch, packed ids) to derive in the same task, for results smaller than the ids; kept: pieces that a worker keeps, which costs memory and saves time; with fewer than KEPT those of a batch are not held together either."""

    def run(batches):
        for batch, packed in encoded(tokenizer_path, batches, kept):
            yield from derive(coder(tokenizer_path, kept), batch, packed)

    return common.map_rows(docs.select(docs[id_col].alias(id_col), docs[text_col].cast("string").alias("text")), run, schema, "bpe")
