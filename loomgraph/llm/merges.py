"""BPE of a batch's distinct words all at once: one merge a word and round, in NumPy.

Words lie in columns, one a place, longest first: those of width w are the words of w bytes and what is left of
longer ones after a merge.  A round finds each word's leftmost pair of least rank, merges it and so leaves the word to
the next width; a word without a pair that merges is done.  Only the two pairs beside a merge are looked up anew.
Nothing is kept from one batch to the next, so what a worker holds follows the batch and not the vocabulary of the texts.

Rules: as in bpe, whose normal form and pieces are taken; words of over WIDE bytes go to the library.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from loomgraph.llm import bpe, common

#: Bytes of the longest word that is merged in columns.
WIDE = 64
#: Rank of a pair that does not merge.
NEVER = np.int32((1 << 31) - 1)
#: Kinds of bytes: letters, digits and marks of ASCII; a piece with any other byte, an apostrophe or "<", with which special tokens begin, is split by the tokenizer's pattern.
LETTER, DIGIT, MARK, ODD = range(4)
KIND = np.full(256, ODD, dtype=np.uint8)
KIND[33:127] = MARK
KIND[[*b"'<"]] = ODD
KIND[[*b"0123456789"]] = DIGIT
KIND[[c for c in range(128) if chr(c).isalpha()]] = LETTER
_ODD, _FREE = np.uint64(0x9E3779B97F4A7C15), np.uint64((1 << 64) - 1)


class Pairs:
    """Ranks of pairs of tokens: a hash table with open addressing, a quarter full at most."""

    def __init__(self, ranks: dict[tuple[int, int], int]):
        bits = max(4, (4 * len(ranks)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(1 << bits, _FREE), np.full(1 << bits, NEVER)
        pairs = np.array([*ranks], dtype=np.uint64).reshape(-1, 2)
        keys = self._key(pairs[:, 0], pairs[:, 1])
        for key, at, rank in zip(keys, self._home(keys).tolist(), ranks.values()):
            while self.keys[at] != _FREE:
                at = (at + 1) & self.last
            self.keys[at], self.ranks[at] = key, rank

    def _key(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _ODD) >> self.shift).astype(np.int64)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, or NEVER."""
        keys = self._key(a, b)
        at = self._home(keys)
        there = self.keys[at]
        found = np.where(there == keys, self.ranks[at], NEVER)
        left = np.flatnonzero((there != keys) & (there != _FREE))
        while left.size:
            at[left] = (at[left] + 1) & self.last
            there = self.keys[at[left]]
            same = there == keys[left]
            found[left[same]] = self.ranks[at[left[same]]]
            left = left[~same & (there != _FREE)]
        return found


class MergeBpe(bpe.Pieces):
    """Encoder for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        super().__init__(path, spec)
        model, letters = spec["model"], bpe.byte_letters()
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.inner = np.array([vocab[letters[b]] for b in range(256)], dtype=np.int32)
        self.final = np.array([vocab[letters[b] + end] for b in range(256)], dtype=np.int32)
        ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.pairs = Pairs({(vocab[x], vocab[y]): rank for (x, y), rank in ranks.items()})
        self.made = np.zeros(len(model["merges"]), dtype=np.int32)
        for (x, y), rank in ranks.items():
            self.made[rank] = vocab[x + y]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = self._split(texts)
        if not split:
            return []
        ends = np.cumsum(np.concatenate([s.value_lengths().to_numpy() for s in split])).tolist()
        pieces = pa.concat_arrays([s.flatten() for s in split]).dictionary_encode()
        ids, start, n = self._of_pieces(pieces.dictionary)
        at = pieces.indices.to_numpy()
        return [_gather(ids, start, n, at[a:b]).tobytes() for a, b in zip([0, *ends], ends)]

    def _split(self, texts: list[str]) -> list[pa.ListArray]:
        """The pieces of each text, in several arrays of lists; an empty piece has no ids."""
        out, plain = [], []
        for text in texts:
            if (self.marks is not None and "<|" in text) or bpe.ODD_SPACE.search(text):
                if plain:
                    out.append(pc.utf8_split_whitespace(pa.array(plain, pa.large_string())))
                    plain = []
                out.append(pa.array([self._segments(text)], pa.list_(pa.large_string())))
            else:
                plain.append(self._normal(text))
        return [*out, pc.utf8_split_whitespace(pa.array(plain, pa.large_string()))] if plain else out

    def _of_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct pieces: all one after another, where each piece's start, and how many they are."""
        offsets, data = _bytes(pieces)
        odd = np.concatenate([[0], np.cumsum(KIND[data] == ODD, dtype=np.int64)])
        odd = odd[offsets[1:]] > odd[offsets[:-1]]
        plain, others = pieces.filter(pa.array(~odd)), pieces.filter(pa.array(odd)).to_pylist()
        offsets, data = _bytes(plain)
        kind = KIND[data]
        begins = np.empty(len(data), dtype=bool)
        begins[:1] = True
        np.not_equal(kind[1:], kind[:-1], out=begins[1:])
        begins |= kind == DIGIT
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        begins = np.flatnonzero(begins)
        many = [np.diff(np.searchsorted(begins, offsets))]
        words = [pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(np.append(begins, len(data))), pa.py_buffer(data))]
        rest = [self._words_of(p) for p in others]
        words.append(pa.array([w for ws in rest for w in ws], pa.large_string()))
        many.append(np.fromiter(map(len, rest), dtype=np.int64, count=len(rest)))
        words = pa.concat_arrays(words).dictionary_encode()
        ids, start, n = self._of_words(words.dictionary)
        at, order = words.indices.to_numpy(), np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])
        upto = np.concatenate([[0], np.cumsum(n[at])])[np.concatenate([[0], np.cumsum(np.concatenate(many))])]
        first, size = np.empty_like(order), np.empty_like(order)
        first[order], size[order] = upto[:-1], np.diff(upto)
        return _gather(ids, start, n, at), first, size

    def _words_of(self, piece: str) -> list[str]:
        """The words of a piece by the tokenizer's pattern; a special token's string is one."""
        return [piece] if piece.isalpha() or piece in self.special else self.words(piece)

    def _of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As _of_pieces, of distinct words."""
        offsets, data = _bytes(words)
        alone = np.diff(offsets) > WIDE
        for special in self.special:
            if (i := pc.index(words, pa.scalar(special, words.type)).as_py()) >= 0:
                alone[i] = True
        n, parts = np.zeros(len(words), dtype=np.int64), []
        for who, tokens in self._rounds(np.flatnonzero(~alone), offsets, data):
            n[who] = len(tokens)
            parts.append((who, tokens))
        for i in np.flatnonzero(alone).tolist():
            word = words[i].as_py()
            own = [self.special[word]] if word in self.special else _library(self.path).encode(word, add_special_tokens=False).ids
            n[i] = len(own)
            parts.append((i, own))
        start = np.cumsum(n) - n
        ids = np.empty(int(n.sum()), dtype="<u4")
        for who, tokens in parts:
            if isinstance(who, int):
                ids[start[who] : start[who] + n[who]] = tokens
                continue
            for k, t in enumerate(tokens):
                ids[start[who] + k] = t
        return ids, start, n

    def _rounds(self, words: np.ndarray, offsets: np.ndarray, data: np.ndarray) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        """Merge these words of data, and give those that are done, each time all of one width, with their tokens by place."""
        size = offsets[words + 1] - offsets[words]
        order = np.argsort(size, kind="stable")
        bounds = np.searchsorted(size[order], np.arange(1, WIDE + 2))
        who, tokens, ranks = words[:0], None, None
        for width in range(int(size.max(initial=0)), 0, -1):
            new = words[order[bounds[width - 1] : bounds[width]]]
            first = offsets[new]
            fresh = [self.inner[data[first + k]] for k in range(width - 1)] + [self.final[data[first + width - 1]]]
            fresh_ranks = [self.pairs.of(x, y) for x, y in zip(fresh, fresh[1:])]
            if len(who):
                fresh = [np.concatenate(both) for both in zip(tokens, fresh)]
                fresh_ranks = [np.concatenate(both) for both in zip(ranks, fresh_ranks)]
            who, tokens, ranks = np.concatenate([who, new]), fresh, fresh_ranks
            least, place = np.full(len(who), NEVER), np.zeros(len(who), dtype=np.int8)
            for k, rank in enumerate(ranks):  # the leftmost of equal ones
                np.copyto(place, k, where=rank < least)
                np.minimum(least, rank, out=least)
            more = least < NEVER
            if not more.all():
                over = ~more
                yield who[over], [t[over] for t in tokens]
                who, place, least = who[more], place[more], least[more]
                tokens, ranks = [t[more] for t in tokens], [r[more] for r in ranks]
            if len(who):
                made = self.made[least]
                tokens = [np.where(place > k, tokens[k], np.where(place == k, made, tokens[k + 1])) for k in range(width - 1)]
                ranks = [np.where(place > k, ranks[k], ranks[k + 1]) for k in range(width - 2)]
                for k, rank in enumerate(ranks):  # a pair is new where one of its two was just made
                    at = np.flatnonzero((place == k) | (place == k + 1))
                    rank[at] = self.pairs.of(tokens[k][at], tokens[k + 1][at])


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a column of large strings without nulls."""
    if not len(column):
        return np.zeros(1, dtype=np.int64), np.empty(0, dtype=np.uint8)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data else np.empty(0, dtype=np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def _gather(ids: np.ndarray, start: np.ndarray, n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The ids of the entries at, one after another."""
    many = n[at]
    ends = np.cumsum(many)
    where = np.repeat(start[at] - ends + many, many)
    where += np.arange(len(where))
    return ids[where]


@lru_cache(4)
def _library(path: str):
    """The library's model without its normaliser and splitting, for single words."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    split = spec["pre_tokenizer"]
    split["pretokenizers"] = [p for p in split["pretokenizers"] if p["type"] != "Split"]
    return Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "added_tokens": []}))


@lru_cache(4)
def coder(path: str) -> MergeBpe:
    """The worker's coder of a vocabulary file."""
    return MergeBpe(path)


def _let_go() -> None:
    coder.cache_clear()
    _library.cache_clear()


common.HELD["merges"] = _let_go
