"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A text's fingerprint has 64 bits; a bit is set if over half of the text's shingle hashes set it.  Two
fingerprints link if at most 3 bits differ.  The bits are cut into three blocks: of 3 differing bits at
least one lies in some block, so without that block at most 2 differ.  Each fingerprint therefore emits, for each
left-out block, all variants of the other bits within half of that radius, one flipped bit at most (132 to a
fingerprint).  Two fingerprints that differ in 2 bits there meet at the variant between them; the shuffle
brings equal variants together, and what meets is deduplicated and verified on all 64 bits.

Texts with equal fingerprints are one node, so groups of copies cost no pairs.  A variant that two
fingerprints share is read off its minimum and maximum; where more meet, the members are compared in
blocks within the task and only the links of a spanning forest leave it.

classes() are those of the links; duplicates() adds the links of texts whose shingles are alike, however far apart their
fingerprints are.

Rules: null counts as empty; a text without words has fingerprint zero and links like any other; fewer
words than a shingle: the whole sequence is the one shingle; only A-Z are lower-cased; repeated ids keep a row
each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import common
from loomgraph.llm.components import components

RADIUS, SEED = 3, 42
#: The blocks of bits, one of which is left out at a time: (first bit, size).
BLOCKS = ((0, 22), (22, 21), (43, 21))
#: Members of a variant that are compared at once.
BLOCK_ROWS = 2048
#: For similar(): words of a shingle, and bits of 256 that may differ before the shingles are compared: in two texts alike
#: to 0.8 about 39 differ, 48 at worst in very short ones, and over 96 with a chance below 1e-11.
SHINGLE, LOOSE = 5, 96
#: Texts and bytes of text that are compared in one task.
GROUP_ROWS, GROUP_BYTES = 4096, 16 << 20
#: Texts that show which shingles are common (these and a share of all), how often such a shingle is seen, and how many
#: are kept.  They decide the order of shingles only: links are the same for every order.
SHOWN, SHARE, SEEN, COMMON = 8192, 1 / 64, 3, 1 << 17
#: Fixed value: the odd multiplier of a common 64-bit mixer.
MIX = 0xBF58476D1CE4E5B9


def fingerprint(text: bytes, words: int) -> int:
    """The fingerprint as a signed 64-bit integer."""
    parts = text.lower().split()
    if not parts:
        return 0
    joined, ends, at = b" ".join(parts), [], -1
    for n in map(len, parts):
        at += n + 1
        ends.append(at)
    if len(parts) <= words:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        digest = xxhash.xxh64_intdigest
        starts = [0, *(e + 1 for e in ends[: len(parts) - words])]
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :])]
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, t long, fp long) of every text; t as in text_hash()."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([fingerprint(t or b"", words) for t in batch.column(2).to_pylist()], pa.int64())], ["id", "t", "fp"])

    rows = docs.select(docs[id_col].alias("id"), text_hash(docs, text_col).alias("t"), docs[text_col].cast("string").cast("binary").alias("text"))
    return common.map_rows(rows, run, f"id {docs.schema[id_col].dataType.simpleString()}, t long, fp long")


def text_hash(docs: DataFrame, text_col: str) -> Column:
    """Tells rows of one id apart."""
    return F.xxhash64(docs[text_col].cast("string"))


def _variants(fp: Column) -> Column:
    """Keys of all variants: for each left-out block, the other bits as they are and with each one flipped."""
    keys = []
    for k, (first, size) in enumerate(BLOCKS):
        left_out = ((1 << size) - 1) << first
        kept = _signed(~left_out & (1 << 64) - 1)
        flips = F.lit([0, *(_signed(1 << b) for b in range(64) if not left_out >> b & 1)])
        keys.append(F.transform(flips, _flipper(k, fp.bitwiseAND(F.lit(kept)))))
    return F.concat(*keys)


def _flipper(k: int, bits: Column):
    return lambda flip: F.xxhash64(F.lit(k), bits.bitwiseXOR(flip))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(nodes: np.ndarray, bits: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Links of a spanning forest of the members of one variant, compared block by block; bits: a row of 64-bit words for each member."""
    nodes, first = np.unique(nodes, return_index=True)
    bits = bits[first].view(np.uint64)
    root = np.arange(len(nodes))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(0, len(nodes), BLOCK_ROWS):
        for j in range(i, len(nodes), BLOCK_ROWS):
            apart = np.zeros((min(BLOCK_ROWS, len(nodes) - i), min(BLOCK_ROWS, len(nodes) - j)), dtype=np.int16)
            for k in range(bits.shape[1]):
                apart += np.bitwise_count(bits[i : i + BLOCK_ROWS, None, k] ^ bits[None, j : j + BLOCK_ROWS, k])
            for a, b in zip(*np.nonzero(apart <= radius)):
                a, b = i + int(a), j + int(b)
                if a < b and (x := find(a)) != (y := find(b)):
                    root[y] = x
                    yield int(nodes[a]), int(nodes[b])


def _loose_forest(nodes: np.ndarray, bits: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """As _forest(), for members most of which link: a search from member to member that drops whoever it reached."""
    nodes, first = np.unique(nodes, return_index=True)
    bits = bits[first].view(np.uint64)
    left, queue = np.arange(len(nodes)), []
    while len(left):
        if not queue:
            queue, left = [left[0]], left[1:]
        x = queue.pop()
        near = np.bitwise_count(bits[left] ^ bits[x]).sum(axis=1, dtype=np.int64) <= radius
        yield from ((int(nodes[x]), int(nodes[y])) for y in left[near])
        queue.extend(left[near])
        left = left[~near]


def _crowded(radius: int, forest=_forest):
    """For rows (key, node, bits array) that come sorted by key: the links among the members of each key."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def linked(key: np.ndarray, node: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(np.diff(key)) + 1
        found = [x for members, words in zip(np.split(node, at), np.split(bits, at)) for x in forest(members, words, radius)]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # parts of the last key's rows and of whole keys before it

        def flush() -> pa.RecordBatch:
            rows = tuple(np.concatenate(x) for x in zip(*held))
            held.clear()
            return linked(*rows)

        for batch in batches:
            if not batch.num_rows:
                continue
            new = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
            if held and held[-1][0][-1] != new[0][0]:
                yield flush()
            whole = int(np.searchsorted(new[0], new[0][-1]))
            if whole:
                held.append(tuple(x[:whole] for x in new))
                yield flush()
            held.append(tuple(x[whole:] for x in new))
        if held:
            yield flush()

    return run


def _meetings(nodes: DataFrame, variants: Column) -> tuple[DataFrame, DataFrame]:
    """From rows with column node: (a, b) of the variants that two nodes share, and (key, node) of those that more share.

    Both read one shuffle of the variants; only a variant's minimum, maximum, count and a mix of its nodes are kept
    of it.  Variants that the same nodes share would compare the same pairs: one of them stays.
    """
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = nodes.select("node", F.explode(variants).alias("key")).repartition(n, "key")
    seen = met.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("mix")).where("a <> b")
    kept = seen.where("n > 2").groupBy("a", "b", "n", "mix").agg(F.min("key").alias("key")).select("key")
    many = met.join(kept.hint("shuffle_hash"), "key", "left_semi").select("key", "node")
    return seen.where("n = 2").select("a", "b"), many


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links that join all fingerprints within RADIUS of each other; fps: distinct fingerprints in column fp."""
    two, many = _meetings(fps.select(F.col("fp").alias("node")), _variants(F.col("node")))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS
    crowded = many.select("key", "node", F.array("node").alias("bits")).sortWithinPartitions("key")
    return two.where(near).distinct().unionByName(common.map_rows(crowded, _crowded(RADIUS), "a long, b long").distinct())


def classes(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, t, fp, component, root): the component is the smallest id that links reach, root a number that no other class has.  Null ids count as the largest."""
    return _classes(common.cut(fingerprints(docs, words, id_col, text_col), "fingerprints"))


def _classes(own: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """classes() of rows (id, t, fp); more: further links (a, b) between their fingerprints."""
    copies = common.cut(own.groupBy("fp").agg(F.min("id").alias("first")), "copies")
    near = links(copies.select("fp"))
    roots = common.cut(components(near if more is None else near.unionByName(more)), "roots")
    named = roots.join(copies, roots.node == copies.fp).select("root", "fp", "first")
    least = named.groupBy("root").agg(F.min("first").alias("component"))
    joined = named.join(least, "root").select("fp", "component", "root")
    found = copies.join(joined, "fp", "left").select("fp", F.coalesce("component", "first").alias("component"), F.coalesce("root", "fp").alias("root"))
    return common.join_hot(own, found, ["fp"]).select("id", "t", "fp", "component", "root")


def _spread(h: np.ndarray, words: int) -> np.ndarray:
    """Majority bits of hashes, 64 for each word, from as many mixes of every hash."""
    out = []
    for k in range(words):
        x = (h + np.uint64(k * MIX & (1 << 64) - 1)) * np.uint64(MIX)
        x ^= x >> np.uint64(29)
        x *= np.uint64(MIX)
        x ^= x >> np.uint64(32)
        bits = np.unpackbits(x.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
        out.append(2 * bits > len(h))
    return np.concatenate(out)


def shingled(text: bytes) -> tuple[int, np.ndarray]:
    """A hash of the word sequence, and the sorted hashes of the distinct shingles of SHINGLE words."""
    parts = text.lower().split()
    joined = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    own = _signed(digest(joined, SEED))
    if not parts:
        return own, np.empty(0, np.uint64)
    ends, at = [], -1
    for n in map(len, parts):
        at += n + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[: max(0, len(parts) - SHINGLE)])]
    return own, np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[min(SHINGLE, len(parts)) - 1 :])], dtype=np.uint64))


def prefix(shingles: np.ndarray, common_ones: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The shingles that come first in one order of all shingles, rare before common: so many that a set alike to 0.8 or more must have one of them first too.

    Two sets of sizes n and m that are alike to 0.8 share ceil(0.8 n) and ceil(0.8 m) shingles at least.  The first
    shared one in the order has as many shared ones behind it, so it is among the first n - ceil(0.8 n) + 1 of n.
    """
    times = np.zeros(len(shingles), dtype=np.int64)
    if len(common_ones):
        at = np.minimum(np.searchsorted(common_ones, shingles), len(common_ones) - 1)
        times = np.where(common_ones[at] == shingles, seen[at], 0)
    n = len(shingles)
    return shingles[np.lexsort((shingles, times))[: n - (4 * n + 4) // 5 + 1]] if n else shingles


def _common_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that are common among some of the texts, and how often they were seen; texts: (id, t, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(2).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingled(text or b"")[1].view(np.int64))], ["s"])

    share = min(1.0, max(SHARE, SHOWN / max(1, texts.count())))
    counted = common.map_rows(texts.sample(share, 5), run, "s long").groupBy("s").count().where(F.col("count") >= SEEN)
    rows = counted.orderBy(F.desc("count"), "s").limit(COMMON).collect()
    shingles = np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], np.array([r[1] for r in rows], dtype=np.int64)[order]


def _signatures(docs: DataFrame, words: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of every text (id, t, text), then (id, t, h, fp, keys, bits), then of every node (node, fp, first, t, keys, bits).

    Texts of the same words are one node, named by h, a 64-bit hash of them; fp, keys and bits follow from the words.  fp:
    the fingerprint of as many words; keys: the prefix of the shingles; bits: their majority bits.
    """
    rows = docs.select(docs[id_col].alias("id"), text_hash(docs, text_col).alias("t"), docs[text_col].cast("string").cast("binary").alias("text"))
    order = _common_shingles(rows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, fps, keys, bits = [], [], [], []
            for text in batch.column(2).to_pylist():
                h, shingles = shingled(text or b"")
                own.append(h)
                fps.append(fingerprint(text or b"", words))
                keys.append(prefix(shingles, *order).view(np.int64))
                bits.append(np.packbits(_spread(shingles, 4), bitorder="little").view("<i8").tolist() if len(shingles) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (own, fps)), *(pa.array(x, pa.list_(pa.int64())) for x in (keys, bits))], ["id", "t", "h", "fp", "keys", "bits"])

    key = docs.schema[id_col].dataType.simpleString()
    own = common.cut(common.map_rows(rows, run, f"id {key}, t long, h long, fp long, keys array<long>, bits array<long>"), "signatures")
    # one text of the node is named
    nodes = own.groupBy(F.col("h").alias("node")).agg(F.min("id").alias("first"), F.min_by(F.struct("t", "fp", "keys", "bits"), F.struct(F.col("id").isNull(), "id", "t")).alias("x"))
    return rows, own, common.cut(nodes.select("node", "x.fp", "first", "x.t", "x.keys", "x.bits"), "texts")


def _loose_groups(nodes: DataFrame) -> DataFrame:
    """(node, fp, id, t, g): groups of nodes that no two nodes alike to 0.8 or more are apart in; nodes as in _signatures().

    Texts that are so alike share a shingle of their prefixes, so the shuffle brings every such pair together; pairs with
    more than LOOSE of 256 majority bits apart are left out.
    """
    worded = nodes.where(F.size("bits") > 0)
    two, many = _meetings(worded, F.col("keys"))
    bits = worded.select("node", "bits")
    pairs = two.distinct().join(bits.select(F.col("node").alias("a"), F.col("bits").alias("x")), "a").join(bits.select(F.col("node").alias("b"), F.col("bits").alias("y")), "b")
    apart = sum((F.bit_count(F.col("x")[k].bitwiseXOR(F.col("y")[k])) for k in range(1, 4)), F.bit_count(F.col("x")[0].bitwiseXOR(F.col("y")[0])))
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    crowded = many.join(bits, "node").select("key", "node", "bits").repartition(n, "key").sortWithinPartitions("key")
    loose = pairs.where(apart <= LOOSE).select("a", "b").unionByName(common.map_rows(crowded, _crowded(LOOSE, _loose_forest), "a long, b long").distinct())
    return common.cut(components(loose).join(nodes.select("node", "fp", "first", "t"), "node").select("node", "fp", F.col("first").alias("id"), "t", F.col("root").alias("g")), "groups")


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, t, component, root) of every text, by SHINGLE-word shingles alike to 0.8 or more: component is the smallest id of the class, root a number that no other class has; t as in text_hash().

    Texts whose prefixes meet and whose majority bits are near are a group, and the texts of a group are compared by
    their shingles: exact_links() decides.
    Null counts as empty; texts without words are one class; rows of one id are told apart by t; null ids are never the smallest.
    """
    rows, own, nodes = _signatures(docs, 3, id_col, text_col)
    roots = common.cut(components(exact_links(_loose_groups(nodes), rows)), "roots")
    named = common.cut(nodes.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")), "named")
    least = named.groupBy("root").agg(F.min("first").alias("component"))
    classes_ = named.join(least, "root").select(F.col("node").alias("h"), "component", "root")
    return common.join_hot(own.select("id", "t", "h"), classes_, ["h"]).select("id", "t", "component", "root")


def duplicates(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, t, fp, component, root) as classes(), whose links are all in it, and those of similar() too.

    Two texts are of one class if links of either kind lead from one to the other.  Texts of one fingerprint are one
    node already, so a link of similar() is one between the fingerprints of its texts.
    """
    rows, own, nodes = _signatures(docs, words, id_col, text_col)
    groups = _loose_groups(nodes)
    fps = groups.select("node", "fp")
    alike = exact_links(groups, rows).join(fps.toDF("a", "x"), "a").join(fps.toDF("b", "y"), "b").where("x <> y")
    return _classes(own.select("id", "t", "fp"), alike.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())


def exact_links(groups: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): links that join, within each group, all nodes whose shingle sets have a Jaccard similarity of 0.8 or more.

    groups: (node, id, t, g), texts: (id, t, text); the text of a node is one of its id and t.  A group too
    large for a task is cut into parts, and every two parts are compared in a task of their own.
    """
    n = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = common.maybe_broadcast(groups, 40)
    sized = texts.join(asked, texts["id"].eqNullSafe(asked["id"]) & (texts["t"] == asked["t"])).select("g", "node", "text", F.coalesce(F.length("text"), F.lit(0)).alias("bytes"))
    held = common.cut(sized, "grouped")
    parts = held.groupBy("g").agg(F.greatest(F.ceil(F.count("*") / GROUP_ROWS), F.ceil(F.sum("bytes") / GROUP_BYTES)).cast("int").alias("parts")).where("parts > 1")
    large = common.cut(parts, "parts")
    few = common.maybe_broadcast(large, 16)
    whole = held.join(common.maybe_broadcast(large.select("g"), 16), "g", "left_anti").select(F.xxhash64("g").alias("key"), "g", F.lit(0).alias("i"), F.lit(0).alias("j"), "node", "text")
    mine = held.join(few, "g").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: k != F.col("mine"))
    dealt = mine.select("g", F.col("mine"), "node", "text", F.explode(others).alias("other")).select(F.xxhash64("g", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), "g", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "node", "text")
    together = whole.unionByName(dealt).repartition(n, "key").sortWithinPartitions("key", "g", "i", "j").select("g", "i", "j", "node", "text")
    return common.map_rows(together, _compared, "a long, b long").distinct()


def _compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a spanning forest of each run of rows (g, i, j, node, text) with equal g, i and j; repeated nodes count once."""
    last, sets = None, {}

    def linked() -> pa.RecordBatch:
        found = list(_alike(list(sets), list(sets.values())))
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    for batch in batches:
        g, i, j, node, text = (batch.column(k) for k in range(5))
        for *key, name, t in zip(g.to_pylist(), i.to_pylist(), j.to_pylist(), node.to_pylist(), text.to_pylist()):
            if key != last:
                if len(sets) > 1:
                    yield linked()
                last, sets = key, {}
            if name not in sets:
                sets[name] = shingled(t or b"")[1]
    if len(sets) > 1:
        yield linked()


def _alike(nodes: list[int], sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """A spanning forest of the nodes whose sets are alike to 0.8 or more, searched from node to node; whoever was reached is dropped."""
    order = sorted(range(len(sets)), key=lambda k: len(sets[k]))
    sizes = np.array([len(sets[k]) for k in order])
    words, flat = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)
    codes = np.split(flat, np.cumsum(sizes)[:-1])
    mark = np.zeros(len(words), dtype=np.int32)
    left = np.arange(len(order))
    starts, queue = np.cumsum(sizes) - sizes, []

    def keep(stay: np.ndarray) -> None:
        nonlocal left, flat, starts
        flat = flat[np.repeat(stay, sizes[left])]
        left = left[stay]
        starts = np.cumsum(sizes[left]) - sizes[left]

    while len(left):
        if not queue:
            queue = [int(left[0])]
            keep(left != left[0])
            continue
        x = queue.pop()
        # alike sets differ in size by a fifth at most
        first, end = np.searchsorted(5 * sizes[left], 4 * sizes[x]), np.searchsorted(4 * sizes[left], 5 * sizes[x], side="right")
        if first == end:
            continue
        begin, stop = starts[first], starts[end - 1] + sizes[left[end - 1]]
        mark[codes[x]] = 1
        shared = np.add.reduceat(mark[flat[begin:stop]], starts[first:end] - begin)
        mark[codes[x]] = 0
        near = np.flatnonzero(9 * shared >= 4 * (sizes[x] + sizes[left[first:end]])) + first
        if len(near):
            reached = left[near]
            yield from ((nodes[order[x]], nodes[order[y]]) for y in reached)
            queue.extend(reached.tolist())
            stay = np.ones(len(left), dtype=bool)
            stay[near] = False
            keep(stay)


def survivors(found: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class of found (id, t, root): the one with the smallest id, and of rows that repeat that id the one
    with the smallest t; of rows that repeat both any one.  Rows without an id stay only where their class has no other.

    Only the rows that go are joined to the texts; where they are few by count they are broadcast.
    """
    own = common.cut(found.select("id", "t", "root"), "classes")
    first = own.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "t")).alias("x")).select("root", F.col("x.id").alias("first"), F.col("x.t").alias("one"))
    marked = common.cut(common.join_hot(own, first, ["root"]).select("id", "t", (F.col("id").eqNullSafe(F.col("first")) & (F.col("t") == F.col("one"))).alias("stays")), "marked")
    row = docs[id_col].eqNullSafe(F.col("__id")) & (text_hash(docs, text_col) == F.col("__t"))
    gone = marked.where("not stays").select(F.col("id").alias("__id"), F.col("t").alias("__t")).distinct()
    kept = docs.join(common.maybe_broadcast(gone, 24), row, "left_anti")
    repeated = marked.where("stays").groupBy("id", "t").count().where("count > 1").select(F.col("id").alias("__id"), F.col("t").alias("__t"))
    if not repeated.take(1):
        return kept
    hint = common.maybe_broadcast(common.cut(repeated, "repeated"), 24)
    once = kept.join(hint, row, "left_semi").dropDuplicates([id_col, text_col])
    return kept.join(hint, row, "left_anti").unionByName(once)
