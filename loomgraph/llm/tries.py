"""Prefix trie of conversations: a double array in every prefix shard.

Nodes of the trie are the distinct beginnings of conversations.  Conversations of equal turns are one weighted
sequence.  Sequences are dealt into shards by a prefix: by the first turn, or where more than SHARD_TURNS turns share
a prefix of D turns, by one of 2 D turns, and so on; so a shard is bounded whatever beginning a third of all
conversations share.  A shard numbers its turns densely, packs BASE and CHECK arrays over these numbers, walks every
sequence through them and sums each node.  Nodes at the shard's depth or below lie in one shard only and are
complete there.  Nodes above it are shared: their parts are merged by the hash of their prefix over all shards, and what
lies below them is summed up the merged upper tree by pointer doubling, in as many rounds as its depth has bits.

Rules: turns are ordered by turn (null first), then by role and by a hash of the text; null role and text are
empty; rows without conv_id take no part; repeated rows are turns of their own; other columns are ignored; an empty
table gives no node.  A conversation's turns are held in one task, 16 bytes and a length each, texts are not: they
are hashed (128 bits of SHA-256 over role and text) where they are read.  The ids that end at one node are hashed
in order by one task, which reads them as sorted chunks and holds one of these.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import common
from loomgraph.session import ship

#: Turns of a shard, ids of a chunk, free slots that a node with several children tries before it takes new ones.
SHARD_TURNS, CHUNK_IDS, TRIES = 32768, 4096, 16
#: Bytes that stand for a turn.
WIDTH = 16
FREE, TOP = -1, -2
NO_ENDS = hashlib.sha256(b"").hexdigest()
#: Kinds of rows that a shard gives: complete nodes, complete nodes whose parent is shared, parts of shared nodes.
CLOSED, OPEN, SHARED = 0, 1, 2
NODES = "kind int, key binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, n_bytes long, ends_sha256 string"


class DoubleArray:
    """Trie of sequences of codes from 1 on: node s has a child by code c at t = base[s] + c if check[t] == s.  Slot 0 is the root.

    flat holds the codes of all sequences, one after the other, sizes their lengths.
    """

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.base, self.check = np.zeros(1024, np.int64), np.full(1024, FREE, np.int64)
        self.check[0], self.end = TOP, 1
        self.pool: list[np.ndarray] = []  # slots below end that were free when they were put here
        starts, at = np.cumsum(sizes) - sizes, np.zeros(len(sizes), np.int64)
        live, depth = np.flatnonzero(sizes > 0), 0
        while len(live):
            code = flat[starts[live] + depth]
            order = np.lexsort((code, at[live]))
            p, c = at[live][order], code[order]
            new = np.r_[True, (p[1:] != p[:-1]) | (c[1:] != c[:-1])]
            self._place(p[new], c[new])
            at[live] = self.base[at[live]] + code
            depth += 1
            live = live[sizes[live] > depth]

    def _reach(self, end: int) -> None:
        """Make slots up to end known; those that were not are free."""
        if end > len(self.check):
            more = max(end, 2 * len(self.check)) - len(self.check)
            self.base, self.check = np.r_[self.base, np.zeros(more, np.int64)], np.r_[self.check, np.full(more, FREE, np.int64)]
        if end > self.end:
            self.pool.append(np.arange(self.end, end))
            self.end = end

    def _free(self, n: int) -> np.ndarray:
        """The first n free slots of the pool, or fewer; they stay in the pool."""
        found, have = [], 0
        while self.pool and have < n:
            some = self.pool.pop()
            some = some[self.check[some] == FREE]
            found, have = [*found, some], have + len(some)
        slots = np.concatenate(found) if found else np.empty(0, np.int64)
        if len(slots):
            self.pool.append(slots)
        return slots[:n]

    def _place(self, parents: np.ndarray, codes: np.ndarray) -> None:
        """Children by these codes, which come sorted by parent and code."""
        first = np.flatnonzero(np.r_[True, parents[1:] != parents[:-1]])
        count = np.diff(np.r_[first, len(parents)])
        for a, n in zip(first[count > 1], count[count > 1]):
            own = codes[a : a + n]
            steps = own - own[0]
            for slot in [*self._free(TRIES), self.end]:
                self._reach(slot + steps[-1] + 1)
                if (self.check[slot + steps] == FREE).all():
                    break
            self.base[parents[a]] = slot - own[0]
            self.check[slot + steps] = parents[a]
        alone = first[count == 1]
        if len(alone):
            slots = self._free(len(alone))
            if len(slots) < len(alone):
                self._reach(self.end + len(alone) - len(slots))
                slots = self._free(len(alone))
            self.base[parents[alone]] = slots - codes[alone]
            self.check[slots] = parents[alone]

    def walk(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The node of every beginning of every sequence, laid out as flat."""
        nodes = np.empty(len(flat), np.int64)
        starts, at = np.cumsum(sizes) - sizes, np.zeros(len(sizes), np.int64)
        live, depth = np.flatnonzero(sizes > 0), 0
        while len(live):
            to = self.base[at[live]] + flat[starts[live] + depth]
            if not (self.check[to] == at[live]).all():
                raise KeyError("a sequence that the trie does not hold")
            at[live] = nodes[starts[live] + depth] = to
            depth += 1
            live = live[sizes[live] > depth]
        return nodes


def _shard(table: pa.Table) -> pa.Table:
    """NODES of one shard's sequences (key, seq, sizes, n, low, ends, deep)."""
    rows = sorted(zip(*(table[c].to_pylist() for c in ("seq", "n", "low", "ends", "deep"))))
    seqs = [r[0] for r in rows]
    n, low, deep = (np.array([r[i] for r in rows], np.int64) for i in (1, 2, 4))
    sizes = np.array([len(s) // WIDTH for s in seqs], np.int64)
    turns = np.frombuffer(b"".join(seqs), f"S{WIDTH}")
    lengths = dict(zip(table["seq"].to_pylist(), table["sizes"].to_pylist()))
    n_bytes = np.array([x for s in seqs for x in lengths[s]], np.int64)
    distinct, where, which = np.unique(turns, return_index=True, return_inverse=True)
    dense = np.empty(len(distinct), np.int64)
    dense[np.argsort(where)] = np.arange(1, len(distinct) + 1)  # in the order of the sequences: siblings are neighbours
    flat = dense[which]
    trie = DoubleArray(flat, sizes)
    nodes = trie.walk(flat, sizes)

    size, starts = trie.end, np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(seqs)), sizes)
    depths, convs, least, shared, last = np.zeros(size, np.int64), np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max), np.zeros(size, np.int64), np.zeros(size, np.int64)
    depths[nodes] = np.arange(len(flat)) - starts[owner] + 1
    last[nodes] = n_bytes
    for at, who in ((nodes, owner), (np.zeros(len(seqs), np.int64), np.arange(len(seqs)))):
        np.add.at(convs, at, n[who])
        np.minimum.at(least, at, low[who])
        np.maximum.at(shared, at, deep[who])
    every = np.flatnonzero(trie.check[:size] >= 0)
    every = every[np.argsort(depths[every], kind="stable")]
    children, leaves, saved = np.zeros(size, np.int64), np.zeros(size, np.int64), (convs - 1) * last
    np.add.at(children, trie.check[every], 1)
    leaves[children == 0] = 1
    cuts = np.flatnonzero(np.diff(depths[every])) + 1
    for level in reversed(np.split(every, cuts)):
        np.add.at(leaves, trie.check[level], leaves[level])
        np.add.at(saved, trie.check[level], saved[level])

    ends, keys = {}, {}
    for i, (s, a, k) in enumerate(zip(seqs, starts, sizes)):
        path = [0, *nodes[a : a + min(k, deep[i])].tolist()]
        ends[int(nodes[a + k - 1]) if k else 0] = rows[i][3]
        done = None
        for d, node in enumerate(path):
            if node not in keys:
                if done is None:
                    done = hashlib.sha256(s[: WIDTH * d])
                else:
                    done.update(s[WIDTH * (d - 1) : WIDTH * d])
                keys[node] = done.copy().digest()
            else:
                done = None
    every = np.r_[0, every]
    parents = trie.check[every]
    kind = np.where(depths[every] < shared[every], SHARED, np.where(depths[every] == shared[every], OPEN, CLOSED))
    slots, above = every.tolist(), parents.tolist()
    named = lambda x, k: keys[x] if k != CLOSED and x >= 0 else None
    columns = [
        pa.array(kind, pa.int32()),
        pa.array([named(x, k) for x, k in zip(slots, kind)], pa.binary()),
        pa.array([named(x, k) for x, k in zip(above, kind)], pa.binary()),
        pa.array(depths[every]),
        pa.array(least[every]),
        pa.array(least[np.maximum(parents, 0)], mask=kind != CLOSED),
        *(pa.array(x[every]) for x in (convs, children, leaves, saved, last)),
        pa.array([ends.get(x, NO_ENDS if k != SHARED else None) for x, k in zip(slots, kind)], pa.string()),
    ]
    return pa.Table.from_arrays(columns, ["kind", "key", "parent", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "n_bytes", "ends_sha256"])


def turn_lists(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns array<struct<turn, role, hash, n_bytes>>), a row a conversation, its turns in order."""
    role, text = common.text_of(role_col), common.text_of(text_col)
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    turn = F.struct(F.col(turn_col).alias("turn"), role.alias("role"), F.unhex(F.substring(F.sha2(whole, 256), 1, 2 * WIDTH)).alias("hash"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, conv_id) in order to (key, first, ids): decimal ids of one key, comma-joined, CHUNK_IDS at most."""
    key, ids, done = None, [], []

    def close() -> None:
        if ids:
            done.append((key, ids[0], ",".join(map(str, ids))))

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.string())], ["key", "first", "ids"])
        done.clear()
        return batch

    for batch in batches:
        for k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k != key or len(ids) >= CHUNK_IDS:
                close()
                key, ids = k, []
            ids.append(i)
        yield flush()
    close()
    yield flush()


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, first, ids) in order to (key, ends): SHA-256 of all ids of a key, comma-joined."""
    key, state = None, None
    for batch in batches:
        done = []
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if k == key:
                state.update(b"," + ids.encode())
                continue
            if state is not None:
                done.append((key, state.hexdigest()))
            key, state = k, hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())], ["key", "ends"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["key", "ends"])


def _prefix(depth: Column) -> Column:
    """Hash of the first turns of seq, all if there are fewer."""
    return F.unhex(F.sha2(F.substring(F.col("seq"), F.lit(1), (WIDTH * depth).cast("int")), 256))


def _dealt(seqs: DataFrame) -> DataFrame:
    """seqs with deep, the depth of the shard's prefix, and bucket."""
    powers = F.filter(F.array(*[F.lit(1 << k) for k in range(27)]), lambda d: d <= F.col("n_turns"))
    begun = seqs.where("n_turns > 0").select("key", "seq", "n_turns", F.explode(powers).alias("d")).select("key", "n_turns", "d", _prefix(F.col("d")).alias("prefix"))
    crowded = common.cut(begun.groupBy("prefix").agg(F.sum("n_turns").alias("turns")).where(F.col("turns") > SHARD_TURNS).select("prefix"), "crowded")
    if crowded.isEmpty():
        dealt = seqs.withColumn("deep", F.lit(1))
    else:
        deep = begun.join(common.maybe_broadcast(crowded, 64), "prefix").groupBy("key").agg((2 * F.max("d")).cast("int").alias("deep"))
        dealt = seqs.join(deep, "key", "left").withColumn("deep", F.coalesce("deep", F.lit(1)))
    turns = seqs.agg(F.sum(F.col("n_turns") + 1)).first()[0] or 0
    return dealt.withColumn("bucket", F.pmod(F.xxhash64(_prefix(F.col("deep"))), F.lit(1 + turns // SHARD_TURNS)))


def _summed_up(upper: DataFrame, most: int) -> DataFrame:
    """upper (key, parent, n_leaves, saved_tokens, ...) with these two summed over all upper nodes below, itself included."""
    rows = upper.select("key", F.col("parent").alias("up"), "n_leaves", "saved_tokens")
    for _ in range(int(most).bit_length()):
        rows = common.cut(rows, "upper")
        linked = rows.where("up is not null")
        below = linked.groupBy(F.col("up").alias("key")).agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        higher = common.join_hot(linked.select("key", "up"), rows.select(F.col("key").alias("up"), F.col("up").alias("next")), ["up"]).select("key", "next")
        total = rows.join(below, "key", "left").join(higher, "key", "left")
        rows = total.select("key", F.col("next").alias("up"), (F.col("n_leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("s", F.lit(0))).alias("saved_tokens"))
    return upper.drop("n_leaves", "saved_tokens").join(rows.drop("up"), "key")


def trie(lists: DataFrame) -> DataFrame:
    """A row a node of the conversations' prefix trie, from (conv_id, turns array<struct<hash, n_bytes, ...>>).

    conv_id: the smallest member; depth; parent_conv_id: that of the parent, null for the root; n_convs: members; n_children;
    n_leaves: nodes without children in the subtree; saved_tokens: over the subtree, (members - 1) times the bytes of
    the last text; ends_sha256: of the ids, ascending and comma-joined, of conversations that end here.
    """
    spark = lists.sparkSession
    ship(spark)
    seq = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["hash"])), ""))
    rows = lists.select("conv_id", seq.alias("seq"), F.transform("turns", lambda t: t["n_bytes"]).alias("sizes"))
    rows = common.cut(rows.withColumn("key", F.unhex(F.sha2("seq", 256))), "sequences")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = common.map_rows(rows.select("key", "conv_id").repartitionByRange(tasks, "key", "conv_id").sortWithinPartitions("key", "conv_id"), _chunks, "key binary, first long, ids string")
    ends = common.map_rows(chunks.repartition(tasks, "key").sortWithinPartitions("key", "first"), _hashed, "key binary, ends string")
    seqs = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("conv_id").alias("low"), F.first("seq").alias("seq"), F.first("sizes").alias("sizes"))
    seqs = common.cut(seqs.join(ends, "key").withColumn("n_turns", F.size("sizes")), "distinct")
    parts = common.cut(_dealt(seqs).select("bucket", "key", "seq", "sizes", "n", "low", "ends", "deep").groupBy("bucket").applyInArrow(_shard, NODES), "parts")

    opened = parts.where(F.col("kind") == OPEN)
    shared = parts.where(F.col("kind") == SHARED).groupBy("key")
    shared = common.cut(shared.agg(F.first("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.max("n_bytes").alias("n_bytes"), F.max("ends_sha256").alias("ends")), "shared")
    zero = F.lit(0).cast("long")
    links = opened.select("parent", "n_leaves", "saved_tokens").unionByName(shared.where("parent is not null").select("parent", zero.alias("n_leaves"), zero.alias("saved_tokens")))
    below = links.groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
    own = shared.join(below, "key", "left")
    upper = own.select(
        "key", "parent", "depth", "conv_id", "n_convs",
        F.coalesce("n_children", zero).alias("n_children"),
        (F.coalesce("l", zero) + F.col("n_children").isNull().cast("long")).alias("n_leaves"),
        (F.coalesce("s", zero) + (F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens"),
        F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
    upper = _summed_up(upper, shared.agg(F.max("depth")).first()[0] or 0)
    names = ["depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    under = opened.select("parent", *names).unionByName(upper.where("parent is not null").select("parent", *names))
    under = common.join_hot(under, shared.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id")), ["parent"]).drop("parent")
    root = upper.where("parent is null").select(*names, F.lit(None).cast("long").alias("parent_conv_id"))
    return parts.where(F.col("kind") == CLOSED).select(*names, "parent_conv_id").unionByName(under).unionByName(root)
