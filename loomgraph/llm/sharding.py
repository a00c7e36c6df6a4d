"""Placing rows on shards by a permutation-filled lookup table of prime size.

Every shard has its own order of preference over the table's slots: an offset and a step drawn from its
name, which visit each slot once because the size is prime.  The shards take turns, each claiming the
first slot of its order that is still free, until the table is full.  A row goes to the shard that owns
slot hash(key) mod size.  Shards own slots in numbers that differ by one at most, and adding or removing
a shard moves few slots between the others.

The table has a fixed number of rows (MOST_SLOTS at most), so broadcasting it is bounded whatever the data.

Rules: a null key is hashed like any other key and always goes to the same shard; equal keys share a
shard; repeated rows stay; a column with the name of a result column is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_SLOTS = 1 << 20


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _draw(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{salt}:{name}".encode(), digest_size=8).digest(), "little")


def fill_table(shards: Sequence[str], size: int = 65537) -> np.ndarray:
    """Owner (index into shards) of each slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct names, one at least")
    if not _is_prime(size) or not len(shards) <= size <= MOST_SLOTS:
        raise ValueError(f"the table's size must be a prime from the number of shards to {MOST_SLOTS}")
    starts = [_draw(s, "offset") % size for s in shards]
    steps = [_draw(s, "step") % (size - 1) + 1 for s in shards]
    owner, left, at = np.full(size, -1, dtype=np.int32), size, list(starts)
    while left:
        for k, step in enumerate(steps):
            slot = at[k]
            while owner[slot] >= 0:
                slot = (slot + step) % size
            owner[slot], at[k], left = k, (slot + step) % size, left - 1
            if not left:
                break
    return owner


def table(spark: SparkSession, shards: Sequence[str], size: int = 65537) -> DataFrame:
    """The lookup table: slot int, shard int."""
    return spark.createDataFrame(list(enumerate(fill_table(shards, size).tolist())), "slot int, shard int")


def place(rows: DataFrame, key: str, shards: Sequence[str], size: int = 65537) -> DataFrame:
    """rows with slot and shard: one hash and one look-up in the broadcast table for each row, no shuffle.  Columns of rows that have these names are replaced, the key too if it has one of them."""
    lookup = F.broadcast(table(rows.sparkSession, shards, size))
    slot = F.pmod(F.xxhash64(rows[key]), F.lit(size).cast("long")).cast("int")
    return rows.withColumn("slot", slot).drop("shard").join(lookup, "slot", "left")
