"""A symmetric sparse matrix in tiles, for products with tall ones.

Nodes are dealt into parts by hash; a tile holds the entries between two parts, ordered by row, as packed columns.  A product
meets each tile with one part of the other factor and leaves a row for each row of the tile, so that what is shuffled is a few times the
nodes instead of a row an entry.  The parts' number grows with the root of the entries: a task holds one tile and one part.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.session import frozen, ship

#: Entries of a tile on average, and of one packed row at most.
TILE, PACKED = 2_000_000, 4_000_000
#: Products of single numbers that sums() holds at once.
EXPANDED = 1_000_000
_PACKED = "cell int, src binary, first binary, dst binary, at binary, weight binary"


@dataclass(frozen=True)
class Tiles:
    """Packed rows of the entries between part cell div parts (of src) and part cell mod parts (of dst): distinct src and where each begins, distinct dst and which of them each entry has, weights."""

    rows: DataFrame
    parts: int

    def part(self, node: str) -> Column:
        return F.pmod(F.xxhash64(node, F.lit("tile")), F.lit(self.parts)).cast("int")

    def spread(self, df: DataFrame) -> DataFrame:
        """df(node, ...) with cell, once for every tile that its node's part meets."""
        cells = F.array(*[F.lit(k * self.parts) + self.part("node") for k in range(self.parts)])
        return df.withColumn("cell", F.explode(cells)).repartition(self.parts**2, "cell")

    def meet(self, df: DataFrame, run, schema: str) -> DataFrame:
        """run(tile, part of df) for every tile."""
        ship(df.sparkSession)
        return self.rows.repartition(self.parts**2, "cell").groupBy("cell").cogroup(self.spread(df).groupBy("cell")).applyInArrow(run, schema)


def _packed(cell: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(src, kind="stable")
    src, dst, weight = src[order], dst[order], weight[order]
    first = np.flatnonzero(np.concatenate([[True], src[1:] != src[:-1]]))
    others, at = np.unique(dst, return_inverse=True)
    columns = [src[first], first.astype(np.int32), others, at.astype(np.int32), weight]
    return pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), *[pa.array([c.tobytes()], pa.binary()) for c in columns]], ["cell", "src", "first", "dst", "at", "weight"])


def _pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by cell into packed ones: a new one for each cell, and after PACKED entries."""
    held, count = [], 0  # numpy columns of batches of one cell or more

    def out() -> Iterator[pa.RecordBatch]:
        cell, src, dst, weight = (np.concatenate([h[k] for h in held]) for k in range(4))
        held.clear()
        for part in np.split(np.arange(len(cell)), np.flatnonzero(np.diff(cell)) + 1):
            a, b = part[0], part[-1] + 1
            yield _packed(int(cell[a]), src[a:b], dst[a:b], weight[a:b])

    for batch in batches:
        if batch.num_rows:
            held.append([batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)])
            count += batch.num_rows
            if count >= PACKED:
                yield from out()
                count = 0
    if held:
        yield from out()


def unpacked(tile: pa.Table) -> Iterator[tuple[np.ndarray, ...]]:
    """(src, first, dst, at, weight) of each packed row."""
    for k in range(tile.num_rows):
        kinds = {"src": np.int64, "first": np.int32, "dst": np.int64, "at": np.int32, "weight": np.float64}
        yield tuple(np.frombuffer(tile.column(name)[k].as_buffer(), kind) for name, kind in kinds.items())


def tiled(x: DataFrame) -> Tiles:
    """x(src, dst, weight) in tiles, frozen; x is read twice."""
    ship(x.sparkSession)
    parts = max(1, math.ceil(math.sqrt(x.count() / TILE)))
    empty = Tiles(x, parts)
    rows = x.select((empty.part("src") * parts + empty.part("dst")).alias("cell"), F.col("src").cast("long"), F.col("dst").cast("long"), F.col("weight").cast("double"))
    return Tiles(frozen(rows.repartition(parts**2, "cell").sortWithinPartitions("cell").mapInArrow(_pack, _PACKED), "tiles"), parts)


def found(ids: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of wanted in the ascending ids; len(ids) for those that are not there."""
    if not len(ids):
        return np.zeros(len(wanted), dtype=np.int64)
    at = np.searchsorted(ids, wanted).clip(max=len(ids) - 1)
    return np.where(ids[at] == wanted, at, len(ids))


def times(tiles: Tiles, q: DataFrame, columns: int) -> DataFrame:
    """(node, q): x q for q(node, q array<double>), 0 where q has no row; every src of x has a row."""

    def run(tile: pa.Table, part: pa.Table) -> pa.Table:
        ids = part.column("node").to_numpy()
        order = np.argsort(ids)
        values = part.column("q").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, columns)[order]
        values, ids = np.vstack([values, np.zeros(columns)]).T.copy(), ids[order]
        nodes, sums = [np.zeros(0, np.int64)], [np.zeros((0, columns))]
        for src, first, dst, at, weight in unpacked(tile):
            place = found(ids, dst)[at]
            nodes.append(src)
            sums.append(np.stack([np.add.reduceat(weight * values[k][place], first) for k in range(columns)], axis=1))
        m = np.concatenate(sums)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * columns, pa.int32()), pa.array(m.ravel()))
        return pa.table([pa.array(np.concatenate(nodes)), lists], ["node", "q"])

    partial = tiles.meet(q.select("node", "q"), run, "node long, q array<double>")
    sums = partial.groupBy("node").agg(*[F.sum(F.col("q")[k]).alias(f"q{k}") for k in range(columns)])
    return sums.select("node", F.array(*[f"q{k}" for k in range(columns)]).alias("q"))


def _slices(counts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of entries whose counts sum to about EXPANDED."""
    ends = np.cumsum(counts)
    cuts = np.unique(np.searchsorted(ends, np.arange(EXPANDED, ends[-1] if len(ends) else 0, EXPANDED), side="right"))
    yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(counts)])


def sums(tiles: Tiles, u: DataFrame) -> DataFrame:
    """(node, v, u): x U for a sparse U(node, v, u) of any number of columns v; a row for each pair that has entries, as by a join and a grouped sum.

    Entries meet U within a tile, a slice at a time, and are summed by row and column there.
    """
    kind = u.schema["v"].dataType.simpleString()

    def run(tile: pa.Table, part: pa.Table) -> pa.Table:
        node, v, value = (part.column(name).to_numpy() for name in ("node", "v", "u"))
        columns, code = np.unique(v, return_inverse=True)
        order = np.argsort(node, kind="stable")
        code, value = code[order], value[order]
        ids, begin, size = np.unique(node[order], return_index=True, return_counts=True)
        begin, size, wide = np.append(begin, 0), np.append(size, 0), max(len(columns), 1)
        nodes, places, totals = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for src, first, dst, at, weight in unpacked(tile):
            place = found(ids, dst)[at]
            row = np.repeat(np.arange(len(src)), np.diff(np.append(first, len(at))))
            for a, b in _slices(size[place]):
                n = size[place[a:b]]
                entry = np.repeat(np.arange(a, b), n)
                where = np.arange(len(entry)) + np.repeat(begin[place[a:b]] - (np.cumsum(n) - n), n)
                if not len(entry):
                    continue
                key = (row[entry] - row[a]) * wide + code[where]
                if (row[b - 1] - row[a] + 1) * wide <= 4 * EXPANDED:
                    keys = np.flatnonzero(np.bincount(key))
                    total = np.bincount(key, weight[entry] * value[where])[keys]
                else:
                    keys, at_key = np.unique(key, return_inverse=True)
                    total = np.bincount(at_key, weight[entry] * value[where])
                nodes.append(src[row[a] + keys // wide])
                places.append(keys % wide)
                totals.append(total)
        named = columns[np.concatenate(places)] if len(columns) else columns
        return pa.table([pa.array(np.concatenate(nodes)), pa.array(named), pa.array(np.concatenate(totals))], ["node", "v", "u"])

    partial = tiles.meet(u.select("node", "v", F.col("u").cast("double")), run, f"node long, v {kind}, u double")
    return partial.groupBy("node", "v").agg(F.sum("u").alias("u"))
