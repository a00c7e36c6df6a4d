"""What the operators share: the cluster's shared folder, lineage cuts, batch bounds."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.session import shared_root, ship

#: Rows and bytes of an Arrow batch; a batch holds at most the rows, and ends soon after the bytes.
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20
#: Bytes of a batch that a function gives back, about.
BACK_BYTES = 4 << 20
#: A side is broadcast only when its counted rows times their width stay under this.
BROADCAST_BYTES = 32 << 20


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: the plan starts anew and survives lost executors."""
    spark, path = df.sparkSession, fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, df_or_path) -> None:
    """Delete what cut() or a writer left in the shared folder."""
    paths = [df_or_path] if isinstance(df_or_path, str) else sorted({f.rsplit("/", 1)[0] for f in df_or_path.inputFiles()})
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small in rows and bytes, so that very long texts do not fill a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def maybe_broadcast(df: DataFrame, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if its counted size is small; else df, for Spark to shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def text_of(name: str) -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


#: What operators keep in a Python worker between tasks: name, and how to let go of it.
HELD: dict[str, Callable[[], None]] = {}


def release(but: str | None) -> None:
    """Let go of what other operators keep in this worker, and give the memory back."""
    others = [clear for name, clear in HELD.items() if name != but]
    for clear in others:
        clear()
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)


def map_rows(df: DataFrame, function, schema, keeps: str | None = None) -> DataFrame:
    """mapInArrow with batches bounded on the way in and back; function takes and gives iterators of record batches.  keeps: its name in HELD."""
    bound_batches(df.sparkSession)
    ship(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(keeps)
        yield from bounded(function(batches))

    return df.mapInArrow(run, schema)


def bounded(batches: Iterable[pa.RecordBatch], limit: int = BACK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about limit bytes at most if rows are of like size, one row at least: the executor's JVM holds a batch that comes back outside its heap."""
    for batch in batches:
        rows = batch.num_rows if batch.nbytes <= limit else max(1, batch.num_rows * limit // batch.nbytes)
        if rows >= batch.num_rows:
            yield batch
            continue
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def slices(batches: Iterable[pa.RecordBatch], column: int, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose column has about limit bytes at most, one row at least."""
    import pyarrow.compute as pc

    for batch in batches:
        if batch.nbytes <= limit:
            yield batch
            continue
        start = size = 0
        for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
            if size and size + (n or 0) > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n or 0
        if start < batch.num_rows:
            yield batch.slice(start)


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join with a table that has one row a key, when a key may hold a large part of rows.

    Keys with over a thousandth of the rows, so a thousand at most, are joined by broadcast; the others by
    a shuffle, in which none is large.
    """
    n = rows.count()
    hot = cut(rows.groupBy(*keys).count().where(F.col("count") * 1000 > n).select(*keys).join(table, keys), "hot")
    if not hot.take(1):
        return rows.join(table, keys)
    few = F.broadcast(hot)
    return rows.join(few, keys).unionByName(rows.join(few.select(*keys), keys, "left_anti").join(table, keys))
