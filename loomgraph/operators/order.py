"""Ranks, running sums and best prefixes over a whole table, in two levels: within range partitions, then by the partitions' offsets.

No row goes through one task: the driver sees one row of sums a partition.  The order must be total, so by ends in a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import frozen

#: Running values are told apart to so many places.
PLACES = 9


def _dealt(rows: DataFrame, by: tuple) -> DataFrame:
    """rows with __p, the range partition, and __m, which ascends in order; frozen, as both are used twice."""
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    return frozen(dealt.withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id()), "ordered")


def _per_partition(dealt: DataFrame, *sums) -> list:
    return dealt.groupBy("__p").agg(F.count("*").alias("n"), F.min("__m").alias("first"), *sums).orderBy("__p").collect()


def _shifted(dealt: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return dealt.join(F.broadcast(dealt.sparkSession.createDataFrame(rows, f"__p int, {schema}")), "__p")


def numbered(rows: DataFrame, *by) -> DataFrame:
    """rows with idx, from 0 in the order of by."""
    dealt, at, shifts = _dealt(rows, by), 0, []
    for r in _per_partition(dealt):
        shifts.append((r["__p"], at - r["first"]))
        at += r["n"]
    return _shifted(dealt, shifts, "__shift long").withColumn("idx", F.col("__m") + F.col("__shift")).drop("__p", "__m", "__shift")


def running(rows: DataFrame, value: str, *by, kind: str = "sum") -> DataFrame:
    """rows with idx and running: the sum or the maximum (kind) of value from the first row in the order of by to the row itself."""
    dealt = _dealt(rows.withColumn(value, F.coalesce(F.col(value).cast("double"), F.lit(0.0 if kind == "sum" else float("-inf")))), by)
    own = F.sum(value) if kind == "sum" else F.max(value)
    at, total, shifts = 0, 0.0 if kind == "sum" else float("-inf"), []
    for r in _per_partition(dealt, own.alias("own")):
        shifts.append((r["__p"], at - r["first"], total))
        at, total = at + r["n"], total + r["own"] if kind == "sum" else max(total, r["own"])
    within = own.over(Window.partitionBy("__p").orderBy("__m").rowsBetween(Window.unboundedPreceding, 0))
    both = F.col("__before") + within if kind == "sum" else F.greatest("__before", within)
    return _shifted(dealt, shifts, "__shift long, __before double").withColumn("idx", F.col("__m") + F.col("__shift")).withColumn("running", both).drop("__p", "__m", "__shift", "__before")


def best_prefix(rows: DataFrame, value: str, *by) -> DataFrame:
    """The rows, with idx and running, up to the first at which the running sum of value is highest; none if it is nowhere above 0."""
    summed = frozen(running(rows, value, *by), "running")
    top = summed.agg(F.max(F.struct(F.round("running", PLACES).alias("r"), (-F.col("idx")).alias("i"))).alias("t")).first().t
    return summed.where(F.col("idx") <= (-top.i if top is not None and top.r > 0 else -1))
