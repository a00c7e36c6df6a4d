"""Graphs of the driver's tables.

nation_dir: trade between nations, supplier's nation to customer's, weight = line items; nation_und: the same
without direction; supply_und: suppliers and parts, weight = line items.  Blocks: regions; for parts, brands.
customer_labels: two labellings of customers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.graph import Graph

#: Parts follow suppliers in the numbering of nodes.
PART_BASE = 1_000_000_000


def _read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def nation(spark: SparkSession, sf_dir: str, directed: bool) -> tuple[Graph, DataFrame]:
    """Line items are counted by order and supplier before they meet customers; nations and suppliers' nations are small by count."""
    lines = _read(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey")
    suppliers = _read(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    orders = _read(spark, sf_dir, "orders", "o_orderkey", "o_custkey").join(_read(spark, sf_dir, "customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    trade = lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    a, b = F.col("s_nationkey").cast("long"), F.col("c_nationkey").cast("long")
    src, dst = (a, b) if directed else (F.least(a, b), F.greatest(a, b))
    edges = trade.groupBy(src.alias("src"), dst.alias("dst")).agg(F.count("*").cast("double").alias("weight")).withColumn("covariate", (F.col("src") + F.col("dst")).cast("double"))
    part = _read(spark, sf_dir, "nation", "n_nationkey", "n_regionkey").select(F.col("n_nationkey").cast("long").alias("node"), F.col("n_regionkey").cast("int").alias("block"))
    return Graph(edges, directed, part.select("node")), part


def supply(spark: SparkSession, sf_dir: str, directed: bool = False) -> tuple[Graph, DataFrame]:
    lines = _read(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey")
    dst = (F.col("l_partkey") + PART_BASE).alias("dst")
    edges = lines.groupBy(F.col("l_suppkey").alias("src"), dst).agg(F.count("*").cast("double").alias("weight")).withColumn("covariate", F.lit(1.0))
    region = _read(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    suppliers = _read(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").join(F.broadcast(region), F.col("s_nationkey") == F.col("n_nationkey"))
    parts = _read(spark, sf_dir, "part", "p_partkey", "p_brand")
    part = suppliers.select(F.col("s_suppkey").alias("node"), F.col("n_regionkey").cast("int").alias("block")).unionByName(
        parts.select((F.col("p_partkey") + PART_BASE).alias("node"), F.substring("p_brand", 7, 2).cast("int").alias("block"))
    )
    return Graph(edges, directed, part.select("node")), part


GRAPHS = {"nation_dir": lambda s, d: nation(s, d, True), "nation_und": lambda s, d: nation(s, d, False), "supply_und": lambda s, d: supply(s, d)}


def customer_labels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers by market segment and by region."""
    customers = _read(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    region = F.broadcast(_read(spark, sf_dir, "nation", "n_nationkey", "n_regionkey"))
    both = customers.join(region, F.col("c_nationkey") == F.col("n_nationkey"))
    return both.select(F.col("c_custkey").alias("node"), F.col("c_mktsegment").alias("block")), both.select(F.col("c_custkey").alias("node"), F.col("n_regionkey").alias("block"))


_TRADE = "lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"
_REGION = "part_ AS (SELECT n_nationkey::BIGINT AS node, n_regionkey::INT AS block FROM nation)"
#: The same graphs as common table expressions: e(src, dst, weight, covariate) and part_(node, block).
SQL = {
    "nation_dir": f"e AS (SELECT s_nationkey::BIGINT AS src, c_nationkey::BIGINT AS dst, count(*)::DOUBLE AS weight, (s_nationkey + c_nationkey)::DOUBLE AS covariate FROM {_TRADE} GROUP BY ALL), {_REGION}",
    "nation_und": f"e AS (SELECT least(s_nationkey, c_nationkey)::BIGINT AS src, greatest(s_nationkey, c_nationkey)::BIGINT AS dst, count(*)::DOUBLE AS weight, (least(s_nationkey, c_nationkey) + greatest(s_nationkey, c_nationkey))::DOUBLE AS covariate FROM {_TRADE} GROUP BY ALL), {_REGION}",
    "supply_und": f"""e AS (SELECT l_suppkey AS src, l_partkey + {PART_BASE} AS dst, count(*)::DOUBLE AS weight, 1.0::DOUBLE AS covariate FROM lineitem GROUP BY ALL),
part_ AS (SELECT s_suppkey AS node, n_regionkey::INT AS block FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT p_partkey + {PART_BASE}, substr(p_brand, 7, 2)::INT FROM part)""",
}
