"""Readers of graph files, and the sinks and source of results."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.operators.graph import Graph


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file) of text files."""
    return spark.read.text(path).select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("value"), F.col("_metadata.file_path").alias("file"))


def lfr_network(spark: SparkSession, path: str, base: int = 0) -> DataFrame:
    """(graph_id, src, dst, weight) of 'u v' lines, a graph a file, its number the last one in the file's name; simple and undirected.  base: what to subtract from nodes."""
    parts = F.split("value", r"\s+")
    rows = _lines(spark, path).where("value <> ''").select(F.regexp_extract("file", r"network_(.*?)\.dat$", 1).alias("graph_id"), (parts[0].cast("long") - base).alias("u"), (parts[1].cast("long") - base).alias("v"))
    return rows.select("graph_id", F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst")).distinct().withColumn("weight", F.lit(1.0))


def lfr_community(spark: SparkSession, path: str, base: int = 0) -> DataFrame:
    """(graph_id, node, block) of 'node community' lines; base: what to subtract from both."""
    parts = F.split("value", r"\s+")
    return _lines(spark, path).where("value <> ''").select(F.regexp_extract("file", r"community_(.*?)\.dat$", 1).alias("graph_id"), (parts[0].cast("long") - base).alias("node"), (parts[1].cast("int") - base).alias("block"))


def lfr_strict(spark: SparkSession, path: str) -> DataFrame:
    """(u, v) of tab-separated pairs numbered from 1, now from 0; anything else fails."""
    rows = spark.read.text(path)
    parts = F.split(F.trim("value"), "\t")
    fine = F.when(F.size(parts) != 2, F.raise_error(F.concat(F.lit("not two fields: "), "value")).cast("long")).otherwise(F.trim(parts[0]).cast("long"))
    return rows.select((fine - 1).alias("u"), (F.trim(parts[1]).cast("long") - 1).alias("v"))


def edge_list(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, weight) of 'u v w' lines with three fields or more."""
    parts = F.split("value", r"\s+")
    return _lines(spark, path).where(F.size(parts) >= 3).select(parts[0].cast("long").alias("src"), parts[1].cast("long").alias("dst"), parts[2].cast("double").alias("weight"))


def labels_by_line(spark: SparkSession, path: str) -> DataFrame:
    """(node, block) of one integer a line; the node is the line's number from 0 in a single file."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.rtrim("value"), r"\r?\n")).alias("node", "line"))
    return rows.where("trim(line) <> ''").select(F.col("node").cast("long"), F.trim("line").cast("int").alias("block"))


def pajek(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes(node, label, pos), edges(src, dst, weight, directed)) of a .net file."""
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.split("value", r"\r?\n")).alias("at", "line")).select("at", F.trim("line").alias("line")).where("line <> '' and not line like '\\%%'")
    tag = F.when(F.col("line").startswith("*"), F.lower(F.regexp_extract("line", r"^\*(\w+)", 1)))
    tagged = lines.withColumn("section", F.last(tag, True).over(Window.orderBy("at"))).where(~F.col("line").startswith("*"))
    label = F.coalesce(F.nullif(F.regexp_extract("line", r'"([^"]*)"', 1), F.lit("")), F.split("line", r"\s+")[1])
    nodes = tagged.where("section = 'vertices'").select(F.split("line", r"\s+")[0].cast("long").alias("node"), label.alias("label"), (F.row_number().over(Window.orderBy("at")) - 1).alias("pos"))
    parts = F.split("line", r"\s+")
    edges = tagged.where("section in ('arcs', 'edges')").select(parts[0].cast("long").alias("src"), parts[1].cast("long").alias("dst"), F.coalesce(F.get(parts, F.lit(2)).cast("double"), F.lit(1.0)).alias("weight"), (F.col("section") == "arcs").alias("directed"))
    return nodes, edges


GML = re.compile(r'\s*(\[|\]|"[^"]*"|[^\s\[\]]+)')


def parse_gml(text: str) -> tuple[bool, list[dict], list[dict]]:
    """(directed, nodes, edges) of a GML text: lists of flat attributes."""
    tokens, at = GML.findall(re.sub(r"(?m)^\s*#.*$", "", text)), 0

    def block() -> list[tuple]:
        nonlocal at
        out = []
        while at < len(tokens) and tokens[at] != "]":
            key, at = tokens[at], at + 1
            if at < len(tokens) and tokens[at] == "[":
                at += 1
                value = block()
                at += 1
            else:
                value, at = tokens[at].strip('"') if at < len(tokens) else "", at + 1
            out.append((key, value))
        return out

    top = block()
    graph = next((v for k, v in top if k == "graph"), top)
    flat = lambda items: {k: v for k, v in items if isinstance(v, str)}
    return dict((k, v) for k, v in graph if isinstance(v, str)).get("directed") == "1", [flat(v) for k, v in graph if k == "node"], [flat(v) for k, v in graph if k == "edge"]


def gml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, bool]:
    """(nodes(node, label, value), edges(src, dst, weight), directed) of one GML file."""
    text = spark.read.text(path, wholetext=True).first().value
    directed, nodes, edges = parse_gml(text)
    table = spark.createDataFrame([(int(n["id"]), n.get("label"), n.get("value")) for n in nodes], "node long, label string, value string")
    return table, spark.createDataFrame([(int(e["source"]), int(e["target"]), float(e.get("value", e.get("weight", 1)))) for e in edges], "src long, dst long, weight double"), directed


def without_isolated_and(graph: Graph, positions: DataFrame) -> Graph:
    """The graph without isolated nodes and without the nodes of positions(node)."""
    own = graph.connected()
    kept = own.nodes.join(positions.select("node"), "node", "left_anti")
    edges = own.edges.join(kept.withColumnRenamed("node", "src"), "src", "left_semi").join(kept.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return Graph(edges, graph.directed, kept)


#: The edges of Zachary's karate club, nodes from 1, and the members of Mr. Hi's side.
KARATE = (
    "1-2 1-3 1-4 1-5 1-6 1-7 1-8 1-9 1-11 1-12 1-13 1-14 1-18 1-20 1-22 1-32 2-3 2-4 2-8 2-14 2-18 2-20 2-22 2-31 3-4 3-8 3-9 3-10 3-14 3-28 3-29 3-33 4-8 4-13 4-14 5-7 5-11 6-7 6-11 6-17 7-17 "
    "9-31 9-33 9-34 10-34 14-34 15-33 15-34 16-33 16-34 19-33 19-34 20-34 21-33 21-34 23-33 23-34 24-26 24-28 24-30 24-33 24-34 25-26 25-28 25-32 26-32 27-30 27-34 28-34 29-32 29-34 30-33 30-34 31-33 31-34 32-33 32-34 33-34"
)
MR_HI = (1, 2, 3, 4, 5, 6, 7, 8, 9, 11, 12, 13, 14, 17, 18, 20, 22)


def karate(spark: SparkSession) -> tuple[Graph, DataFrame]:
    """The karate club, nodes from 0, and its two sides (Mr. Hi's is 1)."""
    edges = [(int(a) - 1, int(b) - 1, 1.0) for a, b in (e.split("-") for e in KARATE.split())]
    part = spark.createDataFrame([(i, int(i + 1 in MR_HI)) for i in range(34)], "node long, block int")
    return Graph(spark.createDataFrame(edges, "src long, dst long, weight double"), False, part.select("node")), part


#: The events, by number from 1, that each of the eighteen Southern women attended.
SOUTHERN = {
    "Evelyn Jefferson": "1 2 3 4 5 6 8 9", "Laura Mandeville": "1 2 3 5 6 7 8", "Theresa Anderson": "2 3 4 5 6 7 8 9", "Brenda Rogers": "1 3 4 5 6 7 8", "Charlotte McDowd": "3 4 5 7", "Frances Anderson": "3 5 6 8",
    "Eleanor Nye": "5 6 7 8", "Pearl Oglethorpe": "6 8 9", "Ruth DeSand": "5 7 8 9", "Verne Sanderson": "7 8 9 12", "Myra Liddel": "8 9 10 12", "Katherina Rogers": "8 9 10 12 13 14", "Sylvia Avondale": "7 8 9 10 12 13 14",
    "Nora Fayette": "6 7 9 10 11 12 13 14", "Helen Lloyd": "7 8 10 11 12", "Dorothy Murchison": "8 9", "Olivia Carleton": "9 11", "Flora Price": "9 11",
}


def southern_women(spark: SparkSession) -> tuple[Graph, DataFrame]:
    """Women (from 0) and events (from 18), and the two kinds as blocks."""
    edges = [(i, 17 + int(e), 1.0) for i, events in enumerate(SOUTHERN.values()) for e in events.split()]
    part = spark.createDataFrame([(i, int(i >= 18)) for i in range(32)], "node long, block int")
    return Graph(spark.createDataFrame(edges, "src long, dst long, weight double"), False, part.select("node")), part


#: Columns of a flat result before the blocks.
FLAT = ("network", "inference", "objective", "num_blocks", "from_true", "cpu_time", "node_moves", "n_deltas", "objective_value")


def write_flat(runs: DataFrame, path: str) -> None:
    """One CSV row a run: FLAT columns, then the blocks in node order; levels of a hierarchy follow each other."""
    blocks = F.transform("blocks", lambda b: b.cast("string"))
    columns = F.concat(F.array(*(F.col(c).cast("string") for c in FLAT)), blocks)
    runs.select(F.array_join(F.transform(columns, lambda x: F.coalesce(x, F.lit(""))), ",").alias("value")).write.mode("overwrite").text(path)


def read_flat(spark: SparkSession, path: str, old: bool = False) -> DataFrame:
    """write_flat()'s rows again; old: files without the from_true column."""
    kinds = {"num_blocks": "int", "from_true": "boolean", "cpu_time": "double", "node_moves": "long", "n_deltas": "long", "objective_value": "double"}
    names = [c for c in FLAT if not (old and c == "from_true")]
    parts = F.split("value", ",")
    rows = spark.read.text(path).where(~F.col("value").startswith(names[0] + ","))
    cells = [parts[i].cast(kinds.get(c, "string")).alias(c) for i, c in enumerate(names)]
    if old:
        cells.insert(4, F.lit(False).alias("from_true"))
    return rows.select(*cells, F.transform(F.slice(parts, len(names) + 1, F.greatest(F.size(parts) - len(names), F.lit(0))), lambda x: x.cast("int")).alias("blocks"))


def levels_of(blocks: list[int], nodes: int) -> list[list[int]]:
    """Levels of a hierarchy from the flat list: each has as many entries as the level below has blocks."""
    out, at, size = [], 0, nodes
    while at < len(blocks):
        level = blocks[at : at + size]
        out.append(level)
        at, size = at + size, max(level) + 1
    return out


def write_metrics(table: DataFrame, path: str, kind: str = "csv") -> None:
    """Metric tables as CSV or JSON."""
    (table.write.mode("overwrite").option("header", True).csv(path) if kind == "csv" else table.write.mode("overwrite").json(path))
