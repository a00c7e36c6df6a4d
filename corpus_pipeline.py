"""The corpus pipeline: quality, toxicity, near-duplicates, packing.

Every stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which run()
writes as Parquet and reads again as the next stage's docs.  All but the last return the columns of documents.

Rules of every stage: null texts count as empty; rows of one id and different texts go or stay each for itself, equal rows
count as copies; rows without an id are judged like any others; an empty table gives no rows; other columns are kept
by the first three stages and ignored by the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import common, packing, quality, simhash, toxicity

#: Texts with this score or more are rejected as toxic.
TOXIC = 0.5


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the model of trusted text is within their language's threshold."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; it learns from the rows that are not held out."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out()))
    return toxicity.keep_harmless(docs, model, TOXIC)


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (fingerprints as near as op9_simhash links them, or five-word shingles alike to 0.8 or more): the one with the smallest id."""
    return simhash.survivors(simhash.duplicates(docs), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document that is left, in sequences of 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))

STAGES = [("quality", good), ("toxicity", harmless), ("simhash", single), ("packing", packed)]
#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
