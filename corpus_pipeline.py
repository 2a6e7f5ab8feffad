"""A corpus pipeline: documents to the shards of a training set.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame.  Its result is written as Parquet
and read again as the docs of the next one.  All but the last return the columns of
documents; the last one returns the place of every row.

Defined results: a document whose text is null or has no letter goes in the first stage, one without a doc_id is
linked with none in the second and so stays there.  A doc_id with several texts stays in the second stage with all of them if one
is the first of its group; of equal rows one stays.  Texts of any length are read as a whole.  Columns besides those that a
stage reads go through all stages but the last.  Without documents the result is empty; without test items none is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm.blocks import kept
from tessitura.llm.decontamination import drop_contaminated
from tessitura.llm.jaccard_join import keep_first
from tessitura.llm.language_id import held_out, keep_identified, train_language_net
from tessitura.llm.mixing import mix_sources
from tessitura.llm.sharding import shard_documents


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those whose language is unclear."""
    train = docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id")))
    return keep_identified(docs, train_language_net(train))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: five-word shingles, a similarity of 0.8 or more."""
    return keep_first(docs, k=5, num=8, den=10)


def no_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that sources have their target weights."""
    return mix_sources(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row."""
    return shard_documents(docs)


STAGES = [
    ("language_id", known_language),
    ("jaccard_join", one_of_near_copies),
    ("decontamination", no_test_items),
    ("mix_sources", mixture),
    ("shard", shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: A trained network and edit distances are beyond SQL; the tests run the stages against brute force.
ORACLE_SQL = None
