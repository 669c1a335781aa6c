"""The corpus pipeline: documents in, sharded training documents out.

Stages, each over all rows that the one before kept, each written as Parquet and read again:

1. ``toxicity``: rows whose toxicity score is 0.3 or more go;
2. ``near_duplicates``: one row of each near-duplicate group stays (shingles of five words, 0.8);
3. ``decontamination``: rows that hold benchmark passages go (see ``linecast.llm.decontam``);
4. ``mixing``: sources get their weights; the mix repeats rows of small sources, at most twice as
   often as those of the largest, and loses none;
5. ``sharding``: every row gets its shard (the only stage that adds columns).

Null texts, empty tables and extra columns are handled as each operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linecast.llm.decontam import drop_contaminated
from linecast.llm.mixing import realise
from linecast.llm.neardup import drop_near_duplicates
from linecast.llm.scratch import table, written
from linecast.llm.sharding import SHARD_BYTES, shard
from linecast.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The classifier learns from the labelled rows of the documents table, whatever ``docs`` holds."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"), corpus=table(spark, sf_dir, "documents"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs, words=5, threshold_pct=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return realise(docs, max_repeats=2.0)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shard(docs, SHARD_BYTES)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: A fitted classifier and graph components have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
