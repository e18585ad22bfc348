"""A training corpus from raw documents: five operators, one after the other.

Each stage works on all that the one before kept, written as Parquet and read again. All stages but
the last return the columns of documents; the last adds each row's shard and slot.

Near duplicates are documents that links of Jaccard similarity 0.8 or more between sets of five-word
shingles join in steps; the one with the smallest doc_id stays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tillwise.llm.common import shared_folder, table
from tillwise.llm.decontamination import without_leaks
from tillwise.llm.mixing import mixed
from tillwise.llm.ngram_join import Join, one_of_each
from tillwise.llm.sharding import sharded
from tillwise.llm.toxicity import without_toxic

NEAR = Join(words=5, similar=80)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs, NEAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharded(docs)


STAGES = [
    ("toxicity", toxicity),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("sharding", sharding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what a stage keeps lies in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs


#: Learnt scores, a random draw and random shards can't be stated in SQL. tests/llm compares the join's
#: components with brute force, checks the other stages on small cases, and of the chain only columns
#: and the order of row counts.
ORACLE_SQL = None
