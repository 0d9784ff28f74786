"""A training-data pipeline over ``documents``: quality rules, toxicity, near duplicates, packing.

Each stage reads what its predecessor kept.  The first three return rows of
``documents`` with their columns; the last returns pieces of token sequences.
The verdicts are models and sketches, so no SQL states the result (ORACLE_SQL
is None); tests hold the stages against plain versions.

Cases: a null or empty text fails the quality rules and goes; a null lang or
source is a group of its own; rows with a null doc_id are judged by their text
and stay as such; of repeated rows, and of rows that share a doc_id, one stays
after the third stage; ties are settled by digests of rows, so a run's answer
doesn't depend on how rows are spread; further columns, whatever their names,
stay until the last stage; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import near_dedup, packing, quality_rules, toxicity
from textloom.llm.common import bounded_batches, discard, job, shared_dir, table
from textloom.llm.word_tokens import public_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return quality_rules.reject(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return near_dedup.deduplicate(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return packing.pack(docs, public_path(packing.TOKENIZER))


STAGES = [("quality_rules", quality), ("toxicity", toxic), ("near_dedup", dedup), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all stages in turn; tables that a stage no longer needs are deleted once it is stored."""
    docs = table(spark, sf_dir, "documents")
    with job() as own:
        for _, stage in STAGES:
            path = shared_dir(spark)
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
            discard(spark, own, (path,))
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
