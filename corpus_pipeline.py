"""A training-corpus pipeline made of the corpus operators.

Every stage takes all that its predecessor kept.  All but the last return the
columns of ``documents``; the last writes the corpus as token records and
returns where each document stands in them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barspark.llm import decontam, langid, mixing, neardup, records
from barspark.llm.common import Workspace
from barspark.llm.queries import END_ID, tokenizer_path


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages stay; texts without a letter or unlike every learned language go."""
    return langid.drop_unidentified(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays (five words, similarity 0.8)."""
    return neardup.drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stands as often as its fitted rate says, below one by the hash of its id."""
    return mixing.apply_rates(docs, mixing.mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as token records, read back: doc_id, start, n_tokens, ids_crc32, file, record."""
    path = Workspace(spark, "corpus").root
    index = records.write_records(docs, path, records.RecordConfig(tokenizer_path(), END_ID))
    return records.with_starts(records.read_checksums(spark, path), index).select("doc_id", "start", "n_tokens", "ids_crc32", "file", "record")


STAGES = [
    ("hierarchical_langid", identified),
    ("minmax_neardup", one_of_each),
    ("winnow_decontam", decontaminated),
    ("soft_mixing", mixed),
    ("token_records", token_records),
]

#: The stages' models and classes are beyond SQL; tests/llm/test_pipeline.py compares each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each one's result written as Parquet before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    work = Workspace(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = work.table(name, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
