"""The corpus pipeline: documents to token ids in five stages.

Each stage takes the Parquet that the one before it wrote and works on all of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshift.llm import bagmin, bpe, mixing, queries, radix, rules
from earshift.sources.tables import materialise, work_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return radix.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bagmin.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_table(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, *queries.tokenizer(), keep=("doc_id", "source"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality), ("exact_dedup", exact), ("near_dedup", near), ("source_mix", mix), ("byte_bpe", tokenize),
]

#: Tokens can't be had in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = work_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name, base)
    return STAGES[-1][1](spark, docs, sf_dir)
