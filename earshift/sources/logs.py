"""Append-only JSON-lines logs: the last record per key counts."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.frames import first_per_key


SEQ = "log_seq"
MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"  # Spark's own format for JSON stops at milliseconds


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All readable records with ``seq``, their order in the log.

    A truncated last line is dropped.  Order is the number that ``append_log``
    gave the append, whatever its files are called; within it, and for files
    written by hand, the file, the block's offset and the row's number in it.
    """
    numbered = T.StructType([*schema.fields, T.StructField(SEQ, T.LongType())])
    rows = spark.read.schema(numbered).option("mode", "DROPMALFORMED").json(path)
    seq = F.struct(
        F.coalesce(SEQ, F.lit(0)).alias("append"), F.col("_metadata.file_name"), F.col("_metadata.file_block_start"),
        F.monotonically_increasing_id().alias("row"))
    return rows.select(*schema.fieldNames(), seq.alias("seq"))


def latest_per_key(log: DataFrame, key: Sequence[str], seq: str = "seq") -> DataFrame:
    """Last record per key.  ``seq`` may be any sortable column that the writer
    fills, e.g. a time of recording."""
    return first_per_key(log, list(key), [F.col(seq)], last=True)


def read_latest(spark: SparkSession, path: str, schema: T.StructType, key: Sequence[str]) -> DataFrame:
    return latest_per_key(read_log(spark, path, schema), key).drop("seq")


def append_log(records: DataFrame, path: str, seq: int | None = None) -> None:
    """Adds records under one number, by default the time of writing in
    nanoseconds; a later append must have a higher one.  ``records`` should hold
    a key once, as rows of one append have no order of their own."""
    records.withColumn(SEQ, F.lit(time.time_ns() if seq is None else seq)).write.mode("append").option(
        "timestampNTZFormat", MICROS).option("timestampFormat", MICROS + "XXX").json(path)
