"""Sharding by jump consistent hashing: a stable key and the number of shards
give the shard, without a ring table."""

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import work_dir
from .text import whole

cloudpickle.register_pickle_by_value(sys.modules[__name__])

STEP = 2862933555777941757  # multiplier of the published algorithm


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of every 64-bit key.  One more shard moves a key only there."""
    key = keys.astype(np.uint64)
    out = np.full(len(key), -1, np.int64)
    ahead = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        out[live] = ahead[live]
        k = key[live] * np.uint64(STEP) + np.uint64(1)
        key[live] = k
        ahead[live] = ((out[live] + 1) * (float(1 << 31) / ((k >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        live = live[ahead[live] < shards]
    return out


def assign(df: DataFrame, shards: int, key: str = "doc_id", name: str = "shard") -> DataFrame:
    """Adds the shard of each row.  A null key counts as 0."""
    if shards < 1:
        raise ValueError("at least one shard")
    f = F.pandas_udf(lambda s: pd.Series(jump(s.to_numpy(np.int64), shards)).astype("int32"), "int")
    return df.withColumn(name, f(F.coalesce(F.col(f"`{key}`"), F.lit(0)).cast("long")))


def write(df: DataFrame, shards: int, path: str, key: str = "doc_id") -> None:
    """Writes every row, with all its columns, below ``path/shard=N``; large
    shards get several files.  A column ``shard`` of the rows is replaced."""
    assign(df, shards, key).hint("rebalance", "shard").write.mode("overwrite").option(
        "compression", "zstd").partitionBy("shard").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The written rows with ``shard`` and ``slot``: their place in the shard's files,
    taken in the order of names.  Only the files' row counts are added up."""
    file, row = F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")
    rows = spark.read.parquet(path)
    shard = F.col("shard").cast("int").alias("_shard")
    sizes = rows.select(file, shard).groupBy("_file", "_shard").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_shard").orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = sizes.select(F.col("_file").alias("_f"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    numbered = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c != "shard"], F.col("shard").cast("int").alias("shard"), file, row)
    return numbered.join(files, F.col("_file") == F.col("_f")).withColumn("slot", F.col("_from") + F.col("_row")).drop("_file", "_row", "_f", "_from")


def plan(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shards the rows and reports on the files written, one row per row: doc_id, size,
    text_crc32, law, shard, slot, grown_shard.

    Size is the text's UTF-8 bytes plus 16; null texts have none.  Slots count
    from 0 in each shard, in the order of its files.  A null key counts as 0.  An
    empty table gives an empty one; further columns are ignored and may have any name.
    """
    path = f"{work_dir(df.sparkSession)}/shards"
    own = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    empty = own.isEmpty()
    write(own, shards, path)
    if empty:  # no folder tells the columns
        spark, kinds = df.sparkSession, "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int"
        return spark.createDataFrame([], kinds)
    t = whole("text")
    light = read(df.sparkSession, path).select(
        "doc_id", (F.octet_length(t) + 16).cast("long").alias("size"), F.crc32(F.encode(t, "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"), "shard", "slot")
    return assign(light, shards + 1, name="grown_shard")
