"""Parquet tables, the playlist archive, and shared working folders."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import ARCHIVE


def work_dir(spark: SparkSession) -> str:
    """A new folder below the shared folder the cluster names in
    ``spark.checkpoint.dir``.  A local session without one gets its own."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="earshift-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/earshift-{uuid.uuid4().hex}"


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_optional(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None where nothing has been written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def materialise(df: DataFrame, name: str, base: str | None = None) -> DataFrame:
    """Write a stage's result to the shared folder and go on from the table.

    Use it where several later steps need the same result: it is computed once,
    the lineage ends, and a lost executor costs a re-read only.
    """
    path = f"{base or work_dir(df.sparkSession)}/{name}"
    write_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def register_tables(
    spark: SparkSession, required: Mapping[str, str], optional: Mapping[str, str] | None = None
) -> set[str]:
    """Named views over Parquet.  A missing required table raises; a missing
    optional one is skipped.  Returns the names registered."""
    for name, path in required.items():
        read_table(spark, path).createOrReplaceTempView(name)
    done = set(required)
    for name, path in (optional or {}).items():
        df = read_optional(spark, path)
        if df is not None:
            df.createOrReplaceTempView(name)
            done.add(name)
    return done


def write_table(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite",
    order: Sequence[str] | None = None,
) -> None:
    """ZSTD Parquet.  A rerun gives the same rows, not the same bytes; pass
    ``order`` only for small tables that need a total row order.

    Partitioned tables are rebalanced on their partition columns: adaptive
    execution joins small partitions and splits a large one over several files.
    """
    if order is not None:
        df = df.orderBy(*order)
    elif partition_by:
        df = df.hint("rebalance", *partition_by)
    w = df.write.mode(mode).option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic" if mode == "overwrite" else "static")
    w.parquet(path)


def append_archive(rows: DataFrame, path: str) -> None:
    """Add one run to the playlist archive.  No rows: nothing is written."""
    if rows.isEmpty():
        return
    rows.select(*[F.col(f.name).cast(f.dataType) for f in ARCHIVE.fields]).write.mode("append").option(
        "compression", "zstd").partitionBy("run_date").parquet(path)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ARCHIVE).parquet(path).select(*ARCHIVE.fieldNames())


def write_review(rows: DataFrame, path: str) -> None:
    """Review CSV with a header, highest share first.  A range sort keeps it
    distributed: part files in order."""
    rows.orderBy(
        F.desc(F.coalesce("rap_share", F.lit(0.0))), F.asc("artist_name"), F.asc("track_name"), F.asc("track_uri")
    ).write.mode("overwrite").option("header", True).csv(path)
