"""Data-quality checks.  Each returns the violations as a DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import DEFAULTS, Params
from ..schemas import PRIVATE_FIELDS
from .trends import monthly_track_time


class QualityError(ValueError):
    pass


# Numeric columns that must be finite before a table is written.
FINITE = {
    "artist_tag_weights": ("tag_weight",),
    "tag_trends": ("share", "smoothed_share", "tag_seconds"),
    "skip_rate_by_tag": ("skip_rate",),
}


def not_finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column with NaN or infinite values, and how many."""
    bad = lambda c: F.isnan(c) | F.col(c).isin(float("inf"), float("-inf"))
    counts = df.agg(*[F.count(F.when(bad(c), 1)).alias(c) for c in columns])
    return counts.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in columns
    ])).alias("_v")).select("_v.*").where("n > 0")


def require_finite(df: DataFrame, columns: Sequence[str], table: str) -> None:
    """Refuse a table with non-finite values.  Runs one job."""
    found = not_finite(df, columns).collect()
    if found:
        raise QualityError("; ".join(f"{table}.{r['column']}: {r['n']} non-finite values" for r in found))


def forbidden_columns(df: DataFrame, fields: Sequence[str] = PRIVATE_FIELDS) -> list[str]:
    return [f for f in fields if f in df.columns]


def log_warnings(plays: DataFrame) -> DataFrame:
    """Rows without an artist and rows from video files."""
    return plays.agg(
        F.count(F.when(F.col("artist_name").isNull(), 1)).alias("null_artist_rows"),
        F.count(F.when(F.col("source_kind") == "video", 1)).alias("video_rows"),
    )


def mass_balance(
    plays: DataFrame, credits: DataFrame, weights: DataFrame, trends: DataFrame,
    params: Params = DEFAULTS, by: Sequence[str] = (),
) -> DataFrame:
    """Per variant: time that reaches a tag against time summed over tags.

    The reachable time is each track's time times the share of its credit held
    by tagged artists.  Both sides use the same rule for plays that share
    (ts, track), so the difference is zero up to rounding.
    """
    from .trends import credit_shares
    tagged = weights.select("artist_name").distinct()
    shares = credit_shares(credits, params).join(tagged, "artist_name", "left_semi").groupBy("track_uri").agg(
        *[F.sum(f"w_{v}").alias(f"w_{v}") for v in params.variants])
    time = monthly_track_time(plays, params, by).join(shares, "track_uri").agg(
        *[F.sum(F.col("secs") * F.col(f"w_{v}")).alias(v) for v in params.variants])
    reach = time.select(F.explode(F.array(*[
        F.struct(F.lit(v).alias("variant"), F.col(v).alias("reachable")) for v in params.variants
    ])).alias("_v")).select("_v.*")
    spread = trends.groupBy("variant").agg(F.sum("tag_seconds").alias("attributed"))
    return reach.join(spread, "variant").withColumn("difference", F.col("reachable") - F.col("attributed"))


def source_conflicts(whole: Sequence[str], filtered: Sequence[str]) -> list[str]:
    """Sources named both kept-whole and filtered."""
    return sorted(set(whole) & set(filtered))


def ambiguous_sources(playlists: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Named sources that match no playlist or more than one."""
    spark = playlists.sparkSession
    names = spark.createDataFrame([(n,) for n in wanted], "name string")
    hits = playlists.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return names.join(hits, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n")).where("n <> 1")


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count and order-free content hash; equal tables give equal rows."""
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).alias("content_hash"),
    )


def content_hash(df: DataFrame) -> Column:
    return F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])


def write_digested(df: DataFrame, path: str, key: Sequence[str], parts: int = 4096, fan: int = 64) -> None:
    """Writes a table in ``parts`` folders by a hash of ``key``, with digests that
    don't depend on the order of rows: of every part, of every ``fan`` parts, and so
    on up to one for the whole."""
    if PART in df.columns:
        raise ValueError(f"a column is named {PART}")
    rows = df.withColumn(PART, F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int"))
    rows.hint("rebalance", PART).write.mode("overwrite").option("compression", "zstd").partitionBy(PART).parquet(f"{path}/rows")
    stored = df.sparkSession.read.parquet(f"{path}/rows")  # what is there now, not what was meant
    digest = stored.groupBy(PART).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(content_hash(df).cast("decimal(38,0)")).alias("content_hash"))
    level, size = digest.select(F.lit(0).alias("level"), F.col(PART).alias("node"), "n_rows", "content_hash"), parts
    level.write.mode("overwrite").parquet(f"{path}/digests/level=0")
    k = 0
    while size > 1:
        below, k, size = df.sparkSession.read.parquet(f"{path}/digests/level={k}"), k + 1, -(-size // fan)
        below.groupBy(F.floor(F.col("node") / fan).cast("int").alias("node")).agg(
            F.sum("n_rows").alias("n_rows"), F.sum("content_hash").alias("content_hash")).write.mode("overwrite").parquet(f"{path}/digests/level={k}")


PART = "_part"


def differing_parts(spark: SparkSession, a: str, b: str, parts: int = 4096, fan: int = 64) -> list[int]:
    """Parts in which two ``write_digested`` tables differ, found from the top: only
    the children of differing nodes are compared."""
    depth, size = 0, parts
    while size > 1:
        depth, size = depth + 1, -(-size // fan)
    bad: list[int] | None = None
    for level in range(depth, -1, -1):
        one, two = (spark.read.parquet(f"{p}/digests/level={level}").select("node", "n_rows", "content_hash") for p in (a, b))
        if bad is not None:
            one, two = (d.where(F.floor(F.col("node") / fan).isin(bad)) for d in (one, two))
        other = two.select("node", F.col("n_rows").alias("_n"), F.col("content_hash").alias("_c"))
        off = one.join(other, "node", "full").where(~(F.col("n_rows").eqNullSafe(F.col("_n")) & F.col("content_hash").eqNullSafe(F.col("_c"))))
        bad = [r[0] for r in off.select(F.col("node").cast("int")).collect()]  # at most ``parts``
        if not bad:
            return []
    return sorted(bad or [])


def rerun_difference(spark: SparkSession, a: str, b: str, parts: int = 4096, fan: int = 64) -> DataFrame:
    """Rows, as often as they are, that only one of two ``write_digested`` tables
    holds, with ``side`` a or b.  Only differing parts are read."""
    bad = differing_parts(spark, a, b, parts, fan)
    one, two = (spark.read.parquet(f"{p}/rows").where(F.col(PART).isin(bad)).drop(PART) for p in (a, b))
    return one.exceptAll(two).withColumn("side", F.lit("a")).unionByName(two.exceptAll(one).withColumn("side", F.lit("b")))
