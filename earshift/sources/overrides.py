"""Hand-edited CSV files: artist, playlist and consolidation overrides.

Each reader returns (valid, rejected).  Blank and comment rows are neither.
The files are small and unsplit, so rows keep their file order in ``line``; the
last line for a key wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.frames import first_per_key
from ..functions.text import fold_name, title_key
from ..operators.resolve import MBID
from ..params import DEFAULTS, Params


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Columns are matched by the header's names, in any order and number."""
    raw = spark.read.option("header", True).option("comment", "#").option("multiLine", True).csv(path)
    wanted = [f.split()[0] for f in schema.split(",")]
    cell = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) if c in raw.columns else F.lit("")
    return raw.select(
        *[cell(c).alias(c) for c in wanted], F.monotonically_increasing_id().alias("line")
    )


def pipe_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\|"), lambda t: F.trim(t)), lambda t: t != "")


def artist_overrides(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """valid: (name_key, mbid, ignore, note, tags).  A row needs an id, IGNORE or
    tags; anything else in the id column is rejected."""
    rows = _csv(spark, path, schemas.ARTIST_OVERRIDES).where(
        (F.col("artist_name") != "") & ~F.col("artist_name").startswith("#")
        & ((F.col("mbid") != "") | (F.col("tags") != "")))
    ignore = F.lower("mbid") == "ignore"
    ok = (F.col("mbid") == "") | ignore | F.col("mbid").rlike(MBID)
    valid = rows.where(ok).select(
        fold_name(F.col("artist_name")).alias("name_key"), "artist_name",
        F.when((F.col("mbid") != "") & ~ignore, F.lower("mbid")).alias("mbid"), ignore.alias("ignore"),
        "note", pipe_list(F.col("tags")).alias("tags"), "line",
    )
    rejected = rows.where(~ok).select("artist_name", "mbid", "line", F.lit("neither an id nor IGNORE").alias("reason"))
    return first_per_key(valid, ["name_key"], [F.col("line")], last=True), rejected


def playlist_overrides(
    spark: SparkSession, path: str, params: Params = DEFAULTS
) -> tuple[DataFrame, DataFrame]:
    """valid: (label, tags, line); no tags means the label itself.  Rows past the
    number of playlists come back as rejected."""
    rows = _csv(spark, path, schemas.PLAYLIST_OVERRIDES).where(
        (F.col("label") != "") & ~F.col("label").startswith("#"))
    tags = pipe_list(F.col("tags"))
    every = rows.select(
        "label", F.when(F.size(tags) > 0, tags).otherwise(F.array("label")).alias("tags"), "line")
    kept = every.orderBy("line").limit(params.n_playlists)
    over = every.join(kept.select("line"), "line", "left_anti").select(
        "label", "line", F.lit("over the playlist cap").alias("reason"))
    return kept, over


def consolidate_overrides(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """valid: (title_key, artist_key, decision)."""
    rows = _csv(spark, path, schemas.CONSOLIDATE_OVERRIDES).where(
        (F.col("decision") != "") & ~F.col("decision").startswith("#")
        & (F.col("artist_name") != "") & (F.col("track_name") != ""))
    ok = F.lower("decision").isin("keep", "drop")
    valid = rows.where(ok).select(
        title_key(F.col("track_name")).alias("title_key"), fold_name(F.col("artist_name")).alias("artist_key"),
        F.lower("decision").alias("decision"), "line")
    rejected = rows.where(~ok).select(
        "decision", "artist_name", "track_name", "line", F.lit("neither keep nor drop").alias("reason"))
    return first_per_key(valid, ["title_key", "artist_key"], [F.col("line")], last=True), rejected


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """Genre terms, one per line, lower-cased."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("term")).where("term <> ''").distinct()
