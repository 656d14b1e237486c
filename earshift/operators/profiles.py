"""One-look profiles of the log, the trends and the poller."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import null_if_zero, top_k
from ..params import DEFAULTS, Params


def content_profile(plays_raw: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return plays_raw.groupBy(*by, "content_type").agg(
        F.count(F.lit(1)).alias("n_rows"),
        (F.coalesce(F.sum("played_seconds"), F.lit(0.0)) / 3600.0).alias("hours"),
    )


def filter_loss(plays_raw: DataFrame, params: Params = DEFAULTS, by: Sequence[str] = ()) -> DataFrame:
    """Music rows before the real-listen filter, dropped by it, and kept."""
    kept = F.col("track_uri").isNotNull() & (F.col("ms_played") >= params.min_ms_played)
    out = plays_raw.groupBy(*by).agg(
        F.count(F.lit(1)).alias("raw_rows"),
        F.count(F.when(F.col("content_type") == "music", 1)).alias("music_rows"),
        F.count(F.when(kept, 1)).alias("plays_rows"),
    )
    dropped = F.col("music_rows") - F.col("plays_rows")
    return out.withColumns({
        "dropped_rows": dropped,
        "dropped_pct": F.coalesce(100.0 * dropped / null_if_zero(F.col("music_rows")), F.lit(0.0)),
    })


def duplicates_dropped(export: DataFrame, plays_raw: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows read, rows kept and the difference."""
    n = lambda df, name: df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    one = n(export, "rows_read"), n(plays_raw, "raw_rows")
    if by:
        both = one[0].join(one[1], list(by), "left")
    else:
        both = one[0].withColumn("raw_rows", plays_raw.agg(F.count(F.lit(1))).scalar())
    return both.withColumn("duplicates", F.col("rows_read") - F.coalesce("raw_rows", F.lit(0)))


def residual_duplicates(plays: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Extra rows that share (end time, duration, track) but differ elsewhere."""
    groups = plays.groupBy(*by, "ts", "ms_played", "track_uri").agg(F.count(F.lit(1)).alias("n"))
    return groups.groupBy(*by).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("residual"))


def headline(plays: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Plays, hours, artists, tracks, months, first and last play, and warnings.

    The log is folded to (track, artist, month) once; the distinct counts run
    on that.
    """
    cells = plays.groupBy(*by, "track_uri", "artist_name", "month").agg(
        F.count(F.lit(1)).alias("n"), F.sum("played_seconds").alias("secs"),
        F.min("ts").alias("lo"), F.max("ts").alias("hi"),
        F.count(F.when(F.col("source_kind") == "video", 1)).alias("video"),
        F.count(F.when(F.col("ms_played_estimated"), 1)).alias("est"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return cells.groupBy(*by).agg(
        total("n").alias("plays"), (F.sum("secs") / 3600.0).alias("hours"),
        F.countDistinct("artist_name").alias("artists"), F.countDistinct("track_uri").alias("tracks"),
        F.countDistinct("month").alias("months"), F.min("lo").alias("first_ts"), F.max("hi").alias("last_ts"),
        total(F.when(F.col("artist_name").isNull(), F.col("n"))).alias("null_artist_rows"),
        total("video").alias("video_rows"), total("est").alias("estimated_rows"),
        (100.0 * F.sum("est") / null_if_zero(F.sum("n"))).alias("estimated_pct"),
    )


def top_artists(plays: DataFrame, k: int = 10, by: Sequence[str] = ()) -> DataFrame:
    per = plays.groupBy(*by, "artist_name").agg(
        (F.sum("played_seconds") / 3600.0).alias("hours"), F.count(F.lit(1)).alias("plays")
    )
    order = [F.desc("hours"), F.asc_nulls_last("artist_name")]
    return top_k(per, by, order, k) if by else per.orderBy(*order).limit(k)


def listening_by_year(plays: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Folded to (year, artist) first, so distinct artists are a row count."""
    cells = plays.groupBy(*by, F.year("ts").alias("year"), "artist_name").agg(
        F.sum("played_seconds").alias("secs"), F.count(F.lit(1)).alias("n")
    )
    return cells.groupBy(*by, "year").agg(
        (F.sum("secs") / 3600.0).alias("hours"), F.sum("n").alias("plays"),
        F.count("artist_name").alias("artists"),
    )


def poll_status(plays_raw: DataFrame, polled: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows, first and last time of the export and of the polled table."""
    look = lambda df, name: df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    ).withColumn("table", F.lit(name))
    return look(plays_raw, "export").unionByName(look(polled, "polled"))


def last_seen(plays_raw: DataFrame, polled: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Newest play time known from either table."""
    return plays_raw.select(*by, "ts").unionByName(polled.select(*by, "ts")).groupBy(*by).agg(
        F.max("ts").alias("last_ts")
    )


def trend_summary(trends: DataFrame, params: Params = DEFAULTS, by: Sequence[str] = ()) -> DataFrame:
    """Tags, months and tags per trend class of the default variant."""
    tags = trends.where(F.col("variant") == params.default_variant).groupBy(*by, "tag").agg(
        F.count(F.lit(1)).alias("months"), F.max("trend_class").alias("trend_class")
    )
    is_class = lambda c: F.count(F.when(F.col("trend_class") == c, 1)).alias(c)
    return tags.groupBy(*by).agg(
        F.count(F.lit(1)).alias("tags"), F.max("months").alias("months"),
        *[is_class(c) for c in ("rising", "declining", "flat", "negligible")],
    )


def movers(
    trends: DataFrame, direction: str, k: int = 10, params: Params = DEFAULTS, by: Sequence[str] = ()
) -> DataFrame:
    """Tags of one class by size of relative change.  Slope columns are the
    same on all rows of a tag, so one row per tag is taken."""
    tags = trends.where(
        (F.col("variant") == params.default_variant) & (F.col("trend_class") == direction)
    ).groupBy(*by, "tag", "trend_class").agg(
        *[F.max(c).alias(c) for c in ("rel_change_per_year", "slope_pp_per_year", "mean_recent_share")]
    )
    order = [F.abs("rel_change_per_year").desc(), F.asc("tag")]
    return top_k(tags, by, order, k) if by else tags.orderBy(*order).limit(k)


def hours_per_tag(trends: DataFrame, params: Params = DEFAULTS, by: Sequence[str] = ()) -> DataFrame:
    return trends.where(F.col("variant") == params.default_variant).groupBy(*by, "tag").agg(
        (F.sum("tag_seconds") / 3600.0).alias("hours")
    )


def story(trends: DataFrame, params: Params = DEFAULTS, by: Sequence[str] = ()) -> DataFrame:
    """Steepest riser and faller of the newest month, and the faller's peak share."""
    tags = trends.where(F.col("variant") == params.default_variant).groupBy(*by, "tag").agg(
        F.max_by(F.struct("month", "smoothed_share", "slope_pp_per_year"), "month").alias("last"),
        F.max("smoothed_share").alias("peak"),
    )
    newest = F.max("last.month").over(Window.partitionBy(*by))
    now = tags.withColumn("_newest", newest).where(
        (F.col("last.month") == F.col("_newest")) & F.col("last.slope_pp_per_year").isNotNull()
    )
    row = F.struct("tag", F.col("last.slope_pp_per_year").alias("pp"),
                   F.col("last.smoothed_share").alias("share"), "peak")
    pp = F.col("last.slope_pp_per_year")
    return now.groupBy(*by).agg(
        F.max_by(row, F.struct(pp, "tag")).alias("up"), F.min_by(row, F.struct(pp, "tag")).alias("down")
    ).select(
        *by, F.col("up.tag").alias("riser"), F.col("up.pp").alias("riser_pp"),
        F.col("up.share").alias("riser_share"), F.col("down.tag").alias("faller"),
        F.col("down.pp").alias("faller_pp"), F.col("down.share").alias("faller_share"),
        F.col("down.peak").alias("faller_peak"),
    )
