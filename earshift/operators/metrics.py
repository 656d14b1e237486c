"""Listening behaviour: discovery, repeat concentration, skips, coverage."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import null_if_zero, ratio, shared_keys
from ..params import DEFAULTS, Params


def discovery_rate(plays: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Artists first heard in each month; months without any are absent."""
    firsts = plays.where(F.col("artist_name").isNotNull()).groupBy(*by, "artist_name").agg(
        F.min("month").alias("month")
    )
    return firsts.groupBy(*by, "month").agg(F.count(F.lit(1)).alias("new_artists"))


def discovery_by_year(rate: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """In the first year every artist is new, so that row is flagged."""
    years = rate.groupBy(*by, F.year("month").alias("year")).agg(
        F.avg("new_artists").alias("avg_new"), F.sum("new_artists").alias("total_new")
    )
    first = F.min("year").over(Window.partitionBy(*by))
    return years.withColumn("first_year", F.col("year") == first)


def repeat_concentration(
    plays: DataFrame, params: Params = DEFAULTS, by: Sequence[str] = ()
) -> DataFrame:
    """Share of a year's time held by its top 1 % of artists (at least one).

    A year can have any number of artists, so they are not ranked in one task.
    Artists are counted in buckets of 0.3 % width by time; buckets wholly above
    the cut add up as they are, and only the bucket the cut falls in is ranked,
    by distinct millisecond value.
    """
    year = [*by, "year"]
    ms = F.round(F.col("played_seconds") * 1000.0).cast("bigint")
    artists = plays.where(F.col("artist_name").isNotNull()).groupBy(
        *by, F.year("ts").alias("year"), "artist_name"
    ).agg(F.sum(ms).alias("ms")).select(
        *year, "ms",
        F.when(F.col("ms") > 0, F.floor(F.log2(F.col("ms").cast("double")) * 256)).otherwise(-1)
        .alias("bucket"),
    )
    down = Window.partitionBy(*year).orderBy(F.desc("bucket"))
    upto = F.sum("n").over(down)
    buckets = (
        artists.groupBy(*year, "bucket")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("ms").alias("ms"))
        .withColumns({"upto": upto, "artists": F.sum("n").over(Window.partitionBy(*year))})
        .withColumn("size", F.greatest(F.lit(1), F.ceil(
            F.col("artists") * F.lit(Decimal(str(params.top_artist_fraction))))).cast("bigint"))
    )
    before = F.col("upto") - F.col("n")
    on_cut = (before < F.col("size")) & (F.col("upto") > F.col("size"))
    years = buckets.groupBy(*year).agg(
        F.max("artists").alias("artists"), F.max("size").alias("top_1pct_size"),
        F.sum("ms").alias("ms"),
        F.sum(F.when(F.col("upto") <= F.col("size"), F.col("ms"))).alias("above"),
        F.max(F.when(on_cut, F.col("bucket"))).alias("bucket"),
        F.max(F.when(on_cut, F.col("size") - before)).alias("need"),
    )
    cut_values = artists.join(years.select(*year, "bucket", "need"), [*year, "bucket"]).groupBy(
        *year, "need", "ms"
    ).agg(F.count(F.lit(1)).alias("n"))
    ahead = F.sum("n").over(Window.partitionBy(*year).orderBy(F.desc("ms"))) - F.col("n")
    taken = F.least(F.col("n"), F.greatest(F.col("need") - ahead, F.lit(0)))
    cut = cut_values.withColumn("part", taken * F.col("ms")).groupBy(*year).agg(
        F.sum("part").alias("inside")
    )
    top = F.coalesce("above", F.lit(0)) + F.coalesce("inside", F.lit(0))
    return years.join(cut, year, "left").select(
        *year, "artists", "top_1pct_size",
        ratio(top.cast("double"), F.col("ms").cast("double")).alias("top_1pct_share"),
        (F.col("ms") / 1000.0 / 3600.0).alias("total_hours"),
    )


def is_skip() -> Column:
    """Three-valued on purpose: an unknown skip flag is not a skip but counts
    as a play."""
    return F.col("skipped") | F.col("reason_end").isin("fwdbtn", "endplay")


def skip_rate(
    plays_raw: DataFrame, credits: DataFrame, weights: DataFrame,
    params: Params = DEFAULTS, by: Sequence[str] = (),
) -> DataFrame:
    """Skips per tag over all music rows, attributed to the album artist.

    Rows fold to tracks, then to artists, before the tag weights fan out.
    """
    tracks = plays_raw.where(F.col("content_type") == "music").groupBy(*by, "track_uri").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(is_skip(), 1)).alias("skips"),
        F.sum("ms_played").alias("ms"),
    )
    lead = credits.where(F.col("credit_type") == "album_artist").select(
        *shared_keys(credits, by, "track_uri"), "artist_name"
    )
    artists = tracks.join(lead, shared_keys(lead, by, "track_uri")).groupBy(*by, "artist_name").agg(
        F.sum("n").alias("n"), F.sum("skips").alias("skips"), F.sum("ms").alias("ms")
    )
    w = F.col("tag_weight")
    tags = artists.join(weights, shared_keys(weights, by, "artist_name")).groupBy(*by, "tag").agg(
        F.sum(w * F.col("n")).alias("weighted_plays"),
        F.sum(w * F.col("skips")).alias("weighted_skips"),
        (F.sum(F.col("ms") / 1000.0 * w) / 3600.0).alias("hours"),
    )
    return tags.where(F.col("weighted_plays") >= params.skip_rate_floor).select(
        *by, "tag", "weighted_plays", "weighted_skips",
        ratio(F.col("weighted_skips"), F.col("weighted_plays")).alias("skip_rate"), "hours",
    )


def tag_coverage(
    plays: DataFrame, credits: DataFrame, weights: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Percent of listening time on tracks with at least one tagged performer."""
    tagged_artists = weights.select(*shared_keys(weights, by, "artist_name")).distinct()
    tagged = credits.join(tagged_artists, tagged_artists.columns, "left_semi").select(
        *shared_keys(credits, by, "track_uri")
    ).distinct().withColumn("_tagged", F.lit(True))
    tracks = plays.groupBy(*by, "track_uri").agg(F.sum("played_seconds").alias("secs"))
    joined = tracks.join(tagged, [c for c in tagged.columns if c != "_tagged"], "left")
    return joined.groupBy(*by).agg(
        (100.0 * F.sum(F.when(F.col("_tagged"), F.col("secs"))) / null_if_zero(F.sum("secs")))
        .alias("pct_tagged")
    )


def coverage_by_status(hours: DataFrame, resolution: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Listening hours per resolution status; artists never tried are listed."""
    status = F.coalesce("status", F.lit("never_attempted")).alias("status")
    per = hours.join(resolution.select("artist_name", "status"), "artist_name", "left").groupBy(
        *by, status
    ).agg(F.sum("listening_hours").alias("hours"))
    return per.withColumn(
        "pct", 100.0 * F.col("hours") / null_if_zero(F.sum("hours").over(Window.partitionBy(*by)))
    )


def coverage_summary(
    hours: DataFrame, resolution: DataFrame, artist_tags: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Percent of listening time that is resolved, has any tag, has a genre tag."""
    genre = artist_tags.where("is_genre").select("artist_name").distinct().withColumn("_g", F.lit(True))
    j = hours.join(resolution.select("artist_name", "status", "n_tags"), "artist_name", "left").join(
        genre, "artist_name", "left"
    )
    h = F.col("listening_hours")
    pct = lambda c: 100.0 * F.sum(F.when(c, h)) / null_if_zero(F.sum(h))
    resolved = F.col("status") == "resolved"
    return j.groupBy(*by).agg(
        pct(resolved).alias("pct_resolved"),
        pct(resolved & (F.col("n_tags") > 0)).alias("pct_any_tag"),
        pct(F.col("_g")).alias("pct_genre_tag"),
    )


def tags_by_artists(artist_tags: DataFrame) -> DataFrame:
    """Genres by number of artists."""
    pairs = artist_tags.where("is_genre").select("tag", "artist_name").distinct()
    return pairs.groupBy("tag").agg(F.count(F.lit(1)).alias("n_artists"))


def tag_row_counts(artist_tags: DataFrame) -> DataFrame:
    return artist_tags.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("is_genre"), 1)).alias("n_genre_rows")
    )


def coverage_by_tier(
    hours: DataFrame, artist_tags: DataFrame, edges: Sequence[float] = (0.5, 2.0, 10.0, 50.0),
    by: Sequence[str] = (),
) -> DataFrame:
    """Genre coverage per listening tier: artists, tagged share, untagged hours."""
    genre = artist_tags.where("is_genre").select("artist_name").distinct().withColumn("_g", F.lit(True))
    h = F.col("listening_hours")
    tier = F.lit(0)
    for e in edges:
        tier = tier + F.when(h >= e, 1).otherwise(0)
    return hours.join(genre, "artist_name", "left").groupBy(*by, tier.alias("tier")).agg(
        F.count(F.lit(1)).alias("artists"),
        (100.0 * F.count("_g") / F.count(F.lit(1))).alias("pct_tagged"),
        F.coalesce(F.sum(F.when(F.col("_g").isNull(), h)), F.lit(0.0)).alias("untagged_hours"),
    )
