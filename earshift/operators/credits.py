"""Track credits: who performs on each track."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns for performer credits in a title.
CREDIT_IN_TITLE = r"(?i)[\(\[](?:feat\.?|featuring|ft\.?|with)\s+([^\)\]]+)[\)\]]"
NAME_SEPARATOR = r",\s*|\s+&\s+|\s+and\s+|\s+x\s+|\s+X\s+|\s*\+\s*"
# No word boundary after the lead on purpose: published behaviour.
LEAD_WORD = r"(?i)^\s*(?:feat\.?|ft\.?|featuring|with)\s*"
TRAILING_WORD = r"(?i)\s*(?:remix|cover|version|edit|mix|remaster(?:ed)?)\s*$"
BRACKET = r"[\(\)\[\]]"
LISTED_ARTISTS_SEPARATOR = "\u001f"


def clean_name(fragment: Column) -> Column:
    name = F.regexp_replace(fragment, LEAD_WORD, "")
    name = F.regexp_replace(name, TRAILING_WORD, "")
    return F.trim(F.regexp_replace(name, BRACKET, ""))


def is_name(name: Column) -> Column:
    """2 to 60 characters with an ASCII letter or digit, so names wholly in
    another script are dropped: published behaviour."""
    return name.isNotNull() & F.length(name).between(2, 60) & name.rlike("[A-Za-z0-9]")


def _credit(name: Column, kind: Column | str) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(name.alias("artist_name"), kind.alias("credit_type"))


def listed_performers(listed: Column) -> Column:
    """Performers from the poller's list; the first is the album artist."""
    names = F.array_distinct(F.transform(F.split(listed, LISTED_ARTISTS_SEPARATOR), lambda n: F.trim(n)))
    return F.transform(
        names, lambda n, i: _credit(n, F.when(i == 0, "album_artist").otherwise("featured"))
    )


def title_performers(title: Column, album_artist: Column) -> Column:
    """Album artist plus the names a title admits.  A repeated name stays."""
    blob = F.nullif(F.regexp_extract(title, CREDIT_IN_TITLE, 1), F.lit(""))
    names = F.coalesce(
        F.transform(F.split(blob, NAME_SEPARATOR), clean_name), F.array().cast("array<string>")
    )
    guests = F.filter(names, lambda n: ~n.eqNullSafe(album_artist))
    return F.concat(
        F.array(_credit(album_artist, "album_artist")),
        F.transform(guests, lambda n: _credit(n, "featured")),
    )


def track_rollup(plays: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per track; the names are the lowest ones, so reruns agree.

    The log is folded on the names themselves first: that step can hash, while
    the lowest of several strings needs a sort, which then runs on few rows.
    """
    return fold_tracks(fold_spellings(plays, by), by)


def fold_spellings(plays: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Time and plays per track and spelling of its names; adds up over batches."""
    return plays.groupBy(*by, "track_uri", "track_name", "artist_name", "track_artists").agg(
        F.sum("played_seconds").alias("played_seconds"), F.count(F.lit(1)).alias("n_plays")
    )


def fold_tracks(spellings: DataFrame, by: Sequence[str] = (), more: Sequence[Column] = ()) -> DataFrame:
    """One row per track; ``more`` are aggregates to add."""
    return spellings.groupBy(*by, "track_uri").agg(
        F.min("track_name").alias("track_name"),
        F.min("artist_name").alias("album_artist"),
        F.sum("played_seconds").alias("played_seconds"),
        F.sum("n_plays").alias("n_plays"),
        F.max("track_artists").alias("listed"), *more,
    )


def track_credits(plays: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(track, performer) rows.  One polled listen is enough for the poller's
    list to replace the title guess on the whole track.

    The log is folded to tracks once; both paths then build an array inside the
    track's own row, so credits need no further shuffle.
    """
    return credits_of_tracks(track_rollup(plays, by), by)


def _polled(of: str = "") -> Column:
    return F.coalesce(F.col(f"{of}listed") != "", F.lit(False))


def performers_of(of: str = "") -> Column:
    """Performers of a ``fold_tracks`` row; ``of`` is the prefix of its columns."""
    performers = F.when(_polled(of), listed_performers(F.col(f"{of}listed"))).otherwise(
        title_performers(F.col(f"{of}track_name"), F.col(f"{of}album_artist"))
    )
    return F.filter(performers, lambda c: is_name(c["artist_name"]))


def credits_of_tracks(t: DataFrame, by: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    t = t.withColumns({
        "_all": performers_of(),
        "credit_source": F.when(_polled(), "poller").otherwise("export"),
    }).withColumn("n_performers", F.size("_all").cast("bigint"))
    return t.select("*", F.explode("_all").alias("_c")).select(
        *by, "track_uri", "track_name", "album_artist", "_c.artist_name", "_c.credit_type",
        "credit_source", "played_seconds", "n_plays", "n_performers", *keep,
    )


def artist_hours(credits: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Listening time per performer; every credit counts the whole track."""
    return credits.groupBy(*by, "artist_name").agg(
        (F.sum("played_seconds") / 3600.0).alias("listening_hours")
    )


def only_in(credits: DataFrame, column: str, wanted: str, other: str, by: Sequence[str] = ()) -> DataFrame:
    """Performers with a ``wanted`` value and never an ``other`` one, e.g.
    featured but never album artist, or known to the poller only."""
    names = lambda v: credits.where(F.col(column) == v).select(*by, "artist_name").distinct()
    return names(wanted).join(names(other), [*by, "artist_name"], "left_anti")


def featured_only(credits: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return only_in(credits, "credit_type", "featured", "album_artist", by)


def featured_ranking(credits: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Featured performers with hours and tracks: order down for the top list,
    up for the review of rare names."""
    return credits.where(F.col("credit_type") == "featured").groupBy(*by, "artist_name").agg(
        (F.sum("played_seconds") / 3600.0).alias("hours"), F.count(F.lit(1)).alias("n_tracks")
    )


def credits_profile(credits: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts of performers by kind and the time on featured and repaired tracks.

    One fold to performers and one to tracks stand in for seven distinct counts.
    """
    is_album, is_featured = (F.col("credit_type") == k for k in ("album_artist", "featured"))
    is_polled = F.col("credit_source") == "poller"
    has = lambda c: F.max(F.when(c, 1).otherwise(0))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    artists = credits.groupBy(*by, "artist_name").agg(
        has(is_album).alias("a"), has(is_featured).alias("f"),
        has(is_polled).alias("p"), has(~is_polled).alias("e"), F.count(F.lit(1)).alias("rows"),
    ).groupBy(*by).agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_artists"),
        one(F.col("a") == 1).alias("n_album"), one(F.col("f") == 1).alias("n_featured"),
        one((F.col("f") == 1) & (F.col("a") == 0)).alias("n_featured_only"),
        one((F.col("p") == 1) & (F.col("e") == 0)).alias("n_poller_only"),
    )
    secs = F.col("secs")
    tracks = credits.groupBy(*by, "track_uri").agg(
        has(is_featured).alias("f"), has(is_polled).alias("p"),
        F.max("played_seconds").alias("secs"),
    ).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_tracks"), F.sum(secs).alias("total_seconds"),
        F.coalesce(F.sum(F.when(F.col("f") == 1, secs)), F.lit(0.0)).alias("featured_seconds"),
        one(F.col("p") == 1).alias("n_repaired_tracks"),
        F.coalesce(F.sum(F.when(F.col("p") == 1, secs)), F.lit(0.0)).alias("repaired_seconds"),
    )
    if by:
        return artists.join(tracks, list(by))
    every = tracks.agg(F.max(F.struct(*tracks.columns))).scalar()  # one row
    return artists.withColumn("_t", every).select(*artists.columns, "_t.*")
