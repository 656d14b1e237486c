"""Nested lookup payloads flattened to rows.  Schemas are in ``schemas``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR = "\u001f"


def utc(text: Column) -> Column:
    """ISO time with offset or Z to a zone-free UTC time, in any session zone;
    without either it is UTC already."""
    marked = F.when(text.rlike(r"(Z|[+-]\d\d:?\d\d)$"), text).otherwise(F.concat(text, F.lit("Z")))
    zoned = F.try_to_timestamp(marked)
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), zoned.cast("timestamp_ntz"))


def recently_played(pages: DataFrame) -> DataFrame:
    """Recently-played pages to polled plays.  The duration is the track's
    length, so it is flagged as an estimate.  Items without a uri are dropped."""
    it = pages.select(F.explode("items").alias("it")).select("it.played_at", "it.track", "it.context")
    it = it.where(F.coalesce("track.uri", F.lit("")) != "")
    text = lambda: F.lit(None).cast("string")
    flag = lambda: F.lit(None).cast("boolean")
    names = F.transform("track.artists", lambda a: a["name"])
    return it.select(
        utc(F.col("played_at")).alias("ts"), F.lit("api-poll").alias("platform"),
        F.coalesce("track.duration_ms", F.lit(0)).cast("bigint").alias("ms_played"),
        F.lit(True).alias("ms_played_estimated"), text().alias("conn_country"),
        F.coalesce(
            F.try_element_at("track.album.artists", F.lit(1))["name"],
            F.try_element_at("track.artists", F.lit(1))["name"],
        ).alias("artist_name"),
        F.col("track.name").alias("track_name"), F.col("track.album.name").alias("album_name"),
        F.col("track.uri").alias("track_uri"),
        F.nullif(F.array_join(names, SEPARATOR), F.lit("")).alias("track_artists"),
        F.col("context.type").alias("reason_start"), text().alias("reason_end"),
        flag().alias("shuffle"), flag().alias("skipped"), flag().alias("offline"),
        flag().alias("incognito_mode"), F.lit("poll").alias("source_kind"),
        F.lit("music").alias("content_type"),
    )


def page_full(pages: DataFrame, limit: int = 50) -> DataFrame:
    """Items per page, in their place, and whether the page was full: then older
    plays may be lost."""
    n = F.coalesce(F.size("items"), F.lit(0))
    return pages.withColumns({"n_items": n, "page_full": n >= limit}).drop("items")


def playlist_items(pages: DataFrame, keep_null: bool = False) -> DataFrame:
    """Playlist pages (source, page, items) to rows with an artist array.

    Items without a uri are dropped for scoring and kept for a snapshot.
    """
    page = "page" if "page" in pages.columns else None
    rows = pages.select(
        "source", *([page] if page else []), F.posexplode_outer("items").alias("i", "it")
    ).where(F.col("i").isNotNull())
    item = rows.select(
        "source",
        ((F.col("page").cast("bigint") * F.lit(1 << 20)) + F.col("i") if page else F.col("i").cast("bigint")).alias("pos"),
        F.col("it.item.uri").alias("track_uri"),
        (F.col("it.item.name") if keep_null else F.coalesce("it.item.name", F.lit(""))).alias("track_name"),
        F.coalesce(
            F.transform("it.item.artists", lambda a: F.coalesce(a["name"], F.lit(""))),
            F.array().cast("array<string>"),
        ).alias("artists"),
        F.coalesce("it.added_at", F.lit("")).alias("added_at"),
    )
    return item if keep_null else item.where(F.coalesce("track_uri", F.lit("")) != "")


def snapshot_rows(pages: DataFrame, run_date: str, label: str, playlist_id: str) -> DataFrame:
    """Contents of a playlist before it is replaced, in the archive shape."""
    return playlist_items(pages, keep_null=True).select(
        F.lit(run_date).alias("run_date"), F.lit("pre_replace_snapshot").alias("kind"),
        F.lit(label).alias("gap_tag"), F.lit(playlist_id).alias("playlist_id"),
        F.col("pos").cast("int").alias("position"), F.lit(None).cast("string").alias("slot"),
        F.array_join("artists", ", ").alias("artist_name"), "track_name", "track_uri", "source",
    )


def similar_artists(records: DataFrame) -> DataFrame:
    """Similar-artist lists to edges; entries without an id are dropped."""
    e = records.select("seed_mbid", F.explode("similar").alias("x")).where(
        F.coalesce("x.artist_mbid", F.lit("")) != "")
    return e.select(
        "seed_mbid", F.col("x.artist_mbid").alias("mbid"), F.coalesce("x.name", F.lit("")).alias("name"),
        F.coalesce("x.score", F.lit(0.0)).alias("score"), F.coalesce("x.comment", F.lit("")).alias("comment"))


def lookup_tags(records: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """Artist lookups (mbid, genres, tags) to (mbid, tag, count).

    Curated genres win; raw tags are the fallback and only they are filtered by
    the vocabulary.  Counts are clamped at 0.
    """
    curated = F.coalesce(F.size("genres"), F.lit(0)) > 0
    rows = records.select(
        "mbid", curated.alias("curated"),
        F.explode(F.when(curated, F.col("genres")).otherwise(F.col("tags"))).alias("t"),
    ).where(F.coalesce("t.name", F.lit("")) != "").select(
        "mbid", "curated", F.lower("t.name").alias("tag"),
        F.greatest(F.coalesce("t.count", F.lit(0)), F.lit(0)).cast("bigint").alias("count"))
    if vocabulary is not None:
        known = vocabulary.select(F.col("term").alias("tag")).distinct().withColumn("_known", F.lit(True))
        empty = ~F.coalesce(known.agg(F.count(F.lit(1)) > 0).scalar(), F.lit(False))
        rows = rows.join(known, "tag", "left").where(F.col("curated") | F.col("_known").isNotNull() | empty)
    return rows.select("mbid", "tag", "count")
