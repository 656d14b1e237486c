"""Playlists from genre gaps: specs, anchors, discovery, interleaving."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import first_per_key, top_k, trailing_months
from ..functions.text import fold_name, title_key
from ..params import DEFAULTS, Params
from .outlook import top_gaps

GAP_COLUMNS = ("gap_score", "hours", "n_artists", "rel_change_per_year")


def playlist_specs(
    gaps: DataFrame, overrides: DataFrame | None = None, params: Params = DEFAULTS
) -> DataFrame:
    """Which playlists to build, at most ``n_playlists``.

    No override table: the top gaps.  With one, it decides alone, and an empty
    one means none.  A label that is no gap is ``pinned`` and has no gap figures.
    """
    if overrides is None:
        top = top_gaps(gaps, params.n_playlists)
        return top.select(
            F.col("tag").alias("label"), F.array("tag").alias("tags"), F.lit(False).alias("pinned"),
            *GAP_COLUMNS,
            F.row_number().over(Window.orderBy(F.desc_nulls_last("gap_score"), "tag")).alias("spec_rank"),
        )
    rows = overrides.orderBy("line").limit(params.n_playlists)
    rows = rows.withColumn("spec_rank", F.row_number().over(Window.orderBy("line")))
    known = gaps.select(F.col("tag").alias("label"), *GAP_COLUMNS, F.lit(True).alias("_gap"))
    return rows.join(known, "label", "left").select(
        "label", "tags", F.col("_gap").isNull().alias("pinned"), *GAP_COLUMNS, "spec_rank"
    )


def spec_tags(specs: DataFrame) -> DataFrame:
    return specs.select("label", F.explode("tags").alias("tag")).distinct()


def anchor_tracks(
    plays: DataFrame, artist_tags: DataFrame, specs: DataFrame,
    params: Params = DEFAULTS, by: Sequence[str] = (),
) -> DataFrame:
    """Recent favourites by artists that carry any tag of the spec.

    An artist with three of the tags is one row per spec, so time is not tripled.
    """
    hours = (
        trailing_months(plays, params.anchor_window_months, by)
        .where(F.col("track_uri").isNotNull())
        .groupBy(*by, "artist_name", "track_name", "track_uri")
        .agg((F.sum("played_seconds") / 3600.0).alias("hours"))
    )
    serving = artist_tags.where(
        F.col("is_genre") & (F.col("tag_count") >= params.min_tag_count_for_anchor)
    ).join(spec_tags(specs), "tag").select("label", "artist_name").distinct()
    order = [F.desc("hours"), F.asc("track_uri")]
    per_artist = top_k(
        hours.join(serving, "artist_name"), [*by, "label", "artist_name"], order, params.tracks_per_artist
    )
    ranked = top_k(per_artist, [*by, "label"], order, params.anchor_tracks, rank="anchor_rank")
    return ranked.select(*by, "label", "artist_name", "track_name", "track_uri", "hours", "anchor_rank")


def gap_candidates(
    recommendations: DataFrame, plays: DataFrame, candidate_tags: DataFrame, specs: DataFrame,
    by: Sequence[str] = (),
) -> DataFrame:
    """Recommended strangers that carry any tag of the spec, once per spec."""
    library = plays.where(F.col("artist_name").isNotNull()).select(*by, "artist_name").distinct().select(
        *by, fold_name(F.col("artist_name")).alias("name_key")
    )
    serving = candidate_tags.join(spec_tags(specs), "tag").select("label", "mbid").distinct()
    strangers = recommendations.select(*by, "artist_name", "mbid", "score").withColumn(
        "name_key", fold_name(F.col("artist_name"))
    ).join(library, [*by, "name_key"], "left_anti")
    return strangers.join(serving, "mbid").select(*by, "label", "artist_name", "name_key", "mbid", "score")


def credited_tracks(artist_tracks: DataFrame) -> DataFrame:
    """Found tracks on which the requested artist is really credited, featured
    credits included; tracks without a uri are dropped.

    Each requested name gets the list of credit spellings that fold to its key,
    so the tracks themselves are neither exploded nor folded.
    """
    usable = artist_tracks.where(F.col("track_uri").isNotNull())
    credits = usable.select(F.explode("artists").alias("credit")).distinct().withColumn(
        "name_key", fold_name(F.col("credit")))
    requested = usable.select("artist_name").distinct().withColumn(
        "name_key", fold_name(F.col("artist_name")))
    spellings = requested.join(credits, "name_key").groupBy("artist_name", "name_key").agg(
        F.collect_set("credit").alias("_spellings"))
    return usable.join(spellings, "artist_name").where(F.arrays_overlap("artists", "_spellings")).select(
        "name_key", "artist_name", "rank", "track_name", "track_uri")


def choose_tracks(
    candidates: DataFrame, tracks: DataFrame, genre_recordings: DataFrame, specs: DataFrame,
    params: Params = DEFAULTS, by: Sequence[str] = (),
) -> DataFrame:
    """Up to ``tracks_per_artist`` songs per candidate, on-genre ones first,
    search order within, editions of one song folded before the cap.

    Titles are folded for the candidates' own tracks and recordings only.
    """
    one = [*by, "label", "mbid"]
    wanted = candidates.select("label", "mbid").distinct()
    on_genre = (
        genre_recordings.withColumnRenamed("artist_mbid", "mbid")
        .join(spec_tags(specs), "tag").join(wanted, ["label", "mbid"])
        .select("label", "mbid", "title").distinct()
        .select("label", "mbid", title_key(F.col("title")).alias("song"))
        .where(F.col("song") != "")
        # Counting keeps the distinct above in place: Spark would drop it below
        # a second distinct and fold every row.
        .groupBy("label", "mbid", "song").agg(F.count(F.lit(1)).alias("_hits"))
    )
    found = candidates.select(*one, "artist_name", "score", "name_key").join(
        tracks.select("name_key", "rank", "track_name", "track_uri"), "name_key"
    ).withColumn("song", title_key(F.col("track_name")))
    songs = first_per_key(
        found, [*one, "song"], [F.col("rank"), F.col("track_uri")]
    ).join(on_genre, ["label", "mbid", "song"], "left").withColumn(
        "genre_matched", F.col("_hits").isNotNull()
    )
    order = [F.desc("genre_matched"), F.asc("rank"), F.asc("track_uri")]
    return top_k(songs, one, order, params.tracks_per_artist, rank="choice").select(
        *one, "artist_name", "score", "choice", "track_name", "track_uri", "genre_matched"
    )


def discovery_tracks(
    chosen: DataFrame, anchors: DataFrame, params: Params = DEFAULTS, by: Sequence[str] = ()
) -> DataFrame:
    """Chosen songs in candidate order, each uri once and none of the anchors.
    A dropped repeat is not refilled from the same artist."""
    order = [F.desc("score"), F.asc("mbid"), F.asc("choice")]
    place = [(-F.col("score")), F.col("mbid"), F.col("choice")]
    fresh = first_per_key(chosen, [*by, "label", "track_uri"], place).join(
        anchors.select(*by, "label", "track_uri"), [*by, "label", "track_uri"], "left_anti"
    )
    return top_k(fresh, [*by, "label"], order, params.playlist_size, rank="discovery_rank").select(
        *by, "label", "discovery_rank", "artist_name", "mbid", "track_name", "track_uri", "genre_matched"
    )


def _place(n: Column, i: Column, j: Column, size: int) -> tuple[Column, Column]:
    """Sort keys of anchor ``i`` and discovery track ``j`` (from 0) with ``n``
    anchors: anchors every ``step`` places, discovery in the gaps."""
    step = F.when(n > 0, F.greatest(F.lit(1), F.floor(F.lit(size) / F.greatest(n, F.lit(1))))).otherwise(size)
    gap = F.greatest(step - 1, F.lit(1))
    spaced = F.floor(j / gap) * step + j % gap + 1
    return i * step, F.when((n > 0) & (step > 1) & (j < n * (step - 1)), spaced).otherwise(j + n)


def interleave(
    anchors: DataFrame, discovery: DataFrame, size: int, by: Sequence[str] = ()
) -> DataFrame:
    """One list per playlist, positions from 0.  A pool that runs dry lets the
    other go on; nothing repeats.

    ``anchors`` has ``anchor_rank`` and ``discovery`` has ``discovery_rank``, both
    from 1.  Anchors past ``size`` are cut.  A uri in both pools stays an anchor.
    """
    one = [*by, "label"]
    anchors = anchors.where(F.col("anchor_rank") <= size)
    shown = [c for c in ("artist_name", "track_name", "track_uri") if c in anchors.columns and c in discovery.columns]
    seen = Window.partitionBy(*one)
    rest = discovery.join(anchors.select(*one, "track_uri"), [*one, "track_uri"], "left_anti")
    rest = rest.withColumn("_j", F.row_number().over(seen.orderBy("discovery_rank")) - 1)
    counts = anchors.groupBy(*one).agg(F.count(F.lit(1)).alias("_n"))
    a_key, _ = _place(F.col("_n"), F.col("anchor_rank") - 1, F.lit(0), size)
    _, d_key = _place(F.coalesce("_n", F.lit(0)), F.lit(0), F.col("_j"), size)
    rows = anchors.join(counts, one).select(*one, *shown, F.lit("anchor").alias("slot"), a_key.alias("_k")).unionByName(
        rest.join(counts, one, "left").select(*one, *shown, F.lit("discovery").alias("slot"), d_key.alias("_k"))
    )
    return top_k(rows, one, [F.asc("_k")], size, rank="position").withColumn(
        "position", F.col("position") - 1).drop("_k")


def build_playlists(
    plays: DataFrame, artist_tags: DataFrame, recommendations: DataFrame, candidate_tags: DataFrame,
    artist_tracks: DataFrame, genre_recordings: DataFrame, specs: DataFrame,
    params: Params = DEFAULTS, by: Sequence[str] = (),
) -> DataFrame:
    anchors = anchor_tracks(plays, artist_tags, specs, params, by)
    found = gap_candidates(recommendations, plays, candidate_tags, specs, by)
    chosen = choose_tracks(found, credited_tracks(artist_tracks), genre_recordings, specs, params, by)
    return interleave(anchors, discovery_tracks(chosen, anchors, params, by), params.playlist_size, by)


def archive_rows(playlists: DataFrame, run_date: str, playlist_ids: DataFrame | None = None) -> DataFrame:
    """Playlist rows in the archive shape, for ``sources.tables.append_archive``."""
    ids = playlist_ids if playlist_ids is not None else playlists.select("label").distinct().withColumn(
        "playlist_id", F.lit(None).cast("string"))
    return playlists.join(ids, "label", "left").select(
        F.lit(run_date).alias("run_date"), F.lit("selection").alias("kind"), F.col("label").alias("gap_tag"),
        "playlist_id", F.col("position").cast("int").alias("position"), "slot", "artist_name",
        "track_name", "track_uri",
        F.when(F.col("slot") == "anchor", "plays").otherwise("recommendations").alias("source"),
    )
