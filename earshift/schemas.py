"""Schemas of the inputs and the column contract of the main tables."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _B, _L = T.StringType(), T.BooleanType(), T.LongType()

# Fields of the play-history export.  ``ip_addr`` is known but
# left out of the read schema, so it never enters a DataFrame.
EXPORT = T.StructType([
    T.StructField("ts", _S),  # read as text; UTC without a zone after the scan
    T.StructField("platform", _S),
    T.StructField("ms_played", _L),
    T.StructField("conn_country", _S),
    T.StructField("master_metadata_track_name", _S),
    T.StructField("master_metadata_album_artist_name", _S),
    T.StructField("master_metadata_album_album_name", _S),
    T.StructField("spotify_track_uri", _S),
    T.StructField("episode_name", _S),
    T.StructField("episode_show_name", _S),
    T.StructField("spotify_episode_uri", _S),
    T.StructField("audiobook_title", _S),
    T.StructField("audiobook_uri", _S),
    T.StructField("audiobook_chapter_uri", _S),
    T.StructField("audiobook_chapter_title", _S),
    T.StructField("reason_start", _S),
    T.StructField("reason_end", _S),
    T.StructField("shuffle", _B),
    T.StructField("skipped", _B),
    T.StructField("offline", _B),
    T.StructField("offline_timestamp", _L),
    T.StructField("incognito_mode", _B),
])
PRIVATE_FIELDS = ("ip_addr",)
KNOWN_EXPORT_FIELDS = frozenset(EXPORT.fieldNames()) | frozenset(PRIVATE_FIELDS)

_SHORT_NAMES = {
    "master_metadata_track_name": "track_name",
    "master_metadata_album_artist_name": "artist_name",
    "master_metadata_album_album_name": "album_name",
    "spotify_track_uri": "track_uri",
    "spotify_episode_uri": "episode_uri",
}
EXPORT_RENAMES = {f: _SHORT_NAMES.get(f, f) for f in EXPORT.fieldNames()}
CONTENT_COLUMNS = tuple(EXPORT_RENAMES.values())
PLAYS_RAW_COLUMNS = (
    *CONTENT_COLUMNS, "source_file", "source_kind", "content_type", "played_seconds", "month",
    "ms_played_estimated", "track_artists",
)

_NAME = T.StructType([T.StructField("name", _S)])
_NAMES = T.ArrayType(_NAME)

RECENTLY_PLAYED = T.StructType([T.StructField("items", T.ArrayType(T.StructType([
    T.StructField("played_at", _S),
    T.StructField("track", T.StructType([
        T.StructField("uri", _S),
        T.StructField("name", _S),
        T.StructField("duration_ms", _L),
        T.StructField("artists", _NAMES),
        T.StructField("album", T.StructType([
            T.StructField("name", _S), T.StructField("artists", _NAMES)])),
    ])),
    T.StructField("context", T.StructType([T.StructField("type", _S)])),
])))])

PLAYLIST_PAGE = T.StructType([
    T.StructField("source", _S),
    T.StructField("items", T.ArrayType(T.StructType([
        T.StructField("added_at", _S),
        T.StructField("item", T.StructType([
            T.StructField("uri", _S), T.StructField("name", _S), T.StructField("artists", _NAMES)])),
    ]))),
])

_TAG_COUNTS = T.ArrayType(T.StructType([T.StructField("name", _S), T.StructField("count", _L)]))

SIMILAR_ARTISTS = T.StructType([
    T.StructField("seed_mbid", _S),
    T.StructField("similar", T.ArrayType(T.StructType([
        T.StructField("artist_mbid", _S), T.StructField("name", _S),
        T.StructField("score", T.DoubleType()), T.StructField("comment", _S)]))),
])

ARTIST_LOOKUP = T.StructType([
    T.StructField("mbid", _S), T.StructField("genres", _TAG_COUNTS), T.StructField("tags", _TAG_COUNTS),
])

RESOLUTION_LOG = T.StructType([
    T.StructField("artist_name", _S),
    T.StructField("source", _S),
    T.StructField("status", _S),
    T.StructField("mbid", _S),
    T.StructField("score", _L),
    T.StructField("matched_name", _S),
    T.StructField("n_candidates", _L),
    T.StructField("tags", T.ArrayType(T.StructType([
        T.StructField("tag", _S), T.StructField("count", _L)]))),
    T.StructField("note", _S),
    T.StructField("backfilled", _B),
])

ARCHIVE = T.StructType([
    T.StructField("run_date", _S),
    T.StructField("kind", _S),
    T.StructField("gap_tag", _S),
    T.StructField("playlist_id", _S),
    T.StructField("position", T.IntegerType()),
    T.StructField("slot", _S),
    T.StructField("artist_name", _S),
    T.StructField("track_name", _S),
    T.StructField("track_uri", _S),
    T.StructField("source", _S),
])

ARTIST_OVERRIDES = "artist_name string, mbid string, note string, tags string"
PLAYLIST_OVERRIDES = "label string, tags string"
CONSOLIDATE_OVERRIDES = "decision string, artist_name string, track_name string, note string"
