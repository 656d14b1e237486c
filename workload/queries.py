"""Registered queries: one Spark plan and, where SQL can say it, its DuckDB twin.

Doubles are rounded on both sides because the engines add in different orders.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earshift.functions.frames import rounded
from earshift.functions.text import pretty, sentence, tag_family, with_folded
from earshift.operators import (
    consolidate as con,
    credits as crd,
    events as ev,
    metrics as met,
    outlook as out,
    playlists as pl,
    profiles as prof,
    quality as qual,
    resolve as res,
    trends as tr,
)
from earshift.plans import feeds
from earshift.sources import exports, logs, overrides, payloads, tables
from earshift.sources.tables import work_dir
from earshift.streaming import live, supersede as sup, trendfeed

from .adapters import Tables
from .oracles import fold, genre, title, with_views

cloudpickle.register_pickle_by_value(sys.modules[__name__])

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(needs: str | None = None, sql: str | None = None, **instead: str):
    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_views(needs or "", sql, **instead)
        return f
    return register


# ---- events ---------------------------------------------------------------

CONTENT = ("ts", "platform", "ms_played", "artist_name", "track_uri", "episode_uri", "reason_end", "skipped")


@query("raw", f"""SELECT {', '.join(CONTENT)}, min(source_file) AS source_file FROM raw GROUP BY ALL""")
def play_dedupe(t):
    """The export listed twice, the second time under another file name."""
    once = t.plays_raw().select(*CONTENT, "source_file")
    twice = once.unionByName(once.withColumn("source_file", F.concat(F.lit("z"), "source_file")))
    return ev.dedupe_events(twice, CONTENT)


@query("plays", "SELECT ts, track_uri, artist_name, ms_played, played_seconds, month FROM plays")
def real_listens(t):
    return t.plays().select("ts", "track_uri", "artist_name", "ms_played", "played_seconds", "month")


@query("raw polled", """
    SELECT ts, track_uri, ms_played, source_file, false AS ms_played_estimated, month, NULL::VARCHAR AS track_artists FROM raw
    UNION ALL SELECT DISTINCT ts, track_uri, ms_played, 'api-poll', true, date_trunc('month', ts)::DATE, track_artists
    FROM polled WHERE ts > (SELECT max(ts) FROM raw)""")
def reconcile_polled(t):
    return ev.reconcile(t.plays_raw(titles=True), t.polled()).select(
        "ts", "track_uri", "ms_played", "source_file", "ms_played_estimated", "month", "track_artists")


@query("raw polled", """
    SELECT m AS cutoff, count(*) AS polled_total, count(*) FILTER (ts <= m) AS superseded,
           count(*) FILTER (ts > m) AS kept FROM polled, (SELECT max(ts) AS m FROM raw) GROUP BY m""")
def reconcile_stats(t):
    return ev.reconcile_stats(t.plays_raw(), t.polled())


@query("plays", """SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS residual FROM (
    SELECT count(*) AS n FROM plays GROUP BY ts, ms_played, track_uri)""")
def residual_dups(t):
    return prof.residual_duplicates(t.plays())


@query("raw", """SELECT content_type, count(*) AS n_rows, round(sum(played_seconds) / 3600, 7) AS hours
    FROM raw GROUP BY content_type""")
def content_profile(t):
    return rounded(prof.content_profile(t.plays_raw()), hours=7)


@query("raw", """SELECT count(*) AS raw_rows, count(track_uri) AS music_rows,
    count(*) FILTER (track_uri IS NOT NULL AND ms_played >= 30000) AS plays_rows,
    count(*) FILTER (track_uri IS NOT NULL AND ms_played < 30000) AS dropped_rows,
    round(100.0 * count(*) FILTER (track_uri IS NOT NULL AND ms_played < 30000) / count(track_uri), 6) AS dropped_pct
    FROM raw""")
def filter_loss(t):
    return rounded(prof.filter_loss(t.plays_raw()), dropped_pct=6)


@query("plays", """SELECT CAST(year(ts) AS INTEGER) AS year, round(sum(played_seconds) / 3600, 7) AS hours,
    count(*) AS plays, count(DISTINCT artist_name) AS artists FROM plays GROUP BY 1""")
def listening_by_year(t):
    return rounded(prof.listening_by_year(t.plays()), hours=7)


@query("plays", """SELECT artist_name, round(sum(played_seconds) / 3600, 7) AS hours, count(*) AS plays
    FROM plays GROUP BY 1 ORDER BY sum(played_seconds) DESC, 1 LIMIT 10""")
def top_artists(t):
    return rounded(prof.top_artists(t.plays()), hours=7)


@query("plays", """SELECT count(*) AS plays, round(sum(played_seconds) / 3600, 7) AS hours,
    count(DISTINCT artist_name) AS artists, count(DISTINCT track_uri) AS tracks, count(DISTINCT month) AS months,
    min(ts) AS first_ts, max(ts) AS last_ts FROM plays""")
def headline(t):
    return rounded(prof.headline(t.plays()), hours=7).select(
        "plays", "hours", "artists", "tracks", "months", "first_ts", "last_ts")


@query("raw polled", """SELECT 'export' AS "table", count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts FROM raw
    UNION ALL SELECT 'polled', count(*), min(ts), max(ts) FROM polled""")
def poll_status(t):
    return prof.poll_status(t.plays_raw(), t.polled())


# ---- credits --------------------------------------------------------------

CREDIT_SQL = """SELECT track_uri, artist_name, credit_type, '{}' AS credit_source, n_plays,
    round(played_seconds, 3) AS played_seconds, count(*) OVER (PARTITION BY track_uri) AS n_performers FROM {}"""


def _credits(df):
    return rounded(df, played_seconds=3).select(
        "track_uri", "artist_name", "credit_type", "credit_source", "n_plays", "played_seconds", "n_performers")


@query("plays", r"""
    WITH t AS (SELECT track_uri, min(track_name) AS title, min(artist_name) AS lead, count(*) AS n_plays,
                      round(sum(played_seconds), 3) AS played_seconds FROM plays GROUP BY track_uri),
    named AS (SELECT *, lead AS artist_name, 'album_artist' AS credit_type FROM t
        UNION ALL SELECT * FROM (SELECT *, trim(unnest(string_split_regex(
            regexp_extract(title, '[(\[](?:feat\.?|with) ([^)\]]+)', 1, 'i'), ' & '))) AS artist_name, 'featured' FROM t)
        WHERE artist_name <> '' AND artist_name <> lead)
    SELECT track_uri, artist_name, credit_type, 'export' AS credit_source, n_plays, played_seconds,
           count(*) OVER (PARTITION BY track_uri) AS n_performers FROM named""")
def track_credits_title(t):
    """Credits parsed from titles."""
    return _credits(t.full_credits())


POLLED_CREDITS = """
    SELECT DISTINCT ON (track_uri, artist_name) track_uri, artist_name,
        CASE WHEN pos = 1 THEN 'album_artist' ELSE 'featured' END AS credit_type, n_plays, played_seconds
    FROM (SELECT track_uri, n_plays, played_seconds, unnest(names) AS artist_name, generate_subscripts(names, 1) AS pos
          FROM (SELECT track_uri, count(*) AS n_plays, sum(ms_played / 1000) AS played_seconds,
                       string_split(max(track_artists), chr(31)) AS names FROM polled GROUP BY track_uri))
    ORDER BY track_uri, artist_name, pos"""


@query("polled", f"""SELECT *, 'poller' AS credit_source, count(*) OVER (PARTITION BY track_uri) AS n_performers
    FROM ({POLLED_CREDITS})""")
def track_credits_polled(t):
    """Credits from the poller's performer lists."""
    polled = t.polled().withColumn("played_seconds", F.col("ms_played") / 1000.0)
    return _credits(crd.track_credits(polled))


@query("crs", """SELECT artist_name FROM crs WHERE credit_type = 'featured'
    EXCEPT SELECT artist_name FROM crs WHERE credit_type = 'album_artist'""")
def featured_only(t):
    return crd.featured_only(t.full_credits())


@query("crs", """
    SELECT count(*) AS n_rows, count(DISTINCT artist_name) AS n_artists,
        count(DISTINCT artist_name) FILTER (credit_type = 'album_artist') AS n_album,
        count(DISTINCT artist_name) FILTER (credit_type = 'featured') AS n_featured,
        (SELECT count(*) FROM (SELECT artist_name FROM crs WHERE credit_type = 'featured'
         EXCEPT SELECT artist_name FROM crs WHERE credit_type = 'album_artist')) AS n_featured_only,
        count(DISTINCT track_uri) AS n_tracks,
        (SELECT round(sum(played_seconds), 3) FROM (SELECT DISTINCT track_uri, played_seconds FROM crs
         WHERE credit_type = 'featured')) AS featured_seconds
    FROM crs""")
def credits_profile(t):
    return rounded(crd.credits_profile(t.full_credits()), featured_seconds=3).select(
        "n_rows", "n_artists", "n_album", "n_featured", "n_featured_only", "n_tracks", "featured_seconds")


@query("crs", """SELECT artist_name, round(sum(played_seconds) / 3600, 7) AS hours, count(*) AS n_tracks
    FROM crs WHERE credit_type = 'featured' GROUP BY 1""")
def featured_ranking(t):
    return rounded(crd.featured_ranking(t.full_credits()), hours=7)


@query("hrs", "SELECT artist_name, round(listening_hours, 7) AS listening_hours FROM hrs")
def artist_hours(t):
    return rounded(crd.artist_hours(t.full_credits()), listening_hours=7)


# ---- trends ---------------------------------------------------------------

@query("wts", "SELECT artist_name, tag, round(tag_weight, 9) AS tag_weight FROM wts")
def tag_weights(t):
    return rounded(t.weights(), tag_weight=9)


@query("split", """SELECT variant, month, artist_name, round(sum(secs * part), 7) AS credited_seconds
    FROM split GROUP BY ALL""")
def credit_split(t):
    """Time handed to each performer per month and variant."""
    wide = tr.artist_month(t.plays(), t.credits())
    return wide.select("month", "artist_name", tr._per_variant(tr.DEFAULTS)).select(
        "_v.variant", "month", "artist_name", F.round("_v.tag_seconds", 7).alias("credited_seconds"))


@query("tm", "SELECT variant, month, tag, round(tag_seconds, 5) AS tag_seconds, n_artists FROM tm")
def tag_month(t):
    return rounded(tr.tag_month(t.plays(), t.credits(), t.weights()), tag_seconds=5)


@query("shr", """SELECT variant, tag, month, CAST(i AS INTEGER) AS month_idx, round(tag_seconds, 5) AS tag_seconds,
    n_artists FROM shr""")
def tag_grid(t):
    return rounded(tr.tag_grid(t.plays(), t.credits(), t.weights()), tag_seconds=5).drop("n_months")


@query("shr", "SELECT variant, tag, month, round(share, 9) AS share FROM shr")
def tag_share(t):
    grid = tr.tag_grid(t.plays(), t.credits(), t.weights())
    return rounded(tr.with_share(grid), share=9).select("variant", "tag", "month", "share")


@query("smo", "SELECT variant, tag, month, round(smoothed_share, 9) AS smoothed_share FROM smo")
def smoothed_share(t):
    grid = tr.tag_grid(t.plays(), t.credits(), t.weights())
    return rounded(tr.with_smoothing(tr.with_share(grid)), smoothed_share=9).select(
        "variant", "tag", "month", "smoothed_share")


@query("slp", """SELECT variant, tag, round(slope, 9) AS slope, round(mean_recent_share, 9) AS mean_recent_share
    FROM slp""")
def tag_slopes(t):
    return rounded(t.trends(), slope=9, mean_recent_share=9).select(
        "variant", "tag", "slope", "mean_recent_share").distinct()


TREND_ROUND = dict(
    share=9, smoothed_share=9, tag_seconds=5, slope=9, slope_pp_per_year=6, rel_change_per_year=6, mean_recent_share=9)


@query("trd", """SELECT variant, tag, month, round(share, 9) AS share, round(smoothed_share, 9) AS smoothed_share,
    round(tag_seconds, 5) AS tag_seconds, n_artists, round(slope, 9) AS slope,
    round(slope_pp_per_year, 6) AS slope_pp_per_year, round(rel_change_per_year, 6) AS rel_change_per_year,
    round(mean_recent_share, 9) AS mean_recent_share, trend_class FROM trd""")
def tag_trends(t):
    return rounded(t.trends(), **TREND_ROUND)


@query("crd wts raw", """
    WITH l AS (SELECT o_custkey AS user_id, raw.* FROM raw JOIN orders ON o_orderkey = l_orderkey
               WHERE track_uri IS NOT NULL AND ms_played >= 30000),
    s AS (SELECT user_id, month, artist_name, secs, rw / sum(rw) OVER (PARTITION BY user_id, ts, track_uri) AS part
          FROM (SELECT user_id, month, ts, l.track_uri, crd.artist_name, played_seconds AS secs,
                       CASE credit_type WHEN 'album_artist' THEN 1.0 ELSE 0.5 END AS rw
                FROM l JOIN crd ON crd.track_uri = l.track_uri)),
    f AS (SELECT user_id, month, tag, sum(secs * part * tag_weight) AS x, count(DISTINCT s.artist_name) AS a
          FROM s JOIN wts ON wts.artist_name = s.artist_name GROUP BY ALL)
    SELECT user_id, tag, month, round(coalesce(x, 0), 7) AS tag_seconds, coalesce(a, 0) AS n_artists,
           round(coalesce(x, 0) / sum(x) OVER (PARTITION BY user_id, month), 9) AS share
    FROM (SELECT DISTINCT user_id, tag FROM f) JOIN (SELECT DISTINCT user_id, month FROM l) USING (user_id)
    LEFT JOIN f USING (user_id, tag, month)""")
def listener_trends(t):
    """The flagship for every listener at once."""
    d = t.trends(by=("user_id",)).where(F.col("variant") == "with_features")
    return rounded(d, share=9, tag_seconds=7).select(
        "user_id", "tag", "month", "tag_seconds", "n_artists", "share")


@query("now", """SELECT tag, month, round(smoothed_share, 9) AS smoothed_share,
    round(slope_pp_per_year, 6) AS slope_pp_per_year, trend_class FROM now""")
def latest_shares(t):
    return rounded(tr.latest_slice(t.trends()), smoothed_share=9, slope_pp_per_year=6).select(
        "tag", "month", "smoothed_share", "slope_pp_per_year", "trend_class")


@query("slp trd", """SELECT DISTINCT tag, trend_class, round(rel_change_per_year, 6) AS rel_change_per_year,
    round(slope_pp_per_year, 6) AS slope_pp_per_year, round(mean_recent_share, 9) AS mean_recent_share
    FROM trd WHERE variant = 'with_features' AND trend_class = 'rising'
    ORDER BY abs(rel_change_per_year) DESC, tag LIMIT 10""")
def latest_movers(t):
    return rounded(prof.movers(t.trends(), "rising"), rel_change_per_year=6, slope_pp_per_year=6, mean_recent_share=9)


@query("trd", """SELECT count(DISTINCT tag) AS tags, count(DISTINCT month) AS months,
    count(DISTINCT tag) FILTER (trend_class = 'rising') AS rising,
    count(DISTINCT tag) FILTER (trend_class = 'declining') AS declining,
    count(DISTINCT tag) FILTER (trend_class = 'flat') AS flat,
    count(DISTINCT tag) FILTER (trend_class = 'negligible') AS negligible
    FROM trd WHERE variant = 'with_features'""")
def trend_summary(t):
    return prof.trend_summary(t.trends())


@query("trd now", """
    SELECT u.tag AS riser, round(u.slope_pp_per_year, 6) AS riser_pp, d.tag AS faller,
           round(d.slope_pp_per_year, 6) AS faller_pp,
           (SELECT round(max(smoothed_share), 9) FROM trd WHERE variant = 'with_features' AND tag = d.tag) AS faller_peak
    FROM (SELECT * FROM now ORDER BY slope_pp_per_year DESC, tag DESC LIMIT 1) u,
         (SELECT * FROM now ORDER BY slope_pp_per_year, tag LIMIT 1) d""")
def trend_story(t):
    return rounded(prof.story(t.trends()), riser_pp=6, faller_pp=6, faller_peak=9).select(
        "riser", "riser_pp", "faller", "faller_pp", "faller_peak")


# ---- behaviour and coverage -----------------------------------------------

@query("plays", """SELECT m AS month, count(*) AS new_artists FROM (
    SELECT min(month) AS m FROM plays WHERE artist_name IS NOT NULL GROUP BY artist_name) GROUP BY m""")
def discovery_rate(t):
    return met.discovery_rate(t.plays())


@query("plays", """
    SELECT CAST(year(m) AS INTEGER) AS year, round(avg(n), 6) AS avg_new, CAST(sum(n) AS BIGINT) AS total_new,
           year(m) = min(year(min(m))) OVER () AS first_year
    FROM (SELECT m, count(*) AS n FROM (SELECT min(month) AS m FROM plays WHERE artist_name IS NOT NULL
          GROUP BY artist_name) GROUP BY m) GROUP BY year(m)""")
def discovery_by_year(t):
    return rounded(met.discovery_by_year(met.discovery_rate(t.plays())), avg_new=6)


@query("plays", """
    SELECT CAST(yr AS INTEGER) AS year, any_value(n) AS artists, any_value(k) AS top_1pct_size,
           round(sum(secs) FILTER (place <= k) / sum(secs), 9) AS top_1pct_share,
           round(sum(secs) / 3600, 7) AS total_hours
    FROM (SELECT *, count(*) OVER (PARTITION BY yr) AS n,
                 greatest(1, (count(*) OVER (PARTITION BY yr) + 99) // 100) AS k,
                 row_number() OVER (PARTITION BY yr ORDER BY secs DESC) AS place
          FROM (SELECT year(ts) AS yr, artist_name, sum(played_seconds) AS secs FROM plays
                WHERE artist_name IS NOT NULL GROUP BY ALL)) GROUP BY yr""")
def repeat_concentration(t):
    return rounded(met.repeat_concentration(t.plays()), top_1pct_share=9, total_hours=7)


LISTENER_SQL = """
    SELECT CAST(yr AS INTEGER) AS year, any_value(n) AS artists, any_value(k) AS top_1pct_size,
           round(sum(secs) FILTER (place <= k) / sum(secs), 9) AS top_1pct_share, round(sum(secs) / 3600, 7) AS total_hours
    FROM (SELECT *, count(*) OVER (PARTITION BY yr) AS n, greatest(1, (count(*) OVER (PARTITION BY yr) + 99) // 100) AS k,
                 row_number() OVER (PARTITION BY yr ORDER BY secs DESC) AS place
          FROM (SELECT year(ts) AS yr, o_custkey AS who, sum(CAST(floor(ms_played / 15000) AS BIGINT) * 15.0) AS secs
                FROM plays JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)) GROUP BY yr"""


@query("plays", LISTENER_SQL)
def listener_concentration(t):
    """The same measure over listeners in place of artists: thousands a year, so that
    the cut falls inside, and time in steps of 15 seconds, so that many tie at it."""
    steps = F.floor(F.col("ms_played") / 15000.0) * 15.0
    d = t.plays(listeners=True).withColumns({"artist_name": F.col("user_id").cast("string"), "played_seconds": steps})
    return rounded(met.repeat_concentration(d), top_1pct_share=9, total_hours=7)


@query("raw crd wts", """
    SELECT tag, round(sum(tag_weight), 6) AS weighted_plays, round(sum(tag_weight) FILTER (skip), 6) AS weighted_skips,
           round(sum(tag_weight) FILTER (skip) / sum(tag_weight), 9) AS skip_rate,
           round(sum(ms_played / 1000 * tag_weight) / 3600, 7) AS hours
    FROM (SELECT track_uri, ms_played, skipped OR reason_end IN ('fwdbtn', 'endplay') AS skip FROM raw
          WHERE content_type = 'music') m
    JOIN crd ON crd.track_uri = m.track_uri AND credit_type = 'album_artist'
    JOIN wts ON wts.artist_name = crd.artist_name GROUP BY tag HAVING sum(tag_weight) >= 50""")
def skip_rate(t):
    return rounded(met.skip_rate(t.plays_raw(), t.credits(), t.weights()),
                   weighted_plays=6, weighted_skips=6, skip_rate=9, hours=7)


@query("plays crd wts", """SELECT round(100 * sum(played_seconds) FILTER (track_uri IN (
        SELECT track_uri FROM crd WHERE artist_name IN (SELECT artist_name FROM wts))) / sum(played_seconds), 6)
    AS pct_tagged FROM plays""")
def tag_coverage(t):
    return rounded(met.tag_coverage(t.plays(), t.credits(), t.weights()), pct_tagged=6)


@query("hrs res", """SELECT coalesce(status, 'never_attempted') AS status, round(sum(listening_hours), 7) AS hours,
    round(100 * sum(listening_hours) / (SELECT sum(listening_hours) FROM hrs), 6) AS pct
    FROM hrs LEFT JOIN res USING (artist_name) GROUP BY 1""")
def resolution_coverage(t):
    d = met.coverage_by_status(crd.artist_hours(t.full_credits()), t.resolution())
    return rounded(d, hours=7, pct=6)


@query("hrs res tags", """SELECT round(100 * sum(h) FILTER (status = 'resolved') / sum(h), 6) AS pct_resolved,
    round(100 * sum(h) FILTER (status = 'resolved' AND n_tags > 0) / sum(h), 6) AS pct_any_tag,
    round(100 * sum(h) FILTER (artist_name IN (SELECT artist_name FROM tags WHERE is_genre)) / sum(h), 6) AS pct_genre_tag
    FROM (SELECT artist_name, listening_hours AS h FROM hrs) LEFT JOIN res USING (artist_name)""")
def coverage_summary(t):
    d = met.coverage_summary(crd.artist_hours(t.full_credits()), t.resolution(), t.artist_tags())
    return rounded(d, pct_resolved=6, pct_any_tag=6, pct_genre_tag=6)


@query("hrs tags", """SELECT CAST((h >= 0.5)::INT + (h >= 2)::INT + (h >= 10)::INT + (h >= 50)::INT AS INTEGER) AS tier,
    count(*) AS artists, round(100.0 * count(*) FILTER (g) / count(*), 6) AS pct_tagged,
    round(coalesce(sum(h) FILTER (NOT g), 0), 7) AS untagged_hours
    FROM (SELECT listening_hours AS h, artist_name IN (SELECT artist_name FROM tags WHERE is_genre) AS g FROM hrs)
    GROUP BY 1""")
def coverage_by_tier(t):
    d = met.coverage_by_tier(crd.artist_hours(t.full_credits()), t.artist_tags())
    return rounded(d, pct_tagged=6, untagged_hours=7)


@query("tags", """SELECT tag, count(DISTINCT artist_name) AS n_artists FROM tags WHERE is_genre GROUP BY tag""")
def tags_by_artists(t):
    return met.tags_by_artists(t.artist_tags())


# ---- resolution -----------------------------------------------------------

@query("art", """
    SELECT artist_name, CASE WHEN bal < 0 THEN 'ambiguous' ELSE 'resolved' END AS status,
           CASE WHEN bal >= 0 THEN CASE WHEN bal <= 2000 THEN 'mb-' WHEN bal <= 5000 THEN 'the-' ELSE 'mb-' END || artist_id END AS mbid,
           CAST(CASE WHEN bal < 0 THEN 100 WHEN bal > 2000 AND bal <= 5000 THEN 70 ELSE 82 END AS INTEGER) AS score,
           CASE WHEN bal < 0 THEN 'Reg ' || artist_name WHEN bal > 2000 AND bal <= 5000 THEN 'The ' || artist_name
                ELSE upper(artist_name) END AS matched_name,
           CAST(3 AS INTEGER) AS n_candidates FROM art
    UNION ALL SELECT n_name, 'not_found', NULL, NULL, NULL, 0 FROM nation""")
def resolve_artists(t):
    return res.resolve_artists(t.names_to_resolve(), t.resolver_candidates()).select(
        "artist_name", "status", "mbid", "score", "matched_name", "n_candidates")


@query("res art", f"""
    WITH o AS (SELECT artist_name, s.bal, CASE WHEN s.nation % 2 = 1 AND s.bal < 4000 THEN 'pin-' || artist_id END AS pin,
                      s.nation % 2 = 0 AND s.bal < 2000 AS ign,
                      CASE WHEN s.bal > 3000 THEN {genre('nation + 3')} || ',' || {genre('nation + 1')} END AS hand
               FROM art s WHERE nation < 10)
    SELECT res.artist_name, CASE WHEN ign OR pin IS NOT NULL OR hand IS NOT NULL THEN 'override' ELSE 'musicbrainz' END AS source,
           CASE WHEN ign THEN 'ignored' WHEN pin IS NOT NULL AND o.bal > 0 THEN 'resolved' WHEN pin IS NOT NULL THEN 'error'
                ELSE status END AS status,
           CASE WHEN ign THEN NULL ELSE coalesce(pin, mbid) END AS mbid,
           CASE WHEN hand IS NOT NULL THEN hand WHEN ign OR (pin IS NOT NULL AND o.bal <= 0) THEN ''
                WHEN pin IS NOT NULL THEN {genre('res.nation')}
                WHEN n_tags = 0 THEN '' ELSE array_to_string([{', '.join(genre(f'res.nation + {k}') for k in range(10))}], ',') END AS tags
    FROM res LEFT JOIN o USING (artist_name)""")
def override_apply(t):
    d = res.apply_overrides(t.resolutions(), t.artist_overrides(), t.vocabulary(), t.lookups())
    return d.select("artist_name", "source", "status", "mbid",
                    F.array_join(F.transform("tags", lambda x: x["tag"]), ",").alias("tags"))


@query("res hrs", """SELECT artist_name, status, round(listening_hours, 7) AS listening_hours
    FROM res LEFT JOIN hrs USING (artist_name) WHERE status <> 'ignored' AND (status <> 'resolved' OR n_tags = 0)""")
def review_list(t):
    d = res.review_list(t.resolution(), crd.artist_hours(t.full_credits()))
    return rounded(d, listening_hours=7).select("artist_name", "status", "listening_hours")


@query("res", f"""
    SELECT artist_name, mbid, {genre('nation + k')} AS tag, CAST(40 - 15 * k AS BIGINT) AS tag_count,
           {genre('nation + k')} IN (SELECT {genre('n_nationkey')} FROM nation) AS is_genre
    FROM res, (SELECT unnest(range(10)) AS k) WHERE n_tags > 0""")
def artist_tag_rows(t):
    return res.artist_tags(t.resolutions(), t.vocabulary()).select("artist_name", "mbid", "tag", "tag_count", "is_genre")


RELEASE_SQL = f"""SELECT mbid, {genre('nation + l_partkey % 4')} AS tag,
    CAST(sum(CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE l_partkey % 5 END) AS BIGINT) AS cnt
    FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN art ON artist_id = l_suppkey GROUP BY ALL"""


@query("art", f"""SELECT mbid, tag, cnt AS "count" FROM ({RELEASE_SQL})""")
def release_group_tags(t):
    return res.release_group_tags(t.release_tags())


@query("res art", f"""
    SELECT artist_name, CASE WHEN rel.tags IS NULL THEN 'musicbrainz' ELSE 'musicbrainz-release-group' END AS source,
           CASE WHEN n_tags > 0 THEN array_to_string([{', '.join(genre(f'res.nation + {k}') for k in range(10))}], ',')
                ELSE coalesce(rel.tags, '') END AS tags
    FROM res LEFT JOIN (SELECT mbid, string_agg(tag, ',' ORDER BY cnt DESC, tag) AS tags FROM ({RELEASE_SQL}) GROUP BY mbid) rel
         ON rel.mbid = res.mbid AND status = 'resolved' AND n_tags = 0""")
def backfill_tags(t):
    d = res.backfill_tags(t.resolutions(), t.release_tags())
    return d.select("artist_name", "source", F.array_join(F.transform("tags", lambda x: x["tag"]), ",").alias("tags"))


@query("hrs res art", """SELECT artist_name, round(listening_hours, 7) AS listening_hours FROM hrs LEFT JOIN res USING (artist_name)
    WHERE (status IS NULL OR status IN ('ambiguous', 'not_found'))
      AND artist_name NOT IN (SELECT artist_name FROM art WHERE nation < 10)""")
def worklist(t):
    d = res.worklist(crd.artist_hours(t.full_credits()), t.resolution(), t.artist_overrides(),
                     retry=("ambiguous", "not_found"))
    return rounded(d, listening_hours=7).drop("status")


# ---- outlook --------------------------------------------------------------

@query("taste", "SELECT tag, round(taste, 9) AS taste FROM taste")
def taste_vector(t):
    return rounded(out.taste_vector(t.trends()), taste=9)


# Queries that need a result several times write it once, as a production run
# would write its stage tables.

def _credits_of(t):
    return t.staged("credits", lambda: crd.track_credits(t.log()))


def _trends(t):
    return t.staged("trends", lambda: tr.tag_trends(t.log(), t.credits(), t.weights()))


def _seeds(t):
    return out.seeds(t.log(), _credits_of(t), t.resolution())


def _candidates(t):
    return t.staged("shortlist", lambda: out.candidates(_seeds(t), t.edges(), t.resolution(), _credits_of(t)))


def _recommend(t):
    return out.recommend(_candidates(t), t.candidate_tags(), out.taste_vector(_trends(t)))


def _gaps(t):
    return out.genre_gaps(_trends(t), _credits_of(t), t.weights())


@query("seed", "SELECT artist_name, seed_mbid, round(weight, 9) AS weight, CAST(seed_rank AS INTEGER) AS seed_rank FROM seed")
def seeds(t):
    return rounded(_seeds(t), weight=9)


@query("cand", """SELECT mbid, artist_name, comment, round(score, 6) AS score, n_seeds, via_artists FROM cand""")
def candidates(t):
    return rounded(_candidates(t), score=6).withColumn("via_artists", F.array_join("via_artists", ", "))


REC_SQL = """SELECT artist_name, mbid, comment, round(score, 9) AS score, round(similarity, 9) AS similarity,
    round(trajectory_fit, 9) AS trajectory_fit, array_to_string(why, ', ') AS matched_genres, via_artists, n_seeds FROM rec"""


@query("rec", REC_SQL)
def recommend(t):
    return rounded(out.as_text(_recommend(t)), score=9, similarity=9, trajectory_fit=9)


@query("rec", REC_SQL + " WHERE regexp_matches(array_to_string(why, ', '), '\\bhouse\\b', 'i')")
def recommendations_for_genre(t):
    d = out.recommendations_for(_recommend(t), "house", word=True)
    return rounded(out.as_text(d), score=9, similarity=9, trajectory_fit=9)


@query("fc", """SELECT tag, round(share_now, 9) AS share_now, round(share_future, 9) AS share_future, trend_class,
    round(slope, 9) AS slope, CAST(horizon_months AS INTEGER) AS horizon_months, round(change, 9) AS change FROM fc""")
def forecast(t):
    return rounded(out.forecast(t.trends()), share_now=9, share_future=9, slope=9, change=9)


@query("fc", """SELECT tag, round(share_now, 9) AS share_now, round(share_future, 9) AS share_future,
    round(change, 9) AS change FROM fc WHERE share_now > 0.005 OR share_future > 0.005
    ORDER BY abs(fc.change) DESC, tag LIMIT 8""")
def projected_movers(t):
    d = out.projected_movers(out.forecast(t.trends()))
    return rounded(d, share_now=9, share_future=9, change=9).select("tag", "share_now", "share_future", "change")


@query("gap", """SELECT tag, round(share_now, 9) AS share_now, round(rel_change_per_year, 6) AS rel_change_per_year,
    trend_class, n_artists, round(hours, 7) AS hours, round(gap_score, 9) AS gap_score,
    round(hours_per_artist, 7) AS hours_per_artist FROM gap""")
def genre_gaps(t):
    return rounded(_gaps(t), share_now=9, rel_change_per_year=6, hours=7, gap_score=9, hours_per_artist=7)


@query("gap rec", """SELECT tag, artist_name, mbid, round(score, 9) AS score FROM (
    SELECT g.tag, r.*, row_number() OVER (PARTITION BY g.tag ORDER BY r.score DESC, r.mbid) AS place
    FROM (SELECT tag FROM gap ORDER BY gap_score DESC, tag LIMIT 8) g JOIN rec r ON list_contains(r.why, g.tag))
    WHERE place <= 2""")
def gap_recommendations(t):
    d = out.gap_recommendations(_gaps(t), _recommend(t))
    return rounded(d, score=9).select("tag", "artist_name", "mbid", "score")


@query("cand cvec now", """
    SELECT lam, mbid, round(sqrt(similarity) * fit, 9) AS score, round(fit, 9) AS trajectory_fit, n_seeds FROM (
        SELECT lam, mbid, sum(v.w * taste) AS fit FROM cvec v JOIN (
            SELECT lam, tag, w / sqrt(sum(w * w) OVER (PARTITION BY lam)) AS taste FROM (
                SELECT lam, tag, smoothed_share * (1 + lam * greatest(-0.9, least(2.0, coalesce(rel_change_per_year, 0)))) AS w
                FROM now, (VALUES (0.0::DOUBLE), (2.0), (5.0)) l(lam) WHERE smoothed_share > 0) WHERE w > 0) USING (tag)
        GROUP BY lam, mbid HAVING sum(v.w * taste) > 0)
    JOIN (SELECT *, score / max(score) OVER () AS similarity FROM cand) USING (mbid)""")
def rerank_lambda(t):
    """The dial: one stored shortlist ranked for three tilts."""
    short = _candidates(t)
    heads, lists = t.staged("heads", lambda: out.ranked_heads(short)), t.staged("postings", lambda: out.postings(short, t.candidate_tags()))
    base = t.staged("taste", lambda: out.taste_inputs(_trends(t)))
    each = [out.rerank(heads, lists, out.tilted(base, lam=lam)).withColumn("lam", F.lit(lam)) for lam in (0.0, 2.0, 5.0)]
    rows = each[0].unionByName(each[1]).unionByName(each[2])
    return rounded(rows, score=9, trajectory_fit=9).select("lam", "mbid", "score", "trajectory_fit", "n_seeds")


# ---- playlists ------------------------------------------------------------

def _specs(t):
    return t.staged("specs", lambda: pl.playlist_specs(_gaps(t)))


def _anchors(t, specs):
    return t.staged("anchors", lambda: pl.anchor_tracks(t.log(), t.artist_tags(), specs))


def _gap_candidates(t, specs):
    return t.staged("gap_candidates", lambda: pl.gap_candidates(
        _recommend(t), t.log(), t.candidate_tags(), specs))


def _chosen(t, specs):
    return pl.choose_tracks(
        _gap_candidates(t, specs), pl.credited_tracks(t.staged("artist_tracks", t.artist_tracks)), t.genre_recordings(), specs)


@query("spec", "SELECT label FROM spec")
def playlist_specs(t):
    return _specs(t).select("label")


@query("anchor", """SELECT label, artist_name, track_name, track_uri, round(hours, 7) AS hours,
    CAST(anchor_rank AS INTEGER) AS anchor_rank FROM anchor""")
def anchor_tracks(t):
    return rounded(_anchors(t, _specs(t)), hours=7)


@query("gcand", "SELECT label, artist_name, mbid, round(score, 9) AS score FROM gcand")
def gap_candidates(t):
    return rounded(_gap_candidates(t, _specs(t)), score=9).drop("name_key")


@query("supplied", f"""SELECT DISTINCT {fold('supplier')} AS name_key, supplier AS artist_name, l_partkey AS rank,
    track_name, track_uri FROM supplied WHERE track_uri IS NOT NULL AND (l_partkey % 2 = 0 OR supplier = artist_name)""")
def credited_tracks(t):
    return pl.credited_tracks(t.staged("artist_tracks", t.artist_tracks))


@query("chosen", """SELECT label, mbid, artist_name, CAST(choice AS INTEGER) AS choice, track_name, track_uri,
    genre_matched FROM chosen""")
def choose_tracks(t):
    return _chosen(t, _specs(t)).drop("score")


@query("disc", """SELECT label, CAST(discovery_rank AS INTEGER) AS discovery_rank, artist_name, mbid, track_name,
    track_uri, genre_matched FROM disc""")
def discovery_tracks(t):
    specs = _specs(t)
    return pl.discovery_tracks(_chosen(t, specs), _anchors(t, specs))


INTERLEAVE_SQL = """
    WITH c AS (SELECT label, count(*) AS n FROM anchor GROUP BY label),
    s AS (SELECT label, n, CASE WHEN n > 0 THEN greatest(1, 25 // n) ELSE 25 END AS step FROM (
            SELECT DISTINCT spec.label, coalesce(n, 0) AS n FROM spec LEFT JOIN c USING (label))),
    r AS (SELECT label, track_uri, 'anchor' AS slot, (anchor_rank - 1) * step AS k FROM anchor JOIN s USING (label)
        UNION ALL SELECT label, track_uri, 'discovery', CASE WHEN n > 0 AND step > 1 AND discovery_rank <= n * (step - 1)
            THEN (discovery_rank - 1) // (step - 1) * step + (discovery_rank - 1) % (step - 1) + 1
            ELSE discovery_rank - 1 + n END FROM disc JOIN s USING (label))
    SELECT label, slot, track_uri, CAST(p - 1 AS INTEGER) AS position FROM (
        SELECT *, row_number() OVER (PARTITION BY label ORDER BY k) AS p FROM r) WHERE p <= 25"""


@query("anchor disc", INTERLEAVE_SQL)
def interleave(t):
    specs = _specs(t)
    anchors = _anchors(t, specs)
    d = pl.interleave(anchors, pl.discovery_tracks(_chosen(t, specs), anchors), 25)
    return d.select("label", "slot", "track_uri", "position")


PINNED = ("soul", "house", "pop", "techno")


@query("anchor disc gap", INTERLEAVE_SQL.replace("track_uri, CAST(p - 1", "track_uri, label NOT IN (SELECT tag FROM gap) AS pinned, CAST(p - 1"),
       spec="SELECT unnest(" + str(list(PINNED)) + ") AS label")
def pinned_playlists(t):
    """The whole build from an override file, which names genres that are no gaps."""
    path = f"{work_dir(t.spark)}/playlists.csv"
    lines = [("# by hand", ""), *((p, "") for p in PINNED), ("one too many", "pop|soul")]
    t.spark.createDataFrame(lines, "label string, tags string").coalesce(1).write.option("header", True).csv(path)
    named, _ = overrides.playlist_overrides(t.spark, path)
    specs = t.staged("pinned", lambda: pl.playlist_specs(_gaps(t), named))
    d = pl.build_playlists(t.log(), t.artist_tags(), _recommend(t), t.candidate_tags(), t.staged("artist_tracks", t.artist_tracks),
                           t.genre_recordings(), specs)
    return d.join(specs.select("label", "pinned"), "label").select("label", "slot", "track_uri", "position", "pinned")


# ---- consolidation --------------------------------------------------------

@query("fam", "SELECT DISTINCT tag, family FROM fam")
def tag_families(t):
    return t.artist_tags().select("tag", tag_family(F.col("tag")).alias("family")).distinct()


@query("bal", """SELECT artist_name, CAST(rap_w AS DOUBLE) AS rap_w, CAST(edm_w AS DOUBLE) AS edm_w, rap_n, edm_n, n_tags,
    round(rap_share, 9) AS rap_share FROM bal""")
def family_balance(t):
    return rounded(con.family_weights(t.artist_tags()), rap_share=9).drop("name_key", "tag_notes")


@query("item_share", """SELECT DISTINCT array_to_string(artists, '|') AS artists, round(rap_share, 9) AS rap_share, reason
    FROM item_share""")
def track_share(t):
    d = con.score_credits(t.playlist_items(), con.family_weights(t.artist_tags()))
    return rounded(d, rap_share=9).select(F.array_join("artists", "|").alias("artists"), "rap_share", "reason")


@query("scored", """SELECT source, pos, track_uri, title_key, artist_key, round(rap_share, 9) AS rap_share, verdict,
    overridden FROM scored""")
def track_verdict(t):
    return rounded(t.scored(), rap_share=9).select(
        "source", "pos", "track_uri", "title_key", "artist_key", "rap_share", "verdict", "overridden")


@query("merged", "SELECT * FROM merged")
def consolidate(t):
    d = con.consolidate(t.whole_and_filtered()[0], t.scored(), ["A"], ["N", "R"])
    return d.select("title_key", "artist_key", "source", "pos", "track_uri")


@query("scored", """SELECT source, track_uri, track_name, round(rap_share, 3) AS rap_share,
    CASE WHEN reason = '' THEN 'ambiguous band' ELSE reason END AS reason, count(*) AS n
    FROM scored WHERE verdict = 'review' GROUP BY ALL""")
def consolidate_review(t):
    d = con.review_rows(t.scored())
    return d.groupBy("source", "track_uri", "track_name", "rap_share", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("scored", """SELECT source, verdict, count(*) AS n, count(*) FILTER (overridden) AS overridden
    FROM scored GROUP BY ALL""")
def verdict_counts(t):
    return con.verdict_counts(t.scored())


@query("scored", """SELECT CASE WHEN reason = '' THEN 'ambiguous band' ELSE split_part(reason, ':', 1) END AS reason,
    count(*) AS n FROM scored WHERE verdict = 'review' GROUP BY 1""")
def review_reasons(t):
    folded = t.staged("folded", lambda: con.with_song_key(con.fold_items(t.filtered())))
    return con.review_reasons(t.scored(folded))


@query("scored merged keyed", """SELECT offered, merged, offered - merged AS folded FROM
    (SELECT (SELECT count(*) FROM keyed WHERE source = 'A') + (SELECT count(*) FROM scored WHERE verdict = 'keep') AS offered,
            (SELECT count(*) FROM merged) AS merged)""")
def folded_count(t):
    whole = t.whole_and_filtered()[0]
    scored = t.scored()
    return con.folded_count(whole, scored, con.consolidate(whole, scored, ["A"], ["N", "R"]))


@query("scored", """
    SELECT verdict, source, pos, track_uri, round(rap_share, 9) AS rap_share FROM (
        (SELECT * FROM scored WHERE verdict = 'drop' AND NOT overridden ORDER BY rap_share, source, pos, track_uri LIMIT 10)
        UNION ALL
        (SELECT * FROM scored WHERE verdict = 'keep' AND NOT overridden ORDER BY rap_share DESC, source, pos, track_uri LIMIT 8))""")
def closest_calls(t):
    return rounded(con.closest_calls(t.scored()), rap_share=9).select("verdict", "source", "pos", "track_uri", "rap_share")


@query("keyed ov bal", f"""SELECT DISTINCT name AS artist_name FROM (
        SELECT unnest(artists) AS name FROM keyed WHERE source <> 'A'
        AND NOT EXISTS (SELECT 1 FROM ov WHERE ov.title_key = keyed.title_key AND ov.artist_key = keyed.artist_key))
    WHERE {fold('name')} NOT IN (SELECT {fold('artist_name')} FROM bal)""")
def missing_artists(t):
    return con.missing_artists(
        t.filtered(), con.family_weights(t.artist_tags()), t.consolidate_overrides())


@query("items", f"SELECT DISTINCT track_name, {title('track_name')} AS title_key, {fold('lead')} AS artist_key FROM items")
def song_keys(t):
    return con.with_song_key(t.playlist_items()).select("track_name", "title_key", "artist_key").distinct()


@query("", rf"""SELECT word, {fold("replace(word, 'ß', 'ss')")} AS name_key FROM (
    SELECT DISTINCT unnest(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+')) AS word FROM documents)
    WHERE regexp_matches(word, '[^\x00-\x7F]')""")
def fold_unicode(t):
    """Keys of all words outside ASCII in the documents."""
    words = t.read("documents").select(F.explode(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+")).alias("word"))
    odd = words.where(~F.col("word").rlike(r"\A\p{ASCII}*\z")).distinct()
    return with_folded(odd, name_key="word")


# ---- feeds ----------------------------------------------------------------

@query("trd", """
    SELECT month, band, round(sum(smoothed_share), 9) AS value FROM (
        SELECT month, smoothed_share, CASE WHEN tag IN (SELECT tag FROM trd WHERE variant = 'with_features' GROUP BY tag
                   ORDER BY sum(tag_seconds) DESC, tag LIMIT 8) THEN tag ELSE 'Other' END AS band
        FROM trd WHERE variant = 'with_features') GROUP BY ALL""")
def stacked_bands(t):
    return rounded(feeds.stacked_bands(_trends(t)), value=9)


PIVOT_TAGS = ("hip hop", "house", "techno", "soul", "ambient")


@query("trd", "SELECT month, " + ", ".join(
    f"round(avg(smoothed_share) FILTER (tag = '{g}') * 100, 2) AS \"{g}\"" for g in PIVOT_TAGS)
    + " FROM trd WHERE variant = 'with_features' GROUP BY month")
def trend_pivot(t):
    return feeds.trend_pivot(t.trends(), PIVOT_TAGS)


@query("trd", """SELECT variant, tag, month, round(share, 9) AS share FROM trd
    WHERE variant = 'with_features' AND month >= DATE '2000-01-01'
      AND tag IN (SELECT tag FROM trd WHERE variant = 'with_features' GROUP BY tag HAVING sum(tag_seconds) / 3600 >= 10)""")
def dashboard_slice(t):
    import datetime
    d = feeds.dashboard_slice(_trends(t), low=datetime.date(2000, 1, 1))
    return rounded(d, share=9).select("variant", "tag", "month", "share")


@query("trd", """SELECT tag, round(sum(tag_seconds) / 3600, 7) AS hours FROM trd WHERE variant = 'with_features' GROUP BY tag""")
def hours_per_tag(t):
    return rounded(prof.hours_per_tag(t.trends()), hours=7)


@query("slp now", """SELECT tag, trend_class, round(slope_pp_per_year, 6) AS pp, round(mean_recent_share, 9) AS mean_recent_share
    FROM now WHERE trend_class IN ('rising', 'declining') ORDER BY abs(slope_pp_per_year) DESC, tag LIMIT 12""")
def movers_chart(t):
    return rounded(feeds.movers_chart(t.trends()), pp=6, mean_recent_share=9)


@query("fc", """SELECT tag AS genre_tag, printf('%.1f%%', share_now * 100) AS now, printf('%.1f%%', share_future * 100) AS projected
    FROM fc""")
def forecast_text(t):
    from earshift.functions.text import percent
    fc = out.forecast(t.trends())
    return fc.select(F.col("tag").alias("genre_tag"), percent(F.col("share_now")).alias("now"),
                     percent(F.col("share_future")).alias("projected"))


@query("raw crd wts", """
    SELECT tag, round(sum(tag_weight * skip) / sum(tag_weight), 9) AS skip_rate
    FROM (SELECT track_uri, ms_played, (coalesce(skipped OR reason_end = 'fwdbtn', false))::INT AS skip FROM raw
          WHERE content_type = 'music') m
    JOIN crd ON crd.track_uri = m.track_uri AND credit_type = 'album_artist'
    JOIN wts ON wts.artist_name = crd.artist_name GROUP BY tag
    HAVING sum(tag_weight) >= 50 AND sum(ms_played / 1000 * tag_weight) / 3600 >= 20
    ORDER BY sum(tag_weight * skip) / sum(tag_weight) DESC, tag LIMIT 15""")
def skip_chart(t):
    d = feeds.skip_chart(met.skip_rate(t.plays_raw(), t.credits(), t.weights()))
    return rounded(d, skip_rate=9).select("tag", "skip_rate")


@query("tags", """SELECT DISTINCT tag, CASE tag WHEN 'uk garage' THEN 'UK garage' ELSE tag END AS label,
    upper(left(tag, 1)) || substr(tag, 2) AS heading FROM tags""")
def display_names(t):
    tag = F.col("tag")
    return t.artist_tags().select("tag").distinct().select("tag", pretty(tag).alias("label"), sentence(tag).alias("heading"))


@query("trd", f"""SELECT tag, month, round(share, 9) AS share, round(smoothed_share, 9) AS smoothed_share FROM trd
    WHERE variant = 'with_features' AND tag IN {PIVOT_TAGS}""")
def trajectories(t):
    return rounded(feeds.trajectories(t.trends(), PIVOT_TAGS), share=9, smoothed_share=9)


@query("gap", "SELECT tag, round(gap_score, 9) AS gap_score, n_artists FROM gap ORDER BY gap.gap_score DESC NULLS LAST, tag LIMIT 10")
def gaps_chart(t):
    return rounded(feeds.gaps_chart(_gaps(t)), gap_score=9).select("tag", "gap_score", "n_artists")


@query("plays", "SELECT year, round(100 * top_1pct_share, 4) AS pct FROM (" + LISTENER_SQL + ")")
def concentration_chart(t):
    steps = F.floor(F.col("ms_played") / 15000.0) * 15.0
    d = t.plays(listeners=True).withColumns({"artist_name": F.col("user_id").cast("string"), "played_seconds": steps})
    return rounded(feeds.concentration_chart(met.repeat_concentration(d)), pct=4)


@query("fc", """SELECT CASE tag WHEN 'uk garage' THEN 'UK garage' ELSE tag END AS genre, printf('%.1f%%', share_now * 100) AS now,
    printf('%.1f%%', share_future * 100) AS projected FROM fc ORDER BY share_future DESC NULLS LAST, tag LIMIT 12""")
def forecast_table(t):
    return feeds.forecast_table(out.forecast(t.trends())).select("genre", "now", "projected")


@query("rec", """SELECT tag, artist_name, mbid, round(score, 9) AS score FROM (
    SELECT tag, r.*, row_number() OVER (PARTITION BY tag ORDER BY r.score DESC, r.mbid) AS place
    FROM (SELECT DISTINCT mbid, unnest(why) AS tag FROM rec) JOIN rec r USING (mbid)) WHERE place <= 3""")
def best_per_tag(t):
    return rounded(feeds.best_per_tag(_recommend(t)), score=9).select("tag", "artist_name", "mbid", "score")


# ---- files written and read back --------------------------------------------

def _csv_of(t: Tables, df: DataFrame, name: str) -> str:
    path = f"{work_dir(t.spark)}/{name}.csv"
    df.coalesce(1).write.option("header", True).csv(path)  # files of this kind are written by hand, in one piece
    return path


@query("art", """
    SELECT artist_name, ident, CASE WHEN nation % 4 = 3 AND nation % 5 <> 0 THEN 'rejected' ELSE 'valid' END AS outcome, n_tags FROM (
        SELECT artist_name, nation, CASE nation % 4 WHEN 0 THEN NULL WHEN 1 THEN 'ignore' WHEN 2 THEN
                   lower(printf('%08X-0000-4000-8000-%012X', artist_id, nation)) ELSE 'what?' END AS ident,
               CASE WHEN nation % 4 = 3 THEN 0 WHEN nation % 5 = 0 THEN 2 ELSE 0 END AS n_tags FROM art)
    WHERE nation % 4 <> 0 AND NOT (nation % 4 = 3 AND nation % 5 = 0) OR (nation % 4 = 0 AND nation % 5 = 0)""")
def override_file(t):
    """Artist overrides written as a hand-kept CSV and read back: ids, IGNORE, tags,
    and ids that are none."""
    n = F.col("nation")
    ident = F.when(n % 4 == 1, "IGNORE").when(n % 4 == 2, F.format_string("%08X-0000-4000-8000-%012X", "artist_id", "nation")).when(n % 4 == 3, "what?")
    lines = t.artists().where(~((n % 4 == 3) & (n % 5 == 0))).select(
        "artist_name", F.coalesce(ident, F.lit("")).alias("mbid"), F.lit("by hand, \"quoted\"").alias("note"),
        F.when((n % 4 != 3) & (n % 5 == 0), "deep house | soul|").otherwise("").alias("tags"))
    valid, rejected = overrides.artist_overrides(t.spark, _csv_of(t, lines, "artists"))
    good = valid.select("artist_name", F.when(F.col("ignore"), "ignore").otherwise(F.col("mbid")).alias("ident"), F.lit("valid").alias("outcome"),
                        F.size("tags").alias("n_tags"))
    return good.unionByName(rejected.select("artist_name", F.col("mbid").alias("ident"), F.lit("rejected").alias("outcome"), F.lit(0).alias("n_tags")))


@query("trk", f"""
    SELECT title_key, artist_key, arg_max(decision, part_id) AS decision, false AS is_rejected FROM (
        SELECT {title('track_name')} AS title_key, {fold('artist_name')} AS artist_key, part_id,
               CASE part_id % 3 WHEN 0 THEN 'keep' ELSE 'drop' END AS decision FROM trk WHERE part_id % 7 <> 0 AND part_id % 2 = 0) GROUP BY 1, 2
    UNION ALL SELECT track_name, artist_name, 'Maybe', true FROM trk WHERE part_id % 7 = 0 AND part_id % 2 = 0""")
def decision_file(t):
    """Consolidation decisions as a CSV, the last line for a song winning."""
    k = F.col("part_id")
    lines = t.tracks().where(k % 2 == 0).orderBy("part_id").select(
        F.when(k % 7 == 0, "Maybe").when(k % 3 == 0, "KEEP").otherwise("drop").alias("decision"), "artist_name", "track_name", F.lit("").alias("note"))
    valid, rejected = overrides.consolidate_overrides(t.spark, _csv_of(t, lines, "songs"))
    return valid.select("title_key", "artist_key", "decision", F.lit(False).alias("is_rejected")).unionByName(rejected.select(
        F.col("track_name").alias("title_key"), F.col("artist_name").alias("artist_key"), "decision", F.lit(True).alias("is_rejected")))


@query("anchor disc", "SELECT run_date, gap_tag, slot, track_uri, position, source FROM (" + INTERLEAVE_SQL.replace(
    "SELECT label, slot, track_uri,", "SELECT label AS gap_tag, slot, track_uri, CASE slot WHEN 'anchor' THEN 'plays' ELSE 'recommendations' END AS source,", 1)
    + "), (VALUES ('2024-01-01'), ('2024-02-01')) d(run_date)")
def playlist_archive(t):
    """Two runs' playlists added to the archive and read back; a run without rows adds nothing."""
    specs = _specs(t)
    anchors = _anchors(t, specs)
    rows = t.staged("playlists", lambda: pl.interleave(anchors, pl.discovery_tracks(_chosen(t, specs), anchors), 25))
    path = f"{work_dir(t.spark)}/archive"
    for day in ("2024-01-01", "2024-02-01"):
        tables.append_archive(pl.archive_rows(rows, day), path)
    tables.append_archive(pl.archive_rows(rows.where("position < 0"), "2024-03-01"), path)
    return tables.read_archive(t.spark, path).select("run_date", "gap_tag", "slot", "track_uri", "position", "source")


@query("tags", "SELECT DISTINCT lower(tag) AS term FROM tags")
def vocabulary_file(t):
    """Genre terms, one a line, with blanks, capitals and repeats."""
    path = f"{work_dir(t.spark)}/terms"
    t.artist_tags().select(F.concat(F.lit("  "), F.initcap("tag"), F.lit(" ")).alias("value")).unionByName(
        t.spark.range(3).select(F.lit("   ").alias("value"))).write.text(path)
    return overrides.vocabulary(t.spark, path)


@query("", """SELECT l_returnflag AS name, count(*) AS n FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem) GROUP BY 1 HAVING count(*) <> 1
    UNION ALL SELECT 'missing', 0""")
def ambiguous_sources(t):
    """Wanted sources that no playlist or several have."""
    lists = t.read("lineitem").select(F.col("l_returnflag").alias("name"), "l_linestatus").distinct()
    return qual.ambiguous_sources(lists, ["A", "N", "R", "missing"])


@query("", """SELECT count(*) FILTER (l_linenumber % 3 = 0) AS null_artist_rows, count(*) FILTER (l_linenumber % 2 = 0) AS video_rows FROM lineitem""")
def log_warnings(t):
    n = F.col("l_linenumber")
    d = t.read("lineitem").select(F.when(n % 3 != 0, F.lit("x")).alias("artist_name"), F.when(n % 2 == 0, "video").otherwise("audio").alias("source_kind"))
    return qual.log_warnings(d)


@query("tags", "SELECT count(*) AS n_rows, count(*) FILTER (is_genre) AS n_genre_rows FROM tags")
def tag_row_counts(t):
    return met.tag_row_counts(t.artist_tags())


@query("", """SELECT 'x' AS "column", count(*) AS n FROM lineitem WHERE l_linenumber < 3
    UNION ALL SELECT 'y', count(*) FROM lineitem WHERE l_quantity > 40""")
def not_finite_rows(t):
    """Columns with values that are no numbers or have no end; z has none."""
    n = F.col("l_linenumber")
    d = t.read("lineitem").select(
        F.when(n == 1, float("nan")).when(n == 2, float("-inf")).otherwise(1.0).alias("x"),
        F.when(F.col("l_quantity") > 40, float("inf")).when(n == 3, F.lit(None)).otherwise(2.0).alias("y"), F.lit(0.5).alias("z"))
    return qual.not_finite(d, ("x", "y", "z")).select("column", "n")


# ---- payloads and logs ----------------------------------------------------

def _names(c):
    return F.transform(c, lambda n: F.struct(n.alias("name")))


@query("polled", """SELECT ts, artist_name, track_name, album_name, track_uri, track_artists, ms_played,
    true AS ms_played_estimated, 'poll' AS source_kind FROM polled""")
def polled_payload(t):
    """One recently-played page per play, flattened again."""
    artists = F.transform(F.split("track_artists", "\u001f"), lambda n: F.struct(n.alias("name")))
    page = F.array(F.struct(
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("played_at"),
        F.struct(F.col("track_uri").alias("uri"), F.col("track_name").alias("name"), F.col("ms_played").alias("duration_ms"),
                 artists.alias("artists"), F.struct(F.col("album_name").alias("name"), F.array(
                     F.struct(F.col("artist_name").alias("name"))).alias("artists")).alias("album")).alias("track"),
        F.struct(F.lit("album").alias("type")).alias("context"))).alias("items")
    return payloads.recently_played(t.polled().select(page)).select(
        "ts", "artist_name", "track_name", "album_name", "track_uri", "track_artists", "ms_played",
        "ms_played_estimated", "source_kind")


@query("items", "SELECT source, track_uri, track_name, array_to_string(artists, '|') AS artists, count(*) AS n FROM items GROUP BY ALL")
def playlist_payload(t):
    """One playlist page per item, flattened again."""
    page = F.array(F.struct(F.col("added_at"), F.struct(
        F.col("track_uri").alias("uri"), F.col("track_name").alias("name"), _names(F.col("artists")).alias("artists")).alias("item")))
    rows = payloads.playlist_items(t.playlist_items().select("source", page.alias("items")))
    return rows.groupBy("source", "track_uri", "track_name", F.array_join("artists", "|").alias("artists")).agg(
        F.count(F.lit(1)).alias("n"))


@query("edge", "SELECT seed_mbid, mbid, name, score, comment FROM edge")
def similar_payload(t):
    entry = F.array(F.struct(F.col("mbid").alias("artist_mbid"), "name", "score", "comment"))
    return payloads.similar_artists(t.edges().select("seed_mbid", entry.alias("similar")))


@query("art", f"""
    SELECT mbid, {genre('nation + k')} AS tag, CAST(k AS BIGINT) AS "count" FROM art, (SELECT unnest(range(3)) AS k)
    WHERE bal >= 0 OR {genre('nation + k')} IN (SELECT {genre('n_nationkey')} FROM nation)""")
def lookup_payload(t):
    """Curated genres for artists in credit; raw tags, with one unknown, for the rest."""
    tag = lambda k: F.struct(F.initcap(t.genre(F.col("nation") + k)).alias("name"), F.lit(k).cast("bigint").alias("count"))
    three = [tag(k) for k in range(3)]
    empty = F.array().cast("array<struct<name:string,count:bigint>>")
    odd = F.struct(F.lit("nonsense").alias("name"), F.lit(-4).cast("bigint").alias("count"))
    records = t.artists().select(
        "mbid", F.when(F.col("s_acctbal") >= 0, F.array(*three)).otherwise(empty).alias("genres"),
        F.array(*three, odd).alias("tags"))
    return payloads.lookup_tags(records, t.vocabulary())


@query("", """SELECT DISTINCT ON (l_partkey) l_partkey, l_shipdate, l_orderkey, l_linenumber FROM lineitem
    ORDER BY l_partkey, l_shipdate DESC, l_orderkey DESC, l_linenumber DESC""")
def log_latest(t):
    """Last record per part of the line table read as an append-only log."""
    seq = F.struct("l_shipdate", "l_orderkey", "l_linenumber")
    log = t.read("lineitem").select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", seq.alias("seq"))
    return logs.latest_per_key(log, ["l_partkey"]).drop("seq")


@query("raw polled", "SELECT max(ts) AS last_ts FROM (SELECT ts FROM raw UNION ALL SELECT ts FROM polled)")
def last_seen(t):
    return prof.last_seen(t.plays_raw(), t.polled())


@query("raw polled", """
    SELECT track_uri, coalesce(a, '') AS track_artists, count(*) AS n FROM raw LEFT JOIN (
        SELECT track_uri, max(track_artists) AS a FROM polled GROUP BY 1) USING (track_uri) GROUP BY ALL""")
def credit_repair(t):
    """All rows of a track take the performer list learned on any polled play."""
    repaired = live.with_listed_artists(t.plays_raw(), live.listed_artists(t.polled()))
    return repaired.groupBy("track_uri", F.coalesce("track_artists", F.lit("")).alias("track_artists")).agg(
        F.count(F.lit(1)).alias("n"))


@query("raw", "SELECT 2 * count(*) AS rows_read, (SELECT count(*) FROM (SELECT DISTINCT "
       + ", ".join(CONTENT) + " FROM raw)) AS raw_rows FROM raw")
def duplicates_dropped(t):
    once = t.plays_raw().select(*CONTENT, "source_file")
    twice = once.unionByName(once)
    return prof.duplicates_dropped(twice, ev.dedupe_events(twice, CONTENT)).drop("duplicates")


@query("res art", """SELECT artist_name, status FROM res
    UNION ALL SELECT artist_name, 'shared' FROM art WHERE artist_name NOT IN (SELECT artist_name FROM res)""")
def first_known(t):
    """The library's own answers, then a shared cache of every artist."""
    shared = t.artists().select("artist_name", F.lit("shared").alias("status"))
    return res.first_known([t.resolution().select("artist_name", "status"), shared])


# ---- quality --------------------------------------------------------------

@query("split wts tm", """
    SELECT variant, round(reachable, 3) AS reachable, round(attributed, 3) AS attributed FROM
        (SELECT variant, sum(secs * part) AS reachable FROM split
         WHERE artist_name IN (SELECT artist_name FROM wts) GROUP BY variant)
    JOIN (SELECT variant, sum(tag_seconds) AS attributed FROM tm GROUP BY variant) USING (variant)""")
def mass_balance(t):
    d = qual.mass_balance(t.plays(), t.credits(), t.weights(), t.trends())
    return rounded(d, reachable=3, attributed=3).select("variant", "reachable", "attributed")


@query("trd", """SELECT 'share' AS "column", count(*) AS n FROM trd WHERE isnan(share) OR isinf(share) HAVING count(*) > 0""")
def not_finite(t):
    return qual.not_finite(t.trends(), ("share", "smoothed_share", "tag_seconds")).select("column", "n")


@query("", """
    WITH a AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders),
    b AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 997 = 1 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders
          WHERE o_orderkey % 1009 <> 2 UNION ALL SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 1013 = 3)
    SELECT 'a' AS side, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL
    SELECT 'b' AS side, * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def rerun_difference(t):
    """Two runs of one table; the second changes some rows, loses some and repeats some."""
    base, key = work_dir(t.spark), F.col("o_orderkey")
    one = t.read("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    two = one.where(key % 1009 != 2).withColumn("o_totalprice", F.when(key % 997 == 1, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    two = two.unionByName(one.where(key % 1013 == 3))
    for df, name in ((one, "a"), (two, "b")):
        qual.write_digested(df, f"{base}/{name}", ["o_orderkey"], parts=64, fan=8)
    return qual.rerun_difference(t.spark, f"{base}/a", f"{base}/b", parts=64, fan=8)


# ---- export files ---------------------------------------------------------

LINE_EVENT = """strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ') AS ts, l_linestatus AS platform, CAST(l_quantity * 6000 AS BIGINT) AS ms_played,
    'Song ' || l_partkey AS track_name, 'Artist ' || l_suppkey AS artist_name,
    CASE WHEN l_linenumber < 5 THEN 't' || l_partkey END AS track_uri, CASE WHEN l_linenumber = 5 THEN 'e' || l_partkey END AS episode_uri,
    CASE WHEN l_linenumber = 6 THEN 'b' || l_partkey END AS audiobook_uri, l_returnflag AS reason_end, l_returnflag = 'R' AS skipped"""


FILE_EVENTS = 4000


def _arrays(batches):
    """(name, event) as JSON arrays (name, value) of at most ``FILE_EVENTS`` events of
    one name: files are put together where the rows are read."""
    held = {}
    for batch in batches:
        name = batch.column(0)
        for k in pc.unique(name).to_pylist():
            events = held.get(k, []) + batch.column(1).filter(pc.equal(name, k)).to_pylist()
            while len(events) >= FILE_EVENTS:
                yield pa.RecordBatch.from_pydict({"name": [k], "value": ["[" + ",".join(events[:FILE_EVENTS]) + "]"]})
                events = events[FILE_EVENTS:]
            held[k] = events
    for k, events in held.items():
        if events:
            yield pa.RecordBatch.from_pydict({"name": [k], "value": ["[" + ",".join(events) + "]"]})


def _export_folder(t: Tables, broken: bool = False) -> str:
    """The line table as export files, JSON arrays of some thousand events, the
    lines numbered 1 once more in files of their own.  The files are packed: as plain
    text they take some fifteen times the table's Parquet."""
    base = f"{work_dir(t.spark)}/export"
    n, uri = F.col("l_linenumber"), lambda letter: F.concat(F.lit(letter), "l_partkey")
    line = t.read("lineitem")
    event = F.to_json(F.struct(
        F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), F.col("l_linestatus").alias("platform"),
        (F.col("l_quantity") * 6000).cast("bigint").alias("ms_played"), F.lit("10.0.0.1").alias("ip_addr"),
        F.concat(F.lit("Song "), "l_partkey").alias("master_metadata_track_name"),
        F.concat(F.lit("Artist "), "l_suppkey").alias("master_metadata_album_artist_name"),
        F.when(n < 5, uri("t")).alias("spotify_track_uri"), F.when(n == 5, uri("e")).alias("spotify_episode_uri"),
        F.when(n == 6, uri("b")).alias("audiobook_uri"), F.col("l_returnflag").alias("reason_end"), (F.col("l_returnflag") == "R").alias("skipped")))
    names = F.when(n == 1, F.array(F.lit("0"), F.lit("1"))).otherwise(F.array(F.lit("0")))
    arrays = line.select(names.alias("names"), event.alias("event")).select(F.explode("names"), "event").mapInArrow(_arrays, "name string, value string")
    if broken:
        both = F.array("value", F.substring("value", 1, 200))
        arrays = arrays.select(F.explode(F.when(F.col("name") == "1", both).otherwise(F.array("value"))).alias("value"))
    arrays.select("value").write.options(maxRecordsPerFile=1, compression="gzip", **{"zlib.compress.level": "BEST_SPEED"}).text(base)
    jvm = t.spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(base)
    fs = where.getFileSystem(t.spark.sparkContext._jsc.hadoopConfiguration())
    for f in fs.listStatus(where):  # the export's file names
        if f.getPath().getName().startswith("part-"):
            fs.rename(f.getPath(), jvm.org.apache.hadoop.fs.Path(where, f"Streaming_History_Audio_{f.getPath().getName()[:-7]}.json.gz"))
    return base


PLAYED = ("ts", "platform", "ms_played", "track_name", "artist_name", "track_uri", "episode_uri", "audiobook_uri", "reason_end", "skipped",
          "content_type", "played_seconds", "month")


@query("", """
    SELECT source_kind, content_type, count(*) AS n, count(*) FILTER (is_first) AS in_first FROM (
        SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'video' ELSE 'audio' END AS source_kind, l_linenumber < 2 AS is_first,
               CASE WHEN l_linenumber < 5 THEN 'music' ELSE 'unknown' END AS content_type
        FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_quantity, l_shipdate FROM lineitem)) GROUP BY 1, 2""")
def export_kinds(t):
    """Audio and video files, one of them twice: an event keeps the lowest file name,
    and the kind goes with it."""
    base = f"{work_dir(t.spark)}/kinds"
    n = F.col("l_linenumber")
    event = F.to_json(F.struct(
        F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), (F.col("l_quantity") * 6000).cast("bigint").alias("ms_played"),
        F.format_string("%d of %d in %d", "l_partkey", "l_orderkey", "l_linenumber").alias("master_metadata_track_name"),
        F.when(n < 5, F.concat(F.lit("t"), "l_partkey")).alias("spotify_track_uri")))
    line = t.read("lineitem")
    names = F.when(n == 1, F.array(F.lit("Audio_0"), F.lit("Audio_1"))).when(n % 2 == 0, F.array(F.lit("Video_2"))).otherwise(F.array(F.lit("Audio_1")))
    arrays = line.select(names.alias("names"), event.alias("event")).select(F.explode("names"), "event").mapInArrow(_arrays, "name string, value string")
    arrays.select("name", "value").write.option("maxRecordsPerFile", 1).partitionBy("name").text(base)
    jvm = t.spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(base)
    fs = top.getFileSystem(t.spark.sparkContext._jsc.hadoopConfiguration())
    for folder in ("Audio_0", "Audio_1", "Video_2"):
        for k, f in enumerate(fs.listStatus(jvm.org.apache.hadoop.fs.Path(base, f"name={folder}"))):
            fs.rename(f.getPath(), jvm.org.apache.hadoop.fs.Path(base, f"Streaming_History_{folder}_{k}.json"))
        fs.delete(jvm.org.apache.hadoop.fs.Path(base, f"name={folder}"), True)
    plays = ev.normalise_plays(exports.read_export(t.spark, base))
    return plays.groupBy("source_kind", "content_type").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("source_file").contains("Audio_0"), 1)).alias("in_first"))


@query("", f"""SELECT DISTINCT CAST(strptime(ts, '%Y-%m-%dT%H:%M:%SZ') AS TIMESTAMP) AS ts, * EXCLUDE (ts), CASE WHEN track_uri IS NOT NULL THEN 'music'
        WHEN episode_uri IS NOT NULL THEN 'podcast' WHEN audiobook_uri IS NOT NULL THEN 'audiobook' ELSE 'unknown' END AS content_type,
        ms_played / 1000.0::DOUBLE AS played_seconds, CAST(date_trunc('month', strptime(ts, '%Y-%m-%dT%H:%M:%SZ')) AS DATE) AS month
    FROM (SELECT {LINE_EVENT} FROM lineitem)""")
def export_plays(t):
    return ev.normalise_plays(exports.read_export(t.spark, _export_folder(t))).select(*PLAYED)


@query("", """SELECT failed, CASE WHEN failed THEN 0 ELSE (SELECT count(*) + count(*) FILTER (l_linenumber = 1) FROM lineitem) END::BIGINT AS n_rows
    FROM (VALUES (true), (false)) AS v(failed)""")
def export_health(t):
    """Rows of whole files, and of files that are cut off."""
    h = exports.file_health(t.spark, _export_folder(t, broken=True))
    return h.groupBy("failed").agg(F.sum("n_rows").alias("n_rows"))


EXPORT_LINES = 4_000_000  # events that one writer puts into one file


def _as_array(batches):
    """Rows of one task as one JSON array, an element a line."""
    opened = False
    for batch in batches:
        lines = [("," if opened or i else "[") + v for i, v in enumerate(batch.column(0).to_pylist())]
        opened = opened or bool(lines)
        yield pa.RecordBatch.from_pydict({"value": lines})
    if opened:
        yield pa.RecordBatch.from_pydict({"value": ["]"]})


def _one_export_file(t: Tables, most: int = EXPORT_LINES) -> str:
    """The line table as one export file, an event a line, with braces, quotes and
    backslashes in the titles; every thirteenth event has fields nobody knows.  A
    file has one writer, so beyond ``most`` lines the export goes on under the same
    name in further folders: no task gets more lines, however large the table."""
    base = f"{work_dir(t.spark)}/one"
    odd = F.array(*[F.lit(x) for x in ODD_TITLES])
    n = F.col("l_linenumber")
    event = F.struct(
        F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), F.lit("10.0.0.1").alias("ip_addr"),
        (F.col("l_quantity") * 6000).cast("bigint").alias("ms_played"), F.concat(F.element_at(odd, n), F.col("l_partkey").cast("string")).alias(
            "master_metadata_track_name"), F.concat(F.lit("t"), "l_partkey").alias("spotify_track_uri"), (F.col("l_returnflag") == "R").alias("skipped"),
        F.when(F.col("l_orderkey") % 13 == 0, F.struct(F.array(F.struct(F.col("l_suppkey").alias("id"))).alias("by"), F.lit("}").alias("note"))).alias("extra"))
    line = t.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_returnflag")
    files = -(-max(1, line.count()) // most)
    dealt = line.repartitionById(files, F.pmod(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey"), F.lit(files)).cast("int"))
    dealt.select(F.to_json(event).alias("value")).mapInArrow(_as_array, "value string").write.text(f"{base}/parts")
    jvm = t.spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{base}/parts")
    fs = where.getFileSystem(t.spark.sparkContext._jsc.hadoopConfiguration())
    parts = [f.getPath() for f in fs.listStatus(where) if f.getPath().getName().startswith("part-")]
    for k, part in enumerate(parts):
        folder = jvm.org.apache.hadoop.fs.Path(f"{base}/export/volume={k}")
        fs.mkdirs(folder)
        fs.rename(part, jvm.org.apache.hadoop.fs.Path(folder, "Streaming_History_Audio_0.json"))
    return f"{base}/export"


ODD_TITLES = ("plain ", 'a "quote" ', "brace } { ", "back\\slash ", '"}, {"', "list [ ", "last ")
ODD_SQL = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in ODD_TITLES) + "]"


@query("", f"""SELECT l_shipdate AS ts, CAST(l_quantity * 6000 AS BIGINT) AS ms_played, {ODD_SQL}[l_linenumber] || l_partkey AS track_name,
    't' || l_partkey AS track_uri, l_returnflag = 'R' AS skipped, count(*) AS n FROM lineitem GROUP BY ALL""")
def export_split(t):
    """One file that several tasks read."""
    rows = exports.read_split_export(t.spark, _one_export_file(t))
    return rows.groupBy("ts", "ms_played", F.col("master_metadata_track_name").alias("track_name"), F.col("spotify_track_uri").alias("track_uri"), "skipped").agg(
        F.count(F.lit(1)).alias("n"))


@query("", """SELECT 'Streaming_History_Audio_0.json' AS source_file, count(*) AS n_rows, false AS failed,
    'OBJECT<extra: OBJECT<by: ARRAY<OBJECT<id: BIGINT>>, note: STRING>>' AS unknown FROM lineitem""")
def export_drift(t):
    """Rows, health and unknown fields, nested ones too, from one reading."""
    return exports.file_report(t.spark, _one_export_file(t))


# ---- streams --------------------------------------------------------------

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _events(t: Tables) -> DataFrame:
    schema = T.StructType.fromDDL(EVENTS)
    return live.stream_table(t.spark, f"{t.path}/events.parquet", schema)


def _streamed(t: Tables, df: DataFrame, key, mode: str, order=()) -> DataFrame:
    base = work_dir(t.spark)
    live.run_to_end(df, f"{base}/rows", f"{base}/checkpoint", mode)
    return live.read_upserts(t.spark, f"{base}/rows", df.schema, key, order)


def _as_stream(t: Tables, df: DataFrame, files: int, *by: str) -> DataFrame:
    """A table in mixed order, ``files`` micro-batches, each of as many files as let every core write."""
    base, each = f"{work_dir(t.spark)}/feed", -(-t.spark.sparkContext.defaultParallelism // files)
    df.repartition(files * each, F.xxhash64(*by)).write.parquet(base)
    return live.stream_table(t.spark, base, df.schema, files_per_trigger=each)


def _shuffled(t: Tables) -> DataFrame:
    """The events in mixed order over many files, one to a micro-batch."""
    return _as_stream(t, t.read("events").select(*T.StructType.fromDDL(EVENTS).fieldNames()), 6, "event_id")


@query("", """SELECT CAST(ts AS DATE) AS day, user_id, event_type, count(*) AS plays, round(sum(value), 4) AS secs
    FROM events GROUP BY ALL""")
def daily_rollup_stream(t):
    days = live.daily_rollup(_shuffled(t), ["user_id", "event_type"], seconds="value")
    return rounded(_streamed(t, days, ["day", "user_id", "event_type"], "update"), secs=4)


@query("", "SELECT user_id, event_type, min(ts) AS first_ts FROM events GROUP BY ALL")
def first_seen_stream(t):
    return _streamed(t, live.first_seen(_events(t), ["user_id", "event_type"]), ["user_id", "event_type"], "update")


@query("", "SELECT event_id, ts, user_id, event_type, value FROM events")
def stream_dedupe(t):
    """The feed delivered twice, each event kept once."""
    twice = _shuffled(t).unionByName(_events(t))
    once = live.dedupe_stream(twice, key=("event_id",)).select("event_id", "ts", "user_id", "event_type", "value")
    return _streamed(t, once, ["event_id"], "append")


@query("", """WITH cut AS (SELECT user_id, max(ts) AS cutoff FROM events WHERE event_id % 3 = 0 GROUP BY user_id)
    SELECT DISTINCT e.user_id, e.ts, e.event_type AS track_uri FROM events e LEFT JOIN cut USING (user_id)
    WHERE event_id % 3 <> 0 AND (cutoff IS NULL OR ts > cutoff)""")
def supersede_stream(t):
    """Two feeds as one stream, files one by one and in mixed order: polled events,
    some of them twice, and an export of every third event."""
    e = t.read("events").select("event_id", "user_id", "ts", F.col("event_type").alias("track_uri"))
    polled = e.where("event_id % 3 <> 0")
    polled = polled.unionByName(polled.where("event_id % 2 = 0")).drop("event_id")
    export = _as_stream(t, e.where("event_id % 3 = 0"), 3, "event_id")
    moved = sup.supersede_changes(export, _as_stream(t, polled, 4, "ts", "track_uri"), ["user_id"])
    rows = _streamed(t, moved, ["user_id", "ts", "track_uri"], "update", order=["step"])
    return rows.where(F.col("state") == sup.KEPT).select("user_id", "ts", "track_uri")


@query("trd", """SELECT variant, tag, month, round(share, 9) AS share, round(smoothed_share, 9) AS smoothed_share,
    round(tag_seconds, 5) AS tag_seconds, n_artists, round(slope, 9) AS slope, round(mean_recent_share, 9) AS mean_recent_share, trend_class
    FROM trd""")
def stream_trends(t):
    """The play log in mixed order, four micro-batches; trends kept up to date."""
    plays = t.plays().select("ts", "month", "track_uri", "played_seconds")
    feed = _as_stream(t, plays, 4, "ts", "track_uri")
    kept = trendfeed.TrendFeed(t.spark, f"{work_dir(t.spark)}/trends", plays.schema,
                               lambda: t.staged("credits", t.credits), t.staged("weights", t.weights))
    live.run_to_end(feed, kept.update, f"{work_dir(t.spark)}/checkpoint", "append")
    return rounded(kept.read(), share=9, smoothed_share=9, tag_seconds=5, slope=9, mean_recent_share=9).select(
        "variant", "tag", "month", "share", "smoothed_share", "tag_seconds", "n_artists", "slope", "mean_recent_share", "trend_class")


@query("plays", """SELECT user_id, month, count(*) AS new_artists FROM (
    SELECT o_custkey AS user_id, artist_name, min(month) AS month FROM plays JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
    GROUP BY ALL""")
def discovery_stream(t):
    """Discoveries per listener and month from a log in mixed order: an artist met
    earlier than was thought moves its discovery."""
    plays = t.plays(listeners=True).select("user_id", "artist_name", "month", "ts")
    feed = _as_stream(t, plays, 4, "ts", "artist_name")
    heard = feed.select("user_id", "artist_name", "month")
    changes, write = trendfeed.discovery_feed(t.spark, f"{work_dir(t.spark)}/discoveries", heard.schema)
    live.run_to_end(heard, write, f"{work_dir(t.spark)}/checkpoint", "append")
    return trendfeed.discoveries(changes, ["user_id"])


def _log_and_polls(t: Tables) -> DataFrame:
    """Plays of the export without performer lists, and polled plays with them."""
    names = ["ts", "month", "track_uri", "track_name", "artist_name", "track_artists", "played_seconds"]
    export = t.plays(titles=True).select(*names)
    polled = t.polled().where(F.substring("track_uri", 6, 20).cast("bigint") % 3 == 0).withColumns(
        {"month": F.trunc("ts", "month"), "played_seconds": F.col("ms_played") / 1000.0})
    return export.unionByName(polled.select(*names))


@query("plays polled crd", """
    WITH p AS (SELECT track_uri, false AS listed FROM plays
               UNION ALL SELECT track_uri, true FROM polled WHERE CAST(substr(track_uri, 6) AS BIGINT) % 3 = 0),
    n AS (SELECT track_uri, bool_or(listed) AS listed, count(*) AS n_plays FROM p GROUP BY track_uri),
    c AS (SELECT track_uri, count(*) AS names, count(DISTINCT artist_name) AS once FROM crd GROUP BY track_uri)
    SELECT CASE WHEN listed THEN 'poller' ELSE 'export' END AS credit_source, CASE WHEN listed THEN once ELSE names END AS n_performers,
           count(*) AS tracks, sum(n_plays)::BIGINT AS plays FROM n JOIN c USING (track_uri) GROUP BY ALL""")
def credit_repair_stream(t):
    """Credits from a mixed feed in which a third of the tracks get a performer
    list at some time; the trends of the months they feed move with them."""
    plays = _log_and_polls(t)
    feed, base = _as_stream(t, plays, 4, "ts", "track_uri", "track_artists"), work_dir(t.spark)
    credits = trendfeed.CreditFeed(t.spark, f"{base}/credits")
    trends = trendfeed.TrendFeed(t.spark, f"{base}/trends", plays.schema, lambda: credits.read(), t.staged("weights", t.weights))
    live.run_to_end(feed, trendfeed.repair_feed(trends, credits), f"{base}/checkpoint", "append")
    per_track = credits.read().groupBy("track_uri", "credit_source").agg(F.count(F.lit(1)).alias("n_performers"), F.max("n_plays").alias("n_plays"))
    return per_track.groupBy("credit_source", "n_performers").agg(F.count(F.lit(1)).alias("tracks"), F.sum("n_plays").alias("plays"))


@query("polled", """SELECT CAST(ts AS DATE) AS day, least(count(*), 50)::INTEGER AS n_items, count(*) >= 50 AS page_full
    FROM polled GROUP BY ALL""")
def poll_completeness(t):
    """Each day's polled plays as one poll page of at most 50, read as a stream."""
    page = t.polled().groupBy(F.to_date("ts").alias("day")).agg(F.slice(F.collect_list(F.struct("track_uri")), 1, 50).alias("items"))
    full = live.completeness(_as_stream(t, page, 3, "day"))
    return _streamed(t, full, ["day"], "append")


@query("", """SELECT user_id, event_type, max(ts) AS ts, arg_max(value, ts) AS value FROM events GROUP BY user_id, event_type""")
def log_reread(t):
    """A log written in four appends, oldest days first; the latest record per key."""
    path = f"{work_dir(t.spark)}/log"
    key = ["user_id", "event_type"]
    e = t.read("events").withColumn("round", F.pmod(F.dayofyear("ts"), F.lit(4)))
    schema = T.StructType.fromDDL("user_id bigint, event_type string, ts timestamp_ntz, value double")
    latest = lambda d: d.groupBy(*key).agg(F.max("ts").alias("ts"), F.max_by("value", "ts").alias("value"))
    done = None
    for k in range(4):
        done = e.where(F.col("round") <= k)
        logs.append_log(latest(done), path)
    return logs.read_latest(t.spark, path, schema, key).select(*key, "ts", "value")
