"""DuckDB SQL for every query that SQL can express on the given tables.

Written from the definitions, play by play, not from the Spark plans.
"""

from __future__ import annotations

from .adapters import GENRES

_GENRES = "[" + ", ".join(f"'{g}'" for g in GENRES) + "]"


def genre(i: str) -> str:
    return f"{_GENRES}[CAST(({i}) % {len(GENRES)} AS INTEGER) + 1]"


def fold(x: str) -> str:
    x = f"translate(coalesce({x}, ''), '$€£@!0', 'selaio')"
    return (rf"regexp_replace(regexp_replace(lower(strip_accents({x})), '\b(?:the|and)\b', '', 'g'), "
            "'[^a-z0-9]+', '', 'g')")


def title(x: str) -> str:
    head = rf"regexp_replace({x}, '\s+[-–—(\[].*$', '')"
    return f"coalesce(nullif({fold(head)}, ''), {fold(x)})"


# name -> (needs, SQL)
VIEWS: dict[str, tuple[str, str]] = {
    "lib": ("", "SELECT count(*) * 3 // 5 AS n FROM supplier"),
    "art": ("", "SELECT s_suppkey AS artist_id, s_name AS artist_name, 'mb-' || s_suppkey AS mbid, "
                "s_nationkey AS nation, s_acctbal AS bal FROM supplier"),
    "trk": ("lib art", """
        SELECT p_partkey AS part_id, p_size, p_size % 6 AS form, p_name AS album_name,
               CASE WHEN p_type <> 'PROMO' THEN 'part:' || p_partkey END AS track_uri,
               CASE WHEN p_type = 'PROMO' THEN 'part:' || p_partkey END AS episode_uri,
               h.artist_name, h.nation, f.artist_name AS feat, g.artist_name AS feat2,
               p_name || CASE p_size % 6
                   WHEN 0 THEN ' (feat. ' || f.artist_name || ')'
                   WHEN 1 THEN ' [with ' || f.artist_name || ' & ' || g.artist_name || ']'
                   WHEN 2 THEN ' - 2020 Remaster' WHEN 3 THEN ' (Radio Edit)' ELSE '' END AS track_name,
               CASE p_size % 6 WHEN 0 THEN [h.artist_name, f.artist_name]
                   WHEN 1 THEN [h.artist_name, f.artist_name, g.artist_name]
                   ELSE [h.artist_name] END AS performers
        FROM part, lib, art h, art f, art g
        WHERE h.artist_id = p_partkey % n AND f.artist_id = (p_partkey * 3 + 1) % n
          AND g.artist_id = (p_partkey * 7 + 3) % n"""),
    "raw0": ("trk", """
        SELECT l_shipdate AS ts, l_linestatus AS platform, l_orderkey, artist_name, track_name, album_name,
               track_uri, episode_uri, 'f' || l_linenumber AS source_file,
               CAST(round(l_quantity * 6000.0 * (1.0 + (nation - 12) / 12.0 * 0.95
                   * greatest((year(l_shipdate) - 2000) * 12 + month(l_shipdate) - 5, 0) / 18.0)) AS BIGINT)
                   AS ms_played,
               CASE WHEN l_linestatus = 'O' AND l_linenumber > 5 THEN 'fwdbtn' ELSE 'trackdone' END AS reason_end,
               CASE l_returnflag WHEN 'R' THEN true WHEN 'A' THEN false END AS skipped
        FROM lineitem JOIN trk ON l_partkey = part_id"""),
    "raw": ("raw0", """
        SELECT *, ms_played / 1000.0 AS played_seconds, CAST(date_trunc('month', ts) AS DATE) AS month,
               CASE WHEN track_uri IS NOT NULL THEN 'music' ELSE 'podcast' END AS content_type
        FROM raw0"""),
    "plays": ("raw", "SELECT * FROM raw WHERE track_uri IS NOT NULL AND ms_played >= 30000"),
    "crd": ("trk", """
        SELECT track_uri, artist_name, 'album_artist' AS credit_type FROM trk WHERE track_uri IS NOT NULL
        UNION ALL SELECT track_uri, feat, 'featured' FROM trk
            WHERE track_uri IS NOT NULL AND form <= 1 AND feat <> artist_name
        UNION ALL SELECT track_uri, feat2, 'featured' FROM trk
            WHERE track_uri IS NOT NULL AND form = 1 AND feat2 <> artist_name"""),
    "crs": ("crd plays", """
        SELECT crd.*, t.secs AS played_seconds, t.n AS n_plays FROM crd JOIN
            (SELECT track_uri, sum(played_seconds) AS secs, count(*) AS n FROM plays GROUP BY track_uri) t
            USING (track_uri)"""),
    "tags": ("art", f"""
        SELECT artist_name, mbid, {genre('nation + k')} AS tag, 40 - 15 * k AS tag_count,
               k <> 4 AND bal < 9500 AS is_genre
        FROM art, (SELECT unnest(range(10)) AS k)"""),
    "wts": ("tags", """
        SELECT artist_name, tag, (greatest(tag_count, 0) + 1) / sum(greatest(tag_count, 0) + 1)
                   OVER (PARTITION BY artist_name) AS tag_weight
        FROM (SELECT *, row_number() OVER (PARTITION BY artist_name ORDER BY tag_count DESC, tag) AS place
              FROM tags WHERE is_genre)
        WHERE place <= 8"""),
    "vars": ("", "SELECT * FROM (VALUES ('album_artist_only', 0.0), ('with_features', 0.5)) v(variant, fw)"),
    # One row per (variant, play, performer).
    "split": ("plays crd vars", """
        SELECT variant, ts, track_uri, month, artist_name, secs, rw / nullif(sum(rw) OVER (
                   PARTITION BY variant, ts, track_uri), 0) AS part
        FROM (SELECT variant, ts, p.track_uri, month, c.artist_name, played_seconds AS secs,
                     CASE WHEN credit_type = 'album_artist' THEN 1.0 ELSE fw END AS rw
              FROM vars, plays p JOIN crd c ON c.track_uri = p.track_uri)"""),
    "tm": ("split wts", """
        SELECT variant, month, tag, sum(secs * part * tag_weight) AS tag_seconds,
               count(DISTINCT split.artist_name) AS n_artists
        FROM split JOIN wts ON wts.artist_name = split.artist_name GROUP BY ALL"""),
    "grid": ("tm plays", """
        SELECT variant, tag, month, coalesce(tag_seconds, 0) AS tag_seconds, coalesce(n_artists, 0) AS n_artists
        FROM (SELECT * FROM (SELECT DISTINCT variant FROM tm), (SELECT DISTINCT tag FROM tm),
                            (SELECT DISTINCT month FROM plays))
        LEFT JOIN tm USING (variant, tag, month)"""),
    "shr": ("grid", """
        SELECT *, tag_seconds / nullif(sum(tag_seconds) OVER (PARTITION BY variant, month), 0) AS share,
               dense_rank() OVER (ORDER BY month) AS i FROM grid"""),
    "smo": ("shr", """
        SELECT *, avg(share) OVER (PARTITION BY variant, tag ORDER BY month
                                   ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS smoothed_share FROM shr"""),
    "slp": ("smo", """
        SELECT variant, tag, CASE WHEN count(smoothed_share) > 1 THEN regr_slope(smoothed_share, i) END AS slope,
               avg(smoothed_share) AS mean_recent_share
        FROM smo WHERE i > (SELECT max(i) - 12 FROM smo) GROUP BY variant, tag"""),
    "trd": ("smo slp", """
        SELECT variant, tag, month, share, smoothed_share, tag_seconds, n_artists, slope,
               slope * 1200 AS slope_pp_per_year, slope * 12 / nullif(mean_recent_share, 0) AS rel_change_per_year,
               mean_recent_share,
               CASE WHEN slope IS NULL OR mean_recent_share IS NULL THEN 'flat'
                    WHEN mean_recent_share < 0.005 THEN 'negligible'
                    WHEN slope * 12 / mean_recent_share > 0.15 THEN 'rising'
                    WHEN slope * 12 / mean_recent_share < -0.15 THEN 'declining' ELSE 'flat' END AS trend_class
        FROM smo JOIN slp USING (variant, tag)"""),
    "now": ("trd", """
        SELECT * FROM trd WHERE variant = 'with_features' AND month = (SELECT max(month) FROM trd)"""),
    "polled": ("trk", """
        SELECT l_shipdate + INTERVAL 180 DAY AS ts, 'poll' AS platform, CAST(240000 AS BIGINT) AS ms_played,
               artist_name, track_name, album_name, track_uri, array_to_string(performers, chr(31)) AS track_artists
        FROM lineitem JOIN trk ON l_partkey = part_id WHERE track_uri IS NOT NULL"""),
    "res": ("art lib", """
        SELECT artist_name, nation, artist_id, bal, CASE WHEN bal < 0 THEN 'ambiguous' WHEN bal >= 9500 THEN 'not_found'
                   WHEN bal >= 9000 THEN 'ignored' ELSE 'resolved' END AS status,
               CASE WHEN bal >= 0 AND bal < 9000 THEN mbid END AS mbid,
               CASE WHEN bal < 8000 THEN 10 ELSE 0 END AS n_tags
        FROM art, lib WHERE artist_id < n"""),
    "hrs": ("crs", "SELECT artist_name, sum(played_seconds) / 3600.0 AS listening_hours FROM crs GROUP BY 1"),
    "taste": ("now", """
        SELECT tag, w / sqrt(sum(w * w) OVER ()) AS taste FROM (
            SELECT tag, smoothed_share * (1 + 2.0 * greatest(-0.9, least(2.0, coalesce(rel_change_per_year, 0)))) AS w
            FROM now WHERE smoothed_share > 0) WHERE w > 0"""),
    "seed": ("plays crs res", """
        SELECT artist_name, seed_mbid, secs / sum(secs) OVER () AS weight,
               row_number() OVER (ORDER BY secs DESC, artist_name) AS seed_rank
        FROM (SELECT c.artist_name, r.mbid AS seed_mbid, sum(c.played_seconds) AS secs
              FROM plays p JOIN crs c USING (track_uri) JOIN res r ON r.artist_name = c.artist_name
              WHERE r.status = 'resolved' AND r.mbid IS NOT NULL
                AND p.month >= (SELECT max(month) - INTERVAL 18 MONTH FROM plays)
              GROUP BY 1, 2 ORDER BY secs DESC, c.artist_name LIMIT 120)"""),
    "edge": ("art lib", """
        SELECT 'mb-' || (l_partkey % n) AS seed_mbid, mbid, artist_name AS name, sum(l_quantity) AS score,
               'nation ' || nation AS comment
        FROM lineitem, lib, art WHERE artist_id = l_suppkey GROUP BY ALL"""),
    "cand": ("seed edge res crd", f"""
        SELECT e.mbid, max_by(name, seed_rank) AS artist_name, max_by(comment, seed_rank) AS comment,
               sum(score * weight) AS score, count(*) AS n_seeds,
               array_to_string(list(artist_name ORDER BY score DESC, seed_rank)[1:3], ', ') AS via_artists
        FROM edge e JOIN seed USING (seed_mbid)
        WHERE e.mbid NOT IN (SELECT mbid FROM res WHERE mbid IS NOT NULL)
          AND {fold('name')} NOT IN (SELECT {fold('artist_name')} FROM crd)
        GROUP BY e.mbid ORDER BY score DESC, e.mbid LIMIT 400"""),
    "ctag": ("tags", "SELECT mbid, tag, CAST(greatest(tag_count, 0) AS BIGINT) AS cnt FROM tags"),
    "cvec": ("ctag", """
        SELECT mbid, tag, place, (cnt + 1) / sqrt(sum((cnt + 1) * (cnt + 1)) OVER (PARTITION BY mbid)) AS w
        FROM (SELECT *, row_number() OVER (PARTITION BY mbid ORDER BY cnt DESC, tag) AS place FROM ctag)
        WHERE place <= 8"""),
    "fit": ("cvec taste", """
        SELECT mbid, sum(w * taste) AS trajectory_fit,
               list(tag ORDER BY w * taste DESC, place)[1:3] AS why
        FROM cvec JOIN taste USING (tag) GROUP BY mbid HAVING sum(w * taste) > 0"""),
    "rec": ("cand fit", """
        SELECT artist_name, mbid, comment, sqrt(similarity) * trajectory_fit AS score, similarity, trajectory_fit,
               why, via_artists, n_seeds
        FROM (SELECT *, score / max(score) OVER () AS similarity FROM cand) JOIN fit USING (mbid)"""),
    "fc": ("now", """
        SELECT tag, share_now, raw / sum(raw) OVER () AS share_future, trend_class, slope, 12 AS horizon_months,
               raw / sum(raw) OVER () - share_now AS change
        FROM (SELECT tag, smoothed_share AS share_now, coalesce(slope, 0) AS slope, trend_class,
                     greatest(smoothed_share + coalesce(slope, 0) * (SELECT sum(pow(0.92, k)) FROM range(12) r(k)), 0) AS raw
              FROM now)
        WHERE share_now > 0 OR raw > 0"""),
    "gap": ("now crs wts", """
        SELECT tag, smoothed_share AS share_now, coalesce(rel_change_per_year, 0) AS rel_change_per_year, trend_class,
               n_artists_all AS n_artists, hours,
               coalesce(rel_change_per_year, 0) * smoothed_share / n_artists_all AS gap_score,
               hours / n_artists_all AS hours_per_artist
        FROM now JOIN (SELECT tag, count(DISTINCT crs.artist_name) AS n_artists_all,
                              sum(played_seconds * tag_weight) / 3600 AS hours
                       FROM crs JOIN wts ON wts.artist_name = crs.artist_name GROUP BY tag) USING (tag)
        WHERE trend_class = 'rising'"""),
    "spec": ("gap", "SELECT tag AS label FROM gap ORDER BY gap_score DESC NULLS LAST, tag LIMIT 4"),
    "anchor": ("plays tags spec", """
        SELECT label, artist_name, track_name, track_uri, hours, anchor_rank FROM (
            SELECT *, row_number() OVER (PARTITION BY label ORDER BY hours DESC, track_uri) AS anchor_rank FROM (
                SELECT label, artist_name, track_name, track_uri, hours, row_number() OVER (
                           PARTITION BY label, artist_name ORDER BY hours DESC, track_uri) AS in_artist
                FROM spec, (SELECT artist_name, track_name, track_uri, sum(played_seconds) / 3600 AS hours FROM plays
                      WHERE month >= (SELECT max(month) - INTERVAL 18 MONTH FROM plays) GROUP BY 1, 2, 3) r
                WHERE EXISTS (SELECT 1 FROM tags t WHERE t.artist_name = r.artist_name AND t.is_genre
                              AND t.tag_count >= 1 AND t.tag = spec.label))
            WHERE in_artist <= 2)
        WHERE anchor_rank <= 6"""),
    "gcand": ("rec plays ctag spec", f"""
        SELECT label, artist_name, mbid, score FROM rec, spec
        WHERE {fold('artist_name')} NOT IN (SELECT {fold('artist_name')} FROM plays)
          AND EXISTS (SELECT 1 FROM ctag WHERE ctag.mbid = rec.mbid AND ctag.tag = label)"""),
    "supplied": ("trk art", """
        SELECT DISTINCT l_partkey, a.artist_name AS supplier, a.mbid AS smbid, a.nation AS snation, trk.*
        FROM lineitem JOIN trk ON l_partkey = part_id JOIN art a ON a.artist_id = l_suppkey"""),
    # A supplier is credited on its even parts only.
    "song": ("supplied gcand", f"""
        SELECT DISTINCT ON (label, mbid, song) * FROM (
            SELECT g.*, l_partkey AS rank, track_name, track_uri, {title('track_name')} AS song
            FROM gcand g JOIN supplied s ON s.supplier = g.artist_name
            WHERE track_uri IS NOT NULL AND l_partkey % 2 = 0)
        ORDER BY label, mbid, song, rank, track_uri"""),
    "chosen": ("song supplied", f"""
        SELECT * FROM (
            SELECT *, row_number() OVER (PARTITION BY label, mbid ORDER BY genre_matched DESC, rank) AS choice
            FROM (SELECT *, EXISTS (
                      SELECT 1 FROM (SELECT smbid, {genre('snation + l_partkey % 10')} AS tag,
                                            {title('album_name')} AS key FROM supplied) r
                      WHERE r.smbid = song.mbid AND r.tag = label AND r.key = song.song AND r.key <> '') AS genre_matched
                  FROM song))
        WHERE choice <= 2"""),
    "disc": ("chosen anchor", """
        SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, mbid, choice) AS discovery_rank FROM (
            SELECT *, row_number() OVER (PARTITION BY label, track_uri ORDER BY score DESC, mbid, choice) AS seen
            FROM chosen) c
        WHERE seen = 1 AND NOT EXISTS (
            SELECT 1 FROM anchor a WHERE a.label = c.label AND a.track_uri = c.track_uri)
        QUALIFY discovery_rank <= 25"""),
    "items": ("trk", """
        SELECT l_returnflag AS source, l_orderkey * 8 + l_linenumber AS pos, coalesce(track_uri, episode_uri) AS track_uri,
               track_name, performers AS artists, artist_name AS lead
        FROM lineitem JOIN trk ON l_partkey = part_id"""),
    "fam": ("tags", """
        SELECT *, CASE
            WHEN regexp_matches(tag, 'hip hop|hip-hop|rap|trap|drill|grime|crunk|g-funk|boom bap|turntablism') THEN 'rap'
            WHEN regexp_matches(tag, 'garage rock|garage punk|hardcore punk|post-hardcore|melodic hardcore|metalcore|deathcore|grindcore') THEN NULL
            WHEN regexp_matches(tag, 'house|techno|trance|dubstep|garage|drum and bass|dnb|jungle|breakbeat|breaks|big beat|electro|electronic|electronica|edm|bass|idm|hardstyle|gabber|hardcore|downtempo|synthwave|eurodance|rave|glitch|trip hop') THEN 'edm'
            END AS family FROM tags"""),
    "bal": ("fam", """
        SELECT artist_name, rap_w, edm_w, rap_n, edm_n, n_tags,
               CASE WHEN rap_w + edm_w = 0 THEN rap_n / nullif(rap_n + edm_n, 0) ELSE rap_w / (rap_w + edm_w) END AS rap_share
        FROM (SELECT artist_name, coalesce(sum(greatest(tag_count, 0)) FILTER (family = 'rap'), 0) AS rap_w,
                     coalesce(sum(greatest(tag_count, 0)) FILTER (family = 'edm'), 0) AS edm_w,
                     count(*) FILTER (family = 'rap') AS rap_n, count(*) FILTER (family = 'edm') AS edm_n,
                     count(*) AS n_tags
              FROM fam WHERE is_genre GROUP BY artist_name)"""),
    "item_share": ("items bal", """
        SELECT i.*, s.rap_share, s.reason FROM items i JOIN (
            SELECT artists, CASE WHEN bool_or(pos = 1 AND rap_share IS NOT NULL)
                        THEN max(rap_share * CASE WHEN pos = 1 THEN 1.0 ELSE 0.5 END) ELSE max(rap_share) END AS rap_share,
                   CASE WHEN count(rap_share) > 0 THEN ''
                        WHEN bool_and(bal.artist_name IS NULL) THEN 'untagged: ' || string_agg(name, ', ' ORDER BY pos)
                        WHEN bool_and(bal.artist_name IS NOT NULL) THEN 'off-family: ' || string_agg(name, ', ' ORDER BY pos)
                        ELSE 'untagged/off-family mix' END AS reason
            FROM (SELECT artists, unnest(artists) AS name, generate_subscripts(artists, 1) AS pos
                  FROM (SELECT DISTINCT artists FROM items))
            LEFT JOIN bal ON bal.artist_name = name GROUP BY artists) s USING (artists)"""),
    "ov": ("trk", f"""
        SELECT title_key, artist_key, min(decision) AS decision FROM (
            SELECT {title('track_name')} AS title_key, {fold('artist_name')} AS artist_key,
                   CASE WHEN p_size = 50 THEN 'keep' ELSE 'drop' END AS decision FROM trk WHERE p_size >= 49)
        GROUP BY ALL"""),
    "keyed": ("item_share", f"""
        SELECT *, {title('track_name')} AS title_key, {fold('lead')} AS artist_key FROM item_share"""),
    "scored": ("keyed ov", """
        SELECT k.*, decision IS NOT NULL AS overridden, coalesce(decision, CASE WHEN rap_share < 0.25 THEN 'keep'
                   WHEN rap_share > 0.60 THEN 'drop' ELSE 'review' END) AS verdict
        FROM keyed k LEFT JOIN ov USING (title_key, artist_key) WHERE source <> 'A'"""),
    "merged": ("keyed scored", """
        SELECT title_key, artist_key, source, pos, track_uri FROM (
            SELECT *, row_number() OVER (PARTITION BY title_key, artist_key
                                         ORDER BY stage, source, pos, track_uri, track_name) AS first FROM (
                SELECT 0 AS stage, title_key, artist_key, source, pos, track_uri, track_name FROM keyed WHERE source = 'A'
                UNION ALL SELECT 1, title_key, artist_key, source, pos, track_uri, track_name FROM scored
                WHERE verdict = 'keep'))
        WHERE first = 1"""),
}


def with_views(needs: str, body: str, **instead: str) -> str:
    """``instead``: other SQL for some of the views."""
    done: list[str] = []

    def add(name: str) -> None:
        if name not in done:
            for d in () if name in instead else VIEWS[name][0].split():
                add(d)
            done.append(name)

    for name in needs.split():
        add(name)
    views = ",\n".join(f"{n} AS ({instead.get(n, VIEWS[n][1])})" for n in done)
    body = body.strip()
    if not views:
        return body
    return f"WITH {views}" + (f",\n{body[5:]}" if body.startswith("WITH ") else f"\n{body}")
