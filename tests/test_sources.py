import datetime as dt
import json

import pytest
from conftest import column

from earshift import schemas
from earshift.operators import events, profiles, quality
from earshift.sources import exports, logs, overrides, payloads, tables


def record(ts, ms, uri="spotify:track:1", **more):
    return {"ts": ts, "platform": "x", "ms_played": ms, "ip_addr": "1.2.3.4", "spotify_track_uri": uri,
            "master_metadata_track_name": "Song", "master_metadata_album_artist_name": "Artist", "skipped": None, **more}


@pytest.fixture
def folder(tmp_path):
    a = [record("2020-01-31T23:59:59Z", 40000), record("2020-02-01T00:00:00Z", 1000),
         record("2020-02-02T00:00:00Z", 50000, None, spotify_episode_uri="e"), record("2020-02-03T00:00:00Z", 9, None, audiobook_uri="b"),
         record("2020-02-04T00:00:00Z", 9, None)]
    (tmp_path / "Streaming_History_Audio_0.json").write_text(json.dumps(a))
    (tmp_path / "Streaming_History_Video_1.json").write_text(json.dumps([a[0], record("2020-03-01T00:00:00Z", 60000, new_field=1)], indent=1))
    (tmp_path / "Streaming_History_Audio_2.json").write_text(json.dumps([a[1]])[:-20])
    (tmp_path / "Other.json").write_text("[]")
    return str(tmp_path)


def test_export_to_plays(spark, folder):
    raw = events.normalise_plays(exports.read_export(spark, folder))
    assert set(raw.columns) == set(schemas.PLAYS_RAW_COLUMNS)
    assert quality.forbidden_columns(raw) == []
    rows = raw.orderBy("ts").collect()
    assert [r.content_type for r in rows] == ["music", "music", "podcast", "audiobook", "unknown", "music"]
    # The doubled event keeps the lower file name.
    assert [r.source_kind for r in rows] == ["audio"] * 5 + ["video"]
    assert [str(r.month) for r in rows[:2]] == ["2020-01-01", "2020-02-01"]
    assert rows[0].played_seconds == 40.0 and rows[0].track_artists is None and not rows[0].ms_played_estimated
    assert column(events.real_listens(raw), "ms_played", "ts") == [40000, 60000]
    assert profiles.duplicates_dropped(exports.read_export(spark, folder), raw).first().duplicates == 1


def test_times_are_utc_in_any_session_zone(spark, folder):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        seen = []
        for z in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", z)
            raw = events.normalise_plays(exports.read_export(spark, folder)).orderBy("ts", "ms_played")
            seen.append([(r.ts, r.month) for r in raw.select("ts", "month").collect()])
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert seen[0] == seen[1] and seen[0][0] == (dt.datetime(2020, 1, 31, 23, 59, 59), dt.date(2020, 1, 1))


def test_health_and_drift(spark, folder):
    h = {r.source_file: (r.n_rows, r.failed) for r in exports.file_health(spark, folder).collect()}
    assert h == {"Streaming_History_Audio_0.json": (5, False), "Streaming_History_Video_1.json": (2, False),
                 "Streaming_History_Audio_2.json": (0, True)}
    assert {tuple(r) for r in exports.schema_drift(spark, folder).collect()} == {("Streaming_History_Video_1.json", "OBJECT<new_field: BIGINT>")}


def test_no_files(spark, tmp_path):
    with pytest.raises(Exception):
        exports.read_export(spark, str(tmp_path))


def test_rerun_gives_the_same_rows(spark, folder, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("t") / "plays_raw")
    prints = []
    for _ in range(2):
        tables.write_table(events.normalise_plays(exports.read_export(spark, folder)), out, ["month"])
        prints.append(quality.fingerprint(tables.read_table(spark, out)).first())
    assert prints[0] == prints[1] and prints[0].n_rows == 6


POLLED = "ts timestamp_ntz, track_uri string, ms_played bigint, track_artists string, source_kind string, content_type string"


def test_reconcile(table):
    t = lambda d: dt.datetime(2020, 1, d)
    raw = table("ts timestamp_ntz, track_uri string, ms_played bigint, source_file string, month date, track_artists string",
                (t(1), "a", 1, "f", dt.date(2020, 1, 1), None), (t(5), "a", 2, "f", dt.date(2020, 1, 1), None))
    polled = table(POLLED, (t(4), "a", 9, "x", "poll", "music"), (t(5), "b", 9, "x", "poll", "music"),
                   (t(6), "a", 9, "x", "poll", "music"), (t(6), "a", 9, "w", "poll", "music"), (t(7), "c", 9, None, "poll", "music"))
    got = events.reconcile(raw, polled).orderBy("ts").collect()
    assert [(r.ts.day, r.source_file, r.track_artists) for r in got] == [
        (1, "f", None), (5, "f", None), (6, "api-poll", "w"), (7, "api-poll", None)]
    assert events.reconcile_stats(raw, polled).first()[1:] == (5, 2, 3)
    # No export yet: every polled row counts.
    assert events.reconcile(raw.limit(0), polled).count() == 4


def test_reconcile_per_listener(table):
    t = lambda d: dt.datetime(2020, 1, d)
    raw = table("user_id int, ts timestamp_ntz, track_uri string", (1, t(5), "a"), (2, t(1), "a"))
    polled = table("user_id int, ts timestamp_ntz, track_uri string, ms_played bigint",
                   *[(u, t(3), "p", 1) for u in (1, 2, 3)])
    got = events.reconcile(raw, polled, by=["user_id"]).where("track_uri = 'p'")
    assert sorted(column(got, "user_id")) == [2, 3]


def test_recently_played(spark):
    track = lambda uri, arts, album: {"uri": uri, "name": "T", "duration_ms": 1000, "artists": [{"name": a} for a in arts],
                                      "album": {"name": "Al", "artists": [{"name": a} for a in album]}}
    page = {"items": [
        {"played_at": "2026-07-01T10:00:00.5Z", "track": track("u1", ["Ember, The Younger", "B"], ["VA"]), "context": {"type": "album"}},
        {"played_at": "2026-07-01T12:00:00+02:00", "track": track("u2", ["B"], []), "context": None},
        {"played_at": "2026-07-01T10:00:00Z", "track": track(None, ["B"], []), "context": None}]}
    df = spark.read.schema(schemas.RECENTLY_PLAYED).json(spark.sparkContext.parallelize([json.dumps(page)]))
    rows = payloads.recently_played(df).orderBy("track_uri").collect()
    assert [(r.track_uri, r.artist_name, r.track_artists, r.reason_start) for r in rows] == [
        ("u1", "VA", "Ember, The Younger\u001fB", "album"), ("u2", "B", "B", None)]
    assert rows[0].ts == dt.datetime(2026, 7, 1, 10, 0, 0, 500000) and rows[1].ts == dt.datetime(2026, 7, 1, 10)
    assert tuple(payloads.page_full(df, 3).first()) == (3, True)


def test_lookup_tags(spark, table):
    tags = "array<struct<name:string,count:bigint>>"
    df = table(f"mbid string, genres {tags}, tags {tags}", ("a", [("House", 3), ("odd", -2)], [("rap", 1)]),
               ("b", [], [("Rap", None), ("nonsense", 4)]), ("c", None, None))
    vocab = table("term string", ("rap",), ("house",))
    got = sorted(tuple(r) for r in payloads.lookup_tags(df, vocab).collect())
    assert got == [("a", "house", 3), ("a", "odd", 0), ("b", "rap", 0)]
    assert payloads.lookup_tags(df, vocab.limit(0)).count() == 4


def test_similar_artists(table):
    df = table("seed_mbid string, similar array<struct<artist_mbid:string,name:string,score:double,comment:string>>",
               ("s", [("c", "C", 2.0, None), (None, "x", 1.0, ""), ("d", None, None, "hm")]))
    assert sorted(tuple(r) for r in payloads.similar_artists(df).collect()) == [("s", "c", "C", 2.0, ""), ("s", "d", "", 0.0, "hm")]


def test_log_last_record_wins(spark, tmp_path):
    p = tmp_path / "log.jsonl"
    p.write_text('{"artist_name":"a","status":"error"}\n\n{"artist_name":"b","status":"resolved"}\n'
                 '{"artist_name":"a","status":"resolved"}\n{"artist_name":"b","sta')
    rows = logs.read_latest(spark, str(p), schemas.RESOLUTION_LOG, ["artist_name"]).collect()
    assert {r.artist_name: r.status for r in rows} == {"a": "resolved", "b": "resolved"}


def test_vocabulary(spark, tmp_path):
    p = tmp_path / "v.txt"
    p.write_text("House\n\n  Hip Hop \nhouse\n")
    assert sorted(column(overrides.vocabulary(spark, str(p)), "term")) == ["hip hop", "house"]


def test_optional_tables(spark, table, tmp_path):
    here = str(tmp_path / "a")
    tables.write_table(table("x int", (1,)), here)
    assert tables.register_tables(spark, {"need": here}, {"maybe": str(tmp_path / "b")}) == {"need"}
    with pytest.raises(Exception):
        tables.register_tables(spark, {"need": str(tmp_path / "b")})


def test_sources(table):
    assert quality.source_conflicts(["a", "b"], ["b"]) == ["b"]
    lists = table("name string", ("a",), ("c",), ("c",))
    assert {(r["name"], r.n) for r in quality.ambiguous_sources(lists, ["a", "b", "c"]).collect()} == {("b", 0), ("c", 2)}


def test_appends_count_in_their_order(spark, table, tmp_path):
    schema = schemas.RESOLUTION_LOG
    row = lambda status: table("artist_name string, status string", ("a", status))
    for k in range(6):
        path = str(tmp_path / f"log{k}")
        for status in ("error", "ambiguous", "error", "resolved"):
            logs.append_log(row(status), path)
        assert [r.status for r in logs.read_latest(spark, path, schema, ["artist_name"]).collect()] == ["resolved"]
