import pytest
from conftest import column

from earshift.operators import credits as crd
from earshift.operators import resolve as res
from earshift.sources import overrides

CANDS = "query_name string, pos int, mbid string, name string, aliases array<string>, score int, tags array<struct<name:string,count:bigint>>"
RES = "artist_name string, source string, status string, mbid string, score int, matched_name string, n_candidates int, tags array<struct<tag:string,count:bigint>>"


def test_resolution_never_guesses(table):
    c = table(
        CANDS, ("Fern", 0, "long", "Old Fern", ["Fern"], 95, []), ("Fern", 1, "exact", "Fern", [], 61, [("Folk Rock", 7), ("", 2)]),
        ("Mara Quill", 0, "near", "Mara Quilt", [], 99, []), ("Mara Quill", 1, "alias", "MQ", ["Mara Quill"], 70, None),
        ("Vague", 0, "x", "Vaguely", None, 64, []), ("Twin", 0, "t0", "TWIN", [], 40, []), ("Twin", 1, "t1", "Twin", [], 40, []),
        ("Timeout", 0, "b", "Timeout", [], 3, []))
    names = table("artist_name string", *[(n,) for n in ("Fern", "Mara Quill", "Vague", "Twin", "Unlisted", "Timeout")])
    failed = table("artist_name string", ("Timeout",))
    r = {x.artist_name: x for x in res.resolve_artists(names, c, failed).collect()}
    assert {k: (v.status, v.mbid, v.matched_name, v.n_candidates) for k, v in r.items()} == {
        "Fern": ("resolved", "exact", "Fern", 2), "Mara Quill": ("resolved", "alias", "MQ", 2),
        "Vague": ("ambiguous", None, "Vaguely", 1), "Twin": ("resolved", "t0", "TWIN", 2),
        "Unlisted": ("not_found", None, None, 0), "Timeout": ("error", None, None, 0)}
    assert [tuple(t) for t in r["Fern"].tags] == [("folk rock", 7)]


@pytest.fixture
def resolutions(table):
    row = lambda name, tags, source="musicbrainz", status="resolved": (name, source, status, "m", 1, name, 1, tags)
    return table(
        RES, row("TIDEWATER", []), row("Oskar", [("drone", 2), ("noise", 1)], "musicbrainz-release-group"),
        row("Left Alone", [("soul", 6)]), row("Pa$t Noon", []), row("Misspelt", [("jazz", 4)]), row("Not Music", []),
        row("By Id", []), row("Gone", []))


CSV = """artist_name,mbid,note,tags
TIDEWATER,,,sea shanty|art folk|shantie
Oskar,,,sea shanty
Left Alone,,,
Past Noon,,,soul
Misspelt,,,no genre of ours
Not Music,IGNORE,an audio guide,
By Id,0A9C51D2-77e1-4c0b-8f3e-5b1d2c3e4f50,this one,
Gone,1a9c51d2-77e1-4c0b-8f3e-5b1d2c3e4f50,,
Half Id,1a9c51d2,too short,soul
Stranger,,,soul
"""


def test_overrides(spark, table, resolutions, tmp_path):
    p = tmp_path / "o.csv"
    p.write_text(CSV, encoding="utf-8")
    valid, rejected = overrides.artist_overrides(spark, str(p))
    assert column(rejected, "artist_name") == ["Half Id"]
    v = {r.name_key: r for r in valid.collect()}
    assert "leftalone" not in v and v["notmusic"].ignore and v["notmusic"].mbid is None
    assert v["byid"].mbid == "0a9c51d2-77e1-4c0b-8f3e-5b1d2c3e4f50" and v["tidewater"].mbid is None
    vocab = table("term string", *[(t,) for t in ("sea shanty", "art folk", "soul", "jazz")])
    lookups = table("mbid string, name string, tags array<struct<tag:string,count:bigint>>",
                    ("0a9c51d2-77e1-4c0b-8f3e-5b1d2c3e4f50", "Right One", [("blues", 8)]))
    got = {r.artist_name: r for r in res.apply_overrides(resolutions, valid, vocab, lookups).collect()}
    short = {k: (r.source, r.status, [tuple(t) for t in r.tags]) for k, r in got.items()}
    assert short == {
        "TIDEWATER": ("override", "resolved", [("sea shanty", 1), ("art folk", 1)]), "Oskar": ("override", "resolved", [("sea shanty", 1)]),
        "Left Alone": ("musicbrainz", "resolved", [("soul", 6)]), "Pa$t Noon": ("override", "resolved", [("soul", 1)]),
        "Misspelt": ("musicbrainz", "resolved", [("jazz", 4)]), "Not Music": ("override", "ignored", []),
        "By Id": ("override", "resolved", [("blues", 8)]), "Gone": ("override", "error", [])}
    assert got["By Id"].matched_name == "Right One" and got["Not Music"].mbid is None
    assert sorted(column(res.rejected_override_tags(valid, vocab), "tag")) == ["no genre of ours", "shantie"]
    assert res.override_stats(resolutions, valid).first().asDict() == {"ignored": 1, "pinned": 2, "tags_only": 4, "unused": 1}
    # No vocabulary at all: what was written by hand stands.
    for none in (None, vocab.limit(0)):
        free = {r.artist_name: r for r in res.apply_overrides(resolutions, valid, none, lookups).collect()}
        assert [t.tag for t in free["Misspelt"].tags] == ["no genre of ours"]


def test_stale_overrides_leave_the_log(table, resolutions):
    from pyspark.sql import functions as F
    log = resolutions.withColumn("source", F.lit("override"))
    backed = table("name_key string, mbid string", ("byid", "m"), ("gone", "other"))
    assert column(res.drop_stale_overrides(log, backed), "artist_name") == ["By Id"]
    assert res.drop_stale_overrides(resolutions, backed).count() == resolutions.count()


def test_backfill(table, resolutions):
    rel = table("mbid string, name string, count bigint", ("m", "Waltz", 0), ("m", "waltz", 4), ("m", "polka", None), ("m", "", 9))
    got = {r.artist_name: r for r in res.backfill_tags(resolutions, rel).collect()}
    assert [tuple(t) for t in got["TIDEWATER"].tags] == [("waltz", 5), ("polka", 1)]
    assert got["TIDEWATER"].source == "musicbrainz-release-group"
    assert got["Left Alone"].source == "musicbrainz" and [t.tag for t in got["Left Alone"].tags] == ["soul"]


def test_first_known_cache_answers(table):
    mine = table("artist_name string, v int", ("a", 1))
    shared = table("artist_name string, v int", ("a", 2), ("b", 3))
    assert {r.artist_name: r.v for r in res.first_known([mine, shared]).collect()} == {"a": 1, "b": 3}


def test_worklist(table):
    hours = table("artist_name string, listening_hours double", ("a", 9.0), ("b", 5.0), ("c", 4.0), ("d", 3.0))
    done = table("artist_name string, status string", ("a", "resolved"), ("b", "error"))
    ov = table("name_key string", ("c",))
    assert column(res.worklist(hours, done, ov, limit=5), "artist_name") == ["b", "d"]
    assert column(res.worklist(hours, done, ov, limit=1), "artist_name") == ["b"]


PLAYS = "track_uri string, track_name string, artist_name string, played_seconds double, track_artists string"


def test_credits(table):
    us = "\u001f"
    plays = table(
        PLAYS, ("t1", "Song (feat. Bee & Cee, Dee)", "Ay", 10.0, None), ("t1", "Song (feat. Bee & Cee, Dee)", "Ay", 5.0, None),
        ("t2", "Song (feat. Wrong)", "Ay", 7.0, None), ("t2", "Song (feat. Wrong)", "Ay", 1.0, f"Ember, The Younger{us}Guest{us} Guest "),
        ("t3", "Song (with Ay, feat.Bee Remix)", "Ay", 1.0, ""), ("t4", "Песня (Live)", "Группа", 1.0, None), ("t5", None, "Ay", 1.0, None),
        ("t6", "Duo [FEATURING Suspect (AGB)]", None, 1.0, None))
    rows = crd.track_credits(plays).collect()
    got = sorted((r.track_uri, r.artist_name, r.credit_type, r.credit_source, r.n_performers) for r in rows)
    assert got == sorted([
        ("t1", "Ay", "album_artist", "export", 4), ("t1", "Bee", "featured", "export", 4), ("t1", "Cee", "featured", "export", 4),
        ("t1", "Dee", "featured", "export", 4), ("t2", "Ember, The Younger", "album_artist", "poller", 2),
        ("t2", "Guest", "featured", "poller", 2), ("t3", "Ay", "album_artist", "export", 2), ("t3", "Bee", "featured", "export", 2),
        ("t5", "Ay", "album_artist", "export", 1), ("t6", "Suspect AGB", "featured", "export", 1)])
    assert {r.track_uri: (r.played_seconds, r.n_plays) for r in rows}["t1"] == (15.0, 2)
    assert sorted(column(crd.featured_only(crd.track_credits(plays)), "artist_name")) == ["Bee", "Cee", "Dee", "Guest", "Suspect AGB"]
