import datetime as dt

import pytest
from conftest import column

from earshift.operators import playlists as pl
from earshift.sources import overrides, payloads, tables

GAPS = "tag string, gap_score double, hours double, n_artists bigint, rel_change_per_year double"
JUNE, MAY, APRIL, OLD = dt.date(2026, 6, 1), dt.date(2026, 5, 1), dt.date(2026, 4, 1), dt.date(2020, 1, 1)


@pytest.fixture
def gaps(table):
    return table(
        GAPS, ("bluegrass", 0.0007, 21.0, 64, 0.83), ("choral", 0.00012, 5.5, 47, 0.61),
        ("ska", 0.00006, 40.2, 118, 0.33), ("tango", 0.00004, 9.1, 52, 0.24), ("drone", 0.00002, 1.5, 4, 0.45))


@pytest.fixture
def plays(table):
    return table(
        "artist_name string, track_name string, track_uri string, played_seconds double, month date",
        ("Creek Union", "Mill Race", "w1", 6600.0, JUNE), ("Creek Union", "Weir", "w3", 3000.0, MAY),
        ("Creek Union", "Ford", "w4", 1200.0, APRIL), ("Ridge Duo", "Switchback", "w2", 4800.0, JUNE),
        ("Creek Union", "Long Ago", "w0", 9500.0, OLD), ("City Choir", "Anthem", "c1", 9200.0, JUNE),
        ("Radio Hour", "Part 3", None, 9400.0, JUNE), ("No Votes", "Almost", "n1", 8800.0, JUNE),
        ("Harbour", "Fog", "h1", 1500.0, JUNE), ("Kite", "Gust", "k1", 2700.0, JUNE))


@pytest.fixture
def artist_tags(table):
    return table(
        "artist_name string, tag string, tag_count int, is_genre boolean",
        ("Creek Union", "bluegrass", 6, True), ("Ridge Duo", "bluegrass", 2, True), ("City Choir", "choral", 4, True),
        ("Radio Hour", "bluegrass", 8, False), ("No Votes", "bluegrass", 0, True),
        ("Harbour", "sea shanty", 3, True), ("Kite", "art folk", 3, True), ("Kite", "sea shanty", 3, True))


def specs(table, *rows):
    return table("label string, tags array<string>", *rows)


def test_specs_from_gaps(gaps):
    s = pl.playlist_specs(gaps)
    assert column(s, "label", "spec_rank") == ["bluegrass", "choral", "ska", "tango"]
    assert set(column(s, "pinned")) == {False}


def write(tmp_path, text):
    p = tmp_path / "rows.csv"
    p.write_text(text, encoding="utf-8")
    return str(p)


def test_specs_from_file(spark, tmp_path, gaps):
    path = write(tmp_path, "﻿label,tags\nbluegrass,bluegrass|old time|string band\nskiffle,\n"
                           "# a comment row,ignored\n  coast  ,  art folk  |  sea shanty  \n,no label\n")
    valid, rejected = overrides.playlist_overrides(spark, path)
    rows = pl.playlist_specs(gaps, valid).orderBy("spec_rank").collect()
    assert [(r.label, r.tags, r.pinned, r.n_artists) for r in rows] == [
        ("bluegrass", ["bluegrass", "old time", "string band"], False, 64), ("skiffle", ["skiffle"], True, None),
        ("coast", ["art folk", "sea shanty"], True, None)]
    assert rejected.count() == 0


def test_specs_cap_and_empty_file(spark, tmp_path, gaps):
    valid, over = overrides.playlist_overrides(
        spark, write(tmp_path, "label,tags\n" + "".join(f"g{i},tag{i}\n" for i in range(9))))
    assert column(pl.playlist_specs(gaps, valid), "label", "spec_rank") == ["g0", "g1", "g2", "g3"]
    assert over.count() == 5
    none, _ = overrides.playlist_overrides(spark, write(tmp_path, "label,tags\n"))
    assert pl.playlist_specs(gaps, none).count() == 0


def test_anchors(table, plays, artist_tags):
    a = pl.anchor_tracks(plays, artist_tags, specs(table, ("d", ["bluegrass"]), ("i", ["art folk", "sea shanty"])))
    assert column(a.where("label = 'd'"), "track_uri", "anchor_rank") == ["w1", "w2", "w3"]
    # Two tags of the blend do not double an artist's time.
    rows = a.where("label = 'i'").orderBy("anchor_rank").collect()
    assert [(r.artist_name, r.hours) for r in rows] == [("Kite", 0.75), ("Harbour", 1500 / 3600)]


def test_candidates(table, plays):
    recs = table("artist_name string, mbid string, score double", ("Tin Orchard", "vr", 0.85), ("Low Bridge", "sd", 0.75),
                 ("Still Pond", "ba", 0.65), ("CREEK UNION!", "sub", 0.95), ("creek union", "sub2", 0.94))
    tags = table("mbid string, tag string, count bigint", ("vr", "bluegrass", 4), ("sd", "bluegrass", 3), ("sd", "skiffle", 2),
                 ("ba", "drone", 7), ("sub2", "bluegrass", 9))
    s = specs(table, ("d", ["bluegrass"]), ("m", ["bluegrass", "skiffle"]), ("w", ["bluegrass", "drone"]))
    c = pl.gap_candidates(recs, plays, tags, s).orderBy("label", "score").collect()
    assert [(r.label, r.mbid) for r in c] == [
        ("d", "sd"), ("d", "vr"), ("m", "sd"), ("m", "vr"), ("w", "ba"), ("w", "sd"), ("w", "vr")]


TRACKS = "artist_name string, rank int, track_name string, track_uri string, artists array<string>"


def test_only_credited_tracks(table):
    t = table(
        TRACKS, ("Tin Orchard", 1, "Cover Night", "bad", ["Pub Singers"]), ("Tin Orchard", 2, "Rail Yard", "ok", ["Tin Orchard"]),
        ("Tin Orchard", 3, "Two Rivers", "feat", ["Low Bridge", "Tin Orchard"]), ("Past Noon", 1, "Awning", "styled", ["Pa$t Noon"]),
        ("Tin Orchard", 4, "Unlisted", None, ["Tin Orchard"]), ("Stranger", 1, "Elsewhere", "x", ["Other Name"]))
    assert sorted(column(pl.credited_tracks(t), "track_uri")) == ["feat", "ok", "styled"]


def choose(table, names, on_genre, k=2):
    from earshift import Params
    tracks = pl.credited_tracks(table(TRACKS, *[("X", i, n, f"uri:{i + 1}", ["X"]) for i, n in enumerate(names)]))
    cands = table("label string, mbid string, artist_name string, score double, name_key string", ("d", "m", "X", 1.0, "x"))
    recs = table("artist_mbid string, tag string, title string", *[("m", "bluegrass", n) for n in on_genre])
    c = pl.choose_tracks(cands, tracks, recs, specs(table, ("d", ["bluegrass"])), Params(tracks_per_artist=k))
    return column(c, "track_uri", "choice")


def test_genre_is_a_preference(table):
    names = ["Radio Single", "Front Porch", "Back Porch", "Outtake"]
    on = ["Front Porch", "Back Porch (Demo)"]
    assert choose(table, names, on, 3) == ["uri:2", "uri:3", "uri:1"]
    assert choose(table, names, on, 4) == ["uri:2", "uri:3", "uri:1", "uri:4"]
    assert choose(table, names, on, 1) == ["uri:2"]
    assert choose(table, names, ["Nothing"], 2) == ["uri:1", "uri:2"]


def test_one_song_one_slot(table):
    assert choose(table, ["Low Tide", "Low Tide", "Low Tide - 1998 Remaster", "Undertow"], [""]) == ["uri:1", "uri:4"]
    assert choose(table, ["Ember", "Ember Street"], [""]) == ["uri:1", "uri:2"]
    assert choose(table, ["Slow One", "Slow One - Live", "Quick One"], ["Quick One"]) == ["uri:3", "uri:1"]


def test_repeats_are_not_refilled(table):
    from earshift import Params
    c = table("label string, mbid string, artist_name string, score double, choice int, track_name string, track_uri string, genre_matched boolean",
              ("d", "m1", "A", 0.9, 1, "x", "u1", True), ("d", "m1", "A", 0.9, 2, "y", "anchor", True),
              ("d", "m2", "B", 0.8, 1, "x", "u1", True), ("d", "m2", "B", 0.8, 2, "z", "u2", True), ("d", "m3", "C", 0.7, 1, "w", "u3", True))
    anchors = table("label string, track_uri string", ("d", "anchor"))
    d = pl.discovery_tracks(c, anchors, Params(playlist_size=2))
    assert column(d, "track_uri", "discovery_rank") == ["u1", "u2"]


def one_by_one(anchors, discovery, size):
    """The list built slot by slot, to check the closed form against."""
    anchors, discovery = anchors[:size], [d for d in discovery if d not in anchors]
    step = max(1, size // len(anchors)) if anchors else size
    out, a, d = [], list(anchors), list(discovery)
    for pos in range(size):
        due = a and pos % step == 0 and pos // step < len(anchors)
        pool = a if (due or not d) else d
        if not pool:
            break
        out.append(pool.pop(0))
    return out


@pytest.mark.parametrize("n, m, size", [
    (3, 30, 10), (1, 1, 10), (0, 5, 3), (6, 0, 25), (4, 1, 25), (6, 40, 25), (25, 5, 25), (13, 30, 25), (7, 3, 25), (30, 2, 25)])
def test_interleave(table, n, m, size):
    a, d = [f"a{i}" for i in range(n)], [f"d{i}" for i in range(m)]
    got = pl.interleave(
        table("label string, track_uri string, anchor_rank int", *[("p", u, i + 1) for i, u in enumerate(a)]),
        table("label string, track_uri string, discovery_rank int", *[("p", u, i + 1) for i, u in enumerate(d)]), size)
    assert column(got, "track_uri", "position") == one_by_one(a, d, size)
    assert column(got, "position", "position") == list(range(got.count()))


def test_uri_in_both_pools_stays_an_anchor(table):
    got = pl.interleave(
        table("label string, track_uri string, anchor_rank int", ("p", "same", 1)),
        table("label string, track_uri string, discovery_rank int", ("p", "same", 1), ("p", "other", 2)), 5)
    assert [(r.track_uri, r.slot) for r in got.orderBy("position").collect()] == [("same", "anchor"), ("other", "discovery")]


def test_archive_accumulates(spark, table, tmp_path):
    path = str(tmp_path / "archive")
    lists = table("label string, position int, slot string, artist_name string, track_name string, track_uri string",
                  ("bluegrass", 0, "anchor", "A", "T", "u0"), ("bluegrass", 1, "discovery", "A", "T", "u1"))
    tables.append_archive(pl.archive_rows(lists, "2026-07-31"), path)
    tables.append_archive(pl.archive_rows(lists.where("position = 0"), "2026-08-01"), path)
    tables.append_archive(pl.archive_rows(lists.limit(0), "2026-09-01"), path)
    pages = table("source string, page int, items array<struct<added_at:string,item:struct<uri:string,name:string,artists:array<struct<name:string>>>>>",
                  ("p", 0, [(None, None), (None, ("u9", "Real", [("B",), ("C",)]))]))
    tables.append_archive(payloads.snapshot_rows(pages, "2026-08-01", "bluegrass", "pid"), path)
    rows = tables.read_archive(spark, path).orderBy("run_date", "kind", "position").collect()
    assert [(r.run_date, r.kind, r.position, r.slot, r.artist_name, r.source) for r in rows] == [
        ("2026-07-31", "selection", 0, "anchor", "A", "plays"), ("2026-07-31", "selection", 1, "discovery", "A", "recommendations"),
        ("2026-08-01", "pre_replace_snapshot", 0, None, "", "p"), ("2026-08-01", "pre_replace_snapshot", 1, None, "B, C", "p"),
        ("2026-08-01", "selection", 0, "anchor", "A", "plays")]
