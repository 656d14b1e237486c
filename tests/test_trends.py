import datetime as dt
import itertools

import pytest
from conftest import column
from pyspark.sql import functions as F

from earshift import Params
from earshift.operators import metrics, outlook, quality, trends

PLAYS = "ts timestamp_ntz, track_uri string, artist_name string, ms_played bigint, played_seconds double, month date"
CREDITS = "track_uri string, artist_name string, credit_type string"
TAGS = "artist_name string, tag string, tag_count int, is_genre boolean"


def play(day, track, secs, artist="A"):
    ts = dt.datetime.fromisoformat(day)
    return (ts, track, artist, int(secs * 1000), float(secs), ts.date().replace(day=1))


@pytest.fixture
def world(table):
    plays = table(
        PLAYS, play("2020-01-05", "t1", 100), play("2020-01-06", "t2", 60), play("2020-02-01", "t1", 200),
        play("2020-02-02", "t3", 50), play("2020-03-01", "t4", 40), play("2020-04-01", "t2", 80),
        play("2020-04-01", "t2", 40))
    credits = table(
        CREDITS, ("t1", "A", "album_artist"), ("t1", "B", "featured"), ("t2", "B", "album_artist"),
        ("t3", "C", "featured"), ("t4", "D", "album_artist"))
    weights = trends.tag_weights(table(
        TAGS, ("A", "house", 3, True), ("A", "techno", -4, True), ("A", "seen live", 9, False),
        ("B", "house", 1, True), ("C", "soul", 0, True)))
    return plays, credits, weights


def by_key(df, *cols):
    return {tuple(str(r[c]) for c in cols): r for r in df.collect()}


def test_weights(world):
    w = {(r.artist_name, r.tag): r.tag_weight for r in world[2].collect()}
    assert w == {("A", "house"): 0.8, ("A", "techno"): 0.2, ("B", "house"): 1.0, ("C", "soul"): 1.0}


def test_weights_keep_the_top_tags_by_raw_votes(table):
    tags = table(TAGS, *[("X", f"g{i}", -i, True) for i in range(12)])
    w = trends.tag_weights(tags)
    assert sorted(column(w, "tag")) == [f"g{i}" for i in range(8)]
    assert set(column(w, "tag_weight")) == {1 / 8}


def test_grid_is_dense_and_keeps_months_without_tags(world):
    r = by_key(trends.tag_trends(*world), "variant", "tag", "month")
    months = [f"2020-0{m}-01" for m in range(1, 5)]
    assert set(r) == set(itertools.product(Params().variants, ("house", "techno", "soul"), months))
    f = lambda tag, m: r["with_features", tag, m]
    # 100 s split 2:1 between A and B; B's 60 s alone; A gives 0.8 to house.
    assert f("house", months[0]).tag_seconds == pytest.approx(100 * (2 / 3 * 0.8 + 1 / 3) + 60)
    assert f("techno", months[0]).tag_seconds == pytest.approx(100 * 2 / 3 * 0.2)
    assert f("soul", months[0]).share == 0
    # March reached no tag: shares are unknown and the mean skips them.
    assert f("house", months[2]).share is None
    assert f("soul", months[2]).smoothed_share == pytest.approx(
        (f("soul", months[0]).share + f("soul", months[1]).share) / 2)
    # Plays sharing (ts, track) count their mean.
    assert f("house", months[3]).tag_seconds == pytest.approx(60)


def test_zero_weight_performers(world):
    r = by_key(trends.tag_trends(*world), "variant", "tag", "month")
    jan = r["album_artist_only", "house", "2020-01-01"]
    assert jan.tag_seconds == pytest.approx(100 * 0.8 + 60)
    assert jan.n_artists == 2 and r["with_features", "house", "2020-01-01"].n_artists == 2
    # Only a featured performer: no time in this variant, still one artist.
    feb = r["album_artist_only", "soul", "2020-02-01"]
    assert (feb.tag_seconds, feb.n_artists) == (0, 1)


def test_every_play_in_full_mode(world):
    p = Params(merge_shared_timestamps=False)
    r = by_key(trends.tag_trends(*world, p), "variant", "tag", "month")
    assert r["with_features", "house", "2020-04-01"].tag_seconds == pytest.approx(120)


@pytest.mark.parametrize("p", [Params(), Params(merge_shared_timestamps=False)])
def test_mass_balance(world, p):
    t = trends.tag_trends(*world, p)
    for r in quality.mass_balance(*world, t, p).collect():
        assert r.difference == pytest.approx(0, abs=1e-9)


def test_listeners_are_independent(world):
    plays, credits, weights = world
    both = plays.withColumn("user_id", F.lit(1)).unionByName(
        plays.where("month < '2020-03-01'").withColumn("user_id", F.lit(2)))
    t = trends.tag_trends(both, credits, weights, by=["user_id"])
    cols = list(trends.TREND_COLUMNS)
    alone = trends.tag_trends(plays, credits, weights).collect()
    assert sorted(map(str, t.where("user_id = 1").select(*cols).collect())) == sorted(map(str, alone))
    assert t.where("user_id = 2").select("month").distinct().count() == 2


def test_classes_and_slope(table):
    months = [dt.date(2020 + m // 12, m % 12 + 1, 1) for m in range(14)]
    rows = []
    for i, m in enumerate(months):
        for tag, secs in (("up", 10 + i), ("down", 30 - i), ("still", 20.0), ("tiny", 0.01)):
            rows.append(("v", tag, m, i + 1, len(months), float(secs)))
    grid = table("variant string, tag string, month date, month_idx int, n_months int, tag_seconds double", *rows)
    t = trends.with_trend_class(trends.with_slope(trends.with_smoothing(trends.with_share(grid))))
    got = {r.tag: r for r in t.where("month_idx = 14").collect()}
    assert {k: v.trend_class for k, v in got.items()} == {
        "up": "rising", "down": "declining", "still": "flat", "tiny": "negligible"}
    # Share of `up` grows by 1/60.01 a month, and so does its mean of three.
    assert got["up"].slope == pytest.approx(1 / 60.01)
    assert got["up"].slope_pp_per_year == pytest.approx(1200 / 60.01)


def test_one_month_is_flat(world):
    plays, credits, weights = world
    t = trends.tag_trends(plays.where("month = '2020-01-01'"), credits, weights)
    assert set(column(t, "trend_class")) == {"flat"} and set(column(t, "slope")) == {None}


def test_forecast_and_taste(table):
    cols = "variant string, tag string, month date, smoothed_share double, slope double, rel_change_per_year double, trend_class string"
    m0, m1 = dt.date(2020, 1, 1), dt.date(2020, 2, 1)
    t = table(
        cols, ("with_features", "a", m1, 0.6, 0.01, 5.0, "rising"), ("with_features", "b", m1, 0.4, -0.9, -3.0, "declining"),
        ("with_features", "c", m1, None, None, None, "flat"), ("with_features", "a", m0, 0.1, 0.01, 5.0, "rising"),
        ("album_artist_only", "a", m1, 0.3, 0.0, 0.0, "flat"))
    fc = {r.tag: r for r in outlook.forecast(t).collect()}
    assert set(fc) == {"a", "b"}
    assert fc["a"].share_future == pytest.approx(1) and fc["b"].share_future == 0
    taste = {r.tag: r.taste for r in outlook.taste_vector(t).collect()}
    # Clamped to 2.0 and -0.9: b's weight is negative and drops out.
    assert taste == {"a": pytest.approx(1.0)}
    flat = {r.tag: r.taste for r in outlook.taste_vector(t, lam=0.0).collect()}
    assert flat["a"] / flat["b"] == pytest.approx(1.5)


def test_concentration_equals_ranking(table):
    """Against a plain ranking, with ties and a cut inside a bucket."""
    plays = []
    for i in range(730):
        plays.append(play("2020-05-01", f"t{i}", 100 + (i % 7) * 0.001, f"artist{i}"))
    plays += [play("2021-01-01", "x", 5, "one"), play("2021-02-01", "x", 7, None)]
    got = {r.year: r for r in metrics.repeat_concentration(table(PLAYS, *plays)).collect()}
    secs = sorted((p[4] for p in plays[:730]), reverse=True)
    assert (got[2020].artists, got[2020].top_1pct_size) == (730, 8)
    assert got[2020].top_1pct_share == pytest.approx(sum(secs[:8]) / sum(secs), rel=1e-12)
    assert (got[2021].artists, got[2021].top_1pct_share) == (1, 1.0)


def test_concentration_rounds_the_size_exactly(table):
    plays = [play("2020-05-01", f"t{i}", 10, f"artist{i}") for i in range(700)]
    assert column(metrics.repeat_concentration(table(PLAYS, *plays)), "top_1pct_size") == [7]


def test_unknown_skip_flag_is_a_play_but_no_skip(table):
    raw = table(
        "track_uri string, ms_played bigint, skipped boolean, reason_end string, content_type string",
        ("t", 1000, None, "trackdone", "music"), ("t", 1000, None, "fwdbtn", "music"), ("t", 1000, True, "x", "music"),
        ("t", 1000, False, "endplay", "music"), ("t", 9000, True, "x", "podcast"))
    credits = table(CREDITS, ("t", "A", "album_artist"), ("t", "B", "featured"))
    w = table("artist_name string, tag string, tag_weight double", ("A", "house", 1.0), ("B", "soul", 1.0))
    r = metrics.skip_rate(raw, credits, w, Params(skip_rate_floor=1)).collect()
    assert [(x.tag, x.weighted_plays, x.weighted_skips) for x in r] == [("house", 4, 3)]
    none = metrics.skip_rate(raw.where("reason_end = 'trackdone'"), credits, w, Params(skip_rate_floor=1)).first()
    assert none.weighted_skips is None and none.skip_rate is None


def test_not_finite(table):
    df = table("a double, b double", (1.0, float("nan")), (float("inf"), None))
    assert {(r["column"], r["n"]) for r in quality.not_finite(df, ["a", "b"]).collect()} == {("a", 1), ("b", 1)}
    with pytest.raises(quality.QualityError):
        quality.require_finite(df, ["a"], "t")
    quality.require_finite(df.where("b is null").select("b"), ["b"], "t")


def test_fingerprint_ignores_order(table):
    rows = [(1, "a"), (2, None), (2, None)]
    f = lambda rs: quality.fingerprint(table("x int, y string", *rs)).first()
    assert f(rows) == f(rows[::-1]) and f(rows) != f(rows[:2])


def test_listener_grid_moves_folded_rows_only(spark, world):
    """The dense grid, months times tags of a listener, is laid out where it is used."""
    plays, credits, weights = world
    both = plays.withColumn("user_id", F.lit(1)).unionByName(plays.withColumn("user_id", F.lit(2)))
    t = trends.tag_trends(both, credits, weights, by=["user_id"])
    plan = t._jdf.queryExecution().executedPlan().toString()
    moves = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert moves and all("hashpartitioning(user_id" in m and "variant" not in m and ", month" not in m for m in moves), moves


def test_no_row_of_a_tag_is_written_or_moved(spark, world, monkeypatch):
    """Listeners get their artists with lists of tags, in one shuffle, and open them."""
    plays, credits, weights = world
    both = plays.withColumn("user_id", F.lit(1)).unionByName(plays.withColumn("user_id", F.lit(2)))
    odd = both.unionByName(plays.withColumn("user_id", F.lit(None).cast("int")))
    wrote, write = [], trends.materialise
    monkeypatch.setattr(trends, "materialise", lambda df, *a: wrote.append(write(df, *a)) or wrote[-1])
    t = trends.tag_trends(odd, credits, weights, by=["user_id"])
    assert [w.count() for w in wrote] == [trends.artist_month(both, credits, by=["user_id"], how="left").count()]
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Generate explode(_tags") < plan.index("Exchange hashpartitioning")
    assert {r.user_id for r in t.select("user_id").distinct().collect()} == {1, 2}
