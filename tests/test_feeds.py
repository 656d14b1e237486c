"""Stored results kept up to date from feeds, against the batch operators."""

import collections
import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earshift.operators.credits import track_credits
from earshift.operators.metrics import discovery_rate
from earshift.operators.trends import TREND_COLUMNS, tag_trends
from earshift.streaming import live, store, supersede, trendfeed

PLAYS = "user_id int, ts timestamp_ntz, month date, track_uri string, track_name string, artist_name string, track_artists string, played_seconds double"
CREDITS = "track_uri string, artist_name string, credit_type string"
WEIGHTS = "artist_name string, tag string, tag_weight double"


def play(user, year, month, day, track, secs=60.0, listed=None, hour=0):
    ts = dt.datetime(year, month, day, hour)
    return user, ts, dt.date(year, month, 1), track, f"Title {track}", f"Act {int(track[1:]) % 4}", listed, secs


def plays(n=240, seed=1):
    r = random.Random(seed)
    rows = [play(r.choice([1, 1, 2, 3]), 2020 + r.randrange(2), r.randrange(1, 13), r.randrange(1, 28), f"t{r.randrange(12)}", float(r.randrange(30, 300)))
            for _ in range(n)]
    rows += [r_[:-1] + (r_[-1] + 5.0,) for r_ in rows[:20]]  # plays that share a time and a track
    rows.append(play(3, 2024, 6, 1, "t99"))  # no credit: a month without tags
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def credits(spark):
    rows = [(f"t{k}", f"Act {k % 4}", "album_artist") for k in range(12)] + [(f"t{k}", f"Act {(k + 1) % 4}", "featured") for k in range(0, 12, 3)]
    return spark.createDataFrame(rows, CREDITS)


@pytest.fixture(scope="module")
def weights(spark):
    return spark.createDataFrame([("Act 0", "house", 0.7), ("Act 0", "soul", 0.3), ("Act 1", "soul", 1.0), ("Act 2", "pop", 1.0)], WEIGHTS)


def rows_of(df, columns):
    near = lambda v: round(v, 9) if isinstance(v, float) else v
    return collections.Counter(tuple(near(r[c]) for c in columns) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, PLAYS)


@pytest.mark.parametrize("by, fold_after", [(["user_id"], 32), ([], 2)])
def test_trends_from_batches_equal_batch_trends(spark, tmp_path, credits, weights, by, fold_after):
    rows = plays()
    feed = trendfeed.TrendFeed(spark, str(tmp_path / "t"), T.StructType.fromDDL(PLAYS), lambda: credits, weights, by=by, fold_after=fold_after)
    cuts = [0, 5, 120, 121, len(rows)]
    for epoch, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        for _ in range(1 + (epoch == 2)):  # a batch that is replayed
            feed.update(frame(spark, rows[lo:hi]), epoch)
        want = tag_trends(frame(spark, rows[:hi]), credits, weights, by=by)
        assert rows_of(feed.read(), [*by, *TREND_COLUMNS]) == rows_of(want, [*by, *TREND_COLUMNS])
    if fold_after == 2:
        assert len(feed.time.parts()) <= 4


def test_a_batch_writes_what_it_touches(spark, tmp_path, credits, weights):
    feed = trendfeed.TrendFeed(spark, str(tmp_path / "t"), T.StructType.fromDDL(PLAYS), lambda: credits, weights, by=["user_id"])
    base = [play(u, y, m, 3, f"t{k}") for u in (1, 2) for y in (2019, 2020, 2021) for m in range(1, 13) for k in (0, 1, 2)]
    feed.update(frame(spark, base), 0)
    feed.update(frame(spark, [play(1, 2019, 5, 9, "t1")]), 1)
    wrote = feed.cells.read().where("epoch = 1").select("user_id", "month").distinct().collect()
    assert {(r.user_id, r.month) for r in wrote} == {(1, dt.date(2019, m, 1)) for m in (5, 6, 7)}
    assert feed.series.read().where("epoch = 1").count() == 0  # no month of the last year moved
    feed.update(frame(spark, [play(2, 2021, 11, 9, "t1")]), 2)
    assert {r.user_id for r in feed.series.read().where("epoch = 2").collect()} == {2}
    feed.update(frame(spark, []), 3)
    assert feed.cells.read().where("epoch = 3").count() == 0


def test_learned_performers_move_their_months_only(spark, tmp_path, weights):
    first = [play(1, 2020, m, 2, "t0") for m in range(1, 7)] + [play(1, 2020, m, 4, "t1") for m in range(5, 12)] + [play(2, 2020, 1, 1, "t1")]
    later = [play(2, 2020, 3, 5, "t0", listed="Act 0\u001fAct 2")]
    credits = trendfeed.CreditFeed(spark, str(tmp_path / "c"))
    trends = trendfeed.TrendFeed(spark, str(tmp_path / "t"), T.StructType.fromDDL(PLAYS), lambda: credits.read(), weights, by=["user_id"])
    write = trendfeed.repair_feed(trends, credits)
    write(frame(spark, first), 0)
    write(frame(spark, later), 1)
    whole = frame(spark, first + later)
    batch = track_credits(whole)
    assert rows_of(credits.read(), batch.columns) == rows_of(batch, batch.columns)
    want = tag_trends(whole, batch, weights, by=["user_id"])
    assert rows_of(trends.read(), ["user_id", *TREND_COLUMNS]) == rows_of(want, ["user_id", *TREND_COLUMNS])
    split = trends.wide.read().where("epoch = 1").select("user_id", "month").distinct().collect()
    assert {(r.user_id, r.month.month) for r in split} == {(1, m) for m in range(1, 7)} | {(2, 3)}
    assert credits.credits.read().where("epoch = 1").select("track_uri").distinct().count() == 1


def test_credits_learned_late_name_their_tracks(spark, tmp_path):
    """Changed tracks come from one fold; a track whose first names gave no credit is one of them."""
    feed = trendfeed.CreditFeed(spark, str(tmp_path))
    named = lambda track, artist, listed=None: (1, dt.datetime(2020, 1, 2), dt.date(2020, 1, 1), track, "Title", artist, listed, 60.0)
    first = [named("t1", "Act 1"), named("t2", "Act 2"), named("t3", "\u0391\u03b2")]
    second = [named("t1", "Act 1"), named("t2", "Act 2", "Act 2\u001fAct 3"), named("t3", "\u0391\u03b2", "Act 4"), named("t4", "Act 5")]
    changed = lambda rows, epoch: {r[0] for r in feed.update(frame(spark, rows), epoch).collect()}
    assert changed(first, 0) == set()
    assert changed(second, 1) == {"t2", "t3"}
    assert changed(second, 1) == {"t2", "t3"}  # replayed
    batch = track_credits(frame(spark, first + second))
    assert rows_of(feed.read(), batch.columns) == rows_of(batch, batch.columns)


def stream_of(spark, path, schema, *batches):
    """One file to a micro-batch, in the order given."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{k}")
    return live.stream_table(spark, f"{path}/*", T.StructType.fromDDL(schema), files_per_trigger=1)


def test_discoveries_move_back(spark, tmp_path):
    rows = plays(120, seed=5)
    write = None
    for k in range(3):
        frame(spark, rows[k::3]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = live.stream_table(spark, str(tmp_path / "in"), T.StructType.fromDDL(PLAYS), files_per_trigger=1)
        firsts = s.groupBy("user_id", "artist_name").agg(F.min("month").alias("month"))
        changes, write = trendfeed.discovery_feed(spark, str(tmp_path / "d"), firsts.schema, fold_after=1)
        live.run_to_end(firsts, write, str(tmp_path / "check"))
    want = discovery_rate(frame(spark, rows), ["user_id"])
    assert rows_of(trendfeed.discoveries(changes, ["user_id"]), want.columns) == rows_of(want, want.columns)
    assert want.count() > 5


def test_discovery_batch_replayed(spark, tmp_path):
    schema = T.StructType.fromDDL("artist_name string, month date")
    changes, write = trendfeed.discovery_feed(spark, str(tmp_path), schema)
    day = lambda m: dt.date(2024, m, 1)
    first = spark.createDataFrame([("A", day(5)), ("B", day(6))], schema)
    second = spark.createDataFrame([("A", day(2))], schema)
    for batch, epoch in ((first, 0), (second, 1), (second, 1)):
        write(batch, epoch)
    assert {r.month.month: r.new_artists for r in trendfeed.discoveries(changes).collect()} == {2: 1, 6: 1}


def test_discoveries_from_plays_without_an_aggregate(spark, tmp_path):
    """An artist met twice in a batch, or never named, is one discovery; only moves are written."""
    schema = T.StructType.fromDDL("artist_name string, month date")
    changes, write = trendfeed.discovery_feed(spark, str(tmp_path), schema, fold_after=2)
    day = lambda m: dt.date(2024, m, 1)
    batches = [[("A", day(5)), ("A", day(4)), (None, day(6))], [("A", day(7)), (None, day(6))], [("A", day(2)), ("A", day(3))], [("B", day(2))]]
    for epoch, rows in enumerate(batches):
        write(spark.createDataFrame(rows, schema), epoch)
    assert {r.month.month: r.new_artists for r in trendfeed.discoveries(changes).collect()} == {2: 2, 6: 1}
    seen = store.EpochLog(spark, f"{tmp_path}/firsts", schema)
    assert seen.read().where("epoch = 1").count() == 0


POLLED = "user_id int, ts timestamp_ntz, track_uri string, platform string, n int"


def polled(user, day, track="t", platform="p", n=1):
    return user, None if day is None else dt.datetime(2024, 1, 1) + dt.timedelta(days=day - 1, microseconds=7), track, platform, n


def superseded(spark, tmp_path, by, steps, salts=3):
    """``steps``: (export rows, polled rows) by turn."""
    out = None
    for k, (export, seen) in enumerate(steps):
        for name, rows in (("x", export), ("p", seen)):
            if rows or not k:
                spark.createDataFrame(rows, POLLED).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        schema = T.StructType.fromDDL(POLLED)
        x, p = (live.stream_table(spark, str(tmp_path / n), schema) for n in ("x", "p"))
        out = supersede.supersede_changes(x, p, by, salts=salts)
        live.run_to_end(out, str(tmp_path / "rows"), str(tmp_path / "check"))
    rows = live.read_upserts(spark, str(tmp_path / "rows"), out.schema, [*by, "ts", "track_uri"], order=["step"])
    return rows.where(F.col("state") == supersede.KEPT).drop("state", "step")


def test_supersession_per_listener(spark, tmp_path):
    """An export takes back what it covers, also rows polled later; a row comes once,
    with its lowest content; rows without a time are left out."""
    steps = [
        ([], [polled(1, 3), polled(1, 9), polled(1, 9, platform="a"), polled(2, 3), polled(2, 3), polled(1, None), polled(1, 8, track=None)]),
        ([polled(1, 5), polled(1, 2)], [polled(1, 4), polled(2, 4, n=7)]),
        ([polled(3, 6)], [polled(3, 6), polled(3, 7, n=None), polled(1, 5), polled(2, 3, platform="z")]),
    ]
    got = superseded(spark, tmp_path, ["user_id"], steps)
    assert {(r.user_id, r.ts.day, r.ts.microsecond, r.track_uri, r.platform, r.n) for r in got.collect()} == {
        (1, 9, 7, "t", "a", 1), (1, 8, 7, None, "p", 1), (2, 3, 7, "t", "p", 1), (2, 4, 7, "t", "p", 7), (3, 7, 7, "t", "p", None)}
    assert got.columns == ["user_id", "ts", "track_uri", "platform", "n"]
    rewritten = store.EpochLog(spark, str(tmp_path / "rows"), T.StructType.fromDDL("user_id int, state string")).read()
    changed = collections.Counter((r.epoch, r.user_id, r.state) for r in rewritten.collect())
    assert changed[(1, 1, "superseded")] == 1 and not any(e == 2 and u == 2 for e, u, _ in changed)


def test_supersession_of_one_listener(spark, tmp_path):
    got = superseded(spark, tmp_path, [], [([], [polled(1, 1), polled(1, 2), polled(1, 40)]), ([polled(1, 41)], [polled(1, 70)]), ([], [polled(1, 41), polled(1, 71)])])
    assert sorted(r.ts.timetuple().tm_yday for r in got.collect()) == [70, 71]


def test_folds_change_nothing(spark, tmp_path):
    schema = T.StructType.fromDDL("k string, v int")
    log = store.EpochLog(spark, str(tmp_path / "log"), schema)
    df = lambda *rows: spark.createDataFrame(list(rows), schema)
    for e in range(5):
        log.write(df(("a", e), (f"k{e}", e)), e)
        log.fold(e - 1, store.keep_newest(["k"]), most=2)
    assert len(log.parts()) <= 3
    want = {("a", 4), *((f"k{e}", e) for e in range(5))}
    assert {tuple(r) for r in log.newest(["k"]).collect()} == want
    log.write(df(("a", 9)), 4)  # a replay replaces the batch
    assert {tuple(r) for r in log.newest(["k"]).collect()} == want - {("a", 4), ("k4", 4)} | {("a", 9)}
    # a fold that broke off counts for nothing
    spark.createDataFrame([("z", 1)], schema).write.parquet(str(tmp_path / "log" / "part=f4"))
    (tmp_path / "log" / "part=f4" / "_SUCCESS").unlink()
    assert "z" not in {r.k for r in log.read().collect()}


class FakeState:
    """A value or list state that counts its calls."""

    def __init__(self):
        self.held, self.calls = [], 0

    def exists(self):
        return bool(self.held)

    def get(self):
        self.calls += 1
        return iter(self.held)

    def appendValue(self, v):
        self.calls += 1
        self.held.append(v)

    def put(self, vs):
        self.calls += 1
        self.held = list(vs)


class FakeValue(FakeState):
    def get(self):
        return self.held[0] if self.held else None

    def update(self, v):
        self.held = [v]


@pytest.mark.parametrize("seed", [1, 2])
def test_one_state_serves_many_listeners(seed):
    """Against a plain run row by row; a batch costs calls by the batch, not by the row."""
    r, p = random.Random(seed), supersede.Reconcile(["k0"])
    p.MOST, p.steps, p.cutoffs, p.rows = 3, FakeValue(), FakeState(), FakeState()
    cut, kept, shown, steps = {}, {}, {}, []
    for _ in range(12):
        rows = [(r.randrange(30), 0, r.randrange(40), None, None) if r.random() < 0.1 else
                (r.randrange(30), 0, r.randrange(60), r.choice([None, "a", "b"]), f"b{r.randrange(3)}") for _ in range(60)]
        before = p.cutoffs.calls + p.rows.calls
        for out in p.handleInputRows((0,), iter([pd.DataFrame(rows, columns=["k0", "salt", "at", "track_uri", "body"]).astype({"track_uri": object, "body": object})]), None):
            for k, at, track, body, state, step in out.itertuples(index=False):
                steps.append(step)
                key = (k, at, track or "")
                assert (state == supersede.KEPT) == (body is not None)
                shown.pop(key, None) if body is None else shown.update({key: body})
        assert p.cutoffs.calls + p.rows.calls - before <= 4
        for k, _, at, _, body in rows:
            if body is None:
                cut[k] = max(at, cut.get(k, -1))
        for k, _, at, track, body in rows:
            if body is not None:
                kept[k, at, track or ""] = min(body, kept.get((k, at, track or ""), body))
        kept = {q: b for q, b in kept.items() if q[1] > cut.get(q[0], -1)}
        assert shown == kept
        assert len(p.rows.held) <= 4 and len(p.cutoffs.held) <= 4
    assert steps == sorted(set(steps)) and kept
