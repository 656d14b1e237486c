import datetime as dt

from conftest import column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earshift.sources import tables
from earshift.streaming import live

EVENTS = "ts timestamp_ntz, track_uri string, artist_name string, played_seconds double, track_artists string"


def batch(spark, path, *rows):
    """One file, so one micro-batch with maxFilesPerTrigger 1."""
    spark.createDataFrame(list(rows), EVENTS).coalesce(1).write.mode("append").parquet(path)


def event(day, uri="t", artist="A", secs=1.0, listed=None, hour=0):
    return (dt.datetime(2024, 1, 1) + dt.timedelta(days=day - 1, hours=hour), uri, artist, secs, listed)


def stream(spark, path):
    return live.stream_table(spark, path, T.StructType.fromDDL(EVENTS), files_per_trigger=1)


def run(spark, tmp_path, make, key, mode="update", batches=()):
    src, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for rows in batches:
        batch(spark, src, *rows)
        df = make(stream(spark, src))
        live.run_to_end(df, out, check, mode)
    return live.read_upserts(spark, out, df.schema, key)


def test_rollup_over_batches_equals_batch(spark, tmp_path):
    batches = [[event(1), event(1, hour=23), event(2, artist="B")], [event(2, artist="B", hour=5), event(3)], [event(2, secs=4.0), event(35)]]
    make = lambda s: live.daily_rollup(s, ["artist_name"])
    days = run(spark, tmp_path, make, ["day", "artist_name"], batches=batches)
    got = sorted((str(r.day), r.artist_name, r.plays, r.secs) for r in days.collect())
    assert got == [("2024-01-01", "A", 2, 2.0), ("2024-01-02", "A", 1, 4.0), ("2024-01-02", "B", 2, 2.0),
                   ("2024-01-03", "A", 1, 1.0), ("2024-02-04", "A", 1, 1.0)]
    months = live.months_from_days(days, ["artist_name"])
    assert sorted((str(r.month), r.artist_name, r.plays) for r in months.collect()) == [
        ("2024-01-01", "A", 4), ("2024-01-01", "B", 2), ("2024-02-01", "A", 1)]


def test_first_seen_moves_back_for_late_rows(spark, tmp_path):
    d = run(spark, tmp_path, lambda s: live.first_seen(s, ["artist_name"]), ["artist_name"],
            batches=[[event(5), event(9, artist="B")], [event(2), event(10, artist="B")]])
    assert {r.artist_name: r.first_ts.day for r in d.collect()} == {"A": 2, "B": 9}


def test_dedupe_across_batches(spark, tmp_path):
    d = run(spark, tmp_path, lambda s: live.dedupe_stream(s), ["ts", "track_uri"], "append",
            [[event(1), event(1), event(2)], [event(1), event(3)], [event(90)], [event(4)], [event(90), event(2)]])
    assert column(d, "ts", "ts") == [dt.datetime(2024, 1, d) for d in (1, 2, 3, 4)] + [event(90)[0]]


def test_late_rows_reach_their_day(spark, tmp_path):
    make = lambda s: live.daily_rollup(s, ["artist_name"])
    days = run(spark, tmp_path, make, ["day", "artist_name"], batches=[[event(1)], [event(60)], [event(1)], [event(30)]])
    assert sorted((r.day.timetuple().tm_yday, r.plays) for r in days.collect()) == [(1, 2), (30, 1), (60, 1)]


def test_nothing_written_yet(spark, tmp_path):
    schema = T.StructType.fromDDL("k string, n int")
    assert live.read_upserts(spark, str(tmp_path / "none"), schema, ["k"]).count() == 0


def test_a_table_may_be_a_folder_or_a_file(spark, tmp_path):
    df = spark.createDataFrame([event(1), event(2)], EVENTS).repartition(2)
    df.write.parquet(str(tmp_path / "events.parquet"))
    part = str(next((tmp_path / "events.parquet").glob("part-*.parquet")))
    for path, n in ((str(tmp_path / "events.parquet"), 2), (part, 1)):
        s = live.stream_table(spark, path, T.StructType.fromDDL(EVENTS))
        live.run_to_end(live.dedupe_stream(s), str(tmp_path / f"o{n}"), str(tmp_path / f"c{n}"), "append")
        assert live.read_upserts(spark, str(tmp_path / f"o{n}"), s.schema, ["ts"]).count() == n


def test_credit_repair(spark, tmp_path):
    rows = [event(1, "t1"), event(2, "t1", listed="A\u001fB"), event(3, "t2")]
    listed = run(spark, tmp_path, live.listed_artists, ["track_uri"], batches=[rows])
    plays = spark.createDataFrame(rows, EVENTS)
    got = live.with_listed_artists(plays, listed)
    assert column(got, "track_artists", "ts") == ["A\u001fB", "A\u001fB", None]


def test_work_dir_uses_the_shared_folder(spark):
    assert tables.work_dir(spark).startswith(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    df = tables.materialise(spark.range(3).withColumn("x", F.lit("a")), "t")
    assert df.count() == 3
