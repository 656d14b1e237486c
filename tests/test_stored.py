"""What is stored to be used again: re-ranking and digests."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from earshift.operators import metrics, outlook, quality

SHORT = "mbid string, artist_name string, comment string, score double, n_seeds bigint, via_artists array<string>"


def test_rerank_from_stored_tables(spark, table, tmp_path):
    short = table(SHORT, ("m1", "A", None, 8.0, 2, ["x"]), ("m2", "B", "c", 2.0, 1, ["y"]), ("m3", "C", None, 4.0, 1, []), ("m4", "D", None, 1.0, 1, []))
    tags = table("mbid string, tag string, count bigint", ("m1", "house", 3), ("m1", "soul", 0), ("m2", "soul", 5), ("m2", "pop", 5), ("m3", "jazz", 1), ("zz", "soul", 9))
    base = table("tag string, smoothed_share double, rel_change_per_year double", ("house", 0.5, -0.9), ("soul", 0.3, 3.0), ("pop", 0.2, None))
    for name, df in (("heads", outlook.ranked_heads(short)), ("lists", outlook.postings(short, tags)), ("base", base)):
        df.write.parquet(str(tmp_path / name))
    heads, lists, stored = (spark.read.parquet(str(tmp_path / n)) for n in ("heads", "lists", "base"))
    order = {}
    for lam in (0.0, 2.0):
        taste = {r.tag: r.taste for r in outlook.tilted(stored, lam=lam).collect()}
        raw = {"house": 0.5 * (1 - lam * 0.9), "soul": 0.3 * (1 + lam * 2.0), "pop": 0.2}
        raw = {k: v for k, v in raw.items() if v > 0}
        norm = sum(v * v for v in raw.values()) ** 0.5
        assert taste == pytest.approx({k: v / norm for k, v in raw.items()})
        got = {r.mbid: r for r in outlook.rerank(heads, lists, outlook.tilted(stored, lam=lam)).collect()}
        want = {r.mbid: r for r in outlook.recommend(short, tags, outlook.tilted(base, lam=lam)).collect()}
        assert got == want and set(got) == {"m1", "m2"}
        fit = (4 * taste.get("house", 0) + taste["soul"]) / 17**0.5
        assert got["m1"].trajectory_fit == pytest.approx(fit) and got["m1"].similarity == 1.0 and got["m2"].similarity == 0.25
        order[lam] = sorted(got, key=lambda m: -got[m].score)
    assert order[0.0] == ["m1", "m2"] and order[2.0] == ["m2", "m1"]


def test_runs_are_compared_by_part(spark, tmp_path):
    rows = [(i, f"v{i % 7}", None if i % 5 else float(i)) for i in range(500)] + [(3, "twice", 1.0)] * 2
    changed = [r for r in rows if r[0] != 77] + [(500, "new", None), (3, "twice", 1.0)]
    changed = [(r[0], "other", r[2]) if r[0] == 42 else r for r in changed]
    random.Random(1).shuffle(changed)
    schema = "id int, name string, x double"
    for name, data in (("a", rows), ("b", changed), ("c", rows[::-1])):
        quality.write_digested(spark.createDataFrame(data, schema).repartition(3), str(tmp_path / name), ["id"], parts=50, fan=4)
    at = lambda n: str(tmp_path / n)
    assert quality.differing_parts(spark, at("a"), at("c"), 50, 4) == []
    assert quality.rerun_difference(spark, at("a"), at("c"), 50, 4).count() == 0
    bad = quality.differing_parts(spark, at("a"), at("b"), 50, 4)
    assert 1 <= len(bad) <= 4
    got = collections.Counter(map(tuple, quality.rerun_difference(spark, at("a"), at("b"), 50, 4).collect()))
    want = collections.Counter((*r, "a") for r in (collections.Counter(rows) - collections.Counter(changed)).elements())
    want.update((*r, "b") for r in (collections.Counter(changed) - collections.Counter(rows)).elements())
    assert got == want and sum(want.values()) == 5
    with pytest.raises(ValueError):
        quality.write_digested(spark.range(1).withColumn("_part", F.lit(1)), at("d"), ["id"])


def test_top_percent_with_ties_at_the_cut(spark):
    r = random.Random(3)
    secs = [r.choice([30.0, 45.0, 60.0, 600.0]) for _ in range(1700)] + [6000.0, 6000.5]
    d = spark.createDataFrame([(f"a{i}", s) for i, s in enumerate(secs)], "artist_name string, played_seconds double").withColumn(
        "ts", F.lit("2020-03-01").cast("timestamp_ntz"))
    got = metrics.repeat_concentration(d).first()
    top = sorted(secs, reverse=True)[:18]
    assert (got.artists, got.top_1pct_size) == (1702, 18) and got.top_1pct_share == pytest.approx(sum(top) / sum(secs))
