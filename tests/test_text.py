import pytest
from conftest import column
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from earshift.functions.text import fold_name, pretty, sentence, tag_family, title_key


def keys(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return column(df.select("i", f(F.col("v")).alias("k")), "k", "i")


def test_fold_name(spark):
    want = {
        "Pa$t Mid!ight": "pastmidiight", "The Copper Kites": "copperkites", "Kites of the North": "kitesofnorth", "Thermal": "thermal",
        "Ñandú Éclair": "nandueclair", "Großstadt": "grossstadt", "Ｗｉｄｅ Open": "wideopen", "Salt & Cedar": "saltcedar",
        "Salt and Cedar": "saltcedar", "0rbit@l": "orbital", "": "", None: "", "ﬁeld №9": "fieldno9",
    }
    assert keys(spark, fold_name, list(want)) == list(want.values())


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=12), min_size=1, max_size=40))
def test_keys_are_settled(spark, names):
    """A key has only its own characters, and folding it again changes nothing
    once no dropped word is left in it."""
    names = [n for n in names if not any(0xD800 <= ord(c) < 0xE000 for c in n)]
    once = keys(spark, fold_name, names)
    words = [k for k in once if k not in ("the", "and")]
    assert keys(spark, fold_name, words) == words


def test_other_scripts_keep_a_key(spark):
    names = ["Зимний сад", "зимний САД", "冬の庭", "夏の庭", "The The"]
    got = keys(spark, fold_name, names)
    assert got[0] == got[1] != "" and len(set(got[1:])) == 4 and "" not in got


def test_title_key(spark):
    want = {
        "Glass Meadow - Club Mix": "glassmeadow", "Glass Meadow (Acoustic)": "glassmeadow", "Glass Meadow [Demo]": "glassmeadow",
        "Glass Meadow": "glassmeadow", "Under the Pier - 2011 Remaster": "underpier", "- Demo": "demo", "Hold (the) Line": "hold",
    }
    assert keys(spark, title_key, list(want)) == list(want.values())


@pytest.mark.parametrize("tags, family", [
    (("hardcore hip hop", "grime", "trap soul"), "rap"),
    (("hip house", "uk garage", "speed garage", "hard techno", "bass house", "drum and bass"), "edm"),
    (("garage rock", "garage rock revival", "hardcore punk", "post-hardcore", "metalcore", "dancehall",
      "heavy metal", "indie rock", "soul", "pop", "", None), None),
])
def test_tag_family(spark, tags, family):
    assert set(keys(spark, tag_family, tags)) == {family}


def test_display(spark):
    assert keys(spark, pretty, ["uk garage", "melodic edm", "soul"]) == ["UK garage", "melodic EDM", "soul"]
    assert keys(spark, sentence, ["uk Garage", ""]) == ["Uk Garage", ""]


def test_only_names_outside_ascii_meet_python(spark):
    from earshift.functions.text import with_folded

    names = ["The Beatles", "Björk", "BJORK", None, "", "Ünï & Söhne", "東京事変", "Björk", "A$AP", "The"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string")
    both = with_folded(df, key="name").withColumn("one", fold_name(F.col("name")))
    rows = both.collect()
    assert len(rows) == len(names) and all(r.key == r.one for r in rows)
    plan = with_folded(df, key="name")._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("ArrowEvalPython"):]
    assert plan.count("ArrowEvalPython") == 1 and "HashAggregate" in below  # distinct names first


def test_joined_keys_fold_distinct_names_only(spark, tmp_path):
    """A join on a folded key must not fold every row below the distinct."""
    from earshift.operators import playlists

    schema = "artist_name string, track_name string, track_uri string, artists array<string>, rank int"
    spark.createDataFrame([("A", "t", "u", ["A"], 1)], schema).write.parquet(str(tmp_path / "t"))
    plan = playlists.credited_tracks(spark.read.parquet(str(tmp_path / "t")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2  # one for the requested names, one for the credits
