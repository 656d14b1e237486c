"""Large export files cut over tasks, against the plain reader."""

import collections
import gzip
import json
import random

import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from earshift.schemas import EXPORT
from earshift.sources import exports, jsonsplit
from workload import queries
from workload.adapters import Tables

ODD = ['He said "no {" and }', "back\\slash \\", 'a\\"}, {"b": [', "[x] {y}", "tab\tline\n", "日本 🙂 {é}", "", "}}}}", '{"in": "text"}', "\\\\\"}"]


def events(n, seed=0, nested=False):
    r = random.Random(seed)
    out = []
    for i in range(n):
        e = {"ts": f"2021-01-{i % 27 + 1:02d}T00:00:{i % 60:02d}Z", "platform": r.choice(ODD), "ms_played": i, "ip_addr": "1.1.1.1",
             "master_metadata_track_name": r.choice(ODD) + r.choice(ODD), "skipped": r.choice([True, False, None])}
        if nested and i % 3 == 0:
            e["extra"] = {"a": [{"b": r.choice(ODD)}, {}], "c": {"d": i}}
        out.append(e)
    return out


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "400"}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k in names:
        spark.conf.unset(k)


def rows(df):
    return collections.Counter(tuple(r[c] for c in (*EXPORT.fieldNames(), "source_file")) for r in df.collect())


def test_same_rows_as_the_plain_reader(spark, tmp_path, small_splits):
    put = lambda name, text: (tmp_path / f"Streaming_History_{name}.json").write_text(text)
    put("0", json.dumps(events(200, 1)))
    put("1", json.dumps(events(60, 2, nested=True), indent=2, ensure_ascii=False))
    put("2", json.dumps(events(40, 3))[:-30])  # cut off
    put("3", "[]")
    put("4", json.dumps(events(1, 4)[0]))  # one object
    put("5", json.dumps(events(1, 5)[0])[:-1])
    put("6", json.dumps(events(30, 6))[:-1])  # without its last bracket
    put("7", " [\n" + ",\n".join(json.dumps(e) for e in events(30, 7)) + "\n] \n")
    put("8", json.dumps([{"platform": "x" * 5000 + '"}{', "ms_played": 1}, *events(3, 8)]))  # over many ranges
    put("9", json.dumps(events(9, 9)).replace("}, {", "} oops {", 1))
    text = jsonsplit._text(spark, str(tmp_path), exports.EXPORT_GLOB)
    assert text.where("path LIKE '%_0.json'").select("start").distinct().count() > 20
    got, want = rows(exports.read_split_export(spark, str(tmp_path))), rows(exports.read_export(spark, str(tmp_path)))
    assert {k[-1] for k in want} >= {f"Streaming_History_{i}.json" for i in (0, 1, 4, 7, 8)}
    assert got == want
    put("10", json.dumps(events(9, 10)) + "]")  # goes on: the plain reader doesn't look
    assert rows(exports.read_split_export(spark, str(tmp_path))) == want
    report = {r.source_file.split("_")[-1][:-5]: (r.n_rows, r.failed, r.unknown) for r in exports.file_report(spark, str(tmp_path)).collect()}
    assert report["0"] == (200, False, "OBJECT<>") and report["2"][:2] == report["6"][:2] == report["5"][:2] == (0, True) and "3" not in report
    assert report["1"] == (60, False, "OBJECT<extra: OBJECT<a: ARRAY<OBJECT<b: STRING>>, c: OBJECT<d: BIGINT>>>")


def test_a_field_of_another_type(spark, tmp_path):
    e = events(3)
    e[1]["ms_played"] = "many"
    (tmp_path / "Streaming_History_0.json").write_text(json.dumps(e))
    assert rows(exports.read_split_export(spark, str(tmp_path))) == rows(exports.read_export(spark, str(tmp_path)))
    assert exports.file_report(spark, str(tmp_path)).first()[1:3] == (0, True)


@pytest.mark.parametrize("cut", [1, 3, 10, 50])
def test_any_cut_gives_the_same_elements(cut):
    """The maps of the ranges compose to the states of one run through the text."""
    text = json.dumps(events(25, 11, nested=True))
    pieces = text.split("}")
    runs = [pieces[i:i + cut] for i in range(0, len(pieces), cut)]
    table, found, at = [], [], 0
    for i, run in enumerate(runs):
        ends = [(s, 0) for s in (0, 1, 2)]
        for t in run:
            ends = [jsonsplit.step(t, *e) for e in ends]
        n = sum(len(t.encode()) + 1 for t in run)
        table.append({"path": "f", "start": at, "size": len(text.encode()), "bytes": n, "state": [e[0] for e in ends], "depth": [e[1] for e in ends]})
        at += n
    starts = jsonsplit._starts(pa.Table.from_pylist(table)).to_pylist()
    assert all(s["fine"] for s in starts)
    for run, s in zip(runs, starts):
        c = jsonsplit.Cutter("f", s["start"], s["state"], s["depth"])
        for t in run:
            c.feed(t)
        c.end()
        found += c.take().to_pylist()
    assert not [f for f in found if f["kind"] == "junk"]
    whole = [(f["start"], f["place"], f["element"]) for f in found if f["kind"] == "element"]
    joined = jsonsplit._together(pa.Table.from_pylist([f for f in found if f["kind"] != "element"], schema=jsonsplit.PIECE)).to_pylist()
    got = sorted(json.dumps(json.loads(e)) for e in [x[2] for x in whole] + [j["element"] for j in joined])
    assert got == sorted(json.dumps(e) for e in json.loads(text))


def test_no_writer_gets_a_whole_large_export(spark):
    """An export beyond a writer's lines goes on in further files, and reads as one."""
    t = Tables(spark, "/root/testdata/sf0.001")
    n = t.read("lineitem").count()
    path = queries._one_export_file(t, most=1000)
    sizes = [r.n for r in spark.read.text(path).where("value != ']'").groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == -(-n // 1000) and max(sizes) < 2000
    assert exports.read_split_export(spark, path).count() == n
    assert exports.file_report(spark, path).select("source_file", "n_rows", "failed").collect() == [("Streaming_History_Audio_0.json", n, False)]


def test_export_files_are_put_together_where_rows_are_read(spark):
    """No row is shuffled to write an export; no file has more events than it may."""
    t = Tables(spark, "/root/testdata/sf0.01")
    n = t.read("lineitem").count() + t.read("lineitem").where("l_linenumber = 1").count()
    status = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("export", "export")
    path = queries._export_folder(t)
    stages = sum(len(status.getJobInfo(j).stageIds) for j in status.getJobIdsForGroup("export"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert stages == 1
    sizes = [r.n_rows for r in exports.file_health(spark, path).collect()]
    assert sum(sizes) == n and max(sizes) == queries.FILE_EVENTS
    batch = pa.RecordBatch.from_pydict({"name": ["a", "b"] * 6001, "value": ["{}"] * 12002})
    files = [(b["name"][0].as_py(), len(json.loads(b["value"][0].as_py()))) for b in queries._arrays([batch, batch])]
    assert sorted(files) == [("a", 2), ("a", 4000), ("a", 4000), ("a", 4000), ("b", 2), ("b", 4000), ("b", 4000), ("b", 4000)]


def test_packed_exports_read_as_plain_ones(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    for k, text in enumerate([json.dumps(events(50, 1)), json.dumps(events(20, 2))[:-30]]):
        (tmp_path / "a" / f"Streaming_History_{k}.json").write_text(text)
        (tmp_path / "b" / f"Streaming_History_{k}.json.gz").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "b" / "Streaming_History_2.json").write_text(json.dumps(events(50, 1)))  # beside a plain one
    plain, packed = (exports.read_export(spark, str(tmp_path / x)).drop("source_path", "source_file") for x in "ab")
    assert plain.count() == 50 and collections.Counter(map(str, packed.collect())) == collections.Counter(map(str, plain.unionByName(plain).collect()))
    assert {(r.source_file, r.n_rows, r.failed) for r in exports.file_health(spark, str(tmp_path / "b")).collect()} == {
        ("Streaming_History_0.json.gz", 50, False), ("Streaming_History_1.json.gz", 0, True), ("Streaming_History_2.json", 50, False)}
    with pytest.raises(ValueError):
        exports.read_split_export(spark, str(tmp_path / "b"))


def test_an_export_of_the_lines_is_packed(spark):
    """Its files take less than their text by far; all lines are in them."""
    t = Tables(spark, "/root/testdata/sf0.001")
    path = queries._export_folder(t)
    n = t.read("lineitem").count() + t.read("lineitem").where("l_linenumber = 1").count()
    assert exports.read_export(spark, path).count() == n
    size = exports.export_files(spark, path).agg(F.sum("length")).first()[0]
    text = exports.read_export(spark, path).select(F.length(F.to_json(F.struct(*EXPORT.fieldNames()))).alias("n")).agg(F.sum("n")).first()[0]
    assert size < text / 4
