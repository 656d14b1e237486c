"""Large JSON arrays of objects, read by many tasks.

Spark parses a JSON array file in one task.  Here it is read as text that ends
at closing braces, which Spark splits by byte range.  Whether a brace closes an
element depends on quotes, escapes and depth before it, so a first pass sums
each range up as a map from the state it starts in to the state it ends in;
composed along a file they give every range its true start.  The second pass
cuts the elements; those that lie across ranges are put together from their
pieces, an element a row.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import materialise, work_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Where a text stands: outside of strings, in one, or in one after a backslash.
OUT, IN, ESCAPED = 0, 1, 2
PAIR = re.compile(r"\\.", re.S)


def masked(text: str, state: int) -> tuple[str, bool]:
    """The text with escaped signs blanked, and whether a backslash waits at its end."""
    if state == ESCAPED and text:
        text = "_" + text[1:]
    if "\\" not in text:
        return text, False
    text = PAIR.sub("__", text)
    return text, text.endswith("\\")


def step(text: str, state: int, depth: int) -> tuple[int, int]:
    """State and depth after a piece of text and the brace that ended it."""
    if state == ESCAPED and not text:
        return IN, depth  # the brace is what was escaped
    text, waits = masked(text, state)
    parts = text.split('"')
    inside = state != OUT
    for p in parts[inside::2]:
        if p:
            depth += p.count("{") + p.count("[") - p.count("]")
    end = IN if (len(parts) - 1 + inside) % 2 else OUT
    if end == OUT:
        return OUT, depth - 1
    return IN, depth  # the brace is text; escaped or not, the string goes on


def first_brace(text: str) -> int:
    """Place of the first opening brace outside of strings, from outside; -1 if none."""
    at = text.find("{")
    if at < 0 or '"' not in text[:at]:
        return at
    lo = 0
    for i, p in enumerate(masked(text, OUT)[0].split('"')):
        if i % 2 == 0 and "{" in p:
            return lo + p.index("{")
        lo += len(p) + 1
    return -1


def _text(spark: SparkSession, path: str, glob: str) -> DataFrame:
    rows = spark.read.option("lineSep", "}").option("pathGlobFilter", glob).text(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
                       F.col("_metadata.file_size").alias("size"), "value")


def _runs(batches: Iterator[pa.RecordBatch], more: str) -> Iterator[tuple[tuple[str, int, int], list[str]]]:
    """Neighbouring rows of one byte range, with its path, start and the column ``more``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        path, begin, third = batch.column("path"), batch.column("start").to_numpy(), batch.column(more)
        names = path.dictionary_encode().indices.to_numpy()
        edges = [0, *(np.flatnonzero((np.diff(begin) != 0) | (np.diff(names) != 0)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            yield (path[lo].as_py(), int(begin[lo]), third[lo].as_py()), batch.column("value").slice(lo, hi - lo).to_pylist()


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, ends, length = None, None, 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"path": now[0], "start": now[1], "size": now[2], "bytes": length,
                                            "state": [e[0] for e in ends], "depth": [e[1] for e in ends]}])

    for key, texts in _runs(batches, "size"):
        if key != now:
            if now:
                yield row()
            now, ends, length = key, [(OUT, 0), (IN, 0), (ESCAPED, 0)], 0
        for t in texts:
            ends = [step(t, *e) for e in ends]
            length += len(t.encode()) + 1
    if now:
        yield row()


def _starts(table: pa.Table) -> pa.Table:
    """One file's ranges in order, each with the state and depth it starts in, and
    whether the file ends as a whole array or object does."""
    rows = table.sort_by("start").to_pylist()
    state, depth, out = OUT, 0, []
    for r in rows:
        out.append({"path": r["path"], "start": r["start"], "state": state, "depth": depth})
        state, depth = r["state"][state], depth + r["depth"][state]
    if sum(r["bytes"] for r in rows) != rows[0]["size"]:
        depth += 1  # the file doesn't end in the brace that the last piece was given
    fine = state == OUT and depth == 0
    return pa.Table.from_pylist([o | {"fine": fine} for o in out], schema=pa.schema(
        [("path", pa.string()), ("start", pa.int64()), ("state", pa.int32()), ("depth", pa.int32()), ("fine", pa.bool_())]))


PIECE = pa.schema([("path", pa.string()), ("start", pa.int64()), ("place", pa.int32()), ("kind", pa.string()), ("element", pa.string())])
ELEMENT, HEAD, THROUGH, TAIL, JUNK = "element", "head", "through", "tail", "junk"


class Cutter:
    """Cuts one byte range, given the state and depth that it starts in."""

    def __init__(self, path: str, start: int, state: int, depth: int):
        self.path, self.start, self.state, self.depth = path, start, state, depth
        self.inside = state != OUT or depth > 1
        self.early = self.inside  # what is held began before this range
        self.held: list[str] = []
        self.found: list[tuple] = []
        self.place = 0

    def put(self, kind: str, element: str | None) -> None:
        self.found.append((self.path, self.start, self.place, kind, element))
        self.place += 1

    def feed(self, text: str) -> None:
        depth = self.depth
        self.state, self.depth = step(text, self.state, depth)
        if not self.inside:
            at = first_brace(text)
            between = (text if at < 0 else text[:at]).strip()
            if between not in ((",", "]") if depth == 1 else ("[", "[]", "")) or (between == "]") != (at < 0 and depth == 1):
                self.put(JUNK, None)
            if at < 0:
                return
            self.inside, self.early, text = True, False, text[at:]
        self.held += [text, "}"]
        if self.state == OUT and self.depth <= 1:
            self.put(HEAD if self.early else ELEMENT, "".join(self.held))
            self.held, self.inside, self.early = [], False, False

    def end(self) -> None:
        if self.inside:
            self.put(THROUGH if self.early else TAIL, "".join(self.held))

    def take(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([f[i] for f in self.found], t.type) for i, t in enumerate(PIECE)], schema=PIECE)
        self.found = []
        return out


def _together(table: pa.Table) -> pa.Table:
    """Elements of one file that lie across ranges; only their pieces come here."""
    out, held = [], []
    for r in table.sort_by([("start", "ascending"), ("place", "ascending")]).to_pylist():
        held = [r["element"]] if r["kind"] == TAIL else [*held, r["element"]]
        if r["kind"] == HEAD:
            out.append({"path": r["path"], "element": "".join(held)})
            held = []
    return pa.Table.from_pylist(out, schema=pa.schema([("path", pa.string()), ("element", pa.string())]))


def elements(spark: SparkSession, path: str, glob: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """((path, element) of every object in the files' arrays, (path, fine) of the
    files).  A file is not fine if it ends too early or if something else than
    commas and white space stands between its objects; its elements are given
    too.  An object on its own is an array of one.

    What reaches every task is one state per byte range: 16 bytes for a range of
    ``spark.sql.files.maxPartitionBytes``.
    """
    base = work_dir(spark)
    text = _text(spark, path, glob)
    ranges = text.mapInArrow(_sum_up, "path string, start long, size long, bytes long, state array<long>, depth array<long>")
    starts = materialise(ranges.groupBy("path").applyInArrow(_starts, "path string, start long, state int, depth int, fine boolean"), "starts", base)
    got = starts.select(F.xxhash64("path", "start").alias("h"), "state", "depth").orderBy("h").toArrow()
    known, states, depths = (got.column(c).to_numpy() for c in ("h", "state", "depth"))
    if (np.diff(known) == 0).any():
        raise ValueError("two byte ranges with one hash")
    table = spark.sparkContext.broadcast((known, states, depths))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, states, depths = table.value
        now, cutter = None, None
        for key, texts in _runs(batches, "h"):
            if key != now:
                if cutter:
                    cutter.end()
                    yield cutter.take()
                i = int(np.searchsorted(known, key[2]))
                now, cutter = key, Cutter(key[0], key[1], int(states[i]), int(depths[i]))
            for t in texts:
                cutter.feed(t)
            yield cutter.take()
        if cutter:
            cutter.end()
            yield cutter.take()

    cuts = materialise(text.withColumn("h", F.xxhash64("path", "start")).mapInArrow(cut, "path string, start long, place int, kind string, element string"), "cuts", base)
    across = cuts.where(F.col("kind").isin(HEAD, THROUGH, TAIL)).groupBy("path").applyInArrow(_together, "path string, element string")
    odd = cuts.where(F.col("kind") == JUNK).select("path").distinct().withColumn("_odd", F.lit(True))
    files = starts.groupBy("path").agg(F.min("fine").alias("fine")).join(odd, "path", "left").select(
        "path", (F.col("fine") & F.col("_odd").isNull()).alias("fine"))
    return cuts.where(F.col("kind") == ELEMENT).select("path", "element").unionByName(across), files
