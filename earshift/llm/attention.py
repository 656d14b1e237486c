"""Text quality by attention-based multiple-instance learning.

A document is a bag of passages.  An encoder turns each passage into a vector;
gated attention weighs the passages, tanh(V h) * sigmoid(U h) projected on one
number and normalised over the document; the weighted vector gives the score.  Only the
document's label is known in training: which passages matter is learned.

Passages are encoded from hashed words, through a learned table, and from shape
measures of the words and how they repeat.  All of it is numpy on batches of
documents; words are looked up once each.
"""

import io
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import materialise, work_dir
from .text import whole

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PASSAGE = 64  # words
BUCKETS, WIDE, HIDDEN, GATE = 2048, 8, 24, 16
MARKS = "#*$%&|<>!?.,"
CASES = 8  # measures of a word besides its marks
SHAPES = len(MARKS) + CASES + 4  # and of a passage: length, repeats of three kinds
#: The model is fitted on so many different labelled texts at most, of at most so
#: many characters each, chosen by a hash of their ids.
FIT_TEXTS, FIT_CHARS = 6000, 20_000
#: Words that a task remembers.
KNOWN_WORDS = 400_000


class Encoder:
    """Texts to passages: hashed words and measures."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.bucket, self.shape = np.zeros(1024, np.int64), np.zeros((1024, len(MARKS) + CASES), np.float32)

    def learn(self, word: str) -> int:
        i = len(self.known)
        if i == len(self.bucket):
            self.bucket = np.concatenate([self.bucket, np.zeros_like(self.bucket)])
            self.shape = np.concatenate([self.shape, np.zeros_like(self.shape)])
        self.known[word] = i
        n = len(word)
        self.bucket[i] = zlib.crc32(word.lower().encode("utf-8", "replace")) % BUCKETS
        letters, digits = sum(map(str.isalpha, word)), sum(map(str.isdigit, word))
        self.shape[i] = [*(min(word.count(c), 4) for c in MARKS), np.log1p(n), letters / n, digits / n, word.isupper() and n > 1,
                         word[0].isupper(), not word.isascii(), n == 1, n > 20]
        return i

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bucket of each word, passage of each word, measures by passage,
        document of each passage).  Every text has a passage, if an empty one."""
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        get, learn = self.known.get, self.learn
        found, count = [], np.zeros(len(texts), np.int64)
        for d, t in enumerate(texts):
            w = t.split()
            count[d] = len(w)
            found.extend([i if (i := get(x)) is not None else learn(x) for x in w])
        w = np.array(found, np.int64)
        doc = np.repeat(np.arange(len(texts)), count)
        place = np.arange(len(w)) - np.repeat(np.cumsum(count) - count, count)
        n_pass = np.maximum(1, -(-count // PASSAGE))
        first = np.cumsum(n_pass) - n_pass
        passage, p = first[doc] + place // PASSAGE, int(n_pass.sum())
        size = np.bincount(passage, minlength=p).astype(np.float32)
        shape = np.zeros((p, SHAPES), np.float32)
        if len(w):
            filled = np.flatnonzero(size)
            shape[filled, :-4] = np.add.reduceat(self.shape[w], np.searchsorted(passage, filled), axis=0) / size[filled, None]
            same = np.zeros(len(w), bool)
            same[1:] = (w[1:] == w[:-1]) & (doc[1:] == doc[:-1])
            in_passage = repeated(passage * np.int64(len(self.bucket)) + w)
            three = (w[:-2] * np.int64(1 << 20) + w[1:-1]) * np.int64(0x9E3779B1) + w[2:] if len(w) > 2 else w[:0]
            held = np.zeros(len(w), bool)
            if len(three):
                inside = doc[2:] == doc[:-2]
                held[2:][inside] = repeated(three[inside] * np.int64(0x9E3779B1) + doc[2:][inside])
            for c, flag in ((-3, same), (-2, in_passage), (-1, held)):
                shape[:, c] = np.bincount(passage[flag], minlength=p) / np.maximum(size, 1)
        shape[:, -4] = np.log1p(size) / 4
        return self.bucket[w], passage, shape, np.repeat(np.arange(len(texts)), n_pass)


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether an equal key stands earlier."""
    order = np.argsort(keys, kind="stable")
    out = np.zeros(len(keys), bool)
    out[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def bags(bucket: np.ndarray, passage: np.ndarray, n: int) -> np.ndarray:
    """Share of each bucket among a passage's words."""
    out = np.bincount(passage * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS).astype(np.float32)
    return out / np.maximum(out.sum(axis=1, keepdims=True), 1)


def forward(m: dict[str, np.ndarray], word: np.ndarray, shape: np.ndarray, doc: np.ndarray, docs: int) -> dict[str, np.ndarray]:
    """``word``: mean word vector by passage."""
    x = np.hstack([word, (shape - m["mean"]) / m["scale"]])
    h = np.tanh(x @ m["w"] + m["b"])
    t, s = np.tanh(h @ m["v"]), sigmoid(h @ m["u"])
    e = (t * s) @ m["a"]
    top = np.full(docs, -np.inf, e.dtype)
    np.maximum.at(top, doc, e)
    e = np.exp(e - top[doc])
    share = e / np.bincount(doc, e, docs)[doc]
    edges = np.searchsorted(doc, np.arange(docs))
    z = np.add.reduceat(share[:, None] * h, edges, axis=0)
    return {"x": x, "h": h, "t": t, "s": s, "share": share, "z": z, "p": sigmoid(z @ m["c"] + m["d"])}


def step(m: dict[str, np.ndarray], bag: np.ndarray, shape: np.ndarray, doc: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of the mean log loss over a batch of documents."""
    f = forward(m, bag @ m["e"], shape, doc, len(y))
    g = (f["p"] - y) / len(y)
    gz = g[:, None] * m["c"]
    into = (gz[doc] * f["h"]).sum(axis=1)  # by each passage's share
    mean = np.bincount(doc, f["share"] * into, len(y))
    ge = f["share"] * (into - mean[doc])
    gt, gs = ge[:, None] * m["a"] * f["s"] * (1 - f["t"] ** 2), ge[:, None] * m["a"] * f["t"] * f["s"] * (1 - f["s"])
    gh = (f["share"][:, None] * gz[doc] + gt @ m["v"].T + gs @ m["u"].T) * (1 - f["h"] ** 2)
    gx = gh @ m["w"].T
    return {"c": f["z"].T @ g, "d": g.sum(keepdims=True), "a": (f["t"] * f["s"]).T @ ge, "v": f["h"].T @ gt, "u": f["h"].T @ gs,
            "w": f["x"].T @ gh, "b": gh.sum(axis=0), "e": bag.T @ gx[:, :WIDE]}


def fit(texts: list[str], labels: np.ndarray, epochs: int = 16, batch: int = 64, rate: float = 0.004, seed: int = 0) -> dict[str, np.ndarray]:
    """Adam on the log loss."""
    r = np.random.default_rng(seed)
    normal = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    bucket, passage, shape, doc = Encoder()(texts)
    n = len(texts)
    m = {"e": 0.1 * normal(BUCKETS, WIDE), "w": normal(WIDE + SHAPES, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "v": normal(HIDDEN, GATE),
         "u": normal(HIDDEN, GATE), "a": normal(GATE), "c": normal(HIDDEN), "d": np.zeros(1, np.float32)}
    still = {"mean": shape.mean(axis=0) if n else np.zeros(SHAPES, np.float32), "scale": (shape.std(axis=0) if n else np.zeros(SHAPES, np.float32)) + 1e-3}
    if not n:
        return m | still
    rows, cells = np.searchsorted(doc, np.arange(n + 1)), np.searchsorted(passage, np.arange(len(doc) + 1))
    first, second = ({k: np.zeros_like(x) for k, x in m.items()} for _ in range(2))
    t = 0
    for epoch in range(epochs):
        order = r.permutation(n)
        for lo in range(0, n, batch):
            pick = np.sort(order[lo:lo + batch])
            p = np.concatenate([np.arange(rows[i], rows[i + 1]) for i in pick])
            own = np.repeat(np.arange(len(pick)), rows[pick + 1] - rows[pick])
            w = np.concatenate([np.arange(cells[i], cells[i + 1]) for i in p])
            bag = bags(bucket[w], np.repeat(np.arange(len(p)), cells[p + 1] - cells[p]), len(p))
            g, t = step(m | still, bag, shape[p], own, labels[pick]), t + 1
            pace = rate * (0.1 + 0.9 * (1 - epoch / epochs))
            for k in m:
                first[k] += 0.1 * (g[k] - first[k])
                second[k] += 0.001 * (g[k] ** 2 - second[k])
                m[k] = (m[k] - pace * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return m | still


def scores(m: dict[str, np.ndarray], encoder: Encoder, texts: list[str]) -> np.ndarray:
    bucket, passage, shape, doc = encoder(texts)
    word = np.zeros((len(doc), WIDE), np.float32)
    if len(bucket):
        filled, start = np.unique(passage, return_index=True)
        n = np.diff(np.append(start, len(passage)))
        word[filled] = np.add.reduceat(m["e"][bucket], start, axis=0) / n[:, None]
    return forward(m, word, shape, doc, len(texts))["p"].astype(np.float64)


def held_out(doc_id: str = "doc_id"):
    """Rows that no label is learned from: crc32 of the id's text leaves 0 by 5."""
    return F.crc32(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit_rows(df: DataFrame, labels: DataFrame, text: str, doc_id: str, label: str, most: int, chars: int, base: str) -> DataFrame:
    """(text, label) of at most ``most`` labelled texts, none of them held out.
    Copies of a text with one label count once; an id whose labels disagree not at all."""
    id_, lab = F.col(f"`{doc_id}`"), F.col(f"`{label}`").cast("int")
    known = labels.where(lab.isNotNull() & id_.isNotNull() & ~held_out(doc_id)).groupBy(id_.alias("doc_id")).agg(F.min(lab).alias("y"), F.max(lab).alias("_z"))
    known = known.where("y = _z AND y IN (0, 1)").select("doc_id", "y")
    rows = df.select(id_.alias("doc_id"), whole(F.col(f"`{text}`")).alias("text")).where(id_.isNotNull())
    light = rows.select("doc_id", F.length("text").alias("n"), F.xxhash64("text").alias("h")).where(F.col("n") <= chars).join(known, "doc_id")
    each = light.groupBy("h", "n", "y").agg(F.min("doc_id").alias("doc_id"))
    chosen = materialise(each.orderBy(F.xxhash64("doc_id", F.lit("fit")), "h").limit(most).select("doc_id", "y", "h"), "chosen", base)
    found = rows.join(F.broadcast(chosen), "doc_id").where(F.xxhash64("text") == F.col("h"))  # at most ``most`` rows
    return found.select("doc_id", "text", "y").distinct()


def train(df: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality",
          most: int = FIT_TEXTS, chars: int = FIT_CHARS) -> dict[str, np.ndarray]:
    """The model, fitted in one task on the bounded sample."""
    base = work_dir(df.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        out = io.BytesIO()
        np.savez(out, **fit(table.column("text").to_pylist(), table.column("y").to_numpy().astype(np.float32)))
        return pa.table({"model": pa.array([out.getvalue()], pa.binary())})

    rows = fit_rows(df, labels, text, doc_id, label, most, chars, base)
    got = rows.groupBy(F.lit(0).alias("_all")).applyInArrow(run, "model binary").first()
    return dict(np.load(io.BytesIO(got["model"]))) if got else fit([], np.zeros(0, np.float32))


def score(df: DataFrame, model: dict[str, np.ndarray], text: str = "text", doc_id: str = "doc_id", cut: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted; one row per row.

    Null texts count as empty, which have one passage without words and so a
    score like any other.  A null id counts as empty text, and so as held out.
    Repeated rows are scored each; an empty table gives an empty one; further
    columns, whatever their names, are no inputs.
    """
    rows = df.select(F.col(f"`{doc_id}`").alias("doc_id"), held_out(doc_id).alias("held_out"), whole(F.col(f"`{text}`")).alias("text"))
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores(model, encoder, part.column(2).to_pylist()))], names=schema.fieldNames())

    return rows.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= cut).cast("int"))


def classify(df: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality",
             most: int = FIT_TEXTS, chars: int = FIT_CHARS, cut: float = 0.3) -> DataFrame:
    """Fits on the labelled rows that are not held out and scores every row.
    Without any label the model is the untrained one, about 0.5 for all."""
    return score(df, train(df, labels, text, doc_id, label, most, chars), text, doc_id, cut)
