"""Whitening, the quality classifier and token alignment against brute force."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from earshift.llm import align, attention, whiten
from earshift.llm.queries import PAIR

FILES = [P.path(f) for f in PAIR]
VECTORS = "vec_id long, embedding array<float>, label int, x int, n string"
DOCS = "doc_id long, text string, lang string, uid string, k int, block long, score string"


# ---- whitening

def plain_whitening(vectors, components=32):
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    total = [sum(r[i] for r in x) for i in range(d)]
    away = np.array([[float(r[i] - total[i] // n) - (total[i] % n) / n for i in range(d)] for r in x])
    values, z = np.linalg.eigh(away.T @ away / n)
    values, z = values[::-1], z[:, ::-1]
    return n, [sum((n * r[i] - total[i]) ** 2 for i in range(d)) for r in x], values, away @ z[:, :components] / np.sqrt(np.abs(values[:components])), z


def vectors(n, d, seed=0):
    r = np.random.default_rng(seed)
    return (r.standard_normal((n, d)) * np.linspace(1, 3, d) + r.standard_normal((n, 1))).astype(np.float32).tolist()


def held(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "n") for i, v in rows], VECTORS)


def test_whitening_equals_plain(spark, monkeypatch):
    monkeypatch.setattr(whiten, "BLOCK_ROWS", 7)
    monkeypatch.setattr(whiten, "FAN", 2)
    good = vectors(200, 40)
    good += [good[0]] * 60  # one vector often
    nan, inf = float("nan"), float("inf")
    bad = [None, [], [nan] + good[0][1:], [None] + good[0][1:], good[0][:-1] + [-inf], [1.0, 2.0], [3e38] + good[0][1:]]
    rows = [(i, v) for i, v in enumerate(good)] + [(1000 + i, v) for i, v in enumerate(bad)] + [(None, good[1])]
    out = whiten.whiten(held(spark, rows).repartition(11)).collect()
    n, deviation, values, white, _ = plain_whitening(good + [good[1]])
    assert len(out) == 32 * 261 and {r["n"] for r in out} == {n}
    got = np.full((261, 32), np.nan)
    for r in out:
        i = 260 if r["vec_id"] is None else r["vec_id"]
        got[i, r["component"] - 1] = r["whitened"]
        assert r["deviation"] == deviation[i]
        assert abs(r["explained"] - values[r["component"] - 1] / values.sum()) <= 1e-12
        assert r["identity_error"] < 1e-12
    sign = np.sign((got * white).sum(axis=0))
    assert np.abs(got * sign - white).max() < 1e-9


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]])
def test_nothing_to_whiten(spark, rows):
    assert whiten.whiten(held(spark, rows)).collect() == []


def test_fewer_directions_than_components(spark):
    v = [a + [5.0] + a[:2] for a in vectors(30, 4, seed=3)]  # one constant and two repeated entries
    out = whiten.whiten(held(spark, list(enumerate(v))))
    assert sorted(r[0] for r in out.select("component").distinct().collect()) == [1, 2, 3, 4]


def test_giant_entries_stay_exact():
    c = whiten.Centre(3, [3 * 2**40 + 1, 5])
    x = np.array([[2**40, 1], [2**40 + 1, 2], [2**40, 2]])
    assert c.deviations(x) == [(3 * a - 3 * 2**40 - 1) ** 2 + (3 * b - 5) ** 2 for a, b in x.tolist()]
    assert whiten.Centre(10**6, [0]).deviations(np.array([[2**50], [1]])) == [None, 10**12]


@pytest.mark.parametrize("scale", ["even", "graded", "equal", "blocks"])
def test_spectrum(scale):
    r = np.random.default_rng(5)
    a = {"even": r.standard_normal((300, 24)), "graded": r.standard_normal((300, 24)) @ np.diag(10.0 ** -np.linspace(0, 6, 24)),
         "equal": np.repeat(np.eye(24), 2, axis=0), "blocks": np.kron(np.eye(3), r.standard_normal((20, 8)))}[scale]
    c = a - a.mean(axis=0)
    values, z, trace = whiten.spectrum(whiten.triangle(c), len(a), 24)
    cov = c.T @ c / len(a)
    true = np.linalg.svd(c, compute_uv=False) ** 2 / len(a)
    assert np.allclose(values, true[:len(values)], rtol=1e-9) and np.isclose(trace, true.sum())
    assert np.abs(z.T @ z - np.eye(len(values))).max() < 1e-10
    assert np.abs(cov @ z - z * values).max() < 1e-13 * max(1, values[0])


# ---- quality

def test_gradient_is_that_of_the_loss():
    r = np.random.default_rng(1)
    texts = ["one two three", "", " ".join(f"w{i % 9}" for i in range(200)), "A! B! C!"]
    y = np.array([1, 0, 0, 1.0])
    bucket, passage, shape, doc = attention.Encoder()(texts)
    m = {k: v.astype(np.float64) for k, v in attention.fit(texts, y.astype(np.float32), epochs=1).items()}
    bag = attention.bags(bucket, passage, len(doc)).astype(np.float64)

    def loss():
        p = attention.forward(m, bag @ m["e"], shape, doc, len(y))["p"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for k, g in attention.step(m, bag, shape, doc, y).items():
        for _ in range(4):
            at = tuple(r.integers(s) for s in m[k].shape) if k != "e" else (int(r.choice(bucket)), int(r.integers(attention.WIDE)))
            keep, h = m[k][at], 1e-5
            m[k][at] = keep + h
            up = loss()
            m[k][at] = keep - h
            low = loss()
            m[k][at] = keep
            assert abs((up - low) / (2 * h) - g[at]) < 1e-6, k


def test_passages_and_attention():
    texts = [" ".join(f"w{i}" for i in range(130)), "", "a a a a"]
    bucket, passage, shape, doc = attention.Encoder()(texts)
    assert len(bucket) == 134 and doc.tolist() == [0, 0, 0, 1, 2] and passage[129] == 2 and passage[-1] == 4
    assert shape[4, -3] == 0.75 and shape[4, -2] == 0.75 and shape[4, -1] == 0.25 and shape[3].sum() == 0
    m = attention.fit(texts, np.array([1, 1, 0], np.float32), epochs=1)
    f = attention.forward(m, np.zeros((5, attention.WIDE), np.float32), shape, doc, 3)
    assert np.allclose(np.bincount(doc, f["share"]), 1)


@pytest.fixture(scope="module")
def marked(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("etaoinsh") for _ in range(r.randint(2, 8)))
    rows, labels = [], []
    for i in range(600):
        w = [word() for _ in range(r.randint(20, 300))]
        bad = i % 4 == 0
        if bad:  # one stretch of a long text
            at = r.randrange(len(w))
            w[at:at] = [word() + "!!" for _ in range(20)] if i % 8 else [w[at]] * 30
        rows.append((i, " ".join(w), "en", "u", 1, 2, "s"))
        labels.append((i, 0 if bad else 1))
    return rows, labels


def test_classifier_on_held_out_rows(spark, marked):
    rows, labels = marked
    more = [(None, None, None, None, None, None, None), (9000, "", None, None, None, None, None), rows[0], (9001, "x" * 300_000, "", "", 0, 0, ""),
            (9002, "word " * 60_000, "", "", 0, 0, "")]
    out = attention.classify(spark.createDataFrame(rows + more, DOCS).repartition(3), spark.createDataFrame(labels + [(1, 0), (None, 1), (2, None)], "doc_id long, quality int"))
    got = out.collect()
    assert len(got) == len(rows) + len(more) and out.columns == ["doc_id", "held_out", "score", "predicted"]
    right = []
    for r in got:
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
        if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 600:
            right.append(r["predicted"] == dict(labels)[r["doc_id"]])
    assert len(right) > 90 and sum(right) / len(right) > 0.93


def test_labels_of_held_out_rows_and_other_columns_count_for_nothing(spark, marked):
    rows, labels = marked
    held_out = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    swapped = [(i, 1 - q) if held_out(i) else (i, q) for i, q in labels]
    docs = spark.createDataFrame(rows, DOCS)
    score = lambda lab, d=docs: {r["doc_id"]: r["score"] for r in attention.classify(d, spark.createDataFrame(lab, "doc_id long, quality int")).collect()}
    first = score(labels)
    other = spark.createDataFrame([(*r[:2], "zz", "v", 9, 9, "1.0") for r in rows], DOCS)
    for again in (score(swapped), score(labels, other)):
        assert all(abs(again[i] - first[i]) < 1e-4 for i in first)


def test_no_labels_and_no_rows(spark, marked):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(0 <= r["score"] <= 1 for r in attention.classify(spark.createDataFrame(marked[0][:5], DOCS), none).collect())
    assert attention.classify(spark.createDataFrame([], DOCS), none).collect() == []


# ---- alignment

def plain_alignment(texts):
    pair = align.Pair(*FILES)
    rows, count = [], collections.Counter()
    for t in texts:
        t = t or ""
        a, b = pair.a.encode(" " + t, add_special_tokens=False).ids, pair.b.encode(t)
        ta, tb = [pair.bytes_a[i] for i in a], [pair.bytes_b[i] for i in b]
        data = (" " + t).encode()
        if not t or b"".join(ta) != data or b"".join(tb) != data:
            rows.append(None)
            continue
        lay = lambda ts: [(sum(map(len, ts[:i])), sum(map(len, ts[:i + 1]))) for i in range(len(ts))] if len(ts) < 400 else spans(ts)
        sa, sb = lay(ta), lay(tb)
        met, j = [], 0
        for i, (lo, hi) in enumerate(sa):
            while sb[j][1] <= lo:
                j += 1
            k = j
            while k < len(sb) and sb[k][0] < hi:
                met.append((a[i], b[k]))
                k += 1
        ends = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, lo = [], 0
        for e in ends:
            groups.append(",".join(str(x) for x, s in zip(a, sa) if lo < s[1] <= e) + "|" + ",".join(str(x) for x, s in zip(b, sb) if lo < s[1] <= e))
            lo = e
        rows.append((len(a), len(b), met, groups))
        count.update(met)
    best = collections.defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    out = []
    for r in rows:
        if r is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, met, groups = r
        out.append((n_a, n_b, len(groups), len(met), sum(count[p] == best[p[1]] for p in met), sum(count[p] for p in met),
                    hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


def spans(tokens):
    out, at = [], 0
    for t in tokens:
        out.append((at, at + len(t)))
        at += len(t)
    return out


def awkward_texts():
    r = random.Random(4)
    words = "the of stone Überraschung naïve lantern 42, don't x. 日本語 🙂 a—b <0x41> <s> <|endoftext|> https://a.b/c".split()
    prose = lambda n: " ".join(r.choice(words) + r.choice(["", "ing", "\n", "  "]) for _ in range(n))
    return [None, "", " ", "a", "\n\n", "▁", "one ▁ two " * 40, "x" * 700, "日本語テキスト" * 60, prose(30), prose(30), *[prose(n) for n in (5, 80, 150, 300)], "é" * 300,
            "tab\tand\r\nlines " * 30, "  lead", "trail  ", "\0 zero", "word " * 100]


@pytest.mark.parametrize("long, span, block", [(1 << 16, 1 << 14, 1 << 22), (120, 48, 300), (200, 7, 64)])
def test_alignment_equals_plain(spark, monkeypatch, long, span, block):
    monkeypatch.setattr(align, "FAN", 3)
    texts = awkward_texts()
    rows = [(i, t, "en", "u", 7, 8, "s") for i, t in enumerate(texts)] + [(3, "a", None, None, None, None, None), (None, texts[12], None, None, None, None, None)]
    want = collections.Counter((r[0], *x) for r, x in zip(rows, plain_alignment([r[1] for r in rows])))
    out = align.align(spark.createDataFrame(rows, DOCS).repartition(3), *FILES, long=long, span=span, block_tokens=block)
    assert out.columns == ["doc_id", *align.COUNTS, "groups_sha256"]
    assert collections.Counter(map(tuple, out.collect())) == want


def test_no_rows_to_align(spark):
    assert align.align(spark.createDataFrame([], DOCS), *FILES).collect() == []
    assert align.align(spark.createDataFrame([(1, None, "", "", 1, 1, "")], DOCS), *FILES).collect()[0][1:] == (0, 0, 0, 0, 0, 0, "")


def test_fragments_compose_in_any_order():
    pair = align.Pair(*FILES)
    size_a, size_b = pair.size_a, pair.size_b
    text = "日本語 naïve don't 🙂🙂 Überraschung " * 9
    a, b = pair.encode([text])[0]
    rows, closed = [], []
    for j, (has, p, c, s) in enumerate(align.fragments(a, b, size_a, size_b, 5)):
        rows.append({"uid": 1, "doc_id": 1, "k": 0, "j": j, "pk": 0, "pj": j, "ok": True, "has": has,
                     **dict(zip(("pa", "pb", "sa", "sb"), (x.tobytes() for x in (*p, *s))))})
        closed.append({"k": 0, "j": j, "part": 1, "a": c[0].tobytes(), "b": c[1].tobytes()})
    flat, seams = align.compose(rows)
    assert flat["sa"] == flat["sb"] == flat["pa"] == b"" and seams
    for parts in ([rows[:1], rows[1:]], [rows[:-1], rows[-1:]], [rows[i:i + 4] for i in range(0, len(rows), 4)]):
        nodes, found = [], []
        for p in parts:
            node, more = align.compose(p)
            nodes.append(node)
            found += more
        top, more = align.compose(nodes)
        key = lambda x: (x["j"], x["a"], x["b"])
        assert sorted(map(key, found + more)) == sorted(map(key, seams)) and top == flat
    whole = sorted([*closed, *seams], key=lambda x: (x["j"], x["part"]))
    assert b"".join(x["a"] for x in whole) == a.tobytes() and b"".join(x["b"] for x in whole) == b.tobytes()


def test_cut_texts_have_the_whole_texts_tokens():
    pair = align.Pair(*FILES)
    assert pair.cuts
    for t in awkward_texts():
        whole = pair.encode([t or ""])[0]
        for p in (pair, align.Pair(*FILES, align.PATTERN)):
            for parts in (list(p.pieces(t or "", 20)), p.words(t or "")):
                cut = p.encode(parts)
                assert (whole is None) == any(c is None for c in cut)
                if whole is not None:
                    assert all(np.array_equal(whole[i], np.concatenate([c[i] for c in cut])) for i in (0, 1))


def test_merging_by_rank_is_merging_by_list():
    assert align.Pair(*FILES).same_by_ranks()
