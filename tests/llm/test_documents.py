"""Operators on documents against brute force, on rows made to be awkward."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from earshift.llm import bagmin, bpe, mixing, radix, rules, shards, suffix
from earshift.llm.queries import tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid string, row int, n int"
GAP = re.compile(r"[\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return [w for w in GAP.split(t or "") if w]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice("the of river Stone under ölwerk été and winter hollow a to quiet marble 42 lantern".split()) + str(r.randrange(60)) for _ in range(n))


def corpus():
    base, other = prose(1, 400), prose(2, 300)
    near = base.replace("river1", "rover1").replace("and2", "und2", 1)
    shared = prose(3, 60)
    texts = [None, "", " \t\n ", "one two", "One two", "a b c d e", base, base.upper(), near, base + " tail end", other, other,
             "x" * 5000, "y " * 4000, prose(4, 6000), shared + " " + prose(5, 50), prose(6, 40) + "\n" + shared, "line a b\nline a b\n\nline a b",
             "ÀÉ ß\u00a0x\u2003y", "#*$% |<> && word", prose(7, 12), "été\nété\r\nété", base[:200] + other[:200], "\x1c\x1d a"]
    rows = [(i, t, "en", f"s{i % 4}" if i % 5 else None, len(t or ""), "u", 1, 2) for i, t in enumerate(texts)]
    rows.append((3, "one two", "en", "s3", 7, None, None, None))  # a row twice
    rows.append((None, other, None, "s1", None, None, None, None))
    rows.append((None, None, None, None, None, None, None, None))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_measures(t):
    t = t or ""
    w = words(t)
    lines = [x for x in t.split("\n") if words(x)]
    wins = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    often = collections.Counter(wins)
    hit = {i + k for i, x in enumerate(wins) if often[x] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_rules(docs, none):
    got = rules.judge(docs, keep=("doc_id", "text"))
    for r in got.collect():
        n, chars, signs, dup, again = plain_measures(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, signs, dup, again), r.text
        assert r.base_failed == (n < 10 or 100 * again > 20 * n)
        assert not (r.base_failed and r.kept)
    assert got.count() == docs.count() and rules.judge(none).count() == 0
    kept = rules.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == got.where("kept").count() > 0
    # a filter on the result must not repeat the work below it
    assert got.where("kept and n_words > 10").count() > 0


def test_rules_on_labels(spark):
    path = "/root/testdata/sf0.01"
    j = rules.judge(spark.read.parquet(f"{path}/documents.parquet")).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id")
    j = j.where("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in j}
    good, bad = n.get((1, True), 0), n.get((0, False), 0)
    assert good >= 0.99 * (good + n.get((1, False), 0)) and bad >= 0.8 * (bad + n.get((0, True), 0))


def test_bpe(docs, none):
    rank_file, pattern = tokenizer()
    codec = bpe.Codec(rank_file, pattern)
    got = bpe.encode(docs, rank_file, pattern, keep=("doc_id", "text", "n"))
    for r in got.collect():
        ids = np.array(codec.encoding.encode_ordinary(r.text or ""), "<u4")
        assert r.ids == ids.tobytes() and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    back = bpe.decode(got, rank_file, pattern).collect()
    assert all(bytes(r.bytes) == (r.text or "").encode() for r in back)
    assert bpe.encode(none, rank_file, pattern).count() == 0


def test_bpe_cuts_at_safe_places():
    codec = bpe.Codec(*tokenizer())
    for text in (prose(9, 3000), "a1  b\n\n c'll  'tis\t\t x" * 200, "ab" * 4000 + " c d " * 900, "  \n " * 3000, "été ß " * 2000):
        whole = np.array(codec.encoding.encode_ordinary(text), "<u4")
        for limit in (64, 1000):
            assert (codec.encode(text, limit) == whole).all()
    long = "ß" * 200_000 + " " * 200_000 + "x"
    assert codec.decode(codec.encode(long)) == long.encode()


def test_radix(docs, none):
    got = radix.partition(docs, first=2, growth=3).collect()
    groups = collections.defaultdict(list)
    for r in corpus():
        groups[(r[1] or "").translate(LOWER)].append(r[0])
    want = collections.Counter()
    for t, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        kept = False
        for i in sorted(ids, key=lambda i: -1 if i is None else i, reverse=True):
            stays = not kept and i == top
            kept |= stays
            want[(i, top, len(ids), stays, hashlib.sha256(t.encode()).hexdigest())] += 1
    assert collections.Counter(map(tuple, got)) == want
    assert radix.partition(none).count() == 0
    kept = radix.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def bag(t):
    w = words((t or "").translate(LOWER))
    return collections.Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def classes_of(rows, least=0.8):
    bags = [bag(r[1]) for r in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for k in range(i):
            both, either = sum((bags[i] & bags[k]).values()), sum((bags[i] | bags[k]).values())
            if (not bags[i] and not bags[k]) or (either and both / either >= least):
                up[top(i)] = top(k)
    out = collections.defaultdict(list)
    for i in range(len(rows)):
        out[top(i)].append(rows[i][0])
    return out


def check_classes(rows, got):
    want = collections.Counter()
    for ids in classes_of(rows).values():
        for i in ids:
            want[(i, max((x for x in ids if x is not None), default=None), len(ids))] += 1
    assert collections.Counter((r.doc_id, r.class_id, r.class_size) for r in got) == want
    assert sum(r.kept for r in got) == len(classes_of(rows))


def test_bagmin(docs, none):
    check_classes(corpus(), bagmin.near_duplicates(docs).collect())
    assert bagmin.near_duplicates(none).count() == 0
    kept = bagmin.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(classes_of(corpus()))


def test_bagmin_chain(spark):
    """A chain of small changes: its ends are far apart and no one text is near
    to all, so that representatives alone would leave it in parts."""
    w = prose(11, 200).split()
    rows = []
    for k in range(30):
        v = list(w)
        for j in range(k):
            v[(j * 7) % 200] = f"new{j}"
        rows.append((100 + (k * 13) % 30, " ".join(v)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for few, block in ((32, 1024), (2, 1024), (2, 7)):
        got = bagmin.classes(df, few=few, block_rows=block).select("id", "class", "size", "kept")
        check_classes(rows, got.toDF("doc_id", "class_id", "class_size", "kept").collect())


def test_blocks():
    """Overlaps of blocks, common and rare shingles alike, against counters."""
    r = random.Random(4)
    base = prose(21, 80).split()
    texts = []
    for k in range(150):
        w = list(base)
        for _ in range(r.randrange(6)):
            w[r.randrange(80)] = f"n{r.randrange(40)}"
        texts.append(" ".join(w) if k % 10 else prose(900 + k // 20, 30) + " a b c d e f a b c d e f")
    bags = [bag(t) for t in texts]
    import pyarrow as pa

    n, half = len(texts), 70
    ids = [1000 - 3 * k for k in range(n)]
    t = pa.table({"nid": ids, "mine": [int(k >= half) for k in range(n)], "i": [0] * n, "j": [1] * n, "text": texts})
    got = bagmin.block_links(t, 0.8).to_pylist()
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(half):
        for b in range(half, n):
            if sum((bags[a] & bags[b]).values()) >= 0.8 * sum((bags[a] | bags[b]).values()):
                x, y = sorted((top(ids[a]), top(ids[b])))
                up[y] = x
    assert {x["a"]: x["b"] for x in got} == {i: top(i) for i in ids if top(i) != i}


def test_bagmin_estimate():
    """Signatures agree as often as the weighted Jaccard similarity says."""
    r = np.random.default_rng(5)
    e = r.integers(0, 2**63, 400).astype(np.uint64)
    a, b = r.integers(1, 9, 400), r.integers(1, 9, 400)
    hits = []
    for k in range(30):
        x = np.sort(e ^ np.uint64(k * 7919))
        sig = bagmin.signatures(np.repeat([0, 1], 400), np.r_[x, x], np.r_[a, b], 2)
        hits.append((sig[0] == sig[1]).mean())
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs(np.mean(hits) - want) < 4 * (want * (1 - want) / (128 * 30)) ** 0.5


def plain_strip(rows):
    first, out = {}, []
    key = lambda i: (1 << 63) - 1 if i is None else i
    for i, t in sorted(((r[0], r[1]) for r in rows), key=lambda r: key(r[0])):
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k:k + 50], key(i))
    for r in rows:
        b = (r[1] or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k:k + 50]] < key(r[0]):
                gone[k:k + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((r[0], len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def test_suffix(docs, none):
    got = suffix.remove_repeats(docs, with_bytes=True)
    assert collections.Counter((*r[:5], bytes(r[5])) for r in got.collect()) == collections.Counter(plain_strip(corpus()))
    assert suffix.remove_repeats(none).count() == 0


def test_suffix_random(spark):
    r = random.Random(8)
    pool = [prose(50 + k, 30) for k in range(12)] + ["z" * 90, "ab" * 60]
    rows = [(i, "".join(p[r.randrange(40):len(p) - r.randrange(40)] for p in r.choices(pool, k=r.randrange(1, 6)))) for i in range(60)]
    rows += [(100, rows[3][1]), (101, rows[3][1]), (-5, rows[7][1][20:120])]
    got = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(x[:5] for x in plain_strip(rows))


MANY = {"anchors_per_file": 200, "rows_per_file": 40, "texts_per_shelf": 5, "chunk": 700}


def hot_corpus():
    """Phrases below and above 50 bytes in many texts, most with their own text around."""
    r = random.Random(18)
    own = lambda n: "".join(r.choice("abcdefghij klmnop") for _ in range(n))
    phrases = ["(c) the usual licence line", "= call now to subscribe to our free letter.. =", "+ a passage of sixty bytes that really is the same in all of it +"]
    rows = [(i, own(60) + phrases[i % 3] + own(r.choice([0, 5, 60])) + phrases[(i * 7) % 3] + own(45)) for i in range(120)]
    rows += [(200 + k, rows[k][1][10:150] + own(20)) for k in range(0, 40, 3)] + [(300, "=" * 150 + own(30)), (301, own(9) + "=" * 120)]
    return rows


@pytest.mark.parametrize("sizes", [{**MANY, "hot_rows": 10**9}, {**MANY, "hot_rows": 8}, {"hot_rows": 2}])
def test_suffix_in_parts(spark, docs, sizes):
    """Several files, shelves and blocks, with and without hot anchors."""
    got = suffix.remove_repeats(docs, with_bytes=True, **sizes)
    assert collections.Counter((*r[:5], bytes(r[5])) for r in got.collect()) == collections.Counter(plain_strip(corpus()))
    rows = hot_corpus()
    got = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **sizes).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(x[:5] for x in plain_strip(rows))


def test_hot_anchor_spreads():
    """A phrase in every text, with differing text around it, is not one file's."""
    import pyarrow as pa

    r = random.Random(3)
    phrase, n, files = b"please read the licence before copying this", 3000, 16
    texts = [bytes(r.randrange(97, 123) for _ in range(60)) + phrase + bytes(r.randrange(97, 123) for _ in range(60)) for _ in range(n)]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]
    h = suffix.short(suffix.anchors(data, at)[2])
    values, counts = np.unique(h, return_counts=True)
    shared = values[counts > n // 10]
    assert len(shared)
    hashes = [suffix.packed(shared).tobytes()] * n
    batch = pa.RecordBatch.from_arrays([pa.array([t.decode() for t in texts]), pa.array(range(n), pa.int64()), pa.array(range(n), pa.int64()), pa.array(hashes, pa.binary())],
                                       names=["text", "id", "th", "hashes"])
    counted = collections.Counter()
    for x in suffix.count_anchors()(iter([batch])):
        counted.update(dict(zip(x["h"].to_pylist(), x["n"].to_pylist())))
    hot = [k for k, c in counted.items() if c >= n // 10]
    assert set(hot) == {int(x) for x in shared}
    load = collections.Counter()
    for x in suffix.lay_out(files, hot)(iter([batch])):
        for row in x.to_pylist():
            load[row["file"]] += len(row["id"])
    assert max(load.values()) <= 1.5 * sum(load.values()) / files


def plain_jump(key, n):
    b, j = -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_shards(docs, none):
    got = shards.plan(docs, 5).collect()
    seen = collections.defaultdict(list)
    for r in got:
        key = (r.doc_id or 0) % 2**64
        assert (r.law, r.shard, r.grown_shard) == ("key", plain_jump(key, 5), plain_jump(key, 6))
        assert r.grown_shard in (r.shard, 5)
        seen[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in seen.values())
    want = collections.Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in corpus())
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert shards.plan(none, 40).count() == 0


def test_jump_is_even():
    keys = np.arange(200_000)
    n = np.bincount(shards.jump(keys, 40), minlength=40)
    assert abs(n - 5000).max() < 400
    assert (shards.jump(np.array([-1, 0]), 7) == [plain_jump(2**64 - 1, 7), plain_jump(0, 7)]).all()


def test_slots_are_places_in_the_files(docs, spark, tmp_path):
    """All columns come back, each row at the place its slot names."""
    import pyarrow.parquet as pq

    path = str(tmp_path / "out")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 2)
    try:
        shards.write(docs, 3, path)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    got = shards.read(spark, path)
    assert collections.Counter(tuple(r[c] for c in docs.columns) for r in got.collect()) == collections.Counter(map(tuple, docs.collect()))
    for n in range(3):
        files = sorted((tmp_path / "out" / f"shard={n}").glob("part-*.parquet"))
        want = [r["text"] for f in files for r in pq.ParquetFile(f).read().to_pylist()]
        assert [r.text for r in got.where(f"shard = {n}").orderBy("slot").collect()] == want and len(files) > 1


def test_shards_written(docs, spark, tmp_path):
    shards.write(docs.drop("row"), 4, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()


def test_mix(docs, none):
    got = mixing.mix_documents(docs).collect()
    again = mixing.mix_documents(docs.repartition(5)).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, again))
    sizes = collections.Counter()
    for r in corpus():
        sizes[r[3]] += len(words(r[1]))
    order = sorted((s for s in sizes if s is not None)) + [None]
    target = {s: 0.0 for s in order}
    open_, left = dict(zip(order, (3, 1, 2, 3, 1, 2))), 1.5 * sum(sizes.values())
    while open_ and left > 1e-9:  # shared by weight, round after round
        total, spill = sum(open_.values()), 0.0
        for s, w in list(open_.items()):
            target[s] += left * w / total
            if target[s] >= 2 * sizes[s]:
                spill += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                del open_[s]
        left = spill
    taken = collections.Counter()
    src = {(r[0], len(words(r[1]))): r[3] for r in corpus()}
    for r in got:
        s = src[(r.doc_id, r.size)]
        assert abs(r.target - target[s]) < 1e-6 and r.source_size == sizes[s] and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    assert mixing.mix_documents(none).count() == 0


def test_mixed_table(docs, none):
    got = mixing.mixed_table(docs, block=16)
    assert got.columns == docs.columns
    n = sum(len(words(r.text)) for r in got.collect())
    assert n == sum(r.taken for r in mixing.mix_documents(docs).collect())
    assert mixing.mixed_table(none).count() == 0


def plain_mix(rows, block):
    """(doc_id, text) of the mix in order, by lists of words and a loop over slots."""
    sized = [(r, words(r[1])) for r in rows]
    target = {}
    sizes = collections.Counter()
    for r, w in sized:
        sizes[r[3]] += len(w)
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    open_, left = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values())
    target = dict.fromkeys(order, 0.0)
    while open_ and left > 1e-9:
        total, spill = sum(open_.values()), 0.0
        for s, w in list(open_.items()):
            target[s] += left * w / total
            if target[s] >= 2 * sizes[s]:
                spill += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                del open_[s]
        left = spill
    goals = {s: int(target[s] + 0.5) for s in order}
    takes, blocks = {}, {s: -(-g // block) for s, g in goals.items()}
    for s in order:
        mine = sorted((x for x in sized if x[0][3] == s), key=lambda x: (
            hashlib.md5(f"mix:{'' if x[0][0] is None else x[0][0]}".encode()).hexdigest(), -1 if x[0][0] is None else x[0][0], len(x[1])))
        at = 0
        for r, w in mine * 2:
            n = min(len(w), goals[s] - at)
            if n > 0:
                cut = r[1] if n == len(w) else re.match(r"(?:[\x20\x09-\x0D]*[^\x20\x09-\x0D]+){%d}" % n, r[1])[0]
                takes.setdefault((s, at // block), []).append((r[0], cut))
            at += len(w)
    n, out, k, slot = sum(blocks.values()), [], collections.Counter(), 0
    edge = np.cumsum([0, *(blocks[s] for s in order)])
    while sum(k.values()) < n:
        u = slot * mixing.GOLDEN % 2**62
        for i, s in enumerate(order):
            if int(edge[i]) * 2**62 // n <= u < int(edge[i + 1]) * 2**62 // n and k[s] < blocks[s]:
                out += takes.get((s, k[s]), [])
                k[s] += 1
        slot += 1
    return out


@pytest.mark.parametrize("block", [3, 16, 256])
def test_mixed_table_in_order(docs, spark, tmp_path, monkeypatch, block):
    """Documents, cuts and their order, in memory and over the files by name, of a
    written table and of one that is not."""
    import pyarrow.parquet as pq

    rows = [r for r in corpus() if r[0] != 3]  # without equal ids
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = plain_mix(rows, block)
    df.write.parquet(str(tmp_path / "docs"))
    monkeypatch.setattr(mixing, "LEAST_WORDS", 500)
    for d in (df, spark.read.parquet(str(tmp_path / "docs"))):
        got = mixing.mixed_table(d, block=block)
        assert got.columns == df.columns and [(r.doc_id, r.text) for r in got.collect()] == want
    assert got.rdd.getNumPartitions() > 1
    got.write.parquet(str(tmp_path / "mix"))
    files = sorted((tmp_path / "mix").glob("part-*.parquet"))
    assert [(r["doc_id"], r["text"]) for f in files for r in pq.read_table(f).to_pylist()] == want


def test_every_block_has_a_slot(spark):
    """Sources from one word to many blocks; none is left to the end or out."""
    goals = [1.0, 3.0, 250_000.0, 17.0, 1.0, 90_000.0, 101.0, 0.0, 199.0]
    s = spark.createDataFrame([(str(k), 0, k, g) for k, g in enumerate(goals)], "source string, source_size long, rank int, target double")
    got = collections.defaultdict(list)
    for r in mixing.slots(s, 100).orderBy("slot").collect():
        got[r["rank"]].append((r.k, r.slot))
    assert {k: [x for x, _ in v] for k, v in got.items()} == {k: list(range(-(-int(g) // 100))) for k, g in enumerate(goals) if g}


@pytest.mark.parametrize("bits", [14, 20, 62])
def test_short_lines_serve_narrow_sources(spark, bits):
    """Blocks as dense on the line as a very large table's: each still has its slot."""
    goals = [1.0, 1500.0, 1.0, 2.0, 400.0, 1.0]
    s = spark.createDataFrame([(str(k), 0, k, g) for k, g in enumerate(goals)], "source string, source_size long, rank int, target double")
    got = collections.Counter((r["rank"], r.k) for r in mixing.slots(s, 1, bits).collect())
    assert got == collections.Counter((k, i) for k, g in enumerate(goals) for i in range(int(g)))
    with pytest.raises(ValueError):
        mixing.slots(s, 1, 12)


def test_points_are_exact(spark):
    ids = [0, 1, 2, 2**31 - 1, 2**31, 10**11 + 7, 2**40 + 3, 2**61 + 5]
    for bits in (14, 40, 62):
        step = mixing.GOLDEN >> (62 - bits)
        d = spark.createDataFrame([(i,) for i in ids], "id long").select("id", mixing.point(F.col("id"), bits).alias("u"))
        assert {r["id"]: r["u"] for r in d.collect()} == {i: i * step % 2**bits for i in ids}


def test_schedule_is_even(spark):
    """Any stretch of the schedule holds the sources in proportion."""
    s = spark.createDataFrame([("a", 0, 0, 60_000.0), ("b", 0, 1, 30_000.0), ("c", 0, 2, 10_000.0)], "source string, source_size long, rank int, target double")
    rows = mixing.slots(s, 100).orderBy("slot").collect()
    assert len(rows) >= 990
    for lo in range(0, 900, 100):
        n = collections.Counter(r["rank"] for r in rows[lo:lo + 100])
        assert abs(n[0] - 60) <= 4 and abs(n[1] - 30) <= 4 and abs(n[2] - 10) <= 4


def test_block_pairs_of_a_group_are_dealt_out(spark):
    """A group's block pairs go to tasks of their own, whatever the join before."""
    left = spark.range(64).selectExpr("id % 2 AS group", "id AS nid", "cast(id % 8 AS int) AS i", "cast(id % 8 AS int) AS j")
    rows = left.join(spark.range(2).selectExpr("id AS _g").hint("merge"), left["group"] == F.col("_g")).drop("_g")
    where = bagmin.by_blocks(rows, lambda t: t.select(["nid", "nid"]).rename_columns(["a", "b"]))
    plan = where._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("FlatMapGroupsInArrow"):]
    assert re.search(r"hashpartitioning\(group#\d+L?, i#\d+, j#\d+", below[:below.index("SortMergeJoin")])
