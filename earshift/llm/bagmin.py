"""Near-duplicate detection by BagMinHash over word shingles.

Every shingle with weight w spawns Poisson processes on the cells [0,1), [1,2),
[2,4), [4,8), ... of the weight axis that reach below w, seeded by shingle and
cell alone.  A point has a time, a position among the signature's and a height
within its cell; points at a height of w or more are thinned out.  The signature
holds at each position the first point of all processes, so two texts agree at
a position with the probability of their weighted Jaccard similarity.  Only
points before a text's own time limit are made, about as many as there are
positions, besides one per shingle.

Bands of the signature give candidates, and the exact overlap of the multisets
decides.  A bucket first links its members to one of them.  Where that leaves
parts, the pairs of a small bucket that the triangle inequality leaves open are
compared one by one.  Members of large buckets are laid into blocks instead:
a task takes two blocks, adds up all overlaps between them as a product of
matrices, and returns a spanning forest of what it finds, so that pairs within a
group never become rows.
"""

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import materialise, work_dir
from . import shingles as S
from .shingles import U, mix
from .text import whole

cloudpickle.register_pickle_by_value(sys.modules[__name__])

POSITIONS, BANDS = 128, 32  # four positions a band: a pair at 0.8 is missed once in 20 million
GOLD = 0x9E3779B97F4A7C15
POINTS = 1 << 19  # points made at once
FEW = 32  # members of a bucket whose pairs are compared one by one
BLOCK_ROWS, BLOCK_BYTES = 1024, 16 << 20
COMMON, COLUMNS = 64, 2048  # texts of a shingle that make it a matrix column; columns at once
SPACES = b" \t\n\x0b\x0c\r"


def processes(text: np.ndarray, shingle: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, seed, low end, length, weight) of each cell that a weight reaches into."""
    out, b = [], 0
    while True:
        low = 0 if b == 0 else 1 << (b - 1)
        on = count > low
        if not on.any():
            break
        seed = mix(shingle[on] + U((b * GOLD) & (2**64 - 1)))
        out.append((text[on], seed, np.full(on.sum(), low), np.full(on.sum(), max(1, low)), count[on]))
        b += 1
    return tuple(np.concatenate(x) for x in zip(*out))


def signatures(text: np.ndarray, shingle: np.ndarray, count: np.ndarray, n: int, positions: int = POSITIONS,
               slack: float = 3.0) -> np.ndarray:
    """n x positions: the names of the first points; texts without shingles have zeros."""
    sig = np.zeros(n * positions, np.uint64)
    if not len(text):
        return sig.reshape(n, positions)
    best = np.full(n * positions, np.inf)
    total = np.bincount(text, count, n)
    limit = (np.log(positions) + slack) / np.maximum(total, 1)
    doc, seed, low, length, weight = processes(text, shingle, count)
    clock = np.zeros(len(doc))
    made, step = 0, 1
    while len(doc):
        going = []
        rows = max(1, POINTS // step)
        for a in range(0, len(doc), rows):
            d, s, lo, ln, w = (x[a:a + rows] for x in (doc, seed, low, length, weight))
            r = mix(s[:, None] + np.arange(made + 1, made + step + 1, dtype=np.uint64)[None, :] * U(GOLD))
            gap = -np.log(((r >> U(11)) + U(1)).astype(np.float64) * 2.0**-53) / (positions * ln)[:, None]
            time = clock[a:a + rows, None] + np.cumsum(gap, axis=1)
            clock[a:a + rows] = time[:, -1]
            going.append(time[:, -1] < limit[d])
            on = time < limit[d][:, None]
            tall = lo > 0
            if tall.any():
                height = lo[tall, None] + (mix(r[tall] ^ U(GOLD)) % ln[tall].astype(np.uint64)[:, None]).astype(np.int64)
                on[tall] &= height < w[tall, None]
            i, j = np.nonzero(on)
            if not len(i):
                continue
            t, name = time[i, j], r[i, j]
            spot = d[i] * positions + (name & U(positions - 1)).astype(np.int64)
            o = np.lexsort((t, spot))
            spot, t, name = spot[o], t[o], name[o]
            head = np.r_[True, spot[1:] != spot[:-1]]
            spot, t, name = spot[head], t[head], name[head]
            better = t < best[spot]
            best[spot[better]] = t[better]
            sig[spot[better]] = name[better]
        going = np.concatenate(going)
        doc, seed, low, length, weight, clock = (x[going] for x in (doc, seed, low, length, weight, clock))
        made, step = made + step, min(step * 4, 256)
    sig, best = sig.reshape(n, positions), best.reshape(n, positions)
    late = np.isinf(best).any(axis=1) & (total > 0)
    if late.any():  # a position without a point: a later limit for these texts
        number = np.cumsum(late) - 1
        on = late[text]
        sig[late] = signatures(number[text[on]], shingle[on], count[on], int(late.sum()), positions, slack * 4)
    return sig


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    n, m = sig.shape
    x = sig.reshape(n, bands, m // bands)
    out = np.zeros((n, bands), np.uint64)
    for k in range(m // bands):
        out = mix(out + x[:, :, k] * U(S.ORDER[k % 5]) + U(k))
    return mix(out + np.arange(1, bands + 1, dtype=np.uint64)[None, :] * U(GOLD)).view(np.int64)


def digest(text: bytes) -> bytes:
    """Of the text's words with A-Z as a-z: equal for texts that are copies."""
    return hashlib.sha256(b" ".join(text.lower().split())).digest()[:16]


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, uid, ...) to (uid, digest, bands or null)."""
    words = S.Words()
    for batch in batches:
        data, at = S.raw(batch.column(0))
        for lo, hi in S.chunks(at):
            bag = S.text_bags(words, data, at, lo, hi)
            keys = band_keys(signatures(*bag, hi - lo))
            some = np.bincount(bag[0], minlength=hi - lo) > 0
            lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum(np.where(some, BANDS, 0))].astype(np.int32), pa.array(keys[some].ravel()))
            view = memoryview(data)
            marks = [digest(view[at[i]:at[i + 1]].tobytes()) for i in range(lo, hi)]
            yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[1:], pa.array(marks, pa.binary()), lists],
                                             names=["id", "th", "digest", "bands"])


def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, text of a, text of b) to (a, b, shared, total) counts of the multisets."""
    words = S.Words()
    for batch in batches:
        da, aa = S.raw(batch.column(2))
        db, ab = S.raw(batch.column(3))
        for lo, hi in S.chunks(aa + ab):
            n = hi - lo
            x, y = S.text_bags(words, da, aa, lo, hi), S.text_bags(words, db, ab, lo, hi)
            t, s, c = (np.concatenate(z) for z in zip(x, y))
            o = np.lexsort((s, t))
            t, s, c = t[o], s[o], c[o]
            same = np.flatnonzero((t[1:] == t[:-1]) & (s[1:] == s[:-1])) if len(t) else np.zeros(0, np.int64)
            shared = np.bincount(t[same], np.minimum(c[same], c[same + 1]), n).astype(np.int64) if len(same) else np.zeros(n, np.int64)
            total = np.bincount(t, c, n).astype(np.int64) - shared if len(t) else np.zeros(n, np.int64)
            part = batch.slice(lo, n)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(shared), pa.array(total)],
                                             names=["a", "b", "shared", "total"])


def components(links: DataFrame, base: str, name: str) -> DataFrame:
    """(node, root) of every linked node but the roots, by alternating stars.

    ``links`` (a, b) with a > b.  Every node is hung on its smallest neighbour
    until nothing moves; the rounds grow with the logarithm of the longest chain.
    """
    edges, before, k = materialise(links.select("a", "b").distinct(), f"{name}_edges", base), None, 0
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b"))).first()
        if mark == before or not mark[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = mark
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")).withColumnRenamed("a", "_a")
        large = both.join(least, F.col("a") == F.col("_a")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialise(large, f"{name}_large{k}", base)
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "_a")
        hung = large.join(least, F.col("a") == F.col("_a"))
        small = hung.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(hung.select("a", F.col("m").alias("b")))
        edges = materialise(small.distinct(), f"{name}_small{k}", base)
        k += 1


def classes(df: DataFrame, text: str = "text", doc_id: str = "doc_id", least: float = 0.8, few: int = FEW,
            block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows id, th (hash of the text), uid, class (its largest id), size, kept; one per row.

    Texts with the same words in the same order are copies, texts without words
    among them (null counts as empty); a text of one to four words has one
    shingle.  A class holds what copies and similarities of ``least`` or more
    connect.  The row with the largest id stays; null ids come last, and of rows
    that repeat an id one stays.  An empty table gives an empty one; further
    columns are ignored and may have any name.
    """
    spark, base = df.sparkSession, work_dir(df.sparkSession)
    kind = df.schema[doc_id].dataType
    docs = df.select(whole(F.col(f"`{text}`")).alias("text"), F.col(f"`{doc_id}`").alias("id")).withColumn("th", F.xxhash64("text"))
    schema = T.StructType([T.StructField("id", kind), T.StructField("th", T.LongType()), T.StructField("digest", T.BinaryType()),
                           T.StructField("bands", T.ArrayType(T.LongType()))])
    signed = materialise(docs.mapInArrow(sign, schema).withColumn("uid", F.monotonically_increasing_id()), "signed", base)
    # one node for all copies of a text
    nodes = signed.groupBy("digest").agg(F.max(F.struct("id", "th")).alias("top"), F.max("bands").alias("bands"))
    nodes = materialise(nodes.select(F.monotonically_increasing_id().alias("nid"), "digest", "top.*", "bands"), "nodes", base)
    members = nodes.select("nid", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("nid").alias("lo"), F.max("nid").alias("hi"))
    buckets = materialise(buckets.where("n > 1"), "buckets", base)
    large = buckets.where("n > 2").select(F.col("key").alias("_k"), "lo", "n")
    large = materialise(members.join(large, F.col("key") == F.col("_k")).select("key", "nid", "lo", "n"), "large", base)
    pairs = buckets.where("n = 2").select(F.col("hi").alias("a"), F.col("lo").alias("b")).unionByName(
        large.where("nid <> lo").select(F.col("nid").alias("a"), F.col("lo").alias("b"))).distinct()
    pairs = materialise(pairs, "pairs", base)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("nid")).distinct()
    wanted = wanted.join(nodes.select("nid", F.col("id").alias("_i"), F.col("th").alias("_t")), "nid")
    texts = docs.join(wanted, docs["id"].eqNullSafe(F.col("_i")) & (F.col("th") == F.col("_t"))).select("nid", "text")
    texts = materialise(texts, "texts", base)

    def compare(todo: DataFrame, name: str) -> DataFrame:
        a = texts.select(F.col("nid").alias("_a"), F.col("text").alias("ta"))
        b = texts.select(F.col("nid").alias("_b"), F.col("text").alias("tb"))
        full = todo.join(a, F.col("a") == F.col("_a")).join(b, F.col("b") == F.col("_b")).select("a", "b", "ta", "tb")
        seen = full.mapInArrow(overlap, "a long, b long, shared long, total long")
        # rows that repeat an id and a text give a pair twice
        return materialise(seen.groupBy("a", "b").agg((F.max("shared") / F.max("total")).alias("sim")), name, base)

    known = compare(pairs, "sims")
    links = known.where(F.col("sim") >= least).select("a", "b")
    roots = components(links, base, "first")
    if not large.isEmpty():
        more = small_pairs(large.where(F.col("n") <= few), known, roots, compare, base, least).unionByName(
            large_groups(large.where(F.col("n") > few), roots, texts, base, least, block_rows))
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more), base, "all")
    root = roots.withColumnRenamed("node", "nid")
    placed = nodes.select("nid", "digest").join(root, "nid", "left").select("digest", F.coalesce("root", "nid").alias("root"))
    rows = materialise(signed.select("id", "th", "uid", "digest").join(placed, "digest").drop("digest"), "rows", base)
    tops = rows.groupBy("root").agg(F.max(F.struct("id", "uid")).alias("top"), F.count(F.lit(1)).alias("size")).withColumnRenamed("root", "_r")
    return rows.join(tops, F.col("root") == F.col("_r")).select(
        "id", "th", "uid", F.col("top.id").alias("class"), "size", (F.col("uid") == F.col("top.uid")).alias("kept"))


def parted(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Adds each member's component so far."""
    r = roots.withColumnRenamed("node", "_n")
    return members.join(r, F.col("nid") == F.col("_n"), "left").withColumn("part", F.coalesce("root", "nid")).drop("_n", "root")


def small_pairs(members: DataFrame, known: DataFrame, roots: DataFrame, compare, base: str, least: float) -> DataFrame:
    """Links in small buckets: pairs in two components whose distances to the
    bucket's representative, exact by now, don't rule them out."""
    far = known.select(F.col("a").alias("_a"), F.col("b").alias("_b"), (1 - F.col("sim")).alias("away"))
    m = members.join(far, (F.col("nid") == F.col("_a")) & (F.col("lo") == F.col("_b")), "left")
    m = materialise(parted(m.select("key", "nid", F.coalesce("away", F.lit(0.0)).alias("away")), roots), "small", base)
    o = m.select(*[F.col(c).alias(f"_{c}") for c in m.columns])
    met = m.join(o, F.col("key") == F.col("_key")).where((F.col("nid") > F.col("_nid")) & (F.col("part") != F.col("_part")) & (
        F.abs(F.col("away") - F.col("_away")) <= 1 - least + 1e-9))
    todo = met.select(F.col("nid").alias("a"), F.col("_nid").alias("b")).distinct().join(known.select("a", "b"), ["a", "b"], "left_anti")
    return compare(materialise(todo, "todo", base), "small_sims").where(F.col("sim") >= least).select("a", "b")


def large_groups(members: DataFrame, roots: DataFrame, texts: DataFrame, base: str, least: float, block_rows: int) -> DataFrame:
    """Links among members of large buckets.  Buckets that share members make a
    group; a group in one component is left alone."""
    groups = components(members.where("nid <> lo").select(F.col("nid").alias("a"), F.col("lo").alias("b")), base, "groups")
    g = groups.withColumnRenamed("node", "_m")
    own = members.select("nid").distinct().join(g, F.col("nid") == F.col("_m"), "left").select("nid", F.coalesce("root", "nid").alias("group"))
    own = materialise(parted(own, roots), "grouped", base)
    held = texts.groupBy("nid").agg(F.first("text").alias("text"))  # rows that repeat an id and a text
    held = materialise(held.join(own.select("nid", "group"), "nid"), "held", base)
    size = own.groupBy("group").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count(F.lit(1)).alias("n")).where("p < q")
    bytes_ = held.groupBy("group").agg(F.sum(F.octet_length("text")).alias("bytes"))
    size = size.join(bytes_, "group").select(F.col("group").alias("_g"), F.ceil(F.greatest(
        F.col("n") / block_rows, F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    rows = held.join(size, F.col("group") == F.col("_g")).withColumn("mine", F.pmod(F.xxhash64("nid"), F.col("blocks")).cast("int"))
    rows = rows.select("group", "nid", "mine", "text", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("group", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "nid", "mine", "text")

    def run(table: pa.Table) -> pa.Table:
        return block_links(table, least)

    return materialise(by_blocks(rows, run), "block_links", base)


def by_blocks(rows: DataFrame, run) -> DataFrame:
    """``run`` on each pair of blocks, dealt by the pair: left to itself Spark takes the
    join's partitioning by group as good enough, and one task gets all of a group."""
    return rows.repartition("group", "i", "j").groupBy("group", "i", "j").applyInArrow(run, "a long, b long")


def block_links(table: pa.Table, least: float) -> pa.Table:
    """Links between two blocks of texts (or within one) as a spanning forest."""
    table = table.combine_chunks()
    nid, mine, i, j = (table.column(c).to_numpy() for c in ("nid", "mine", "i", "j"))
    words, texts, keys, base_row = S.Words(), [], [], 0
    for chunk in table.column("text").chunks:
        data, at = S.raw(chunk)
        for lo, hi in S.chunks(at):
            t, s, c = S.text_bags(words, data, at, lo, hi)
            row = np.repeat(t + lo + base_row, c)
            copy = np.arange(len(row)) - np.repeat(np.cumsum(c) - c, c)  # the k-th copy is a sign of its own
            texts.append(row)
            keys.append(mix(np.repeat(s, c) + copy.astype(np.uint64) * U(GOLD)))
        base_row += len(chunk)
    row, key = np.concatenate(texts), np.concatenate(keys)
    total = np.bincount(row, minlength=len(nid))
    left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
    place = np.full((2, len(nid)), -1)
    place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
    o = np.argsort(key, kind="stable")
    row, key = row[o], key[o]
    head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    often = np.diff(np.r_[head, len(key)])
    shared = np.zeros((len(left), len(right)), np.float32)
    wide = head[often >= COMMON]
    for a in range(0, len(wide), COLUMNS):
        z = wide[a:a + COLUMNS]
        n = often[np.searchsorted(head, z)]
        column = np.repeat(np.arange(len(z)), n)
        who = row[np.repeat(z - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        sides = []
        for side, size in ((0, len(left)), (1, len(right))):
            at = place[side, who]
            m = np.zeros((size, len(z)), np.float32)
            m[at[at >= 0], column[at >= 0]] = 1
            sides.append(m)
        shared += sides[0] @ sides[1].T
    for k in range(2, COMMON):
        z = head[often == k]
        step = max(1, (1 << 20) // (k * k))
        for a in range(0, len(z), step):
            who = row[z[a:a + step, None] + np.arange(k)[None, :]]
            x, y = place[0, who][:, :, None], place[1, who][:, None, :]
            ok = (x >= 0) & (y >= 0)
            shared += np.bincount((x * len(right) + y)[ok], minlength=shared.size).reshape(shared.shape)
    either = total[left][:, None] + total[right][None, :] - shared.astype(np.float64)
    x, y = np.nonzero(shared / np.maximum(either, 1) >= least)
    x, y = left[x], right[y]
    x, y = x[x != y], y[x != y]
    label = np.argsort(np.argsort(nid))
    while True:
        before = label.copy()
        np.minimum.at(label, x, label[y])
        np.minimum.at(label, y, label[x])
        if (label == before).all():
            break
    root = np.sort(nid)[label]
    hung = root != nid
    return pa.table({"a": nid[hung], "b": root[hung]})


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", least: float = 0.8) -> DataFrame:
    """doc_id, class_id, class_size, kept for each row; see ``classes``."""
    return classes(df, text, doc_id, least).select(
        F.col("id").alias("doc_id"), F.col("class").alias("class_id"), F.col("size").alias("class_size"), "kept")


def keep_one(df: DataFrame, text: str = "text", doc_id: str = "doc_id", least: float = 0.8) -> DataFrame:
    """The row that stays of each class, with its own columns."""
    found = materialise(classes(df, text, doc_id, least), "classes", work_dir(df.sparkSession))
    got = found.where("kept").select(F.col("id").alias("_i"), F.col("th").alias("_t"))
    rows = df.select(F.struct("*").alias("row"), F.col(f"`{doc_id}`").alias("id"), F.xxhash64(whole(F.col(f"`{text}`"))).alias("th"))
    out = rows.join(got, F.col("id").eqNullSafe(F.col("_i")) & (F.col("th") == F.col("_t")), "left_semi")
    if not found.groupBy("id", "th").count().where("count > 1").isEmpty():
        out = out.dropDuplicates(["id", "th"])  # rows that repeat an id and its text: one of them
    return out.select("row.*")
