"""Removal of repeated byte strings by column-wise multi-document construction.

Every 50-byte window has an anchor, the 16 bytes of least hash within it, so
equal windows have equal anchors at equal distances.  Anchors that occur in one
text only are ruled out first.  The stretches around the others are laid under
one another with their anchors aligned, in files by anchor.  A file then takes
in one symbol per stretch each round, from the last column to the first: the
collection's order is updated by a stable pass over the new symbols (the order
of the positional Burrows-Wheeler transform), and the common prefixes of
neighbours by the least prefix between the places they came from.  Neighbours
with a common prefix of 50 are equal windows.

Whole copies are settled before, within a block of texts equal stretches leave
as one, and an anchor's known repeats do not travel at all, so a passage that
many texts share costs a file a few rows for each block.  Anchors with very many
stretches are laid out window by window, in files by the window's bytes.
"""

import hashlib
import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialise, work_dir
from . import shingles as S
from .shingles import U, mix
from .text import whole

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH, ANCHOR = 50, 16
SPAN = LENGTH - ANCHOR  # an anchor begins at most so far into its window
WIDTH = SPAN + LENGTH  # bytes that windows around an anchor can reach
CHUNK = 1 << 21
ANCHORS_PER_FILE = 3_000_000
ROWS_PER_FILE = 400_000
TEXTS_PER_SHELF = 4096
HOT_ROWS = ROWS_PER_FILE // 4  # an anchor's stretches that one file can take in besides others
SAMPLE_BYTES = 1 << 26
HOT_PIECE = 4096
LAST = (1 << 63) - 1
HASH_BYTES = 6


def anchors(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Texts between the offsets ``at`` to (text, anchor, hash, first, last) of each
    maximal run of windows, by start, with the same anchor."""
    n = len(data)
    if n < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(2)) + (np.zeros(0, np.uint64),) + tuple(np.zeros(0, np.int64) for _ in range(2))
    # hash of the 16 bytes from each place, as two words
    b = np.concatenate([data, np.zeros(ANCHOR, np.uint8)])
    word = np.zeros(n + 8, np.uint64)
    for k in range(8):
        word |= b[k:k + n + 8].astype(np.uint64) << U(8 * k)
    h = mix(word[:n] * U(S.ORDER[0]) ^ mix(word[8:8 + n]))
    del word, b
    # leftmost least hash among the SPAN + 1 places of each window, by doubling
    low, pos, reach = h, np.arange(n, dtype=np.int32), 1
    while reach < SPAN + 1:
        step = min(reach, SPAN + 1 - reach)
        right = low[step:] < low[:-step]
        new_low, new_pos = low.copy(), pos.copy()
        np.copyto(new_low[:-step], low[step:], where=right)
        np.copyto(new_pos[:-step], pos[step:], where=right)
        low, pos, reach = new_low, new_pos, reach + step
    size = np.diff(at)
    text = np.repeat(np.arange(len(size)), size)
    start = np.flatnonzero(np.arange(n) + LENGTH <= at[1:][text])
    if not len(start):
        return anchors(data[:0], at)
    own, where = text[start], pos[start].astype(np.int64)
    head = np.flatnonzero(np.r_[True, (where[1:] != where[:-1]) | (own[1:] != own[:-1])])
    tail = np.r_[head[1:], len(start)] - 1
    q = where[head]
    return own[head], q, h[q], start[head], start[tail]


def short(h: np.ndarray) -> np.ndarray:
    return h >> U(64 - 8 * HASH_BYTES)


def packed(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES])


def unpacked(b: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(b) // HASH_BYTES, 8), np.uint8)
    wide[:, :HASH_BYTES] = b.reshape(-1, HASH_BYTES)
    return wide.view("<u8").ravel()


def binaries(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def cuts(*keys: np.ndarray) -> np.ndarray:
    """Where sorted keys change, with both ends."""
    change = np.zeros(len(keys[0]), bool)
    change[:1] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.r_[np.flatnonzero(change), len(keys[0])]


def blocks(batch: pa.RecordBatch, chunk: int = CHUNK) -> Iterator[tuple]:
    data, at = S.raw(batch.column(0))
    ids, ths = batch.column(1).to_numpy(), batch.column(2).to_numpy()
    for lo, hi in S.chunks(at, chunk):
        yield lo, hi, data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo], ids[lo:hi], ths[lo:hi]


def lists(cut: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(values, kind))


def flat(table: pa.Table, column: str) -> np.ndarray:
    """All lists of a column, end to end."""
    parts = [x.flatten().to_numpy() for x in table.column(column).chunks]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def flat_bytes(table: pa.Table, column: str) -> np.ndarray:
    parts = [S.raw(x)[0] for x in table.column(column).chunks]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint8)


def shelf(ths: np.ndarray, shelves: int) -> np.ndarray:
    """Where what is found for a text is gathered."""
    return (mix(ths.astype(np.int64).view(np.uint64)) % U(shelves)).astype(np.int64)


OWN, WITNESS, SURE = 0, 1, 2
ANCHOR_ROWS = "file int, id array<long>, th array<long>, n array<int>, kind array<byte>, hashes binary"
FOUND_ROWS = "shelf int, id array<long>, th array<long>, n array<int>, hashes binary"


def list_anchors(files: int, chunk: int = CHUNK):
    """(text, id, th) to the anchors of a block of texts, one row per file.

    Hashes that two texts of a block hold are sure already: they pass through a
    file without being compared, and two witnesses tell their own file."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, at, ids, ths in blocks(batch, chunk):
                text, _, h, _, _ = anchors(data, at)
                h = short(h)
                o = np.lexsort((text, h))
                text, h = text[o], h[o]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
                text, h = text[new], h[new]
                if not len(h):
                    continue
                run_ = cuts(h)
                t = ths[text]
                several = np.minimum.reduceat(t, run_[:-1]) != np.maximum.reduceat(t, run_[:-1])
                sure, seen = np.repeat(several, np.diff(run_)), h[run_[:-1][several]]
                own_file = (h % U(files)).astype(np.int64)
                file = np.r_[np.where(sure, text % files, own_file), np.tile((seen % U(files)).astype(np.int64), 2)]
                kind = np.r_[np.where(sure, SURE, OWN), np.full(2 * len(seen), WITNESS)]
                text = np.r_[text, np.full(len(seen), len(ids)), np.full(len(seen), len(ids) + 1)]
                h = np.r_[h, seen, seen]
                o = np.lexsort((text, kind, file))
                file, kind, text, h = file[o], kind[o], text[o], h[o]
                group = cuts(file, kind, text)
                first = group[:-1]
                row = cuts(file[first])
                every_id, every_th = np.r_[ids, -1, -1], np.r_[ths, 0, 1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(file[first][row[:-1]].astype(np.int32)), lists(row, every_id[text[first]], pa.int64()),
                     lists(row, every_th[text[first]], pa.int64()), lists(row, np.diff(group), pa.int32()),
                     lists(row, kind[first].astype(np.int8), pa.int8()), binaries(packed(h).ravel(), group[row] * HASH_BYTES)],
                    names=["file", "id", "th", "n", "kind", "hashes"])
    return run


def find_repeats(shelves: int):
    """One file's anchors to those that two different texts hold, by shelf of the text."""
    def run(table: pa.Table) -> pa.Table:
        n = flat(table, "n")
        ids, ths, kind = (np.repeat(flat(table, c), n) for c in ("id", "th", "kind"))
        h = unpacked(flat_bytes(table, "hashes"))
        hit = kind == SURE
        rest = np.flatnonzero(~hit)
        if len(rest):
            o = rest[np.argsort(h[rest], kind="stable")]
            run_ = cuts(h[o])
            t, wit = ths[o], kind[o] == WITNESS
            many = (np.minimum.reduceat(t, run_[:-1]) != np.maximum.reduceat(t, run_[:-1])) | np.logical_or.reduceat(wit, run_[:-1])
            hit[o] = np.repeat(many, np.diff(run_)) & ~wit
        ids, ths, h = ids[hit], ths[hit], h[hit]
        where = shelf(ths, shelves)
        o = np.lexsort((h, ths, ids, where))
        where, ids, ths, h = where[o], ids[o], ths[o], h[o]
        group = cuts(where, ids, ths) if len(h) else np.zeros(1, np.int64)
        first = group[:-1]
        row = cuts(where[first]) if len(h) else np.zeros(1, np.int64)
        return pa.table({
            "shelf": pa.array(where[first][row[:-1]].astype(np.int32)), "id": lists(row, ids[first], pa.int64()),
            "th": lists(row, ths[first], pa.int64()), "n": lists(row, np.diff(group), pa.int32()),
            "hashes": binaries(packed(h).ravel(), group[row] * HASH_BYTES)})
    return run


def gather_hashes(table: pa.Table) -> pa.Table:
    """A shelf's texts, each with all its repeated anchors."""
    n = flat(table, "n")
    ids, ths = np.repeat(flat(table, "id"), n), np.repeat(flat(table, "th"), n)
    h = unpacked(flat_bytes(table, "hashes"))
    o = np.lexsort((ths, ids))
    group = cuts(ids[o], ths[o]) if len(h) else np.zeros(1, np.int64)
    first = o[group[:-1]] if len(h) else o
    return pa.table({"id": ids[first], "th": ths[first], "hashes": binaries(packed(h[o]).ravel(), group * HASH_BYTES)})


def repeated(batch: pa.RecordBatch, chunk: int) -> Iterator[tuple]:
    """(text, id, th, hashes) to each block with the stretches at its repeated anchors."""
    for lo, hi, data, at, ids, ths in blocks(batch, chunk):
        text, q, h, p0, p1 = anchors(data, at)
        known, ends = S.raw(batch.column(3).slice(lo, hi - lo))
        size = np.diff(ends) // HASH_BYTES
        code = lambda h_, t_: mix(h_ ^ mix(t_.astype(np.uint64)))
        want = code(unpacked(known), np.repeat(np.arange(hi - lo), size))
        on = np.isin(code(short(h), text), want)
        yield data, at, ids, ths, text[on], q[on], h[on], p0[on], p1[on]


def count_anchors(chunk: int = CHUNK):
    """(text, id, th, hashes) to (hash, n) of the anchors with several stretches in a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [short(b[6]) for batch in batches for b in repeated(batch, chunk)]
        if found:
            h, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h[n > 1].astype(np.int64)), pa.array(n[n > 1].astype(np.int64))], names=["h", "n"])
    return run


def hot_anchors(held: DataFrame, n_bytes: int, least: int, chunk: int = CHUNK, sample_bytes: int = SAMPLE_BYTES) -> dict[int, int]:
    """Hashes of the anchors with about ``least`` stretches or more, and how many,
    from a sample of the texts.  They only decide where stretches go."""
    share = min(1.0, sample_bytes / max(1, n_bytes))
    part = held.sample(share, 7) if share < 1 else held
    n = part.mapInArrow(count_anchors(chunk), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    return {r.h: int(r.n / share) for r in n.where(F.col("n") >= max(2, least * share)).collect()}


def lay_out(files: int, hot: Sequence[int] = (), chunk: int = CHUNK):
    """(text, id, th, hashes) to a block's stretches, one row per file and kind.

    Equal stretches of a block leave once, with the least id; those of the other
    texts are covered whole and pass through without their bytes.  At ``hot``
    anchors every window is a stretch of its own."""
    around = np.arange(-SPAN, LENGTH)
    many = np.array(sorted(hot), np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, at, ids, ths, *found in repeated(batch, chunk):
                by_window = np.isin(short(found[2]), many)
                text, q, h, p0, p1 = (x[~by_window] for x in found)
                for a in range(0, len(q), 1 << 16):
                    z = slice(a, a + (1 << 16))
                    yield stretch(data, at, ids, ths, files, around, text[z], q[z], h[z], p0[z], p1[z])
                text, q, h, p0, p1 = (x[by_window] for x in found)
                # equal windows side by side, so that they meet in one piece
                n = p1 - p0 + 1
                each = np.repeat(np.arange(len(n)), n)
                start = p0[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                o = np.lexsort((ids[text[each]], window_marks(data, start)))
                for a in range(0, len(o), HOT_PIECE * (SPAN + 1)):
                    z = o[a:a + HOT_PIECE * (SPAN + 1)]
                    k, p = each[z], start[z]
                    yield stretch(data, at, ids, ths, files, around, text[k], q[k], h[k], p, p, True)
    return run


def window_marks(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Hashes of the windows from ``start``."""
    mark = np.zeros(len(start), np.uint64)
    for k in range(LENGTH):
        mark = mark * U(S.ORDER[0]) + data[start + k]
    return mix(mark)


def stretch(data, at, ids, ths, files, around, text, q, h, p0, p1, by_bytes=False) -> pa.RecordBatch:
    spot = q[:, None] + around[None, :]
    inside = (spot >= p0[:, None]) & (spot < (p1 + LENGTH)[:, None])
    rows = np.where(inside, data[np.clip(spot, 0, len(data) - 1)], 0).astype(np.uint8)
    own = ids[text]
    # copies within the block: the least id speaks for all
    mark = mix(h)
    for k in range(0, WIDTH, 8):
        part = np.zeros((len(rows), 8), np.uint8)
        piece = rows[:, k:k + 8]
        part[:, :piece.shape[1]] = piece
        mark = mix(mark ^ part.view("<u8").ravel())
    mark = mix(mark ^ ((p0 - q) * 64 + p1 - p0).astype(np.uint64))
    o = np.lexsort((own, mark))
    cut = cuts(mark[o])
    least = np.empty(len(own), np.int64)
    least[o] = np.repeat(own[o[cut[:-1]]], np.diff(cut))
    whole_ = own != least
    file = np.where(whole_, text % files, ((mark if by_bytes else mix(h)) % U(files)).astype(np.int64))
    o = np.lexsort((whole_, file))
    text, q, p0, p1, rows, file, own, whole_ = (x[o] for x in (text, q, p0, p1, rows, file, own, whole_))
    cut = cuts(file, whole_)
    first = cut[:-1]
    sent = np.r_[0, np.cumsum(np.where(whole_[first], 0, np.diff(cut)))]
    return pa.RecordBatch.from_arrays(
        [pa.array(file[first].astype(np.int32)), pa.array(whole_[first]), lists(cut, own, pa.int64()), lists(cut, ths[text], pa.int64()),
         lists(cut, q - at[text], pa.int32()), lists(cut, (p0 - q + SPAN).astype(np.int8), pa.int8()),
         lists(cut, (p1 - q + SPAN).astype(np.int8), pa.int8()), binaries(rows[~whole_].ravel(), sent * WIDTH)],
        names=["file", "whole", "id", "th", "at", "first", "last", "bytes"])


LAID_ROWS = "file int, whole boolean, id array<long>, th array<long>, at array<int>, first array<byte>, last array<byte>, bytes binary"
RUN_ROWS = "shelf int, id array<long>, th array<long>, n array<int>, starts array<int>, sizes array<byte>"


def covered(rows: np.ndarray, ids: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Aligned stretches (n x WIDTH) to n x (SPAN + 1): whether the window from a
    column also stands in a stretch with a smaller id.

    One column a round, from the last to the first, as the module says."""
    n = len(rows)
    out = np.zeros((n, SPAN + 1), bool)
    order = np.argsort(ids, kind="stable")
    common = np.zeros(n, np.uint8)  # with the neighbour before, up to LENGTH
    columns = np.ascontiguousarray(rows.T)
    for c in range(WIDTH - 1, -1, -1):
        symbol = columns[c][order]
        moved = np.argsort(symbol, kind="stable")
        # least common prefix between two rows that now stand side by side
        a, b = moved[:-1], moved[1:]
        width = b - a
        within = np.zeros(n, np.uint8)
        if n > 1:
            same = symbol[a] == symbol[b]
            level = np.where(same, np.frexp(np.maximum(width, 1).astype(np.float64))[1] - 1, -1)
            least, best = common, np.zeros(n - 1, np.uint8)
            for k in range(int(level.max(initial=-1)) + 1):
                on = np.flatnonzero(level == k)
                if len(on):
                    best[on] = np.minimum(least[a[on] + 1], least[b[on] + 1 - (1 << k)])
                if len(least) > 1 << k:
                    short_ = least.copy()
                    np.minimum(least[:-(1 << k)], least[1 << k:], out=short_[:-(1 << k)])
                    least = short_
            within[1:] = np.where(same, np.minimum(best + 1, LENGTH), 0)
        order, common = order[moved], within
        if c > SPAN:
            continue
        valid = (first[order] <= c) & (c <= last[order])
        head = np.flatnonzero(common < LENGTH)
        own = np.where(valid, ids[order], LAST)
        least_id = np.repeat(np.minimum.reduceat(own, head), np.diff(np.r_[head, n]))
        out[order, c] = valid & (ids[order] > least_id)
    return out


def settle(shelves: int):
    """One file's stretches to runs of covered windows, by shelf of the text."""
    def run(table: pa.Table) -> pa.Table:
        n = np.concatenate([np.diff(x.offsets.to_numpy()) for x in table.column("id").chunks])
        alone = np.repeat(table.column("whole").to_numpy(), n)
        ids, ths, at, first, last = (flat(table, c) for c in ("id", "th", "at", "first", "last"))
        spot = np.arange(SPAN + 1)[None, :]
        cover = (spot >= first[:, None]) & (spot <= last[:, None])
        k = np.flatnonzero(~alone)
        cover[k] = covered(flat_bytes(table, "bytes").reshape(-1, WIDTH), ids[k], first[k], last[k])
        wide = np.zeros((len(cover), SPAN + 3), np.int8)
        wide[:, 1:-1] = cover
        edge = np.diff(wide, axis=1)
        i, a = np.nonzero(edge == 1)
        _, z = np.nonzero(edge == -1)
        start, size = at[i].astype(np.int64) - SPAN + a, z - a
        where = shelf(ths[i], shelves)
        o = np.lexsort((start, ths[i], ids[i], where))
        i, start, size, where = i[o], start[o], size[o], where[o]
        group = cuts(where, ids[i], ths[i]) if len(i) else np.zeros(1, np.int64)
        head = group[:-1]
        row = cuts(where[head]) if len(i) else np.zeros(1, np.int64)
        return pa.table({
            "shelf": pa.array(where[head][row[:-1]].astype(np.int32)), "id": lists(row, ids[i[head]], pa.int64()),
            "th": lists(row, ths[i[head]], pa.int64()), "n": lists(row, np.diff(group), pa.int32()),
            "starts": lists(group[row], start, pa.int32()), "sizes": lists(group[row], size.astype(np.int8), pa.int8())})
    return run


def gather_runs(table: pa.Table) -> pa.Table:
    """A shelf's texts, each with all its runs of covered windows."""
    n = flat(table, "n")
    ids, ths = np.repeat(flat(table, "id"), n), np.repeat(flat(table, "th"), n)
    start, size = flat(table, "starts"), flat(table, "sizes")
    o = np.lexsort((start, ths, ids))
    group = cuts(ids[o], ths[o]) if len(o) else np.zeros(1, np.int64)
    first = o[group[:-1]] if len(o) else o
    return pa.table({"id": ids[first], "th": ths[first], "starts": lists(group, start[o], pa.int32()), "sizes": lists(group, size[o], pa.int8())})


def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, id, th, starts, sizes) to the bytes that stay."""
    for batch in batches:
        data, at = S.raw(batch.column(0))
        out = []
        for i in range(batch.num_rows):
            b = data[at[i]:at[i + 1]]
            a = batch.column(3)[i].values.to_numpy().astype(np.int64)
            z = a + batch.column(4)[i].values.to_numpy() + LENGTH - 1
            gone = np.cumsum(np.bincount(a, minlength=len(b) + 1) - np.bincount(z, minlength=len(b) + 1))[:len(b)] > 0
            kept = b[~gone].tobytes()
            out.append((int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest(), kept))
        yield pa.RecordBatch.from_arrays(
            [batch.column(1), batch.column(2), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()),
             pa.array([x[2] for x in out], pa.string()), pa.array([x[3] for x in out], pa.binary())],
            names=["id", "th", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(df: DataFrame, text: str = "text", doc_id: str = "doc_id", with_bytes: bool = False,
                   anchors_per_file: int = ANCHORS_PER_FILE, rows_per_file: int = ROWS_PER_FILE, texts_per_shelf: int = TEXTS_PER_SHELF,
                   chunk: int = CHUNK, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes that
    stay), one row per row.

    A byte goes if a 50-byte string over it also starts in a text with a smaller
    id.  Null texts are empty; texts below 50 bytes stay whole; null ids come
    after all others, and rows of equal id take nothing from one another.  An
    empty table gives an empty one; further columns are ignored.
    """
    base = work_dir(df.sparkSession)
    body = whole(F.col(f"`{text}`"))
    docs = df.select(body.alias("text"), F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(LAST)).alias("id"))
    docs = docs.withColumn("th", F.xxhash64("text"))
    light = materialise(docs.select("id", "th", F.octet_length("text").cast("long").alias("n"), F.sha2("text", 256).alias("sha")), "light", base)
    total = light.agg(F.sum("n")).first()[0] or 0
    groups = light.groupBy("sha").agg(F.min("id").alias("least")).withColumnRenamed("sha", "_s")
    light = materialise(light.join(groups, F.col("sha") == F.col("_s")).drop("_s"), "placed", base)
    files = max(1, math.ceil(total * 2 / (SPAN + 2) / anchors_per_file))
    shelves = max(1, light.count() // texts_per_shelf)
    listed = docs.mapInArrow(list_anchors(files, chunk), ANCHOR_ROWS)
    found = listed.groupBy("file").applyInArrow(find_repeats(shelves), FOUND_ROWS)
    asked = found.groupBy("shelf").applyInArrow(gather_hashes, "id long, th long, hashes binary")
    first = light.where("id = least").select("id", "th").distinct()
    asked = asked.join(first, ["id", "th"]).select(F.col("id").alias("_i"), F.col("th").alias("_t"), "hashes")
    held = docs.join(asked, (F.col("id") == F.col("_i")) & (F.col("th") == F.col("_t"))).select("text", "id", "th", "hashes")
    held = materialise(held, "held", base)
    n_bytes, rows = held.agg(F.sum(F.octet_length("text")), F.sum(F.octet_length("hashes"))).first()
    rows = (rows or 0) / HASH_BYTES
    hot = hot_anchors(held, n_bytes or 0, hot_rows, chunk) if rows > hot_rows else {}
    files = max(1, math.ceil((rows + SPAN * sum(hot.values())) / rows_per_file))
    laid = held.mapInArrow(lay_out(files, tuple(hot), chunk), LAID_ROWS)
    gone = laid.groupBy("file").applyInArrow(settle(shelves), RUN_ROWS)
    gone = gone.groupBy("shelf").applyInArrow(gather_runs, "id long, th long, starts array<int>, sizes array<byte>")
    gone = gone.select(F.col("id").alias("_i"), F.col("th").alias("_t"), "starts", "sizes")
    cut = held.join(gone, (F.col("id") == F.col("_i")) & (F.col("th") == F.col("_t"))).select("text", "id", "th", "starts", "sizes")
    cut = cut.mapInArrow(strip, "id long, th long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    cut = cut.select(F.col("id").alias("_i"), F.col("th").alias("_t"), "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_bytes else []))
    cut = cut.dropDuplicates(["_i", "_t"])
    copy = (F.col("id") > F.col("least")) & (F.col("n") >= LENGTH)
    out = light.join(cut, (F.col("id") == F.col("_i")) & (F.col("th") == F.col("_t")), "left")
    pick = lambda whole_, part, none: F.when(copy, whole_).otherwise(F.coalesce(part, none))
    out = out.select(
        "id", "th", F.col("n").alias("n_bytes"), pick(F.col("n"), F.col("n_removed"), F.lit(0)).cast("long").alias("n_removed"),
        pick(F.lit(1), F.col("n_spans"), F.lit(0)).cast("long").alias("n_spans"),
        pick(F.lit(hashlib.sha256(b"").hexdigest()), F.col("kept_sha256"), F.col("sha")).alias("kept_sha256"),
        *([pick(F.lit(b""), F.col("kept"), F.lit(None)).alias("kept")] if with_bytes else []))
    if with_bytes:  # what nothing was taken from is read from the table
        d = docs.select(F.col("id").alias("_i"), F.col("th").alias("_t"), "text").dropDuplicates(["_i", "_t"])
        out = out.join(d, (F.col("id") == F.col("_i")) & (F.col("th") == F.col("_t"))).withColumn(
            "kept", F.coalesce("kept", F.encode("text", "UTF-8"))).drop("_i", "_t", "text")
    return out.drop("th").withColumn("id", F.when(F.col("id") < LAST, F.col("id"))).withColumnRenamed("id", "doc_id")
