"""Alignment of two tokenizers' tokens on the same bytes.

Both encode a text to tokens that lie end to end on the bytes of " " + text.
Where a token of each ends, a group ends.  A byte range of a long text is a
fragment: an open prefix up to its first common end, closed groups, and an open
suffix after its last one.  Fragments compose associatively (a suffix and the
next prefix close one group), so a tree of small tasks settles documents whose
ranges were cut anywhere.  What lies between common ends is a segment; groups
and links are local to segments, whose runs end to end are segments again.  Words
with the space before them are the shortest segments that need no look around
them, so each is encoded and linked once.

Link counts of the whole corpus reach the documents by blocks: a block holds its
documents as lists of segments and each segment's links once, asks for the pairs
among them, once each, and gets their counts.
"""

import hashlib
import os
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import materialise, work_dir
from .text import whole

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Characters from which a text is cut into pieces; bytes of a fragment; tokens of
#: both kinds in a block; fragments that one step of the tree composes.
LONG, RANGE, BLOCK_TOKENS, FAN = 1 << 16, 1 << 14, 1 << 21, 16
#: Words a task remembers; rows that it takes at a time.
KNOWN_WORDS, ROWS = 400_000, 256
#: Below this sign all versions of Unicode agree on letters and digits.
PLAIN = "\u0250"
#: Fixed value: how a byte-level vocabulary of this kind cuts texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Where words are cut: spaces after other than white space, but for those that end
#: the text.  Most texts have no white space before a space, and are cut at every one.
CUT, UNEVEN = re.compile(r"(?<=\S)(?= +[^ ])"), re.compile(r"\s | $")
#: No token of either kind lies across a space like this one (see ``Pair.cuts``).
SAFE = re.compile(r"(?<=[A-Za-z0-9.,]) (?=[A-Za-z])")
COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
KEY = ("uid", "doc_id", "k", "j", "part")


def byte_signs() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable
    ones for themselves, the others in order from code point 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Tokenizer A (byte-level, JSON) and B (pieces) with their tokens' bytes."""

    def __init__(self, file_a: str, file_b: str, pattern: str | None = None):
        """``pattern``: how A cuts texts, if merging by ids is known to be the same;
        plain words then go through the faster library."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(file_a)
        self.a.encode_special_tokens = True
        signs, vocab = byte_signs(), self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(signs[c] for c in token)
        self.b = sentencepiece.SentencePieceProcessor(model_file=file_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        self.size_a, self.size_b = sizes(self.bytes_a), sizes(self.bytes_b)
        # a space inside a piece would let B's tokens lie across a cut
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.quick = None if pattern is None else tiktoken.Encoding("a", pat_str=pattern, special_tokens={}, mergeable_ranks={
            b: i for i, b in enumerate(self.bytes_a) if i not in self.a.get_added_tokens_decoder()})

    def same_by_ranks(self) -> bool:
        """Whether merging by A's ids is merging by its list: if every token's bytes
        merge to that token, two tokens next to each other that make up a third are
        the two it is merged from, as nothing from outside has touched its bytes."""
        names = {i: t for t, i in self.a.get_vocab().items()}
        special = self.a.get_added_tokens_decoder()
        return all([x.id for x in self.a.model.tokenize(t)] == [i] for i, t in names.items() if i not in special)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of " " + text by A and by B; None where bytes differ from the text's."""
        out: list[tuple[np.ndarray, np.ndarray] | None] = []
        for at in range(0, len(texts), 256):
            part = texts[at:at + 256]
            got = [self.quick.encode_ordinary(" " + t) if self.quick is not None and max(t, default="") < PLAIN else None for t in part]
            slow = [i for i, x in enumerate(got) if x is None]
            for i, x in zip(slow, self.a.encode_batch_fast([" " + part[i] for i in slow], add_special_tokens=False) if slow else ()):
                got[i] = x.ids
            for t, x, y in zip(part, got, self.b.encode(part, num_threads=1)):
                data = b" " + t.encode()
                same = b"".join(map(self.bytes_a.__getitem__, x)) == data and b"".join(map(self.bytes_b.__getitem__, y)) == data
                out.append((np.array(x, "<u4"), np.array(y, "<u4")) if same else None)
        return out

    def words(self, text: str) -> list[str]:
        """The text's segments, each without the space before it: neither tokenizer
        has a token across a space that follows other than white space."""
        if not self.cuts:
            return [text]
        if UNEVEN.search(text) or text[:1].isspace():
            return [w[1:] for w in CUT.split(" " + text)]
        return text.split(" ")

    def pieces(self, text: str, limit: int) -> Iterator[str]:
        """Parts of the text whose tokens in a row are the text's; the space of a cut
        is the one that both tokenizers see before the next part."""
        at = 0
        while self.cuts and len(text) - at > limit:
            cut = SAFE.search(text, at + limit - 1)
            if cut is None:
                break
            yield text[at:cut.start()]
            at = cut.end()
        yield text[at:]


def sizes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(len, tokens), np.int64, len(tokens))


def fragments(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, span: int) -> Iterator[tuple]:
    """Cuts a text's tokens by the byte ranges they end in: for each range
    (has, prefix, closed, suffix), each of the three a pair of id arrays.

    ``has`` tells whether the range holds a common end; if not, all its tokens
    are prefix.  The text's beginning counts as a common end of the first range.
    """
    end_a, end_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
    n = max(1, -(-int(end_a[-1]) // span))
    edges = np.arange(1, n + 1) * span
    hi_a, hi_b = np.searchsorted(end_a, edges, "right"), np.searchsorted(end_b, edges, "right")
    lo_a = lo_b = 0
    for j in range(n):
        ea, eb = end_a[lo_a:hi_a[j]], end_b[lo_b:hi_b[j]]
        ia, ib = np.intersect1d(ea, eb, assume_unique=True, return_indices=True)[1:]
        if not len(ia) and j:
            first = last = (len(ea), len(eb))
        else:
            first = (0, 0) if j == 0 else (ia[0] + 1, ib[0] + 1)
            last = (ia[-1] + 1, ib[-1] + 1) if len(ia) else (0, 0)
        cut = lambda x, y: (a[lo_a + x[0]:lo_a + y[0]], b[lo_b + x[1]:lo_b + y[1]])
        yield bool(len(ia)) or j == 0, cut((0, 0), first), cut(first, last), cut(last, (len(ea), len(eb)))
        lo_a, lo_b = hi_a[j], hi_b[j]


def compose(rows: list[dict]) -> tuple[dict, list[dict]]:
    """Neighbouring fragments, in order, to one; with the segments that they close.
    Associative: any grouping into runs gives the same segments and ends."""
    cur, closed = dict(rows[0]), []
    for r in rows[1:]:
        cur["ok"] = cur["ok"] and r["ok"]
        if not cur["has"]:
            cur["pa"], cur["pb"] = cur["pa"] + r["pa"], cur["pb"] + r["pb"]
            if r["has"]:
                cur.update({c: r[c] for c in ("has", "sa", "sb", "pk", "pj")})
        elif not r["has"]:
            cur["sa"], cur["sb"] = cur["sa"] + r["pa"], cur["sb"] + r["pb"]
        else:
            a, b = cur["sa"] + r["pa"], cur["sb"] + r["pb"]
            if a:
                closed.append({"uid": r["uid"], "doc_id": r["doc_id"], "k": r["pk"], "j": r["pj"], "part": 0, "a": a, "b": b})
            cur["sa"], cur["sb"] = r["sa"], r["sb"]
    return cur, closed


def links(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, ...]:
    """The links of segments end to end: their ends, A and B tokens by position,
    and whether a group ends there.  Between two neighbouring ends of any token
    lies one pair of overlapping tokens, and each pair lies there once."""
    end_a, end_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
    ends = np.union1d(end_a, end_b)
    ia, ib = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
    return ends, ia, ib, (end_a[ia] == ends) & (end_b[ib] == ends)


def linked(each_a: list[np.ndarray], each_b: list[np.ndarray], size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Segments to (link keys end to end, their ends by segment, groups of each, its
    groups as text)."""
    a, b = np.concatenate(each_a).astype(np.int64), np.concatenate(each_b).astype(np.int64)
    ends, ia, ib, common = links(a, b, size_a, size_b)
    n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (each_a, each_b))
    upto = np.searchsorted(ends, np.cumsum(size_a[a])[np.cumsum(n_a) - 1], "right")
    groups = np.diff(np.concatenate(([0], np.cumsum(common)))[np.concatenate(([0], upto))])
    # tokens in the order of (group, side, place), each with the sign that follows it:
    # "," within its side of a group, else "|" or ";"
    last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    last_a[ia[common]], last_b[ib[common]] = True, True
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    put = np.empty(len(a) + len(b), np.int64)
    put[np.arange(len(a)) + np.searchsorted(group_b, group_a, "left")] = a * 3 + last_a
    put[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = b * 3 + 2 * last_b
    names, lo, texts = {c: str(c // 3) + ",|;"[c % 3] for c in np.unique(put).tolist()}, 0, []
    for hi in np.cumsum(n_a + n_b).tolist():
        texts.append("".join(map(names.__getitem__, put[lo:hi].tolist()))[:-1])
        lo = hi
    return a[ia] * len(size_b) + b[ib], upto, groups, texts


class Words:
    """Segments that a task has met, by number: their links, counts and groups."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.right, self.counts = np.zeros(0, bool), np.zeros((0, 4), np.int64)  # n_a, n_b, n_groups, n_links
        self.keys, self.ends, self.texts = np.zeros(0, np.int64), np.zeros(1, np.int64), []

    def full(self) -> bool:
        return len(self.known) > KNOWN_WORDS or len(self.keys) > 8 * KNOWN_WORDS

    def add(self, got: list[tuple[np.ndarray, np.ndarray] | None]) -> np.ndarray:
        """Numbers of new segments."""
        first, fine = len(self.right), [g for g in got if g is not None]
        right = np.fromiter((g is not None for g in got), bool, len(got))
        counts, n, texts = np.zeros((len(got), 4), np.int64), np.zeros(len(got), np.int64), [""] * len(got)
        if fine:
            keys, upto, groups, said = linked([g[0] for g in fine], [g[1] for g in fine], self.pair.size_a, self.pair.size_b)
            n[right] = np.diff(upto, prepend=0)
            counts[right] = np.column_stack([[len(g[0]) for g in fine], [len(g[1]) for g in fine], groups, n[right]])
            self.keys = np.append(self.keys, keys)
            for i, t in zip(np.flatnonzero(right).tolist(), said):
                texts[i] = t
        self.right, self.counts = np.append(self.right, right), np.vstack([self.counts, counts])
        self.ends = np.append(self.ends, self.ends[-1] + np.cumsum(n))
        self.texts += texts
        return np.arange(first, first + len(got))

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's segments by number."""
        parts = [self.pair.words(t) for t in texts]
        new = [w for w in dict.fromkeys(w for p in parts for w in p) if w not in self.known]
        self.known.update(zip(new, self.add(self.pair.encode(new)).tolist()))
        return [np.fromiter(map(self.known.__getitem__, p), np.int64, len(p)) for p in parts]


class Block:
    """Rows of one block: documents or parts of them as lists of segments."""

    def __init__(self, words: Words, doc_type: pa.DataType):
        self.words, self.doc_type = words, doc_type
        self.rows: list[dict] = []
        self.items: list[np.ndarray] = []
        self.tokens = 0

    def put(self, row: dict, items: np.ndarray) -> None:
        w = self.words
        n = w.counts[items].sum(axis=0).tolist()
        text = ";".join(map(w.texts.__getitem__, items.tolist()))
        self.rows.append(row | dict(zip(COUNTS, n)) | {"groups": hashlib.sha256(text.encode()).hexdigest() if row["whole"] else text})
        self.items.append(items)
        self.tokens += n[0] + n[1]

    def close(self, number: int) -> Iterator[pa.RecordBatch]:
        """The rows with block-wide segment numbers, and one row with the block's
        pairs, how often it holds each, and every segment's links among them."""
        if not self.rows:
            return
        w, schema = self.words, block_schema(self.doc_type)
        own, at = np.unique(np.concatenate(self.items), return_inverse=True)
        often = np.bincount(at)
        n = w.ends[own + 1] - w.ends[own]
        upto = np.cumsum(n)
        held = w.keys[np.arange(upto[-1]) + np.repeat(w.ends[own] - upto + n, n)]
        keys, spots = np.unique(held, return_inverse=True)
        counts = np.bincount(spots, np.repeat(often, n)).astype(np.int64)
        cuts = np.cumsum([len(x) for x in self.items])[:-1]
        rows = [r | {"block": number, "kind": DOCUMENT, "items": x.astype("<u4").tobytes()} for r, x in zip(self.rows, np.split(at, cuts))]
        rows.append({"block": number, "kind": PAIRS, "items": spots.astype("<u4").tobytes(), "ends": upto.astype("<u4").tobytes(),
                     "keys": keys.tobytes(), "counts": counts.tobytes()})
        self.rows, self.items, self.tokens = [], [], 0
        yield from pa.Table.from_pylist(rows, schema=schema).to_batches(max_chunksize=1024)


DOCUMENT, PAIRS, NONE = 0, 1, 2


def block_schema(doc_type: pa.DataType) -> pa.Schema:
    """Kinds: a document or part of one, a block's pairs, a document without tokens."""
    return pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("uid", pa.int64()), ("doc_id", doc_type), *((c, pa.int32()) for c in ("k", "j", "part")),
                      ("whole", pa.bool_()), *((c, pa.int64()) for c in COUNTS[:4]), ("groups", pa.string()),
                      *((c, pa.binary()) for c in ("items", "ends", "keys", "counts"))])


def ids(x: pa.Scalar, kind: str = "<u4") -> np.ndarray:
    return np.frombuffer(x.as_buffer(), kind) if x.is_valid else np.zeros(0, kind)


def blocks(df: DataFrame, files: tuple[str, str, str | None], text: str, doc_id: str, base: str, long: int, span: int, block_tokens: int) -> DataFrame:
    """Rows of ``block_schema``: whole documents, and long ones in parts."""
    rows = df.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{doc_id}`").alias("doc_id"), whole(F.col(f"`{text}`")).alias("text"))
    id_type = rows.schema["doc_id"].dataType
    doc_type = _arrow(id_type)
    out_schema = _spark(block_schema(doc_type), id_type)
    pid = F.spark_partition_id().cast("long").alias("pid")

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(Pair(*files))
        block, number = Block(words, doc_type), 0
        for batch in batches:
            at = batch.column("pid")[0].as_py() << 24 if batch.num_rows else 0
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                if words.full():
                    yield from block.close(at + number)
                    words.forget()
                    number += 1
                texts, none = part.column("text").to_pylist(), []
                for t, items, uid, doc in zip(texts, words(texts), part.column("uid").to_pylist(), part.column("doc_id").to_pylist()):
                    row = {"uid": uid, "doc_id": doc, "k": 0, "j": 0, "part": 0, "whole": True}
                    if not t or not words.right[items].all():
                        none.append(row | {"block": at, "kind": NONE})
                        continue
                    block.put(row, items)
                if none:
                    yield from pa.Table.from_pylist(none, schema=block_schema(doc_type)).to_batches()
                if block.tokens > block_tokens:
                    yield from block.close(at + number)
                    number += 1
            yield from block.close(at + number)
            number += 1

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, number = Pair(*files), 0
        for batch in batches:
            at = (1 << 60) + (batch.column("pid")[0].as_py() << 24) if batch.num_rows else 0
            words = Words(pair)
            block = Block(words, doc_type)
            for lo in range(0, batch.num_rows, 16):
                part = batch.slice(lo, 16)
                items = words.add([(ids(a), ids(b)) for a, b in zip(part.column("a"), part.column("b"))])
                for row, i in zip(part.select(list(KEY)).to_pylist(), items):
                    block.put(row | {"whole": False}, np.array([i]))
                if block.tokens > block_tokens:
                    yield from block.close(at + number)
                    words.forget()
                    number += 1
            yield from block.close(at + number)
            number += 1

    few = materialise(rows.where(F.length("text") <= long).select("*", pid).mapInArrow(short, out_schema), "short", base)
    segs, bad = long_segments(rows.where(F.length("text") > long), files, base, long, span)
    many = materialise(segs.select("*", pid).mapInArrow(parted, out_schema), "long", base)
    none = bad.select(*[F.col(c) if c in ("uid", "doc_id") else F.lit(NONE).alias(c) if c == "kind" else F.lit(None).cast(out_schema[c].dataType).alias(c)
                        for c in out_schema.fieldNames()])
    return few.unionByName(many).unionByName(none)


def long_segments(rows: DataFrame, files: tuple[str, str, str | None], base: str, long: int, span: int) -> tuple[DataFrame, DataFrame]:
    """Long texts (uid, doc_id, text) to (their segments: uid, doc_id, k, j, part, a,
    b, in that order; the documents without tokens: uid, doc_id)."""
    id_type = rows.schema["doc_id"].dataType
    key = [T.StructField("uid", T.LongType()), T.StructField("doc_id", id_type), *(T.StructField(c, T.IntegerType()) for c in ("k", "j", "part"))]
    tokens = [T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair(*files)
        for batch in batches:
            for i in range(batch.num_rows):
                for k, p in enumerate(pair.pieces(batch.column("text")[i].as_py(), long)):
                    yield pa.RecordBatch.from_arrays([batch.column("uid").slice(i, 1), batch.column("doc_id").slice(i, 1), pa.array([k], pa.int32()), pa.array([p])],
                                                     names=["uid", "doc_id", "k", "text"])

    open_schema = T.StructType([*key, *tokens, *(T.StructField(c, T.BooleanType()) for c in ("ok", "has")),
                                *(T.StructField(c, T.IntegerType()) for c in ("pk", "pj")), *(T.StructField(c, T.BinaryType()) for c in ("pa", "pb", "sa", "sb"))])
    open_arrow = pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in open_schema])

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair(*files)
        for batch in batches:
            for row in batch.to_pylist():
                own = {"uid": row["uid"], "doc_id": row["doc_id"], "k": row["k"], "pk": row["k"]}
                got, out = pair.encode([row["text"]])[0], []
                if got is None:
                    out.append(own | {"j": 0, "part": 2, "ok": False, "has": True, "pj": 0, **dict.fromkeys(("pa", "pb", "sa", "sb"), b"")})
                else:
                    for j, (has, p, c, s) in enumerate(fragments(*got, pair.size_a, pair.size_b, span)):
                        ends = dict(zip(("pa", "pb", "sa", "sb"), (x.tobytes() for x in (*p, *s))))
                        out.append(own | ends | {"j": j, "pj": j, "part": 2, "ok": True, "has": has})
                        if len(c[0]):
                            out.append(own | {"j": j, "part": 1, "a": c[0].tobytes(), "b": c[1].tobytes()})
                yield from pa.Table.from_pylist(out, schema=open_arrow).to_batches()

    def join(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["k"], r["j"]))
        node, closed = compose(rows)
        return pa.Table.from_pylist([node, *closed], schema=open_arrow)

    pieces = rows.mapInArrow(cut, T.StructType([*key[:3], T.StructField("text", T.StringType())])).repartition("uid", "k")
    found = materialise(pieces.mapInArrow(ranges, open_schema), "ranges", base)
    segs, nodes = found.where("part = 1"), found.where("part = 2")
    most = nodes.agg(F.max("j").alias("j"), F.max("k").alias("k")).first()
    j, k, level = most["j"] or 0, most["k"] or 0, 0
    while j or k:
        by = ("uid", "k", F.floor(F.col("j") / FAN).alias("_j")) if j else ("uid", F.floor(F.col("k") / FAN).alias("_k"))
        level += 1
        done = materialise(nodes.groupBy(*by).applyInArrow(join, open_schema), f"level{level}", base)
        segs = segs.unionByName(done.where("part = 0"))
        up = F.floor(F.col("j") / FAN).cast("int").alias("j") if j else F.lit(0).alias("j")
        nodes = done.where("part = 2").select(*[up if c == "j" else F.floor(F.col("k") / FAN).cast("int").alias("k") if c == "k" and not j else c for c in open_schema.fieldNames()])
        j, k = (j // FAN, k) if j else (0, k // FAN)
    bad = nodes.where(~F.col("ok")).select("uid", "doc_id")
    return segs.select(*KEY, "a", "b").join(bad.select("uid"), "uid", "left_anti"), bad


def _arrow(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


def _spark(schema: pa.Schema, id_type: T.DataType) -> T.StructType:
    from pyspark.sql.pandas.types import from_arrow_type

    return T.StructType([T.StructField(f.name, id_type if f.name == "doc_id" else from_arrow_type(f.type)) for f in schema])


def align(df: DataFrame, file_a: str, file_b: str, text: str = "text", doc_id: str = "doc_id", long: int = LONG,
          span: int = RANGE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; one
    row per row.

    Null and empty texts, and texts whose tokens' bytes differ from " " + text,
    have no tokens: zeros and an empty string, and no link of theirs counts.
    Repeated rows and ids count and return each; ties for a B id's highest count
    all count as best.  An empty table gives an empty one; further columns are
    ignored and may have any name.  Both files must exist on every executor.
    """
    base = work_dir(df.sparkSession)
    pair = Pair(file_a, file_b)
    width, pattern = len(pair.bytes_b), PATTERN if pair.same_by_ranks() else None
    rows = blocks(df, (file_a, file_b, pattern), text, doc_id, base, long, span, block_tokens)
    id_type = rows.schema["doc_id"].dataType

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, keys, counts in zip(*(batch.column(c) for c in ("block", "keys", "counts"))):
                key = ids(keys, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), number.as_py())), pa.array(key), pa.array(ids(counts, "<i8"))], names=["block", "key", "n"])

    asked = materialise(rows.where(F.col("kind") == PAIRS).select("block", "keys", "counts").mapInArrow(pairs, "block long, key long, n long"), "pairs", base)
    counts = materialise(asked.groupBy("key").agg(F.sum("n").alias("count")).withColumn("b", F.pmod("key", F.lit(width))), "counts", base)
    best = counts.groupBy("b").agg(F.max("count").alias("top"))
    judged = counts.join(best, "b").select("key", "count", (F.col("count") == F.col("top")).alias("best"))
    answers = asked.select("block", "key").join(judged, "key").select("block", "key", "count", "best")
    schema = T.StructType([*(rows.schema[c] for c in (*KEY, "whole")), *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("groups", T.StringType())])
    arrow_schema = pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in schema])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        mine = left.filter(pa.compute.equal(left.column("kind"), PAIRS)).to_batches()[0]
        order = np.argsort(right.column("key").to_numpy(), kind="stable")  # the block's pairs, all of them
        spots, ends = ids(mine.column("items")[0]), ids(mine.column("ends")[0]).astype(np.int64)
        starts = np.concatenate(([0], ends[:-1]))
        each = {c: np.add.reduceat(right.column(c).to_numpy()[order].astype(np.int64)[spots], starts) for c in ("best", "count")}
        docs = left.filter(pa.compute.equal(left.column("kind"), DOCUMENT))
        items = [ids(x) for x in docs.column("items")]
        first = np.cumsum([0, *map(len, items)])[:-1]
        items = np.concatenate(items)
        out = docs.select([*KEY, "whole", *COUNTS[:4]])
        for name, c in (("n_best", "best"), ("count_sum", "count")):
            out = out.append_column(name, pa.array(np.add.reduceat(each[c][items], first)))
        return out.append_column("groups", docs.column("groups")).select(arrow_schema.names).cast(arrow_schema)

    met = materialise(rows.where(F.col("kind") != NONE).drop("keys", "counts").groupBy("block").cogroup(
        answers.groupBy("block")).applyInArrow(score, schema), "scored", base)
    final = T.StructType([T.StructField("doc_id", id_type), *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("groups_sha256", T.StringType())])
    final_arrow = pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in final])

    def total(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("k", "j", "part")])
        digest = hashlib.sha256()
        for i, x in enumerate(table.column("groups")):
            digest.update((b";" if i else b"") + x.as_py().encode())
        row = {"doc_id": table.column("doc_id")[0].as_py(), **{c: int(table.column(c).to_numpy().sum()) for c in COUNTS}, "groups_sha256": digest.hexdigest()}
        return pa.Table.from_pylist([row], schema=final_arrow)

    one = met.where("whole").select("doc_id", *COUNTS, F.col("groups").alias("groups_sha256"))
    many = met.where("NOT whole").groupBy("uid").applyInArrow(total, final)
    zero = rows.where(F.col("kind") == NONE).select("doc_id", *[F.lit(0).cast("long").alias(c) for c in COUNTS], F.lit("").alias("groups_sha256"))
    return one.unionByName(many).unionByName(zero)
