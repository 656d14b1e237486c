"""Byte-level BPE with a local rank file.

Texts are encoded in Arrow batches by the tiktoken library.  A long text is cut
before white space that follows a letter or digit: no match of the pattern
spans such a place and no look-ahead sees over it, so the pieces' ids in a row
are the text's ids.  A stretch without such a place goes through match by match.
Ids become bytes again by concatenating the vocabulary's byte strings.
"""

import base64
import hashlib
import re
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

#: Texts beyond this many characters are cut, for bounded working memory.
PIECE_CHARS = 1 << 16
#: A cut that long without a safe place is matched one by one.
MATCH_CHARS = 1 << 18
SAFE = re.compile(r"(?<=[A-Za-z0-9.,])(?=[ \n])")


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, rank_file: str, pattern: str):
        import tiktoken

        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = pattern
        ids = np.fromiter(ranks.values(), np.int64, len(ranks))
        size = np.zeros(ids.max() + 1, np.int64)
        size[ids] = np.fromiter(map(len, ranks), np.int64, len(ranks))
        self.start = np.concatenate(([0], np.cumsum(size)))
        data = bytearray(int(self.start[-1]))
        for b, i in ranks.items():
            data[self.start[i]:self.start[i + 1]] = b
        self.data = np.frombuffer(bytes(data), np.uint8)

    def pieces(self, text: str, limit: int = PIECE_CHARS) -> Iterator[str]:
        at = 0
        while len(text) - at > limit:
            cut = SAFE.search(text, at + limit)
            if cut is None:
                break
            yield text[at:cut.start()]
            at = cut.start()
        yield text[at:]

    def encode(self, text: str, limit: int = PIECE_CHARS) -> np.ndarray:
        """Ids of the whole text as little-endian unsigned 32-bit integers."""
        out: list[np.ndarray] = []
        for piece in self.pieces(text, limit):
            if len(piece) <= MATCH_CHARS + limit:
                out.append(np.array(self.encoding.encode_ordinary(piece), "<u4"))
                continue
            import regex

            for m in regex.finditer(self.pattern, piece):
                out.append(np.array(self.encoding._encode_single_piece(m[0]), "<u4"))
        return np.concatenate(out) if len(out) != 1 else out[0]

    def decode(self, ids: np.ndarray) -> bytes:
        """Raw bytes; they need not be valid UTF-8 if ``ids`` is a slice."""
        ids = ids.astype(np.int64)
        a, n = self.start[ids], self.start[ids + 1] - self.start[ids]
        ends = np.cumsum(n)
        if not len(ids):
            return b""
        spots = np.arange(ends[-1]) + np.repeat(a - (ends - n), n)
        return self.data[spots].tobytes()


def encode(df: DataFrame, rank_file: str, pattern: str, text: str = "text", keep: Sequence[str] = ("doc_id",),
           with_ids: bool = True) -> DataFrame:
    """``keep`` plus n_tokens, ids (binary, little-endian unsigned 32-bit),
    ids_sha256 and decoded_sha256, one row per row.

    A null text counts as empty: no ids, digests of the empty string.  Repeated
    rows are encoded each; an empty table gives an empty one; columns not in
    ``keep`` go, and kept ones may have any name that is not an output's.
    ``rank_file`` must exist on every executor.  Without ``with_ids`` the ids
    stay behind, where only counts and digests are wanted.
    """
    fields = [df.schema[c] for c in keep]
    added = [T.StructField("n_tokens", T.LongType()), *([T.StructField("ids", T.BinaryType())] if with_ids else []),
             T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(rank_file, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                n, raw, d1, d2 = [], [], [], []
                for x in part.column(0):
                    ids = codec.encode(x.as_py() or "")
                    b = ids.tobytes()
                    n.append(len(ids))
                    raw.append(b)
                    d1.append(hashlib.sha256(b).hexdigest())
                    d2.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                new = [pa.array(n, pa.int64()), *([pa.array(raw, pa.binary())] if with_ids else []),
                       pa.array(d1, pa.string()), pa.array(d2, pa.string())]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], *new], names=[*(f"_{i}" for i in range(len(fields))), *(f.name for f in added)])

    put = [F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep)]
    schema = T.StructType([*(T.StructField(f"_{i}", f.dataType) for i, f in enumerate(fields)), *added])
    out = df.select(F.col(f"`{text}`").alias("_text"), *put).mapInArrow(run, schema)
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], *[f.name for f in added])


def decode(df: DataFrame, rank_file: str, pattern: str, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """Adds the raw bytes of each row's ids; null ids give empty bytes."""
    def raw(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = Codec(rank_file, pattern)
        for s in batches:
            yield s.map(lambda b: codec.decode(np.frombuffer(b or b"", "<u4")))

    return df.withColumn(out, F.pandas_udf(raw, "binary")(F.coalesce(F.col(ids), F.lit(b""))))
