"""Polled plays against exports, as one stream.

State: per listener, the time of its last export row, and the polled rows after
it.  An export row moves the time on and takes the rows up to it back; a polled
row is kept if it is later, once per (ts, track).  Output is a change log, so a
batch writes what it changes and nothing stored is written again.

A listener's rows are dealt over ``salts`` parts, so that one busy listener
isn't one task; every part hears the listener's export times, of which each
task passes on one per batch of rows.  Parts of many listeners share a state, of
which there are ``buckets`` at most, and are handled together.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .live import instant

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEPT, SUPERSEDED = "kept", "superseded"


def micros(ts: str):
    return F.unix_micros(instant(ts))


def _packed(frame: pd.DataFrame) -> bytes | None:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(frame, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(parts: list[bytes]) -> pd.DataFrame | None:
    return pd.concat([pa.ipc.open_stream(p).read_pandas() for p in parts], ignore_index=True) if parts else None


class Reconcile(StatefulProcessor):
    """Rows of one bucket of listeners: the listener keys, salt, at (microseconds; null
    in no row), track_uri, body (the other columns as JSON; null in an export's row).

    The state is a list of packed tables, to which a batch adds one of its changes;
    they are packed into one after some batches.  So a state call moves a table, not a row.
    """

    MOST = 16  # packed tables in a state

    def __init__(self, keys: Sequence[str]):
        self.keys = list(keys)
        self.part = [*self.keys, "salt"]
        self.row = [*self.part, "at", "track_uri"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.steps = handle.getValueState("steps", "n bigint")
        self.cutoffs = handle.getListState("cutoffs", "packed binary")
        self.rows = handle.getListState("rows", "packed binary")

    def _held(self, state, order: list[str]) -> tuple[pd.DataFrame | None, int]:
        """The newest row per key, and how many tables hold it."""
        parts = [p[0] for p in state.get()] if state.exists() else []
        held = _unpacked(parts)
        return (held if held is None else held.drop_duplicates(order, keep="last"), len(parts))

    def _keep(self, state, changes: pd.DataFrame, held: pd.DataFrame | None, parts: int, order: list[str]) -> pd.DataFrame:
        """What is held now; the state gets the changes, or all in one where it has many tables."""
        now = changes if held is None else pd.concat([held, changes], ignore_index=True).drop_duplicates(order, keep="last")
        if "body" in now:
            now = now[now["body"].notna()]
        if parts < self.MOST:
            state.appendValue((_packed(changes),))
        else:
            state.put([(_packed(now),)])
        return now

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = self.steps.get()
        step = first_step = 0 if found is None else found[0]
        cutoffs, n_cutoffs = self._held(self.cutoffs, self.part)
        held, n_held = self._held(self.rows, self.row)
        if held is not None:
            held = held[held["body"].notna()]
        for part in rows:
            part = part[[*self.row, "body"]].assign(track_uri=part["track_uri"].fillna(""))
            export = part["body"].isna()
            out = []
            if export.any():
                last = part[export].groupby(self.part, as_index=False, dropna=False)["at"].max()
                if cutoffs is not None:
                    was = last[self.part].merge(cutoffs, on=self.part, how="left")["at"]
                    last = last[(was.isna() | (last["at"].to_numpy() > was.fillna(0).to_numpy())).to_numpy()]
                if len(last):
                    cutoffs = self._keep(self.cutoffs, last, cutoffs, n_cutoffs, self.part)
                    n_cutoffs = n_cutoffs + 1 if n_cutoffs < self.MOST else 1
                    if held is not None and len(held):
                        cut = held[self.part].merge(last, on=self.part, how="left")["at"].to_numpy()
                        gone = held[held["at"].to_numpy() <= cut].assign(body=None)
                        out.append(gone.assign(state=SUPERSEDED))
            polled = part[~export]
            if cutoffs is not None and len(polled):
                cut = polled[self.part].merge(cutoffs, on=self.part, how="left")["at"].to_numpy()
                polled = polled[~(polled["at"].to_numpy() <= cut)]
            if len(polled):
                best = polled.groupby(self.row, as_index=False, sort=True, dropna=False)["body"].min()
                if held is not None and len(held):
                    was = best[self.row].merge(held, on=self.row, how="left")["body"]
                    best = best[(was.isna() | (best["body"].to_numpy() < was.fillna("").to_numpy())).to_numpy()]
                out.append(best.assign(state=KEPT))
            out = [o for o in out if len(o)]
            if out:
                moved = pd.concat(out, ignore_index=True)
                held = self._keep(self.rows, moved[[*self.row, "body"]], held, n_held, self.row)
                n_held = n_held + 1 if n_held < self.MOST else 1
                n = len(moved)
                moved["track_uri"] = moved["track_uri"].where(moved["track_uri"] != "", None)
                yield moved[[*self.keys, "at", "track_uri", "body", "state"]].assign(step=range(step, step + n))
                step += n
        if step != first_step:
            self.steps.update((step,))

    def close(self) -> None:
        pass


def last_exports(export: DataFrame, by: Sequence[str], ts: str, salts: int) -> DataFrame:
    """One row per task, batch and listener with its last export time, for every salt."""
    keys = [f"k{i}" for i in range(len(by))]

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p.groupby(keys, as_index=False)["at"].max() if keys else p[["at"]].max().to_frame().T.dropna().astype("int64")

    rows = export.where(F.col(ts).isNotNull()).select(*[F.col(b).alias(k) for b, k in zip(by, keys)], micros(ts).alias("at"))
    few = rows.mapInPandas(fold, rows.schema)
    return few.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "at",
                      F.lit(None).cast("string").alias("track_uri"), F.lit(None).cast("string").alias("body"))


def supersede_changes(export: DataFrame, polled: DataFrame, by: Sequence[str] = (), ts: str = "ts", salts: int = 8,
                      buckets: int = 1024) -> DataFrame:
    """Changes (listener keys, ts, track_uri, the other polled columns, state,
    step) of the stored polled rows; the newest per (listener, ts, track) holds.

    Both inputs may be streams, in any order and mixed.  Polled rows without a
    time are left out: no export can be compared with them.  Of rows with equal
    time and track the one with the lowest other columns stays, as JSON text.  An
    empty string counts as no track.
    """
    rest = [f for f in polled.schema.fields if f.name not in (*by, ts, "track_uri")]
    keys = [f"k{i}" for i in range(len(by))]
    salt = F.pmod(F.xxhash64(ts, "track_uri"), F.lit(salts)).cast("int")
    rows = polled.where(F.col(ts).isNotNull()).select(
        *[F.col(b).alias(k) for b, k in zip(by, keys)], salt.alias("salt"), micros(ts).alias("at"), "track_uri",
        F.to_json(F.struct(*[f.name for f in rest]) if rest else F.struct(F.lit(1).alias("_"))).alias("body"))
    both = rows.unionByName(last_exports(export, by, ts, salts))
    both = both.withColumn("bucket", F.pmod(F.xxhash64(*keys, "salt"), F.lit(buckets)).cast("int"))
    out = T.StructType([*[T.StructField(k, polled.schema[b].dataType) for b, k in zip(by, keys)],
                        T.StructField("at", T.LongType()), T.StructField("track_uri", T.StringType()), T.StructField("body", T.StringType()),
                        T.StructField("state", T.StringType()), T.StructField("step", T.LongType())])
    moved = both.groupBy("bucket").transformWithStateInPandas(Reconcile(keys), out, "Update", "None")
    body = F.from_json("body", T.StructType(rest)) if rest else None
    return moved.select(*[F.col(k).alias(b) for b, k in zip(by, keys)], utc_wall_micros("at").alias(ts), "track_uri",
                        *([body[f.name].alias(f.name) for f in rest] if rest else []), "state", "step")


def utc_wall_micros(at: str):
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.timestamp_micros(at).cast("timestamp_ntz"))


