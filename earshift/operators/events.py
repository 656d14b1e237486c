"""Play events: normalise, de-duplicate, filter, reconcile with polled rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import first_per_key, with_group_value
from ..params import DEFAULTS, Params
from ..schemas import CONTENT_COLUMNS, EXPORT_RENAMES, PLAYS_RAW_COLUMNS


def content_type() -> Column:
    return (
        F.when(F.col("track_uri").isNotNull(), "music")
        .when(F.col("episode_uri").isNotNull(), "podcast")
        .when(F.col("audiobook_uri").isNotNull(), "audiobook")
        .otherwise("unknown")
    )


def dedupe_events(
    events: DataFrame, content: Sequence[str] = CONTENT_COLUMNS, by: Sequence[str] = (),
    keep: str = "source_file",
) -> DataFrame:
    """One row per listening event, the one with the lowest ``keep`` column.

    All content columns are equal inside a group, so an aggregate does it and
    copies fold on the map side.  NULLs group together.
    """
    key = [*by, *[c for c in content if c in events.columns]]
    rest = [c for c in events.columns if c not in key and c != keep]
    return first_per_key(events, key, [F.col(keep), *[F.col(c) for c in rest]])


def normalise_plays(export: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Raw export rows (see ``sources.exports.read_export``) to ``plays_raw``."""
    named = export.select(
        *by,
        *[F.col(src).alias(dst) for src, dst in EXPORT_RENAMES.items()],
        "source_file",
        # '_' is a wildcard in the pattern and the whole path is tested.
        F.when(F.col("source_path").ilike("%_Video_%"), "video").otherwise("audio").alias("source_kind"),
    )
    return dedupe_events(named, by=by).select(
        *by,
        *[c for c in named.columns if c not in by],
        content_type().alias("content_type"),
        (F.col("ms_played") / 1000.0).alias("played_seconds"),
        F.trunc("ts", "month").alias("month"),
        F.lit(False).alias("ms_played_estimated"),
        F.lit(None).cast("string").alias("track_artists"),
    )


def real_listens(plays_raw: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    return plays_raw.where(
        F.col("track_uri").isNotNull() & (F.col("ms_played") >= params.min_ms_played)
    )


def dedupe_polled(polled: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per (ts, track); the survivor is the lowest in all other columns."""
    key = [*by, "ts", "track_uri"]
    return first_per_key(polled, key, [F.col(c) for c in polled.columns if c not in key])


def reconcile(plays_raw: DataFrame, polled: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The export supersedes every polled row up to its last timestamp.

    A listener without any export row keeps all polled rows.
    """
    late = polled_after_export(plays_raw, polled, by)
    rows = dedupe_polled(late, by).withColumns({
        "source_file": F.lit("api-poll"),
        "played_seconds": F.col("ms_played") / 1000.0,
        "month": F.trunc("ts", "month"),
        "ms_played_estimated": F.lit(True),
    })
    return plays_raw.unionByName(
        rows.select(*[c for c in rows.columns if c in plays_raw.columns]), allowMissingColumns=True
    )


def polled_after_export(plays_raw: DataFrame, polled: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    if by:
        cutoffs = plays_raw.groupBy(*by).agg(F.max("ts").alias("_cutoff"))
        dated = polled.join(cutoffs, list(by), "left").withColumn("_cutoff", _or_earliest(F.col("_cutoff")))
    else:
        dated = with_group_value(polled, plays_raw, (), _or_earliest(F.max("ts")), "_cutoff")
    return dated.where(F.col("ts") > F.col("_cutoff")).drop("_cutoff")


def _or_earliest(cutoff: Column) -> Column:
    """No export at all: every polled row is later."""
    return F.coalesce(cutoff, F.lit("0001-01-01 00:00:00").cast("timestamp_ntz"))


def reconcile_stats(plays_raw: DataFrame, polled: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Polled rows in total, superseded and kept (before the dedupe), and the cutoff."""
    if by:
        cutoffs = plays_raw.groupBy(*by).agg(F.max("ts").alias("cutoff"))
        dated = polled.join(cutoffs, list(by), "left")
    else:
        dated = with_group_value(polled, plays_raw, (), F.max("ts"), "cutoff")
    late = F.when(F.col("ts") > F.col("cutoff"), 1).when(F.col("cutoff").isNull(), 1).otherwise(0)
    n = F.count(F.lit(1))
    return dated.groupBy(*by).agg(
        F.max("cutoff").alias("cutoff"), n.alias("polled_total"),
        (n - F.sum(late)).alias("superseded"), F.sum(late).alias("kept"),
    )


def add_missing(df: DataFrame, **types: str) -> DataFrame:
    """Columns an older file lacks, as typed NULLs."""
    gone = {c: F.lit(None).cast(t) for c, t in types.items() if c not in df.columns}
    return df.withColumns(gone) if gone else df


__all__ = [
    "PLAYS_RAW_COLUMNS", "add_missing", "content_type", "dedupe_events", "dedupe_polled",
    "normalise_plays", "polled_after_export", "real_listens", "reconcile", "reconcile_stats",
]
