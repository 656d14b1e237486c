"""Small DataFrame helpers shared by the operators.

``by`` is a list of listener key columns.  Empty means one listener.  Listener
keys are expected to be non-null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def null_if_zero(c: Column) -> Column:
    return F.when(c != 0, c)


def ratio(num: Column, den: Column) -> Column:
    """Division that gives NULL for a zero denominator (ANSI mode raises)."""
    return num / null_if_zero(den)


def shared_keys(df: DataFrame, by: Sequence[str], *cols: str) -> list[str]:
    """Join keys: ``cols`` plus the listener keys that ``df`` also carries."""
    return [b for b in by if b in df.columns] + list(cols)


def with_group_value(
    df: DataFrame, source: DataFrame, by: Sequence[str], value: Column, name: str
) -> DataFrame:
    """Attach one aggregate of ``source`` to every row of ``df``.

    Without listener keys this is a scalar subquery, which Spark runs once and
    can push into the scan; with them it is an equi-join on the keys.
    """
    if not by:
        return df.withColumn(name, source.agg(value.alias(name)).scalar())
    return df.join(source.groupBy(*by).agg(value.alias(name)), list(by))


def trailing_months(
    df: DataFrame, months: int, by: Sequence[str] = (), month: str = "month"
) -> DataFrame:
    """Rows within ``months`` calendar months of the newest month, inclusive."""
    dated = with_group_value(df, df, by, F.max(month), "_newest")
    return dated.where(F.col(month) >= F.add_months("_newest", -months)).drop("_newest")


def first_per_key(
    df: DataFrame, key: Sequence[str], order: Sequence[Column], last: bool = False
) -> DataFrame:
    """One row per key, the lowest (or highest) in ``order``.

    Runs as an aggregate, so copies are folded on the map side and a key that
    holds a large part of the rows never lands in one task.  Add enough columns
    to ``order`` to make it total, or the survivor is arbitrary.
    """
    rest = [c for c in df.columns if c not in key]
    pick = F.max_by if last else F.min_by
    row = pick(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*key).agg(row).select(*key, "_row.*").select(*df.columns)


def top_k(
    df: DataFrame, key: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None
) -> DataFrame:
    """At most ``k`` rows per key.  Spark prunes each map task to ``k`` rows first."""
    w = Window.partitionBy(*key).orderBy(*order)
    out = df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k)
    return out.withColumnRenamed("_rank", rank) if rank else out.drop("_rank")


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})
