"""Shared expressions on text: words, lines, ASCII case."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The white space that separates words, everywhere in this package.
SPACE = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"


def whole(text: str | Column) -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def words(text: Column) -> Column:
    """Maximal runs of other characters; an empty array if there are none."""
    t = trimmed(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACES))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def numbered(df: DataFrame, group: Sequence[str], bucket: str, order: Sequence[Column],
             name: str = "slot") -> DataFrame:
    """A gapless number from 0 within each group, in order of (bucket, order).

    ``bucket`` splits a group into parts that one task can sort.  Only the
    counts of the buckets are added up group by group; rows are never brought
    together by group.
    """
    return running(df.withColumn("_one", F.lit(1).cast("long")), group, bucket, order, "_one", name).drop("_one")


def running(df: DataFrame, group: Sequence[str], bucket: str, order: Sequence[Column], value: str,
            name: str) -> DataFrame:
    """Sum of ``value`` over the group's earlier rows, in order of (bucket, order).
    Null groups are a group of their own."""
    keys = [*group, bucket]
    sums = df.groupBy(*keys).agg(F.sum(value).alias("_in"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                         F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_from"))
    met = F.lit(True)
    for i, k in enumerate(keys):
        met = met & df[k].eqNullSafe(F.col(f"_k{i}"))
    inner = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    at = (F.col("_from") + F.coalesce(F.sum(value).over(inner), F.lit(0))).cast("long")
    return df.join(starts, met).withColumn(name, at).select(*df.columns, name)
