"""Exact dedup by distributed MSD radix partitioning.

Documents are split by their first bytes, each group by its next bytes, and so
on, until a group holds one document or its documents have ended.  Two texts are
equal if they were never split; no digest decides.  The stretch that a round
reads grows fourfold, so the number of rounds is the logarithm of the longest
text that has a partner.

A round counts (group, next bytes) with partial sums on the map side, so a
group of copies leaves each task as one row, and joins the counts back; adaptive
execution splits a large group in that join.  Only documents of open groups go
into the next round, with the rest of their text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialise, work_dir
from .text import lower_ascii, whole

#: Bytes read in the first round, and the factor between rounds.
FIRST, GROWTH = 64, 4


def partition(df: DataFrame, text: str = "text", doc_id: str = "doc_id", first: int = FIRST,
              growth: int = GROWTH, uid: str | None = None) -> DataFrame:
    """One row per row: doc_id, keep_id, group_size, kept, text_sha256.  With
    ``uid``, a column that numbers the rows of a written table, it comes too.

    Texts are compared after lower-casing A-Z only; null counts as empty.  Of a
    group the row with the largest doc_id stays; null ids come last, and of rows
    that repeat the same id and text exactly one is kept.  An empty table gives
    an empty one; further columns are ignored and may have any name.
    """
    spark = df.sparkSession
    base = work_dir(spark)
    norm = lower_ascii(whole(F.col(f"`{text}`")))
    rows = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.sha2(norm, 256).alias("sha"),
                     F.encode(norm, "UTF-8").alias("rest"), F.lit(None).cast("long").alias("part"),
                     *([F.col(uid).alias("uid")] if uid else []))
    done, width, k = [], first, 0
    while True:
        # the next bytes, and whether the text goes on after them
        cut = rows.select(
            "*", F.substring("rest", 1, width).alias("head"), (F.length("rest") > width).alias("more"))
        counts = cut.groupBy("part", "head", "more").agg(
            F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keep_id")).where("n > 1")
        # numbered once and read from the table, so that names agree for all readers
        groups = materialise(counts.withColumn("next", F.monotonically_increasing_id()), f"groups{k}", base)
        g = groups.select(F.col("part").alias("_p"), F.col("head").alias("_h"), F.col("more").alias("_m"), "n", "keep_id", "next")
        met = F.col("part").eqNullSafe(F.col("_p")) & (F.col("head") == F.col("_h")) & (F.col("more") == F.col("_m"))
        # a merge join at every size: it splits a large group, and one broadcast
        # would have to hold every group's next bytes
        split = cut.join(g.hint("merge"), met, "left")
        goes_on = F.col("n").isNotNull() & F.col("more")
        split = split.select(
            "doc_id", "sha", F.when(goes_on, F.expr(f"substring(rest, {width + 1})")).alias("rest"),
            F.col("next").alias("part"), F.coalesce("n", F.lit(1)).alias("n"),
            F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            goes_on.alias("open"), F.lit(k).alias("round"),
            (F.monotonically_increasing_id() if k == 0 and not uid else F.col("uid")).alias("uid"))
        path = f"{base}/round{k}"
        split.write.partitionBy("open").option("compression", "zstd").parquet(path)
        written = spark.read.schema(split.schema).parquet(path)
        done.append(written.where("not open").drop("rest", "open"))
        rows = written.where("open").select("doc_id", "sha", "rest", "part", "uid")
        if rows.isEmpty():
            break
        width, k = width * growth, k + 1
    ended = done[0]
    for d in done[1:]:
        ended = ended.unionByName(d)
    # of a group's rows with the largest id, one stays
    top = ended.where((F.col("n") > 1) & F.col("doc_id").eqNullSafe(F.col("keep_id")))
    winners = top.groupBy("round", "part").agg(F.max("uid").alias("win")).select(
        F.col("round").alias("_r"), F.col("part").alias("_p"), "win")
    out = ended.where("n > 1").join(winners, (F.col("round") == F.col("_r")) & (F.col("part") == F.col("_p")), "left")
    alone = ended.where("n = 1").withColumn("win", F.col("uid"))
    both = out.select("doc_id", "keep_id", "n", "uid", "win", "sha").unionByName(
        alone.select("doc_id", "keep_id", "n", "uid", "win", "sha"))
    return both.select("doc_id", "keep_id", F.col("n").cast("long").alias("group_size"),
                       (F.col("uid") == F.col("win")).alias("kept"), F.col("sha").alias("text_sha256"),
                       *([F.col("uid").alias(uid)] if uid else []))


def keep_one(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows that stay, with their own columns."""
    rows = df.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("uid"))
    rows = materialise(rows, "rows", work_dir(df.sparkSession))
    seen = rows.select(F.col(f"row.`{text}`").alias("text"), F.col(f"row.`{doc_id}`").alias("doc_id"), "uid")
    stay = partition(seen, uid="uid").where("kept").select("uid")
    return rows.join(stay, "uid", "left_semi").select("row.*")
