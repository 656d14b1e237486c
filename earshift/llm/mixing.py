"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents form a stream in shuffled order, repeated as often as
its target asks for and cut into blocks of equal numbers of words.  Slots of the
schedule are golden-ratio points mapped through the cumulative targets to a
source; the k-th slot of a source takes its k-th block, and what has no slot is
not taken.  So every stretch of the mix holds the sources in their proportions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialise, work_dir
from .text import n_words, numbered, running, whole

#: The schedule's line has 2**62 places, and its points step by that over the golden
#: ratio: 10**11 blocks, as 100 TB have, still get stretches of many places each.
BITS = 62
GOLDEN = 2850178704830799621
CELL_BITS = 16
BLOCK_WORDS = 256
ROWS_PER_PART = 100_000
#: A partition of the mixed table holds at most so many words, and not less than so
#: many for the sake of the session's number of shuffle partitions.
MOST_WORDS, LEAST_WORDS = 1 << 24, 1 << 16


def targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Sources (source, source_size) with ``rank`` by code point, null last, and
    ``target``: weights repeat over the ranks and share ``share`` times all
    sizes; no target exceeds ``most`` times its source, the excess is shared
    again by weight.  Runs on one row per source."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.select("source", "source_size", "rank", F.get(w, F.col("rank") % len(weights)).alias("w"),
                           (F.col("source_size") * F.lit(most)).alias("cap"))
    # the water level at which the caps, met in the order of cap per weight, and
    # the weights of the rest hold the total
    by_level = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    upto = by_level.rowsBetween(Window.unboundedPreceding, 0)
    seen = ranked.select(
        "source", "source_size", "rank", "w", "cap", (F.col("cap") / F.col("w")).alias("level"),
        (F.sum("cap").over(upto) - F.col("cap")).alias("full"),
        (F.sum("w").over(Window.partitionBy()) - F.sum("w").over(upto) + F.col("w")).alias("open_w"),
        (F.sum("source_size").over(Window.partitionBy()) * F.lit(share)).alias("total"))
    met = (F.col("full") + F.col("level") * F.col("open_w")) >= F.col("total")
    level = F.min(F.when(met, F.struct("level", "rank", ((F.col("total") - F.col("full")) / F.col("open_w")).alias("at")))).over(
        Window.partitionBy())["at"]
    return seen.withColumn("at", level).select(
        "source", "source_size", "rank", F.least(F.col("cap"), F.coalesce(F.col("at") * F.col("w"), F.col("cap"))).alias("target"))


def goal() -> Column:
    return F.floor(F.col("target") + 0.5)


def point(i: Column, bits: int = BITS) -> Column:
    """Place of point ``i``: i times the step, modulo 2**bits (an even number), by
    halves so that no product leaves a long."""
    half = bits // 2
    low = (1 << half) - 1
    step = GOLDEN >> (BITS - bits)
    i1, i0 = F.shiftright(i, half).bitwiseAND(F.lit(low)), i.bitwiseAND(F.lit(low))
    cross = (i1 * (step & low)).bitwiseAND(F.lit(low)) + (i0 * (step >> half)).bitwiseAND(F.lit(low))
    return (i0 * (step & low) + F.shiftleft(cross.bitwiseAND(F.lit(low)), half)).bitwiseAND(F.lit((1 << bits) - 1))


def slots(sources: DataFrame, block: int, bits: int = BITS) -> DataFrame:
    """(rank, k, slot): the schedule, a slot for every block of every source.
    ``sources`` must be a small written table.

    A source's stretch of the line is its share of the blocks.  The first 3 n
    golden-ratio points leave no gap of 1 / n, so every block of n finds its point
    among them; points beyond a source's last block are passed over.
    """
    upto = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    s = sources.where(goal() > 0).select("rank", F.ceil(goal() / block).alias("blocks"))
    s = s.select("rank", "blocks", F.sum("blocks").over(upto).alias("hi"), F.sum("blocks").over(Window.partitionBy()).alias("all"))
    scale = lambda c: F.floor(c / F.col("all") * F.lit(float(1 << bits)))
    line = s.select("rank", "blocks", scale(F.col("hi") - F.col("blocks")).alias("lo"), scale(F.col("hi")).alias("hi"))
    n = line.agg(F.sum("blocks")).first()[0] or 0
    if 8 * n > 1 << bits:
        raise ValueError("more blocks than the line has places for")
    cells = line.select("*", F.explode(F.sequence(
        F.shiftright("lo", bits - CELL_BITS), F.shiftright(F.col("hi") - 1, bits - CELL_BITS))).alias("cell"))
    points = sources.sparkSession.range(3 * n).select(F.col("id").alias("slot"), point(F.col("id"), bits).alias("u"))
    hit = points.join(cells, F.shiftright("u", bits - CELL_BITS) == F.col("cell")).where(
        (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("slot", "rank", "blocks")
    hit = numbered(hit.withColumn("_part", F.floor(F.col("slot") / 65536)), ["rank"], "_part", [F.col("slot")], "k")
    return hit.where("k < blocks").select("rank", "k", "slot")


def shuffled(light: DataFrame, sources: DataFrame, rows: int) -> DataFrame:
    """Rows with ``start``: words of their source before them, in shuffled order."""
    s = sources.select(F.col("source").alias("_s"), "source_size", "rank", "target")
    j = light.join(s, light["source"].eqNullSafe(F.col("_s"))).drop("_s")
    digits = max(1, math.ceil(math.log(max(1, rows / ROWS_PER_PART), 16)))
    j = j.withColumn("_h", F.md5(F.concat_ws(":", F.lit("mix"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    j = j.withColumn("_part", F.substring("_h", 1, digits))
    order = [F.col("_h"), F.col("doc_id").asc_nulls_first(), F.col("size"), F.col("uid")]
    return running(j, ["rank"], "_part", order, "size", "start").drop("_h", "_part")


def mix(light: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
        block: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """Rows (uid, doc_id, source, size) of a written table to (rows, takes).

    rows: the same with source_size, target and taken, the words that the mix
    takes, first_slot and n_slots, the slots that take of it (0 and null if none).
    takes: uid, epoch, slot, lo, to_word, size: the mix itself, a row for each
    document as often as it is taken, at its first slot.  It stands in the order of
    (slot, lo), lo being a document's place in its source's stream.  A source's
    blocks add up to its rounded target.
    """
    spark, base = light.sparkSession, work_dir(light.sparkSession)
    sizes = light.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = materialise(targets(sizes, weights, share, most), "sources", base)
    placed = materialise(shuffled(light, sources, light.count()), "placed", base)
    epochs = F.explode(F.sequence(F.lit(0), F.lit(max(1, math.ceil(most)) - 1))).alias("epoch")
    spans = placed.where("size > 0").select("uid", "rank", "size", "start", "source_size", goal().alias("goal"), epochs)
    at = F.col("start") + F.col("epoch") * F.col("source_size")
    spans = spans.select("uid", "rank", "epoch", "size", at.alias("lo"), F.least(at + F.col("size"), F.col("goal")).alias("hi")).where("lo < hi")
    # a word range meets each block in one piece
    piece = spans.select("*", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))).alias("k"))
    piece = piece.select("uid", "rank", "epoch", "size", "lo", "k", (F.greatest(F.col("lo"), F.col("k") * block) - F.col("lo")).alias("from_word"),
                         (F.least(F.col("hi"), (F.col("k") + 1) * block) - F.col("lo")).alias("to_word"))
    sched = slots(sources, block).select(F.col("rank").alias("_r"), F.col("k").alias("_k"), "slot")
    met = piece.join(sched, (F.col("rank") == F.col("_r")) & (F.col("k") == F.col("_k")))
    takes = materialise(met.groupBy("uid", "epoch").agg(
        F.min("slot").alias("slot"), F.count(F.lit(1)).alias("n_slots"), F.first("lo").alias("lo"), F.max("to_word").alias("to_word"),
        F.sum(F.col("to_word") - F.col("from_word")).alias("words"), F.first("size").alias("size")), "takes", base)
    taken = takes.groupBy(F.col("uid").alias("_u")).agg(
        F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.sum("n_slots").alias("n_slots"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    rows = placed.join(taken, F.col("uid") == F.col("_u"), "left").select(
        "uid", "doc_id", "source", "size", "source_size", "target", zero("taken"), "first_slot", zero("n_slots"))
    return rows, takes


def light_rows(df: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    return df.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{doc_id}`").alias("doc_id"),
                     F.col(f"`{source}`").alias("source"), n_words(whole(F.col(f"`{text}`"))).alias("size"))


def mix_documents(df: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
                  text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot and n_slots for each row.

    Null texts and texts without words have size 0 and are never taken; null
    sources are one source, ranked last; null and repeated ids are rows like any
    other.  An empty table gives an empty one; further columns are ignored.
    """
    light = materialise(light_rows(df, text, doc_id, source), "light", work_dir(df.sparkSession))
    return mix(light, weights, share, most)[0].select(
        "doc_id", "size", "source_size", "target", "taken", "first_slot", "n_slots")


def row_ids(df: DataFrame, base: str) -> DataFrame:
    """The rows as (row, uid).  A Parquet table's rows are numbered by file and place
    in the file, so that each reading gives the same numbers; anything else is
    written first."""
    try:
        files = df.select(F.col("_metadata.file_path").alias("_f"), F.col("_metadata.row_index").alias("_i"))
    except AnalysisException:
        return materialise(df.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("uid")), "rows", base)
    number = F.row_number().over(Window.orderBy("_f")).cast("long")  # one row per file
    listed = materialise(files.select("_f").distinct().select("_f", number.alias("_n")), "files", base)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col("_metadata.file_path").alias("_p"), F.col("_metadata.row_index").alias("_i"))
    return rows.join(listed, F.col("_p") == F.col("_f")).select("row", (F.shiftleft("_n", 40) + F.col("_i")).alias("uid"))


def mixed_table(df: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
                block: int = BLOCK_WORDS) -> DataFrame:
    """The mix as rows of ``df``: a document stands as often as it is taken, and
    where its source's target ends within it, its first words that are taken
    (with n_chars, if there is such a column, counted again).

    Rows stand in the order of the schedule, each document at the first slot that
    takes of it: partitions are stretches of the mix, and so the files written from
    them in the order of their names, rows by slot within.  Which partition a row
    goes to is settled on light rows, by the words before it; the texts are
    shuffled to their numbers, and once more in the order of the mix."""
    spark = df.sparkSession
    base = work_dir(spark)
    kept = row_ids(df, base)
    text = F.col("row.text")
    light = kept.select("uid", "row.doc_id", "row.source", n_words(whole(text)).alias("size"))
    _, takes = mix(materialise(light, "light", base), weights, share, most, block)
    total = takes.agg(F.sum("to_word")).first()[0] or 0
    parts = max(1, math.ceil(total / MOST_WORDS), min(math.ceil(total / LEAST_WORDS), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    order = [F.col("slot"), F.col("lo")]
    placed = running(takes.withColumn("_part", F.floor(F.col("slot") / 65536)), [], "_part", order, "to_word", "_before")
    part = F.floor(F.col("_before") * parts / F.lit(max(1, total))).cast("int")
    placed = materialise(placed.select(F.col("uid").alias("_u"), "to_word", "size", "slot", "lo", part.alias("part")), "placed_takes", base)
    out = kept.join(placed, F.col("uid") == F.col("_u"))
    # pieces are words with the white space before them
    pieces_of = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    cut = F.when(F.col("to_word") >= F.col("size"), text).otherwise(
        F.array_join(F.slice(pieces_of, F.lit(1), F.col("to_word").cast("int")), ""))
    row = F.col("row").withField("text", cut)
    if "n_chars" in df.columns:
        row = row.withField("n_chars", F.length(cut).cast(df.schema["n_chars"].dataType))
    dealt = out.select(row.alias("row"), "slot", "lo", "part").repartitionById(parts, F.col("part"))
    return dealt.sortWithinPartitions("slot", "lo").select("row.*")
