"""Quality rules: a threshold table compiled into one projection.

Every rule bounds a ratio of a text's lengths, symbols, stop words or lines.
All measures are built-in functions of the row, so a scan, a projection and
nothing else runs, whatever the size of the table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import trimmed, whole, words

SYMBOLS = "#*$%&|<>"
#: Frequent function words of four languages.
STOP_WORDS = tuple(sorted(set((
    "the of and to a in is that for it as was with be by on are this at from or an not have which "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an "
    "le la les de des et à un une du en que qui dans est pour pas au sur avec ce par il se plus "
    "el los las y una con del al lo como más su sus o"
).split())))


@dataclass(frozen=True)
class Rule:
    """``low <= measure / per <= high``; a missing bound is open.  Texts of fewer
    than ``words`` words are too short for the ratio and pass."""

    name: str
    measure: str
    per: str | None = None
    low: float | None = None
    high: float | None = None
    words: int = 0


RULES = (
    Rule("word_length", "word_chars", "n_words", 1.5, 16.0),
    Rule("symbols", "n_symbols", "n_words", None, 0.2),
    Rule("exclamations", "n_exclamations", "n_words", None, 0.5),
    Rule("stop_words", "n_stop_words", "n_words", 0.02, None, 50),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 0.75),
)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
            "n_exclamations", "n_stop_words")


def measures(df: DataFrame, text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """The columns ``keep`` and every measure, as long.

    Null texts count as empty; an empty text measures 0 throughout.  A window
    of five words counts as repeated by two 64-bit hashes of its words.  Work in
    a row is of order n log n in its words, and only texts whose first hashes
    are not all distinct are sorted.  ``keep`` columns may have any name.
    """
    put = {f"_keep{i}": F.col(f"`{c}`") for i, c in enumerate(keep)}
    rows = df.select(*[c.alias(n) for n, c in put.items()], whole(F.col(f"`{text}`")).alias("_text"))
    w = F.col("_words")
    rows = rows.select(
        *put, "_text", words(F.col("_text")).alias("_words"),
        F.filter(F.split("_text", "\n"), lambda x: trimmed(x) != "").alias("_lines"))
    five = lambda i: [F.get("_codes", i + k) for k in range(5)]
    rows = rows.select("*", F.transform("_words", lambda x: F.xxhash64(x)).alias("_codes"))
    spots = F.when(F.size(w) >= 5, F.sequence(F.lit(0), F.size(w) - 5)).otherwise(F.array().cast("array<int>"))
    rows = rows.select("*", spots.alias("_spots"))
    rows = rows.select(*rows.columns, F.transform("_spots", lambda i: F.xxhash64(*five(i))).alias("_hashes"))
    twice = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    # only texts with a repeat go on to sort their windows
    windows = F.when(twice, F.sort_array(F.transform("_spots", lambda i: F.struct(
        F.xxhash64(*five(i)).alias("a"), F.xxhash64(*[F.get(w, i + k) for k in range(5)], F.lit(1)).alias("b"),
        i.alias("at"))))).otherwise(
        F.array().cast("array<struct<a:bigint,b:bigint,at:int>>"))
    rows = rows.select(*[c for c in rows.columns if c != "_hashes"], windows.alias("_windows"))
    ws = F.col("_windows")

    def same(x: Column, y: Column) -> Column:
        return F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]), F.lit(False))

    marked = F.transform(ws, lambda x, k: F.when(
        same(x, F.get(ws, k - 1)) | same(x, F.get(ws, k + 1)), x["at"]))
    rows = rows.select(*[c for c in rows.columns if c not in ("_windows", "_spots", "_codes")],
                       F.sort_array(F.array_compact(marked)).alias("_at"))
    covered = F.aggregate(
        "_at", F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(5), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"])
    text_ = F.col("_text")
    count = {
        "n_words": F.size(w), "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": F.regexp_count(text_, F.lit(f"[{SYMBOLS}]")),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": covered, "n_lines": F.size("_lines"),
        "n_exclamations": F.length(text_) - F.length(F.replace(text_, F.lit("!"), F.lit(""))),
        "n_stop_words": F.size(F.filter(w, lambda x: x.isin(*STOP_WORDS))),
    }
    # as a generator's output: a filter on a measure must not be pushed below,
    # where it would repeat the work once for every element it looks at
    found = F.struct(*[count[m].cast("long").alias(f"_m_{m}") for m in MEASURES])
    return rows.select(*[F.col(n) for n in put], F.inline(F.array(found)))


def verdict(rules: Sequence[Rule] = RULES) -> tuple[Column, Column]:
    """Whether all rules hold, and the names of those that don't; over ``_m_`` columns."""
    failed = []
    for r in rules:
        x = F.col(f"_m_{r.measure}").cast("double")
        if r.per:
            x = x / F.nullif(F.col(f"_m_{r.per}"), F.lit(0)).cast("double")
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (x < r.low)
        if r.high is not None:
            bad = bad | (x > r.high)
        bad = F.coalesce(bad, F.lit(True)) & (F.col("_m_n_words") >= r.words)
        failed.append(F.when(bad, F.lit(r.name)))
    names = F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>")
    return F.size(names) == 0, names


def base_failed() -> Column:
    return (F.col("_m_n_words") < 10) | (100 * F.col("_m_n_repeat_words") > 20 * F.col("_m_n_words"))


def judge(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",),
          rules: Sequence[Rule] = RULES) -> DataFrame:
    """``keep``, the measures, base_failed, failed_rules and kept, one row per row.

    A text without words (null, empty, white space only) has n_words 0, fails
    the base rules and every ratio, and is not kept.  Repeated rows are judged
    each; an empty table gives an empty one; columns not in ``keep`` go.
    """
    m = measures(df, text, keep)
    good, names = verdict(rules)
    return m.select(
        *[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)],
        *[F.col(f"_m_{x}").alias(x) for x in MEASURES],
        base_failed().alias("base_failed"), names.alias("failed_rules"), (good & ~base_failed()).alias("kept"))


def keep_good(df: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows whose text passes, with their own columns in their order."""
    own = list(df.columns)
    m = measures(df, text, own)
    good, _ = verdict(rules)
    return m.where(good & ~base_failed()).select(*[F.col(f"_keep{i}").alias(c) for i, c in enumerate(own)])
