"""Name and title folding, tag families, display text."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..params import ACRONYMS, DEFAULTS, Params

# Stylised characters and the letters they stand for.
STYLISED, PLAIN = "$€£@!0", "selaio"
SUFFIX_MARKS = "-–—(["  # what an edition suffix begins with
DROPPED_WORDS = r"\b(?:the|and)\b"
NOT_KEY_CHARS = r"[^a-z0-9]+"


def _unicode_fold():
    """The Arrow function for names outside ASCII.

    Built in a function and free of other names of this module, so it travels by
    value: workers need neither this package nor Spark's Python functions.  Word
    removal stays inside: Python's word boundary knows every script.
    """
    dropped, not_key = DROPPED_WORDS, NOT_KEY_CHARS

    def fold(names: pd.Series) -> pd.Series:
        if names.isna().all():
            return names

        import re
        import unicodedata

        def key(name):
            decomposed = unicodedata.normalize("NFKD", name)
            text = "".join(c for c in decomposed if not unicodedata.combining(c)).casefold()
            short = re.sub(not_key, "", re.sub(dropped, "", text))
            return short or "".join(c for c in text if c.isalnum())

        return names.map(key, na_action="ignore")

    return F.pandas_udf(fold, T.StringType())


def fold_name(name: Column) -> Column:
    """Comparison key: accents, case, punctuation and the words the/and removed.

    A name that loses everything so (another script, or dropped words alone)
    keeps its letters and digits in any script, so strangers don't share a key.
    ASCII names are folded by Spark itself.  Spark has no Unicode decomposition,
    so only the others carry a value into the Arrow function.  NULL, and names without a letter or
    digit, fold to ''.
    """
    plain, is_ascii, ascii_key = _ascii_fold(name)
    # Never NULL, so that no null check is pushed below a distinct and folds every row.
    return F.coalesce(F.when(is_ascii, ascii_key).otherwise(_unicode_fold()(F.when(~is_ascii, plain))), F.lit(""))


def _ascii_fold(name: Column) -> tuple[Column, Column, Column]:
    """The name without stylised signs, whether it is ASCII, and its key if it is.

    Patterns cost far more than plain searches, so they run on names that can match."""
    plain = F.translate(F.coalesce(name, F.lit("")), STYLISED, PLAIN)
    low = F.lower(plain)
    fewer = F.when(F.contains(low, F.lit("the")) | F.contains(low, F.lit("and")), F.regexp_replace(low, DROPPED_WORDS, "")).otherwise(low)
    short = F.regexp_replace(fewer, NOT_KEY_CHARS, "")
    ascii_key = F.when(short != "", short).otherwise(F.regexp_replace(low, NOT_KEY_CHARS, ""))
    return plain, F.octet_length(plain) == F.char_length(plain), ascii_key


def with_folded(df: DataFrame, **keys: str) -> DataFrame:
    """Add ``key=column`` folded keys, as ``fold_name`` gives them.

    Rows never pass through Python: only the distinct names outside ASCII do, and
    their keys are joined.  NULL counts as ''.
    """
    for key, column in keys.items():
        plain, is_ascii, ascii_key = _ascii_fold(F.col(f"`{column}`"))
        odd = df.where(~is_ascii).select(F.col(f"`{column}`").alias("_name")).distinct()
        odd = odd.select("_name", fold_name(F.col("_name")).alias("_key"))
        df = df.join(odd, F.col(f"`{column}`") == F.col("_name"), "left").withColumn(
            key, F.when(is_ascii, ascii_key).otherwise(F.col("_key"))).drop("_name", "_key")
    return df


def title_key(title: Column) -> Column:
    """Fold a title without its edition suffix.  A title whose head folds to
    nothing keeps the whole string, so the key does not match everything."""
    title = F.coalesce(title, F.lit(""))
    marked = F.translate(title, SUFFIX_MARKS, "") != title
    head = fold_name(F.when(marked, F.regexp_replace(title, rf"(?sU)\s+[{SUFFIX_MARKS[:-1]}\[].*\z", "")).otherwise(title))
    return F.when(head != "", head).otherwise(fold_name(title))


def any_literal(words: Sequence[str]) -> str:
    return "|".join(re.escape(w).replace(r"\ ", " ") for w in words)


def tag_family(tag: Column, params: Params = DEFAULTS) -> Column:
    """'rap', 'edm' or NULL.  Order matters, see ``Params``."""
    t = F.lower(F.trim(tag))
    return (
        F.when(t.rlike(any_literal(params.rap_patterns)), "rap")
        .when(t.rlike(any_literal(params.edm_blocklist)), None)
        .when(t.rlike(any_literal(params.edm_patterns)), "edm")
    )


def pretty(tag: Column) -> Column:
    """Tag for prose: acronyms in capitals, the rest untouched."""
    words = F.split(F.trim(F.regexp_replace(tag, r"\s+", " ")), " ")
    return F.array_join(
        F.transform(words, lambda w: F.when(w.isin(*ACRONYMS), F.upper(w)).otherwise(w)), " "
    )


def sentence(text: Column) -> Column:
    """First letter in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def percent(x: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", x * 100.0)


def points(x: Column, digits: int = 1) -> Column:
    """Signed percentage points of a share."""
    return F.format_string(f"%+.{digits}f pp", x * 100.0)
