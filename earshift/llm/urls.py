"""URL filter by a character language-model ratio.

Rules decide what they cover.  URLs that they allow and URLs that they block
train one model each: a Markov model over characters whose order varies from 0
to 3, each order blended with the next shorter one by how often its context was
followed by something new (Witten-Bell).  A URL without a rule is allowed if its
log-likelihood difference, divided by its length, reaches a threshold.  The
threshold separates the rules' URLs best when each is scored by the other half.

Counting is an aggregate over distinct four-grams, scoring a join with one row
per three signs that holds what may follow them: the alphabet has 34 signs, so
that table has 39,304 rows at most while its counts grow with the input.  Such
tables are broadcast.  Joins of tables with a row per URL never are: they compress
so well that Spark takes millions of URLs, or all their signs, for a few MB.  Log
ratios are rounded to millionths and added as integers, so results don't depend
on the order of addition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialise, work_dir
from .text import lower_ascii

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"),
         ("net/fr/", "block"))
ORDER, SIGNS, PAD = 3, 34, "^"
MICRO, BIN, BINS = 1_000_000, 10_000, 500
#: Counts of the two classes, of all rows and without either fold.
PARTS = tuple((c, f) for c in ("a", "r") for f in ("all", "not0", "not1"))


def after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """Longest rule that fits, and its verdict; null if none does."""
    name = verdict = F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(slash + p))
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def signs(url: Column) -> Column:
    """What the models read: the URL after its scheme, lower-cased, digits as 0,
    other signs than a-z . / - _ ? as ~, after three pads."""
    t = F.coalesce(F.when(F.locate("://", url) > 0, after_scheme(url)).otherwise(url), F.lit(""))
    t = F.regexp_replace(F.regexp_replace(lower_ascii(t), "[0-9]", "0"), r"[^a-z0./\-_?]", "~")
    return F.concat(F.lit(PAD * ORDER), t)


def grams(urls: DataFrame, *keep: str) -> DataFrame:
    """A row for each sign of a URL, with the three before it."""
    n = F.length("signs") - ORDER
    spots = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return urls.select(*keep, "signs", F.explode(spots).alias("at")).select(*keep, F.substr("signs", F.col("at"), F.lit(ORDER + 1)).alias("gram"))


def model(urls: DataFrame, base: str) -> DataFrame:
    """gram, llr_all, llr_not0, llr_not1 (in millionths) for each four-gram of
    ``urls`` (signs, weight, verdict, fold).  What is joined has 34 ** 3 rows at
    most; the counts of the longest order are the four-grams' own."""
    put = []
    for c, f in PARTS:
        on = F.col("verdict") == ("allow" if c == "a" else "block")
        if f != "all":
            on = on & (F.col("fold") != int(f[-1]))
        put.append(F.sum(F.when(on, F.col("weight")).otherwise(0)).alias(f"{c}_{f}"))
    g = materialise(grams(urls, "weight", "verdict", "fold").groupBy("gram").agg(*put), "grams", base)
    counts = [f"{c}_{f}" for c, f in PARTS]
    out = g.select("gram", *counts, *[F.lit(1.0 / SIGNS).alias(f"p_{c}_{f}") for c, f in PARTS])
    for k in range(ORDER + 1):
        tail = F.substr("gram", F.lit(ORDER + 1 - k), F.lit(k + 1))
        n = g.groupBy(tail.alias("_g")).agg(*[F.sum(f"{c}_{f}").alias(f"n_{c}_{f}") for c, f in PARTS])
        ctx = n.groupBy(F.substr("_g", F.lit(1), F.lit(k)).alias("_c")).agg(
            *[F.sum(f"n_{c}_{f}").alias(f"s_{c}_{f}") for c, f in PARTS],
            *[F.count(F.when(F.col(f"n_{c}_{f}") > 0, 1)).alias(f"t_{c}_{f}") for c, f in PARTS])
        out = out.join(n.hint("broadcast"), tail == F.col("_g")) if k < ORDER else out.select("*", *[F.col(x).alias(f"n_{x}") for x in counts])
        out = out.join(ctx.hint("broadcast"), F.substr("gram", F.lit(ORDER + 1 - k), F.lit(k)) == F.col("_c"))

        def blended(x: str) -> Column:
            seen = F.col(f"s_{x}") + F.col(f"t_{x}")
            return F.when(seen > 0, (F.col(f"n_{x}") + F.col(f"t_{x}") * F.col(f"p_{x}")) / seen.cast("double")).otherwise(F.col(f"p_{x}"))

        out = out.select("gram", *counts, *[blended(f"{c}_{f}").alias(f"p_{c}_{f}") for c, f in PARTS])
    return out.select("gram", *[F.round((F.log(f"p_a_{f}") - F.log(f"p_r_{f}")) * MICRO).cast("long").alias(f"llr_{f}")
                                for f in ("all", "not0", "not1")])


def followers(m: DataFrame) -> DataFrame:
    """``model`` with a row for each three signs: _c, and for each log ratio a map
    from the ASCII code of the sign after them."""
    sign = F.ascii(F.substr("gram", F.lit(ORDER + 1), F.lit(1)))
    return m.groupBy(F.substr("gram", F.lit(1), F.lit(ORDER)).alias("_c")).agg(
        *[F.map_from_entries(F.collect_list(F.struct(sign, x))).alias(x) for x in m.columns if x != "gram"])


def judge(df: DataFrame, url: str = "url", keep: Sequence[str] = ("page_id",), rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """``keep``, host, path, rule, verdict and score, one row per row.

    A null URL, or one without ``://``, has an empty host and path and meets no
    rule; the models read a URL without a scheme whole and score an empty one 0.
    Without URLs of both kinds to learn from, all others are allowed.  Repeated
    rows count as often as they stand there; an empty table gives an empty one;
    columns not in ``keep`` go.
    """
    base = work_dir(df.sparkSession)
    rows = df.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep)], F.col(f"`{url}`").alias("url"))
    u = F.col("url")
    urls = rows.groupBy("url").agg(F.count(F.lit(1)).alias("weight")).select(
        "url", "weight", host_of(u).alias("host"), path_of(u).alias("path"), signs(u).alias("signs"),
        (F.ascii(F.substring(F.md5(F.coalesce(u, F.lit(""))), 1, 1)) % 2).alias("fold"))
    name, says = ruled(F.col("host"), F.col("path"), rules)
    urls = materialise(urls.select("*", name.alias("rule"), says.alias("verdict")), "urls", base)
    spots = grams(urls, "url", "fold")
    sign = F.ascii(F.substr("gram", F.lit(ORDER + 1), F.lit(1)))
    held_out = F.when(F.col("fold") == 0, F.col("llr_not0")).otherwise(F.col("llr_not1"))
    sums = spots.join(followers(model(urls, base)).hint("broadcast"), F.substr("gram", F.lit(1), F.lit(ORDER)) == F.col("_c")).groupBy("url").agg(
        F.sum(F.element_at("llr_all", sign)).alias("llr"), F.sum(F.element_at(held_out, sign)).alias("held"),
        F.count(F.lit(1)).alias("n")).withColumnRenamed("url", "_u")
    per_sign = lambda c: F.coalesce(F.floor(F.col(c) / F.col("n") / BIN), F.lit(0))
    scored = urls.join(sums.hint("merge"), u.eqNullSafe(F.col("_u")), "left").select(
        "url", "weight", "host", "path", "rule", "verdict", per_sign("llr").alias("bin"), per_sign("held").alias("held_bin"),
        (F.col("llr") / F.col("n") / MICRO).alias("score"))
    scored = materialise(scored, "scored", base)
    cut = threshold(scored)
    judged = scored.select(F.col("url").alias("_u"), "host", "path", "rule", F.coalesce(
        "verdict", F.when(F.col("bin") >= F.coalesce(cut.scalar(), F.lit(-BINS - 1)), "allow").otherwise("block")).alias("verdict"), "score")
    return rows.join(judged.hint("merge"), u.eqNullSafe(F.col("_u"))).select(
        *[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], "host", "path", "rule", "verdict", "score")


def threshold(scored: DataFrame) -> DataFrame:
    """One row: the bin from which on a score allows, where the shares of allowed
    URLs at or above it and of blocked ones below add up highest; null without
    URLs of both kinds.  At most ``2 * BINS + 1`` bins are compared."""
    clipped = F.greatest(F.lit(-BINS), F.least(F.lit(BINS), F.col("held_bin")))
    bins = scored.where("verdict is not null").groupBy(clipped.alias("bin")).agg(
        F.sum(F.when(F.col("verdict") == "allow", F.col("weight")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("verdict") == "block", F.col("weight")).otherwise(0)).alias("r"))
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    cut = bins.select(
        "bin", (F.sum("a").over(every) - F.coalesce(F.sum("a").over(below), F.lit(0))).alias("kept"), F.coalesce(F.sum("r").over(below), F.lit(0)).alias("out"),
        F.sum("a").over(every).alias("na"), F.sum("r").over(every).alias("nr"))
    gain = F.col("kept") * F.col("nr") + F.col("out") * F.col("na")  # both shares over na * nr
    return cut.where("na > 0 and nr > 0").agg(F.max_by("bin", F.struct(gain, -F.col("bin"))).alias("cut"))
