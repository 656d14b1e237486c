"""The data behind each chart and report table, without any drawing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import top_k
from ..functions.text import percent, points, pretty
from ..operators.profiles import hours_per_tag
from ..params import DEFAULTS, Params

OTHER = "Other"


def ranked_tags(trends: DataFrame, k: int, params: Params = DEFAULTS) -> DataFrame:
    return hours_per_tag(trends, params).orderBy(F.desc("hours"), F.asc("tag")).limit(k)


def dashboard_slice(
    trends: DataFrame, low=None, high=None, min_hours: float = 10.0, params: Params = DEFAULTS,
) -> DataFrame:
    """One variant, a span of months, tags with enough hours over all time."""
    eligible = hours_per_tag(trends, params).where(F.col("hours") >= min_hours).select("tag")
    d = trends.where(F.col("variant") == params.default_variant)
    if low is not None:
        d = d.where(F.col("month") >= F.lit(low))
    if high is not None:
        d = d.where(F.col("month") <= F.lit(high))
    return d.join(eligible, "tag", "left_semi")


def stacked_bands(
    trends: DataFrame, k: int = 8, smoothed: bool = True, params: Params = DEFAULTS
) -> DataFrame:
    """Monthly share of the top tags, everything else in one band."""
    value = "smoothed_share" if smoothed else "share"
    top = ranked_tags(trends, k, params).select("tag", F.lit(True).alias("_top"))
    d = trends.where(F.col("variant") == params.default_variant).join(top, "tag", "left")
    band = F.when(F.col("_top"), F.col("tag")).otherwise(OTHER)
    return d.groupBy("month", band.alias("band")).agg(F.sum(value).alias("value"))


def trend_pivot(
    trends: DataFrame, tags: Sequence[str], smoothed: bool = True, params: Params = DEFAULTS
) -> DataFrame:
    """Month by tag table in percent.  The tag list is given, so the columns are
    fixed and no extra pass looks for them."""
    value = "smoothed_share" if smoothed else "share"
    return trends.where(F.col("variant") == params.default_variant).groupBy("month").pivot(
        "tag", list(tags)).agg(F.round(F.avg(value) * 100.0, 2))


def trajectories(trends: DataFrame, tags: Sequence[str], params: Params = DEFAULTS) -> DataFrame:
    return trends.where(
        (F.col("variant") == params.default_variant) & F.col("tag").isin(list(tags))
    ).select("tag", "month", "share", "smoothed_share")


def movers_chart(trends: DataFrame, k: int = 12, params: Params = DEFAULTS) -> DataFrame:
    """Biggest rises and falls by percentage points a year."""
    d = trends.where(
        (F.col("variant") == params.default_variant) & F.col("trend_class").isin("rising", "declining")
    ).groupBy("tag", "trend_class").agg(
        F.max("slope_pp_per_year").alias("pp"), F.max("mean_recent_share").alias("mean_recent_share")
    ).where(F.col("pp").isNotNull())
    return d.orderBy(F.abs("pp").desc(), F.asc("tag")).limit(k)


def skip_chart(skips: DataFrame, k: int = 15, min_hours: float = 20.0, lowest: bool = False) -> DataFrame:
    order = F.asc_nulls_last("skip_rate") if lowest else F.desc_nulls_last("skip_rate")
    return skips.where(F.col("hours") >= min_hours).orderBy(order, F.asc("tag")).limit(k)


def gaps_chart(gaps: DataFrame, k: int = 10) -> DataFrame:
    return gaps.orderBy(F.desc_nulls_last("gap_score"), F.asc("tag")).limit(k)


def concentration_chart(concentration: DataFrame) -> DataFrame:
    return concentration.select("year", (F.col("top_1pct_share") * 100.0).alias("pct"))


def forecast_table(fc: DataFrame, k: int = 12) -> DataFrame:
    """Forecast rows as report text."""
    top = fc.orderBy(F.desc_nulls_last("share_future"), F.asc("tag")).limit(k)
    return top.select(
        pretty(F.col("tag")).alias("genre"), percent(F.coalesce("share_now", F.lit(0.0))).alias("now"),
        percent(F.coalesce("share_future", F.lit(0.0))).alias("projected"), points(F.col("change")).alias("change"),
    )


def best_per_tag(recommendations: DataFrame, k: int = 3) -> DataFrame:
    """Top recommendations for every genre they match."""
    tagged = recommendations.withColumn("tag", F.explode(F.array_distinct("matched_genres")))
    return top_k(tagged, ["tag"], [F.desc("score"), F.asc("mbid")], k)
