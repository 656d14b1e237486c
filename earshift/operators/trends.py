"""Tag weights and monthly tag trends.

The play log is folded to (listener, month, track) before any join, because
both weights of the split are known per track and per artist:

* plays sharing (ts, track) divide one unit of credit, so their joint
  contribution is their mean time times the track's credit share;
* every other play contributes its own time times that share.

So the log itself is never fanned out over performers, variants or tags.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import null_if_zero, ratio, shared_keys, top_k
from ..params import DEFAULTS, Params
from ..sources.tables import materialise


def tag_weights(artist_tags: DataFrame, params: Params = DEFAULTS, by: Sequence[str] = ()) -> DataFrame:
    """Genre vector per artist: top tags by raw votes, (votes + 1) normalised.

    Ranking sees the raw count; only the weight uses the count clamped at 0.
    """
    who = shared_keys(artist_tags, by, "artist_name")
    kept = top_k(
        artist_tags.where("is_genre").select(*who, "tag", "tag_count"),
        who, [F.desc("tag_count"), F.asc("tag")], params.top_tags_per_artist,
    )
    votes = F.greatest("tag_count", F.lit(0)) + F.lit(1.0)
    return kept.select(
        *who, "tag",
        (votes / F.sum(votes).over(Window.partitionBy(*who))).alias("tag_weight"),
    )


def raw_weight(feature_weight: float) -> Column:
    return F.when(F.col("credit_type") == "album_artist", 1.0).otherwise(float(feature_weight))


def credit_shares(credits: DataFrame, params: Params = DEFAULTS, by: Sequence[str] = ()) -> DataFrame:
    """Each performer's normalised share of one play of the track, one column
    per variant (``w_<variant>``).  NULL where no performer carries weight."""
    track = shared_keys(credits, by, "track_uri")
    whole = Window.partitionBy(*track)
    return credits.select(
        *track, "artist_name",
        *[
            (raw_weight(w) / null_if_zero(F.sum(raw_weight(w)).over(whole))).alias(f"w_{v}")
            for v, w in params.variants.items()
        ],
    )


def monthly_track_time(
    plays: DataFrame, params: Params = DEFAULTS, by: Sequence[str] = ()
) -> DataFrame:
    """(listener, month, track) with the seconds to hand out."""
    cell = [*by, "month", "track_uri"]
    if params.merge_shared_timestamps:
        plays = plays.groupBy(*cell, "ts").agg(F.avg("played_seconds").alias("played_seconds"))
    return plays.groupBy(*cell).agg(F.sum("played_seconds").alias("secs"))


def artist_month(
    plays: DataFrame, credits: DataFrame, params: Params = DEFAULTS, by: Sequence[str] = (),
    how: str = "inner",
) -> DataFrame:
    """(listener, month, artist) with credited seconds per variant (``s_<variant>``)."""
    return artist_month_of(monthly_track_time(plays, params, by), credits, params, by, how)


def artist_month_of(
    time: DataFrame, credits: DataFrame, params: Params = DEFAULTS, by: Sequence[str] = (),
    how: str = "inner",
) -> DataFrame:
    """The same from ``monthly_track_time``."""
    shares = credit_shares(credits, params, by)
    return (
        time.join(shares, shared_keys(shares, by, "track_uri"), how)
        .groupBy(*by, "month", "artist_name")
        .agg(*[F.sum(F.col("secs") * F.col(f"w_{v}")).alias(f"s_{v}") for v in params.variants])
    )


def tag_month_wide(
    plays: DataFrame, credits: DataFrame, weights: DataFrame,
    params: Params = DEFAULTS, by: Sequence[str] = (), every_month: bool = False,
) -> DataFrame:
    """(listener, month, tag) with seconds per variant and distinct artists.

    Artists with weight 0 in a variant still count as artists.  The input is
    unique per artist, so counting rows counts distinct artists.  With
    ``every_month``, time that reaches no tag stays as rows with a NULL tag, so
    that no month of the log is lost.
    """
    return tag_month_of(monthly_track_time(plays, params, by), credits, weights, params, by, every_month)


def tag_month_of(
    time: DataFrame, credits: DataFrame, weights: DataFrame,
    params: Params = DEFAULTS, by: Sequence[str] = (), every_month: bool = False,
) -> DataFrame:
    """The same from ``monthly_track_time``."""
    how = "left" if every_month else "inner"
    who = shared_keys(weights, by, "artist_name")
    per_tag = weights.groupBy(*who, "tag").agg(F.sum("tag_weight").alias("tag_weight"))
    return (
        artist_month_of(time, credits, params, by, how)
        .join(per_tag, who, how)
        .groupBy(*by, "month", "tag")
        .agg(
            *[F.sum(F.col(f"s_{v}") * F.col("tag_weight")).alias(f"s_{v}") for v in params.variants],
            F.count(F.lit(1)).alias("n_artists"),
        )
    )


#: Rows of (listener, month, artist) that one task opens; with ten tags each they are sorted in memory.
LAYOUT_ROWS = 50_000


def listener_tag_month(
    plays: DataFrame, credits: DataFrame, weights: DataFrame, params: Params, by: Sequence[str],
) -> DataFrame:
    """``tag_month_wide`` with every month, a listener's rows all in one task.

    The folded log is written once, an artist's tags as a list in its row, and goes
    to its listeners as it is; the lists are opened where the rows are summed up, so
    that no row of a tag is written or moved.  Listeners without a key are left out.
    """
    who = shared_keys(weights, by, "artist_name")
    lists = weights.groupBy(*who, "tag").agg(F.sum("tag_weight").alias("tag_weight")).groupBy(*who).agg(
        F.collect_list(F.struct("tag", "tag_weight")).alias("_tags"))
    seconds = [f"s_{v}" for v in params.variants]
    known = functools.reduce(operator.and_, [F.col(b).isNotNull() for b in by])
    artists = artist_month(plays.where(known), credits, params, by, "left").join(lists, who, "left")
    rows = materialise(artists.select(*by, "month", *seconds, "_tags"), "listeners")
    tasks = max(plays.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // LAYOUT_ROWS))
    return (
        rows.repartition(tasks, *by).select(*by, "month", *seconds, F.explode_outer("_tags").alias("_t"))
        .groupBy(*by, "month", F.col("_t.tag").alias("tag"))
        .agg(*[F.sum(F.col(s) * F.col("_t.tag_weight")).alias(s) for s in seconds], F.count(F.lit(1)).alias("n_artists"))
    )


def _per_variant(params: Params) -> Column:
    return F.explode(F.array(*[
        F.struct(F.lit(v).alias("variant"), F.col(f"s_{v}").alias("tag_seconds"))
        for v in params.variants
    ])).alias("_v")


def tag_month(
    plays: DataFrame, credits: DataFrame, weights: DataFrame,
    params: Params = DEFAULTS, by: Sequence[str] = (),
) -> DataFrame:
    wide = tag_month_wide(plays, credits, weights, params, by)
    return wide.select(*by, "month", "tag", "n_artists", _per_variant(params)).select(
        *by, "_v.variant", "month", "tag", "_v.tag_seconds", "n_artists"
    )


def _grid(
    plays: DataFrame, credits: DataFrame, weights: DataFrame, params: Params, by: Sequence[str],
) -> DataFrame:
    """``tag_grid`` with ``month_seconds``, the month's tagged time per variant.

    For one listener the folded log is written once; the months, the tags and the
    cells are read from there.  Of many listeners, a listener's months meet in one
    row, bounded by the calendar and the vocabulary, each with its totals and its
    cells by tag, and are laid out from there.
    """
    totals = [f"t_{v}" for v in params.variants]
    values = [*[f"s_{v}" for v in params.variants], "n_artists"]
    tagged = F.col("tag").isNotNull() & F.col("month").isNotNull()
    sums = [F.sum(F.when(tagged, F.col(f"s_{v}"))).alias(f"t_{v}") for v in params.variants]
    if by:
        wide = listener_tag_month(plays, credits, weights, params, by)
        months = wide.groupBy(*by, "month").agg(*sums, F.collect_list(F.when(F.col("tag").isNotNull(), F.struct("tag", F.struct(*values)))).alias("_cells"))
        whole = months.groupBy(*by).agg(
            F.array_distinct(F.flatten(F.collect_list(F.transform("_cells", lambda c: c["tag"])))).alias("_tags"),
            F.transform(F.sort_array(F.collect_list(F.struct("month", *totals, "_cells"))), lambda m: F.struct(
                m["month"].alias("month"), *[m[t].alias(t) for t in totals], F.map_from_entries(m["_cells"]).alias("_cells"))).alias("_months"))
        cells = whole.select(*by, "_months", F.explode("_tags").alias("tag")).select(
            *by, "tag", F.size("_months").alias("n_months"), F.posexplode("_months").alias("_at", "_month"))
        cells = cells.select(*by, "tag", "n_months", (F.col("_at") + 1).alias("month_idx"), "_month.month", *[f"_month.{t}" for t in totals],
                             F.when(F.col("_month.month").isNotNull(), F.try_element_at("_month._cells", "tag")).alias("_cell"))
        dense = cells.select("*", *[F.col(f"_cell.{c}") for c in values])
    else:
        wide = materialise(tag_month_wide(plays, credits, weights, params, every_month=True), "wide")
        whole = Window.partitionBy()
        months = wide.groupBy("month").agg(*sums).select(
            "month", F.row_number().over(whole.orderBy("month")).alias("month_idx"), F.count(F.lit(1)).over(whole).alias("n_months"), *totals)
        wide = wide.where(F.col("tag").isNotNull())
        calendar = months.agg(F.collect_list(F.struct(*months.columns))).scalar()
        dense = wide.select("tag").distinct().select("tag", F.inline(calendar)).join(wide, ["tag", "month"], "left")
    each = F.explode(F.array(*[
        F.struct(F.lit(v).alias("variant"), F.coalesce(f"s_{v}", F.lit(0.0)).alias("tag_seconds"), F.col(f"t_{v}").alias("month_seconds"))
        for v in params.variants])).alias("_v")
    return dense.select(
        *by, "tag", "month", "month_idx", F.col("n_months").cast("int").alias("n_months"),
        F.coalesce("n_artists", F.lit(0)).alias("n_artists"), each,
    ).select(
        *by, "_v.variant", "tag", "month", "month_idx", "n_months", "_v.tag_seconds", "n_artists", "_v.month_seconds"
    )


def tag_grid(
    plays: DataFrame, credits: DataFrame, weights: DataFrame,
    params: Params = DEFAULTS, by: Sequence[str] = (),
) -> DataFrame:
    """Dense (listener, variant, tag, month): every tag of a listener in every
    month that listener played anything.  ``month_idx`` counts observed months."""
    return _grid(plays, credits, weights, params, by).drop("month_seconds")


def with_share(grid: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of the month's tagged time; NULL in a month without any."""
    month = Window.partitionBy(*by, "month", "variant")
    return grid.withColumn(
        "share", ratio(F.col("tag_seconds"), F.sum("tag_seconds").over(month))
    )


def with_smoothing(shared: DataFrame, params: Params = DEFAULTS, by: Sequence[str] = ()) -> DataFrame:
    w = Window.partitionBy(*by, "tag", "variant").orderBy("month_idx")
    return shared.withColumn(
        "smoothed_share", F.avg("share").over(w.rowsBetween(1 - params.rolling_months, 0))
    )


def with_slope(smoothed: DataFrame, params: Params = DEFAULTS, by: Sequence[str] = ()) -> DataFrame:
    """Slope and mean of the smoothed share over the last observed months."""
    series = Window.partitionBy(*by, "tag", "variant")
    recent = F.when(
        F.col("month_idx") > F.col("n_months") - params.slope_months, F.col("smoothed_share")
    )
    return smoothed.withColumns({
        "slope": F.regr_slope(recent, F.col("month_idx").cast("double")).over(series),
        "mean_recent_share": F.avg(recent).over(series),
    })


def with_trend_class(sloped: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Size is tested before direction: a tiny share moves a lot in relative terms."""
    rel = ratio(F.col("slope") * 12.0, F.col("mean_recent_share"))
    return sloped.withColumns({
        "slope_pp_per_year": F.col("slope") * 12.0 * 100.0,
        "rel_change_per_year": rel,
        "trend_class": F.when(F.col("slope").isNull() | F.col("mean_recent_share").isNull(), "flat")
        .when(F.col("mean_recent_share") < params.min_share, "negligible")
        .when(rel > params.rel_threshold, "rising")
        .when(rel < -params.rel_threshold, "declining")
        .otherwise("flat"),
    })


TREND_COLUMNS = (
    "variant", "tag", "month", "share", "smoothed_share", "tag_seconds", "n_artists", "slope",
    "slope_pp_per_year", "rel_change_per_year", "mean_recent_share", "trend_class",
)


def tag_trends(
    plays: DataFrame, credits: DataFrame, weights: DataFrame,
    params: Params = DEFAULTS, by: Sequence[str] = (),
) -> DataFrame:
    grid = _grid(plays, credits, weights, params, by)
    shared = grid.withColumn("share", ratio(F.col("tag_seconds"), F.col("month_seconds")))
    smoothed = with_smoothing(shared, params, by)
    return with_trend_class(with_slope(smoothed, params, by), params).select(*by, *TREND_COLUMNS)


def latest_slice(
    trends: DataFrame, params: Params = DEFAULTS, by: Sequence[str] = (), variant: str | None = None
) -> DataFrame:
    """Rows of the newest month over all variants, for one variant.

    Each series is reduced to its last row first, so the month is compared on
    one row per tag and the trends are computed only once.
    """
    key = [*by, "tag", "variant"]
    rest = [c for c in trends.columns if c not in key]
    last = trends.groupBy(*key).agg(F.max_by(F.struct(*rest), "month").alias("_r")).select(*key, "_r.*")
    newest = F.max("month").over(Window.partitionBy(*by))
    return (
        last.withColumn("_newest", newest)
        .where((F.col("month") == F.col("_newest"))
               & (F.col("variant") == (variant or params.default_variant)))
        .select(*trends.columns)
    )
