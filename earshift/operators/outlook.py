"""Where the listening is heading: taste vector, recommendations, forecast, gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import null_if_zero, ratio, shared_keys, top_k, trailing_months
from ..functions.text import fold_name, with_folded
from ..params import DEFAULTS, Params
from ..sources.tables import materialise
from .trends import latest_slice


def taste_inputs(trends: DataFrame, params: Params = DEFAULTS, by: Sequence[str] = ()) -> DataFrame:
    """What a taste vector is made of, a row per tag: worth storing, as any tilt
    starts from it."""
    return latest_slice(trends, params, by).select(*by, "tag", "smoothed_share", "rel_change_per_year")


def tilted(inputs: DataFrame, params: Params = DEFAULTS, by: Sequence[str] = (), lam: float | None = None) -> DataFrame:
    """Newest shares tilted by ``lam`` times their relative change, as a unit vector."""
    low, high = params.clamp
    lam = params.lam if lam is None else lam
    rel = F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce("rel_change_per_year", F.lit(0.0))))
    w = F.col("smoothed_share") * (1.0 + lam * rel)
    kept = inputs.select(*by, "tag", w.alias("w")).where("w > 0")
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*by)))
    return kept.select(*by, "tag", (F.col("w") / length).alias("taste"))


def taste_vector(
    trends: DataFrame, params: Params = DEFAULTS, by: Sequence[str] = (), lam: float | None = None
) -> DataFrame:
    return tilted(taste_inputs(trends, params, by), params, by, lam)


def seeds(
    plays: DataFrame, credits: DataFrame, resolution: DataFrame,
    params: Params = DEFAULTS, by: Sequence[str] = (),
) -> DataFrame:
    """Best-heard recent artists with a resolved id, with weights that sum to 1.

    By default each recent play counts its track's all-time seconds; plays are
    counted per track before credits join, so nothing fans out.
    """
    tracks = trailing_months(plays, params.seed_window_months, by).groupBy(*by, "track_uri").agg(
        F.count(F.lit(1)).alias("n"), F.sum("played_seconds").alias("recent")
    )
    c = credits.select(*shared_keys(credits, by, "track_uri"), "artist_name", "played_seconds")
    secs = F.col("recent") if params.seed_weight == "recent_seconds" else F.col("n") * F.col("played_seconds")
    heard = tracks.join(c, shared_keys(c, by, "track_uri")).groupBy(*by, "artist_name").agg(
        F.sum(secs).alias("secs")
    )
    known = resolution.where((F.col("status") == "resolved") & F.col("mbid").isNotNull())
    ranked = heard.join(known.select("artist_name", F.col("mbid").alias("seed_mbid")), "artist_name")
    order = [F.desc("secs"), F.asc("artist_name")]
    # Without listener keys: the top rows only, so the window below is that small.
    top = top_k(ranked, by, order, params.n_seeds) if by else ranked.orderBy(*order).limit(params.n_seeds)
    group = Window.partitionBy(*by)
    return top.select(
        *by, "artist_name", "seed_mbid",
        ratio(F.col("secs"), F.sum("secs").over(group)).alias("weight"),
        F.row_number().over(group.orderBy(*order)).alias("seed_rank"),
    )


def candidates(
    seeds: DataFrame, edges: DataFrame, resolution: DataFrame, credits: DataFrame,
    params: Params = DEFAULTS, by: Sequence[str] = (),
) -> DataFrame:
    """Unknown artists near the seeds, best ``max_candidates`` by summed
    similarity.  Known means a resolved id or a credited name after folding.

    Edges fold to (candidate, seed) first; a candidate then has at most one row
    per seed, which bounds its seed list by ``n_seeds``.
    """
    known_ids = resolution.where(F.col("mbid").isNotNull()).select("mbid").distinct()
    who = shared_keys(credits, by, "artist_name")
    # No second distinct after folding: Spark would drop the first one and fold
    # every row, and an anti join does not mind repeats.
    known_names = credits.select(*who).distinct().select(
        *who[:-1], fold_name(F.col("artist_name")).alias("name_key")
    )
    # Written, as the folding reads it twice; the edges are folded and joined once.
    fresh = materialise(edges.join(seeds, "seed_mbid").join(known_ids, "mbid", "left_anti"), "fresh")
    near = with_folded(fresh, name_key="name").join(known_names, known_names.columns, "left_anti")
    per_seed = near.groupBy(*by, "mbid", "seed_rank", F.col("artist_name").alias("seed")).agg(
        F.sum(F.col("score") * F.col("weight")).alias("part"), F.count(F.lit(1)).alias("n"),
        F.max("score").alias("near"),
        F.max_by(F.struct("name", "comment"), F.struct("score", "name")).alias("shown"),
    )
    out = per_seed.groupBy(*by, "mbid").agg(
        F.sum("part").alias("score"), F.sum("n").alias("n_seeds"),
        F.max_by("shown", "seed_rank").alias("shown"),
        F.slice(F.sort_array(F.collect_list(
            F.struct((-F.col("near")).alias("k"), "seed_rank", "seed"))), 1, 3).alias("via"),
    ).select(
        *by, "mbid", F.col("shown.name").alias("artist_name"), F.col("shown.comment").alias("comment"),
        "score", "n_seeds", F.col("via.seed").alias("via_artists"),
    )
    order = [F.desc("score"), F.asc("mbid")]
    if by:
        return top_k(out, by, order, params.max_candidates)
    return out.orderBy(*order).limit(params.max_candidates)


def candidate_vectors(tags: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Unit tag vector per candidate: top tags by count, weight count + 1."""
    top = top_k(
        tags, ["mbid"], [F.desc("count"), F.asc("tag")], params.top_tags_per_artist, rank="tag_rank"
    )
    w = F.greatest("count", F.lit(0)) + F.lit(1.0)
    return top.select(
        "mbid", "tag", "tag_rank",
        (w / F.sqrt(F.sum(w * w).over(Window.partitionBy("mbid")))).alias("w"),
    )


def ranked_heads(shortlist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The shortlist with similarity, which is relative to the whole of it,
    untagged candidates included."""
    best = F.max("score").over(Window.partitionBy(*by))
    return shortlist.withColumn("similarity", F.col("score") / F.when(best == 0, 1.0).otherwise(best))


def postings(shortlist: DataFrame, candidate_tags: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Tag to candidates with their unit weights, for the shortlist only."""
    wanted = candidate_tags.join(shortlist.select("mbid").distinct(), "mbid", "left_semi")
    return candidate_vectors(wanted, params).select("tag", "mbid", "w", "tag_rank")


def rerank(
    heads: DataFrame, lists: DataFrame, taste: DataFrame, params: Params = DEFAULTS, by: Sequence[str] = ()
) -> DataFrame:
    """similarity^alpha times tag cosine^beta, from stored ``ranked_heads`` and
    ``postings``: another taste costs a join on tag over the lists of its tags."""
    part = F.col("w") * F.col("taste")
    fit = lists.join(taste, "tag").groupBy(*by, "mbid").agg(
        F.sum(part).alias("trajectory_fit"),
        F.slice(F.sort_array(F.collect_list(
            F.struct((-part).alias("k"), "tag_rank", "tag"))), 1, 3).alias("why"),
    ).where("trajectory_fit > 0")
    return heads.join(fit, [*by, "mbid"]).select(
        *by, "artist_name", "mbid", "comment",
        (F.pow("similarity", F.lit(params.alpha)) * F.pow("trajectory_fit", F.lit(params.beta))).alias("score"),
        "similarity", "trajectory_fit", F.col("why.tag").alias("matched_genres"), "via_artists", "n_seeds",
    )


def recommend(
    shortlist: DataFrame, candidate_tags: DataFrame, taste: DataFrame,
    params: Params = DEFAULTS, by: Sequence[str] = (),
) -> DataFrame:
    """Vectors stay long, so the cosine is a join on tag over at most
    ``top_tags_per_artist`` rows per candidate."""
    return rerank(ranked_heads(shortlist, by), postings(shortlist, candidate_tags, params), taste, params, by)


def as_text(recommendations: DataFrame) -> DataFrame:
    """Lists joined with ', ' for files and screens."""
    return recommendations.withColumns({
        c: F.array_join(c, ", ") for c in ("matched_genres", "via_artists")
    })


def recommendations_for(recs: DataFrame, genre: str, word: bool = False) -> DataFrame:
    """Candidates whose matched genres hold ``genre``; with ``word`` also those
    where it is a word inside a longer genre (``house`` in ``deep house``)."""
    if word:
        return recs.where(F.array_join("matched_genres", ", ").rlike(rf"(?i)\b{genre}\b"))
    return recs.where(F.array_contains("matched_genres", genre))


def damped_months(params: Params = DEFAULTS, horizon: int | None = None) -> float:
    n = params.horizon_months if horizon is None else horizon
    return sum(params.momentum_decay**i for i in range(n))


def forecast(
    trends: DataFrame, params: Params = DEFAULTS, by: Sequence[str] = (), horizon: int | None = None
) -> DataFrame:
    """Shares carried forward with fading momentum, never below zero, summing to 1."""
    months = params.horizon_months if horizon is None else horizon
    now = latest_slice(trends, params, by).select(
        *by, "tag", F.col("smoothed_share").alias("share_now"),
        F.coalesce("slope", F.lit(0.0)).alias("slope"), "trend_class",
    )
    raw = F.greatest(F.col("share_now") + F.col("slope") * damped_months(params, months), F.lit(0.0))
    ahead = now.withColumn("raw", raw).where("share_now > 0 OR raw > 0")
    future = ratio(F.col("raw"), F.sum("raw").over(Window.partitionBy(*by)))
    return ahead.withColumn("share_future", future).select(
        *by, "tag", "share_now", "share_future", "trend_class", "slope",
        F.lit(months).alias("horizon_months"),
        (F.col("share_future") - F.col("share_now")).alias("change"),
    )


def projected_movers(fc: DataFrame, k: int = 8, floor: float = 0.005, by: Sequence[str] = ()) -> DataFrame:
    big = fc.where((F.col("share_now") > floor) | (F.col("share_future") > floor))
    order = [F.abs("change").desc_nulls_last(), F.asc("tag")]
    return top_k(big, by, order, k) if by else big.orderBy(*order).limit(k)


def tag_supply(credits: DataFrame, weights: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Artists and hours per tag.  Each credit carries the whole track's time."""
    artists = credits.groupBy(*by, "artist_name").agg(F.sum("played_seconds").alias("secs"))
    who = shared_keys(weights, by, "artist_name")
    per_tag = weights.groupBy(*who, "tag").agg(F.sum("tag_weight").alias("w"))
    return artists.join(per_tag, who).groupBy(*by, "tag").agg(
        F.count(F.lit(1)).alias("n_artists"), (F.sum(F.col("secs") * F.col("w")) / 3600.0).alias("hours")
    )


def genre_gaps(
    trends: DataFrame, credits: DataFrame, weights: DataFrame,
    params: Params = DEFAULTS, by: Sequence[str] = (),
) -> DataFrame:
    """Rising genres served by few artists: growth times share per artist."""
    rising = latest_slice(trends, params, by).where(F.col("trend_class") == "rising").select(
        *by, "tag", F.col("smoothed_share").alias("share_now"),
        F.coalesce("rel_change_per_year", F.lit(0.0)).alias("rel_change_per_year"), "trend_class",
    )
    n = null_if_zero(F.col("n_artists"))
    return rising.join(tag_supply(credits, weights, by), [*by, "tag"]).withColumns({
        "gap_score": F.col("rel_change_per_year") * F.col("share_now") / n,
        "hours_per_artist": F.col("hours") / n,
    })


def top_gaps(gaps: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    order = [F.desc_nulls_last("gap_score"), F.asc("tag")]
    return top_k(gaps, by, order, k) if by else gaps.orderBy(*order).limit(k)


def gap_recommendations(
    gaps: DataFrame, recs: DataFrame, per_tag: int = 2, n_gaps: int = 8, by: Sequence[str] = ()
) -> DataFrame:
    """Best candidates for each of the top gaps.  The genre list is exploded so
    membership is an equi-join."""
    tagged = recs.withColumn("tag", F.explode(F.array_distinct("matched_genres")))
    hits = top_gaps(gaps, n_gaps, by).select(*by, "tag").join(tagged, [*by, "tag"])
    return top_k(hits, [*by, "tag"], [F.desc("score"), F.asc("mbid")], per_tag)

