"""Consolidate playlists: score credits by tag family, band, fold editions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import first_per_key, ratio
from ..functions.text import fold_name, tag_family, title_key, with_folded
from ..params import DEFAULTS, Params
from ..sources.tables import materialise

KEEP, DROP, REVIEW = "keep", "drop", "review"


def family_weights(artist_tags: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Rap and electronic votes per artist, keyed on the folded name.

    Votes are clamped at 0; where both sides have no votes, tags are counted
    instead.  When spellings fold together the one with most tags stands.
    Rows fold to (artist, tag) first, so the tag list is bounded by the vocabulary.
    """
    votes = F.greatest(F.coalesce("tag_count", F.lit(0)), F.lit(0)).cast("double")
    tags = artist_tags.where(F.col("is_genre") & F.col("artist_name").isNotNull()).groupBy(
        "artist_name", "tag"
    ).agg(F.sum(votes).alias("w"), F.count(F.lit(1)).alias("n")).withColumn(
        "family", tag_family(F.col("tag"), params)
    )
    side = lambda fam, c: F.coalesce(F.sum(F.when(F.col("family") == fam, F.col(c))), F.lit(0))
    noted = F.when(F.col("family").isNotNull(), F.struct((-F.col("w")).alias("k"), "tag"))
    artists = tags.groupBy("artist_name").agg(
        side("rap", "w").alias("rap_w"), side("edm", "w").alias("edm_w"),
        side("rap", "n").alias("rap_n"), side("edm", "n").alias("edm_n"),
        F.sum("n").alias("n_tags"), F.sort_array(F.collect_list(noted)).alias("_tags"),
    ).withColumn("name_key", fold_name(F.col("artist_name")))
    total = F.col("rap_w") + F.col("edm_w")
    share = F.when(total == 0, ratio(F.col("rap_n"), F.col("rap_n") + F.col("edm_n"))).otherwise(
        ratio(F.col("rap_w"), total))
    best = first_per_key(artists, ["name_key"], [-F.col("n_tags"), F.col("artist_name")])
    return best.select(
        "name_key", "artist_name", "rap_w", "edm_w", "rap_n", "edm_n", "n_tags", share.alias("rap_share"),
        F.transform("_tags", lambda t: F.concat(
            t["tag"], F.lit("("), (-t["k"]).cast("bigint").cast("string"), F.lit(")"))).alias("tag_notes"),
    )


def decide(share: Column, params: Params = DEFAULTS) -> Column:
    return (
        F.when(share < params.keep_below, KEEP).when(share > params.drop_above, DROP).otherwise(REVIEW)
    )


def score_credits(items: DataFrame, weights: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """rap_share and reason per distinct credit list.

    The highest credit counts; credits after the first at ``feature_weight``,
    unless the first one cannot be scored.  Items are folded to their credit
    lists first: a list shared by many tracks is scored once.
    """
    lists = items.select("artists").distinct()
    w = weights.select("name_key", "rap_share", "tag_notes", F.lit(True).alias("_known"))
    each = lists.select("artists", F.posexplode_outer("artists").alias("pos", "name"))
    credits = with_folded(each, name_key="name").join(w, "name_key", "left")
    share, pos = F.col("rap_share"), F.col("pos")
    is_credit = pos.isNotNull()
    unknown = is_credit & F.col("_known").isNull()
    off = is_credit & F.col("_known").isNotNull() & share.isNull()
    listed = lambda c: F.sort_array(F.collect_list(F.when(c, F.struct("pos", "name"))))
    scored = credits.groupBy("artists").agg(
        F.coalesce(F.max(F.when(pos == 0, share.isNotNull())), F.lit(False)).alias("primary_known"),
        F.max(share).alias("full"),
        F.max(share * F.when(pos == 0, 1.0).otherwise(params.feature_weight)).alias("discounted"),
        listed(unknown).alias("unknown"), listed(off).alias("off"),
        F.sort_array(F.collect_list(F.when(
            is_credit & F.col("_known").isNotNull(), F.struct("pos", "name", "rap_share", "tag_notes")
        ))).alias("notes"),
    )
    names = lambda c: F.array_join(F.transform(c, lambda x: x["name"]), ", ")
    n_unknown, n_off = F.size("unknown"), F.size("off")
    reason = (
        F.when(F.col("full").isNotNull(), "")
        .when((n_unknown > 0) & (n_off == 0), F.concat(F.lit("untagged: "), names(F.col("unknown"))))
        .when((n_off > 0) & (n_unknown == 0), F.concat(F.lit("off-family: "), names(F.col("off"))))
        .otherwise("untagged/off-family mix")
    )
    note = lambda x: F.when(x["rap_share"].isNull(), F.concat(x["name"], F.lit(": off-family"))).otherwise(
        F.concat(
            x["name"], F.lit(": "), F.format_string("%.2f", x["rap_share"]),
            F.when(F.size(x["tag_notes"]) > 0, F.concat(
                F.lit(" ["), F.array_join(F.slice(x["tag_notes"], 1, 4), ","), F.lit("]"))).otherwise(""),
            F.when(F.col("primary_known"), "").otherwise(" (full weight: primary untagged)"),
        ))
    return scored.select(
        "artists", F.when(F.col("primary_known"), F.col("discounted")).otherwise(F.col("full")).alias("rap_share"),
        reason.alias("reason"), F.array_join(F.transform("notes", note), "; ").alias("tag_note"),
    )


def with_song_key(items: DataFrame) -> DataFrame:
    """Folded title and primary artist: editions of a song share both.

    Folding runs on the distinct pairs, of which there are far fewer than items.
    Items that carry the keys already are left alone.
    """
    if "title_key" in items.columns and "artist_key" in items.columns:
        return items
    named = items.withColumns({
        "_title": F.coalesce("track_name", F.lit("")),
        "_lead": F.coalesce(F.try_element_at("artists", F.lit(1)), F.lit("")),
    })
    keys = named.select("_title", "_lead").distinct().withColumns({
        "title_key": title_key(F.col("_title")), "artist_key": fold_name(F.col("_lead")),
    })
    return named.join(keys, ["_title", "_lead"]).drop("_title", "_lead")


def classify(
    items: DataFrame, weights: DataFrame, overrides: DataFrame | None = None, params: Params = DEFAULTS
) -> DataFrame:
    """Score and band every item; a hand decision outranks the band."""
    scored = with_song_key(items).join(score_credits(items, weights, params), "artists")
    if overrides is None:
        scored = scored.withColumn("decision", F.lit(None).cast("string"))
    else:
        scored = scored.join(
            overrides.select("title_key", "artist_key", "decision"), ["title_key", "artist_key"], "left")
    return scored.withColumns({
        "verdict": F.coalesce("decision", decide(F.col("rap_share"), params)),
        "overridden": F.col("decision").isNotNull(),
    }).drop("decision")


def source_rank(names: Sequence[str]) -> Column:
    rank = F.lit(None).cast("int")
    for i, n in reversed(list(enumerate(names))):
        rank = F.when(F.col("source") == n, i).otherwise(rank)
    return rank


def consolidate(
    whole: DataFrame, scored: DataFrame, whole_sources: Sequence[str], filtered_sources: Sequence[str]
) -> DataFrame:
    """The merged list: sources kept whole in the order named, then the kept
    rows of the filtered ones; the first to claim a song keeps it.  Order by
    (stage, source_rank, pos).

    Songs fold in an aggregate, so a song with very many copies is no problem.
    """
    shown = ["source", "pos", "track_uri", "track_name", "artists", "added_at", "title_key", "artist_key"]
    part = lambda df, stage, names: df.select(
        *[c for c in shown if c in df.columns], F.lit(stage).alias("stage"), source_rank(names).alias("source_rank"))
    rows = part(with_song_key(whole), 0, whole_sources).unionByName(
        part(scored.where(F.col("verdict") == KEEP), 1, filtered_sources))
    return first_per_key(
        rows, ["title_key", "artist_key"],
        [F.col(c) for c in ("stage", "source_rank", "pos", "track_uri", "track_name")],
    )


def review_rows(scored: DataFrame) -> DataFrame:
    """Rows that still need an answer, with a blank decision column.  Not folded."""
    return scored.where(F.col("verdict") == REVIEW).select(
        F.lit("").alias("decision"), "source", F.array_join("artists", ", ").alias("artist_name"),
        "track_name", F.round("rap_share", 3).alias("rap_share"),
        F.when(F.col("reason") == "", "ambiguous band").otherwise(F.col("reason")).alias("reason"),
        "added_at", F.col("tag_note").alias("tags"), "track_uri",
    )


def verdict_counts(scored: DataFrame) -> DataFrame:
    return scored.groupBy("source", "verdict").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("overridden"), 1)).alias("overridden"))


def fold_items(items: DataFrame) -> DataFrame:
    """One row per title and credit list with its number of items ``n``: all that a
    verdict depends on, so that counts need not carry every item."""
    return items.groupBy("track_name", "artists").agg(F.count(F.lit(1)).alias("n"))


def review_reasons(scored: DataFrame) -> DataFrame:
    """Rows to review by reason; rows of ``fold_items`` count as their items."""
    kind = F.when(F.col("reason") == "", "ambiguous band").otherwise(F.split("reason", ":")[0])
    n = F.sum("n") if "n" in scored.columns else F.count(F.lit(1))
    return scored.where(F.col("verdict") == REVIEW).groupBy(kind.alias("reason")).agg(n.alias("n"))


def folded_count(whole: DataFrame, scored: DataFrame, merged: DataFrame) -> DataFrame:
    """Tracks offered, tracks kept, and copies folded away."""
    offered = whole.select(F.lit(1).alias("x")).unionByName(
        scored.where(F.col("verdict") == KEEP).select(F.lit(1).alias("x")))
    kept = merged.agg(F.count(F.lit(1))).scalar()
    return offered.agg(F.count(F.lit(1)).alias("offered")).withColumn("merged", kept).withColumn(
        "folded", F.col("offered") - F.col("merged"))


def closest_calls(scored: DataFrame, drops: int = 10, keeps: int = 8) -> DataFrame:
    """Computed verdicts nearest the bands: lowest drops, highest keeps."""
    computed = scored.where(~F.col("overridden")).select(
        "verdict", "source", "pos", "track_uri", "track_name", "artists", "rap_share")
    tie = [F.asc(c) for c in ("source", "pos", "track_uri")]
    low = computed.where(F.col("verdict") == DROP).orderBy(F.asc("rap_share"), *tie).limit(drops)
    high = computed.where(F.col("verdict") == KEEP).orderBy(F.desc("rap_share"), *tie).limit(keeps)
    return low.unionByName(high)


def missing_artists(
    items: DataFrame, weights: DataFrame, overrides: DataFrame | None = None
) -> DataFrame:
    """Artists of filtered playlists without tags, on tracks not answered by hand.

    Items fold to titles and credit lists, and names to distinct ones, which are written:
    Spark would move the last anti join below the distinct and fold every item's names.
    """
    keys = [c for c in ("track_name", "title_key", "artist_key") if c in items.columns]
    rows = with_song_key(items.select("artists", *keys).distinct())
    if overrides is not None:
        rows = rows.join(overrides.select("title_key", "artist_key"), ["title_key", "artist_key"], "left_anti")
    names = materialise(rows.select(F.explode("artists").alias("artist_name")).distinct(), "names")
    return names.withColumn("name_key", fold_name(F.col("artist_name"))).join(
        weights.select("name_key"), "name_key", "left_anti").select("artist_name")
