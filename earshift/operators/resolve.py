"""Artist resolution: candidate matching, hand overrides, tags, work lists.

Lookups are input tables here: ``resolver_candidates`` holds what a catalogue
search returned per name, ``lookups`` what a direct lookup by id returned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.frames import first_per_key
from ..functions.text import fold_name, with_folded
from ..params import DEFAULTS, Params

# Fixed value: shape of a catalogue id.
MBID = r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
TAGS = T.ArrayType(T.StructType([T.StructField("tag", T.StringType()), T.StructField("count", T.LongType())]))


def no_tags() -> Column:
    return F.array().cast(TAGS)


def candidate_tag_list(tags: Column) -> Column:
    """[{name, count}] to [{tag, count}], lower-cased, unnamed ones dropped."""
    named = F.filter(tags, lambda t: F.coalesce(t["name"], F.lit("")) != "")
    out = F.transform(named, lambda t: F.struct(
        F.lower(t["name"]).alias("tag"), F.coalesce(t["count"], F.lit(0)).cast("bigint").alias("count")))
    return F.coalesce(out, no_tags())


def resolve_artists(names: DataFrame, resolver_candidates: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """One resolution row per artist name; never a guess.

    A candidate counts when its name or an alias folds to the same key.  Best:
    own name over alias, then tagged, score, number of tags, search position.
    No candidates: not_found.  Candidates but none equal: ambiguous, showing the
    first.  ``failed`` lists names whose search failed: error.

    Every candidate list is reduced by an aggregate, not ranked in a window.
    """
    c = resolver_candidates.withColumn("n_tags", F.size(F.coalesce("tags", F.array().cast(
        resolver_candidates.schema["tags"].dataType))))
    keys = with_folded(c, target="query_name", own_key="name").select(
        "query_name", "pos", "mbid", "name", "score", "tags", "n_tags", "target", "own_key")
    # Aliases are folded as rows: a Python function cannot run inside an array
    # lambda.  They meet their candidate again on its position.
    aliases = c.select("query_name", "pos", F.explode("aliases").alias("alias"))
    alias_hits = with_folded(aliases, target="query_name", alias_key="alias").where(
        F.col("alias_key") == F.col("target")
    ).select("query_name", "pos").distinct().withColumn("by_alias", F.lit(True))
    matched = keys.join(alias_hits, ["query_name", "pos"], "left")
    own = F.col("own_key") == F.col("target")
    row = F.struct("mbid", "score", "name", "tags")
    is_match = own | F.coalesce("by_alias", F.lit(False))
    rank = F.struct(
        own, F.col("n_tags") > 0, F.coalesce("score", F.lit(0)), F.col("n_tags"), -F.col("pos"))
    best = matched.groupBy("query_name").agg(
        F.max_by(row, F.when(is_match, rank)).alias("hit"),
        F.max(is_match).alias("is_resolved"),
        F.min_by(row, "pos").alias("first"),
        F.count(F.lit(1)).cast("int").alias("n_candidates"),
    )
    j = names.select("artist_name").distinct().join(
        best.withColumnRenamed("query_name", "artist_name"), "artist_name", "left"
    )
    if failed is not None:
        j = j.join(failed.select("artist_name").distinct().withColumn("_failed", F.lit(True)), "artist_name", "left")
    else:
        j = j.withColumn("_failed", F.lit(None).cast("boolean"))
    ok = F.coalesce("is_resolved", F.lit(False)) & F.col("_failed").isNull()
    shown = F.when(ok, F.col("hit")).when(F.col("_failed").isNull(), F.col("first"))
    return j.select(
        "artist_name", F.lit("musicbrainz").alias("source"),
        F.when(F.col("_failed"), "error").when(F.col("n_candidates").isNull(), "not_found")
        .when(ok, "resolved").otherwise("ambiguous").alias("status"),
        F.when(ok, F.col("hit.mbid")).alias("mbid"), shown["score"].cast("int").alias("score"),
        shown["name"].alias("matched_name"),
        F.when(F.col("_failed"), 0).otherwise(F.coalesce("n_candidates", F.lit(0))).alias("n_candidates"),
        F.when(ok, candidate_tag_list(F.col("hit.tags"))).otherwise(no_tags()).alias("tags"),
    )


def valid_override_tags(overrides: DataFrame, vocabulary: DataFrame | None) -> DataFrame:
    """(name_key, tag, position) of hand tags the vocabulary accepts.

    ``vocabulary`` has a lower-cased ``term`` column.  None, or an empty table,
    accepts everything: a failed vocabulary load must not lose hand tags.
    """
    t = overrides.select("name_key", F.posexplode("tags").alias("pos", "tag"))
    if vocabulary is None:
        return t
    known = vocabulary.select("term").distinct()
    is_empty = ~F.coalesce(known.agg(F.count(F.lit(1)) > 0).scalar(), F.lit(False))
    j = t.withColumn("term", F.lower("tag")).join(known.withColumn("_known", F.lit(True)), "term", "left")
    return j.where(F.col("_known").isNotNull() | is_empty).select("name_key", "pos", "tag")


def rejected_override_tags(overrides: DataFrame, vocabulary: DataFrame) -> DataFrame:
    every = overrides.select("name_key", F.posexplode("tags").alias("pos", "tag"))
    return every.join(valid_override_tags(overrides, vocabulary), ["name_key", "pos", "tag"], "left_anti")


def apply_overrides(
    resolutions: DataFrame, overrides: DataFrame, vocabulary: DataFrame | None = None,
    lookups: DataFrame | None = None, params: Params = DEFAULTS,
) -> DataFrame:
    """Hand answers over computed ones, joined fresh on every run, so a line
    taken out of the file leaves nothing behind.

    IGNORE marks the name; an id pins it, with tags from ``lookups`` (mbid,
    name, tags) and status error where the lookup has no row; hand tags replace
    the tags without touching the resolution.
    """
    good = valid_override_tags(overrides, vocabulary).groupBy("name_key").agg(
        F.sort_array(F.collect_list(F.struct("pos", "tag"))).alias("_t")
    ).select("name_key", F.transform("_t", lambda t: F.struct(
        t["tag"].alias("tag"), F.lit(params.override_tag_count).cast("bigint").alias("count"))).alias("_hand"))
    ov = overrides.select(
        "name_key", F.col("mbid").alias("_pin"), F.col("ignore").alias("_ignore"), F.col("note").alias("_note")
    ).join(good, "name_key", "left")
    j = resolutions.withColumn("name_key", fold_name(F.col("artist_name"))).join(ov, "name_key", "left")
    if lookups is not None:
        found = lookups.select(
            F.lower("mbid").alias("_pin"), F.col("name").alias("_found_name"), F.col("tags").alias("_found_tags"))
        j = j.join(found, "_pin", "left")
    else:
        j = j.withColumns({"_found_name": F.lit(None).cast("string"), "_found_tags": F.lit(None).cast(TAGS)})
    ignored = F.coalesce("_ignore", F.lit(False))
    pinned = F.col("_pin").isNotNull()
    found = pinned & F.col("_found_tags").isNotNull()
    pick = lambda on_ignore, on_found, on_failed, name: (
        F.when(ignored, on_ignore).when(found, on_found).when(pinned, on_failed).otherwise(F.col(name))
    )
    none = F.lit(None)
    return j.select(
        "artist_name",
        F.when(ignored | pinned | F.col("_hand").isNotNull(), "override").otherwise(F.col("source")).alias("source"),
        pick(F.lit("ignored"), F.lit("resolved"), F.lit("error"), "status").alias("status"),
        pick(none, F.col("_pin"), F.col("_pin"), "mbid").alias("mbid"),
        pick(none, F.lit(100), none, "score").cast("int").alias("score"),
        pick(none, F.col("_found_name"), none, "matched_name").alias("matched_name"),
        pick(F.lit(0), F.lit(1), F.lit(0), "n_candidates").cast("int").alias("n_candidates"),
        F.coalesce("_hand", pick(no_tags(), F.col("_found_tags"), no_tags(), "tags")).alias("tags"),
        F.when(ignored | pinned, F.col("_note")).alias("note"),
    )


def override_stats(resolutions: DataFrame, overrides: DataFrame) -> DataFrame:
    """Rows per kind, and rows that match no artist."""
    names = resolutions.select(fold_name(F.col("artist_name")).alias("name_key")).distinct().withColumn(
        "_used", F.lit(True))
    j = overrides.join(names, "name_key", "left")
    n = lambda c: F.count(F.when(c, 1))
    used = F.col("_used").isNotNull()
    return j.agg(
        n(used & F.col("ignore")).alias("ignored"), n(used & F.col("mbid").isNotNull()).alias("pinned"),
        n(used & ~F.col("ignore") & F.col("mbid").isNull()).alias("tags_only"), n(~used).alias("unused"),
    )


def drop_stale_overrides(log: DataFrame, overrides: DataFrame) -> DataFrame:
    """Drop logged override answers that the file no longer backs."""
    backed = overrides.where(F.col("mbid").isNotNull()).select("name_key", "mbid").distinct()
    ours = log.where(F.col("source").eqNullSafe("override"))
    kept = ours.where(F.col("status") == "resolved").withColumn(
        "name_key", fold_name(F.col("artist_name"))
    ).join(backed, ["name_key", "mbid"], "left_semi").select(*log.columns)
    return log.where(~F.col("source").eqNullSafe("override")).unionByName(kept)


def artist_tags(resolutions: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """One row per (artist, tag) with ``is_genre``; no vocabulary means all are."""
    flat = resolutions.select("artist_name", "mbid", "source", F.explode("tags").alias("_t")).select(
        "artist_name", "mbid", F.col("_t.tag").alias("tag"),
        F.coalesce("_t.count", F.lit(0)).cast("bigint").alias("tag_count"), "source",
    )
    if vocabulary is None:
        return flat.withColumn("is_genre", F.lit(True))
    known = vocabulary.select(F.col("term").alias("tag")).distinct().withColumn("_known", F.lit(True))
    is_empty = ~F.coalesce(known.agg(F.count(F.lit(1)) > 0).scalar(), F.lit(False))
    return flat.join(known, "tag", "left").withColumn(
        "is_genre", F.col("_known").isNotNull() | is_empty
    ).drop("_known").select(*flat.columns, "is_genre")


def artist_resolution(resolutions: DataFrame) -> DataFrame:
    return resolutions.select(
        "artist_name", "mbid", "status", "source", "matched_name", "score",
        F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"),
        F.size(F.coalesce("tags", no_tags())).alias("n_tags"),
    )


def review_list(resolution: DataFrame, hours: DataFrame) -> DataFrame:
    """Names still open: unresolved or untagged, unless ignored by hand."""
    still_open = (F.col("status") != "ignored") & ((F.col("status") != "resolved") | (F.col("n_tags") == 0))
    return resolution.where(still_open).join(hours, "artist_name", "left").select(
        "artist_name", "status", "matched_name", "score", "n_candidates", "listening_hours"
    )


def release_group_tags(release_tags: DataFrame) -> DataFrame:
    """Votes over everything an artist released; a zero or absent count is 1."""
    votes = F.when(F.coalesce("count", F.lit(0)) == 0, 1).otherwise(F.col("count"))
    named = release_tags.where(F.coalesce("name", F.lit("")) != "")
    return named.groupBy("mbid", F.lower("name").alias("tag")).agg(F.sum(votes).alias("count"))


def backfill_tags(resolutions: DataFrame, release_tags: DataFrame) -> DataFrame:
    """Resolved artists without tags take those of their releases.

    A tag list is per artist and as long as the artist's distinct tags.
    """
    lists = release_group_tags(release_tags).groupBy("mbid").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("k"), "tag"))).alias("_l")
    ).select("mbid", F.transform("_l", lambda t: F.struct(
        t["tag"].alias("tag"), (-t["k"]).cast("bigint").alias("count"))).alias("_tags"))
    needs = (F.col("status") == "resolved") & F.col("mbid").isNotNull() & (
        F.size(F.coalesce("tags", no_tags())) == 0)
    j = resolutions.join(lists, "mbid", "left")
    filled = needs & F.col("_tags").isNotNull()
    return j.select(*[
        F.when(filled, F.lit("musicbrainz-release-group")).otherwise(F.col("source")).alias("source")
        if c == "source" else
        F.when(filled, F.col("_tags")).otherwise(F.col("tags")).alias("tags") if c == "tags" else F.col(c)
        for c in resolutions.columns
    ])


def worklist(
    hours: DataFrame, resolutions: DataFrame, overrides: DataFrame | None = None,
    retry: Sequence[str] = ("error",), limit: int | None = None,
) -> DataFrame:
    """Artists still to look up, heaviest first: not answered by hand, and never
    tried or in a status worth another try."""
    j = hours.join(resolutions.select("artist_name", "status"), "artist_name", "left")
    todo = j.where(F.col("status").isNull() | F.col("status").isin(*retry))
    if overrides is not None:
        todo = todo.withColumn("name_key", fold_name(F.col("artist_name"))).join(
            overrides.select("name_key").distinct(), "name_key", "left_anti")
    todo = todo.select("artist_name", "listening_hours", "status")
    if limit is None:
        return todo
    return todo.orderBy(F.desc("listening_hours"), F.asc("artist_name")).limit(limit)


def first_known(sources: Sequence[DataFrame], key: str = "artist_name") -> DataFrame:
    """Union of caches; the first one that knows a name answers it."""
    ranked = [s.withColumn("_priority", F.lit(i)) for i, s in enumerate(sources)]
    out = ranked[0]
    for s in ranked[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    order = [F.col("_priority")] + [
        F.col(f.name) for f in out.schema if f.name not in (key, "_priority")
        and not isinstance(f.dataType, T.MapType)
    ]
    return first_per_key(out, [key], order).drop("_priority")
