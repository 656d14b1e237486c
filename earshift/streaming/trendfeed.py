"""Trends and credits kept up to date from a feed.

A batch names the (listener, month) cells it touches.  Those months are split
over tags anew, the shares of their tags change, the trailing means change there
and in the next months of the listener, and slopes only if one of those lies in
the last year.  Nothing else is written, so the work of a batch follows what it
touches and not the history.  A performer list that is learned later touches the
months in which its track was played, and only those.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.frames import ratio
from ..operators.credits import credits_of_tracks, fold_spellings, fold_tracks, performers_of
from ..operators.trends import TREND_COLUMNS, tag_month_of, with_trend_class
from ..params import DEFAULTS, Params
from ..sources.tables import materialise, work_dir
from .store import EpochLog, add_up, keep_newest, keep_newest_group

FOLD_AFTER = 32


def listener_fields(by: Sequence[str], like: T.StructType) -> list[T.StructField]:
    """Without listener keys there is one listener, number 0."""
    return [like[b] for b in by] or [T.StructField("listener", T.IntegerType())]


class TrendFeed:
    """``plays`` names the feed's schema: the listener keys, ts, month, track_uri,
    played_seconds.  ``credits`` gives the credits as they are known now."""

    def __init__(self, spark: SparkSession, path: str, plays: T.StructType, credits: Callable[[], DataFrame], weights: DataFrame,
                 params: Params = DEFAULTS, by: Sequence[str] = (), fold_after: int = FOLD_AFTER):
        self.spark, self.credits, self.weights, self.params, self.by, self.fold_after = spark, credits, weights, params, tuple(by), fold_after
        own = listener_fields(by, plays)
        self.key = [f.name for f in own]
        self.cell = [*self.key, "month"]
        f = lambda name, kind: T.StructField(name, kind)
        month, tag, variant = f("month", T.DateType()), f("tag", T.StringType()), f("variant", T.StringType())
        num = lambda *names: [f(n, T.DoubleType()) for n in names]
        log = lambda name, fields, part=("month",): EpochLog(spark, f"{path}/{name}", T.StructType(fields), part)
        n = f("n_artists", T.LongType())
        self.time = log("time", [*own, f("track_uri", T.StringType()), plays["ts"], *num("secs"), f("n", T.LongType()), month])
        self.wide = log("wide", [*own, tag, *num(*[f"s_{v}" for v in params.variants]), n, month])
        self.cells = log("cells", [*own, variant, tag, *num("share", "smoothed_share", "tag_seconds"), n, month])
        self.series = log("series", [*own, variant, tag, *num("slope", "mean_recent_share")], ())

    def listeners(self, df: DataFrame) -> DataFrame:
        return df if self.by else df.withColumn("listener", F.lit(0))

    def update(self, batch: DataFrame, epoch: int, changed: DataFrame | None = None) -> None:
        """foreachBatch writer.  ``changed`` names tracks whose performers are no
        longer those of the last batch.  A replayed batch replaces what it wrote."""
        base = work_dir(self.spark)
        plays = self.listeners(batch)
        self.time.write(plays.select(*self.cell, "track_uri", "ts", F.col("played_seconds").alias("secs"), F.lit(1).cast("long").alias("n")), epoch)
        own = self.time.read(epoch + 1).where(F.col("epoch") == epoch)
        touched = materialise(own.select(*self.cell).distinct(), "played", base)
        months = self._months(touched)
        if changed is not None:
            rest = self.time.read(epoch)
            rest = rest.join(touched, self.cell, "left_anti") if self.by else rest.where(~F.col("month").isin(months))
            more = rest.join(changed, "track_uri", "left_semi").select(*self.cell).distinct()
            touched = materialise(touched.unionByName(more), "touched", base)
            months = self._months(touched)
        if not months:
            return
        self.wide.write(self._split(touched, months, epoch), epoch)
        todo = self._cells(touched, epoch, base)
        self.cells.write(todo.where("keep"), epoch)
        self.series.write(self._slopes(touched, epoch, base), epoch)
        self._fold(epoch)

    def _months(self, touched: DataFrame) -> list:
        return [r[0] for r in touched.select("month").distinct().collect() if r[0] is not None]  # the calendar bounds them

    def _split(self, touched: DataFrame, months: list, epoch: int) -> DataFrame:
        """Touched months over tags, time without a tag as a null tag."""
        time = self.time.read(epoch + 1).where(F.col("month").isin(months))
        if self.by:  # one listener's cells are its months
            time = time.join(touched, self.cell, "left_semi")
        # Both folds below run where these rows meet.
        each = time.repartition(*self.cell, "track_uri").groupBy(*self.cell, "track_uri", "ts").agg(F.sum("secs").alias("secs"), F.sum("n").alias("n"))
        one = F.col("secs") / F.col("n") if self.params.merge_shared_timestamps else F.col("secs")
        per_track = each.groupBy(*self.cell, "track_uri").agg(F.sum(one).alias("secs"))
        return tag_month_of(per_track, self.credits(), self.weights, self.params, self.key, every_month=True)

    def calendar(self, touched: DataFrame, epoch: int) -> DataFrame:
        """All months of the touched listeners with their place."""
        own = self.wide.read(epoch + 1).select(*self.cell).join(touched.select(*self.key).distinct(), self.key, "left_semi").distinct()
        w = Window.partitionBy(*self.key)
        return own.select(*self.cell, F.row_number().over(w.orderBy("month")).alias("month_idx"), F.count(F.lit(1)).over(w).alias("n_months"))

    def _cells(self, touched: DataFrame, epoch: int, base: str) -> DataFrame:
        """Shares and trailing means of the months that change, led in by the months
        that their means reach back to; of a tag that is new, all months."""
        back = self.params.rolling_months - 1
        calendar = materialise(self.calendar(touched, epoch), "calendar", base)
        hit = calendar.join(touched, self.cell, "left_semi")
        near = hit.select(*self.key, "month_idx", F.explode(F.sequence(
            F.greatest(F.col("month_idx") - back, F.lit(1)), F.least(F.col("month_idx") + back, F.col("n_months").cast("int")))).alias("at"))
        near = near.groupBy(*self.key, F.col("at").alias("month_idx")).agg(F.max(F.col("at") >= F.col("month_idx")).alias("keep"))
        near = calendar.join(near, [*self.key, "month_idx"])
        known = self.series.read(epoch).select(*self.key, "tag").distinct()
        tags = self.wide.read(epoch + 1).where((F.col("epoch") == epoch) & F.col("tag").isNotNull()).select(*self.key, "tag").distinct()
        new = materialise(tags.join(known, [*self.key, "tag"], "left_anti"), "new", base)
        listed = known.join(near, self.key).select(*self.cell, "tag", "month_idx", "keep").unionByName(
            new.join(calendar, self.key).select(*self.cell, "tag", "month_idx", F.lit(True).alias("keep")))
        listed = materialise(listed, "listed", base)
        wide = self.wide.newest_group(self.cell, epoch + 1).join(listed.select(*self.cell).distinct(), self.cell, "left_semi").where("tag IS NOT NULL")
        variants = list(self.params.variants)
        totals = wide.groupBy(*self.cell).agg(*[F.sum(f"s_{v}").alias(f"all_{v}") for v in variants])
        dense = listed.join(wide, [*self.cell, "tag"], "left").join(totals, self.cell, "left")
        each = dense.select(*self.cell, "tag", "month_idx", "keep", F.coalesce("n_artists", F.lit(0)).alias("n_artists"), F.explode(F.array(*[F.struct(
            F.lit(v).alias("variant"), F.coalesce(f"s_{v}", F.lit(0.0)).alias("tag_seconds"), F.coalesce(f"all_{v}", F.lit(0.0)).alias("total"))
            for v in variants])).alias("_v")).select("*", "_v.*").withColumn("share", ratio(F.col("tag_seconds"), F.col("total")))
        w = Window.partitionBy(*self.key, "tag", "variant").orderBy("month_idx").rowsBetween(-back, 0)
        return each.withColumn("smoothed_share", F.avg("share").over(w))

    def _slopes(self, touched: DataFrame, epoch: int, base: str) -> DataFrame:
        """Slopes of the tags of listeners with a changed month among the last ones,
        and of new tags."""
        calendar, new = (self.spark.read.parquet(f"{base}/{n}") for n in ("calendar", "new"))
        late = F.col("month_idx") > F.col("n_months") - self.params.slope_months
        reach = F.col("month_idx") + self.params.rolling_months - 1 > F.col("n_months") - self.params.slope_months
        moved = calendar.join(touched, self.cell, "left_semi").where(reach).select(*self.key).distinct()
        recent = calendar.where(late).select(*self.cell, "month_idx")
        months = [r[0] for r in recent.select("month").distinct().collect()]
        cells = self.cells.read(epoch + 1).where(F.col("month").isin(months)).join(recent, self.cell)
        names = [*self.key, "variant", "tag"]
        last = cells.groupBy(*names, "month_idx").agg(F.max_by("smoothed_share", "epoch").alias("smoothed_share"))
        last = last.join(moved.withColumn("_m", F.lit(True)), self.key, "left").join(
            new.withColumn("_n", F.lit(True)), [*self.key, "tag"], "left").where("_m OR _n")
        return last.groupBy(*names).agg(F.regr_slope("smoothed_share", F.col("month_idx").cast("double")).alias("slope"),
                                        F.avg("smoothed_share").alias("mean_recent_share"))

    def _fold(self, epoch: int) -> None:
        names = [*self.key, "variant", "tag"]
        self.time.fold(epoch - 1, add_up([*self.cell, "track_uri", "ts"], "secs", "n"), self.fold_after)
        self.wide.fold(epoch - 1, keep_newest_group(self.cell), self.fold_after)
        self.cells.fold(epoch - 1, keep_newest([*names, "month"]), self.fold_after)
        self.series.fold(epoch - 1, keep_newest(names), self.fold_after)

    def read(self) -> DataFrame:
        """The trends as ``tag_trends`` gives them for all plays so far."""
        names = [*self.key, "variant", "tag"]
        rows = self.cells.newest([*names, "month"]).join(self.series.newest(names), names)
        return with_trend_class(rows, self.params).select(*self.by, *TREND_COLUMNS)


class CreditFeed:
    """Credits kept up to date from plays with names and, from the poller,
    performer lists.  ``plays`` needs track_uri, track_name, artist_name,
    track_artists and played_seconds."""

    def __init__(self, spark: SparkSession, path: str, fold_after: int = FOLD_AFTER):
        self.spark, self.fold_after = spark, fold_after
        self.spellings = EpochLog(spark, f"{path}/spellings", T.StructType.fromDDL(
            "track_uri string, track_name string, artist_name string, track_artists string, played_seconds double, n_plays bigint"))
        self.credits = EpochLog(spark, f"{path}/credits", T.StructType.fromDDL(
            "track_uri string, track_name string, album_artist string, artist_name string, credit_type string, credit_source string, "
            "played_seconds double, n_plays bigint, n_performers bigint, changed boolean"))

    def update(self, batch: DataFrame, epoch: int) -> DataFrame:
        """foreachBatch writer: the credits of the batch's tracks, from all their
        plays.  Returns the tracks whose performers changed."""
        self.spellings.write(fold_spellings(batch.where("track_uri IS NOT NULL")), epoch)
        every = self.spellings.read(epoch + 1)
        hit = every.where(F.col("epoch") == epoch).select("track_uri").distinct()
        rows = every.join(hit, "track_uri", "left_semi")
        # A track's names as they were and as they are now come from one fold.
        was = {c: F.when(F.col("epoch") < epoch, F.col(c)) for c in ("track_name", "artist_name", "track_artists")}
        known = F.max(F.col("epoch") < epoch).alias("_known")
        both = fold_tracks(rows, more=[
            F.struct(F.min(was["track_name"]).alias("track_name"), F.min(was["artist_name"]).alias("album_artist"),
                     F.max(was["track_artists"]).alias("listed")).alias("_was"), known])
        before = F.sort_array(performers_of("_was."))
        both = both.withColumn("changed", F.col("_known") & ~F.sort_array(performers_of()).eqNullSafe(before))
        self.credits.write(credits_of_tracks(both, keep=["changed"]), epoch)
        changed = materialise(self.credits.read(epoch + 1).where((F.col("epoch") == epoch) & F.col("changed")).select("track_uri").distinct(), "changed")
        self.spellings.fold(epoch - 1, add_up(["track_uri", "track_name", "artist_name", "track_artists"], "played_seconds", "n_plays"), self.fold_after)
        self.credits.fold(epoch - 1, keep_newest_group(["track_uri"]), self.fold_after)
        return changed

    def read(self, before: int | None = None) -> DataFrame:
        return self.credits.newest_group(["track_uri"], before).drop("changed")


def repair_feed(trends: TrendFeed, credits: CreditFeed) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer for both: new lists re-credit their tracks, and the
    months in which those were played are split anew."""
    def write(batch: DataFrame, epoch: int) -> None:
        kept = materialise(batch, "batch")
        trends.update(kept, epoch, credits.update(kept, epoch))
    return write


def discovery_feed(spark: SparkSession, path: str, firsts: T.StructType, fold_after: int = FOLD_AFTER) -> tuple[EpochLog, Callable[[DataFrame, int], None]]:
    """Discoveries per month from a stream of plays or of first months (listener
    keys, artist_name, month): an artist whose first month moves back leaves the
    old month and enters the new one.  The log of first months is all the state
    there is, so plays need no streaming aggregate before.  Returns the log of changes
    (read with ``discoveries``) and the foreachBatch writer."""
    key = [f.name for f in firsts.fields if f.name != "month"]
    by = [k for k in key if k != "artist_name"]
    seen = EpochLog(spark, f"{path}/firsts", T.StructType([*firsts.fields, T.StructField("was", firsts["month"].dataType)]))
    changes = EpochLog(spark, f"{path}/changes", T.StructType([*[firsts[b] for b in by], firsts["month"], T.StructField("n", T.LongType())]))

    def write(batch: DataFrame, epoch: int) -> None:
        # One fold of the batch and of what was known; only what moves is written.
        known = seen.read(epoch).select(*key, F.lit(None).cast(firsts["month"].dataType).alias("month"), F.col("month").alias("was"))
        now = batch.select(*key, "month", F.lit(None).cast(firsts["month"].dataType).alias("was"))
        both = now.unionByName(known).groupBy(*key).agg(F.min("month").alias("month"), F.min("was").alias("was"))
        seen.write(both.where("month IS NOT NULL AND (was IS NULL OR month < was)"), epoch)
        moved = seen.read(epoch + 1).where(F.col("epoch") == epoch)
        steps = moved.select(*by, F.explode(F.filter(F.array(
            F.struct("month", F.lit(1).cast("long").alias("n")), F.struct(F.col("was").alias("month"), F.lit(-1).cast("long").alias("n"))),
            lambda s: s["month"].isNotNull())).alias("_s")).select(*by, "_s.*")
        changes.write(steps.groupBy(*by, "month").agg(F.sum("n").alias("n")), epoch)
        changes.fold(epoch - 1, add_up([*by, "month"], "n"), fold_after)
        seen.fold(epoch - 1, lambda rows: rows.groupBy(*key).agg(F.min("month").alias("month"), F.min("was").alias("was")), fold_after)

    return changes, write


def discoveries(changes: EpochLog, by: Sequence[str] = ()) -> DataFrame:
    return changes.read().groupBy(*by, "month").agg(F.sum("n").alias("new_artists")).where("new_artists <> 0")
