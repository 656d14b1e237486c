"""Live feeds with Structured Streaming.

Results of changing aggregates are kept as an upsert log (``store.EpochLog``):
every micro-batch writes its changed rows, replaced when the batch is replayed,
and readers take the newest row per key.  Lost executors or a restarted query
therefore change nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..params import DEFAULTS, Params
from ..sources.payloads import page_full
from .store import EpochLog, keep_newest


def stream_table(
    spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None,
) -> DataFrame:
    """A Parquet table as a stream: a folder of part files, or one file."""
    r = spark.readStream.schema(schema)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        r, path = r.option("pathGlobFilter", where.getName()), where.getParent().toString()
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path)


def instant(ts: str | Column) -> Column:
    """Zone-free UTC time as the instant a watermark needs, in any session zone."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(ts) if isinstance(ts, str) else ts).cast("timestamp")


def utc_wall(ts: str) -> Column:
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col(ts).cast("timestamp_ntz"))


def dedupe_stream(
    events: DataFrame, key: Sequence[str] = ("ts", "track_uri"), ts: str = "ts", delay: str | None = None
) -> DataFrame:
    """Drop repeats of a key, however late they or their first row arrive.

    The state holds every key.  With a ``delay`` it is dropped with the
    watermark, but rows that come later than that are lost: give one only to a
    feed that is known to be in order.
    """
    if delay is None:
        return events.dropDuplicates(list(key))
    timed = events.withColumn("_at", instant(ts)).withWatermark("_at", delay)
    return timed.dropDuplicatesWithinWatermark(list(key)).drop("_at")


def daily_rollup(
    events: DataFrame, keys: Sequence[str], seconds: str = "played_seconds", ts: str = "ts",
    delay: str | None = None,
) -> DataFrame:
    """Day-grain totals.  Spark has no calendar-month stream window, so months
    are added up from days in batch (``months_from_days``).

    A row of any age is added to its day; with a ``delay`` days are closed by
    the watermark and later rows are lost.
    """
    sums = F.count(F.lit(1)).alias("plays"), F.sum(seconds).alias("secs")
    if delay is None:
        return events.groupBy(F.to_date(ts).alias("day"), *keys).agg(*sums)
    timed = events.withColumn("_at", instant(ts)).withWatermark("_at", delay)
    days = timed.groupBy(F.window("_at", "1 day"), *keys).agg(*sums)
    return days.select(F.to_date(utc_wall("window.start")).alias("day"), *keys, "plays", "secs")


def months_from_days(days: DataFrame, keys: Sequence[str]) -> DataFrame:
    return days.groupBy(F.trunc("day", "month").alias("month"), *keys).agg(
        F.sum("plays").alias("plays"), F.sum("secs").alias("secs"))


def first_seen(events: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """First time of each key; update mode emits a key again if older rows arrive."""
    return events.groupBy(*keys).agg(F.min(ts).alias("first_ts"))


def listed_artists(events: DataFrame) -> DataFrame:
    """Performer list per track as the poller learns it, for credit repair."""
    return events.where(F.col("track_artists").isNotNull()).groupBy("track_uri").agg(
        F.max("track_artists").alias("track_artists"))


def with_listed_artists(plays: DataFrame, listed: DataFrame) -> DataFrame:
    """All plays of a track, old ones too, with the list learned on any of them."""
    j = plays.join(listed.withColumnRenamed("track_artists", "_listed"), "track_uri", "left")
    return j.withColumn("track_artists", F.greatest("track_artists", "_listed")).drop("_listed").select(*plays.columns)


def upsert_log(path: str, key: Sequence[str] = (), order: Sequence[str] = (), fold_after: int = 32) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer; a replayed batch replaces its own rows.  With ``key``
    earlier batches are folded to their newest rows now and then."""
    def write(batch: DataFrame, epoch: int) -> None:
        log = EpochLog(batch.sparkSession, path, batch.schema)
        log.write(batch, epoch)
        if key:
            log.fold(epoch - 1, keep_newest(key, order), fold_after)
    return write


def read_upserts(spark: SparkSession, path: str, schema: T.StructType, key: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Newest row per key of an upsert log; empty before the first batch."""
    return EpochLog(spark, path, schema).newest(key, order=order)


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_end(df: DataFrame, sink: str | Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Process what is there now, then stop.  The same call later goes on where
    this one ended.  ``sink`` is a foreachBatch writer or the path of an upsert
    log.  State is kept in RocksDB, off the heap, unless the session names
    another store."""
    conf = df.sparkSession.conf
    before = conf.get(STATE_STORE, None)
    if before is None or before.endswith("HDFSBackedStateStoreProvider"):
        conf.set(STATE_STORE, ROCKSDB)
    try:
        q = (
            df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).foreachBatch(upsert_log(sink) if isinstance(sink, str) else sink).start()
        )
        q.awaitTermination()
    finally:
        conf.unset(STATE_STORE) if before is None else conf.set(STATE_STORE, before)
    return q


def completeness(pages: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Poll pages, a stream too, with the number of their items and whether the
    page was full, so that older plays may be lost, in place of the items."""
    return page_full(pages, params.poll_page_limit)
