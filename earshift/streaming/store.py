"""Tables that micro-batches add to.

Every batch writes a folder of its own, which a replay of the batch replaces.
Now and then all folders so far are folded into one; readers take the newest
complete fold and the batches after it, so a fold that failed half-way, or old
folders that are not deleted yet, change nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.frames import first_per_key


class EpochLog:
    """Rows of ``schema`` by epoch, below ``path``; ``partition`` names columns
    that readers filter by."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, partition: Sequence[str] = ()):
        self.spark, self.path, self.schema, self.partition = spark, path, schema, tuple(partition)
        self._listed: tuple[tuple, DataFrame] | None = None

    def _fs(self):
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), root

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path, name)

    def _names(self) -> list[str]:
        fs, root = self._fs()
        return [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []

    def _complete(self, name: str) -> bool:
        fs, _ = self._fs()
        return fs.exists(self._path(f"{name}/_SUCCESS"))

    def parts(self, before: int | None = None) -> list[str]:
        """Folders that hold the rows of the epochs below ``before``."""
        names = self._names()
        folds = sorted((int(n[6:]) for n in names if n.startswith("part=f")), reverse=True)
        base = next((f for f in folds if (before is None or f < before) and self._complete(f"part=f{f}")), -1)
        epochs = sorted(int(n[6:]) for n in names if n.startswith("part=e"))
        return ([f"part=f{base}"] if base >= 0 else []) + [f"part=e{e}" for e in epochs if e > base and (before is None or e < before)]

    def write(self, rows: DataFrame, epoch: int) -> None:
        self._put(rows, f"part=e{epoch}")

    def _put(self, rows: DataFrame, name: str) -> None:
        rows, self._listed = rows.select(*self.schema.fieldNames()), None
        w = (rows.hint("rebalance", *self.partition) if self.partition else rows).write.mode("overwrite").option("compression", "zstd")
        (w.partitionBy(*self.partition) if self.partition else w).parquet(f"{self.path}/{name}")

    def read(self, before: int | None = None) -> DataFrame:
        """All rows with their ``epoch``; a fold's rows have its last one.

        Files are listed once for every state of the log, as a partitioned one has many
        folders; the folders' times tell a replaced epoch from the one before."""
        parts = self.parts(before)
        if not parts:
            fields = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields]
            return self.spark.range(1).select(*fields, F.lit(None).cast("long").alias("epoch")).where(F.lit(False))
        fs, _ = self._fs()
        state = tuple((p, fs.getFileStatus(self._path(p)).getModificationTime()) for p in parts)
        if self._listed is None or self._listed[0] != state:
            schema = T.StructType([*self.schema.fields, T.StructField("part", T.StringType())])
            rows = self.spark.read.option("basePath", self.path).schema(schema).parquet(*[f"{self.path}/{p}" for p in parts])
            self._listed = state, rows.withColumn("epoch", F.substring("part", 2, 20).cast("long")).select(*self.schema.fieldNames(), "epoch")
        return self._listed[1]

    def newest(self, key: Sequence[str], before: int | None = None, order: Sequence[str] = ()) -> DataFrame:
        """One row per key: of the last epoch, the last in ``order``."""
        return first_per_key(self.read(before), list(key), [F.col("epoch"), *[F.col(c) for c in order]], last=True).drop("epoch")

    def newest_group(self, key: Sequence[str], before: int | None = None) -> DataFrame:
        """All rows that the last epoch to write a key gave it."""
        last = F.max("epoch").over(Window.partitionBy(*key))
        return self.read(before).withColumn("_last", last).where("epoch = _last").drop("_last", "epoch")

    def fold(self, epoch: int, reduce: Callable[[DataFrame], DataFrame], most: int = 32) -> bool:
        """Once more than ``most`` folders are read, write what ``reduce`` makes of
        all up to ``epoch`` as one, and delete those.  ``reduce`` takes ``read()``'s
        rows and must give rows that later epochs combine with as with its input."""
        if len(self.parts(epoch + 1)) <= most:
            return False
        old = self._names()
        self._put(reduce(self.read(epoch + 1)), f"part=f{epoch}")
        fs, _ = self._fs()
        for name in old:
            if name[:5] == "part=" and int(name[6:]) <= epoch and name != f"part=f{epoch}":
                fs.delete(self._path(name), True)
        return True


def keep_newest(key: Sequence[str], order: Sequence[str] = ()) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: first_per_key(rows, list(key), [F.col("epoch"), *[F.col(c) for c in order]], last=True)


def keep_newest_group(key: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: rows.withColumn("_last", F.max("epoch").over(Window.partitionBy(*key))).where("epoch = _last").drop("_last")


def add_up(key: Sequence[str], *values: str) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: rows.groupBy(*key).agg(*[F.sum(v).alias(v) for v in values])
