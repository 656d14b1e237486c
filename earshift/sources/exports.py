"""Play-history export files: JSON arrays named Streaming_History_*.json, or the same
with gzip, Streaming_History_*.json.gz."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import EXPORT, KNOWN_EXPORT_FIELDS
from .jsonsplit import elements
from .payloads import utc

# Fixed value: file name pattern of the export, packed or not.
EXPORT_GLOB = "Streaming_History_*.json{,.gz}"
CORRUPT = "_corrupt_record"


def _reader(spark: SparkSession):
    return spark.read.option("pathGlobFilter", EXPORT_GLOB).option("multiLine", True)


def _scan(spark: SparkSession, path: str) -> DataFrame:
    """A file that does not parse gives one corrupt row and none of its data,
    so one bad file never sinks the run."""
    schema = T.StructType([*EXPORT.fields, T.StructField(CORRUPT, T.StringType())])
    return (
        _reader(spark).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
        .schema(schema).json(path)
        .withColumns({"ts": utc(F.col("ts")), "source_path": F.col("_metadata.file_path"), "source_file": F.col("_metadata.file_name")})
    )


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Good rows of all export files, with ``source_path`` and ``source_file``.

    Raises when the folder holds no export file.  ``ip_addr`` is never read.
    """
    require_exports(spark, path)
    # Spark refuses a scan that needs nothing but the corrupt column, as a bare
    # count does, so the filter always reads a data field too.
    reads_data = F.coalesce(F.length("platform"), F.lit(0)) >= 0
    return _scan(spark, path).where(F.col(CORRUPT).isNull() & reads_data).drop(CORRUPT)


def export_files(spark: SparkSession, path: str) -> DataFrame:
    """Export files found, with their size; file contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", EXPORT_GLOB).load(path).select(
        F.element_at(F.split("path", "/"), -1).alias("source_file"), "length")


def require_exports(spark: SparkSession, path: str) -> None:
    if not export_files(spark, path).limit(1).count():
        raise FileNotFoundError(f"no {EXPORT_GLOB} in {path}")


def file_health(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, rows, failed) per file.  Row fields are read so that Spark
    really parses every record."""
    scan = _scan(spark, path)
    bad = F.col(CORRUPT).isNotNull()
    parsed = F.count(F.when(~bad & F.coalesce(*[F.col(f).cast("string") for f in EXPORT.fieldNames()]).isNotNull(), 1))
    return scan.groupBy("source_file").agg(
        parsed.alias("n_rows"), F.max(bad).alias("failed"))


def export_parts(spark: SparkSession, path: str) -> DataFrame:
    """Every object of the export files as ``element``, with ``path`` and ``fine``,
    whether its file is a whole one.  A file is read by as many tasks as it has byte
    ranges; one without any object gives no row.  Raises for packed files, which have
    no byte ranges: ``read_export`` reads them."""
    if export_files(spark, path).where(F.col("source_file").endswith(".gz")).limit(1).count():
        raise ValueError(f"packed export files in {path} cannot be cut")
    rows, files = elements(spark, path, EXPORT_GLOB)
    return rows.join(files, "path")


def parse_parts(parts: DataFrame) -> DataFrame:
    schema = T.StructType([*EXPORT.fields, T.StructField(CORRUPT, T.StringType())])
    row = F.from_json("element", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return parts.select("path", "fine", "element", row.alias("_row"))


def read_split_export(spark: SparkSession, path: str) -> DataFrame:
    """The rows of ``read_export``, for files too large for one task.  A file that goes
    on after its array counts as broken, which the plain reader does not notice."""
    require_exports(spark, path)
    parsed = parse_parts(export_parts(spark, path)).where("fine").select("path", "_row.*")
    broken = parsed.where(F.col(CORRUPT).isNotNull()).select("path").distinct()  # one bad object spoils its file
    return parsed.join(broken, "path", "left_anti").withColumn("ts", utc(F.col("ts"))).select(
        *EXPORT.fieldNames(), F.col("path").alias("source_path"), F.element_at(F.split("path", "/"), -1).alias("source_file"))


def file_report(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, n_rows, failed, unknown) per file from one reading: its rows,
    none if any of it failed, and the fields that are not known with their merged
    types, nested ones too, as Spark writes a variant's schema."""
    parsed = parse_parts(export_parts(spark, path))
    bad = F.col("_row").isNull() | F.col(f"_row.{CORRUPT}").isNotNull() | ~F.col("fine")
    fields = F.from_json("element", "map<string,variant>")
    odd = F.map_filter(fields, lambda k, _: ~k.isin(*sorted(KNOWN_EXPORT_FIELDS)))
    return parsed.groupBy(F.element_at(F.split("path", "/"), -1).alias("source_file")).agg(
        F.when(F.max(bad), 0).otherwise(F.count(F.lit(1))).alias("n_rows"), F.max(bad).alias("failed"),
        F.schema_of_variant_agg(F.try_parse_json(F.to_json(odd))).alias("unknown"))


def schema_drift(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, unknown) of the files with fields that are not known."""
    return file_report(spark, path).where(~F.col("unknown").isin("OBJECT<>", "VOID")).select("source_file", "unknown")
