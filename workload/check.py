"""Run queries beside their SQL twins: python -m workload.check SF_DIR [names...]"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("earshift-check")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(path: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    return con


def canonical(rows: list[tuple], columns: list[str]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if v is None or (isinstance(v, float) and v != v) or v is pd.NaT:
            return ""
        if isinstance(v, float):
            return repr(v + 0.0)
        return str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark_df, con, sql: str) -> str:
    """'' if equal, else what differs first."""
    rows = [tuple(r) for r in spark_df.collect()]
    cur = con.execute(sql)
    names, want = [d[0] for d in cur.description], cur.fetchall()
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    kinds = {d[0]: str(d[1]) for d in cur.description}
    for f in spark_df.schema.fields:
        a, b = f.dataType.simpleString(), kinds[f.name]
        same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
                "date": "DATE", "timestamp_ntz": "TIMESTAMP"}.get(a)
        if same and same != b and want:
            return f"type of {f.name}: {a} / {b}"
    a, b = canonical(rows, spark_df.columns), canonical(want, names)
    if a == b:
        return ""
    if len(a) != len(b):
        return f"{len(a)} rows, expected {len(b)}: {sorted(set(a) - set(b))[:2]} / {sorted(set(b) - set(a))[:2]}"
    return f"{sum(x != y for x, y in zip(a, b))} of {len(a)} rows differ: {sorted(set(a) - set(b))[:2]} / {sorted(set(b) - set(a))[:2]}"


def main(path: str, names: list[str]) -> int:
    from .adapters import Tables
    from .queries import ORACLES, QUERIES
    spark, con, bad = session(), connect(path), 0
    for name in names or QUERIES:
        start = time.time()
        try:
            df = QUERIES[name](Tables(spark, path))
            note = compare(df, con, ORACLES[name]) if name in ORACLES else f"no SQL, {df.count()} rows"
        except Exception as e:  # noqa: BLE001
            note = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(note) and name in ORACLES
        print(f"{name:28s} {time.time() - start:6.2f}s  {note or 'ok'}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
