"""Attribute tables: CSV with its label column, SQLite tables and views, saved attribute stores."""

from __future__ import annotations

import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.labels import cast_integral, duplicate_keys


def read_attributes_csv(spark: SparkSession, path: str, label: str, separator: str = ",") -> DataFrame:
    """All columns as doubles (whole ones as longs), the label as a long read on its own, so that large
    labels stay exact.  A header's leading # is dropped."""
    head = spark.read.text(path).first().value
    names = [n.strip() for n in head.lstrip("#").split(separator)]
    if label not in names:
        raise ValueError(f"no column {label!r} among {names}")
    schema = T.StructType([T.StructField(n, T.LongType() if n == label else T.DoubleType()) for n in names])
    table = spark.read.csv(path, sep=separator, header=True, schema=schema, enforceSchema=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return cast_integral(checked(table, label), label)


def checked(table: DataFrame, label: str) -> DataFrame:
    """The table, if no label occurs twice."""
    twice = duplicate_keys(table, label).limit(1).collect()
    if twice:
        raise ValueError(f"label {twice[0].label} occurs {twice[0].n} times")
    return table


def read_relabel_csv(spark: SparkSession, path: str) -> DataFrame:
    """(id, type) of a two-column file with a header; a line splits at its last comma."""
    lines = spark.read.text(path).where(F.col("value") != spark.read.text(path).first().value)
    return lines.select(F.regexp_extract("value", r"^(.*),", 1).cast("long").alias("id"), F.regexp_extract("value", r",([^,]*)$", 1).cast("long").alias("type"))


def sqlite_schema(path: str, table: str | None = None) -> tuple[str, list[str], str]:
    """(table, columns, key): by default the first table, and its primary key or first column."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        table = table or db.execute("SELECT name FROM sqlite_master WHERE type = 'table' LIMIT 1").fetchone()[0]
        info = db.execute("SELECT name, pk FROM pragma_table_info(?) ORDER BY cid", (table,)).fetchall()
    if not info:
        raise ValueError(f"no table or view {table!r}")
    return table, [n for n, _ in info], next((n for n, pk in info if pk), info[0][0])


def read_sqlite(spark: SparkSession, path: str, table: str | None = None, batch: int = 50_000) -> DataFrame:
    """A table or view of a database on the driver's disk; it is a dimension, read in batches."""
    name, columns, _ = sqlite_schema(path, table)
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        quoted = name.replace('"', '""')
        cursor = db.execute(f'SELECT * FROM "{quoted}"')
        parts = []
        while rows := cursor.fetchmany(batch):
            parts += rows
    kinds = [T.StringType() if any(isinstance(v, str) for v in c) else T.DoubleType() if any(isinstance(v, float) for v in c) else T.LongType() for c in (zip(*parts) if parts else [()] * len(columns))]
    rows = [tuple(float(v) if isinstance(k, T.DoubleType) and v is not None else v for v, k in zip(r, kinds)) for r in parts]
    return spark.createDataFrame(rows, T.StructType([T.StructField(c, k) for c, k in zip(columns, kinds)]))


def write_csv(df: DataFrame, path: str) -> None:
    """Columns by name; whole doubles print as whole numbers."""
    columns = []
    for c, kind in sorted(df.dtypes):
        whole = F.col(c) == F.floor(F.col(c).cast("double")) if kind in ("double", "float") else None
        columns.append((F.when(whole, F.col(c).cast("long").cast("string")).otherwise(F.col(c).cast("string")) if whole is not None else F.col(c)).alias(c))
    df.select(*columns).write.csv(path, header=True)


def save_attributes(table: DataFrame, info: DataFrame, path: str) -> None:
    """Attribute and info tables side by side; refuses to overwrite."""
    table.write.mode("errorifexists").parquet(f"{path}/attributes")
    info.write.mode("errorifexists").parquet(f"{path}/info")


def open_or_compute(spark: SparkSession, path: str, compute) -> DataFrame:
    """The stored attributes if they exist, else those that ``compute`` gives, stored."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/attributes/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        compute().write.mode("overwrite").parquet(f"{path}/attributes")
    return spark.read.parquet(f"{path}/attributes")
