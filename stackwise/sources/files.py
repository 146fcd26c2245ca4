"""Sources and sinks: ordered unions, JSON lines, located spreadsheet headers, staged publication with one backup."""

from __future__ import annotations

import csv
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ordered_union(sources: list[DataFrame]) -> DataFrame:
    """Rows of all sources with their source_priority, the position in the list."""
    tagged = [s.withColumn("source_priority", F.lit(i)) for i, s in enumerate(sources)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines, compressed or not by extension; malformed lines give null columns. A missing path is an empty table."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def clean_header(cell) -> str:
    return str(cell or "").replace("﻿", "").strip()


def locate_header(rows: Iterable[list], marker: str, required: list[str], within: int = 20) -> tuple[int, dict[str, int]]:
    """Row index and column positions of the first of the leading rows that has the marker cell."""
    for i, row in enumerate(rows):
        if i >= within:
            break
        names = [clean_header(c) for c in row]
        if marker in names:
            missing = [r for r in required if r not in names]
            if missing:
                raise ValueError(f"columns are missing: {missing}")
            return i, {n: names.index(n) for n in required}
    raise ValueError(f"no header with {marker!r} in the first {within} rows")


def read_sheet(spark: SparkSession, path: str, marker: str, required: list[str], sheet: str | None = None) -> DataFrame:
    """A worksheet (or a CSV export of one) with its real row numbers; rows with a blank marker are skipped.

    Workbooks are parsed on the driver, one at a time: they are single files of at most a few hundred thousand rows.
    """
    if path.endswith(".csv"):
        with open(path, newline="", encoding="utf-8-sig") as f:
            rows = list(csv.reader(f))
    else:
        try:
            import openpyxl
        except ImportError as e:
            raise RuntimeError("reading .xlsx needs openpyxl; export the sheet as CSV instead") from e
        book = openpyxl.load_workbook(path, read_only=True, data_only=True)
        rows = [list(r) for r in (book[sheet] if sheet else book.worksheets[0]).iter_rows(values_only=True)]
    at, where = locate_header(rows, marker, required)
    out = []
    for i, row in enumerate(rows[at + 1 :], at + 2):
        cell = lambda n: row[where[n]] if where[n] < len(row) else None  # noqa: B023, E731
        if clean_header(cell(marker)):
            out.append((i, *[None if cell(n) is None else str(cell(n)) for n in required]))
    schema = T.StructType([T.StructField("row_number", T.IntegerType()), *[T.StructField(n, T.StringType()) for n in required]])
    return spark.createDataFrame(out, schema)


def publish(df: DataFrame, root: str, check=None) -> str:
    """Writes a new version, checks it, and only then makes it the current one; the one before stays as the backup."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(conf)
    path = lambda name: jvm.org.apache.hadoop.fs.Path(base, name)
    df.write.mode("overwrite").parquet(f"{root}/staging")
    if check is not None and not check(spark.read.parquet(f"{root}/staging")):
        fs.delete(path("staging"), True)
        raise ValueError("the new version is not valid; nothing was replaced")
    if fs.exists(path("current")):
        fs.delete(path("backup"), True)
        fs.rename(path("current"), path("backup"))
    fs.rename(path("staging"), path("current"))
    return f"{root}/current"


def rollback(spark: SparkSession, root: str) -> str:
    """Makes the backup the current version again."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    path = lambda name: jvm.org.apache.hadoop.fs.Path(base, name)
    if not fs.exists(path("backup")):
        raise ValueError("there is no backup")
    fs.delete(path("current"), True)
    fs.rename(path("backup"), path("current"))
    return f"{root}/current"
