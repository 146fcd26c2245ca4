"""Per-group selection and deterministic ordering. Every order ends in a unique key, so results never depend on row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(rows: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key in the given order. Spark limits each key to one row in every task before rows are moved
    (WindowGroupLimit), so a hot key sends a row for each task, not all of its rows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def top_per_key(rows: DataFrame, keys: list, order: list, n: int, name: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)


def sample(rows: DataFrame, keys: list[str], n: int, seed: int) -> DataFrame:
    """n rows in the order of a seeded digest of their key: the same ones however rows are dealt; the limit is the feature."""
    return rows.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])), *keys).limit(n)


def only_singles(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key no other row has."""
    return rows.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where("_n = 1").drop("_n")


def round_robin(rows: DataFrame, lane: str, order: list, limit: int) -> DataFrame:
    """One row of each lane in turn, lanes by name, until limit."""
    picked = top_per_key(rows, [lane], order, limit, "turn")
    return picked.orderBy("turn", lane).limit(limit)


def page(rows: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of ``size`` rows, empty beyond the last; the limit is the feature."""
    if number < 1 or not 1 <= size <= 50:
        raise ValueError("page must be at least 1 and page_size between 1 and 50")
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def sort_keys(kind: str) -> list[Column]:
    """year_desc, year_asc (nulls last in both), links_desc, relevance."""
    year = {"year_desc": F.col("year").desc_nulls_last(), "year_asc": F.col("year").asc_nulls_last()}
    if kind in year:
        return [year[kind], F.col("item_id")]
    if kind == "links_desc":
        return [F.col("link_count").desc(), F.col("item_id")]
    return [F.col("has_primary").desc(), F.col("link_count").desc(), F.col("item_id")]


def daily_order(ids: DataFrame, column: str, day: str, version: str, limit: int = 12) -> DataFrame:
    """The day's selection: ids in the order of sha256("day|version|id"), at most 24."""
    key = F.sha2(F.concat_ws("|", F.lit(day), F.lit(version), F.col(column).cast("string")), 256)
    return ids.select(column, key.alias("sort_key")).orderBy("sort_key").limit(min(limit, 24))


def two_day_start(day: Column) -> Column:
    """First day of the two-day period, periods counted from the proleptic ordinal."""
    return F.date_sub(day, F.pmod(F.datediff(day, F.lit("1970-01-01").cast("date")) + 719_163, F.lit(2)))


def keyset_after(rows: DataFrame, key: str, cursor, limit: int) -> DataFrame:
    """The next rows of a resumable pass: key above the cursor, in key order."""
    if cursor is not None:
        rows = rows.where(F.col(key) > cursor)
    return rows.orderBy(key).limit(limit)
