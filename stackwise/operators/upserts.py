"""Keyed writes as joins of the old state with new rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_folder
from .ranking import first_per_key


def latest_wins(old: DataFrame, new: DataFrame, keys: list[str], order: list) -> DataFrame:
    """All columns replaced by the newest row of a key; within new, by order."""
    newest = first_per_key(new, keys, order)
    return old.join(newest.select(*keys), keys, "left_anti").unionByName(newest.select(old.columns))


def insert_only(old: DataFrame, new: DataFrame, keys: list[str], order: list) -> DataFrame:
    """New keys are added, known ones ignored; ``created`` tells which rows were added."""
    added = first_per_key(new, keys, order).join(old.select(*keys), keys, "left_anti")
    return old.withColumn("created_now", F.lit(False)).unionByName(added.select(old.columns).withColumn("created_now", F.lit(True)))


def merge_non_empty(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Per column the new value unless it is null or empty, else the old one."""
    n = new.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    merged = old.select(*keys, *columns).join(n, keys, "full_outer")
    return merged.select(*keys, *[F.coalesce(F.nullif(F.col(f"_{c}").cast("string"), F.lit("")), F.col(c).cast("string")).alias(c) for c in columns])


def merge_monotone(old: DataFrame, new: DataFrame, keys: list[str], never_down: list[str], fill: list[str]) -> DataFrame:
    """never_down columns only grow, and stay null only if one side was null (as a scalar maximum does); fill columns
    take the new value if there is one."""
    n = new.select(*keys, *[F.col(c).alias(f"_{c}") for c in [*never_down, *fill]])
    both = old.join(n, keys, "full_outer")
    up = [F.when(F.col(c).isNotNull() & F.col(f"_{c}").isNotNull(), F.greatest(c, f"_{c}")).alias(c) for c in never_down]
    return both.select(*keys, *up, *[F.coalesce(f"_{c}", c).alias(c) for c in fill])


def row_digest(*columns: str) -> Column:
    """32 bits of a row's digest, as a number that can be summed."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns])), 1, 8), 16, 10).cast("long")


def assign_ids(rows: DataFrame, natural_key: str, name: str) -> DataFrame:
    """Deterministic ids: the position of a string key in code point order.

    Keys are dealt by ranges of sampled bounds, whatever they begin with, and written with their range's number; each range
    is numbered by itself, after the counts of those before it. Only the counts are ordered in one place.
    """
    spark = rows.sparkSession
    path = shared_folder(spark)
    keys = rows.select(natural_key).where(F.col(natural_key).isNotNull()).distinct()
    keys.repartitionByRange(natural_key).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    keys = spark.read.parquet(path)
    so_far = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = keys.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(so_far), F.lit(0)).alias("_before"))
    numbered = keys.join(before, "_range").withColumn(name, F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy(natural_key)))
    return rows.join(numbered.select(natural_key, name), natural_key)
