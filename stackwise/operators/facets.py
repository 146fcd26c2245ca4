"""Facet counts over live rows and the summaries built from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def facets(items: DataFrame, editions: DataFrame, live: DataFrame) -> DataFrame:
    """facet, value, n, position: types by value, years descending, the others by count and then value."""
    e = editions.join(live, "edition_id", "left_semi")
    shown = items.join(e, "item_id", "left_semi")

    def counts(df: DataFrame, columns: list[str]) -> DataFrame:
        """All of a table's facets in one pass over it."""
        if len(columns) == 1:
            g = df.groupBy(*columns).agg(F.count("*").alias("n"))
            picked = F.struct(F.lit(columns[0]).alias("facet"), F.col(columns[0]).cast("string").alias("value"))
        else:
            g = df.groupingSets([(c,) for c in columns], *columns).agg(F.count("*").alias("n"), *[F.grouping(c).alias(f"_{c}") for c in columns])
            picked = F.coalesce(*[F.when(F.col(f"_{c}") == 0, F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value"))) for c in columns])
        return g.select(picked.alias("p"), "n").select("p.facet", "p.value", "n").where("value is not null")

    parts = [counts(shown, ["kind", "year", "genre"]), counts(live, ["provider"]), counts(e, ["quality", "hdr"])]
    rows = reduce(DataFrame.unionByName, parts)
    by_year = F.when(F.col("facet") == "year", -F.col("value").try_cast("int"))
    by_count = F.when(~F.col("facet").isin("year", "kind"), -F.col("n"))
    # facets are few values a facet, so ranking them is small
    w = Window.partitionBy("facet").orderBy(by_year.asc_nulls_last(), by_count.asc_nulls_last(), "value")
    return rows.withColumn("position", F.row_number().over(w))


def status_totals(rows: DataFrame, column: str, known: list[str]) -> DataFrame:
    """Counts by status with zeros for known ones that don't occur."""
    base = rows.sparkSession.createDataFrame([(k,) for k in known], "status string")
    counts = rows.groupBy(F.col(column).alias("status")).agg(F.count("*").alias("c"))
    return base.join(counts, "status", "left").select("status", F.coalesce("c", F.lit(0)).alias("n"))


def merge_facets(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Full outer sum of two (value, n) facets."""
    a, b = local.select("value", F.col("n").alias("a")), remote.select("value", F.col("n").alias("b"))
    return a.join(b, "value", "full_outer").select("value", (F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0))).alias("n"))


def provider_order(column: str, fixed: list[str]):
    """Sort key: known providers in their fixed order, others last by name."""
    at = F.array_position(F.array(*map(F.lit, fixed)), F.col(column))
    return [F.when(at == 0, len(fixed) + 1).otherwise(at), F.col(column)]


def resource_summary(rows: DataFrame, fixed: list[str]) -> DataFrame:
    """Per edition: count, unlocked count, providers in fixed order, and state none/unlocked/partial/candidate."""
    order = F.array(*map(F.lit, fixed))
    agg = rows.groupBy("edition_id").agg(F.count("*").alias("n"), F.count_if(~F.col("deleted")).alias("unlocked"), F.collect_set("provider").alias("ps"))
    state = F.when(F.col("n") == 0, "none").when(F.col("unlocked") == F.col("n"), "unlocked").when(F.col("unlocked") > 0, "partial").otherwise("candidate")
    return agg.select("edition_id", "n", "unlocked", F.array_join(F.filter(order, lambda p: F.array_contains("ps", p)), ",").alias("providers"), state.alias("state"))
