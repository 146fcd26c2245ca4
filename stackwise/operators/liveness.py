"""The one rule of which links are live, and the counts that follow from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.catalog import PRIMARY

KEY = ["provider", "url_key"]


def live_links(links: DataFrame, checks: DataFrame) -> DataFrame:
    """Not deleted at the source and without an invalid check of the same (provider, url_key)."""
    bad = checks.where("status = 'invalid'").select(*KEY).distinct()
    return links.where("not deleted").join(bad, KEY, "left_anti")


def recount_editions(editions: DataFrame, live: DataFrame) -> DataFrame:
    """edition_id, item_id, link_count, has_primary; zero where nothing is live."""
    counts = live.groupBy("edition_id").agg(F.count("*").alias("n"), F.max((F.col("provider") == PRIMARY).cast("int")).alias("p"))
    rows = editions.select("edition_id", "item_id").join(counts, "edition_id", "left")
    return rows.select("edition_id", "item_id", F.coalesce("n", F.lit(0)).alias("link_count"), F.coalesce("p", F.lit(0)).alias("has_primary"))


def recount_items(items: DataFrame, recounted: DataFrame) -> DataFrame:
    """item_id, link_count (sum), has_primary (any), n_live_editions."""
    counts = recounted.groupBy("item_id").agg(F.sum("link_count").alias("n"), F.max("has_primary").alias("p"), F.count_if(F.col("link_count") > 0).alias("e"))
    rows = items.select("item_id").join(counts, "item_id", "left")
    return rows.select("item_id", F.coalesce("n", F.lit(0)).alias("link_count"), F.coalesce("p", F.lit(0)).alias("has_primary"), F.coalesce("e", F.lit(0)).alias("n_live_editions"))


def recount_subset(editions: DataFrame, live: DataFrame, ids: DataFrame) -> DataFrame:
    """The same recount for the editions in ids only; links of others are pruned before the count."""
    return recount_editions(editions.join(ids, "edition_id", "left_semi"), live.join(ids, "edition_id", "left_semi"))


def all_links_invalid(editions: DataFrame, links: DataFrame, live: DataFrame) -> DataFrame:
    """item_ids with links of which none is live."""
    ids = editions.select("edition_id", "item_id")
    linked = links.join(ids, "edition_id").select("item_id").distinct()
    alive = live.join(ids, "edition_id").select("item_id").distinct()
    return linked.join(alive, "item_id", "left_anti")


def provider_counts(links: DataFrame, checks: DataFrame) -> DataFrame:
    """Per provider: valid, invalid, unknown, unchecked (no check, or only queued) and due links."""
    rows = links.where("not deleted").join(checks.select(*KEY, "status", "priority_score"), KEY, "left")
    s = F.col("status")
    return rows.groupBy("provider").agg(
        F.count_if(s == "valid").alias("valid"), F.count_if(s == "invalid").alias("invalid"), F.count_if(s == "unknown").alias("unknown"),
        F.count_if(s.isNull() | (s == "queued")).alias("unchecked"), F.count_if(s.isNull() | (F.col("priority_score") < 3000)).alias("due"),
    )
