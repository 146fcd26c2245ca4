"""Remote items: JSON of a foreign catalog, reduced to known members with known types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.links import remote_provider
from .ranking import first_per_key

ITEM = """slug string, title string, remark string, share_size string, video_resolution array<string>, source array<string>, subtitle_language array<string>,
  subtitle_type array<string>, unlock_points bigint, is_unlocked boolean, validate_status string, created_at string, last_validated_at string"""


def normalise_item(item: Column) -> Column:
    """struct of the known members of a JSON item, texts trimmed and null if empty, with its provider; null for text that
    is no object."""
    x = F.from_json(item, ITEM)
    raw = F.regexp_extract(item, r'"pan_type"\s*:\s*("[^"]*"|[^,}\s]+)', 1)
    names = [part.split()[0] for part in ITEM.replace("\n", " ").split(",")]
    text = lambda n: F.nullif(F.trim(x[n]), F.lit("")) if n in ("slug", "title", "remark", "share_size", "validate_status") else x[n]
    return F.when(item.rlike(r"^\s*\{"), F.struct(remote_provider(raw).alias("provider"), *[text(n).alias(n) for n in names]))


def merge_results(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """The union of two result lists by key; where both have one, the second's row."""
    return first.join(second.select(*keys), keys, "left_anti").unionByName(second, allowMissingColumns=True)


def pick_match(candidates: DataFrame, key: list[str], candidate: str, similarity: Column, least: float = 0.5) -> DataFrame:
    """Each key's most similar candidate, if it reaches ``least``; the lower id of equals."""
    rows = candidates.withColumn("similarity", F.round(similarity, 9)).where(F.col("similarity") >= least)
    return rows.groupBy(*key).agg(F.max_by(F.struct(candidate, "similarity"), F.struct("similarity", (-F.col(candidate)).alias("i"))).alias("m")).select(*key, f"m.{candidate}", "m.similarity")


def expected_kind(kind: Column, hinted: Column, known: dict[str, str]) -> Column:
    """The item's own type, else what its hint's type stands for, else a film."""
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.coalesce(F.when(kind.isin("movie", "tv"), kind), F.try_element_at(table, hinted), F.lit("movie"))


def upgraded(matched: DataFrame, backup: DataFrame, key: str, rank: str) -> DataFrame:
    """A backup pass after a match: rows keep what they have unless the backup ranks higher."""
    b = backup.select(key, *[F.col(c).alias(f"_{c}") for c in matched.columns if c != key])
    both = matched.join(b, key, "left")
    higher = F.coalesce(F.col(f"_{rank}") > F.coalesce(F.col(rank), F.lit(0)), F.lit(False))
    return both.select(key, *[F.when(higher, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in matched.columns if c != key])


def promote(items: DataFrame, remote: DataFrame, key: list[str], order: list) -> DataFrame:
    """items (key, name, aliases) with a new row for each remote row (key, name) that none of them stands for; a known
    item gets the remote names that it does not have as aliases."""
    named = remote.groupBy(*key).agg(F.array_sort(F.collect_set("name")).alias("names"))
    known = items.join(named, key, "left").withColumn("aliases", F.array_except(F.array_union("aliases", F.coalesce("names", F.array().cast("array<string>"))), F.array("name"))).drop("names")
    new = first_per_key(remote.join(items.select(*key), key, "left_anti"), key, order).join(named, key).withColumn("aliases", F.array_except("names", F.array("name")))
    return known.unionByName(new.select(items.columns))
