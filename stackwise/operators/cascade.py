"""Merged identities carried through a library: items, their editions, links, and what else points to them.

An identity map says which item another one became. It is closed first, so that chains end in the item that stays; then
every table is repointed in one pass. Editions that have one fingerprint under their new item are one edition, the lowest
id; links that stand for one share under their new edition are one link, the lowest id. Rows kept once an item (ratings,
hints) are the staying item's own, or else those of the lowest id that became it.

Defined results: an id that maps to itself, or is null on a side, is no change; of two entries of an id the lower target
counts; a loop is an error; ids outside the map stay; null fingerprints and shares are never equal; empty tables stay empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .ranking import first_per_key


@dataclass(frozen=True)
class Merged:
    items: DataFrame
    editions: DataFrame
    links: DataFrame
    once: dict[str, DataFrame]
    touched: DataFrame


def closed(changes: DataFrame) -> DataFrame:
    """old, new of a map old, new whose chains are followed to their end; each pass doubles the steps taken."""
    known = changes.where("old is not null and new is not null and old <> new").groupBy("old").agg(F.min("new").alias("new"))
    known = written(known, "map0")
    for i in range(1, 40):
        onward = known.select(F.col("old").alias("new"), F.col("new").alias("onward"))
        known = written(known.join(onward, "new", "left").select("old", F.coalesce("onward", "new").alias("new"), F.col("onward").isNotNull().alias("moved")), f"map{i}")
        if not known.where("old = new").isEmpty():
            raise ValueError("the identity map has a loop")
        if known.where("moved").isEmpty():
            return known.select("old", "new")
        known = known.select("old", "new")
    raise ValueError("the identity map has a loop")


def repointed(rows: DataFrame, column: str, changes: DataFrame) -> DataFrame:
    return rows.join(changes.select(F.col("old").alias(column), "new"), column, "left").withColumn(column, F.coalesce("new", column)).drop("new").select(rows.columns)


def folded(rows: DataFrame, ident: str, keys: list[str]) -> DataFrame:
    """old, new of rows that are another one by their keys: the one of the lowest id."""
    solid = rows.where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    same = solid.withColumn("new", F.min(ident).over(Window.partitionBy(*keys)))
    return same.where(F.col("new") != F.col(ident)).select(F.col(ident).alias("old"), "new")


def cascade(changes: DataFrame, items: DataFrame, editions: DataFrame, links: DataFrame, once: dict[str, DataFrame] | None = None) -> Merged:
    """changes: old, new (item ids); items: item_id; editions: edition_id, item_id, fingerprint; links: link_id, edition_id,
    share; once: tables with item_id, a row for each item. All with more columns, which stay. Only the groups of items that
    others became can fold, so no other row is compared; ``touched`` are these items (item_id)."""
    changes = closed(changes)
    touched = written(changes.select(F.col("new").alias("item_id")).distinct(), "touched")
    items = items.join(changes.select(F.col("old").alias("item_id")), "item_id", "left_anti")
    moved = written(repointed(editions, "item_id", changes), "editions")
    gone = written(folded(moved.join(touched, "item_id", "left_semi"), "edition_id", ["item_id", "fingerprint"]), "folded")
    editions = moved.join(gone.select(F.col("old").alias("edition_id")), "edition_id", "left_anti")
    links = written(repointed(links, "edition_id", gone), "links")
    kept = gone.select(F.col("new").alias("edition_id")).distinct()
    again = folded(links.join(kept, "edition_id", "left_semi"), "link_id", ["edition_id", "share"])
    links = links.join(again.select(F.col("old").alias("link_id")), "link_id", "left_anti")
    out = {}
    for name, rows in (once or {}).items():
        from_ = repointed(rows.withColumn("_was", F.col("item_id")), "item_id", changes)
        out[name] = first_per_key(from_, ["item_id"], [(F.col("_was") != F.col("item_id")), "_was"]).drop("_was")
    return Merged(items, editions, links, out, touched)


def orphans(m: Merged) -> DataFrame:
    """Rows that point to nothing: table, id. Empty for a library whose rows all had something to point to."""
    lost = lambda rows, name, ident, key, to: rows.join(to.select(key), key, "left_anti").select(F.lit(name).alias("table"), F.col(ident).alias("id"))
    out = lost(m.editions, "editions", "edition_id", "item_id", m.items).unionByName(lost(m.links, "links", "link_id", "edition_id", m.editions))
    for name, rows in m.once.items():
        out = out.unionByName(lost(rows, name, "item_id", "item_id", m.items))
    return out


def recounted(m: Merged, counts: DataFrame) -> DataFrame:
    """counts (item_id, editions, links) with the touched items counted anew; all others keep what was stored."""
    e = m.editions.join(m.touched, "item_id", "left_semi").select("item_id", "edition_id")
    per_edition = m.links.join(e, "edition_id").groupBy("edition_id").agg(F.count("*").alias("links"))
    new = m.touched.join(e.join(per_edition, "edition_id", "left").groupBy("item_id").agg(F.count("*").alias("editions"), F.coalesce(F.sum("links"), F.lit(0)).alias("links")), "item_id", "left").na.fill(0)
    stay = counts.join(m.items.select("item_id"), "item_id", "left_semi").join(m.touched, "item_id", "left_anti")
    return stay.select("item_id", "editions", "links").unionByName(new.select("item_id", "editions", "links"))
