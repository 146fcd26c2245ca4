"""Faceted filters: every edition predicate must hold on the same edition, and links are only tested on that edition."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PROVIDERS = 64


@dataclass(frozen=True)
class Filters:
    kind: str | None = None
    year_from: int | None = None
    year_to: int | None = None
    genre: int | str | None = None
    quality: str | None = None
    hdr: str | None = None
    source: str | None = None
    complete: bool | None = None
    season: int | None = None
    has_backdrop: bool = False
    min_size: float | None = None
    max_size: float | None = None
    providers: tuple[str, ...] = ()
    include_deleted: bool = False

    def over(self, parsed: Filters) -> Filters:
        """Explicit values win over those parsed from a query; a parsed genre is consumed but never applied."""
        mine = {k: v for k, v in vars(self).items() if v not in (None, (), False)}
        return Filters(**(vars(parsed) | {"genre": None} | mine))


def apply_filters(items: DataFrame, editions: DataFrame, links: DataFrame, live: DataFrame, f: Filters) -> DataFrame:
    out = items
    if f.kind is not None:
        out = out.where(F.col("kind") == f.kind)
    if f.year_from is not None:
        out = out.where(F.col("year") >= f.year_from)
    if f.year_to is not None:
        out = out.where(F.col("year") <= f.year_to)
    if f.genre is not None and "genres" in items.columns:
        # one of an item's genres, in any case
        out = out.where(F.exists("genres", lambda g: F.lower(g) == str(f.genre).lower()))
    elif f.genre is not None:
        out = out.where(F.col("genre") == f.genre)
    if f.has_backdrop:
        out = out.where(F.col("backdrop").isNotNull() & (F.coalesce("overview", F.lit("")) != ""))
    e = editions
    if f.season is not None:
        e = e.where(F.lit(f.season).between(F.col("season_from"), F.coalesce("season_to", "season_from")))
    for c in ("quality", "hdr", "source", "complete"):
        if getattr(f, c) is not None:
            e = e.where(F.col(c) == getattr(f, c))
    if f.min_size is not None:
        e = e.where(F.col("size") >= f.min_size)
    if f.max_size is not None:
        e = e.where(F.col("size") <= f.max_size)
    pool = links if f.include_deleted else live
    if f.providers:
        e = e.join(pool.where(F.col("provider").isin(*f.providers[:MAX_PROVIDERS])), "edition_id", "left_semi")
    elif not f.include_deleted:
        e = e.join(live, "edition_id", "left_semi")
    return out.join(e, "item_id", "left_semi")


def either(items: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """Items that pass the local clauses or have a remote resource, each once."""
    ids = local.select("item_id").union(remote.select("item_id")).distinct()
    return items.join(ids, "item_id", "left_semi")
