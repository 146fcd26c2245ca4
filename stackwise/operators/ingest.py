"""Batch ingest: row repair, link explosion, keep-first folding into links, editions and items."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.catalog import identity, parse_title
from ..functions.editions import fingerprint, item_kind, parse_edition
from ..functions.links import canonical_hash, parse_link
from ..session import shared_folder, written


def judge_confirmations(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Outcome of every row: a reason, or accepted for the first good row of an item; bad rows don't take its place."""
    j = rows.join(known.withColumn("found", F.lit(True)), "item_id", "left")
    reason = F.when(F.col("t").isNull(), "bad_row").when(F.col("found").isNull(), "missing").when(F.col("known_t") != F.col("t"), "title_mismatch").when(F.col("known_y") != F.col("y"), "year_mismatch")
    good = reason.isNull()
    nth = F.row_number().over(Window.partitionBy("item_id", good).orderBy("row_no"))
    return j.withColumn("outcome", F.coalesce(reason, F.when(nth > 1, "duplicate").otherwise("accepted")))


def is_shifted(link: Column, note: Column) -> Column:
    """The link cell holds no link while the note cell does."""
    has = r"^(https?|ed2k|magnet):"
    return ~F.coalesce(link, F.lit("")).rlike(has) & F.coalesce(note, F.lit("")).rlike(has)


def repair_shifted(rows: DataFrame) -> DataFrame:
    """Moves link and note one column back where is_shifted; other rows stay as they are."""
    s = is_shifted(F.col("link"), F.col("note"))
    return rows.withColumns({"repaired": s, "link": F.when(s, F.col("note")).otherwise(F.col("link")), "note": F.when(s, F.lit(None).cast("string")).otherwise(F.col("note"))})


def split_links(cell: Column) -> Column:
    """Fragments of a cell that packs several links."""
    return F.filter(F.transform(F.split(cell, r"(?=ed2k://|magnet:|https?://)"), lambda x: F.trim(x)), lambda x: x != "")


def parsed_once(rows: DataFrame, texts: list[str], parse: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows with the columns that ``parse`` adds to their texts. Each combination of texts is parsed once, however many rows
    repeat it, and dealt by itself, however few files the rows come from; texts may be null. What was parsed is written, so
    that Spark knows its size: if it is small, rows stay where they are. Texts that never repeat cost a join more."""
    names = [f"_{t}" for t in texts]
    known = written(parse(rows.select(*texts).distinct()).withColumnsRenamed(dict(zip(texts, names, strict=True))), "parsed")
    return rows.join(known, reduce(lambda a, b: a & b, [F.col(t).eqNullSafe(F.col(n)) for t, n in zip(texts, names, strict=True)])).drop(*names)


def fold_links(rows: DataFrame, key: list[str], order: list[str], holder: str) -> tuple[DataFrame, DataFrame]:
    """(links, flags). The first row of a key gives the link its holder; created is the least of all its rows, deleted the
    greatest only if every row is deleted. flags: holders that share a link with another one. Rows combine before they
    are moved."""
    links = rows.groupBy(*key).agg(
        F.min_by(holder, F.struct(*order)).alias("holder"), F.min("created").alias("created"),
        F.when(F.count("deleted_at") == F.count("*"), F.max("deleted_at")).alias("deleted_at"), F.count("*").alias("occurrences"), F.countDistinct(holder).alias("holders"),
    )
    shared = rows.join(links.where("holders > 1").select(*key), key, "left_semi").select(F.col(holder).alias("holder")).distinct()
    return links, shared


def fold_library(rows: DataFrame, known_kinds: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Sheet rows folded into items, editions, links and provenance.

    rows: source_priority, row_no, title, preferred, link, code, note, created, deleted (epoch seconds, null: unknown, and
    not deleted), and kind, if known_kinds is to drop others. Shifted rows are repaired and cells with several links split.
    Main rows (source_priority 0) stand in order of created, others in that of their sheet. The first row with a link gives
    it its edition; a later one adds its times, and another edition only if its own is a different one, which flags both.

    items: identity, title, aliases, original, year, kind. editions: identity, fingerprint, edition, created, reasons.
    links: provider, link_hash, identity, fingerprint, note, url, label, access_code, occurrences, code_conflicts, created,
    deleted (only if every row is), shared. provenance: a row for each fragment.
    """
    if known_kinds:
        rows = rows.where(F.col("kind").isin(*known_kinds))
    r = repair_shifted(rows).select("*", F.posexplode(split_links(F.coalesce("link", F.lit("")))).alias("fragment", "part"))
    # links first, while rows are narrow
    r = parsed_once(r.drop("kind"), ["part", "code"], _linked)
    r = parsed_once(r, ["title", "preferred", "note"], _named)
    reasons = F.array_compact(F.array(F.when(F.col("e.unparsed"), "unparsed_edition"), F.when(F.col("provider") == "unknown", "unknown_provider"), F.when(F.col("created").isNull(), "timestamp_missing"), F.when(F.col("l.conflict"), "access_code_conflict"), F.when(F.col("repaired"), "shifted_row")))
    # a number for each place in the order, nulls last
    main = F.when(F.col("source_priority") == 0, F.coalesce("created", F.lit(2**62))).otherwise(0)
    r = r.withColumns({"reasons": reasons, "at": F.struct("source_priority", main.alias("by_time"), "row_no", "fragment"), "holder": F.struct("identity", "fingerprint")})
    # parsed once: several results are made of it
    path = shared_folder(rows.sparkSession)
    r.drop("link").write.parquet(path)
    r = rows.sparkSession.read.parquet(path)
    key = ["provider", "link_hash"]
    first = F.min_by(F.struct("holder", "note", F.col("part").alias("url"), F.col("l.label").alias("label"), F.col("l.access_code").alias("access_code")), "at").alias("f")
    links = r.groupBy(*key).agg(
        first, F.count("*").alias("occurrences"), F.min("created").alias("created"), F.when(F.count("deleted") == F.count("*"), F.max("deleted")).alias("deleted"),
        (F.min("holder") != F.max("holder")).alias("shared"),
    )
    marked = r.join(links.select(*key, F.col("f.holder").alias("first_holder"), F.col("f.access_code").alias("first_code"), "shared"), key)
    conflicts = marked.groupBy(*key).agg(F.count_if(F.coalesce(F.col("l.access_code") != F.col("first_code"), F.lit(False))).alias("code_conflicts"))
    links = links.join(conflicts, key).select(*key, "f.holder.identity", "f.holder.fingerprint", "f.note", "f.url", "f.label", "f.access_code", "occurrences", "code_conflicts", "created", "deleted", "shared")
    # rows that create something: a link's first one, and those whose edition is another than their link's
    w = Window.partitionBy(*key).orderBy("at")
    makers = marked.withColumn("nth", F.row_number().over(w)).where((F.col("nth") == 1) | (F.col("holder") != F.col("first_holder")))
    told = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("shared"), F.array_union("reasons", F.array(F.lit("link_shared_across_groups")))).otherwise(F.col("reasons"))))))
    held = links.groupBy("identity", "fingerprint").agg(F.min("created").alias("created"))
    editions = makers.groupBy("identity", "fingerprint").agg(F.min_by("e", "at").alias("edition"), told.alias("reasons")).join(held, ["identity", "fingerprint"], "left")
    items = makers.groupBy("identity").agg(
        F.min_by("t", "at").alias("t"), F.min_by("kind", "at").alias("kind"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("t.aliases")))).alias("aliases"),
        F.min_by("t.original", F.when(F.col("t.original").isNotNull(), F.col("at"))).alias("original"),
    ).select("identity", "t.title", "aliases", "original", "t.year", "kind")
    return {"items": items, "editions": editions, "links": links, "provenance": marked.select("source_priority", "row_no", "fragment", *key, "identity", "fingerprint", "reasons")}


def _linked(texts: DataFrame) -> DataFrame:
    r = texts.withColumn("l", parse_link(F.col("part"), F.col("code")))
    return r.withColumns({"link_hash": canonical_hash(F.col("l.canonical")), "provider": F.col("l.provider")})


def _named(texts: DataFrame) -> DataFrame:
    """What title, preferred and note say of item and edition."""
    e = parse_edition(F.coalesce("note", F.lit("")), F.coalesce("title", F.lit("")))
    r = texts.withColumns({"t": parse_title(F.col("title"), F.col("preferred")), "e": e})
    r = r.withColumns({"kind": item_kind(F.col("e"), F.concat_ws(" ", "title", "preferred", "note")), "fingerprint": fingerprint(F.col("e"))})
    return r.withColumn("identity", identity(F.col("kind"), F.lit(None).cast("string"), F.col("t.title"), F.col("t.year")))


def holder_created(links: DataFrame) -> DataFrame:
    return links.groupBy("holder").agg(F.min("created").alias("created"), F.count("*").alias("links"), F.count_if(F.col("deleted_at").isNull()).alias("open_links"))
