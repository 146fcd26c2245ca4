"""The verdict ladder: staged evaluation of an item's evidence, over recorded answers of a remote catalog.

Each step judges the items that it can decide; only the others go on to the next one, so the costlier evidence is joined
for fewer keys. Answers are a table (endpoint, ask, status, error_class, results); a request that was never recorded
counts as failed. A transport failure leaves an item without a verdict, to be tried again, and is never taken for "asked
and found nothing".

1. ``confirmed`` hints name an id: a known other type is a conflict without any request; an id that the catalog still
   serves, with the item's year (one year off at most) and, where the hint has an IMDb id, that one's own mapping, is exact;
   a conflict goes to review; an id that is gone sends the item to the search, and nowhere else.
2. proposed hints have an IMDb id: its results of the expected type are judged with the hint's titles as further names;
   ``proposed_review`` is a candidate at best; results of the other type alone go to review.
3. the search by title; by an alias with a Latin word if that finds nothing; and, if the verdict is unmatched or review,
   once more in English, both lists judged together.
4. an unmatched series is looked for by name in a second catalog, whose IMDb id is then judged as in 2.

Defined results: null and empty titles and names are like nothing; equal scores stand in the order of the answer; of an
answer recorded twice the newest counts; repeated keys of items or hints are judged as one (the first hint by decision and
id); an empty table of items gives no verdicts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import similarity
from ..session import written
from .ranking import first_per_key
from .resolve import CANDIDATE, EXACT, MARGIN, year_score

# fixed values: decisions, what a hint's type stands for, the least similarity of a name in the second catalog
CONFIRMED = "confirmed"
PROPOSED = ["proposed_exact", "proposed_candidate", "proposed_review"]
KIND_OF_HINT = {"movie": "movie", "tvMovie": "movie", "tvSeries": "tv", "tvMiniSeries": "tv", "tvSpecial": "tv"}
LEAST_NAME = 0.5
TOP = 5

RESULT = "struct<id: bigint, kind: string, title: string, name: string, original_title: string, original_name: string, year: int, imdb_id: string>"
VERDICT = ["key", "verdict", "ext_id", "ext_kind", "score", "top", "lane", "source", "imdb_id", "note", "error"]


def answered(asks: DataFrame, answers: DataFrame, endpoint: str, name: str) -> DataFrame:
    """asks (key, ask, ...) with ``name``: struct of status, error_class and results. A null ask is none: its status is null."""
    one = first_per_key(answers.where(F.col("endpoint") == endpoint), ["ask"], [F.desc("fetched_at"), "status"])
    got = F.struct("status", "error_class", F.coalesce("results", F.array().cast(f"array<{RESULT}>")).alias("results"))
    none = F.struct(F.lit("failed_retryable").alias("status"), F.lit("not_recorded").alias("error_class"), F.array().cast(f"array<{RESULT}>").alias("results"))
    return asks.join(one.select("ask", got.alias("_got")), "ask", "left").withColumn(name, F.when(F.col("ask").isNotNull(), F.coalesce("_got", none))).drop("_got", "ask")


def usable(answer: str) -> Column:
    return F.coalesce(F.col(f"{answer}.status").isin("ok", "empty"), F.lit(False))


def judged(asked: DataFrame) -> DataFrame:
    """key, verdict, ext_id, ext_kind, score, top of asked (key, queries, year, kind, results): the similarity of the best
    pair of a query and one of the result's names, and the year; a film found for a series loses half."""
    rows = asked.select("key", "queries", "year", "kind", F.posexplode("results").alias("pos", "r")).where(F.coalesce(F.col("r.kind") != "person", F.lit(True)))
    names = F.array_compact(F.array("r.title", "r.name", "r.original_title", "r.original_name"))
    pairs = rows.select("key", "pos", F.explode(names).alias("n"), "queries").select("key", "pos", "n", F.explode("queries").alias("q")).where("n <> '' and q <> ''").distinct()
    near = pairs.groupBy("key", "pos").agg(F.max(similarity("q", "n")).alias("near"))
    kind = F.coalesce("r.kind", "kind")
    score = F.coalesce("near", F.lit(0.0)) + year_score(F.col("r.year"), F.col("year")) - F.when((F.col("kind") == "tv") & (kind == "movie"), 0.5).otherwise(0.0)
    scored = rows.join(near, ["key", "pos"], "left").select("key", "pos", F.col("r.id").alias("id"), kind.alias("k"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 9).alias("score"))
    w = Window.partitionBy("key").orderBy(F.desc("score"), "pos")
    best = scored.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= TOP).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rn", "id", "k", "score"))).alias("t"))
    first, second = F.get("t", 0), F.coalesce(F.get("t", 1)["score"], F.lit(0.0))
    verdict = F.when(first["score"].isNull(), "unmatched").when((first["score"] >= EXACT) & (F.round(first["score"] - second, 9) >= MARGIN), "exact").when(first["score"] >= CANDIDATE, "candidate").otherwise("needs_review")
    out = asked.select("key").join(best, "key", "left").withColumn("verdict", verdict)
    matched = F.col("verdict").isin("exact", "candidate")
    top = F.coalesce(F.transform("t", lambda x: x["id"]), F.array().cast("array<bigint>"))
    return out.select("key", "verdict", F.when(matched, first["id"]).alias("ext_id"), F.when(matched, first["k"]).alias("ext_kind"), F.coalesce(first["score"], F.lit(0.0)).alias("score"), top.alias("top"))


def _verdicts(rows: DataFrame, **given: Column) -> DataFrame:
    """rows in the columns of VERDICT; what is not given is null."""
    types = {"ext_id": "bigint", "score": "double", "top": "array<bigint>"}
    have = lambda c: given[c] if c in given else F.col(c) if c in rows.columns else F.lit(None)
    return rows.select("key", *[have(c).cast(types.get(c, "string")).alias(c) for c in VERDICT[1:]])


def _review(rows: DataFrame, note: Column, lane: str, **given: Column) -> DataFrame:
    return _verdicts(rows, verdict=F.lit("needs_review"), score=F.lit(0.0), note=note, lane=F.lit(lane), **given)


def of_kind(results: str, kind: Column, same: bool = True) -> Column:
    return F.filter(results, lambda r: (r["kind"] == kind) if same else ~F.coalesce(r["kind"] == kind, F.lit(False)))


def by_confirmed(items: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verdicts, key and id of items whose id the catalog no longer serves)."""
    h = items.where((F.col("hint.decision") == CONFIRMED) & F.col("hint.ext_id").isNotNull() & F.col("hint.ext_kind").isin("movie", "tv"))
    source = {"source": F.lit("confirmation"), "imdb_id": F.col("hint.imdb_id"), "top": F.array("hint.ext_id")}
    clash = ~F.col("kind").isin(F.lit("unknown"), F.col("hint.ext_kind"))
    out = [_review(h.where(clash), F.lit("type"), "confirmed", **source)]
    rows = answered(h.where(~clash).withColumn("ask", F.concat_ws(":", "hint.ext_kind", F.col("hint.ext_id").cast("string"))), answers, "details", "d")
    detail = F.get("d.results", 0)
    served = (F.col("d.status") == "ok") & F.coalesce(detail["id"] == F.col("hint.ext_id"), F.lit(False))
    failed = F.col("d.status") == "failed_retryable"
    out.append(_verdicts(rows.where(~served & failed), lane=F.lit("confirmed"), error=F.col("d.error_class")))
    gone = rows.where(~served & ~failed).select("key", F.col("hint.ext_id").alias("gone"))
    other_year = F.coalesce(F.abs(F.col("year") - detail["year"]) > 1, F.lit(False))
    out.append(_review(rows.where(served & other_year), F.lit("year"), "confirmed", **source))
    rows = answered(rows.where(served & ~other_year).withColumn("ask", F.col("hint.imdb_id")), answers, "find", "f")
    lost = F.coalesce(F.col("f.status") == "failed_retryable", F.lit(False))
    out.append(_verdicts(rows.where(lost), lane=F.lit("confirmed"), error=F.col("f.error_class")))
    mapped = F.col("f").isNull() | F.exists("f.results", lambda r: (r["id"] == F.col("hint.ext_id")) & (r["kind"] == F.col("hint.ext_kind")))
    out.append(_review(rows.where(~lost & ~mapped), F.lit("imdb_identity"), "confirmed", **source))
    sure = {"verdict": F.lit("exact"), "ext_id": F.col("hint.ext_id"), "ext_kind": F.col("hint.ext_kind"), "score": F.lit(1.0), "lane": F.lit("confirmed")}
    out.append(_verdicts(rows.where(~lost & mapped), **sure, **source))
    return reduce(DataFrame.unionByName, out), gone


def by_hint(items: DataFrame, answers: DataFrame) -> DataFrame:
    h = items.where(F.col("hint.decision").isin(PROPOSED) & F.col("hint.imdb_id").isNotNull()).withColumn("ask", F.col("hint.imdb_id"))
    known = F.create_map(*[F.lit(x) for kv in KIND_OF_HINT.items() for x in kv])
    kind = F.when(F.col("kind").isin("movie", "tv"), F.col("kind")).otherwise(F.coalesce(F.try_element_at(known, "hint.imdb_type"), F.lit("movie")))
    rows = answered(h, answers, "find", "f").where(usable("f")).withColumn("own", F.col("kind")).withColumn("kind", kind)
    rows = rows.withColumns({"expected": of_kind("f.results", F.col("kind")), "other": of_kind("f.results", F.col("kind"), same=False)})
    more = F.array_compact(F.array("hint.primary_title", "hint.original_title"))
    found = rows.where(F.size("expected") > 0)
    v = judged(found.select("key", F.concat("queries", more).alias("queries"), "year", "kind", F.col("expected").alias("results"))).join(found.select("key", "hint"), "key")
    capped = (F.col("verdict") == "exact") & (F.col("hint.decision") == "proposed_review")
    source = {"source": F.lit("imdb_hint"), "imdb_id": F.col("hint.imdb_id"), "lane": F.lit("hint")}
    out = _verdicts(v, verdict=F.when(capped, "candidate").otherwise(F.col("verdict")), note=F.when(capped, "hint_review"), **source)
    wrong = rows.where((F.size("expected") == 0) & (F.size("other") > 0))
    top = judged(wrong.select("key", "queries", "year", "kind", F.slice("other", 1, TOP).alias("results")))
    # the others are shown in the order of the answer
    shown = F.transform(F.filter(F.slice("other", 1, TOP), lambda r: F.coalesce(r["kind"] != "person", F.lit(True))), lambda r: r["id"])
    wrong = wrong.join(top.select("key"), "key").select("key", "hint", shown.alias("top"))
    return out.unionByName(_review(wrong, F.lit("type"), "hint", source=F.lit("imdb_hint"), imdb_id=F.col("hint.imdb_id")))


def by_search(items: DataFrame, answers: DataFrame) -> DataFrame:
    """items with ``gone``, the confirmed id that was not found, if any."""
    alias = F.get(F.filter("aliases", lambda a: a.rlike("[A-Za-z]{3,}")), 0)
    where = F.when(F.col("kind").isin("movie", "tv"), F.col("kind")).otherwise("multi")
    ask = lambda lang, text: F.concat_ws("|", where, F.lit(lang), text, F.coalesce(F.col("year").cast("string"), F.lit("")))
    rows = answered(items.withColumns({"alias": alias, "ask": ask("zh-CN", F.col("title"))}), answers, "search", "s")
    nothing = usable("s") & (F.size("s.results") == 0) & F.col("alias").isNotNull()
    rows = answered(rows.withColumn("ask", F.when(nothing, ask("zh-CN", F.col("alias")))), answers, "search", "a")
    failed = ~usable("s") | (F.col("a").isNotNull() & ~usable("a"))
    error = F.when(~usable("s"), F.col("s.error_class")).otherwise(F.col("a.error_class"))
    out = _verdicts(rows.where(failed), lane=F.lit("search"), error=error)
    rows = rows.where(~failed).withColumn("results", F.when(F.col("a").isNotNull(), F.col("a.results")).otherwise(F.col("s.results"))).drop("s", "a")
    first = judged(rows.select("key", "queries", "year", "kind", "results"))
    weak = rows.join(first.where(F.col("verdict").isin("unmatched", "needs_review")).select("key"), "key")
    weak = answered(weak.withColumn("ask", ask("en-US", F.coalesce("alias", "title"))), answers, "search", "e").where(usable("e") & (F.size("e.results") > 0))
    # of a result that both lists have, the English form, in the place where it first stood
    same = lambda x, r: x["id"].eqNullSafe(r["id"]) & x["kind"].eqNullSafe(r["kind"])
    old = F.transform("results", lambda r: F.coalesce(F.get(F.filter("e.results", lambda x: same(x, r)), 0), r))
    new = F.filter("e.results", lambda x: ~F.exists("results", lambda r: same(x, r)))
    again = judged(weak.select("key", "queries", "year", "kind", F.concat(old, new).alias("results")))
    both = first.join(again.select("key"), "key", "left_anti").unionByName(again).join(rows.select("key", "gone"), "key")
    source = F.when(F.col("gone").isNotNull(), "confirmation_not_found")
    return out.unionByName(_verdicts(both, lane=F.lit("search"), source=source, note=F.col("gone").cast("string")))


def by_name(items: DataFrame, answers: DataFrame) -> DataFrame:
    """Verdicts for series that the second catalog knows; none for all others, whatever failed on the way."""
    rows = answered(items.where("kind = 'tv'").withColumn("ask", F.col("title")), answers, "names", "n").where("n.status = 'ok'")
    shows = rows.select("key", "title", F.posexplode("n.results").alias("pos", "r")).withColumn("near", similarity("title", F.coalesce("r.name", F.lit(""))))
    picked = first_per_key(shows.where(F.col("near") >= LEAST_NAME), ["key"], [F.desc("near"), "pos"]).select("key", F.col("r.name").alias("show"), F.col("r.imdb_id").alias("ask"))
    picked = picked.where("ask is not null").withColumn("imdb_id", F.col("ask"))
    rows = answered(items.join(picked, "key"), answers, "find", "f").where(usable("f")).withColumn("results", of_kind("f.results", F.lit("tv"))).where(F.size("results") > 0)
    v = judged(rows.select("key", F.concat("queries", F.array_compact(F.array("show"))).alias("queries"), "year", "kind", "results"))
    return _verdicts(v.join(rows.select("key", "imdb_id"), "key"), lane=F.lit("names"), source=F.lit("names"))


def verdict_ladder(items: DataFrame, hints: DataFrame, answers: DataFrame, second_catalog: bool = True) -> DataFrame:
    """One row of VERDICT for each key; verdict null, with the error, where a request failed that the verdict needs.

    items: key, title, aliases (array), year, kind (movie, tv, unknown). hints: key, decision, ext_id, ext_kind, imdb_id,
    imdb_type, primary_title, original_title. answers: endpoint (details, find, search, names), ask, status (ok, empty,
    failed_retryable, failed_permanent), error_class, fetched_at, results (array of RESULT). Each step's verdicts are
    written to the shared folder, so that a step is evaluated once."""
    h = first_per_key(hints, ["key"], ["decision", "ext_id", "imdb_id"]).select("key", F.struct("decision", "ext_id", "ext_kind", "imdb_id", "imdb_type", "primary_title", "original_title").alias("hint"))
    i = first_per_key(items, ["key"], ["title", "year", "kind"]).withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
    i = i.select("key", "title", "aliases", "year", F.coalesce("kind", F.lit("unknown")).alias("kind"), F.array_compact(F.concat(F.array("title"), F.col("aliases"))).alias("queries"))
    i = written(i.join(h, "key", "left"), "items")
    confirmed, gone = by_confirmed(i, answers)
    confirmed, gone = written(confirmed, "confirmed"), written(gone, "gone")
    open_ = i.join(confirmed.select("key"), "key", "left_anti").join(gone, "key", "left")
    hinted = written(by_hint(open_.where("gone is null"), answers), "hinted")
    searched = written(by_search(open_.join(hinted.select("key"), "key", "left_anti"), answers), "searched")
    out = [confirmed, hinted, searched]
    if second_catalog:
        unmatched = reduce(DataFrame.unionByName, [hinted, searched]).where("verdict = 'unmatched' and source is distinct from 'confirmation_not_found'").select("key")
        named = written(by_name(i.join(unmatched, "key"), answers), "named")
        out = [confirmed, *(x.join(named.select("key"), "key", "left_anti") for x in (hinted, searched)), named]
    return reduce(DataFrame.unionByName, out)
