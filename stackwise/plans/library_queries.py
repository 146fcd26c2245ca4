"""Queries of the library's maintenance: verdicts over recorded answers, bundles that inherit, and stored state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cascade, ladder, search, upserts
from ..operators.segments import Maintained
from ..session import shared_folder, written
from ..sources.bundles import Library, Matched, Plan
from ..sources.catalog import table
from ..sources.state_table import StateTable
from .search_queries import INDEX, corpus_of

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


# Every part is an item; its key's remainders choose its hint and what the catalog answers. A list is named by its letter:
# x the item itself, d two of it, h its name with a word before and no year, n a stranger, p a person, w a film of its name.
# The text is SQL of both engines.
ASKED = """SELECT p_partkey AS key, p_name || ' ' || p_partkey AS title, 1990 + p_size % 20 AS year, CASE p_partkey % 3 WHEN 0 THEN 'tv' WHEN 1 THEN 'movie' ELSE 'unknown' END AS kind,
  CASE WHEN p_partkey % 4 = 0 THEN 'Alias ' || p_partkey END AS alias, CASE p_partkey % 11 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'confirmed' WHEN 2 THEN 'proposed_exact' WHEN 3 THEN 'proposed_review' WHEN 4 THEN 'proposed_exact' END AS decision,
  CASE WHEN p_partkey % 2 = 0 THEN 'tv' ELSE 'movie' END AS hint_kind, CASE WHEN p_partkey % 13 <> 0 THEN 'tt' || p_partkey END AS imdb,
  CASE p_partkey % 5 WHEN 1 THEN 'retry' WHEN 2 THEN 'gone' WHEN 3 THEN 'year' ELSE 'ok' END AS detail, CASE p_partkey % 7 WHEN 0 THEN 'retry' WHEN 1 THEN '' WHEN 2 THEN 'x' WHEN 3 THEN 'd' WHEN 4 THEN 'o' WHEN 5 THEN 'h' ELSE 'n' END AS find,
  CASE WHEN p_partkey % 17 = 0 THEN 'retry' WHEN p_partkey % 17 < 4 THEN '' WHEN p_partkey % 17 = 5 THEN 'd' WHEN p_partkey % 17 = 6 THEN 'h' WHEN p_partkey % 17 = 7 THEN 'n' WHEN p_partkey % 17 = 8 THEN 'p' WHEN p_partkey % 17 = 9 THEN 'w' ELSE 'x' END AS zh,
  CASE p_partkey % 5 WHEN 0 THEN 'retry' WHEN 1 THEN 'x' ELSE '' END AS zh_alias, CASE p_partkey % 7 WHEN 0 THEN 'retry' WHEN 1 THEN '' WHEN 2 THEN 'x' WHEN 3 THEN 'h' ELSE 'unasked' END AS en,
  CASE p_partkey % 5 WHEN 0 THEN 'retry' WHEN 2 THEN 'n' WHEN 3 THEN 'h' ELSE 'x' END AS named FROM part"""

LADDER = f"""WITH q AS ({ASKED}), k AS (SELECT *, CASE WHEN kind = 'unknown' THEN 'movie' ELSE kind END AS own FROM q),
-- what a list is judged as, for an item of a kind
v(letter, verdict, score, n) AS (VALUES ('x', 'exact', 1.0, 1), ('d', 'candidate', 1.0, 2), ('h', 'candidate', 0.8, 1), ('n', 'needs_review', 0.0, 1), ('p', 'unmatched', 0.0, 0), ('', 'unmatched', 0.0, 0), ('w', 'exact', 1.0, 1), ('wt', 'needs_review', 0.65, 1)),
c AS (SELECT *, decision = 'confirmed' AS sure, kind NOT IN ('unknown', hint_kind) AS clash, imdb IS NULL OR find IN ('x', 'd', 'h', 'n') OR (find = 'o' AND own <> hint_kind) AS mapped FROM k),
confirmed AS (SELECT key, CASE WHEN clash OR detail = 'year' OR (NOT mapped AND find <> 'retry') THEN 'needs_review' WHEN detail = 'retry' OR (imdb IS NOT NULL AND find = 'retry') THEN NULL ELSE 'exact' END AS verdict,
    CASE WHEN clash THEN 'type' WHEN detail = 'retry' THEN NULL WHEN detail = 'year' THEN 'year' WHEN NOT mapped AND find <> 'retry' THEN 'imdb_identity' END AS note, NOT clash AND (detail = 'retry' OR (detail = 'ok' AND imdb IS NOT NULL AND find = 'retry')) AS failed, hint_kind, imdb
  FROM c WHERE sure AND (clash OR detail <> 'gone')),
r1 AS (SELECT key, CASE WHEN failed THEN NULL ELSE verdict END AS verdict, CASE WHEN NOT failed AND verdict = 'exact' THEN key * 10 + 1 END AS ext_id, CASE WHEN NOT failed AND verdict = 'exact' THEN hint_kind END AS ext_kind, CASE WHEN failed THEN NULL WHEN verdict = 'exact' THEN 1.0 ELSE 0.0 END AS score,
    CASE WHEN NOT failed THEN (key * 10 + 1)::VARCHAR END AS top, 'confirmed' AS lane, CASE WHEN NOT failed THEN 'confirmation' END AS source, CASE WHEN NOT failed THEN imdb END AS imdb_id, CASE WHEN NOT failed THEN note END AS note, CASE WHEN failed THEN 'HTTP503' END AS error FROM confirmed),
r2 AS (SELECT key, CASE WHEN find = 'o' THEN 'needs_review' WHEN v.verdict = 'exact' AND decision = 'proposed_review' THEN 'candidate' ELSE v.verdict END AS verdict, CASE WHEN find <> 'o' AND v.verdict IN ('exact', 'candidate') THEN key * 10 + 1 END AS ext_id, CASE WHEN find <> 'o' AND v.verdict IN ('exact', 'candidate') THEN own END AS ext_kind,
    CASE WHEN find = 'o' THEN 0.0 ELSE v.score END AS score, CASE WHEN find = 'd' THEN (key * 10 + 1) || ',' || (key * 10 + 2) ELSE (key * 10 + 1)::VARCHAR END AS top, 'hint' AS lane, 'imdb_hint' AS source, imdb AS imdb_id, CASE WHEN find = 'o' THEN 'type' WHEN v.verdict = 'exact' AND decision = 'proposed_review' THEN 'hint_review' END AS note, NULL AS error
  FROM c LEFT JOIN v ON v.letter = find WHERE decision LIKE 'proposed%' AND imdb IS NOT NULL AND find NOT IN ('retry', '')),
s0 AS (SELECT *, CASE WHEN sure THEN key * 10 + 1 END AS gone, CASE WHEN zh = '' AND alias IS NOT NULL THEN zh_alias ELSE zh END AS list FROM c WHERE key NOT IN (SELECT key FROM r1 UNION ALL SELECT key FROM r2)),
s1 AS (SELECT s0.*, CASE WHEN list = 'w' AND kind = 'tv' THEN 'wt' ELSE list END AS letter FROM s0),
s2 AS (SELECT s1.*, v.verdict AS v1, v.score AS c1, v.n AS n1, coalesce(v.verdict IN ('unmatched', 'needs_review') AND en IN ('x', 'h'), false) AS again FROM s1 LEFT JOIN v USING (letter)),
s3 AS (SELECT s2.*, CASE WHEN again THEN e.verdict ELSE v1 END AS verdict, CASE WHEN again THEN e.score ELSE c1 END AS score FROM s2 LEFT JOIN v e ON e.letter = en),
n AS (SELECT key, key % 7 < 4 AS found FROM s3 WHERE kind = 'tv' AND verdict = 'unmatched' AND gone IS NULL AND named = 'x'),
r3 AS (SELECT key, verdict, CASE WHEN verdict IN ('exact', 'candidate') THEN key * 10 + CASE WHEN again THEN 3 ELSE 1 END END AS ext_id, CASE WHEN verdict IN ('exact', 'candidate') THEN CASE WHEN list = 'w' AND NOT again THEN 'movie' ELSE own END END AS ext_kind, score,
    CASE WHEN list <> 'retry' THEN concat_ws(',', CASE WHEN again THEN (key * 10 + 3)::VARCHAR END, CASE WHEN n1 > 0 THEN (key * 10 + 1)::VARCHAR END, CASE WHEN n1 > 1 THEN (key * 10 + 2)::VARCHAR END) END AS top,
    'search' AS lane, CASE WHEN gone IS NOT NULL AND list <> 'retry' THEN 'confirmation_not_found' END AS source, NULL AS imdb_id, CASE WHEN list <> 'retry' THEN gone::VARCHAR END AS note, CASE WHEN list = 'retry' THEN 'HTTP503' END AS error FROM s3 WHERE key NOT IN (SELECT key FROM n WHERE found)),
r4 AS (SELECT key, 'exact' AS verdict, key * 10 + 7 AS ext_id, 'tv' AS ext_kind, 1.0 AS score, (key * 10 + 7)::VARCHAR AS top, 'names' AS lane, 'names' AS source, 'nn' || key AS imdb_id, NULL AS note, NULL AS error FROM n WHERE found)
SELECT key, verdict, ext_id, ext_kind, score::DOUBLE AS score, top, lane, source, imdb_id, note, error FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3 UNION ALL SELECT * FROM r4)"""


def recorded(q):
    """Items, hints and the catalog's answers of ASKED."""
    items = q.select("key", "title", F.array_compact(F.array("alias")).alias("aliases"), "year", "kind")
    ext = (F.col("key") * 10 + 1).cast("long")
    confirmed = F.col("decision") == "confirmed"
    hints = q.where("decision is not null").select("key", "decision", F.when(confirmed, ext).alias("ext_id"), F.when(confirmed, F.col("hint_kind")).alias("ext_kind"), F.col("imdb").alias("imdb_id"), F.lit("video").alias("imdb_type"), F.lit(None).cast("string").alias("primary_title"), F.lit("").alias("original_title"))
    own = F.when(F.col("kind") == "unknown", "movie").otherwise(F.col("kind"))

    def result(slot, title, kind, year, imdb=None):
        return F.struct((F.col("key") * 10 + slot).cast("long").alias("id"), kind.alias("kind"), title.alias("title"), *[F.lit(None).cast("string").alias(c) for c in ("name", "original_title", "original_name")], year.cast("int").alias("year"), F.lit(imdb).cast("string").alias("imdb_id"))

    title, year, none = F.col("title"), F.col("year"), F.lit(None).cast("int")

    def listed(letter, slot=1, kind=own):
        stranger, other = F.lit("黑客"), F.when(own == "tv", "movie").otherwise("tv")
        x = result(slot, title, kind, year)
        return (
            F.when(letter == "x", F.array(x)).when(letter == "d", F.array(x, result(slot + 1, title, kind, year))).when(letter == "h", F.array(result(slot, F.concat(F.lit("The "), title), kind, none)))
            .when(letter == "n", F.array(result(slot, stranger, kind, none))).when(letter == "p", F.array(result(slot, title, F.lit("person"), year))).when(letter == "w", F.array(result(slot, title, F.lit("movie"), year)))
            .when(letter == "o", F.array(result(slot, title, other, year))).otherwise(F.array().cast(f"array<{ladder.RESULT}>"))
        )

    def answers(endpoint, ask, letter, results, rows=q):
        status = F.when(letter == "retry", "failed_retryable").when(letter == "gone", "failed_permanent").when(F.size(results) == 0, "empty").otherwise("ok")
        return rows.select(F.lit(endpoint).alias("endpoint"), ask.alias("ask"), status.alias("status"), F.when(letter == "retry", "HTTP503").when(letter == "gone", "HTTP404").alias("error_class"), F.lit(1).alias("fetched_at"), results.alias("results"))

    where, y = F.when(F.col("kind") == "unknown", "multi").otherwise(F.col("kind")), year.cast("string")
    search = lambda lang, text: F.concat_ws("|", where, F.lit(lang), text, y)
    hinted = F.when(confirmed, F.col("hint_kind")).otherwise(own)
    shown = result(9, F.when(F.col("named") == "n", "黑客").when(F.col("named") == "h", F.concat(F.lit("The "), title)).otherwise(title), F.lit("tv"), none)
    shown = F.struct(shown["id"].alias("id"), shown["kind"].alias("kind"), shown["title"].alias("title"), shown["title"].alias("name"), *[shown[c].alias(c) for c in ("original_title", "original_name", "year")], F.when(F.col("named") == "x", F.concat(F.lit("nn"), F.col("key").cast("string"))).alias("imdb_id"))
    by_name = result(7, title, F.when(F.col("key") % 7 < 4, "tv").otherwise("movie"), year)
    parts = [
        answers("details", F.concat_ws(":", "hint_kind", ext.cast("string")), F.col("detail"), F.array(result(1, title, F.col("hint_kind"), F.when(F.col("detail") == "year", year + 5).otherwise(year))), q.where(confirmed)),
        answers("find", F.col("imdb"), F.col("find"), listed(F.col("find"), kind=hinted), q.where("imdb is not null")),
        answers("search", search("zh-CN", title), F.col("zh"), listed(F.col("zh"))), answers("search", search("zh-CN", F.col("alias")), F.col("zh_alias"), listed(F.col("zh_alias")), q.where("alias is not null")),
        answers("search", search("en-US", F.coalesce("alias", "title")), F.col("en"), listed(F.col("en"), 3), q.where("en <> 'unasked'")),
        answers("names", title, F.col("named"), F.array(shown), q.where("kind = 'tv'")), answers("find", F.concat(F.lit("nn"), F.col("key").cast("string")), F.lit("ok"), F.array(by_name)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return items, hints, out


@query(LADDER)
def e2_staged_ladder(spark, d):
    table(spark, d, "part").createOrReplaceTempView("part")
    items, hints, answers = recorded(spark.sql(ASKED))
    out = ladder.verdict_ladder(items, hints, written(answers, "answers"))
    return out.select(*[F.array_join("top", ",").alias("top") if c == "top" else c for c in ladder.VERDICT])


OLD = "SELECT p_partkey AS id, cast(p_partkey % 700 + 1 AS string) AS ident, p_name AS title, p_brand AS kind, CASE p_partkey % 4 WHEN 1 THEN 'exact' WHEN 2 THEN 'candidate' ELSE 'needs_review' END AS match_status, p_retailprice AS ext FROM part WHERE p_partkey % 2 = 1 AND p_partkey % 5 <> 0"
NEW = "SELECT p_partkey AS id, cast(p_partkey % 900 AS string) AS ident, p_name AS title, p_brand AS kind, 'unmatched' AS match_status, cast(NULL AS double) AS ext FROM part WHERE p_partkey % 2 = 0"
INSTALLED = f"""WITH a AS ({NEW}), b AS ({OLD}), {{pairs}}
SELECT a.id, CASE WHEN b.match_status = 'exact' THEN b.kind ELSE a.kind END AS kind, coalesce(b.match_status, a.match_status) AS match_status, b.ext, CASE WHEN b.id IS NOT NULL THEN 'current' END AS inherited FROM a LEFT JOIN p ON p.new_id = a.id LEFT JOIN b ON b.id = p.old_id"""
_PAIRS = []
for _i, _keys in enumerate((["ident"], ["title"], ["title", "kind"])):
    _left = [f"id NOT IN (SELECT {{side}}_id FROM p{j})" for j in range(_i)]
    _one = ["({side}1{n} AS (SELECT *, count(*) OVER (PARTITION BY {keys}) AS n FROM {side} WHERE {left}))".format(side=s, n=_i, keys=", ".join(_keys), left=" AND ".join(x.format(side={"a": "new", "b": "old"}[s]) for x in _left) or "true")[1:-1] for s in "ab"]
    _PAIRS += [*_one, f"p{_i} AS (SELECT x.id AS new_id, y.id AS old_id FROM a1{_i} x JOIN b1{_i} y ON {' AND '.join(f'x.{k} = y.{k}' for k in _keys)} AND x.n = 1 AND y.n = 1)"]
_PAIRS.append("p AS (" + " UNION ALL ".join(f"SELECT * FROM p{j}" for j in range(3)) + ")")


@query(INSTALLED.replace("{pairs}", ", ".join(_PAIRS)).replace("AS string", "AS VARCHAR"))
def s9_install_bundle(spark, d):
    """Two versions of a library of items and checks; the second one's items have what the first knew of them."""
    table(spark, d, "part").createOrReplaceTempView("part")
    checks = table(spark, d, "supplier").selectExpr("s_suppkey AS url", "s_nationkey AS status")
    plan = Plan(Matched("items", "id", [["ident"], ["title"], ["title", "kind"]], ["ext"], kind="kind"), kept={"checks": ["url"]}, check=lambda t: not t["items"].isEmpty())
    library = Library(spark, shared_folder(spark))
    library.install({"items": spark.sql(OLD), "checks": checks.where("url % 2 = 1")}, plan)
    library.install({"items": spark.sql(NEW), "checks": checks.where("url % 2 = 0")}, plan)
    return library.read("items").select("id", "kind", "match_status", "ext", "inherited")


# The documents as they are after two batches: those of the second batch have their words in other cases and more of them,
# those divisible by 13 are gone.
LATER = "doc_id % 9 = 0"
GONE = "doc_id % 13 = 0"
LATER_DOCS = INDEX.replace("coalesce(text, '') AS text, regexp_extract_all(coalesce(text, '')", f"CASE WHEN {LATER} THEN 'Later ' || coalesce(text, '') || ' late' ELSE coalesce(text, '') END AS text, regexp_extract_all(CASE WHEN {LATER} THEN 'Later ' || coalesce(text, '') || ' late' ELSE coalesce(text, '') END").replace("FROM documents)", f"FROM documents WHERE NOT {GONE})", 1)


def maintained(spark, d):
    """An index of the documents without a third of them, to which these come as a first batch; a second one changes every
    ninth document and deletes every thirteenth."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    first = docs.where("doc_id % 3 <> 0")
    m = Maintained.create(spark, shared_folder(spark), corpus_of(first), buckets=8)
    m.enqueue(docs.where("doc_id % 3 = 0").select("doc_id"), 1)
    m.catch_up(corpus_of(docs), 1)
    changed = docs.where(f"NOT {GONE}").withColumn("text", F.when(F.expr(LATER), F.concat(F.lit("Later "), F.coalesce("text", F.lit("")), F.lit(" late"))).otherwise(F.col("text")))
    m.enqueue(docs.where(f"{LATER} OR {GONE}").select("doc_id"), 2)
    m.catch_up(corpus_of(changed), 2)
    return m


@query(LATER_DOCS + "SELECT term, kind, df FROM df")
def t5_vocabulary(spark, d):
    """Document frequencies after signed changes of three segments."""
    return maintained(spark, d).open().table("vocabulary").select("term", "kind", "df")


@query(LATER_DOCS + f"SELECT doc_id, field, count(*) AS terms, round(sum(weight), 5) AS weight, round(max(weight), 6) AS top FROM idx WHERE {LATER} GROUP BY 1, 2")
def t18_batch_weights(spark, d):
    """The changed documents' rows, with the weights of the corpus after their batch, as a rebuild gives them."""
    w = search.weights(maintained(spark, d).open().table("terms").where(LATER))
    return w.groupBy("doc_id", "field").agg(F.count("*").alias("terms"), F.round(F.sum("weight"), 5).alias("weight"), F.round(F.max("weight"), 6).alias("top"))


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 50 = 3 THEN c_mktsegment || ' later' ELSE c_mktsegment END AS v, c_custkey % 50 = 3 AS touched FROM customer")
def u4_state_table(spark, d):
    """A keyed table in buckets; a second write replaces every fiftieth row."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"), F.lit(False).alias("touched"))
    t = StateTable.create(spark, shared_folder(spark), rows.schema, ["k"], buckets=32)
    latest = lambda old, new: upserts.latest_wins(old, new, ["k"], ["v"])
    t.merge(rows, latest)
    t.merge(rows.where("k % 50 = 3").withColumns({"v": F.concat("v", F.lit(" later")), "touched": F.lit(True)}), latest)
    return t.read()


# every third and fourth customer of four became the one before; shares are parts, fingerprints priorities
CASCADE = """WITH m AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 IN (2, 3) THEN c_custkey - c_custkey % 4 + 1 ELSE c_custkey END AS root FROM customer),
e0 AS (SELECT o_orderkey AS edition_id, m.root AS item_id, m.root % 4 = 1 AND (SELECT count(*) FROM m x WHERE x.root = m.root) > 1 AS touched, o_orderpriority AS fingerprint FROM orders JOIN m ON m.id = o_custkey),
e AS (SELECT *, CASE WHEN touched THEN min(edition_id) OVER (PARTITION BY item_id, fingerprint) ELSE edition_id END AS target FROM e0),
l0 AS (SELECT DISTINCT (l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey AS link_id, target, l_partkey AS share, folded FROM lineitem JOIN (SELECT *, count(*) OVER (PARTITION BY target) AS folded FROM e) e ON e.edition_id = l_orderkey),
l AS (SELECT *, CASE WHEN folded > 1 THEN min(link_id) OVER (PARTITION BY target, share) ELSE link_id END AS kept FROM l0),
ne AS (SELECT item_id, count(*) AS editions FROM e WHERE edition_id = target GROUP BY 1), nl AS (SELECT e.item_id, count(*) AS links FROM l JOIN e ON e.edition_id = l.target WHERE link_id = kept GROUP BY 1)
SELECT m.id AS item_id, coalesce(editions, 0) AS editions, coalesce(links, 0)::BIGINT AS links, 0::BIGINT AS orphans FROM m LEFT JOIN ne ON ne.item_id = m.id LEFT JOIN nl ON nl.item_id = m.id WHERE m.id = m.root"""


@query(CASCADE)
def e6_cascade(spark, d):
    """Chains of merged items through editions and links; counts of touched items alone are made anew."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("item_id"))
    editions = table(spark, d, "orders").select(F.col("o_orderkey").alias("edition_id"), F.col("o_custkey").alias("item_id"), F.col("o_orderpriority").alias("fingerprint"))
    links = table(spark, d, "lineitem").select(((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10_000_000 + F.col("l_partkey")).alias("link_id"), F.col("l_orderkey").alias("edition_id"), F.col("l_partkey").alias("share")).distinct()
    changes = c.where("item_id % 4 IN (2, 3)").select(F.col("item_id").alias("old"), (F.col("item_id") - 1).alias("new"))
    m = cascade.cascade(changes, c, editions, links, {"ratings": c})
    n = editions.join(links.groupBy("edition_id").agg(F.count("*").alias("links")), "edition_id", "left").groupBy("item_id").agg(F.count("*").alias("editions"), F.coalesce(F.sum("links"), F.lit(0)).alias("links"))
    stored = c.join(n, "item_id", "left").na.fill(0)
    lost = cascade.orphans(m).agg(F.count("*").alias("orphans"))
    return cascade.recounted(m, stored).crossJoin(F.broadcast(lost))
