"""Search and entity resolution on the driver's tables: documents are the items, their first eight words the title."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import ROMAN, build_charmap, fold, similarity, strip_marks
from ..operators import remote, resolve, search
from ..operators.tokens import classify, last_word, token_column
from ..session import shared_folder
from ..sources.catalog import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def corpus(spark, d):
    """Items of four languages: the first eight words of a document are its title."""
    return corpus_of(table(spark, d, "documents").select("doc_id", "text"))


def corpus_of(t):
    # a limited split reads no further than the title's eight words and what may stand before them
    words = F.array_remove(F.split("text", r"[^\p{L}\p{M}\p{N}]+", 10), "")
    boost = search.static_boost(F.col("doc_id") % 2 == 0, F.col("doc_id") % 10, F.col("doc_id") % 3 == 0)
    return t.select("doc_id", F.array_join(F.slice(words, 1, 8), " ").alias("title"), F.col("text").alias("overview"), boost.alias("boost"))


_STORED: dict[tuple[str, str], search.Index] = {}


def build(spark, d) -> search.Index:
    """A new index of the documents, which later queries of the session read."""
    index = search.build_index(corpus(spark, d), shared_folder(spark), buckets=16)
    _STORED[spark.sparkContext.applicationId, d] = index
    return index


def stored(spark, d) -> search.Index:
    return _STORED.get((spark.sparkContext.applicationId, d)) or build(spark, d)


ROMAN_SQL = "CASE t " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ROMAN.items()) + " ELSE t END"
INDEX = rf"""WITH d0 AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{M}}\p{{N}}]+')[1:8] AS w FROM documents),
keys AS (SELECT doc_id, replace(lower(array_to_string(w, ' ')), 'ß', 'ss') AS key, 1 + 0.15::DOUBLE * (doc_id % 2 = 0)::INT + 0.10::DOUBLE * ln(1 + doc_id % 10) + 0.10::DOUBLE * (doc_id % 3 = 0)::INT AS boost FROM d0),
raw AS (SELECT doc_id, 'title' AS field, unnest(regexp_extract_all(strip_accents(key), '[0-9a-zæðøþ]+')) AS t FROM keys
  UNION ALL SELECT doc_id, 'overview', unnest(regexp_extract_all(strip_accents(replace(lower(text), 'ß', 'ss')), '[0-9a-zæðøþ]+')) FROM d0),
tok AS (SELECT doc_id, field, {ROMAN_SQL} AS term FROM raw),
p AS (SELECT doc_id, field, term, CASE WHEN regexp_matches(term, '^[0-9]+$') THEN 'number' ELSE 'latin' END AS kind, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT doc_id, sum(tf) AS dl FROM p GROUP BY 1), df AS (SELECT term, min(kind) AS kind, count(DISTINCT doc_id) AS df FROM p GROUP BY 1),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
idx AS (SELECT p.doc_id, field, p.term, p.kind, CASE WHEN p.kind = 'latin' AND p.term IN ('the', 'a', 'an', 'of') THEN 0.2 * CASE field WHEN 'title' THEN 3.0 ELSE 0.3 END::DOUBLE
  ELSE ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) * (CASE field WHEN 'title' THEN 3.0 ELSE 0.3 END)::DOUBLE END AS weight
  FROM p JOIN dl ON dl.doc_id = p.doc_id JOIN df ON df.term = p.term, st)
"""


@query(INDEX + "SELECT doc_id, field, count(*) AS terms, round(sum(weight), 5) AS weight, round(max(weight), 6) AS top FROM idx GROUP BY 1, 2")
def t1_build_index(spark, d):
    w = search.weights(build(spark, d).table("terms"))
    return w.groupBy("doc_id", "field").agg(F.count("*").alias("terms"), F.round(F.sum("weight"), 5).alias("weight"), F.round(F.max("weight"), 6).alias("top"))


@query(INDEX + "SELECT term, df FROM df")
def a16_document_frequency(spark, d):
    return search.document_frequencies(search.postings(corpus(spark, d)))


@query(INDEX + "SELECT doc_id, key, round(boost, 9) AS boost FROM keys")
def t3_static_boost(spark, d):
    return search.document_keys(corpus(spark, d)).select("doc_id", "doc.key", F.round("doc.boost", 9).alias("boost"))


@query(INDEX + "SELECT doc_id, key AS name FROM keys WHERE key <> ''")
def t4_document_names(spark, d):
    return stored(spark, d).table("names").where("kind = 'key'").select("doc_id", "name")


def hits_sql(ask: str) -> str:
    """Recall of a query in SQL; the words that its last one may begin come from the vocabulary."""
    terms, word = classify(ask), last_word(ask)
    listed = lambda xs: ", ".join(f"'{x}'" for x in xs) or "NULL"
    more = f"SELECT term FROM df WHERE kind = 'latin' AND starts_with(term, '{word}') ORDER BY term LIMIT 20" if word else "SELECT NULL AS term WHERE false"
    numeric = listed(terms.numeric) if not terms.numeric & set(terms.names) else "NULL"
    return f""", more AS ({more}), names AS (SELECT unnest([{listed(terms.names)}]) AS term UNION SELECT term FROM more),
hit AS (SELECT doc_id, round(sum(CASE WHEN field = 'title' AND term IN (SELECT term FROM names) THEN weight ELSE 0 END), 9) AS name_score,
  round(sum(CASE WHEN field = 'title' AND term NOT IN (SELECT term FROM names) THEN 0 WHEN field = 'overview' AND coalesce(term IN ({numeric}), false) THEN 0.25 * weight ELSE weight END), 9) AS score,
  count(DISTINCT CASE WHEN field = 'title' AND term IN (SELECT term FROM names) THEN term END) AS matched
  FROM idx WHERE term IN (SELECT term FROM names) OR term IN ({listed(terms.others)}) GROUP BY 1),
top AS (SELECT * FROM hit WHERE matched > 0 ORDER BY name_score DESC, doc_id LIMIT 300)
"""


def rank_sql(ask: str) -> str:
    """The rerank of a query of Latin words in SQL."""
    terms, q = classify(ask), fold(ask)
    has = {t: f"list_contains(string_split(strip_accents(key), ' '), '{t}')" for t in terms.names}
    cov = " + ".join(f"({has[u]})::INT" for u in terms.units)
    phrase = " OR ".join(has[t] for t in terms.runs if t in has) or "false"
    return f""", rr AS (SELECT t.doc_id, key, boost, score, matched, ({cov}) / {len(terms.units)}.0::DOUBLE AS cov, ({phrase}) AS phrase FROM top t JOIN keys k ON k.doc_id = t.doc_id)
SELECT doc_id, key, CASE WHEN key = '{q}' THEN 0 WHEN starts_with(key, '{q}') OR phrase THEN 1 WHEN cov >= 0.5 THEN 2 ELSE 3 END AS tier, round(cov, 6) AS coverage,
  round(score * (1 + 0.15::DOUBLE * (matched - 1)) * (CASE WHEN key = '{q}' THEN 2.0 ELSE 1 END * CASE WHEN starts_with(key, '{q}') THEN 1.5 ELSE 1 END * CASE WHEN contains(key, '{q}') THEN 1.3 ELSE 1 END)::DOUBLE * boost * (1 + 0.5::DOUBLE * cov), 6) AS final FROM rr"""


ASK = "the thonst onth of 2"
ASK_MARKS = "nicht über ción"


@query(INDEX + hits_sql(ASK) + "SELECT doc_id, round(name_score, 6) AS name_score, round(score, 6) AS score, matched FROM top")
def t9_recall(spark, d):
    terms = classify(ASK)
    r = search.recall(stored(spark, d).terms(terms.all), terms)
    return r.select("doc_id", F.round("name_score", 6).alias("name_score"), F.round("score", 6).alias("score"), "matched")


@query(INDEX + hits_sql(ASK) + rank_sql(ASK))
def t12_rerank(spark, d):
    terms = classify(ASK)
    return search.rerank(search.recall(stored(spark, d).terms(terms.all), terms), search.understand(ASK), terms)


@query(INDEX + hits_sql(ASK) + rank_sql(ASK))
def t14_search(spark, d):
    return search.search(stored(spark, d), ASK)


@query(INDEX + hits_sql(ASK_MARKS) + rank_sql(ASK_MARKS))
def t14_search_marks(spark, d):
    return search.search(stored(spark, d), ASK_MARKS)


@query(INDEX + "SELECT term FROM df WHERE kind = 'latin' AND starts_with(term, 'tho') ORDER BY term LIMIT 20")
def t8_expansions(spark, d):
    return search.expansions(stored(spark, d), "tho")


@query(INDEX + "SELECT asked AS term, term AS correction FROM (SELECT asked, term, row_number() OVER (PARTITION BY asked ORDER BY levenshtein(term, asked), term) AS rn FROM (SELECT term FROM df WHERE kind = 'latin') JOIN (SELECT unnest(['thonnt', 'insherx', 'ththationx', 'shor']) AS asked) ON substr(term, 1, 1) = substr(asked, 1, 1) AND abs(length(term) - length(asked)) <= 2 AND length(asked) >= 5 AND levenshtein(term, asked) BETWEEN 1 AND CASE WHEN length(asked) < 9 THEN 1 ELSE 2 END) WHERE rn = 1")
def t13_corrections(spark, d):
    return search.corrections(stored(spark, d).table("vocabulary"), ["thonnt", "insherx", "ththationx", "shor"])


@query(INDEX + "SELECT doc_id, key FROM keys WHERE starts_with(key, 'th') ORDER BY boost DESC, doc_id LIMIT 8")
def t16_suggest(spark, d):
    return search.suggest(stored(spark, d), "Th").select("doc_id", "key")


@query(INDEX + "SELECT term, kind, sum(tf)::BIGINT AS n, count(DISTINCT doc_id) AS docs FROM p WHERE field = 'overview' GROUP BY 1, 2")
def x22_tokenise(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.explode(token_column(F.col("text"))).alias("t"))
    return t.groupBy("t.term", "t.kind").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query("SELECT c AS src, strip_accents(c) AS dst, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(list_distinct(string_split(lower(text), ''))) AS c FROM documents) WHERE c BETWEEN 'à' AND 'ü' GROUP BY 1, 2 HAVING strip_accents(c) <> c")
def x23_charmap(spark, d):
    """The characters of the texts that a conversion changes: here, to what they are without marks."""
    charmap = build_charmap(table(spark, d, "documents").select("text"), "text", lambda c: strip_marks(c), "à", "ü")
    c = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), ""))).alias("src"))
    pairs = spark.createDataFrame(sorted(charmap.items()) or [("", "")], "src string, dst string")
    return c.join(F.broadcast(pairs), "src").groupBy("src", "dst").agg(F.countDistinct("doc_id").alias("docs"))


@query(INDEX + """, q AS (SELECT doc_id AS query, unnest(list_distinct(regexp_extract_all(strip_accents(key), '[0-9a-zæðøþ]+'))) AS t FROM keys WHERE doc_id % 100 = 0),
qt AS (SELECT DISTINCT query, """ + ROMAN_SQL + """ AS term FROM q),
qk AS (SELECT *, CASE WHEN regexp_matches(term, '^[0-9]+$') THEN 2 WHEN term IN ('the', 'a', 'an', 'of') THEN 1 ELSE 0 END AS trust FROM qt),
qb AS (SELECT query, term FROM (SELECT *, min(trust) OVER (PARTITION BY query) AS best FROM qk) WHERE trust = best),
h AS (SELECT query, doc_id, round(sum(weight), 9) AS s FROM qb JOIN idx ON idx.term = qb.term AND field = 'title' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, doc_id) AS rank FROM h),
e AS (SELECT k.doc_id % 4 AS category, k.doc_id AS query, min(rank) AS rank FROM keys k LEFT JOIN r ON r.query = k.doc_id AND r.doc_id = k.doc_id AND rank <= 10 WHERE k.doc_id % 100 = 0 GROUP BY ALL)
SELECT category, count(*) AS n, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr, round(avg((rank IS NOT NULL)::INT), 6) AS recall, round(avg(coalesce((rank = 1)::INT, 0)), 6) AS p1 FROM e GROUP BY 1""")
def a17_retrieval_metrics(spark, d):
    """Titles as queries: how well each finds its own document among all."""
    asked = search.document_keys(corpus(spark, d)).where("doc_id % 100 = 0").select(F.col("doc_id").alias("query"), F.col("doc.key").alias("text"))
    found = search.recall_many(stored(spark, d), asked, 10)
    expected = asked.select("query", F.col("query").alias("doc_id"), (F.col("query") % 4).alias("category"))
    return search.retrieval_metrics(found, expected)


# entity resolution: parts of one brand are the candidates of a supplier's nation

SCORED = """WITH s AS (SELECT p_brand AS k, p_partkey AS c, greatest(0, least(1, (p_size * 2.0::DOUBLE) / 100 + CASE abs(p_size % 7 - 3) WHEN 0 THEN 0.15 WHEN 1 THEN 0.05 ELSE -0.30 END::DOUBLE + CASE WHEN p_type = 'PROMO' THEN -0.5 ELSE 0.0 END::DOUBLE)) AS score FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, c) AS rn, lead(score) OVER (PARTITION BY k ORDER BY score DESC, c) AS second FROM s)
"""


def scored(spark, d):
    p = table(spark, d, "part")
    year = resolve.year_score(F.col("p_size") % 7, F.lit(3))
    score = resolve.score_candidate(F.col("p_size") * 2.0 / 100, year, F.lit("film"), F.when(F.col("p_type") == "PROMO", "series").otherwise("film"))
    return p.select(F.col("p_brand").alias("k"), F.col("p_partkey").alias("c"), score.alias("score"))


@query(SCORED + "SELECT k, CASE WHEN score IS NULL THEN 'unmatched' WHEN score >= 0.9 AND round(score - coalesce(second, 0), 9) >= 0.15 THEN 'exact' WHEN score >= 0.75 THEN 'candidate' ELSE 'needs_review' END AS verdict, c, score, round(score - coalesce(second, 0), 6) AS margin, (SELECT string_agg(c::VARCHAR, ',' ORDER BY rn) FROM r x WHERE x.k = r.k AND rn <= 5) AS top FROM r WHERE rn = 1")
def e1_judge(spark, d):
    return resolve.judge(scored(spark, d), "k", "c")


@query(SCORED + "SELECT k AS brand, round(max(score), 6) AS best, count(*) FILTER (score >= 0.5) AS eligible FROM s GROUP BY 1")
def x26_score_candidate(spark, d):
    return scored(spark, d).groupBy(F.col("k").alias("brand")).agg(F.round(F.max("score"), 6).alias("best"), F.count_if(F.col("score") >= 0.5).alias("eligible"))


@query("SELECT k, verdict FROM (SELECT k, verdict, row_number() OVER (PARTITION BY k ORDER BY lane) AS rn FROM (SELECT s_suppkey AS k, 'confirmed' AS verdict, 0 AS lane FROM supplier WHERE s_acctbal > 8000 UNION ALL SELECT s_suppkey, 'hint', 1 FROM supplier WHERE s_nationkey % 2 = 0 UNION ALL SELECT s_suppkey, 'search', 2 FROM supplier)) WHERE rn = 1")
def e2_verdict_ladder(spark, d):
    s = table(spark, d, "supplier").withColumnRenamed("s_suppkey", "k")
    lane = lambda c, v: s.where(c).select("k", F.lit(v).alias("verdict"))
    return resolve.verdict_ladder([lane("s_acctbal > 8000", "confirmed"), lane("s_nationkey % 2 = 0", "hint"), lane("true", "search")], "k").select("k", "verdict")


@query("SELECT coalesce(b.k, a.k) AS k, coalesce(b.v, a.v) AS v FROM (SELECT p_partkey AS k, p_name AS v FROM part WHERE p_size < 30) a FULL JOIN (SELECT p_partkey AS k, p_type AS v FROM part WHERE p_size > 20) b ON a.k = b.k")
def e3_merge_results(spark, d):
    p = table(spark, d, "part")
    return remote.merge_results(p.where("p_size < 30").selectExpr("p_partkey as k", "p_name as v"), p.where("p_size > 20").selectExpr("p_partkey as k", "p_type as v"), ["k"])


NAMES = "(SELECT p_brand, p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'The ' || p_brand WHEN 1 THEN upper(p_brand) WHEN 2 THEN 'zz' ELSE '黑客' END AS name FROM part)"


@query(f"SELECT p_brand, p_partkey, s AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY s DESC, p_partkey) AS rn FROM (SELECT *, CASE p_partkey % 4 WHEN 0 THEN 0.8::DOUBLE WHEN 1 THEN 1.0 ELSE 0 END AS s FROM {NAMES}) WHERE s >= 0.5) WHERE rn = 1")
def e4_pick_match(spark, d):
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, F.concat(F.lit("The "), "p_brand")).when(k == 1, F.upper("p_brand")).when(k == 2, "zz").otherwise("黑客")
    found = table(spark, d, "part").select("p_brand", "p_partkey", name.alias("name"))
    return remote.pick_match(found, ["p_brand"], "p_partkey", similarity("p_brand", "name"))


@query("SELECT p_partkey, CASE WHEN p_size > 40 THEN 'tv' WHEN p_size > 30 THEN 'movie' WHEN p_size % 3 = 0 THEN 'tv' WHEN p_size % 3 = 1 THEN 'movie' ELSE 'movie' END AS kind FROM part")
def e5_expected_kind(spark, d):
    kind = F.when(F.col("p_size") > 40, "tv").when(F.col("p_size") > 30, "movie").otherwise("unknown")
    hint = F.when(F.col("p_size") % 3 == 0, "tvSeries").when(F.col("p_size") % 3 == 1, "tvMovie").otherwise("videoGame")
    return table(spark, d, "part").select("p_partkey", remote.expected_kind(kind, hint, {"tvSeries": "tv", "tvMiniSeries": "tv", "movie": "movie", "tvMovie": "movie"}).alias("kind"))


MERGE = """WITH r AS (SELECT p_name, p_type, p_partkey AS id, p_size % 4 AS rank, CASE WHEN p_size % 3 = 0 THEN p_brand END AS brand, CASE WHEN p_size > 40 THEN p_size END AS size FROM part),
k AS (SELECT *, row_number() OVER (PARTITION BY p_name, p_type ORDER BY rank DESC, id) AS rn FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY p_name, p_type ORDER BY CASE WHEN rn = 1 THEN 0 ELSE 1 END, id) AS pos FROM k),
f AS (SELECT p_name, p_type, brand, min(pos) AS pos FROM o WHERE brand IS NOT NULL GROUP BY ALL)
SELECT o.p_name, o.p_type, max(CASE WHEN pos = 1 THEN id END) AS keeper, count(*) AS members, max(rank) AS best_rank, arg_min(size, pos) FILTER (size IS NOT NULL) AS size,
  (SELECT coalesce(string_agg(brand, ',' ORDER BY pos), '') FROM f WHERE f.p_name = o.p_name AND f.p_type = o.p_type) AS aliases FROM o GROUP BY 1, 2"""


@query(MERGE)
def e6_merge_identities(spark, d):
    p = table(spark, d, "part").selectExpr("p_name", "p_type", "p_partkey as id", "p_size % 4 as rank", "case when p_size % 3 = 0 then p_brand end as brand", "case when p_size > 40 then p_size end as size")
    m = resolve.merge_identities(p, ["p_name", "p_type"], "rank", "id", ["size"], "brand")
    return m.withColumn("aliases", F.array_join("aliases", ","))


@query("WITH k AS (SELECT c_custkey AS item_id, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS keeper FROM customer), m AS (SELECT keeper AS item_id, o_orderkey AS edition_id, o_orderpriority AS fp FROM orders JOIN k ON k.item_id = o_custkey) SELECT item_id, edition_id, fp, min(edition_id) OVER (PARTITION BY item_id, fp) AS target FROM m")
def e6_fold_groups(spark, d):
    c = table(spark, d, "customer")
    k = c.select(F.col("c_custkey").alias("item_id"), F.min("c_custkey").over(Window.partitionBy("c_nationkey", "c_mktsegment")).alias("keeper"))
    g = table(spark, d, "orders").select(F.col("o_custkey").alias("item_id"), F.col("o_orderkey").alias("edition_id"), F.col("o_orderpriority").alias("fp"))
    return resolve.fold_groups(g, k, "fp")


@query("""WITH n AS (SELECT p_partkey AS k, p_size % 4 AS rank, p_name AS title FROM part), o AS (SELECT s_suppkey AS k, s_nationkey % 5 AS rank, s_name AS title FROM supplier)
SELECT n.k, CASE WHEN o.rank > n.rank THEN o.rank ELSE n.rank END AS rank, CASE WHEN o.rank > n.rank THEN o.title ELSE n.title END AS title FROM n LEFT JOIN o ON o.k = n.k""")
def e7_backup_upgrades(spark, d):
    """A second pass over what staged matching (j11) paired by id: a backup row only replaces one of a lower rank."""
    n = table(spark, d, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size") % 4).alias("rank"), F.col("p_name").alias("title"))
    o = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_nationkey") % 5).alias("rank"), F.col("s_name").alias("title"))
    return remote.upgraded(n, o, "k", "rank")


@query(INDEX + "SELECT doc_id FROM keys WHERE key = (SELECT key FROM keys WHERE doc_id = 0) AND doc_id % 2 = 0")
def e8_exact_candidates(spark, d):
    k = search.document_keys(corpus(spark, d)).select("doc_id", "doc.key")
    asked = k.where("doc_id = 0").select("key")
    return k.where("doc_id % 2 = 0").join(asked, "key", "left_semi").select("doc_id")


@query("""WITH i AS (SELECT c_custkey % 300 AS k, min(c_name) AS name FROM customer WHERE c_custkey % 300 < 200 GROUP BY 1), r AS (SELECT p_partkey % 300 AS k, p_name AS name, p_partkey FROM part),
n AS (SELECT k, list_sort(list_distinct(list(name))) AS names, arg_min(name, p_partkey) AS first FROM r GROUP BY 1)
SELECT coalesce(i.k, n.k) AS k, coalesce(i.name, first) AS name, coalesce(array_to_string(list_filter(names, lambda x: x <> coalesce(i.name, first)), ','), '') AS aliases FROM i FULL JOIN n ON n.k = i.k""")
def e9_promote(spark, d):
    i = table(spark, d, "customer").select((F.col("c_custkey") % 300).alias("k"), F.col("c_name").alias("name")).where("k < 200").groupBy("k").agg(F.min("name").alias("name"))
    i = i.withColumn("aliases", F.array().cast("array<string>"))
    r = table(spark, d, "part").select((F.col("p_partkey") % 300).alias("k"), F.col("p_name").alias("name"), "p_partkey")
    return remote.promote(i, r, ["k"], ["p_partkey"]).withColumn("aliases", F.array_join("aliases", ","))
