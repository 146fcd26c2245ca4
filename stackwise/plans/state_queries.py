"""Time-based and stateful rules over events, ingest folding, and the remaining composite reads."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ingest, liveness, ranking
from ..session import shared_folder
from ..sources.catalog import SQL, Catalog, table
from ..streaming import events as S
from .function_queries import EDITIONS, LINK_SQL, LINKS, REMARKS

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def stamped(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


RATE = """WITH RECURSIVE e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
w AS (SELECT user_id, rn, event_id, ts AS start, 1 AS attempt FROM e WHERE rn = 1
  UNION ALL
  SELECT e.user_id, e.rn, e.event_id, CASE WHEN e.ts - w.start >= INTERVAL 2 DAY THEN e.ts ELSE w.start END, CASE WHEN e.ts - w.start >= INTERVAL 2 DAY THEN 1 ELSE w.attempt + 1 END
  FROM w JOIN e ON e.user_id = w.user_id AND e.rn = w.rn + 1)
SELECT event_id, attempt, (attempt <= 3)::INT AS allowed FROM w"""


@query(RATE)
def r1_rate_limit(spark, d):
    return S.rate_limit(table(spark, d, "events"), 3, 2 * 86_400)


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n, least(count(*), 300) AS spent, count(*) >= 300 AS exhausted FROM events GROUP BY 1")
def r2_daily_budget(spark, d):
    return S.daily_budget(stamped(spark, d), 300)


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, least(count(*), 50) AS spent, count(*) >= 50 AS exhausted FROM events GROUP BY 1, 2")
def r3_provider_budget(spark, d):
    return S.daily_budget(stamped(spark, d), 50, ("event_type",))


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def r2_streaming_counts(spark, d):
    root = shared_folder(spark)
    return S.run_complete(S.streaming_daily_counts(S.read_stream(spark, d)), f"{root}/out", f"{root}/checkpoint")


@query("SELECT count(*) AS n, count(*) FILTER (event_type = 'error' AND value > 50) AS retry FROM events WHERE CASE WHEN event_type IN ('view', 'click') THEN 1706400000 - epoch(ts) < 86400 * 10 WHEN event_type = 'error' THEN user_id > 20 ELSE FALSE END")
def r4_cache_usability(spark, d):
    e = stamped(spark, d)
    status = F.when(F.col("event_type").isin("view", "click"), "ok").when(F.col("event_type") == "error", "retryable").otherwise("other")
    ok = S.usable(status, 1_706_400_000 + F.col("user_id") - 20, F.col("ts").cast("double"), 1_706_400_000, 864_000)
    return e.where(ok).agg(F.count("*").alias("n"), F.count_if((F.col("event_type") == "error") & (F.col("value") > 50)).alias("retry"))


@query("SELECT event_type, count(DISTINCT sha256(event_type || '|' || user_id || '|' || strftime(ts, '%Y-%m-%d %H'))) AS events FROM events GROUP BY 1")
def r5_event_dedup(spark, d):
    e = stamped(spark, d).withColumn("event_key", S.dedup_key())
    return ranking.first_per_key(e, ["event_key"], ["ts", "event_id"]).groupBy("event_type").agg(F.count("*").alias("events"))


@query("SELECT event_type, count(DISTINCT sha256(event_type || '|' || user_id || '|' || strftime(ts, '%Y-%m-%d %H'))) AS events FROM events GROUP BY 1")
def r5_streaming_dedup(spark, d):
    root = shared_folder(spark)
    out = S.run_to_end(S.streaming_dedup(S.read_stream(spark, d)).select("event_key", "event_type"), f"{root}/out", f"{root}/checkpoint")
    return out.groupBy("event_type").agg(F.count("*").alias("events"))


@query("SELECT event_id, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS unknowns FROM (SELECT *, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events)")
def r6_unknown_runs(spark, d):
    return S.unknown_runs(stamped(spark, d))


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'not_started' WHEN s_nationkey % 5 = 0 THEN 'paused' WHEN s_suppkey <= 90 THEN 'running' ELSE 'stale' END AS state FROM supplier")
def r7_heartbeat(spark, d):
    state = S.heartbeat(F.col("s_suppkey"), F.col("s_nationkey") % 5 != 0, F.col("s_acctbal") >= 0, 30)
    return table(spark, d, "supplier").select("s_suppkey", state.alias("state"))


@query("SELECT event_type, count(*) AS due FROM events WHERE ts <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY 1")
def r8_due(spark, d):
    return stamped(spark, d).where(F.col("ts") <= F.lit("2024-01-20 12:00:00").cast("timestamp")).groupBy("event_type").agg(F.count("*").alias("due"))


@query("SELECT phase, max(event_id) AS cursor FROM (SELECT event_type AS phase, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events) WHERE rn <= 25 GROUP BY 1")
def r10_resume_cursors(spark, d):
    return ranking.top_per_key(stamped(spark, d), ["event_type"], ["event_id"], 25).groupBy(F.col("event_type").alias("phase")).agg(F.max("event_id").alias("cursor"))


# batch ingest: rows of line items as spreadsheet rows, keyed by (part, supplier)

INGEST = """WITH r AS (SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_shipdate AS created, l_extendedprice AS price, CASE WHEN l_linestatus = 'F' THEN l_shipdate END AS deleted_at,
  CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS source FROM lineitem),
o AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY source, created, l_orderkey, l_linenumber, price) AS rn FROM r),
f AS (SELECT l_partkey, l_suppkey, max(CASE WHEN rn = 1 THEN l_orderkey END) AS holder, min(created) AS created, CASE WHEN count(deleted_at) = count(*) THEN max(deleted_at) END AS deleted_at, count(*) AS occurrences, count(DISTINCT l_orderkey) AS holders FROM o GROUP BY 1, 2)
"""


def spread(spark, d):
    t = table(spark, d, "lineitem")
    source = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    return t.select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", F.col("l_shipdate").alias("created"), F.col("l_extendedprice").alias("price"), F.when(F.col("l_linestatus") == "F", F.col("l_shipdate")).alias("deleted_at"), source.alias("source"))


def folded(spark, d):
    return ingest.fold_links(spread(spark, d), ["l_partkey", "l_suppkey"], ["source", "created", "l_orderkey", "l_linenumber", "price"], "l_orderkey")


@query(INGEST + "SELECT * FROM f")
def a1_fold_links(spark, d):
    return folded(spark, d)[0]


@query(INGEST + "SELECT DISTINCT l_orderkey AS holder FROM r WHERE (l_partkey, l_suppkey) IN (SELECT (l_partkey, l_suppkey) FROM f WHERE holders > 1)")
def a1_shared_holders(spark, d):
    return folded(spark, d)[1]


@query(INGEST + "SELECT holder, min(created) AS created, count(*) AS links, count(*) FILTER (deleted_at IS NULL) AS open_links FROM f GROUP BY 1")
def a1_holder_created(spark, d):
    return ingest.holder_created(folded(spark, d)[0])


# the fold of whole rows into items, editions and links, on parts that share links; links and remarks are those whose
# meaning x11 and x6 state

ROWS = f"""{EDITIONS}, w AS (SELECT part.*, p_partkey % 96 AS k, p_partkey % 16 AS j FROM part),
l AS (SELECT k, {LINK_SQL} FROM (SELECT DISTINCT k, j, k AS p_partkey FROM w)),
g AS (SELECT w.p_partkey, w.p_size % 3 = 0 AS gone, w.p_size, l.provider, coalesce(l.share, 'unknown:' || sha256(l.url)) AS canonical, 'title:' || regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') || ':0:' ||
  CASE WHEN r.season_from IS NOT NULL OR r.episode_from IS NOT NULL OR r.complete THEN 'tv' ELSE 'movie' END AS identity, r.k AS edition, r.k = 4 AS unparsed FROM w JOIN l ON l.k = w.k JOIN r ON r.k = w.p_partkey % 7),
o AS (SELECT *, row_number() OVER (PARTITION BY provider, canonical ORDER BY p_size, p_partkey) AS rn, first_value(identity || '/' || edition) OVER (PARTITION BY provider, canonical ORDER BY p_size, p_partkey) AS holder FROM g)
"""


def sheet(spark, d):
    p = table(spark, d, "part")
    url = F.replace(F.get(F.array(*[F.lit(x[0]) for x in LINKS]), (F.col("p_partkey") % 16).cast("int")), F.lit("{k}"), (F.col("p_partkey") % 96).cast("string"))
    remark = F.get(F.array(*map(F.lit, REMARKS)), (F.col("p_partkey") % 7).cast("int"))
    gone = F.when(F.col("p_size") % 3 == 0, F.col("p_partkey"))
    return p.select(F.lit(0).alias("source_priority"), F.col("p_partkey").alias("row_no"), F.col("p_name").alias("title"), F.lit("").alias("preferred"), url.alias("link"), F.lit(None).cast("string").alias("code"), remark.alias("note"), F.col("p_size").cast("long").alias("created"), gone.alias("deleted"))


@query(ROWS + """SELECT provider, sha256(canonical) AS link_hash, max(holder) AS holder, count(*) AS occurrences, min(p_size)::BIGINT AS created, CASE WHEN count(*) FILTER (NOT gone) = 0 THEN max(p_partkey) END AS deleted,
  count(DISTINCT identity || '/' || edition) > 1 AS shared FROM o GROUP BY 1, 2""")
def a1_library_links(spark, d):
    links = ingest.fold_library(sheet(spark, d))["links"]
    edition = F.array_position(F.array(*map(F.lit, REMARKS)), F.col("note")) - 1
    return links.select("provider", "link_hash", F.concat("identity", F.lit("/"), edition.cast("string")).alias("holder"), "occurrences", "created", "deleted", "shared")


@query(ROWS + """, c AS (SELECT * FROM o WHERE rn = 1 OR identity || '/' || edition <> holder)
SELECT identity, count(DISTINCT CASE WHEN edition IN (6) THEN 6 ELSE edition END) AS editions, max(unparsed) AS unparsed FROM c GROUP BY 1""")
def a1_library_items(spark, d):
    out = ingest.fold_library(sheet(spark, d))
    groups = out["editions"].groupBy("identity").agg(F.count("*").alias("editions"), F.max(F.array_contains("reasons", "unparsed_edition")).alias("unparsed"))
    return out["items"].select("identity").join(groups, "identity")


# composite reads


@query(SQL + """, g AS (SELECT e.item_id, e.edition_id, quality, hdr, count(*) AS links, string_agg(DISTINCT provider, ',' ORDER BY provider) AS providers FROM editions e JOIN live l ON l.edition_id = e.edition_id GROUP BY 1, 2, 3, 4)
SELECT i.item_id, title, count(edition_id) AS editions, coalesce(sum(links), 0)::BIGINT AS links, coalesce(string_agg(edition_id || ':' || quality || ':' || providers, ';' ORDER BY edition_id), '') AS detail FROM items i LEFT JOIN g ON g.item_id = i.item_id GROUP BY 1, 2""")
def media_detail(spark, d):
    c = Catalog.from_tables(spark, d)
    live = liveness.live_links(c.links, c.checks).groupBy("edition_id").agg(F.count("*").alias("links"), F.array_join(F.array_sort(F.collect_set("provider")), ",").alias("providers"))
    g = c.editions.join(live, "edition_id").groupBy("item_id").agg(F.count("*").alias("editions"), F.sum("links").alias("links"), F.array_sort(F.collect_list(F.struct("edition_id", F.concat_ws(":", F.col("edition_id").cast("string"), "quality", "providers").alias("t")))).alias("x"))
    rows = c.items.select("item_id", "title").join(g, "item_id", "left")
    text = F.coalesce(F.array_join(F.transform("x", lambda r: r["t"]), ";"), F.lit(""))
    return rows.select("item_id", "title", F.coalesce("editions", F.lit(0)).alias("editions"), F.coalesce("links", F.lit(0)).alias("links"), text.alias("detail"))


@query("SELECT coalesce(status, 'none') AS status, count(*) AS n, count(*) FILTER (day = DATE '2024-01-05') AS today, max_by(event_id, event_id) FILTER (status = 'error') AS last_error FROM (SELECT event_type AS status, event_id, CAST(ts AS DATE) AS day FROM events) GROUP BY 1")
def b7_status_summary(spark, d):
    e = stamped(spark, d)
    return e.groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"), F.count_if(F.to_date("ts") == F.lit("2024-01-05").cast("date")).alias("today"), F.max_by(F.when(F.col("event_type") == "error", F.col("event_id")), F.col("event_id")).alias("last_error"))


@query("SELECT user_id, event_type, value, ts + INTERVAL 1 HOUR AS expires_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def b8_preview_store(spark, d):
    e = ranking.first_per_key(table(spark, d, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])
    return e.select("user_id", "event_type", "value", (F.col("ts") + F.expr("interval 1 hour")).alias("expires_at"))


@query("SELECT count(*) AS seen, count(*) FILTER (k IS NULL) AS invalid, count(*) FILTER (k > 80) AS mapped, count(*) FILTER (k > 80 AND event_type = 'purchase') AS unlocked FROM (SELECT event_type, json_extract_string(props, '$.k')::BIGINT AS k FROM events)")
def b9_record_items(spark, d):
    e = stamped(spark, d).withColumn("k", F.from_json("props", "k bigint")["k"])
    return e.agg(F.count("*").alias("seen"), F.count_if(F.expr("k is null")).alias("invalid"), F.count_if(F.expr("k > 80")).alias("mapped"), F.count_if(F.expr("k > 80 and event_type = 'purchase'")).alias("unlocked"))


@query("SELECT event_id, CASE WHEN s_suppkey IS NOT NULL THEN 'same_local' ELSE 'inserted' END AS outcome FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY event_id) AS rn FROM (SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events)) LEFT JOIN supplier ON s_suppkey = k AND s_nationkey < 12 WHERE rn = 1")
def b10_materialise(spark, d):
    e = stamped(spark, d).select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))
    s = table(spark, d, "supplier").where("s_nationkey < 12").select(F.col("s_suppkey").alias("k"), F.lit(True).alias("known"))
    return ranking.first_per_key(e, ["k"], ["event_id"]).join(s, "k", "left").select("event_id", F.when(F.col("known"), "same_local").otherwise("inserted").alias("outcome"))


@query("SELECT count(*) FILTER (p_size > 40) AS strong, count(*) FILTER (p_size > 40 AND p_type = 'PROMO') AS conflicting, count(*) FILTER (p_size <= 5) AS weak FROM part")
def b12_reconcile(spark, d):
    return table(spark, d, "part").agg(F.count_if(F.expr("p_size > 40")).alias("strong"), F.count_if(F.expr("p_size > 40 and p_type = 'PROMO'")).alias("conflicting"), F.count_if(F.expr("p_size <= 5")).alias("weak"))


@query("SELECT user_id FROM (SELECT user_id, max(ts) AS seen FROM events GROUP BY 1) WHERE user_id NOT IN (SELECT s_suppkey FROM supplier) ORDER BY seen DESC, user_id LIMIT 20")
def b14_discover(spark, d):
    seen = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("seen"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("user_id"))
    return seen.join(s, "user_id", "left_anti").orderBy(F.desc("seen"), "user_id").limit(20).select("user_id")


@query("SELECT p_partkey, region, kind FROM (SELECT p_partkey, split_part(s, ':', 1) AS region, split_part(s, ':', 2) AS kind FROM (SELECT p_partkey, unnest(['us:movie', p_brand || ':tv', 'de:' || p_type]) AS s FROM part)) WHERE region IN ('us', 'de', 'Brand#3') AND kind IN ('movie', 'tv', 'PROMO')")
def b15_parse_sources(spark, d):
    text = F.concat(F.lit("us:movie,"), "p_brand", F.lit(":tv,de:"), "p_type")
    p = table(spark, d, "part").select("p_partkey", F.explode(F.split(text, ",")).alias("s"))
    p = p.select("p_partkey", F.split_part("s", F.lit(":"), F.lit(1)).alias("region"), F.split_part("s", F.lit(":"), F.lit(2)).alias("kind"))
    return p.where(F.col("region").isin("us", "de", "Brand#3") & F.col("kind").isin("movie", "tv", "PROMO"))


@query("SELECT c_custkey FROM customer LEFT JOIN (SELECT user_id, min(ts) AS nx FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1) ON user_id = c_custkey ORDER BY nx IS NULL, c_custkey LIMIT 100")
def b17_follow_order(spark, d):
    nx = table(spark, d, "events").where(F.col("ts") > F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).groupBy(F.col("user_id").alias("c_custkey")).agg(F.min("ts").alias("nx"))
    return table(spark, d, "customer").select("c_custkey").join(nx, "c_custkey", "left").orderBy(F.col("nx").isNull(), "c_custkey").limit(100).select("c_custkey")


@query("SELECT p_brand, p_partkey AS item_id FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY (p_type = 'PROMO') DESC, p_partkey) AS rn FROM part) WHERE rn = 1")
def b18_local_id(spark, d):
    return ranking.first_per_key(table(spark, d, "part"), ["p_brand"], [(F.col("p_type") == "PROMO").desc(), "p_partkey"]).select("p_brand", F.col("p_partkey").alias("item_id"))


@query("SELECT p_partkey, CASE WHEN s_suppkey IS NOT NULL AND s_acctbal >= 0 THEN 'complete' WHEN s_suppkey IS NOT NULL THEN 'retryable' ELSE 'failed' END AS status, coalesce(s_acctbal, p_retailprice) AS score FROM part LEFT JOIN supplier ON s_suppkey = p_partkey % 150")
def b21_enrich(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), "s_acctbal")
    j = table(spark, d, "part").join(s, F.col("p_partkey") % 150 == F.col("k"), "left")
    return j.select("p_partkey", F.when(F.col("k").isNotNull() & (F.col("s_acctbal") >= 0), "complete").when(F.col("k").isNotNull(), "retryable").otherwise("failed").alias("status"), F.coalesce("s_acctbal", "p_retailprice").alias("score"))


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN s_acctbal < 0 THEN 'retryable' WHEN s_acctbal < 1000 THEN 'empty' ELSE 'ok' END AS status FROM supplier) GROUP BY 1")
def b31_cache_counts(spark, d):
    b = F.col("s_acctbal")
    return table(spark, d, "supplier").groupBy(F.when(b < 0, "retryable").when(b < 1000, "empty").otherwise("ok").alias("status")).agg(F.count("*").alias("n"))


@query("""WITH v AS (SELECT *, CASE WHEN event_type = 'error' THEN 'unknown' WHEN value > 60 THEN 'invalid' ELSE 'valid' END AS verdict FROM events),
i AS (SELECT *, sum((verdict <> 'unknown')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM v),
u AS (SELECT *, sum((verdict = 'unknown')::INT) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS unknowns, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM i)
SELECT user_id, verdict, unknowns::BIGINT AS unknowns, CASE WHEN verdict = 'valid' THEN 1209600 WHEN verdict = 'invalid' THEN 604800 WHEN unknowns >= 5 THEN 604800 ELSE 86400 END AS delay FROM u WHERE rn = 1""")
def b32_link_check_round(spark, d):
    from ..functions.catalog import check_delay

    e = stamped(spark, d)
    verdict = F.when(F.col("event_type") == "error", "unknown").when(F.col("value") > 60, "invalid").otherwise("valid")
    e = e.withColumn("verdict", verdict).join(S.unknown_runs(e), "event_id")
    last = ranking.first_per_key(e, ["user_id"], [F.desc("ts"), F.desc("event_id")])
    return last.select("user_id", "verdict", "unknowns", check_delay(F.col("verdict"), F.col("unknowns")).alias("delay"))


@query("SELECT count(*) FILTER (s_nationkey < 8) AS queued, count(*) FILTER (s_nationkey BETWEEN 8 AND 15) AS disabled, count(*) FILTER (s_nationkey > 15) AS unsupported FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49)")
def b34_queue_recheck(spark, d):
    ids = table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey"))
    s = table(spark, d, "supplier").join(ids, "s_suppkey", "left_semi")
    return s.agg(F.count_if(F.expr("s_nationkey < 8")).alias("queued"), F.count_if(F.expr("s_nationkey between 8 and 15")).alias("disabled"), F.count_if(F.expr("s_nationkey > 15")).alias("unsupported"))


@query("SELECT DISTINCT k FROM (SELECT s_suppkey AS k FROM supplier UNION ALL SELECT user_id FROM events)")
def b35_enqueue_index(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("k")).union(table(spark, d, "events").select("user_id")).distinct()


@query("SELECT p_name, min_by(p_brand, p_partkey) AS brand, min_by(p_size, p_partkey) FILTER (p_size > 20) AS size, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS types FROM part GROUP BY 1")
def b39_first_row_attributes(spark, d):
    return table(spark, d, "part").groupBy("p_name").agg(F.min_by("p_brand", "p_partkey").alias("brand"), F.min_by(F.when(F.col("p_size") > 20, F.col("p_size")), F.when(F.col("p_size") > 20, F.col("p_partkey"))).alias("size"), F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("types"))


@query("SELECT tier, count(*) AS n FROM (SELECT CASE WHEN p_size > 40 THEN 0 WHEN p_size > 30 THEN 1 WHEN p_size > 10 THEN 2 ELSE 3 END AS tier FROM part) GROUP BY 1")
def b47_tier_histogram(spark, d):
    s = F.col("p_size")
    return table(spark, d, "part").groupBy(F.when(s > 40, 0).when(s > 30, 1).when(s > 10, 2).otherwise(3).alias("tier")).agg(F.count("*").alias("n"))


@query("SELECT conv_id, count(*) AS turns, count(DISTINCT role) AS roles, min_by(text, turn) AS opening FROM conversations GROUP BY 1")
def follow_rows(spark, d):
    c = table(spark, d, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.countDistinct("role").alias("roles"), F.min_by("text", "turn").alias("opening"))


@query("SELECT day, event_type, n, sum(n) OVER (PARTITION BY event_type ORDER BY day)::BIGINT AS running FROM (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2)")
def r9_attempt_log(spark, d):
    n = stamped(spark, d).groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    return n.withColumn("running", F.sum("n").over(Window.partitionBy("event_type").orderBy("day")))
