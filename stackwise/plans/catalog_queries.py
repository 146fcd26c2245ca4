"""Queries on the catalog: liveness, facets, filters, joins, per-group selection, order, queues and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import facets, filters, liveness, ranking, upserts
from ..sources.catalog import PRIMARY, SQL, Catalog, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None, base: bool = True):
    """Registers fn(catalog, spark, sf_dir) under its name with the SQL that gives the same rows."""

    def add(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Catalog.from_tables(spark, sf_dir), spark, sf_dir)
        if sql:
            ORACLES[fn.__name__] = (SQL + sql) if base else sql
        return fn

    return add


def live_of(c: Catalog) -> DataFrame:
    return liveness.live_links(c.links, c.checks)


EDITION_COUNTS = """, ec AS (
  SELECT e.edition_id, e.item_id, coalesce(n, 0) AS link_count, coalesce(p, 0) AS has_primary
  FROM editions e LEFT JOIN (SELECT edition_id, count(*) AS n, max(CASE WHEN provider = 'R' THEN 1 ELSE 0 END) AS p FROM live GROUP BY 1) x
    ON x.edition_id = e.edition_id),
ic AS (
  SELECT i.item_id, coalesce(sum(link_count), 0)::BIGINT AS link_count, coalesce(max(has_primary), 0) AS has_primary,
         count(*) FILTER (link_count > 0) AS n_live_editions
  FROM items i LEFT JOIN ec ON ec.item_id = i.item_id GROUP BY 1)
"""


def counts_of(c: Catalog) -> DataFrame:
    return liveness.recount_items(c.items, liveness.recount_editions(c.editions, live_of(c)))


# liveness and aggregates


@query("SELECT provider, count(*) AS n, count(DISTINCT edition_id) AS editions, round(sum(price), 2) AS price FROM live GROUP BY 1")
def f1_live_links(c, spark, d):
    return live_of(c).groupBy("provider").agg(F.count("*").alias("n"), F.countDistinct("edition_id").alias("editions"), F.round(F.sum("price"), 2).alias("price"))


@query(EDITION_COUNTS + "SELECT item_id, link_count, has_primary, n_live_editions FROM ic")
def a2_recount(c, spark, d):
    return counts_of(c)


@query(EDITION_COUNTS + "SELECT edition_id, item_id, link_count, has_primary FROM ec WHERE edition_id % 7 = 3")
def a3_recount_subset(c, spark, d):
    ids = c.editions.where("edition_id % 7 = 3").select("edition_id")
    return liveness.recount_subset(c.editions, live_of(c), ids)


FACETS = """, e AS (SELECT * FROM editions WHERE edition_id IN (SELECT edition_id FROM live)),
i AS (SELECT * FROM items WHERE item_id IN (SELECT item_id FROM e))
SELECT 'kind' AS facet, kind AS value, count(*) AS n FROM i GROUP BY 2
UNION ALL SELECT 'year', year::VARCHAR, count(*) FROM i WHERE year IS NOT NULL GROUP BY 2
UNION ALL SELECT 'genre', genre::VARCHAR, count(*) FROM i GROUP BY 2
UNION ALL SELECT 'provider', provider, count(*) FROM live GROUP BY 2
UNION ALL SELECT 'quality', quality, count(*) FROM e GROUP BY 2
UNION ALL SELECT 'hdr', hdr, count(*) FROM e GROUP BY 2"""


@query(FACETS.replace("SELECT 'kind'", "SELECT facet, value, n, row_number() OVER (PARTITION BY facet ORDER BY CASE WHEN facet = 'year' THEN -value::INT END NULLS LAST, CASE WHEN facet NOT IN ('year', 'kind') THEN -n END NULLS LAST, value)::INT AS position FROM (SELECT 'kind'", 1) + ")")
def a4_facets(c, spark, d):
    return facets.facets(c.items, c.editions, live_of(c))


@query("SELECT s AS status, coalesce(n, 0) AS n FROM (SELECT unnest(['F', 'O', 'P', 'X']) AS s) LEFT JOIN (SELECT hdr, count(*) AS n FROM editions GROUP BY 1) ON hdr = s")
def a5_status_totals(c, spark, d):
    return facets.status_totals(c.editions, "hdr", ["F", "O", "P", "X"])


@query("""SELECT count(*) AS total, count(*) FILTER (hdr = 'F') AS confirmed, count(*) FILTER (hdr = 'P') AS proposed,
  count(*) FILTER (year IS NULL) AS no_year, count(*) FILTER (hdr = 'F' AND rating < 0) AS conflicts, count(*) FILTER (size > 100000 AND hdr IS DISTINCT FROM 'O') AS large
  FROM editions e JOIN items i ON i.item_id = e.item_id""")
def a6_hint_stats(c, spark, d):
    j = c.editions.join(c.items, "item_id")
    counts = {"total": "true", "confirmed": "hdr = 'F'", "proposed": "hdr = 'P'", "no_year": "year is null", "conflicts": "hdr = 'F' and rating < 0", "large": "size > 100000 and not (hdr <=> 'O')"}
    return j.agg(*[F.count_if(F.expr(e)).alias(n) for n, e in counts.items()])


@query("""SELECT l.provider, count(*) FILTER (status = 'valid') AS valid, count(*) FILTER (status = 'invalid') AS invalid, count(*) FILTER (status = 'unknown') AS unknown,
  count(*) FILTER (status IS NULL OR status = 'queued') AS unchecked, count(*) FILTER (status IS NULL OR priority_score < 3000) AS due
  FROM links l LEFT JOIN checks c ON c.provider = l.provider AND c.url_key = l.url_key WHERE NOT deleted GROUP BY 1""")
def a7_link_check_counts(c, spark, d):
    return liveness.provider_counts(c.links, c.checks)


@query("SELECT provider, n, CAST(row_number() OVER (ORDER BY CASE provider WHEN 'R' THEN 1 WHEN 'N' THEN 2 ELSE 9 END, provider) AS INT) AS position FROM (SELECT provider, sum(n)::BIGINT AS n FROM (SELECT edition_id, provider, count(*) AS n FROM live GROUP BY 1, 2) GROUP BY 1)")
def a8_provider_facets(c, spark, d):
    per = live_of(c).groupBy("edition_id", "provider").agg(F.count("*").alias("n")).groupBy("provider").agg(F.sum("n").alias("n"))
    return per.withColumn("position", F.row_number().over(Window.orderBy(*facets.provider_order("provider", ["R", "N"]))))


@query("SELECT coalesce(a.value, b.value) AS value, coalesce(a.n, 0) + coalesce(b.n, 0) AS n FROM (SELECT quality AS value, count(*) AS n FROM editions WHERE hdr = 'P' GROUP BY 1) a FULL JOIN (SELECT kind AS value, count(*) AS n FROM items GROUP BY 1 UNION ALL SELECT '1-URGENT', 5) b ON a.value = b.value")
def a9_merge_facets(c, spark, d):
    a = c.editions.where("hdr = 'P'").groupBy(F.col("quality").alias("value")).agg(F.count("*").alias("n"))
    b = c.items.groupBy(F.col("kind").alias("value")).agg(F.count("*").alias("n")).union(spark.createDataFrame([("1-URGENT", 5)], "value string, n long"))
    return facets.merge_facets(a, b)


@query("""SELECT edition_id, count(*) AS n, count(*) FILTER (NOT deleted) AS unlocked,
  concat_ws(',', CASE WHEN bool_or(provider = 'R') THEN 'R' END, CASE WHEN bool_or(provider = 'A') THEN 'A' END, CASE WHEN bool_or(provider = 'N') THEN 'N' END) AS providers,
  CASE WHEN count(*) FILTER (NOT deleted) = count(*) THEN 'unlocked' WHEN count(*) FILTER (NOT deleted) > 0 THEN 'partial' ELSE 'candidate' END AS state FROM links GROUP BY 1""")
def a10_resource_summary(c, spark, d):
    return facets.resource_summary(c.links, ["R", "A", "N"])


@query("SELECT hdr || ':' || quality AS phase_status, count(*) AS n FROM editions GROUP BY 1")
def a11_run_report(c, spark, d):
    return c.editions.groupBy(F.concat_ws(":", "hdr", "quality").alias("phase_status")).agg(F.count("*").alias("n"))


@query(", x AS (SELECT DISTINCT e.item_id FROM links l JOIN editions e ON e.edition_id = l.edition_id), y AS (SELECT DISTINCT e.item_id FROM live l JOIN editions e ON e.edition_id = l.edition_id) SELECT item_id FROM x WHERE item_id NOT IN (SELECT item_id FROM y)")
def a13_all_links_invalid(c, spark, d):
    return liveness.all_links_invalid(c.editions, c.links, live_of(c))


@query("SELECT edition_id, max(coalesce(CASE WHEN line > 2 THEN line END, part_key % 10)) AS season FROM links GROUP BY 1")
def a14_max_season(c, spark, d):
    to = F.when(F.col("line") > 2, F.col("line"))
    return c.links.groupBy("edition_id").agg(F.max(F.coalesce(to, F.col("part_key") % 10)).alias("season"))


@query("SELECT DISTINCT item_id, quality FROM editions")
def a15_distinct_ids(c, spark, d):
    return c.editions.select("item_id", "quality").distinct()


@query("SELECT kind, count(*) AS n, round(median(rating), 6) AS p50, round(max(CASE WHEN rn = least(cast(floor(n0 * 0.95) AS BIGINT), n0 - 1) THEN rating END), 6) AS p95 FROM (SELECT kind, rating, row_number() OVER (PARTITION BY kind ORDER BY rating, item_id) - 1 AS rn, count(*) OVER (PARTITION BY kind) AS n0 FROM items) GROUP BY 1")
def a18_latency_summary(c, spark, d):
    w = Window.partitionBy("kind")
    r = c.items.select("kind", "rating", (F.row_number().over(w.orderBy("rating", "item_id")) - 1).alias("rn"), F.count("*").over(w).alias("n0"))
    at = F.least(F.floor(F.col("n0") * 0.95), F.col("n0") - 1)
    return r.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.median("rating"), 6).alias("p50"), F.round(F.max(F.when(F.col("rn") == at, F.col("rating"))), 6).alias("p95"))


# filters


def _filtered(name: str, sql: str, f: filters.Filters):
    def run(c, spark, d):
        return filters.apply_filters(c.items, c.editions, c.links, live_of(c), f).select("item_id", "title", "kind", "year")

    run.__name__ = name
    query("SELECT item_id, title, kind, year FROM items i WHERE " + sql)(run)


LIVE_ONE = "EXISTS (SELECT 1 FROM editions e WHERE e.item_id = i.item_id AND EXISTS (SELECT 1 FROM live l WHERE l.edition_id = e.edition_id))"
_filtered("f2a_type_and_years", f"kind = 'BUILDING' AND year >= 1996 AND year <= 2100 AND {LIVE_ONE}", filters.Filters(kind="BUILDING", year_from=1996, year_to=2100))
_filtered("f2d_same_edition", "EXISTS (SELECT 1 FROM editions e WHERE e.item_id = i.item_id AND quality = '1-URGENT' AND hdr = 'O' AND size BETWEEN 50000 AND 150000 AND EXISTS (SELECT 1 FROM live l WHERE l.edition_id = e.edition_id))", filters.Filters(quality="1-URGENT", hdr="O", min_size=50000, max_size=150000))
_filtered("f2e_providers", "EXISTS (SELECT 1 FROM editions e WHERE e.item_id = i.item_id AND hdr = 'F' AND EXISTS (SELECT 1 FROM live l WHERE l.edition_id = e.edition_id AND provider IN ('R', 'A')))", filters.Filters(hdr="F", providers=("R", "A")))
_filtered("f2f_include_deleted", "EXISTS (SELECT 1 FROM editions e WHERE e.item_id = i.item_id AND quality = '5-LOW' AND EXISTS (SELECT 1 FROM links l WHERE l.edition_id = e.edition_id AND provider IN ('N')))", filters.Filters(quality="5-LOW", providers=("N",), include_deleted=True))
_filtered("f4_effective_filters", f"kind = 'MACHINERY' AND year >= 1993 AND {LIVE_ONE}", filters.Filters(kind="MACHINERY").over(filters.Filters(kind="BUILDING", genre=3, year_from=1993)))


@query(f"SELECT item_id, title FROM items i WHERE (genre = 5 OR kind = 'BUILDING') AND {LIVE_ONE}")
def f2b_genre(c, spark, d):
    """One of an item's genres, in any case."""
    items = c.items.withColumn("genres", F.array(F.concat(F.lit("G"), F.col("genre").cast("string")), F.when(F.col("kind") == "BUILDING", "g5").otherwise("Other")))
    return filters.apply_filters(items, c.editions, c.links, live_of(c), filters.Filters(genre="g5")).select("item_id", "title")


@query("SELECT item_id, title FROM items i WHERE rating > 100 AND kind <> 'BUILDING' AND EXISTS (SELECT 1 FROM editions e WHERE e.item_id = i.item_id)")
def f2c_has_backdrop(c, spark, d):
    items = c.items.withColumns({"backdrop": F.when(F.col("rating") > 100, F.col("title")), "overview": F.when(F.col("kind") == "BUILDING", "").otherwise(F.col("kind"))})
    return filters.apply_filters(items, c.editions, c.links, live_of(c), filters.Filters(has_backdrop=True, include_deleted=True)).select("item_id", "title")


@query("SELECT item_id, title FROM items i WHERE EXISTS (SELECT 1 FROM editions e WHERE e.item_id = i.item_id AND quality = '1-URGENT' AND edition_id % 2 = 0 AND 3 BETWEEN edition_id % 5 AND coalesce(CASE WHEN edition_id % 3 = 0 THEN edition_id % 5 + 2 END, edition_id % 5) AND EXISTS (SELECT 1 FROM live l WHERE l.edition_id = e.edition_id))")
def f2d_season(c, spark, d):
    n = F.col("edition_id")
    e = c.editions.withColumns({"season_from": n % 5, "season_to": F.when(n % 3 == 0, n % 5 + 2), "complete": n % 2 == 0})
    return filters.apply_filters(c.items, e, c.links, live_of(c), filters.Filters(quality="1-URGENT", season=3, complete=True)).select("item_id", "title")


@query(f"SELECT item_id FROM items i WHERE (kind = 'FURNITURE' AND {LIVE_ONE}) OR EXISTS (SELECT 1 FROM editions e WHERE e.item_id = i.item_id AND hdr = 'P')")
def f2g_local_or_remote(c, spark, d):
    local = filters.apply_filters(c.items, c.editions, c.links, live_of(c), filters.Filters(kind="FURNITURE"))
    return filters.either(c.items, local, c.editions.where("hdr = 'P'")).select("item_id")


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events e WHERE event_type <> 'error' AND json_extract_string(props, '$.k')::BIGINT > 50 AND NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'error' AND x.value > 90)", base=False)
def f3_remote_filter(c, spark, d):
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    bad = e.where("event_type = 'error' and value > 90").select("user_id").distinct()
    return e.where("event_type <> 'error'").where(k > 50).join(bad, "user_id", "left_anti").select("event_id", k.alias("k"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(p_name, '_') OR contains(p_name, '%') OR starts_with(p_type, 'PROMO')", base=False)
def f5_literal_prefix(c, spark, d):
    return table(spark, d, "part").where(F.contains("p_name", F.lit("_")) | F.contains("p_name", F.lit("%")) | F.startswith("p_type", F.lit("PROMO"))).select("p_partkey", "p_name")


@query("SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array(p_type, '[,;\\s]+'), lambda x: x IN ('BRASS', 'STEEL', 'PROMO', 'SMALL')), ' ') AS reasons FROM part", base=False)
def f6_allowed_reasons(c, spark, d):
    allowed = F.filter(F.split("p_type", r"[,;\s]+"), lambda x: x.isin("BRASS", "STEEL", "PROMO", "SMALL"))
    return table(spark, d, "part").select("p_partkey", F.array_join(allowed, " ").alias("reasons"))


@query("SELECT edition_id, count(*) FILTER (NOT bad OR mine) AS shown, count(*) FILTER (bad AND NOT mine) AS hidden FROM (SELECT edition_id, deleted AS bad, provider = 'R' AS mine FROM links) GROUP BY 1")
def f7_split_invalid(c, spark, d):
    bad, mine = F.col("deleted"), F.col("provider") == PRIMARY
    return c.links.groupBy("edition_id").agg(F.count_if(~bad | mine).alias("shown"), F.count_if(bad & ~mine).alias("hidden"))


@query("SELECT count(*) AS conflicts FROM events WHERE (TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) % 10) IS DISTINCT FROM (user_id % 10)", base=False)
def f8_hint_conflict(c, spark, d):
    first = F.from_json("props", "k bigint", {"mode": "PERMISSIVE"})["k"] % 10
    return table(spark, d, "events").where(~first.eqNullSafe(F.col("user_id") % 10)).agg(F.count("*").alias("conflicts"))


# joins


@query("SELECT item_id FROM items i WHERE " + LIVE_ONE)
def j1_semi(c, spark, d):
    return c.items.join(c.editions.join(live_of(c), "edition_id", "left_semi"), "item_id", "left_semi").select("item_id")


@query("SELECT l.provider, coalesce(status, 'none') AS status, count(*) AS n FROM links l LEFT JOIN checks c ON c.provider = l.provider AND c.url_key = l.url_key GROUP BY 1, 2")
def j2_left_checks(c, spark, d):
    return c.links.join(c.checks, liveness.KEY, "left").groupBy("provider", F.coalesce("status", F.lit("none")).alias("status")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM links l WHERE NOT EXISTS (SELECT 1 FROM checks c WHERE c.provider = l.provider AND c.url_key = l.url_key AND status = 'invalid')")
def j3_anti_invalid(c, spark, d):
    return c.links.join(c.checks.where("status = 'invalid'"), liveness.KEY, "left_anti").agg(F.count("*").alias("n"))


@query("SELECT e.edition_id, title, quality FROM editions e JOIN items i ON i.item_id = e.item_id WHERE size > 200000")
def j4_inner(c, spark, d):
    return c.editions.where("size > 200000").join(c.items, "item_id").select("edition_id", "title", "quality")


@query("SELECT i.item_id, title, label FROM items i JOIN (SELECT user_id, max(event_type) AS label FROM events GROUP BY 1) h ON h.user_id = i.item_id")
def j5_hints(c, spark, d):
    h = table(spark, d, "events").groupBy(F.col("user_id").alias("item_id")).agg(F.max("event_type").alias("label"))
    return c.items.join(h, "item_id").select("item_id", "title", "label")


@query("SELECT item_id FROM items i WHERE NOT EXISTS (SELECT 1 FROM editions e WHERE e.item_id = i.item_id) OR EXISTS (SELECT 1 FROM editions e WHERE e.item_id = i.item_id AND hdr = 'P')")
def j6_anti_or_semi(c, spark, d):
    flag = c.editions.groupBy("item_id").agg(F.max((F.col("hdr") == "P").cast("int")).alias("p"))
    return c.items.join(flag, "item_id", "left").where("p is null or p = 1").select("item_id")


@query("SELECT item_id FROM items LEFT JOIN (SELECT user_id, max(ts) AS seen FROM events GROUP BY 1) p ON user_id = item_id WHERE seen IS NULL OR seen < TIMESTAMP '2024-01-10 00:00:00'")
def j7_due_projection(c, spark, d):
    p = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("seen"))
    return c.items.join(p, F.col("user_id") == F.col("item_id"), "left").where((F.col("seen").isNull()) | (F.col("seen") < F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))).select("item_id")


@query("SELECT edition_id, item_id, provider, url_key FROM (SELECT e.edition_id, e.item_id, l.provider, l.url_key, row_number() OVER (PARTITION BY e.edition_id ORDER BY l.provider NULLS LAST, l.url_key, l.line, l.created) AS rn FROM editions e LEFT JOIN live l ON l.edition_id = e.edition_id) WHERE rn = 1")
def j8_two_step_left(c, spark, d):
    j = c.editions.select("edition_id", "item_id").join(live_of(c), "edition_id", "left")
    order = [F.col("provider").asc_nulls_last(), F.col("url_key").asc_nulls_last(), "line", "created"]
    return ranking.first_per_key(j, ["edition_id"], order).select("edition_id", "item_id", "provider", "url_key")


@query("SELECT item_id FROM items i WHERE NOT EXISTS (SELECT 1 FROM editions e WHERE e.item_id = i.item_id AND hdr = 'P')")
def j9_missing_rows(c, spark, d):
    return c.items.join(c.editions.where("hdr = 'P'"), "item_id", "left_anti").select("item_id")


@query("SELECT edition_id FROM editions e WHERE NOT EXISTS (SELECT 1 FROM live l WHERE l.edition_id = e.edition_id)")
def j10_without_live(c, spark, d):
    return c.editions.join(live_of(c), "edition_id", "left_anti").select("edition_id")


STAGED = """, a AS (SELECT p_partkey AS new_id, p_name AS k1, p_brand AS k2, p_partkey % 900 AS ident FROM part WHERE p_partkey % 2 = 0),
b AS (SELECT p_partkey AS old_id, p_name AS k1, p_brand AS k2, p_partkey % 700 AS ident FROM part WHERE p_partkey % 2 = 1 AND p_partkey % 5 <> 0),
a1 AS (SELECT *, count(*) OVER (PARTITION BY ident) AS n FROM a), b1 AS (SELECT *, count(*) OVER (PARTITION BY ident) AS n FROM b),
s1 AS (SELECT new_id, old_id, 1 AS stage FROM a1 JOIN b1 ON a1.ident = b1.ident + 1 AND a1.n = 1 AND b1.n = 1),
ar AS (SELECT * FROM a WHERE new_id NOT IN (SELECT new_id FROM s1)), br AS (SELECT * FROM b WHERE old_id NOT IN (SELECT old_id FROM s1)),
a2 AS (SELECT *, count(*) OVER (PARTITION BY k1) AS n FROM ar), b2 AS (SELECT *, count(*) OVER (PARTITION BY k1) AS n FROM br),
s2 AS (SELECT new_id, old_id, 2 AS stage FROM a2 JOIN b2 ON a2.k1 = b2.k1 AND a2.n = 1 AND b2.n = 1),
ar2 AS (SELECT * FROM ar WHERE new_id NOT IN (SELECT new_id FROM s2)), br2 AS (SELECT * FROM br WHERE old_id NOT IN (SELECT old_id FROM s2)),
a3 AS (SELECT *, count(*) OVER (PARTITION BY k1, k2) AS n FROM ar2), b3 AS (SELECT *, count(*) OVER (PARTITION BY k1, k2) AS n FROM br2),
s3 AS (SELECT new_id, old_id, 3 AS stage FROM a3 JOIN b3 ON a3.k1 = b3.k1 AND a3.k2 = b3.k2 AND a3.n = 1 AND b3.n = 1)
SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3"""


@query(STAGED)
def j11_staged_inheritance(c, spark, d):
    from ..operators.resolve import staged_match

    p = table(spark, d, "part")
    a = p.where("p_partkey % 2 = 0").selectExpr("p_partkey as new_id", "p_partkey % 900 as ident", "p_name as k1", "p_brand as k2")
    b = p.where("p_partkey % 2 = 1 and p_partkey % 5 <> 0").selectExpr("p_partkey as old_id", "p_partkey % 700 + 1 as ident", "p_name as k1", "p_brand as k2")
    return staged_match(a, b, [["ident"], ["k1"], ["k1", "k2"]])


@query("SELECT count(*) AS missing FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'N' AND NOT EXISTS (SELECT 1 FROM lineitem k WHERE k.l_returnflag = 'A' AND k.l_partkey = lineitem.l_partkey AND k.l_suppkey = lineitem.l_suppkey))", base=False)
def j12_missing_pairs(c, spark, d):
    pairs = lambda p: c.links.where(F.col("provider") == p).select("part_key", "url_key").distinct()
    return pairs("N").join(pairs("A"), ["part_key", "url_key"], "left_anti").agg(F.count("*").alias("missing"))


@query(EDITION_COUNTS + ", nx AS (SELECT user_id, min(ts) AS next_event FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1) SELECT i.item_id, link_count, next_event FROM items i JOIN ic ON ic.item_id = i.item_id LEFT JOIN nx ON nx.user_id = i.item_id")
def j13_scalar_subqueries(c, spark, d):
    nx = table(spark, d, "events").where(F.col("ts") > F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).groupBy(F.col("user_id").alias("item_id")).agg(F.min("ts").alias("next_event"))
    return c.items.select("item_id").join(counts_of(c).select("item_id", "link_count"), "item_id").join(nx, "item_id", "left")


# per-group selection


@query("SELECT part_key, url_key, edition_id, line FROM (SELECT *, row_number() OVER (PARTITION BY part_key, url_key ORDER BY CASE provider WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, created, edition_id, line, price) AS rn FROM links) WHERE rn = 1")
def w1_keep_first(c, spark, d):
    priority = F.when(F.col("provider") == PRIMARY, 0).when(F.col("provider") == "A", 1).otherwise(2)
    return ranking.first_per_key(c.links, ["part_key", "url_key"], [priority, "created", "edition_id", "line", "price"]).select("part_key", "url_key", "edition_id", "line")


@query("SELECT kind, genre, item_id FROM (SELECT *, row_number() OVER (PARTITION BY kind, genre ORDER BY CASE WHEN rating > 8000 THEN 3 WHEN rating > 4000 THEN 2 WHEN rating > 0 THEN 1 ELSE 0 END DESC, item_id) AS rn FROM items) WHERE rn = 1")
def w2_keeper(c, spark, d):
    rank = F.when(F.col("rating") > 8000, 3).when(F.col("rating") > 4000, 2).when(F.col("rating") > 0, 1).otherwise(0)
    return ranking.first_per_key(c.items, ["kind", "genre"], [rank.desc(), "item_id"]).select("kind", "genre", "item_id")


@query("SELECT item_id, kind, score FROM (SELECT item_id, kind, genre, CASE WHEN title LIKE '%7' THEN 100 ELSE 0 END + CASE WHEN year = 1992 THEN 20 ELSE 0 END AS score, rating, row_number() OVER (PARTITION BY kind, genre ORDER BY item_id) AS rn FROM items) WHERE rn = 1 ORDER BY score DESC, rating DESC, kind, item_id LIMIT 5")
def w3_select_candidates(c, spark, d):
    score = F.when(F.endswith("title", F.lit("7")), 100).otherwise(0) + F.when(F.col("year") == 1992, 20).otherwise(0)
    one = ranking.first_per_key(c.items.withColumn("score", score), ["kind", "genre"], ["item_id"])
    return one.orderBy(F.desc("score"), F.desc("rating"), "kind", "item_id").limit(5).select("item_id", "kind", "score")


@query("SELECT genre, kind, item_id, lane FROM (SELECT *, row_number() OVER (PARTITION BY genre, kind ORDER BY lane, item_id) AS rn FROM (SELECT genre, kind, item_id, 0 AS lane FROM items WHERE rating > 5000 UNION ALL SELECT genre, kind, item_id, 1 FROM items WHERE rating < 1000)) WHERE rn = 1 ORDER BY lane, item_id LIMIT 5")
def w4_merge_candidates(c, spark, d):
    lane = lambda cond, n: c.items.where(cond).select("genre", "kind", "item_id", F.lit(n).alias("lane"))
    one = ranking.first_per_key(lane("rating > 5000", 0).unionByName(lane("rating < 1000", 1)), ["genre", "kind"], ["lane", "item_id"])
    return one.orderBy("lane", "item_id").limit(5)


@query("SELECT item_id, identity FROM (SELECT item_id, identity, row_number() OVER (PARTITION BY identity ORDER BY item_id) AS rn FROM (SELECT item_id, CASE WHEN rating > 5000 THEN 'a:' || genre WHEN rating > 0 THEN 'b:' || kind ELSE 'c:' || item_id END AS identity FROM items)) WHERE rn = 1")
def w6_identity_dedup(c, spark, d):
    identity = F.when(F.col("rating") > 5000, F.concat(F.lit("a:"), F.col("genre").cast("string"))).when(F.col("rating") > 0, F.concat(F.lit("b:"), "kind")).otherwise(F.concat(F.lit("c:"), F.col("item_id").cast("string")))
    return ranking.first_per_key(c.items.select("item_id", identity.alias("identity")), ["identity"], ["item_id"])


@query("SELECT user_id, ts, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00') WHERE rn = 1", base=False)
def w7_next_event(c, spark, d):
    e = table(spark, d, "events").where(F.col("ts") >= F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))
    return ranking.first_per_key(e, ["user_id"], ["ts", "event_id"]).select("user_id", "ts", "event_type")


@query("SELECT turn, event_type, event_id FROM (SELECT event_type, event_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS INT) AS turn FROM events) WHERE turn <= 17 ORDER BY turn, event_type LIMIT 17", base=False)
def w8_round_robin(c, spark, d):
    return ranking.round_robin(table(spark, d, "events"), "event_type", ["ts", "event_id"], 17).select("turn", "event_type", "event_id")


@query("SELECT item_id, year, genre FROM (SELECT *, count(*) OVER (PARTITION BY year, genre, kind) AS n FROM items) WHERE n = 1")
def w9_one_to_one(c, spark, d):
    return ranking.only_singles(c.items, ["year", "genre", "kind"]).select("item_id", "year", "genre")


@query("SELECT genre, kind, item_id FROM (SELECT *, row_number() OVER (PARTITION BY genre, kind ORDER BY rating DESC, item_id) AS rn FROM items) WHERE rn = 1")
def w10_page_dedup(c, spark, d):
    return ranking.first_per_key(c.items, ["genre", "kind"], [F.desc("rating"), "item_id"]).select("genre", "kind", "item_id")


# order and queues


def _sorted(name: str, kind: str, order: str, number: int):
    def run(c, spark, d):
        rows = c.items.join(counts_of(c), "item_id")
        return ranking.page(rows, ranking.sort_keys(kind), number, 25).select("item_id", "year", "link_count", "has_primary")

    run.__name__ = name
    query(EDITION_COUNTS + f"SELECT i.item_id, year, link_count, has_primary FROM items i JOIN ic ON ic.item_id = i.item_id ORDER BY {order} LIMIT 25 OFFSET {25 * (number - 1)}")(run)


_sorted("o1_links_desc", "links_desc", "link_count DESC, i.item_id", 1)
_sorted("o1_year_desc", "year_desc", "year DESC NULLS LAST, i.item_id", 1)
_sorted("o1_year_asc", "year_asc", "year ASC NULLS LAST, i.item_id", 1)
_sorted("o2_page_three", "relevance", "has_primary DESC, link_count DESC, i.item_id", 3)
_sorted("t17_browse", "relevance", "has_primary DESC, link_count DESC, i.item_id", 1)


@query(EDITION_COUNTS + "SELECT item_id, edition_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY has_primary DESC, CASE quality WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 ELSE 9 END, edition_id) AS INT) AS position FROM (SELECT ec.*, quality FROM ec JOIN editions e ON e.edition_id = ec.edition_id)")
def o4_group_order(c, spark, d):
    rank = F.when(F.col("quality") == "1-URGENT", 1).when(F.col("quality") == "2-HIGH", 2).when(F.col("quality") == "3-MEDIUM", 3).otherwise(9)
    rows = liveness.recount_editions(c.editions, live_of(c)).join(c.editions.select("edition_id", "quality"), "edition_id")
    return rows.select("item_id", "edition_id", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("has_primary"), rank, "edition_id")).alias("position"))


@query("SELECT edition_id, string_agg(provider, ',' ORDER BY CASE WHEN provider = 'R' THEN 0 ELSE 1 END, provider) AS providers FROM (SELECT DISTINCT edition_id, provider FROM live) GROUP BY 1")
def o5_provider_order(c, spark, d):
    got = live_of(c).select("edition_id", "provider").distinct().groupBy("edition_id").agg(F.array_sort(F.collect_list(F.struct((F.col("provider") != PRIMARY).alias("o"), "provider"))).alias("ps"))
    return got.select("edition_id", F.array_join(F.transform("ps", lambda p: p["provider"]), ",").alias("providers"))


@query("SELECT edition_id, position, provider, created FROM (SELECT edition_id, provider, created, CAST(row_number() OVER (PARTITION BY edition_id ORDER BY provider = 'R' DESC, created DESC NULLS LAST, url_key, line, price) AS INT) AS position FROM links) WHERE position <= 2")
def o6_link_order(c, spark, d):
    order = [(F.col("provider") == PRIMARY).desc(), F.col("created").desc_nulls_last(), "url_key", "line", "price"]
    return ranking.top_per_key(c.links, ["edition_id"], order, 2, "position").select("edition_id", "position", "provider", "created")


@query("SELECT provider, url_key FROM (SELECT DISTINCT l.provider, l.url_key, status, priority_score FROM links l LEFT JOIN checks c ON c.provider = l.provider AND c.url_key = l.url_key WHERE NOT deleted) ORDER BY coalesce(CASE WHEN status = 'queued' THEN 1 ELSE 0 END, 0) DESC, (status IS NULL) DESC, priority_score ASC NULLS FIRST, provider, url_key LIMIT 40")
def o7_due_link_checks(c, spark, d):
    rows = c.links.where("not deleted").select(*liveness.KEY).distinct().join(c.checks, liveness.KEY, "left")
    order = [F.coalesce((F.col("status") == "queued").cast("int"), F.lit(0)).desc(), F.col("status").isNull().desc(), F.col("priority_score").asc_nulls_first(), "provider", "url_key"]
    return rows.orderBy(*order).limit(40).select("provider", "url_key")


@query("SELECT edition_id, provider, url_key FROM live ORDER BY md5('20260910|' || edition_id || '|' || provider || '|' || url_key || '|' || line), edition_id, provider, url_key, line LIMIT 50")
def o8_sample_live_links(c, spark, d):
    return ranking.sample(live_of(c), ["edition_id", "provider", "url_key", "line"], 50, 20260910).select("edition_id", "provider", "url_key")


@query(EDITION_COUNTS + "SELECT i.item_id, has_primary, link_count FROM items i JOIN ic ON ic.item_id = i.item_id WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = i.item_id AND event_type = 'signup') ORDER BY has_primary DESC, link_count DESC, i.item_id LIMIT 31")
def o9_fresh_candidates(c, spark, d):
    cached = table(spark, d, "events").where("event_type = 'signup'").select(F.col("user_id").alias("item_id"))
    return counts_of(c).join(cached, "item_id", "left_anti").orderBy(*ranking.sort_keys("relevance")).limit(31).select("item_id", "has_primary", "link_count")


@query("SELECT item_id, bucket FROM (SELECT e.item_id, CASE WHEN count(*) FILTER (l.deleted) * 2 >= count(*) FILTER (NOT l.deleted) THEN 0 WHEN max(hdr) = 'P' THEN 1 WHEN min(size) < 1000 THEN 2 ELSE 3 END AS bucket FROM editions e JOIN links l ON l.edition_id = e.edition_id WHERE e.item_id > 100 GROUP BY 1) ORDER BY bucket, item_id LIMIT 50")
def o10_refresh_queue(c, spark, d):
    j = c.editions.where("item_id > 100").join(c.links.select("edition_id", "deleted"), "edition_id").groupBy("item_id").agg(F.count_if("deleted").alias("bad"), F.count_if(~F.col("deleted")).alias("ok"), F.max("hdr").alias("h"), F.min("size").alias("s"))
    bucket = F.when(F.col("bad") * 2 >= F.col("ok"), 0).when(F.col("h") == "P", 1).when(F.col("s") < 1000, 2).otherwise(3)
    return j.select("item_id", bucket.alias("bucket")).orderBy("bucket", "item_id").limit(50)


@query("SELECT edition_id FROM editions WHERE hdr IN ('P', 'F') AND created < TIMESTAMP '1997-01-01 00:00:00' ORDER BY CASE hdr WHEN 'P' THEN 0 ELSE 1 END, created DESC, edition_id LIMIT 40")
def o11_projections_to_enrich(c, spark, d):
    rows = c.editions.where(F.col("hdr").isin("P", "F") & (F.col("created") < F.lit("1997-01-01 00:00:00").cast("timestamp_ntz")))
    return rows.orderBy(F.when(F.col("hdr") == "P", 0).otherwise(1), F.desc("created"), "edition_id").limit(40).select("edition_id")


@query("SELECT item_id FROM items WHERE (year IS NULL OR rating < 0) AND item_id > 200 ORDER BY item_id LIMIT 60")
def o12_metadata_rows(c, spark, d):
    return ranking.keyset_after(c.items.where("year is null or rating < 0").select("item_id"), "item_id", 200, 60)


@query("SELECT item_id, sha256('2026-11-26|v1|' || item_id) AS sort_key FROM items ORDER BY 2 LIMIT 24")
def o13_daily_ranking(c, spark, d):
    return ranking.daily_order(c.items, "item_id", "2026-11-26", "v1", 24)


@query("SELECT DISTINCT CAST(created AS DATE) AS day, CAST(created AS DATE) - CAST(((CAST(created AS DATE) - DATE '1970-01-01') + 719163) % 2 AS INT) AS start FROM editions")
def o14_rotation(c, spark, d):
    day = F.col("created").cast("date")
    return c.editions.select(day.alias("day"), ranking.two_day_start(day).alias("start")).distinct()


@query(f"SELECT item_id FROM items i WHERE rating BETWEEN 7500 AND 10000 AND kind IN ('BUILDING', 'AUTOMOBILE') AND {LIVE_ONE}")
def o15_eligible_pool(c, spark, d):
    pool = c.items.where("rating between 7500 and 10000 and kind in ('BUILDING', 'AUTOMOBILE')")
    return filters.apply_filters(pool, c.editions, c.links, live_of(c), filters.Filters()).select("item_id")


# set operations and upserts


@query("SELECT count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT s_suppkey FROM supplier)", base=False)
def u1_union_count(c, spark, d):
    s = table(spark, d, "supplier")
    return table(spark, d, "customer").select(F.col("c_nationkey").cast("long")).union(s.select(F.col("s_nationkey").cast("long"))).union(s.select("s_suppkey")).distinct().agg(F.count("*").alias("n"))


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(string_split(p_type, ' '), string_split(p_name, ' ')))), ' ') AS tokens FROM part", base=False)
def u2_sorted_union(c, spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(F.array_union(F.split("p_type", " "), F.split("p_name", " "))), " ").alias("tokens"))


@query("SELECT p_partkey, CASE WHEN p_brand = p_type THEN p_brand || '/' || p_name ELSE p_brand || '/' || CASE WHEN p_name = p_brand THEN p_type ELSE p_name || '/' || p_type END END AS aliases FROM part WHERE p_name <> p_type", base=False)
def u3_ordered_union(c, spark, d):
    a = F.array_distinct(F.concat(F.array("p_brand"), F.array("p_name", "p_brand"), F.array("p_type")))
    return table(spark, d, "part").where("p_name <> p_type").select("p_partkey", F.array_join(a, "/").alias("aliases"))


UPSERT_OLD = "(SELECT item_id AS k, kind AS v FROM items WHERE item_id % 3 <> 0)"
UPSERT_NEW = "(SELECT item_id AS k, max_by(quality, edition_id) AS v FROM editions WHERE item_id % 2 = 0 GROUP BY 1)"


def _old_new(c):
    old = c.items.where("item_id % 3 <> 0").select(F.col("item_id").alias("k"), F.col("kind").alias("v"))
    new = c.editions.where("item_id % 2 = 0").select(F.col("item_id").alias("k"), F.col("quality").alias("v"), "edition_id")
    return old, new


@query(f"SELECT coalesce(n.k, o.k) AS k, CASE WHEN n.k IS NULL THEN o.v ELSE n.v END AS v FROM {UPSERT_OLD} o FULL JOIN {UPSERT_NEW} n ON n.k = o.k")
def u4_upsert(c, spark, d):
    old, new = _old_new(c)
    return upserts.latest_wins(old, new, ["k"], [F.desc("edition_id")])


@query(f"SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.k IS NULL THEN n.v ELSE o.v END AS v, o.k IS NULL AS created_now FROM {UPSERT_OLD} o FULL JOIN {UPSERT_NEW} n ON n.k = o.k")
def u5_insert_only(c, spark, d):
    old, new = _old_new(c)
    return upserts.insert_only(old, new, ["k"], [F.desc("edition_id")])


@query("SELECT coalesce(o.k, n.k) AS k, coalesce(nullif(n.v, ''), o.v) AS v FROM (SELECT item_id AS k, kind AS v FROM items WHERE item_id % 3 <> 0) o FULL JOIN (SELECT item_id AS k, CASE WHEN genre % 2 = 0 THEN '' ELSE title END AS v FROM items WHERE item_id % 2 = 0) n ON n.k = o.k")
def u6_non_empty_merge(c, spark, d):
    old = c.items.where("item_id % 3 <> 0").select(F.col("item_id").alias("k"), F.col("kind").alias("v"))
    new = c.items.where("item_id % 2 = 0").select(F.col("item_id").alias("k"), F.when(F.col("genre") % 2 == 0, "").otherwise(F.col("title")).alias("v"))
    return upserts.merge_non_empty(old, new, ["k"], ["v"])


@query("SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.lvl IS NULL OR n.lvl IS NULL THEN NULL ELSE greatest(o.lvl, n.lvl) END AS lvl, coalesce(n.note, o.note) AS note FROM (SELECT item_id AS k, genre AS lvl, kind AS note FROM items WHERE item_id % 3 <> 0) o FULL JOIN (SELECT item_id AS k, year - 1985 AS lvl, CASE WHEN genre > 12 THEN title END AS note FROM items WHERE item_id % 2 = 0) n ON n.k = o.k")
def u7_monotone_merge(c, spark, d):
    old = c.items.where("item_id % 3 <> 0").select(F.col("item_id").alias("k"), F.col("genre").alias("lvl"), F.col("kind").alias("note"))
    new = c.items.where("item_id % 2 = 0").select(F.col("item_id").alias("k"), (F.col("year") - 1985).alias("lvl"), F.when(F.col("genre") > 12, F.col("title")).alias("note"))
    return upserts.merge_monotone(old, new, ["k"], ["lvl"], ["note"])


@query("SELECT DISTINCT part_key FROM links WHERE provider = 'R' AND part_key NOT IN (SELECT part_key FROM links WHERE provider = 'A' AND line = 1)")
def u8_difference(c, spark, d):
    return c.links.where("provider = 'R'").select("part_key").distinct().join(c.links.where("provider = 'A' and line = 1"), "part_key", "left_anti")


# sources


@query("SELECT source_priority, count(*) AS n, count(DISTINCT item_id) AS items FROM (SELECT item_id, 0 AS source_priority FROM editions WHERE hdr = 'F' UNION ALL SELECT item_id, 1 FROM editions WHERE hdr = 'O' UNION ALL SELECT item_id, 2 FROM editions WHERE hdr = 'P') GROUP BY 1")
def s2_ordered_sources(c, spark, d):
    from ..sources.files import ordered_union

    rows = ordered_union([c.editions.where(F.col("hdr") == h) for h in "FOP"])
    return rows.groupBy("source_priority").agg(F.count("*").alias("n"), F.countDistinct("item_id").alias("items"))


@query("SELECT item_id, string_agg(k::VARCHAR, ',' ORDER BY k) AS top FROM (SELECT item_id, k, row_number() OVER (PARTITION BY item_id ORDER BY k) AS rn FROM (SELECT DISTINCT user_id AS item_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE user_id IN (SELECT item_id FROM items WHERE kind = 'BUILDING'))) WHERE rn <= 3 GROUP BY 1")
def s4_load_hints(c, spark, d):
    known = c.items.where("kind = 'BUILDING'").select("item_id")
    h = table(spark, d, "events").select(F.col("user_id").alias("item_id"), F.from_json("props", "k bigint")["k"].alias("k")).join(known, "item_id", "left_semi")
    return h.groupBy("item_id").agg(F.array_join(F.slice(F.array_sort(F.collect_set("k")), 1, 3), ",").alias("top"))


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_suppkey IN (SELECT url_key FROM links WHERE part_key < 50)")
def s5_relevant_ratings(c, spark, d):
    return table(spark, d, "supplier").join(c.links.where("part_key < 50").select(F.col("url_key").alias("s_suppkey")), "s_suppkey", "left_semi").select("s_suppkey", "s_acctbal")


CONFIRM = """, r AS (SELECT o_orderkey AS row_no, o_custkey AS item_id, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderkey % 5 END AS t, year(o_orderdate) AS y FROM orders),
j AS (SELECT r.*, i.year, i.genre, i.item_id AS known FROM r LEFT JOIN items i ON i.item_id = r.item_id AND i.genre < 20),
v AS (SELECT *, CASE WHEN t IS NULL THEN 'bad_row' WHEN known IS NULL THEN 'missing' WHEN genre % 5 <> t THEN 'title_mismatch' WHEN year <> y THEN 'year_mismatch' END AS reason FROM j),
w AS (SELECT *, CASE WHEN reason IS NULL THEN row_number() OVER (PARTITION BY item_id, reason IS NULL ORDER BY row_no) END AS nth FROM v)
SELECT coalesce(reason, CASE WHEN nth > 1 THEN 'duplicate' ELSE 'accepted' END) AS outcome, count(*) AS n FROM w GROUP BY 1"""


@query(CONFIRM)
def s6_confirmations(c, spark, d):
    from ..operators.ingest import judge_confirmations

    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_no"), F.col("o_custkey").alias("item_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey") % 5).alias("t"), F.year("o_orderdate").alias("y"))
    known = c.items.where("genre < 20").select("item_id", (F.col("genre") % 5).cast("long").alias("known_t"), F.col("year").alias("known_y"))
    return judge_confirmations(rows, known).groupBy("outcome").agg(F.count("*").alias("n"))


@query("SELECT p_name, row_number() OVER (ORDER BY p_name) AS id FROM (SELECT DISTINCT p_name FROM part)", base=False)
def s7_stable_ids(c, spark, d):
    return upserts.assign_ids(table(spark, d, "part").select("p_name").distinct(), "p_name", "id")


@query("SELECT coalesce(n.k, o.k) AS k, coalesce(n.v, o.v) AS v, CASE WHEN n.k IS NOT NULL THEN o.v END AS prior FROM (SELECT item_id AS k, kind AS v FROM items) o FULL JOIN (SELECT item_id AS k, 'confirmed' AS v FROM items WHERE genre = 3) n ON n.k = o.k")
def s8_override(c, spark, d):
    o = c.items.select(F.col("item_id").alias("k"), F.col("kind").alias("v"))
    n = c.items.where("genre = 3").select(F.col("item_id").alias("k"), F.lit("confirmed").alias("nv"))
    return o.join(n, "k", "full_outer").select("k", F.coalesce("nv", "v").alias("v"), F.when(F.col("nv").isNotNull(), F.col("v")).alias("prior"))


@query("SELECT count(*) AS n, count(DISTINCT item_id) AS items, sum(('0x' || substr(md5(edition_id || '|' || item_id), 1, 8))::BIGINT)::BIGINT AS digest FROM editions")
def s10_report(c, spark, d):
    # a digest that does not depend on order and needs no row gathered
    return c.editions.agg(F.count("*").alias("n"), F.countDistinct("item_id").alias("items"), F.sum(upserts.row_digest("edition_id", "item_id")).alias("digest"))


@query("SELECT p_name, is_dir FROM (SELECT DISTINCT p_name, p_name LIKE 'b%' AS is_dir FROM part) ORDER BY NOT is_dir, lower(p_name) LIMIT 500", base=False)
def s12_listing(c, spark, d):
    p = table(spark, d, "part").select("p_name", F.startswith("p_name", F.lit("b")).alias("is_dir")).distinct()
    return p.orderBy(~F.col("is_dir"), F.lower("p_name")).limit(500)
