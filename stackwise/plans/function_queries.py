"""Queries that apply the column functions to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import catalog as C
from ..functions import editions as E
from ..functions import links as L
from ..functions import text as T
from ..operators import remote
from ..operators.ingest import parsed_once
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


ASCII_SPACED = r"trim(regexp_replace(translate(lower(text), ':-_/\|[](),~', '            '), '[\s\x1c-\x1f\x0b]+', ' ', 'g'))"


@query(f"SELECT doc_id, md5({ASCII_SPACED}) AS digest FROM documents")
def x1_normalise_ascii(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.normalise_ascii(F.col("text"))).alias("digest"))


@query(None)
def x1_normalise(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.normalise_col(F.col("text"))).alias("digest"))


@query("SELECT p_partkey, regexp_replace(lower(p_brand || ' ' || p_name), '[^a-z0-9]', '', 'g') AS key FROM part")
def x2_search_key(spark, d):
    return table(spark, d, "part").select("p_partkey", T.search_key(F.concat_ws(" ", "p_brand", "p_name")).alias("key"))


TITLES = "(SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name || ' (' || (1895 + p_partkey % 150) || ')' WHEN 1 THEN p_name || ' ()' WHEN 2 THEN p_name || ' ' || (1895 + p_partkey % 150) WHEN 3 THEN p_name || ' / ' || p_brand || '|' || p_type ELSE '  ' || p_name END AS t, CASE WHEN p_partkey % 7 = 0 THEN ' ' || p_brand || ' ' ELSE '' END AS m FROM part)"


def titles(spark, d):
    p = table(spark, d, "part")
    y = (1895 + F.col("p_partkey") % 150).cast("string")
    k = F.col("p_partkey") % 5
    t = F.when(k == 0, F.concat("p_name", F.lit(" ("), y, F.lit(")"))).when(k == 1, F.concat("p_name", F.lit(" ()"))).when(k == 2, F.concat("p_name", F.lit(" "), y)).when(k == 3, F.concat("p_name", F.lit(" / "), "p_brand", F.lit("|"), "p_type")).otherwise(F.concat(F.lit("  "), "p_name"))
    return p.select("p_partkey", t.alias("t"), F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit(" "), "p_brand", F.lit(" "))).otherwise("").alias("m"))


BASE = r"trim(CASE WHEN regexp_matches(trim(t), '\([0-9]{4}\)$') THEN regexp_replace(trim(t), '\s*\([0-9]{4}\)$', '') WHEN regexp_matches(trim(t), '\(\)$') THEN regexp_replace(trim(t), '\s*\(\)$', '') ELSE regexp_replace(trim(t), '\s[0-9]{4}$', '') END)"
YEAR = r"CASE WHEN regexp_matches(trim(t), '\(\)$') THEN NULL ELSE TRY_CAST(nullif(regexp_extract(trim(t), '\s\(?([0-9]{4})\)?$', 1), '') AS INT) END"


@query(f"SELECT p_partkey, {BASE} AS title, CASE WHEN {YEAR} BETWEEN 1900 AND 2030 THEN {YEAR} END AS year FROM {TITLES}")
def x3_split_year(spark, d):
    title, year = C.split_year(F.col("t"))
    return titles(spark, d).select("p_partkey", title.alias("title"), year.alias("year"))


@query(f"""SELECT p_partkey, title, array_to_string(aliases, ';') AS aliases, list_filter(aliases, lambda x: regexp_matches(x, '[A-Za-z]{{3,}}'))[1] AS original FROM (
  SELECT p_partkey, title, list_filter(list_transform(regexp_split_to_array(b, ' / |\\|'), lambda x: trim(x)), lambda x: x <> '' AND x <> title) AS aliases FROM (
    SELECT *, coalesce(nullif(trim(m), ''), b) AS title FROM (SELECT *, {BASE} AS b FROM {TITLES})))""")
def x4_parse_title(spark, d):
    p = titles(spark, d).select("p_partkey", C.parse_title(F.col("t"), F.col("m")).alias("x"))
    return p.select("p_partkey", "x.title", F.array_join("x.aliases", ";").alias("aliases"), "x.original")


# every part is an edition with one of these remarks and titles; the SQL states what each says
REMARKS = ["S01E02-E05 1080p WEB-DL DDP5.1 HEVC", "第二季 第3集 【2160p】 杜比视界 HDR 内封简繁", "全3季 蓝光 DTS-HD MA 7.1 豆瓣8.5", "12集全 720p HDTV 国语 中字 H264", "Se7en", "[E7-E9] 480p AAC SDR 60FPS NF", ""]
NAMES = ["", "Season 4 UHD REMUX", "１０８０ｐ 全集", "纪录 SDR AV1"]
EDITIONS = """WITH r(k, season_from, season_to, episode_from, episode_to, quality, source, hdr, codec, complete, audio, subtitle, tags) AS (VALUES
  (0, 1, 1, 2, 5, '1080p', 'webdl', NULL, 'hevc', false, 'ddp5.1', '', ''), (1, 2, 2, 3, 3, '2160p', NULL, 'dv_hdr', NULL, false, '', 'embedded:zh-hans+zh-hant', ''),
  (2, 1, 3, NULL, NULL, NULL, 'bluray', NULL, NULL, true, 'dtshdma7.1', '', 'douban:8.5'), (3, NULL, NULL, 1, 12, '720p', 'hdtv', NULL, 'avc', true, 'mandarin', 'zh', ''),
  (4, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, false, '', '', ''), (5, NULL, NULL, 7, 9, 'other', 'webdl', 'sdr', NULL, false, 'aac', '', '60fps+src:netflix'),
  (6, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, false, '', '', '')),
n(k, season_from, season_to, quality, source, hdr, codec, complete, cue) AS (VALUES (0, NULL, NULL, NULL, NULL, NULL, NULL, false, false), (1, 4, 4, '2160p', 'remux', NULL, NULL, false, false),
  (2, NULL, NULL, '1080p', NULL, NULL, NULL, true, false), (3, NULL, NULL, NULL, NULL, 'sdr', 'av1', false, true)),
e AS (SELECT p_partkey, r.k AS rk, coalesce(r.season_from, n.season_from) AS season_from, coalesce(r.season_to, n.season_to) AS season_to, episode_from, episode_to, coalesce(r.quality, n.quality) AS quality,
  coalesce(r.source, n.source) AS source, coalesce(r.hdr, n.hdr) AS hdr, coalesce(r.codec, n.codec) AS codec, r.complete OR n.complete AS complete, audio, subtitle, tags, r.k = 4 AS unparsed, cue
  FROM part JOIN r ON r.k = p_partkey % 7 JOIN n ON n.k = p_size % 4)
"""


def remarks(spark, d):
    pick = lambda xs, i: F.get(F.array(*map(F.lit, xs)), i.cast("int"))
    return table(spark, d, "part").select("p_partkey", pick(REMARKS, F.col("p_partkey") % 7).alias("r"), pick(NAMES, F.col("p_size") % 4).alias("f"))


FIELDS = [*E.SCALARS, "complete"]


@query(EDITIONS + f"SELECT p_partkey, r.{', r.'.join(FIELDS)}, audio, subtitle, tags FROM part JOIN r ON r.k = p_partkey % 7")
def x6_parse_fragment(spark, d):
    e = remarks(spark, d).select("p_partkey", E.parse_fragment(E.prepared(F.col("r"))).alias("e"))
    return e.select("p_partkey", *[f"e.{n}" for n in FIELDS], *[F.array_join(f"e.{n}", "+").alias(n) for n in E.SETS])


def editions(spark, d, *columns):
    """p_partkey and columns of e, what a part's remark and title say."""
    parse = lambda t: t.select("r", "f", E.parse_edition(F.col("r"), F.col("f")).alias("e")).select("r", "f", *columns)
    return parsed_once(remarks(spark, d), ["r", "f"], parse).drop("r", "f")


@query(EDITIONS + f"SELECT p_partkey, {', '.join(FIELDS)}, unparsed FROM e")
def x7_merge_editions(spark, d):
    return editions(spark, d, *[f"e.{n}" for n in FIELDS], "e.unparsed")


@query(EDITIONS + """, f AS (SELECT *, CASE WHEN tags LIKE '60fps%' THEN '60fps' ELSE '' END AS x FROM e)
SELECT p_partkey, CASE WHEN coalesce(season_from, episode_from) IS NULL AND coalesce(quality, source, hdr, codec) IS NULL AND NOT complete AND audio || subtitle || tags = '' AND NOT unparsed THEN 'unspecified'
  ELSE concat_ws('|', coalesce('s' || season_from || '-' || season_to, 's?'), coalesce('e' || episode_from || '-' || episode_to, 'e?'), CASE WHEN complete THEN 'full' ELSE 'part' END, coalesce(quality, '?'), coalesce(source, '?'),
    coalesce(hdr, '?'), coalesce(codec, '?'), 'a=' || audio, 't=' || subtitle, 'x=' || x) END AS fingerprint,
  concat_ws(' · ', nullif(coalesce('S' || lpad(season_from::VARCHAR, 2, '0') || CASE WHEN season_to > season_from THEN '-S' || lpad(season_to::VARCHAR, 2, '0') ELSE '' END, '') ||
    coalesce('E' || lpad(episode_from::VARCHAR, 2, '0') || CASE WHEN episode_to > episode_from THEN '-E' || lpad(episode_to::VARCHAR, 2, '0') ELSE '' END, ''), ''), quality, source, hdr, codec) AS label FROM f""")
def x10_fingerprint(spark, d):
    return editions(spark, d, E.fingerprint(F.col("e")).alias("fingerprint"), E.edition_label(F.col("e")).alias("label"))


@query(EDITIONS + "SELECT p_partkey, CASE WHEN season_from IS NOT NULL OR episode_from IS NOT NULL OR complete THEN 'tv' WHEN cue THEN 'unknown' ELSE 'movie' END AS kind FROM e")
def x8_item_kind(spark, d):
    return editions(spark, d, E.item_kind(F.col("e"), F.concat_ws(" ", "r", "f")).alias("kind"))


@query(EDITIONS + """SELECT p_partkey, CASE quality WHEN '2160p' THEN '4K' WHEN '1080p' THEN '1080p' WHEN '720p' THEN '720p' END AS resolution,
  CASE hdr WHEN 'dv_hdr' THEN 'DV/HDR' WHEN 'sdr' THEN 'SDR' END AS dynamic_range, CASE source WHEN 'webdl' THEN 'WEB-DL' WHEN 'bluray' THEN 'BluRay' WHEN 'remux' THEN 'BDRemux' WHEN 'hdtv' THEN 'HDTV' END AS source FROM e""")
def x16_specs(spark, d):
    e = editions(spark, d, E.spec_chips(F.col("e.quality"), F.col("e.hdr"), F.col("e.source")).alias("x"))
    return e.select("p_partkey", "x.*")


# remarks and file names made of each part's own numbers: s is a season, e an episode, k how many more
SAID = [r"'S' || lpad(s::string, 2, '0') || '-' || (s + k) || ' 全集'", "'EP' || e || ' 更至 5集'", "'S' || s || 'E' || e || '-E' || (e + k) || ' 首更'", "'第' || s || '季 ' || e || '集 完结'", "'第 ' || e || ' ～ ' || (e + k) || ' 集'", "'合集 ' || e || '集'", "''", "'连载 第' || substring('零一二三四五六七八九', s % 10 + 1, 1) || '季'", "'x' || s || ' notes'"]
COMPOSED = """WITH p AS (SELECT p_partkey, p_size % 30 + 1 AS s, p_partkey % 500 + 1 AS e, p_partkey % 4 AS k, p_partkey % 9 AS t, p_size % 2 = 0 AS f FROM part),
q AS (SELECT *, f AND t IN (0, 6, 7, 8) AS inferred, CASE WHEN t = 0 THEN range(s, s + k + 1) WHEN t IN (2, 3) THEN [s] WHEN t = 7 AND s % 10 > 0 THEN [s % 10] WHEN f AND t IN (6, 7, 8) THEN [2] ELSE []::INT[] END AS ss,
  CASE WHEN t IN (0, 3) THEN 'complete' WHEN t IN (2, 7) THEN 'updating' ELSE 'unknown' END AS completion FROM p),
r AS (SELECT *, CASE WHEN inferred OR t IN (1, 2, 4) THEN e END AS a, CASE WHEN inferred OR t IN (2, 4) THEN e + k WHEN t = 1 THEN e END AS b FROM q),
u AS (SELECT *, CASE WHEN inferred THEN 2 - (k = 0)::INT WHEN a IS NOT NULL THEN b - a + 1 WHEN t IN (3, 5) THEN e END AS n,
  CASE WHEN len(ss) > 0 AND (completion = 'complete') THEN 'season_complete' WHEN len(ss) > 0 AND completion = 'updating' THEN 'season_partial' WHEN a = b THEN 'episode_single' WHEN a < b THEN 'episode_range' WHEN t = 5 THEN 'collection' ELSE 'unknown' END AS kind FROM r)
SELECT p_partkey, kind, array_to_string(ss, ',') AS seasons, a AS episode_start, b AS episode_end, n AS episode_count, completion, CASE WHEN inferred THEN 'file_inferred' WHEN t IN (6, 8) THEN 'unknown' ELSE 'declared' END AS confidence,
  coalesce(nullif(concat_ws(' · ', CASE WHEN len(ss) > 0 THEN 'S' || lpad(ss[1]::VARCHAR, 2, '0') || CASE WHEN len(ss) > 1 THEN '-S' || lpad(ss[-1]::VARCHAR, 2, '0') ELSE '' END END,
    CASE WHEN kind = 'collection' THEN '合集' WHEN a = b THEN '第 ' || a || ' 集' WHEN a < b THEN '第 ' || a || '–' || b || ' 集' WHEN n IS NOT NULL THEN n || '集' END), ''), '构成未说明') AS display FROM u"""


@query(COMPOSED)
def x36_composition(spark, d):
    p = table(spark, d, "part").selectExpr("p_partkey", "p_size % 30 + 1 AS s", "p_partkey % 500 + 1 AS e", "p_partkey % 4 AS k", "p_partkey % 9 AS t", "p_size % 2 = 0 AS f")
    said = F.expr("CASE t " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(SAID)) + " END")
    files = F.expr("CASE WHEN f THEN array('Show.S02E' || e || '.mkv', 'show ep' || (e + k) || '.MP4', 'S09E09.txt', 'notes.mkv') END")
    c = p.select("p_partkey", E.composition(said, files).alias("c"))
    return c.select("p_partkey", "c.kind", F.array_join("c.seasons", ",").alias("seasons"), "c.episode_start", "c.episode_end", "c.episode_count", "c.completion", "c.confidence", "c.display")


WORKS = "CASE p_partkey % 3 WHEN 0 THEN '黑客 ' || p_brand WHEN 1 THEN 'Été, ' || p_brand ELSE p_name END"


def works():
    k = F.col("p_partkey") % 3
    return F.when(k == 0, F.concat(F.lit("黑客 "), "p_brand")).when(k == 1, F.concat(F.lit("Été, "), "p_brand")).otherwise(F.col("p_name"))


@query(f"SELECT p_partkey, CASE WHEN p_size > 30 THEN 'ext:' || p_type || ':' || p_size ELSE 'title:' || regexp_replace(lower({WORKS}), '[^\\p{{L}}0-9]', '', 'g') || ':' || coalesce(CASE WHEN p_size > 10 THEN p_size END, 0) || ':' || p_type END AS identity FROM part")
def x9_identity(spark, d):
    return table(spark, d, "part").select("p_partkey", C.identity(F.col("p_type"), F.when(F.col("p_size") > 30, F.col("p_size")), works(), F.when(F.col("p_size") > 10, F.col("p_size"))).alias("identity"))


# every part has one of these links; the SQL states what each stands for
LINKS = [
    ("HTTPS://115.com/s/swz{k}?password=ab{k}#x", "115", "115:swz{k}", "ab{k}"), ("http://www.115cdn.com/s/swz{k}", "115", "115:swz{k}", None), ("https://pan.quark.cn/s/q{k}#pwd=z{k}", "quark", "quark:q{k}", "z{k}"),
    ("https://www.alipan.com/s/a{k}/folder/f1", "alipan", "alipan:a{k}/folder/f1", None), ("https://pan.baidu.com/s/1b{k}?pwd=c{k}", "baidu", "baidu:b{k}", "c{k}"), ("https://pan.baidu.com/share/init?surl=b{k}&pwd=", "baidu", "baidu:b{k}", None),
    ("https://cloud.189.cn/web/share?code=t{k}&b=2&a=1&accessCode=d{k}", "tianyicloud", "tianyicloud:cloud.189.cn/web/share?a=1&b=2&code=t{k}", "d{k}"), ("https://guangyapan.com/g/{k}?y=2&x=%20", "guangya", "guangya:/g/{k}?x= &y=2", None),
    ("https://yun.139.com/m/i?{k}", "139cloud", "139cloud:/m/i?{k}=", None), ("https://www.123pan.com/s/n{k}.html?pwd=e{k}", "123", "123:/s/n{k}.html", "e{k}"),
    ("ed2k://|file|Some%20film.mkv|123|0123456789ABCDEF0123456789ABCDEF|/", "ed2k", "ed2k:0123456789abcdef0123456789abcdef", None), ("magnet:?xt=urn:btih:ABC{k}&dn=a%20b", "ed2k", "ed2k:abc{k}", None),
    ("https://other.org/s/{k}?pwd=f{k}", "unknown", None, "f{k}"), ("ftp://115.com/s/{k}", "unknown", None, None), ("HTTP://b.com/y?z={k}", "unknown", None, None), ("text {k}", "unknown", None, None),
]


def _filled(template: str | None) -> str:
    return "NULL" if template is None else "'" + template.replace("{k}", "' || p_partkey || '") + "'"


LINK_SQL = ", ".join("CASE p_partkey % 16 " + " ".join(f"WHEN {i} THEN {_filled(x[n])}" for i, x in enumerate(LINKS)) + f" END AS {name}" for n, name in enumerate(["url", "provider", "share", "code"]))
LINKED = f"(SELECT p_partkey, {LINK_SQL} FROM part)"


def linked(spark, d):
    urls = F.get(F.array(*[F.lit(x[0]) for x in LINKS]), (F.col("p_partkey") % 16).cast("int"))
    p = table(spark, d, "part").select("p_partkey", F.replace(urls, F.lit("{k}"), F.col("p_partkey").cast("string")).alias("url"))
    return p.select("p_partkey", "url", L.parse_link(F.col("url"), F.when(F.col("p_partkey") % 5 == 0, "own").otherwise("NULL")).alias("x"))


@query(f"SELECT p_partkey, provider, coalesce(share, 'unknown:' || sha256(url)) AS canonical, coalesce(code, CASE WHEN p_partkey % 5 = 0 THEN 'own' END) AS access_code, code IS NOT NULL AND p_partkey % 5 = 0 AS conflict FROM {LINKED}")
def x11_parse_link(spark, d):
    return linked(spark, d).select("p_partkey", "x.provider", "x.canonical", "x.access_code", "x.conflict")


@query("SELECT page_id, 'unknown' AS provider, 'unknown:' || sha256(trim(url)) AS canonical, '未知来源 · ' || regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\\.', '') AS label FROM pages")
def x11_canonical_url(spark, d):
    p = table(spark, d, "pages").select("page_id", L.parse_link(F.col("url")).alias("x"))
    return p.select("page_id", "x.provider", "x.canonical", "x.label")


@query(f"SELECT provider, count(*) AS n FROM {LINKED} GROUP BY 1")
def x11_provider(spark, d):
    return linked(spark, d).groupBy("x.provider").agg(F.count("*").alias("n"))


@query(f"SELECT p_partkey, CASE WHEN provider <> 'unknown' THEN 'save,open' WHEN url LIKE 'text%' OR url LIKE 'ftp%' THEN '' ELSE 'open,copy' END AS actions FROM (SELECT * FROM {LINKED}) WHERE true")
def x41_actions(spark, d):
    special = {p: ["save", "open"] for p in [*L.LABELS, "ed2k"]}
    return linked(spark, d).select("p_partkey", F.array_join(L.link_actions(F.col("x.provider"), F.col("x.label"), special), ",").alias("actions"))


PAGES_Q = r"(SELECT *, array_to_string(list_sort(list_transform(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> '' AND lower(string_split(x, '=')[1]) NOT IN ('pwd', 'password', 'accesscode')), lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END)), '&') AS q FROM pages)"


@query("SELECT p_partkey, CASE WHEN length(p_type) <= 4 THEN '…' ELSE substr(p_type, 1, 3) || '…' || right(p_type, 1) END AS masked FROM part")
def x12_mask(spark, d):
    return table(spark, d, "part").select("p_partkey", L.mask_code(F.col("p_type")).alias("masked"))


@query(f"SELECT page_id, q AS query FROM {PAGES_Q}")
def x13_sorted_query(spark, d):
    return table(spark, d, "pages").select("page_id", L.sorted_query(F.regexp_extract("url", r"\?([^#]*)", 1)).alias("query"))


@query("SELECT page_id, sha256(url) AS hash, substr(translate(to_base64(unhex(sha256(url))), '+/', '-_'), 1, 22) AS public_id FROM pages")
def x14_hash_and_public_id(spark, d):
    return table(spark, d, "pages").select("page_id", L.canonical_hash(F.col("url")).alias("hash"), L.public_id(F.col("url")).alias("public_id"))


RATED = "(SELECT p_partkey AS id, round((p_retailprice - 950) / 50, 2) AS s1, p_size - 20 AS v1, p_size % 11 AS s2, p_partkey % 3 AS v2 FROM part)"


def rated(spark, d):
    return table(spark, d, "part").selectExpr("p_partkey as id", "round((p_retailprice - 950) / 50, 2) as s1", "p_size - 20 as v1", "p_size % 11 as s2", "p_partkey % 3 as v2")


@query(f"SELECT id, CASE WHEN s1 > 0 AND v1 > 0 THEN s1 END AS votes_score, CASE WHEN s2 > 0 THEN s2 END AS critics_score, coalesce(CASE WHEN s1 > 0 AND v1 > 0 THEN s1 END, CASE WHEN s2 > 0 THEN s2 END)::DOUBLE AS primary_score FROM {RATED}")
def x17_ratings(spark, d):
    r = rated(spark, d).select("id", C.ratings_kept("votes", F.col("s1"), F.col("v1")).alias("a"), C.ratings_kept("critics", F.col("s2"), F.col("v2")).alias("b"))
    return r.select("id", F.col("a.score").alias("votes_score"), F.col("b.score").alias("critics_score"), F.coalesce("a.score", F.col("b.score").cast("double")).alias("primary_score"))


@query(f"SELECT id, CASE WHEN v2 = 1 THEN s2 WHEN v2 = 2 THEN v1 ELSE v1 END AS a, CASE WHEN v2 = 2 THEN s2 END AS b FROM {RATED}")
def x19_effective_ratings(spark, d):
    base = F.create_map(F.lit("a"), F.col("v1"))
    local = F.when(F.col("v2") == 1, F.create_map(F.lit("a"), F.col("s2"))).when(F.col("v2") == 2, F.create_map(F.lit("b"), F.col("s2"))).otherwise(F.create_map().cast("map<string,int>"))
    return rated(spark, d).select("id", C.overlay(base, local).alias("m")).select("id", F.try_element_at("m", F.lit("a")).alias("a"), F.try_element_at("m", F.lit("b")).alias("b"))


@query(f"SELECT id, CASE WHEN (s1 > 0)::INT + (s2 > 3)::INT = 0 THEN 'none' WHEN (s1 > 0)::INT + (s2 > 3)::INT = 2 THEN 'complete' ELSE 'partial' END AS status FROM {RATED}")
def x20_ratings_status(spark, d):
    have = F.array_compact(F.array(F.when(F.col("s1") > 0, "votes"), F.when(F.col("s2") > 3, "critics"), F.lit("other")))
    return rated(spark, d).select("id", C.ratings_status(have, F.array(F.lit("votes"), F.lit("critics"))).alias("status"))


@query("SELECT a, b, levenshtein(a, b)::INT AS distance FROM (SELECT DISTINCT split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part) WHERE levenshtein(a, b) <= 4")
def x24_levenshtein(spark, d):
    p = table(spark, d, "part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("a"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("b")).distinct()
    return p.withColumn("distance", F.levenshtein("a", "b", 4)).where("distance >= 0")


@query(None)
def x25_similarity(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.round(T.similarity("p_name", "p_type"), 6).alias("similarity"))
    return p


STAMPS = "(SELECT event_id, CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN CAST(epoch(date_trunc('second', ts)) AS BIGINT)::VARCHAR WHEN 2 THEN strftime(ts, '%Y/%m/%d %H:%M:%S') WHEN 3 THEN 'soon' ELSE '' END AS s, ts FROM events)"


@query(f"SELECT event_id, CASE WHEN event_id % 5 < 3 THEN CAST(floor(epoch(ts)) AS BIGINT) END AS epoch, event_id % 5 = 3 AS bad FROM {STAMPS}")
def x27_timestamps(spark, d):
    k, ts = F.col("event_id") % 5, F.col("ts").cast("timestamp")
    s = F.when(k == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).when(k == 1, F.unix_timestamp(ts).cast("string")).when(k == 2, F.date_format(ts, "yyyy/MM/dd HH:mm:ss")).when(k == 3, "soon").otherwise("")
    epoch, bad = C.to_epoch(F.col("s"))
    return table(spark, d, "events").select("event_id", s.alias("s")).select("event_id", epoch.alias("epoch"), bad.alias("bad"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 1 THEN NULL ELSE p_partkey END AS n FROM part")
def x28_tolerant_int(spark, d):
    k = F.col("p_partkey")
    s = F.when(k % 3 == 0, F.concat(k.cast("string"), F.lit(".0"))).when(k % 3 == 1, F.concat(k.cast("string"), F.lit("x"))).otherwise(F.concat(F.lit(" "), k.cast("string"), F.lit(" ")))
    return table(spark, d, "part").select("p_partkey", C.tolerant_int(s).alias("n"))


SHIFT = "(SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'note' ELSE url END AS link, CASE WHEN page_id % 4 = 0 THEN url WHEN page_id % 4 = 1 THEN 'fine' END AS note FROM pages)"


@query(f"SELECT page_id, page_id % 4 = 0 AS repaired, CASE WHEN page_id % 4 = 0 THEN note ELSE link END AS link, CASE WHEN page_id % 4 = 0 THEN NULL ELSE note END AS note FROM {SHIFT}")
def x29_repair_shifted(spark, d):
    from ..operators.ingest import repair_shifted

    k = F.col("page_id") % 4
    p = table(spark, d, "pages").select("page_id", F.when(k == 0, "note").otherwise(F.col("url")).alias("link"), F.when(k == 0, F.col("url")).when(k == 1, "fine").alias("note"))
    return repair_shifted(p)


@query("SELECT page_id, n, url AS fragment FROM (SELECT page_id, 0 AS n, url FROM pages UNION ALL SELECT page_id, 1, 'magnet:?xt=' || page_id FROM pages WHERE page_id % 2 = 0)")
def x30_split_links(spark, d):
    from ..operators.ingest import split_links

    cell = F.when(F.col("page_id") % 2 == 0, F.concat("url", F.lit(" magnet:?xt="), F.col("page_id").cast("string"))).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", F.posexplode(split_links(cell)).alias("n", "fragment"))


@query(f"SELECT p_partkey, NOT contains(a, b) AND NOT contains(b, a) AS conflict FROM (SELECT p_partkey, regexp_replace(lower({WORKS}), '[^\\p{{L}}0-9]', '', 'g') AS a, CASE p_size % 3 WHEN 0 THEN '黑客' WHEN 1 THEN 'été' ELSE lower(p_type) END AS b FROM part)")
def x31_alias_conflict(spark, d):
    b = F.when(F.col("p_size") % 3 == 0, "黑客").when(F.col("p_size") % 3 == 1, "É t é").otherwise(F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", C.alias_conflict(works(), b).alias("conflict"))


@query("SELECT doc_id, CASE WHEN length(text) > 120 THEN substr(text, 1, 120) || '…' ELSE text END AS overview FROM documents")
def x33_overview(spark, d):
    return table(spark, d, "documents").select("doc_id", T.short(F.col("text")).alias("overview"))


RAW = """CASE event_id % 8 WHEN 0 THEN '"115"' WHEN 1 THEN '189' WHEN 2 THEN '"aliPan"' WHEN 3 THEN '"alipan"' WHEN 4 THEN 'true' WHEN 5 THEN '115.0' WHEN 6 THEN '" 115"' ELSE 'null' END"""


@query(f"SELECT event_id, CASE event_id % 8 WHEN 0 THEN '115' WHEN 1 THEN 'tianyicloud' WHEN 2 THEN 'alipan' ELSE 'unknown' END AS provider, json_extract_string(props, '$.k')::BIGINT AS k, 'item ' || event_id AS title FROM events")
def x34_normalise_item(spark, d):
    k = F.get_json_object("props", "$.k")
    item = F.concat(F.lit('{"pan_type": '), F.expr(RAW), F.lit(', "title": " item\\u0020'), F.col("event_id").cast("string"), F.lit(' ", "unlock_points": '), k, F.lit(', "other": [1]}'))
    x = table(spark, d, "events").select("event_id", remote.normalise_item(item).alias("x"))
    return x.select("event_id", "x.provider", F.col("x.unlock_points").alias("k"), "x.title")


@query("SELECT event_id, CASE event_id % 8 WHEN 0 THEN '115' WHEN 1 THEN 'tianyicloud' WHEN 2 THEN 'alipan' ELSE 'unknown' END AS provider FROM events")
def x35_map_provider(spark, d):
    return table(spark, d, "events").select("event_id", L.remote_provider(F.expr(RAW)).alias("provider"))


@query("SELECT event_id, CASE WHEN event_type = 'error' AND value > 50 THEN 'permanent' WHEN event_type = 'error' THEN 'invalid' WHEN event_type = 'view' AND user_id > 50 THEN 'preview' WHEN event_type <> 'click' THEN event_type ELSE 'unknown' END AS status FROM events")
def x37_effective_status(spark, d):
    t = F.col("event_type")
    s = C.effective_status((t == "error") & (F.col("value") > 50), t == "error", F.col("user_id"), F.when(t == "view", "preview"), F.when(t != "click", t), F.lit(50))
    return table(spark, d, "events").select("event_id", s.alias("status"))


@query("SELECT s_suppkey, CASE WHEN s_acctbal > 4000 THEN 1209600 WHEN s_acctbal < 0 THEN 604800 WHEN s_suppkey % 8 >= 5 THEN 604800 ELSE 86400 END AS delay FROM supplier")
def x38_check_delay(spark, d):
    status = F.when(F.col("s_acctbal") > 4000, "valid").when(F.col("s_acctbal") < 0, "invalid").otherwise("unknown")
    return table(spark, d, "supplier").select("s_suppkey", C.check_delay(status, F.col("s_suppkey") % 8).alias("delay"))


# provider, code, body, verdict
ANSWERS = [
    ("tianyicloud", 200, '{"res_code": 0}', "valid:ok"), ("tianyicloud", 200, '{"res_code": "ShareNotFound"}', "invalid:share_not_found"), ("tianyicloud", 200, '{"res_code": false}', "unknown:unmapped_response"), ("tianyicloud", 200, "<html>", "unknown:parse_error"),
    ("quark", 200, '{"status": 200, "code": 0}', "valid:ok"), ("quark", 404, '{"status": 404, "code": 41012}', "invalid:share_cancelled"), ("quark", 404, '{"code": 41010}', "unknown:unmapped_response"), ("quark", 429, "{}", "unknown:rate_limited"),
    ("alipan", 200, '{"share_name": "x"}', "valid:ok"), ("alipan", 200, '{"code": "ShareLink.Expired"}', "invalid:share_expired"), ("alipan", 404, "gone", "invalid:share_not_found"), ("alipan", 403, "{}", "unknown:http_4xx"),
    ("115", 200, '{"state": true}', "valid:ok"), ("115", 200, '{"state": false, "errno": 4100010}', "invalid:share_cancelled"), ("115", 200, '{"state": 0, "error": "请稍后再试"}', "unknown:anti_bot"), ("115", 503, "", "unknown:http_5xx"), ("115", 200, "人机验证", "unknown:anti_bot"), ("other", 200, "{}", "unknown:unsupported"),
]


@query("SELECT event_id, CASE event_id % 18 " + " ".join(f"WHEN {i} THEN '{a[3]}'" for i, a in enumerate(ANSWERS)) + " END AS verdict FROM events")
def x39_classify(spark, d):
    answer = F.get(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(c).alias("c"), F.lit(b).alias("b")) for p, c, b, _ in ANSWERS]), (F.col("event_id") % 18).cast("int"))
    return table(spark, d, "events").select("event_id", answer.alias("a")).select("event_id", L.classify_response(F.col("a.p"), F.col("a.c"), F.col("a.b")).alias("verdict"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, CAST(ts + INTERVAL 8 HOUR AS DATE) AS shanghai_day FROM events")
def x40_iso(spark, d):
    ts = F.col("ts").cast("timestamp")
    return table(spark, d, "events").select("event_id", F.date_format(ts, "yyyy-MM-dd").alias("day"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"), C.local_day(ts).alias("shanghai_day"))


@query("SELECT event_id, sha256(event_type || '|' || user_id || '|' || strftime(ts, '%Y-%m-%d') || '|' || coalesce(CASE WHEN value > 50 THEN event_id END::VARCHAR, 'None')) AS event_key FROM events")
def x42_event_key(spark, d):
    return table(spark, d, "events").select("event_id", C.event_key(F.col("event_type"), F.col("user_id"), F.date_format("ts", "yyyy-MM-dd"), F.when(F.col("value") > 50, F.col("event_id"))).alias("event_key"))


@query("SELECT p_partkey, substr(sha256(p_name || '|' || p_brand || '|' || p_type), 1, 16) AS query_key FROM part")
def x43_query_key(spark, d):
    return table(spark, d, "part").select("p_partkey", C.query_key(F.col("p_name"), F.col("p_brand"), F.col("p_type")).alias("query_key"))


@query("SELECT page_id, nullif(CASE WHEN contains(url, '#top') THEN '' WHEN page_id % 3 = 0 THEN 'b' || page_id WHEN page_id % 3 = 1 THEN 'a' || page_id END, '') AS code FROM pages")
def x44_access_code(spark, d):
    k = F.col("page_id")
    u = F.regexp_replace(F.regexp_replace("url", "[?].*$", ""), "#.*$", "")
    u = F.when(F.contains("url", F.lit("#top")), F.concat(u, F.lit("#top"))).when(k % 3 == 0, F.concat(u, F.lit("?pwd=a&x=1#pwd=b"), k.cast("string"))).when(k % 3 == 1, F.concat(u, F.lit("?x=1&pwd=a"), k.cast("string"))).otherwise(u)
    return table(spark, d, "pages").select("page_id", L.code_of(F.regexp_extract(u, r"\?([^#]*)", 1), F.regexp_extract(u, "#(.*)$", 1)).alias("code"))


@query(f"SELECT p_partkey, regexp_replace(lower({WORKS}), '[^\\p{{L}}0-9]', '', 'g') AS clean FROM part")
def x45_reclean(spark, d):
    return table(spark, d, "part").select("p_partkey", T.search_key(works()).alias("clean"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(v, '^[0-9]+$') THEN v::BIGINT END AS n FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR ELSE p_type END AS v FROM part)")
def b1_as_int(spark, d):
    v = F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", F.when(v.rlike("^[0-9]+$"), v.try_cast("bigint")).alias("n"))


@query(r"SELECT page_id, nullif(substr(trim(regexp_replace(regexp_replace(regexp_replace('see ' || url || ' for' || chr(9) || 'more', '(https?|ed2k|magnet):[^ ]*', ' ', 'g'), '[\x00-\x1F\x7F]', ' ', 'g'), ' +', ' ', 'g')), 1, 200), '') AS clean FROM pages")
def b2_strip_links(spark, d):
    return table(spark, d, "pages").select("page_id", T.clean_text(F.concat(F.lit("see "), "url", F.lit(" for\tmore"))).alias("clean"))


@query("SELECT s_suppkey, CASE WHEN s_acctbal > 5000 AND s_nationkey > 10 THEN 'partial' ELSE 'pending' END AS status FROM supplier")
def b5_metadata_status(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", F.when((F.col("s_acctbal") > 5000) & (F.col("s_nationkey") > 10), "partial").otherwise("pending").alias("status"))


@query("SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'save' WHEN 'SMALL' THEN 'open' ELSE 'copy' END AS action FROM part")
def b6_action(spark, d):
    m = F.create_map(F.lit("PROMO"), F.lit("save"), F.lit("SMALL"), F.lit("open"))
    return table(spark, d, "part").select("p_partkey", F.coalesce(F.try_element_at(m, F.col("p_type")), F.lit("copy")).alias("action"))


@query(f"SELECT p_partkey, sha256(regexp_replace(lower({WORKS}), '[^\\p{{L}}0-9]', '', 'g') || '|' || p_type || '|' || p_size) AS query_hash FROM part")
def b19_query_hash(spark, d):
    return table(spark, d, "part").select("p_partkey", F.sha2(F.concat_ws("|", T.search_key(works()), "p_type", F.col("p_size").cast("string")), 256).alias("query_hash"))


@query("SELECT p_partkey, 'search:' || p_type || ':' || p_name || ':' || p_size AS cache_key FROM part")
def b26_cache_key(spark, d):
    return table(spark, d, "part").select("p_partkey", F.concat_ws(":", F.lit("search"), "p_type", "p_name", F.col("p_size").cast("string")).alias("cache_key"))
