"""Share links: provider, canonical form, access code and label, in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# fixed values: hosts of the known providers, their labels, and what a link of each may be used for
HOSTS = {
    "115.com": "115", "115cdn.com": "115", "share.115.com": "115", "anxia.com": "115",
    "cloud.189.cn": "tianyicloud", "content.21cn.com": "tianyicloud", "h5.cloud.189.cn": "tianyicloud",
    "pan.quark.cn": "quark", "alipan.com": "alipan", "aliyundrive.com": "alipan", "alywp.net": "alipan",
    "pan.baidu.com": "baidu", "yun.baidu.com": "baidu", "guangyapan.com": "guangya", "caiyun.139.com": "139cloud", "yun.139.com": "139cloud",
    "123pan.com": "123", "123684.com": "123", "123865.com": "123", "123912.com": "123", "123pan.cn": "123",
}
LABELS = {
    "115": "115 网盘", "quark": "夸克网盘", "alipan": "阿里云盘", "baidu": "百度网盘", "tianyicloud": "天翼云盘", "guangya": "光鸭网盘",
    "139cloud": "移动云盘", "123": "123 云盘",
}
REMOTE_PROVIDERS = {
    "115": "115", "189": "tianyicloud", "quark": "quark", "aliPan": "alipan", "baiDu": "baidu", "139": "139cloud", "guangYa": "guangya", "ed2k": "ed2k",
    "magnet": "ed2k",
}
CODE_KEYS = ["password", "pwd", "accesscode"]
INVALID = "无效链接"
PAIR = "array<struct<k:string,v:string>>"


def lookup(c: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def unquoted(c: Column) -> Column:
    """Percent escapes read, a plus left as it is; the text itself where they are broken."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def query_pairs(c: Column) -> Column:
    """array<struct<k, v>> of a query string, escapes read, a plus read as a blank."""
    read = lambda x: F.coalesce(F.try_url_decode(x), x)
    key = lambda p: F.split(p, "=", 2)[0]
    parts = F.filter(F.split(F.coalesce(c, F.lit("")), "&"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(read(key(p)).alias("k"), read(F.coalesce(F.get(F.split(p, "=", 2), 1), F.lit(""))).alias("v")))


def sorted_query(c: Column) -> Column:
    """Query pairs in order, without access codes."""
    kept = F.array_sort(F.filter(query_pairs(c), lambda p: ~F.lower(p["k"]).isin(*CODE_KEYS)))
    return F.array_join(F.transform(kept, lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")


def code_of(query: Column, fragment: Column) -> Column:
    """The first non-empty access code by CODE_KEYS; a key's last place in the fragment goes before its first in the query."""

    def value(key: str) -> Column:
        own = lambda pairs: F.transform(F.filter(pairs, lambda p: F.lower(p["k"]) == key), lambda p: p["v"])
        late, early = own(query_pairs(fragment)), own(query_pairs(query))
        return F.nullif(F.coalesce(F.try_element_at(late, F.lit(-1)), F.get(early, 0)), F.lit(""))

    return F.coalesce(*map(value, CODE_KEYS))


def mask_code(c: Column) -> Column:
    return F.when(F.length(c) <= 4, F.lit("…")).otherwise(F.concat(F.substring(c, 1, 3), F.lit("…"), F.substring(c, -1, 1)))


def _with_query(head: Column, query: Column) -> Column:
    q = sorted_query(query)
    return F.concat(head, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


def parse_link(url: Column, cell: Column | None = None) -> Column:
    """struct(provider, canonical, share, access_code, conflict, label).

    canonical identifies the share and never holds an access code: provider and share for the providers of HOSTS, the
    hash for ed2k and magnet links, a digest of the whole text for all else. Schemes and hosts are read in any case. cell:
    an access code given beside the link; conflict: it differs from the link's own.
    """
    pattern = r"(?is)^https?://(?:[^/?#]*@)?([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
    given = F.trim(cell) if cell is not None else F.lit(None).cast("string")

    def split(u: Column) -> Column:
        part = lambda g: F.regexp_extract(u, pattern, g)
        host = F.regexp_replace(F.regexp_replace(F.lower(part(1)), ":[0-9]*$", ""), r"^www\.", "")
        steps = F.transform(F.filter(F.split(part(2), "/"), lambda x: x != ""), unquoted)
        scheme = F.lower(F.regexp_extract(u, r"(?i)^(https?://|ed2k://|magnet:)", 1))
        return F.struct(u.alias("u"), scheme.alias("scheme"), host.alias("host"), lookup(host, HOSTS).alias("at"), part(2).alias("path"), part(3).alias("query"), part(4).alias("fragment"), steps.alias("steps"))

    def finished(x: Column) -> Column:
        x, shared, given = x["x"], x["b"], x["given"]
        u, at, digest = x["u"], x["at"], F.sha2(x["u"], 256)
        web, ed2k, magnet = F.startswith(x["scheme"], F.lit("http")), x["scheme"] == "ed2k://", x["scheme"] == "magnet:"
        e_hash, e_name = (F.regexp_extract(u, r"(?i)^ed2k://\|file\|([^|]*)\|[^|]*\|([0-9A-F]{32})\|/?", g) for g in (2, 1))
        m_hash, m_name = F.regexp_extract(u, r"(?i)btih:([A-Z0-9]+)", 1), F.substring(unquoted(F.regexp_extract(u, "(?i)[?&]dn=([^&]+)", 1)), 1, 24)
        hashed = lambda h: F.concat(F.lit("ed2k:"), F.when(h != "", F.lower(h)).otherwise(digest))
        known = web & shared["s"].isNotNull()
        provider = F.when(ed2k | magnet, "ed2k").when(known, at).otherwise("unknown")
        canonical = F.when(ed2k, hashed(e_hash)).when(magnet, hashed(m_hash)).when(known, shared["c"]).otherwise(F.concat(F.lit("unknown:"), digest))
        share = F.when(ed2k, F.substring(unquoted(e_name), 1, 24)).when(magnet, F.coalesce(F.nullif(m_name, F.lit("")), F.substring(m_hash, 1, 24))).when(known, shared["s"]).otherwise("")
        code = F.when(web, code_of(x["query"], x["fragment"])).when(magnet, code_of(F.regexp_extract(u, r"\?(.*)$", 1), F.lit("")))
        label = (
            F.when(ed2k | magnet, F.concat(F.lit("ED2K · "), F.when(share != "", share).otherwise("ed2k")))
            .when(known, F.concat(lookup(at, LABELS), F.lit(" 分享 · "), mask_code(share)))
            .when(web, F.concat(F.lit("未知来源 · "), x["host"]))
            .otherwise(INVALID)
        )
        conflict = F.coalesce(code.isNotNull() & given.isNotNull() & (code != given), F.lit(False))
        return F.struct(provider.alias("provider"), canonical.alias("canonical"), share.alias("share"), F.coalesce(code, given).alias("access_code"), conflict.alias("conflict"), label.alias("label"))

    given = F.when((given != "") & (F.upper(given) != "NULL"), given)
    whole = F.struct(let(F.trim(F.coalesce(url, F.lit(""))), split).alias("x"), given.alias("given"))
    return let(whole, lambda w: let(F.struct(w["x"].alias("x"), w["given"].alias("given"), _share(w["x"]).alias("b")), finished))


def _share(x: Column) -> Column:
    """struct(c, s): canonical form and share code of a web link by its provider's builder; null for other hosts, and s
    null where the path is none of a share."""
    at, steps, query, path, host = x["at"], x["steps"], x["query"], x["path"], x["host"]
    led = F.lower(F.get(steps, 0)) == "s"
    own = F.when(led, F.slice(steps, 2, F.greatest(F.size(steps), F.lit(1)))).otherwise(steps)
    one = F.when((F.size(own) == 1) & (F.get(own, 0) != ""), F.get(own, 0))
    surl = F.get(F.filter(query_pairs(query), lambda p: (F.lower(p["k"]) == "surl") & (p["v"] != "")), 0)["v"]
    init = F.endswith(F.lower(F.regexp_replace(path, "/+$", "")), F.lit("/share/init"))
    baidu = F.when(led, F.when(F.startswith(one, F.lit("1")) & (F.length(one) > 1), F.substr(one, F.lit(2))).otherwise(one)).when(init, surl)
    last = F.nullif(F.try_element_at(steps, F.lit(-1)), F.lit(""))
    form = lambda c, s: F.struct(c.alias("c"), s.alias("s"))
    return (
        F.when(at.isin("115", "quark"), form(F.concat_ws(":", at, one), one))
        .when(at == "alipan", form(F.concat(F.lit("alipan:"), F.array_join(own, "/")), F.get(own, 0)))
        .when(at == "baidu", form(F.concat(F.lit("baidu:"), baidu), baidu))
        .when(at == "tianyicloud", form(_with_query(F.concat(F.lit("tianyicloud:"), host, path), query), F.coalesce(last, host)))
        .when(at.isNotNull(), form(_with_query(F.concat(at, F.lit(":"), path), query), F.coalesce(last, at)))
    )


def canonical_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def public_id(c: Column) -> Column:
    return F.substring(F.translate(F.base64(F.unhex(F.sha2(c, 256))), "+/", "-_"), 1, 22)


def remote_provider(raw: Column) -> Column:
    """The provider of a remote type code as it stands in JSON: a string or a whole number; all else is unknown."""
    text = F.when(raw.rlike('^"[^"]*"$'), F.regexp_replace(raw, '"', "")).when(raw.rlike("^-?[0-9]+$"), raw)
    return F.coalesce(lookup(text, REMOTE_PROVIDERS), F.lit("unknown"))


def link_actions(provider: Column, label: Column, special: dict[str, list[str]]) -> Column:
    """What a link may be used for: a provider's own list, nothing for a text that is no link, else open and copy."""
    out = F.when((provider == "unknown") & (label == INVALID), F.array().cast("array<string>")).otherwise(F.array(F.lit("open"), F.lit("copy")))
    for name, actions in special.items():
        out = F.when(provider == name, F.array(*map(F.lit, actions))).otherwise(out)
    return out


# fixed values: what the probes of four providers answer for a share that is gone
TIANYI_GONE = {"FileNotFound": "file_deleted", "ShareNotFound": "share_not_found", "ShareAuditNotPass": "share_audit"}
QUARK_GONE = {"41011": "share_expired", "41012": "share_cancelled", "41031": "share_audit"}
ALIPAN_GONE = {"ShareLink.Cancelled": "share_cancelled", "ShareLink.Expired": "share_expired", "ShareLink.Forbidden": "share_audit", "NotFound.ShareLink": "share_not_found"}
P115_GONE = {"4100010": "share_cancelled"}
BUSY = "验证码|人机验证|频繁|稍后再试"


def classify_response(provider: Column, code: Column, body: Column) -> Column:
    """status:reason of a provider's answer. body: JSON text; members are compared as they stand there, so neither true
    nor 0.0 counts as a whole number."""
    is_object = body.rlike(r"^\s*\{")
    raw = lambda name: F.nullif(F.regexp_extract(body, rf'"{name}"\s*:\s*("[^"\\]*+(?:\\.[^"\\]*+)*+"|-?[0-9.eE+]+|true|false|null)', 1), F.lit(""))
    text = lambda name: F.when(raw(name).rlike('^"'), F.regexp_extract(raw(name), '^"(.*)"$', 1))
    verdict = lambda reason, other: F.when(reason.isNotNull(), F.concat(F.lit("invalid:"), reason)).otherwise(other)
    res, quark, state = raw("res_code"), raw("code"), raw("state")
    tianyi = F.when(~is_object | res.isNull(), "unknown:parse_error").when(res == "0", "valid:ok").otherwise(verdict(lookup(text("res_code"), TIANYI_GONE), F.lit("unknown:unmapped_response")))
    by_quark = F.when(~is_object | quark.isNull(), "unknown:parse_error").when((raw("status") == "200") & (quark == "0"), "valid:ok").otherwise(verdict(lookup(quark, QUARK_GONE), F.lit("unknown:unmapped_response")))
    by_code = F.when(code == 200, "valid:ok").when(code == 404, "invalid:share_not_found").when(code.between(400, 499), "unknown:http_4xx").otherwise("unknown:parse_error")
    alipan = F.when(is_object, verdict(lookup(text("code"), ALIPAN_GONE), by_code)).otherwise(by_code)
    p115 = (
        F.when(~is_object, F.when(body.rlike(BUSY), "unknown:anti_bot").otherwise("unknown:parse_error"))
        .when(state.isin("true", "1"), "valid:ok")
        .when(state.isNull() | ~state.isin("false", "0"), "unknown:parse_error")
        .when(F.coalesce(text("error"), F.lit("")).rlike(BUSY), "unknown:anti_bot")
        .otherwise(verdict(lookup(raw("errno"), P115_GONE), F.lit("unknown:unmapped_response")))
    )
    own = F.when(provider == "tianyicloud", tianyi).when(provider == "quark", by_quark).when(provider == "alipan", alipan).when(provider == "115", p115).otherwise("unknown:unsupported")
    return F.when(code == 429, "unknown:rate_limited").when(code >= 500, "unknown:http_5xx").otherwise(own)
