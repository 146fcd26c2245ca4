"""Column functions on titles, identities, ratings, checks and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import search_key

YEAR_MIN, YEAR_MAX = 1900, 2030


def nullable_extract(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def split_year(c: Column) -> tuple[Column, Column]:
    """(title, year): a trailing (YYYY), () or bare YYYY is cut off; a year out of range is cut off and null."""
    s = F.trim(c)
    paren, empty, bare = r"\s*[(（]\s*([0-9]{4})\s*[)）]\s*$", r"\s*[(（]\s*[)）]\s*$", r"(?:^|\s)([0-9]{4})$"
    raw = F.coalesce(nullable_extract(s, paren), F.when(~s.rlike(empty), nullable_extract(s, bare))).try_cast("int")
    title = F.when(s.rlike(paren), F.regexp_replace(s, paren, "")).when(s.rlike(empty), F.regexp_replace(s, empty, "")).otherwise(F.regexp_replace(s, bare, ""))
    return F.trim(title), F.when(raw.between(YEAR_MIN, YEAR_MAX), raw)


def parse_title(title: Column, preferred: Column) -> Column:
    """struct(title, aliases, original, year)."""
    base, year = split_year(F.coalesce(title, F.lit("")))
    best = F.coalesce(F.nullif(F.trim(preferred), F.lit("")), base)
    parts = F.filter(F.transform(F.split(base, r" / |／|\|"), lambda x: F.trim(x)), lambda x: (x != "") & (x != best))
    original = F.get(F.filter(parts, lambda x: x.rlike("[A-Za-z]{3,}")), 0)
    return F.struct(best.alias("title"), parts.alias("aliases"), original.alias("original"), year.alias("year"))


def identity(kind: Column, external: Column, title: Column, year: Column) -> Column:
    """ext:kind:id, else title:key:year|0:kind; the key keeps the letters of every script."""
    return F.when(external.isNotNull(), F.concat_ws(":", F.lit("ext"), kind, external.cast("string"))).otherwise(F.concat_ws(":", F.lit("title"), search_key(title), F.coalesce(year, F.lit(0)).cast("string"), kind))


def ratings_kept(kind: str, score: Column, votes: Column) -> Column:
    """A source's rating counts only with a positive score, and for voted sources with votes."""
    ok = (score > 0) & (F.lit(kind == "critics") | (votes > 0))
    return F.when(ok, F.struct(F.lit(kind).alias("source"), score.alias("score"), votes.alias("votes")))


def overlay(base: Column, local: Column) -> Column:
    """Two maps as one, the local one's entries winning."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(local, k)), local)


def ratings_status(have: Column, applicable: Column) -> Column:
    n = F.size(F.array_intersect(have, applicable))
    return F.when(n == 0, "none").when(n == F.size(applicable), "complete").otherwise("partial")


def to_epoch(c: Column) -> tuple[Column, Column]:
    """(epoch seconds, bad): numbers, ISO and YYYY/MM/DD forms; bad is non-empty text that is none of them."""
    s = F.nullif(F.trim(c), F.lit(""))
    number = F.when(s.rlike(r"^[0-9]{9,12}(\.[0-9]+)?$"), s.try_cast("double").try_cast("long"))
    stamp = F.coalesce(F.try_to_timestamp(s, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(s, F.lit("yyyy/M/d H:m:s")), F.try_to_timestamp(s, F.lit("yyyy-MM-dd'T'HH:mm:ss")), F.try_to_timestamp(s, F.lit("yyyy-MM-dd")))
    out = F.coalesce(number, F.unix_timestamp(stamp))
    return out, s.isNotNull() & out.isNull()


def tolerant_int(c: Column) -> Column:
    """500001.0 and " 12 " are numbers; anything else is null."""
    s = F.trim(c)
    return F.when(s.rlike(r"^-?[0-9]+(\.0+)?$"), F.regexp_replace(s, r"\.0+$", "").try_cast("bigint"))


def alias_conflict(a: Column, b: Column) -> Column:
    x, y = search_key(a), search_key(b)
    return (x != "") & (y != "") & ~F.contains(x, y) & ~F.contains(y, x)


def check_delay(status: Column, unknowns: Column) -> Column:
    """Seconds to the next check: valid 14 days, invalid 7, unknown 1, but 7 from five in a row."""
    day = 86_400
    return F.when(status == "valid", 14 * day).when(status == "invalid", 7 * day).when(unknowns >= 5, 7 * day).otherwise(day)


def event_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts]), 256)


def query_key(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def effective_status(permanent: Column, invalid: Column, expires: Column, preview: Column, upstream: Column, now: Column) -> Column:
    """First that applies: permanent, invalid, a preview that has not expired, upstream, unknown."""
    return F.when(permanent, "permanent").when(invalid, "invalid").when(preview.isNotNull() & (expires > now), preview).when(upstream.isNotNull(), upstream).otherwise("unknown")


def local_day(c: Column, zone: str = "Asia/Shanghai") -> Column:
    return F.to_date(F.from_utc_timestamp(c, zone))
