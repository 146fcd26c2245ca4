"""Editions: what a remark, a title or a file name says about season, episodes, picture, sound and subtitles."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import CJK_DIGITS, ZERO_WIDTH, let, normalise_col

# fixed values: rules in order; for the first four lists the first that matches decides, all others add up
QUALITY = [("2160p|4K|UHD", "2160p"), ("1080[pi]", "1080p"), ("720p", "720p"), (r"\d{3,4}p", "other")]
SOURCE = [
    ("REMUX", "remux"), ("原盘|BluRay|Blu-ray|蓝光|ISO", "bluray"), ("BDRip", "bdrip"),
    (r"WEB-?DL|WEB|HiveWeb|\bNF\b|Netflix|\bHBO\b|\bMax\b|Amazon|\bAMZN\b|Disney|\bDSNP\b|iTunes|\bATVP\b|咪咕|\bBBC\b|\biQ\b|Vivid|\bEDR\b|\bHQ\b", "webdl"),
    ("HDTV", "hdtv"),
]
HDR = [
    (r"DV\s*[&+]\s*HDR|杜比视界.*HDR", "dv_hdr"), (r"\bDV\b|杜比视界|Dolby ?Vision|\bP[58]\b", "dv"), (r"HDR10\+|HDR10P", "hdr10plus"), ("HLG", "hlg"),
    (r"HDR10|HDR|\bEDR\b|Vivid", "hdr10"), ("SDR", "sdr"),
]
CODEC = [(r"HEVC|H\.?265|x265", "hevc"), (r"AVC|H\.?264|x264", "avc"), ("AV1", "av1")]
AUDIO = [
    ("TrueHD", "truehd"), ("Atmos|杜比全景声", "atmos"), ("杜比音效", "dolby_audio"), (r"\bAAC\b", "aac"), (r"\bFLAC\b", "flac"), ("国英音轨", "mandarin+english"),
    ("国粤音轨", "mandarin+cantonese"), ("国粤英音轨", "mandarin+cantonese+english"), ("国配", "mandarin"), ("国语", "mandarin"), ("粤语", "cantonese"),
    ("英语", "english"), ("双语音轨", "dual"),
]
SUBTITLE = [
    ("内封简繁", "embedded:zh-hans+zh-hant"), ("内封简中", "embedded:zh-hans"), ("内封繁中", "embedded:zh-hant"), ("内封简英", "embedded:zh-hans+en"),
    ("内嵌简中", "embedded:zh-hans"), ("外挂简中", "external:zh-hans"), ("特效字幕", "effects"), ("简英双语", "dual:zh-hans+en"),
    ("内封AI简繁", "embedded:ai:zh-hans+zh-hant"), ("中字", "zh"), ("简/繁", "zh-hans+zh-hant"),
]
TAGS = [
    (r"\bHQ\b", "hq"), ("高码", "highbitrate"), ("60FPS|60帧", "60fps"), ("50FPS", "50fps"), ("补", "resend"), ("洗版", "rewash"), ("自购", "purchased"),
    ("仅秒传", "instant_only"), ("单集", "single"), (r"\bNF\b|Netflix", "src:netflix"), (r"\bHBO\b|\bMax\b", "src:max"), (r"Amazon|\bAMZN\b", "src:amazon"),
    (r"Disney|\bDSNP\b", "src:disney"), (r"iTunes|\bATVP\b", "src:itunes"), ("HiveWeb", "src:hive"), ("咪咕", "src:migu"), (r"\bBBC\b", "src:bbc"), (r"\biQ\b", "src:iq"),
]
FINGERPRINT_TAGS = ["hq", "highbitrate", "60fps", "50fps"]
SERIES_CUES = r"综艺|真人秀|脱口秀|更新|更至|连载|番剧|动漫|动画|纪录|系列|合辑|部曲|全\s*\d+\s*部"
SEASON = [(r"S\s*(\d{1,2})(?:\s*[-~–]\s*S?\s*(\d{1,2}))?", True), (r"Season\s*(\d+)", False), (r"第\s*(\d+)\s*季", False)]
SEASONS_IN_ALL, ALL_SEASONS = r"(\d+)\s*季全|全\s*(\d+)\s*季", "全季|季全"
EPISODE = [(r"S\d{1,2}\s*E(\d{1,3})(?:\s*[-~–]\s*E?(\d{1,3}))?", True), (r"\bE(\d{1,3})\s*[-~–]\s*E?(\d{1,3})", True), (r"第\s*(\d+)\s*集", False)]
EPISODES_IN_ALL, ALL_EPISODES = r"(\d+)\s*集全", "全集|合集"
RESOLUTION_CHIPS = [("2160p|4k|uhd", "4K"), ("1080p", "1080p"), ("720p", "720p"), (r"\bsd\b", "SD")]
RANGE_CHIPS = [
    (r"dv[\s_&+.-]*hdr(?:10)?\+?", "DV/HDR"), (r"\bdv\b|dolby[\s_-]*vision", "Dolby Vision"), (r"hdr10\+|hdr10p(?:lus)?", "HDR10+"), ("hdr10", "HDR10"),
    ("hlg", "HLG"), ("sdr", "SDR"),
]
SOURCE_CHIPS = [
    (r"web[\s_.-]*rip", "WEBRip"), (r"web[\s_.-]*dl", "WEB-DL"), (r"blu[\s_.-]*ray", "BluRay"), ("remux", "BDRemux"), ("hdtv", "HDTV"),
    (r"bd[\s_.-]*rip", "BDRip"),
]

_NUMERALS = {ord(k): str(v) for k, v in (CJK_DIGITS | {"两": 2}).items()}
_BRACKETS = "【】[]"
SCALARS = ["season_from", "season_to", "episode_from", "episode_to", "quality", "source", "hdr", "codec"]
SETS = ["audio", "subtitle", "tags"]


def prepare(text: str | None) -> str:
    """NFKC without zero-width characters, brackets as blanks, CJK numerals as digits."""
    s = unicodedata.normalize("NFKC", text or "")
    return s.translate({ord(c): None for c in ZERO_WIDTH} | {ord(c): " " for c in _BRACKETS} | _NUMERALS)


def prepared(c: Column) -> Column:
    """prepare as a column; ASCII takes a built-in function."""
    c = F.coalesce(c, F.lit(""))
    ascii_only = c.rlike(r"^[\x00-\x7F]*$")
    return F.when(ascii_only, F.translate(c, "[]", "  ")).otherwise(F.udf(prepare, "string", useArrow=True)(F.when(~ascii_only, c)))


def has(c: Column, pattern: str) -> Column:
    return c.rlike(f"(?iU){pattern}")


def number(c: Column, pattern: str, group: int = 1) -> Column:
    """The group as a number. Only what matched is cast: a cast of the empty text throws and catches, which takes twenty
    times as long as a match."""
    return let(F.regexp_extract(c, f"(?iU){pattern}", group), lambda x: F.when(x != "", x.try_cast("int")))


def first_rule(c: Column, rules: list[tuple[str, str]]) -> Column:
    out = F.lit(None).cast("string")
    for pattern, value in reversed(rules):
        out = F.when(has(c, pattern), value).otherwise(out)
    return out


def numbers(c: Column, name: str, rules: list[tuple[str, bool]], in_all: str, groups: int) -> list[Column]:
    """What spanned reads: of each rule the number and, if it is ranged, its end; and the number of all."""
    of = lambda i, p, ranged: [number(c, p, g).alias(f"{name}{i}_{g}") for g in ((1, 2) if ranged else (1,))]
    return [*[x for i, (p, ranged) in enumerate(rules) for x in of(i, p, ranged)], F.coalesce(*[number(c, in_all, g + 1) for g in range(groups)]).alias(f"{name}_all")]


def spanned(found: Column, name: str, rules: list[tuple[str, bool]]) -> tuple[Column, Column, Column]:
    """(from, to, whether a number of all was given) by the first rule that matches; a second number is the end."""
    n = found[f"{name}_all"]
    low, high = F.when(n.isNotNull(), 1), n
    firsts = [found[f"{name}{i}_1"] for i in range(len(rules))]
    for i, (_, ranged) in reversed(list(enumerate(rules))):
        a = firsts[i]
        low = F.when(a.isNotNull(), a).otherwise(low)
        high = F.when(a.isNotNull(), F.coalesce(found[f"{name}{i}_2"], a) if ranged else a).otherwise(high)
    return low, high, F.coalesce(*firsts).isNull() & n.isNotNull()


def parse_fragment(text: Column) -> Column:
    """struct of SCALARS, complete, and SETS of one prepared text."""
    return let(text, _fragment)


def _fragment(c: Column) -> Column:
    found = F.struct(*numbers(c, "s", SEASON, SEASONS_IN_ALL, 2), *numbers(c, "e", EPISODE, EPISODES_IN_ALL, 1))
    return let(found, lambda n: _described(c, n))


def _described(c: Column, found: Column) -> Column:
    s1, s2, s_all = spanned(found, "s", SEASON)
    e1, e2, e_all = spanned(found, "e", EPISODE)
    complete = s_all | e_all | (s1.isNull() & has(c, ALL_SEASONS)) | (e1.isNull() & has(c, ALL_EPISODES))
    get = lambda p, g: F.regexp_extract(c, f"(?iU){p}", g)
    dd, dts = r"(DDP|DD\+|DD)\.?\s?(\d)\.(\d)", r"DTS(-HD)?(\s*MA)?(?:\s*(\d)\.(\d))?"
    dolby = F.when(has(c, dd), F.concat(F.when(F.upper(get(dd, 1)) == "DD", "dd").otherwise("ddp"), get(dd, 2), F.lit("."), get(dd, 3)))
    dts_label = F.when(has(c, dts), F.concat(F.lit("dts"), F.when(get(dts, 1) != "", "hd").otherwise(""), F.when(get(dts, 2) != "", "ma").otherwise(""), F.when(get(dts, 3) != "", F.concat(get(dts, 3), F.lit("."), get(dts, 4))).otherwise("")))
    rating = r"豆瓣\s?(\d(?:\.\d)?)"
    rated = F.when(has(c, rating), F.concat(F.lit("douban:"), get(rating, 1)))
    every = lambda rules, *more: F.array_sort(F.array_distinct(F.array_compact(F.array(*more, *[F.when(has(c, p), v) for p, v in rules]))))
    return F.struct(
        s1.alias("season_from"), s2.alias("season_to"), e1.alias("episode_from"), e2.alias("episode_to"), first_rule(c, QUALITY).alias("quality"), first_rule(c, SOURCE).alias("source"),
        first_rule(c, HDR).alias("hdr"), first_rule(c, CODEC).alias("codec"), complete.alias("complete"), every(AUDIO, dolby, dts_label).alias("audio"), every(SUBTITLE).alias("subtitle"), every(TAGS, rated).alias("tags"),
    )


def is_blank(e: Column) -> Column:
    return F.coalesce(*[e[n].cast("string") for n in SCALARS]).isNull() & ~e["complete"] & (F.size(e["audio"]) + F.size(e["subtitle"]) + F.size(e["tags"]) == 0)


def merge_editions(*editions: Column) -> Column:
    """Per field the first non-null one; complete if any is; sets are united."""
    return let(F.struct(*[e.alias(f"e{i}") for i, e in enumerate(editions)]), lambda s: _merged([s[f"e{i}"] for i in range(len(editions))]))


def _merged(editions: list[Column]) -> Column:
    united = lambda n: F.array_sort(F.array_distinct(F.concat(*[e[n] for e in editions])))
    complete = editions[0]["complete"]
    for e in editions[1:]:
        complete = complete | e["complete"]
    return F.struct(*[F.coalesce(*[e[n] for e in editions]).alias(n) for n in SCALARS], complete.alias("complete"), *[united(n).alias(n) for n in SETS])


def parse_edition(remark: Column, title: Column | None = None, file: Column | None = None) -> Column:
    """struct of SCALARS, complete, SETS and unparsed (a remark that says something, but nothing known), from texts in
    order of trust."""
    parts = [parse_fragment(prepared(c)).alias(f"e{i}") for i, c in enumerate(x for x in (remark, title, file) if x is not None)]

    def merged(s: Column) -> Column:
        blank = s["said"] & is_blank(s["e0"])
        return let(_merged([s[f"e{i}"] for i in range(len(parts))]), lambda e: F.struct(*[e[n].alias(n) for n in [*SCALARS, "complete", *SETS]], blank.alias("unparsed")))

    return let(F.struct((normalise_col(remark) != "").alias("said"), *parts), merged)


def fingerprint(e: Column) -> Column:
    """The edition's identity within its item, in ten segments; "unspecified" where nothing is known."""
    return let(e, _fingerprint)


def _fingerprint(e: Column) -> Column:
    span = lambda p, a, b: F.when(e[a].isNotNull(), F.concat(F.lit(p), e[a].cast("string"), F.lit("-"), e[b].cast("string"))).otherwise(F.lit(f"{p}?"))
    listed = lambda p, c: F.concat(F.lit(f"{p}="), F.array_join(F.array_sort(c), "+"))
    parts = [span("s", "season_from", "season_to"), span("e", "episode_from", "episode_to"), F.when(e["complete"], "full").otherwise("part")]
    parts += [F.coalesce(e[n], F.lit("?")) for n in ("quality", "source", "hdr", "codec")]
    parts += [listed("a", e["audio"]), listed("t", e["subtitle"]), listed("x", F.array_intersect(e["tags"], F.array(*map(F.lit, FINGERPRINT_TAGS))))]
    return F.when(is_blank(e) & ~e["unparsed"], "unspecified").otherwise(F.concat_ws("|", *parts))


def edition_label(e: Column) -> Column:
    """S01E01-E06 · 1080p · webdl, without what is missing."""
    return let(e, _label)


def _label(e: Column) -> Column:
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    season = F.concat(F.lit("S"), two(e["season_from"]), F.when(e["season_to"] > e["season_from"], F.concat(F.lit("-S"), two(e["season_to"]))).otherwise(""))
    episode = F.concat(F.lit("E"), two(e["episode_from"]), F.when(e["episode_to"] > e["episode_from"], F.concat(F.lit("-E"), two(e["episode_to"]))).otherwise(""))
    head = F.nullif(F.concat(F.coalesce(season, F.lit("")), F.coalesce(episode, F.lit(""))), F.lit(""))
    return F.concat_ws(" · ", head, e["quality"], e["source"], e["hdr"], e["codec"])


def item_kind(e: Column, text: Column) -> Column:
    """A series where the edition has a season, an episode or is complete; unknown where the text sounds like one."""
    return let(F.struct(e.alias("e"), text.alias("t")), lambda s: _kind(s["e"], s["t"]))


def _kind(e: Column, text: Column) -> Column:
    series = e["season_from"].isNotNull() | e["episode_from"].isNotNull() | e["complete"]
    return F.when(series, "tv").when(has(text, SERIES_CUES), "unknown").otherwise("movie")


def spec_chips(quality: Column, hdr: Column, source: Column) -> Column:
    """struct(resolution, dynamic_range, source): display labels of single values, null where none is known."""
    label = lambda c, rules: let(F.coalesce(c, F.lit("")), lambda x: first_rule(x, rules))
    return F.struct(label(quality, RESOLUTION_CHIPS).alias("resolution"), label(hdr, RANGE_CHIPS).alias("dynamic_range"), label(source, SOURCE_CHIPS).alias("source"))


# composition: what a remote resource holds, by its publisher's words and, where they are silent, its file names

# fixed values: patterns, numerals and bounds of compositions
COMPOSITION = {
    "season_range": r"\bs(\d{1,2})\s*[-–—~～]\s*s?(\d{1,2})\b",
    "season": r"\bs(\d{1,2})(?![\d])",
    "season_cn": r"第\s*([0-9]{1,2}|[零一二两三四五六七八九十]{1,3})\s*季",
    "episode_cn_range": r"第\s*(\d{1,4})\s*[-–—~～]\s*(\d{1,4})\s*集",
    "episode_range": r"e(\d{1,4})\s*[-–—~～]\s*e?(\d{1,4})",
    "season_episode": r"s(\d{1,2})e(\d{1,4})",
    "episode_cn": r"第\s*(\d{1,4})\s*集",
    "episode": r"\bep?(\d{1,4})(?![\d])",
    "count": r"(?:全|共)?\s*(\d{1,4})\s*集",
    "file_episode": r"(?:^|[^\d])e(?:p)?(\d{1,4})(?![\d])",
}
COMPLETE, UPDATING, COLLECTION = "完结|全集", "更新中|连载|首更|更新至", "合集|全集"
NUMERALS = {"零": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10}
VIDEO = "mkv|mp4|ts|avi|m2ts|iso|rmvb|wmv|mov|flv"
MOST_SEASON, MOST_EPISODE = 99, 9999
SHOWN_COLLECTION, SHOWN_UNKNOWN = "合集", "构成未说明"


def composition(text: Column, files: Column) -> Column:
    """struct(kind, seasons, episode_start, episode_end, episode_count, completion, confidence, display). text: the first
    that is not blank of remark, title and share title; files: array of names."""
    names = F.coalesce(files, F.array().cast("array<string>"))
    return let(F.struct(F.coalesce(text, F.lit("")).alias("t"), names.alias("f")), lambda s: _composed(_declared(s["t"]), _seen(s["f"])))


def small_numeral(raw: Column) -> Column:
    """A season's number in digits or in Chinese numerals up to 99; null for anything else."""
    value = F.create_map(*[F.lit(x) for k, v in NUMERALS.items() for x in (k, v)])
    head, tail = F.substring_index(raw, "十", 1), F.regexp_extract(raw, "^[^十]*十(.*)$", 1)
    tens = F.when(head == "", 1).otherwise(F.coalesce(F.try_element_at(value, head), F.lit(1)))
    ones = F.when(tail == "", 0).otherwise(F.coalesce(F.try_element_at(value, tail), F.lit(0)))
    in_tens = F.when((tens != 0) & ones.between(0, 9), tens * 10 + ones)
    return F.when(raw.rlike("^[0-9]+$"), raw.try_cast("int")).otherwise(F.coalesce(F.try_element_at(value, raw), F.when(F.contains(raw, F.lit("十")), in_tens)))


def _within(n: Column, most: int) -> Column:
    return F.when(n.between(1, most), n)


def _declared(t: Column) -> Column:
    """What the publisher's words say: seasons, start, end, count, completion, collection."""
    rule = COMPOSITION
    lo, hi = (_within(number(t, rule["season_range"], g), MOST_SEASON) for g in (1, 2))
    every = lambda name: F.regexp_extract_all(t, F.lit(f"(?iU){rule[name]}"), F.lit(1))
    numbers = F.concat(F.transform(every("season"), lambda x: x.try_cast("int")), F.transform(every("season_cn"), small_numeral))
    listed = F.array_sort(F.array_distinct(F.filter(numbers, lambda n: n.between(1, MOST_SEASON))))
    seasons = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(listed)
    start = end = F.lit(None).cast("int")
    for name, first, last in reversed([("episode_cn_range", 1, 2), ("episode_range", 1, 2), ("season_episode", 2, 2), ("episode_cn", 1, 1), ("episode", 1, 1)]):
        a, b = (_within(number(t, rule[name], g), MOST_EPISODE) for g in (first, last))
        start, end = F.when(a <= b, a).otherwise(start), F.when(a <= b, b).otherwise(end)
    count = F.when(start.isNotNull(), end - start + 1).otherwise(_within(number(t, rule["count"]), MOST_EPISODE))
    completion = F.when(t.rlike(COMPLETE), "complete").when(t.rlike(UPDATING), "updating").otherwise("unknown")
    return F.struct(seasons.alias("seasons"), start.alias("start"), end.alias("end"), count.alias("count"), completion.alias("completion"), t.rlike(COLLECTION).alias("collection"))


def _seen(files: Column) -> Column:
    """Seasons and episodes of the video files; a name with season and episode is read for nothing else."""
    names = F.filter(files, lambda f: f.rlike(rf"(?i)\.({VIDEO})\s*$"))
    episode = lambda f: F.when(has(f, COMPOSITION["season_episode"]), number(f, COMPOSITION["season_episode"], 2)).otherwise(number(f, COMPOSITION["file_episode"]))
    sorted_ = lambda of, most: F.array_sort(F.array_distinct(F.filter(F.transform(names, of), lambda n: n.between(1, most))))
    return F.struct(sorted_(episode, MOST_EPISODE).alias("episodes"), sorted_(lambda f: number(f, COMPOSITION["season_episode"]), MOST_SEASON).alias("seasons"))


def _composed(declared: Column, seen: Column) -> Column:
    return let(F.struct(declared.alias("d"), seen.alias("s")), lambda x: _settled(x["d"], x["s"]))


def _settled(d: Column, s: Column) -> Column:
    seasons, start, end, count, completion, collection, seen = (*(d[n] for n in ("seasons", "start", "end", "count", "completion", "collection")), s["episodes"])
    inferred = count.isNull() & (F.size(seen) > 0)
    declared = (F.size(seasons) > 0) | count.isNotNull() | (completion != "unknown") | collection
    start, end = (F.when(inferred, x).otherwise(y) for x, y in ((F.array_min(seen), start), (F.array_max(seen), end)))
    count = F.when(inferred, F.size(seen)).otherwise(count)
    seasons = F.when(inferred & (F.size(seasons) == 0), s["seasons"]).otherwise(seasons)
    some = F.size(seasons) > 0
    by_completion = lambda other: F.when(completion == "complete", "season_complete").otherwise(other)
    kind = (
        F.when(start.isNotNull() & some & (completion == "complete"), "season_complete")
        .when(start.isNotNull() & some & (completion == "updating"), "season_partial")
        .when(start.isNotNull(), F.when(start == end, "episode_single").otherwise("episode_range"))
        .when(count.isNotNull() & some, by_completion(F.lit("season_partial")))
        .when(some, by_completion(F.when(completion == "updating", "season_partial").otherwise("unknown")))
        .when(collection, "collection")
        .otherwise("unknown")
    )
    confidence = F.when(inferred, "file_inferred").when(declared & ((kind != "unknown") | some | (completion != "unknown")), "declared").otherwise("unknown")
    return F.struct(kind.alias("kind"), seasons.alias("seasons"), start.alias("episode_start"), end.alias("episode_end"), count.alias("episode_count"), completion.alias("completion"), confidence.alias("confidence"), _shown(seasons, start, end, count, kind).alias("display"))


def _shown(seasons: Column, start: Column, end: Column, count: Column, kind: Column) -> Column:
    two = lambda c: F.concat(F.lit("S"), F.lpad(c.cast("string"), 2, "0"))
    season = F.when(F.size(seasons) == 1, two(F.get(seasons, 0))).when(F.size(seasons) > 1, F.concat(two(F.get(seasons, 0)), F.lit("-"), two(F.element_at(seasons, -1))))
    part = (
        F.when((kind == "collection") & (F.size(seasons) == 0), SHOWN_COLLECTION)
        .when(start == end, F.concat(F.lit("第 "), start.cast("string"), F.lit(" 集")))
        .when(start.isNotNull(), F.concat(F.lit("第 "), start.cast("string"), F.lit("–"), end.cast("string"), F.lit(" 集")))
        .when(count.isNotNull(), F.concat(count.cast("string"), F.lit("集")))
    )
    return F.coalesce(F.nullif(F.concat_ws(" · ", season, part), F.lit("")), F.lit(SHOWN_UNKNOWN))
