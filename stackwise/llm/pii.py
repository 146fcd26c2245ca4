"""Operator 8: PII pseudonyms by keyed Feistel permutations within each value's format, in DataFrame functions only.

Numbers and dates are found by pattern and validated (Luhn, octets, calendar, areas). Valid ones are permuted by an
eight-round Feistel network over A x B, with SHA-256 of key, kind, round and the other half as round function, and
written back in their own layout; equal values map to equal pseudonyms in every document and different ones to different
ones.

* cards: the first digit stays, the inner digits are permuted, the Luhn digit is recomputed
* phones: country code, and first national digit, stay; the other digits are permuted
* IPv4 addresses; dates (within 65,536 days, about 179 years), day or month first as the calendar allows (day first where
  both do), written without leading zeros where the original has a single digit; dates before the year 1003 or after 9793
  are no personal dates and stay
* US identity numbers: only issued areas, groups and serials are valid, and stand for valid ones
* e-mail addresses get a keyed local part; access keys and password/token values a keyed value of the same length
  and alphabet (not numbers: a keyed digest, 48 bits or more, links them)

The key is a secret of the caller: who has it can undo the permutations. ``session_key`` reads it from the session.

Defined results: null text stays null with no finding, empty text stays empty; an invalid number stays as it is; of
kinds that fit the same place (ties) the first in PATTERNS counts; a null doc_id keeps its row; repeated rows get equal
results; long texts are read whole (a domain has at most 127 labels, as names have; Java's matcher recurses on unbounded
groups, so there are none here); columns of any name pass, but for ``pii``, which is replaced.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY_SETTING = "spark.stackwise.pii.key"
#: kind, pattern; in order of preference at the same place
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){0,125}\.[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z])(?i:password|passwd|pwd|secret|token|api_?key)[ ]{0,3}[=:][ ]{0,3}[\"']?(?=[A-Za-z_+/-]{0,80}[0-9])[A-Za-z0-9_+/-]{8,200}+",
    "key": r"(?<![A-Z0-9])AKIA[A-Z0-9]{16}(?![A-Z0-9])",
    "phone": r"\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9.(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
    "date": r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])|(?<![0-9./])[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9.])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
}
ANY = "|".join(PATTERNS.values())
KINDS = tuple(PATTERNS)
DAYS = 65_536


def session_key(spark: SparkSession) -> str:
    """The setting spark.stackwise.pii.key. Where it is not set, a random key, kept for the rest of the session."""
    if not (key := spark.conf.get(KEY_SETTING, None)):
        spark.conf.set(KEY_SETTING, key := secrets.token_hex(16))
    return key


def keyed(key: str, kind: str | Column, value: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{key}|"), kind if isinstance(kind, Column) else F.lit(kind), F.lit("|"), value), 256)


def feistel(x: Column, a: Column, b: Column, key: str, kind: Column) -> Column:
    """A permutation of 0 .. a*b-1: odd rounds add to the left half, even rounds to the right one."""

    def f(half: Column, i: Column, size: Column) -> Column:
        digest = keyed(key, kind, F.concat(i.cast("string"), F.lit("|"), half.cast("string")))
        return F.pmod(F.conv(F.substring(digest, 1, 14), 16, 10).cast("long"), size)

    start = F.struct(F.floor(x / b).cast("long").alias("l"), F.pmod(x, b).cast("long").alias("r"))
    step = lambda s, i: F.when(i % 2 == 1, F.struct(F.pmod(s["l"] + f(s["r"], i, a), a).alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), F.pmod(s["r"] + f(s["l"], i, b), b).alias("r")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(8)), start, step, lambda s: s["l"] * b + s["r"])


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def lay_out(m: Column, digits: Column) -> Column:
    """m with its digits replaced one after another."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    step = lambda s, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(s["out"], F.substr(digits, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at")))
    return F.aggregate(F.split(m, ""), start, step, lambda s: s["out"])


def luhn_sum(digits: Column, doubled: int) -> Column:
    """Luhn's sum where places with the parity ``doubled``, counted from the right, are doubled."""

    def step(s, i):
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        d2 = F.when(i % 2 == doubled, d * 2).otherwise(d)
        return s + F.when(d2 > 9, d2 - 9).otherwise(d2)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step)


def kind_of(m: Column) -> Column:
    kind = F.lit(KINDS[-1])
    for k in reversed(KINDS[:-1]):
        kind = F.when(m.rlike(f"^(?:{PATTERNS[k]})$"), k).otherwise(kind)
    return kind


def kept_digits(r: Column) -> Column:
    """How many leading digits stay: a card's first, a phone's country code and first national digit."""
    code = F.length(F.regexp_extract(r["old"], r"^\+([0-9]{1,3})(?![0-9])", 1))
    phone = F.when(F.startswith(r["old"], F.lit("+")) & (code == 0), F.lit(3)).otherwise(code + 1)
    return F.when(r["kind"] == "card", 1).when(r["kind"] == "phone", phone).otherwise(0)


def day_of(m: Column) -> Column:
    day = F.coalesce(*[F.try_to_date(m, f) for f in ("yyyy-MM-dd", "d.M.yyyy", "d/M/yyyy", "M/d/yyyy")])
    return F.datediff(day, F.lit("1900-01-01").cast("date")).cast("long")


def block_of(day: Column) -> Column:
    return F.floor(day / DAYS)


def written_date(m: Column, day: Column) -> Column:
    """day in the layout of m: its order, its separators, and leading zeros unless m has a single digit."""
    plain = m.rlike("(^|[./])[0-9][./]")
    dd, mm = (F.when(plain, F.date_format(day, p)).otherwise(F.date_format(day, p * 2)) for p in ("d", "M"))
    sep = F.when(F.contains(m, F.lit(".")), ".").otherwise("/")
    second = F.regexp_extract(m, r"^[0-9]+([./])[0-9]+([./])", 2)
    month_first = F.contains(m, F.lit("/")) & F.try_to_date(m, "d/M/yyyy").isNull()
    return F.when(m.rlike("^[0-9]{4}-"), F.date_format(day, "yyyy-MM-dd")).otherwise(F.concat(F.when(month_first, mm).otherwise(dd), sep, F.when(month_first, dd).otherwise(mm), second, F.date_format(day, "yyyy")))


AREAS, GROUPS, SERIALS = 898, 99, 9999  # 001 to 899 without 666; 01 to 99; 0001 to 9999


def issued(digits: Column) -> Column:
    """The number of a US identity number among the valid ones, from 0; null for invalid ones."""
    area, group, serial = (F.substring(digits, at, size).cast("long") for at, size in ((1, 3), (4, 2), (6, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    return F.when(valid, ((area - F.when(area > 666, 2).otherwise(1)) * GROUPS + group - 1) * SERIALS + serial - 1)


def issued_digits(y: Column) -> Column:
    area = F.floor(y / (GROUPS * SERIALS)) + 1
    parts = ((F.when(area > 665, area + 1).otherwise(area), 3), (F.pmod(F.floor(y / SERIALS), F.lit(GROUPS)) + 1, 2), (F.pmod(y, F.lit(SERIALS)) + 1, 4))
    return F.concat(*[F.lpad(v.cast("string"), size, "0") for v, size in parts])


def place(r: Column) -> Column:
    """struct(x, a, b): the valid value's number x in 0 .. a*b-1; null for invalid and for other kinds."""
    n = F.length(r["digits"])
    octets = F.transform(F.split(r["old"], r"\."), lambda x: x.cast("long"))
    ip = F.aggregate(octets, F.lit(0).cast("long"), lambda s, x: s * 256 + x)
    digits = lambda low, high, size: F.struct(F.substr(r["digits"], low, size).cast("long").alias("x"), F.pow(F.lit(10), high).cast("long").alias("a"), F.pow(F.lit(10), size - high).cast("long").alias("b"))
    fixed = lambda x, side: F.struct(x.alias("x"), F.lit(side).cast("long").alias("a"), F.lit(side).cast("long").alias("b"))
    tail = n - r["keep"] - F.when(r["kind"] == "card", 1).otherwise(0)
    cut = F.ceil(tail / 2).cast("int")
    number = (
        F.when(r["kind"] == "card", (luhn_sum(r["digits"], 1) % 10 == 0) & (n <= 19))
        .when(r["kind"] == "phone", (n >= 8) & (tail >= 4) & (n <= 18))
        .otherwise(False)
    )
    day = day_of(r["old"])
    number_of = issued(r["digits"])
    return (
        F.when(number, digits(r["keep"] + 1, cut, tail))
        .when((r["kind"] == "ssn") & number_of.isNotNull(), F.struct(number_of.alias("x"), F.lit(AREAS * GROUPS).cast("long").alias("a"), F.lit(SERIALS).cast("long").alias("b")))
        .when((r["kind"] == "ip") & F.forall(octets, lambda x: x < 256), fixed(ip, 65536))
        .when((r["kind"] == "date") & block_of(day).between(-5, 43), fixed(F.pmod(day, F.lit(DAYS)), 256))
    )


def written(r: Column, key: str) -> Column:
    """The pseudonym of a finding with its permuted number y; null where the value is not valid."""
    m, kind = r["old"], r["kind"]
    n = F.length(r["digits"])
    size = n - r["keep"] - F.when(kind == "card", 1).otherwise(0)
    body = F.concat(F.substr(r["digits"], F.lit(1), r["keep"]), F.lpad(r["y"].cast("string"), size, "0"))
    check = F.when(kind == "card", F.pmod(F.lit(10) - luhn_sum(body, 0) % 10, F.lit(10)).cast("string")).otherwise("")
    ip = F.concat_ws(".", *[F.pmod(F.shiftright(r["y"], k), F.lit(256)).cast("string") for k in (24, 16, 8, 0)])
    date = written_date(m, F.date_add(F.lit("1900-01-01").cast("date"), (block_of(day_of(m)) * DAYS + r["y"]).cast("int")))
    email = F.concat(F.lit("u"), F.substring(keyed(key, "email", F.lower(m)), 1, 12), F.regexp_extract(m, "@.*$", 0))
    upper = F.upper(F.substring(F.translate(keyed(key, "key", m), "01", "gh"), 1, 16))
    head = F.regexp_extract(m, r"""^[A-Za-z_]+[ ]*[=:][ ]*["']?""", 0)
    tail = F.substr(m, F.length(head) + 1, F.length(m))
    stream = F.concat(*[keyed(key, f"secret{i}", tail) for i in range(4)])
    stream = F.when(tail.rlike("[a-z]"), stream).otherwise(F.upper(stream))
    return (
        F.when(kind == "email", email)
        .when(kind == "secret", F.concat(head, F.substr(stream, F.lit(1), F.length(tail))))
        .when(kind == "key", F.concat(F.lit("AKIA"), upper))
        .when(r["y"].isNull(), F.lit(None).cast("string"))
        .when(kind == "ip", ip)
        .when(kind == "date", date)
        .when(kind == "ssn", lay_out(m, issued_digits(r["y"])))
        .otherwise(lay_out(m, F.concat(body, check)))
    )


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with the text replaced, and pii: array<struct<kind, old, new>> of what was replaced, in order."""
    t = F.col(text_col).cast("string")
    d = docs.withColumn("_f", F.when(t.rlike("[0-9@]"), F.regexp_extract_all(t, F.lit(ANY), F.lit(0))))
    d = d.withColumn("_f", F.when(F.size("_f") > 0, F.col("_f")))
    # one narrow step after another keeps each expression small; all of them pass over rows without findings
    d = d.withColumn("_f", F.transform("_f", lambda m: F.struct(m.alias("old"), kind_of(m).alias("kind"), digits_of(m).alias("digits"))))
    d = d.withColumn("_f", F.transform("_f", lambda r: F.struct(r["old"].alias("old"), r["kind"].alias("kind"), r["digits"].alias("digits"), kept_digits(r).alias("keep"))))
    d = d.withColumn("_f", F.transform("_f", lambda r: F.struct(r["old"].alias("old"), r["kind"].alias("kind"), r["digits"].alias("digits"), r["keep"].alias("keep"), place(r).alias("p"))))
    d = d.withColumn("_f", F.transform("_f", lambda r: F.struct(r["old"].alias("old"), r["kind"].alias("kind"), r["digits"].alias("digits"), r["keep"].alias("keep"), F.when(r["p"].isNotNull(), feistel(r["p"]["x"], r["p"]["a"], r["p"]["b"], key, r["kind"])).alias("y"))))
    d = d.withColumn("_f", F.transform("_f", lambda r: F.struct(r["kind"].alias("kind"), r["old"].alias("old"), written(r, key).alias("new"))))
    d = d.withColumn("_p", F.when(F.col("_f").isNotNull(), F.split(t, ANY, -1)))
    joined = F.array_join(F.transform("_p", lambda p, i: F.concat(p, F.coalesce(F.get("_f", i)["new"], F.get("_f", i)["old"], F.lit("")))), "")
    d = d.withColumn(text_col, F.when(F.col("_p").isNotNull(), joined).otherwise(t))
    pii = F.coalesce(F.filter("_f", lambda x: x["new"].isNotNull()), F.array().cast("array<struct<kind:string,old:string,new:string>>"))
    return d.withColumn("pii", pii).drop("_f", "_p")


def op8_pii(spark, sf_dir: str) -> DataFrame:
    d = pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), session_key(spark))

    def count(kind: str) -> Column:
        return F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return d.select("doc_id", F.size("pii").cast("long").alias("n_pii"), *map(count, KINDS), "text")
