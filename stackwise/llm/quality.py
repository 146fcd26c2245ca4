"""Operator 4: quality rules with risk-controlled thresholds, in DataFrame functions only.

Every text gets its base counts and three ratios: symbols a word, duplicate lines a line, characters a word. In each
stratum (language), half of the labelled good documents that pass the base rule give the candidates: for every share in
SHARES, the cutoffs that would reject that share of them, a third by each ratio. The other half, which had no part in
that, tests them: a candidate that rejects k of n documents is admissible if P(Binomial(n, RISK) <= k) is at most
DELTA / (strata * candidates). That is the exact (Clopper-Pearson) bound with Bonferroni's correction, so with
probability 1 - DELTA no stratum loses more than RISK of its good documents. The strictest admissible candidate decides;
a stratum in which none is admissible (fewer than some 130 good labels to test by) rejects nothing beyond the base rule.

Defined results: null and empty texts have zero counts and fail the base rule; a null language is a stratum of its own;
a document labelled more than once is good only if every label says so; null labels and null doc_ids don't count for
calibration, and null doc_ids keep their rows; repeated rows get equal results and, where labelled, all count; a ratio
equal to its cutoff (ties) passes; a long text counts whole; extra columns are ignored, whatever their names; an empty
table gives an empty result, and without labels only the base rule decides.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, shared_dir

RISK = 0.05
DELTA = 0.05
#: shares of good documents that the candidates would reject, from lenient to strict
SHARES = (0.0005, 0.001, 0.0025, 0.005, 0.01)
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


def metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """doc_id, stratum, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed."""
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(stratum_col).cast("string").alias("stratum"), t.alias("t"))
    d = d.select(
        "doc_id", "stratum",
        F.length(F.translate("t", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0).alias("lines"),
        F.array_remove(F.split(F.translate("t", BLANKS, " " * len(BLANKS)), " "), "").alias("words"),
    )
    d = d.select(
        "doc_id", "stratum", "word_chars", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("w"),
    )
    windows = F.transform(F.sequence(F.lit(0), F.size("w") - 5), lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(5)]))
    d = d.withColumn("h", F.when(F.size("w") > 5, windows)).drop("w")
    # most texts repeat no window: they are settled by one hash set
    d = d.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.array_sort(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("h")
    same = lambda x, j: (x["h"] == F.get("s", j - 1)["h"]) | (x["h"] == F.get("s", j + 1)["h"])
    places = F.array_sort(F.filter(F.transform("s", lambda x, j: F.when(same(x, j), x["i"])), lambda p: p.isNotNull()))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    covered = F.aggregate(places, start, lambda a, p: F.struct((a["n"] + p + 5 - F.greatest(p.cast("long"), a["end"])).alias("n"), (p + 5).cast("long").alias("end")), lambda a: a["n"])
    d = d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("s")
    return d.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def ratios() -> list[Column]:
    n = F.nullif("n_words", F.lit(0))
    return [F.col("n_symbols") / n, F.col("n_dup_lines") / F.nullif("n_lines", F.lit(0)), F.col("word_chars") / n]


def violates(level: int | Column) -> Column:
    """Whether a ratio exceeds its cutoff of a candidate. cutoffs: for each ratio, the candidates' cutoffs."""
    over = [F.coalesce(r > F.get(F.get("cutoffs", i), level - 1), F.lit(False)) for i, r in enumerate(ratios())]
    return over[0] | over[1] | over[2]


def log_binomial_tail(k: Column, n: Column, p: float) -> Column:
    """ln P(Binomial(n, p) <= k), by the recurrence of its terms in logarithms; 0 (no evidence) where k >= n p."""
    odds = math.log(p / (1 - p))
    first = n * math.log(1 - p)
    start = F.struct(first.cast("double").alias("t"), first.cast("double").alias("s"))

    def step(a, i):
        t = a["t"] + F.log((n - i + 1) / i) + odds
        high, low = F.greatest(a["s"], t), F.least(a["s"], t)
        return F.struct(t.cast("double").alias("t"), (high + F.log1p(F.exp(low - high))).cast("double").alias("s"))

    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1).cast("long")))).otherwise(F.array().cast("array<bigint>"))
    return F.when(k >= n * p, F.lit(0.0)).otherwise(F.aggregate(terms, start, step, lambda a: a["s"]))


def candidates(half: DataFrame) -> DataFrame:
    """stratum, cutoffs: per ratio the quantiles that leave a third of each of SHARES above them."""
    at = [1 - x / 3 for x in SHARES]
    return half.groupBy("stratum").agg(F.array(*[F.percentile_approx(r, at, 100_000) for r in ratios()]).alias("cutoffs"))


def calibrate(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """stratum, cutoffs, level: the strictest admissible candidate of each stratum that has one."""
    good = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null")
    good = good.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality > 0").select("doc_id")
    held = measured.where("not base_failed").join(good, "doc_id", "left_semi").withColumn("tests", F.crc32(F.col("doc_id").cast("string")) % 2 == 1)
    cut = candidates(held.where("not tests")).withColumnRenamed("stratum", "s")
    tested = held.where("tests").join(cut, F.col("stratum").eqNullSafe(F.col("s")))
    levels = range(1, len(SHARES) + 1)
    counts = tested.groupBy("stratum").agg(F.first("cutoffs").alias("cutoffs"), F.count("*").alias("n"), *[F.count_if(violates(i)).alias(f"k{i}") for i in levels])
    tests = max(1, counts.count()) * len(SHARES)
    limit = math.log(delta / tests)
    admissible = [F.when(log_binomial_tail(F.col(f"k{i}"), F.col("n"), risk) <= limit, i) for i in levels]
    return counts.select("stratum", "cutoffs", F.greatest(*admissible).alias("level")).where("level is not null")


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """metrics, the stratum's level (0: none) and cutoffs, and kept for every row of docs."""
    root = shared_dir(docs.sparkSession)
    measured = materialise(metrics(docs, id_col, text_col, stratum_col), "measured", root)
    # written, so that its size is known: Spark broadcasts it only below its threshold
    levels = materialise(calibrate(measured, labels, risk, delta).withColumnRenamed("stratum", "s"), "levels", root)
    d = measured.join(levels, F.col("stratum").eqNullSafe(F.col("s")), "left").withColumn("level", F.coalesce("level", F.lit(0)))
    rejected = F.when(F.col("level") > 0, violates(F.col("level"))).otherwise(False)
    return d.withColumn("kept", ~F.col("base_failed") & ~rejected).drop("s")


def op4_quality(spark, sf_dir: str) -> DataFrame:
    d = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "level")
