"""Entity resolution: verdicts over scored candidates, staged one-to-one matching, and merging of identities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import first_per_key, only_singles

EXACT, CANDIDATE, MARGIN = 0.90, 0.75, 0.15


def staged_match(new: DataFrame, old: DataFrame, stages: list[list[str]]) -> DataFrame:
    """(new_id, old_id, stage): a stage joins by its keys where both sides have the key once; the next stage sees only
    what is left on both sides."""
    found: list[DataFrame] = []
    for number, keys in enumerate(stages, 1):
        pairs = only_singles(new, keys).select(*keys, "new_id").join(only_singles(old, keys).select(*keys, "old_id"), keys)
        pairs = pairs.select("new_id", "old_id", F.lit(number).alias("stage"))
        found.append(pairs)
        new = new.join(pairs.select("new_id"), "new_id", "left_anti")
        old = old.join(pairs.select("old_id"), "old_id", "left_anti")
    return reduce(DataFrame.unionByName, found)


def year_score(mine: Column, theirs: Column) -> Column:
    gap = F.abs(mine - theirs)
    return F.when(mine.isNull() | theirs.isNull(), 0.0).when(gap == 0, 0.15).when(gap == 1, 0.05).otherwise(-0.30)


def score_candidate(similarity: Column, year: Column, kind: Column, candidate_kind: Column) -> Column:
    """Clamped to 0..1; a series against a film loses half; a person never scores."""
    clash = F.when(kind.isNotNull() & (kind != candidate_kind), -0.5).otherwise(0.0)
    return F.when(candidate_kind != "person", F.greatest(F.lit(0.0), F.least(F.lit(1.0), similarity + year + clash)))


def judge(scored: DataFrame, key: str, candidate: str) -> DataFrame:
    """key, verdict, candidate, score, margin, top: exact needs EXACT and MARGIN ahead of the runner-up."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), candidate)
    rows = scored.withColumn("rn", F.row_number().over(w)).withColumn("second", F.lead("score").over(w)).where("rn <= 5")
    best = rows.groupBy(key).agg(
        F.max(F.when(F.col("rn") == 1, F.col(candidate))).alias(candidate), F.max(F.when(F.col("rn") == 1, F.col("score"))).alias("score"),
        F.max(F.when(F.col("rn") == 1, F.col("second"))).alias("second"), F.array_sort(F.collect_list(F.struct("rn", candidate))).alias("t"),
    )
    margin = F.col("score") - F.coalesce("second", F.lit(0.0))
    verdict = F.when(F.col("score").isNull(), "unmatched").when((F.col("score") >= EXACT) & (F.round(margin, 9) >= MARGIN), "exact").when(F.col("score") >= CANDIDATE, "candidate").otherwise("needs_review")
    return best.select(key, verdict.alias("verdict"), candidate, "score", F.round(margin, 6).alias("margin"), F.array_join(F.transform("t", lambda x: x[candidate].cast("string")), ",").alias("top"))


def verdict_ladder(lanes: list[DataFrame], key: str) -> DataFrame:
    """The first lane that has a verdict for a key decides; lanes are in order of trust."""
    rows = reduce(DataFrame.unionByName, [x.withColumn("lane", F.lit(i)) for i, x in enumerate(lanes)])
    return first_per_key(rows, [key], ["lane"])


def merge_identities(rows: DataFrame, identity: list[str], rank: str, ident: str, scalars: list[str], aliases: str) -> DataFrame:
    """One row per identity: the keeper has the highest rank, then the lowest id; scalars are the keeper's, or else the
    first non-null of the others in id order; aliases are the ordered union, the keeper's first."""
    w = Window.partitionBy(*identity).orderBy(F.desc(rank), ident)
    ranked = rows.withColumn("_k", F.when(F.row_number().over(w) == 1, 0).otherwise(1)).withColumn("_o", F.struct("_k", F.col(ident).alias("i")))
    picks = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_o"))).alias(c) for c in scalars]
    listed = F.array_sort(F.collect_list(F.when(F.col(aliases).isNotNull(), F.struct("_o", F.col(aliases).alias("a")))))
    return ranked.groupBy(*identity).agg(F.min_by(ident, "_o").alias("keeper"), F.count("*").alias("members"), F.max(rank).alias("best_rank"), *picks, F.array_distinct(F.transform(listed, lambda x: x["a"])).alias("aliases"))


def fold_groups(groups: DataFrame, keepers: DataFrame, fingerprint: str) -> DataFrame:
    """Groups repointed to their item's keeper; equal fingerprints of one keeper become the lowest group id."""
    moved = groups.join(keepers, "item_id").select(F.col("keeper").alias("item_id"), "edition_id", fingerprint)
    return moved.withColumn("target", F.min("edition_id").over(Window.partitionBy("item_id", fingerprint)))
