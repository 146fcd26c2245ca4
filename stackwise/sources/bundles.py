"""Bundles: several tables published together, as one version of a library, with what the version before knew.

A version's tables are written to a folder of their own; a manifest makes them the current version. The manifest before
stays as the backup; whatever is older goes after the commit, manifests first.

    root/manifests/000000000007.json      number, tables (folder, schema, rows), previous number, counts
    root/versions/<id>/<table>/*.parquet
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.resolve import staged_match
from .manifests import Manifests

# fixed values: how much a match is worth; every other status, unmatched too, is worth nothing
STATUS_RANK = {"exact": 3, "candidate": 2, "needs_review": 1}


@dataclass(frozen=True)
class Bundle:
    number: int
    previous: int | None
    tables: dict[str, dict]
    counts: dict[str, int]


@dataclass(frozen=True)
class Matched:
    """Which rows of ``table`` stand for the same thing in two versions (keys per stage, as staged_match), and the columns
    that a row then has from the older one: ``carried``, and ``kind`` where the older one's status is exact."""

    table: str
    key: str
    stages: list[list[str]]
    carried: list[str]
    status: str = "match_status"
    kind: str | None = None


@dataclass(frozen=True)
class Plan:
    """How a version follows the one before. kept: tables whose older rows stay where the new version has none with their
    key, by name."""

    matched: Matched | None = None
    kept: dict[str, list[str]] = field(default_factory=dict)
    check: Callable[[dict[str, DataFrame]], bool] | None = None


class Library:
    """The bundles below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.manifests = Manifests(spark, root)

    def current(self) -> Bundle | None:
        _, content = self.manifests.latest()
        return Bundle(**content) if content else None

    def backup(self) -> Bundle | None:
        now = self.current()
        return Bundle(**self.manifests.load(now.previous)) if now and now.previous in self.manifests.numbers() else None

    def read(self, name: str, bundle: Bundle | None = None) -> DataFrame:
        """A table of a bundle, the current one by default; its files do not change while they are read."""
        bundle = bundle or self.current()
        if bundle is None:
            raise ValueError("nothing is published")
        t = bundle.tables[name]
        return self.spark.read.schema(T.StructType.fromJson(t["schema"])).parquet(f"{self.root}/{t['folder']}")

    def _write_table(self, df: DataFrame, version: str, name: str) -> dict:
        seen = Observation()
        folder = f"versions/{version}/{name}"
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(f"{self.root}/{folder}")
        return {"folder": folder, "schema": df.schema.jsonValue(), "rows": seen.get["rows"]}

    def _commit(self, bundle: Bundle) -> None:
        self.manifests.put(bundle.number, bundle.__dict__)

    def _drop_older(self, keep: list[int]) -> None:
        """Manifests that are not kept, then the folders that no manifest names any more."""
        load = lambda n: Bundle(**self.manifests.load(n))
        gone = [load(n) for n in self.manifests.numbers() if n not in keep and n < max(keep)]
        folders = lambda bundles: {"/".join(t["folder"].split("/")[:2]) for b in bundles for t in b.tables.values()}
        for b in gone:
            self.manifests.forget(b.number)
        for folder in folders(gone) - folders(map(load, keep)):
            self.manifests.delete(folder)

    def install(self, tables: dict[str, DataFrame], plan: Plan | None = None) -> Bundle:
        """Publishes tables as the next version. What the current version knows of its matched rows is carried into them,
        and then, where it is worth more, what the backup knows. Nothing is replaced if ``check`` says no or a step fails."""
        plan, old, backup = plan or Plan(), self.current(), self.backup()
        version, written, counts = uuid.uuid4().hex, {}, {}
        try:
            for name, df in tables.items():
                if plan.matched and name == plan.matched.table:
                    df = df.withColumn("inherited", F.lit(None).cast("string"))
                    for source, bundle in (("current", old), ("backup", backup)):
                        if bundle and name in bundle.tables:
                            df = inherit(df, self.read(name, bundle), plan.matched, source)
                if old and name in plan.kept and name in old.tables:
                    df = df.unionByName(self.read(name, old).join(df.select(*plan.kept[name]), plan.kept[name], "left_anti"), allowMissingColumns=True)
                written[name] = self._write_table(df, version, name)
            new = Bundle((old.number if old else 0) + 1, old.number if old else None, written, counts)
            staged = {name: self.read(name, new) for name in tables}
            if plan.check and not plan.check(staged):
                raise ValueError("the new version is not valid; nothing was replaced")
            if plan.matched and plan.matched.table in staged:
                worth = staged[plan.matched.table].where(rank_of(F.col(plan.matched.status)) > 0).groupBy("inherited").agg(F.count("*").alias("n"))
                counts.update({f"inherited_from_{r['inherited']}": r["n"] for r in worth.where("inherited is not null").collect()})
            self._commit(new)
        except Exception:
            self.manifests.delete(f"versions/{version}")
            raise
        self._drop_older([n for n in (new.number, new.previous) if n is not None])
        return new

    def rollback(self) -> Bundle:
        """Publishes the backup's tables again; the version that they replace is given up, and there is no backup left."""
        now, backup = self.current(), self.backup()
        if backup is None:
            raise ValueError("there is no backup")
        again = Bundle(now.number + 1, None, backup.tables, backup.counts)
        self._commit(again)
        self._drop_older([again.number])
        return again


def rank_of(status: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in STATUS_RANK.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.coalesce(status, F.lit(""))), F.lit(0))


def inherit(new: DataFrame, old: DataFrame, m: Matched, source: str) -> DataFrame:
    """new with what its matched rows have in ``old``; source "backup" takes only what is worth more than what is there.
    A row that has no partner, or more than one, stays as it is. ``inherited`` tells the source; null or repeated keys of
    a stage match nothing in it."""
    keys = sorted({k for s in m.stages for k in s})
    pairs = staged_match(new.select(F.col(m.key).alias("new_id"), *keys), old.select(F.col(m.key).alias("old_id"), *keys), m.stages)
    theirs = [*dict.fromkeys([*m.carried, m.status, *([m.kind] if m.kind else [])])]
    found = pairs.join(old.select(F.col(m.key).alias("old_id"), F.struct(*theirs).alias("_old")), "old_id").select(F.col("new_id").alias(m.key), "_old")
    both = new.join(found, m.key, "left")
    take = F.col("_old").isNotNull()
    if source == "backup":
        take = take & (rank_of(F.col("_old")[m.status]) > rank_of(F.col(m.status)))
    taken = {c: F.when(take, F.col("_old")[c]).otherwise(F.col(c)) for c in dict.fromkeys([*m.carried, m.status])}
    if m.kind:
        taken[m.kind] = F.when(take & (F.col("_old")[m.status] == "exact"), F.col("_old")[m.kind]).otherwise(F.col(m.kind))
    taken["inherited"] = F.when(take, source).otherwise(F.col("inherited"))
    return both.select(*[taken[c].alias(c) if c in taken else F.col(c) for c in new.columns])
