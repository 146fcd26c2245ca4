"""Connected components of a distributed edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, shared_dir


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    low = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return low.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, below: str | None = None) -> DataFrame:
    """(id, comp) for every end of an edge (a, b); comp is the smallest id of its component.

    Rounds are logarithmic in the longest path; each is written to the shared folder, which ends its lineage. Hubs are
    joined to their minimum only, so Spark can split a hot hub's rows.
    """
    root = shared_dir(edges.sparkSession, below)
    e = materialise(edges.select("a", "b").where("a <> b").distinct(), "edges0", root)
    state = None
    for i in range(1, 64):
        e = materialise(_small_star(_large_star(e)), f"edges{i}", root)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("id"), F.col("b").alias("comp")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("comp")).distinct())
