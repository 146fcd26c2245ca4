"""Operator 6: mixing sources to target weights by Sainte-Lague apportionment.

Sources get word targets by weight, capped at a multiple of their size, the excess going to the others by weight. The
mix is cut into equal blocks of words. Blocks are apportioned to sources, and each source's to its shards, by highest
quotients w / (2k + 1), which gives an integer quota for every shard. Within a shard, documents stand in seeded order
and form one stream of blocks; a quota takes every block as often as it divides, and the rest by seeded systematic
selection. How many words of a document are taken follows from its place in the stream, without listing blocks.

Shards hold about 1,000 documents, or more where that would make more than 65,536 of them and one for each source; their
sizes, and the sources', are what the driver gets. More than MAX_SOURCES sources are refused. Documents are dealt to
shards by a hash of id and text, so null or repeated ids don't gather in one. Rows without words are not placed at all, and
equal rows (same source, id and text) have one place for all of them: the stream runs through them one after another, and
which of them is the how-manieth is counted within the parts that they were written in, after the counts of the parts
before. A row that a third of the corpus repeats so is one row of its shard's window.

Defined results: null and empty texts have size 0 and nothing is taken; a null source is a source of its own, the last;
sources without words have target 0; documents with equal or null doc_id are separate; repeated rows share a shard, one
after another; a long text counts whole; ties in the order of a shard fall to id, then text hash, then size, after which
rows are alike; reruns give the same rows; columns not asked for are ignored, whatever their names; an empty table gives
an empty result. Of equal rows, which one gets which of their takes is open.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, shared_dir

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
SHARD_ROWS = 1000
MAX_SHARDS = 65_536
MAX_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[float], total: float, cap: float) -> list[float]:
    """Shares of total by weight; what exceeds cap times a size is shared again among the others, until none does."""
    out = [0.0] * len(sizes)
    free = [i for i, s in enumerate(sizes) if s > 0]
    left = min(total, cap * sum(sizes))
    while free:
        whole = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / whole > cap * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / whole
            break
        for i in over:
            out[i] = float(cap * sizes[i])
            left -= out[i]
        gone = set(over)
        free = [i for i in free if i not in gone]
    return out


def sainte_lague(weights: list[float], seats: int) -> list[int]:
    """Seats by highest quotients w / (2k + 1); ties go to the first. Starts from the quotas that the mean divisor
    gives, which such a sequence passes through, and hands out or takes back the difference in order of quotients."""
    total = sum(weights)
    if total <= 0 or seats <= 0:
        return [0] * len(weights)
    out = [int(w * seats / total + 0.5) for w in weights]
    diff = seats - sum(out)
    if diff > 0:
        heap = [(-w / (2 * a + 1), i) for i, (w, a) in enumerate(zip(weights, out, strict=True)) if w > 0]
        heapq.heapify(heap)
        for _ in range(diff):
            _, i = heap[0]
            out[i] += 1
            heapq.heapreplace(heap, (-weights[i] / (2 * out[i] + 1), i))
    elif diff < 0:
        heap = [(w / (2 * a - 1), -i) for i, (w, a) in enumerate(zip(weights, out, strict=True)) if a > 0]
        heapq.heapify(heap)
        for _ in range(-diff):
            _, i = heapq.heappop(heap)
            out[-i] -= 1
            if out[-i] > 0:
                heapq.heappush(heap, (weights[-i] / (2 * out[-i] - 1), i))
    return out


def _taken(x: Column) -> Column:
    """Words taken of the first x words of a shard's stream."""
    i = F.floor(x / F.col("block"))
    chosen = lambda k: F.floor((k * F.col("rest") + F.col("phase")) / F.col("blocks"))
    inside = x - i * F.col("block")
    return F.col("rounds") * x + F.col("block") * chosen(i) + (chosen(i + 1) - chosen(i)) * inside


def mix_sources(docs: DataFrame, share: float = SHARE, cap: int = CAP, weights: tuple = WEIGHTS, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = (), copy: bool = True) -> DataFrame:
    """doc_id, size, source_size, target, taken, and the columns of ``keep``, for every row of docs. ``keep`` is copied with
    what is written, so that nothing reads docs later; without ``copy``, for docs with an id of its own in every row, it is
    read from docs again."""
    spark = docs.sparkSession
    root = shared_dir(spark)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.col(text_col).cast("string")).alias("h"), F.struct(*[F.col(c) for c in keep if copy], F.lit(0).alias("_none")).alias("kept"))
    d = materialise(d.withColumns({"rid": F.monotonically_increasing_id() if copy else F.col("doc_id"), "piece": F.spark_partition_id()}), "sizes", root)
    found = d.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes, rows = [r["size"] for r in found], sum(r["rows"] for r in found)
    total = sum(sizes)
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], share * total, cap)
    per_shard = max(SHARD_ROWS, 2 * rows // MAX_SHARDS)
    counts = [max(1, -(-r["rows"] // per_shard)) for r in found]
    least = min((g for g in goal if g > 0), default=32.0)
    block = max(1, min(64, int(least // 32)))
    table = spark.createDataFrame([(r["source"], r["source"] is None, i, float(g), int(n), int(s)) for i, (r, g, n, s) in enumerate(zip(found, goal, counts, sizes, strict=True))], "source string, none boolean, number int, target double, shards int, source_size long")
    d = d.join(F.broadcast(table.withColumnRenamed("source", "name")), F.col("source").eqNullSafe(F.col("name")))
    d = d.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "h"), F.col("shards")).cast("int"))
    shards = d.groupBy("number", "shard").agg(F.sum("size").alias("size")).collect()
    shards = sorted((r["number"], r["shard"], r["size"]) for r in shards if r["size"] > 0)
    seats = sainte_lague(goal, round(sum(goal) / block))
    plan: list[list] = [[] for _ in found]
    for s in shards:
        plan[s[0]].append(s)
    quotas = []
    for i, own in enumerate(plan):
        for (number, shard, size), q in zip(own, sainte_lague([float(s[2]) for s in own], seats[i]), strict=True):
            blocks = -(-size // block)
            q = min(q, cap * blocks)
            quotas.append((number, shard, block, blocks, q // blocks, q % blocks, (seed * 7919 + number * 104_729 + shard * 1_299_709) % blocks))
    q = spark.createDataFrame(quotas, "number int, shard int, block long, blocks long, rounds long, rest long, phase long")
    slim = d.where("size > 0").select("rid", "piece", "number", "shard", F.struct("doc_id", "h", "size").alias("k"))
    same = slim.groupBy("number", "shard", "k").agg(F.count("*").alias("copies"), F.min("rid").alias("rid"))
    w = Window.partitionBy("number", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "k.doc_id", "k.h"), "k").rowsBetween(Window.unboundedPreceding, -1)
    placed = same.withColumn("start", F.coalesce(F.sum(F.col("k.size") * F.col("copies")).over(w), F.lit(0)))
    placed = materialise(placed.join(F.broadcast(q), ["number", "shard"]), "placed", root)
    at = F.col("start") + F.coalesce("nth", F.lit(0)) * F.col("k.size")
    taken = F.coalesce(_taken(at + F.col("k.size")) - _taken(at), F.lit(0)).cast("long").alias("taken")
    once = placed.where("copies = 1").withColumn("nth", F.lit(0)).select("rid", taken)
    several = slim.join(placed.where("copies > 1").drop("rid"), ["number", "shard", "k"])
    several = materialise(several, "several", root)
    before = Window.partitionBy("number", "shard", "k").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = several.groupBy("number", "shard", "k", "piece").agg(F.count("*").alias("n")).select("number", "shard", "k", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("number", "shard", "k", "piece").orderBy("rid")
    several = several.withColumn("nth", F.row_number().over(inside) - 1).join(pieces, ["number", "shard", "k", "piece"]).withColumn("nth", F.col("before") + F.col("nth"))
    takes = once.unionByName(several.select("rid", taken))
    d = d.join(takes, "rid", "left")
    if not copy:
        d = d.drop("kept").join(docs.select(F.col(id_col).cast("long").alias("rid"), F.struct(*[F.col(c) for c in keep], F.lit(0).alias("_none")).alias("kept")), "rid")
    return d.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), *[F.col("kept")[c].alias(c) for c in keep])


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
