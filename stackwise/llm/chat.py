"""Operator 10: chat formatting with multi-party perspective rotation.

For every participant of a conversation (every role but "system"), the dialogue is rendered with that speaker as the
assistant and all others as named users. Masks are the character spans of the assistant's own words with their end
mark, on which a model would be trained.

A dialogue's rendering is uncut: its rows, in order of segment and part, are pieces that follow each other without gap or
repeat, each with ``begin_char``, the characters before it, so their texts joined are the whole rendering and begin_char + start
a mask's place in it. A dialogue of up to ``segment`` turn numbers is one row; a longer one is several, so that a
conversation with a third of all turns is many rows and never one task's. With ``heads``, for use of a row by itself, later
rows begin with the system turns of all rows before them instead (and begin_char is null); these are few in a dialogue, and
ride along with each of its rows.

Turns are numbered within ranges of their order, after the counts of the ranges before; no task sorts a segment, be all
its turns without a number. Segments have at most ``part`` turns a row.

Defined results: exact repeats of a turn (same conversation, turn, role and text), so repeated rows too, are one turn;
turns with the same number (ties) stand in order of role, then text; turns without a number are segments of their own
(null), as the first; a null conversation is a conversation; a null role is "unknown"; null and empty texts are empty
turns; a long text is rendered whole; control marks inside names and texts are broken up with a space; a conversation
without participants (only system turns) gives no rows; extra columns are ignored, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, shared_dir

SEGMENT = 512
PART = 4096
END = "<|end|>"


def _safe(c):
    return F.replace(F.replace(c, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))


def _numbered(t: DataFrame, root: str) -> DataFrame:
    """t with nth, a turn's position in its conversation's segment, from 0."""
    ranged = t.repartitionByRange("conv_id", "segment", "turn", "role", "text").withColumn("_range", F.spark_partition_id())
    ranged = materialise(ranged, "ranged", root)
    before = Window.partitionBy("conv_id", "segment").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("conv_id", "segment", "_range").agg(F.count("*").alias("n"))
    counts = counts.select(F.col("conv_id").alias("c"), F.col("segment").alias("s"), F.col("_range").alias("r"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("conv_id", "segment", "_range").orderBy("turn", "role", "text")
    rows = ranged.withColumn("_in", F.row_number().over(inside) - 1)
    same = F.col("conv_id").eqNullSafe(F.col("c")) & F.col("segment").eqNullSafe(F.col("s")) & (F.col("_range") == F.col("r"))
    return rows.join(counts, same).withColumn("nth", F.col("before") + F.col("_in")).drop("c", "s", "r", "before", "_in", "_range")


def chat_format(turns: DataFrame, segment: int = SEGMENT, part: int = PART, heads: bool = False) -> DataFrame:
    """conv_id, perspective, segment, part, begin_char, n_turns, text, masks array<struct<start, end>>."""
    root = shared_dir(turns.sparkSession)
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _safe(F.coalesce(F.col("role").cast("string"), F.lit("unknown"))).alias("role"), _safe(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text")).distinct()
    t = _numbered(t.withColumn("segment", F.floor(F.col("turn") / segment)), root).withColumn("part", F.floor(F.col("nth") / part).cast("int"))
    groups = t.groupBy("conv_id", "segment", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("msgs"))
    if heads:
        system = groups.select("conv_id", "segment", "part", F.filter("msgs", lambda m: m["role"] == "system").alias("sys"))
        system = system.where(F.size("sys") > 0).select(F.col("conv_id").alias("c"), F.struct(F.col("segment").isNotNull().alias("numbered"), "segment", "part").alias("at"), "sys")
        order = F.struct(F.col("segment").isNotNull().alias("numbered"), "segment", "part")
        lead = groups.join(system, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("at") < order))
        lead = lead.groupBy("conv_id", "segment", "part").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "sys"))), lambda x: x["sys"])).alias("lead"))
        lead = lead.select(F.col("conv_id").alias("c"), F.col("segment").alias("s"), F.col("part").alias("p"), "lead")
        groups = groups.join(lead, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("segment").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")), "left")
        groups = groups.select("conv_id", "segment", "part", F.concat(F.coalesce("lead", F.array().cast("array<struct<turn:bigint,role:string,text:string>>")), "msgs").alias("msgs"))
    parts = t.where("role <> 'system'").select(F.col("conv_id").alias("c"), F.col("role").alias("perspective")).distinct()
    rows = groups.join(parts, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    head = lambda m: F.concat(F.when(m["role"] == "system", F.lit("<|system|>")).when(m["role"] == F.col("perspective"), F.lit("<|assistant|>")).otherwise(F.concat(F.lit("<|user name="), m["role"], F.lit("|>"))), F.lit("\n"))
    rows = rows.withColumn("pieces", F.transform("msgs", lambda m: F.struct(head(m).alias("head"), m["text"].alias("text"), (m["role"] == F.col("perspective")).alias("own"))))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc, p):
        begin = acc["at"] + F.length(p["head"])
        end = begin + F.length(p["text"]) + len(END)
        return F.struct((end + 1).cast("long").alias("at"), F.when(p["own"], F.concat(acc["spans"], F.array(F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end"))))).otherwise(acc["spans"]).alias("spans"))

    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["text"], F.lit(END + "\n"))), "")
    rows = rows.select("conv_id", "perspective", "segment", "part", F.size("msgs").cast("long").alias("n_turns"), text.alias("text"), F.aggregate("pieces", start, step, lambda acc: acc["spans"]).alias("masks"))
    if heads:
        return rows.select("conv_id", "perspective", "segment", "part", F.lit(None).cast("long").alias("begin_char"), "n_turns", "text", "masks")
    # offsets from lengths alone; texts stay where they are
    rows = materialise(rows.withColumn("_row", F.monotonically_increasing_id()), "rows", root)
    before = Window.partitionBy("conv_id", "perspective").orderBy("segment", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.select("_row", F.coalesce(F.sum(F.length("text").cast("long")).over(before), F.lit(0)).alias("begin_char"))
    return rows.join(offsets, "_row").select("conv_id", "perspective", "segment", "part", "begin_char", "n_turns", "text", "masks")


def op10_chat(spark, sf_dir: str) -> DataFrame:
    rows = chat_format(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    masks = F.array_join(F.transform("masks", lambda m: F.concat(m["start"].cast("string"), F.lit("-"), m["end"].cast("string"))), ",")
    return rows.select("conv_id", "perspective", "segment", "part", "begin_char", "n_turns", "text", masks.alias("masks"))


SQL = r"""
WITH s AS (
  SELECT DISTINCT conv_id, turn,
         replace(replace(coalesce(role, 'unknown'), '<|', '< |'), '|>', '| >') AS role,
         replace(replace(coalesce(text, ''), '<|', '< |'), '|>', '| >') AS text
  FROM conversations),
g AS (SELECT *, CAST(floor(turn / 512.0) AS BIGINT) AS segment FROM s),
t AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY conv_id, segment ORDER BY turn NULLS FIRST, role, text) - 1) / 4096.0) AS INT) AS part FROM g),
p AS (SELECT DISTINCT conv_id AS c, role AS perspective FROM t WHERE role <> 'system'),
x AS (
  SELECT t.*, perspective, CASE WHEN role = 'system' THEN '<|system|>' WHEN role = perspective THEN '<|assistant|>'
              ELSE '<|user name=' || role || '|>' END || chr(10) AS head
  FROM t JOIN p ON conv_id IS NOT DISTINCT FROM c),
y AS (
  SELECT *, CAST(coalesce(sum(length(head) + length(text) + 8) OVER (
      PARTITION BY conv_id, perspective, segment, part ORDER BY turn NULLS FIRST, role, text
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos
  FROM x),
z AS (SELECT conv_id, perspective, segment, part, count(*) AS n_turns,
       string_agg(head || text || '<|end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS text,
       coalesce(string_agg(CASE WHEN role = perspective THEN (pos + length(head))::VARCHAR || '-' ||
         (pos + length(head) + length(text) + 7)::VARCHAR END, ',' ORDER BY turn NULLS FIRST, role, text), '') AS masks
  FROM y GROUP BY conv_id, perspective, segment, part)
SELECT *, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id, perspective ORDER BY segment NULLS FIRST, part
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begin_char FROM z
"""
