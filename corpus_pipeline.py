"""Corpus cleaning in stages, each an operator of stackwise.llm; every stage works on all rows the one before kept.

Documents need doc_id, text, lang, source and n_chars; n_chars follows the text where a stage changes it. Every row is
judged by its own text: where an operator answers by id and ids are null or repeated, rows are numbered and written first, so
these neither escape a verdict nor share one, and of repeated rows one stays; where each row has an id of its own, that is its
number and no row is copied. Rows with null or empty text are no toxic row, no copy
and no leak, and stay; a table without rows passes every stage. The mix returns all rows with their text and the words
that it takes of each. Sketches, buckets and links of the near-duplicates go when its verdicts are written; numbered rows
and hashed words stay. Of the tables between stages, run() keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackwise.llm.common import discard, materialise, own_ids, scratch, shared_dir
from stackwise.llm.decontaminate import decontaminate
from stackwise.llm.minhash import near_duplicates
from stackwise.llm.mixing import mix_sources
from stackwise.llm.pii import pseudonymise, session_key
from stackwise.llm.toxicity import without_toxic


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with a number for each row: its doc_id where every row has one of its own, else one that is written with all
    rows, so that all that reads it sees the same numbers."""
    own = own_ids(docs)
    numbered = materialise((docs.limit(0) if own else docs).withColumn("_row", F.monotonically_increasing_id()), name)
    return docs.withColumn("_row", F.col("doc_id").cast("long")) if own else numbered


def _without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    return docs.join(bad.select(F.col("doc_id").alias("_row")), "_row", "left_anti").drop("_row")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _numbered(docs, "rows")
    with scratch(spark) as root:
        copies = materialise(near_duplicates(rows, percent=80, id_col="_row", below=root).where("not kept").select("doc_id"), "copies")
    return _without(rows, copies)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _numbered(docs, "rows")
    leaks = materialise(decontaminate(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="_row").where("contaminated").select("doc_id"), "leaks")
    return _without(rows, leaks)


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pseudonymise(docs, session_key(spark)).drop("pii")
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(docs, keep=KEPT, copy=not own_ids(docs))


KEPT = ("text", "lang", "source")
STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", replace_pii),
    ("mixing", mix),
]

#: no stage but the last two can be written in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES[:-1]:
        root = shared_dir(spark)
        docs = materialise(stage(spark, docs, sf_dir), name, root)
        if last:
            discard(spark, last)
        last = root
    mixed = mix_sources(docs, keep=KEPT)  # it has written the rows that it returns
    discard(spark, last)
    return mixed
