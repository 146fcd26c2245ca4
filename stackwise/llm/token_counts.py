"""Operator 5: token counts with a digest cache.

Content is normalised only by null -> empty, which no tokenizer can tell apart, and digested with SHA-256. The digest
and a digest of the tokenizer's file are joined to a cache of counts; distinct misses are encoded, once each, and
appended to the cache. Copies combine before texts are moved, so a text that a third of all rows hold leaves each task
once and is encoded once, whatever its ids. ``compact_cache`` rewrites a cache that many runs have appended to.

Defined results: null and empty texts have 0 bytes and what the tokenizer gives for the empty text; null or repeated
doc_ids, and repeated rows, keep their rows; a long text is encoded whole, by itself; equal texts (ties) have equal
counts; extra columns are ignored, whatever their names; an empty table gives an empty result and appends nothing.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, shared_dir, slices

LIMIT = 4096
TOKENIZER = "piece_bpe_32k.model"
CACHE = "digest binary, tokenizer string, n_tokens long"
_LOADED: dict = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def counter(path: str):
    """Counts tokens of a list of texts with the library that belongs to the file."""
    if path not in _LOADED:
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            _LOADED[path] = lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
        else:
            import sentencepiece

            p = sentencepiece.SentencePieceProcessor(model_file=path)
            _LOADED[path] = lambda texts: [len(x) for x in p.encode(texts, num_threads=1)]
    return _LOADED[path]


def encoder(name: str, version: str):
    def step(batches):
        count = counter(tokenizer_path(name))
        for batch in slices(batches, "text", limit=1 << 18):
            n = count(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["digest"], pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())], ["digest", "tokenizer", "n_tokens"])

    return step


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache's rows; none where nothing was written yet."""
    try:
        return spark.read.schema(CACHE).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE)


def compact_cache(spark: SparkSession, path: str, to: str) -> None:
    """Writes the cache anew, each digest once, to another folder."""
    read_cache(spark, path).groupBy("digest", "tokenizer").agg(F.max("n_tokens").alias("n_tokens")).write.parquet(to)


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER, cache_path: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. cache_path: a Parquet folder that is read first and appended to; without
    one, a new cache in the shared folder."""
    spark = docs.sparkSession
    root = shared_dir(spark)
    path = cache_path or f"{root}/cache"
    version = tokenizer_digest(tokenizer_path(tokenizer))
    cached = read_cache(spark, path).where(F.col("tokenizer") == version)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    d = d.withColumn("digest", F.unhex(F.sha2("text", 256)))
    ids = materialise(d.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "digests", root)
    misses = d.groupBy("digest").agg(F.first("text").alias("text")).join(cached.select("digest"), "digest", "left_anti")
    new = materialise(misses.mapInArrow(encoder(tokenizer, version), CACHE), "new", root)
    known = cached.unionByName(new).select("digest", "n_tokens").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    # written, so that the join has plain exchanges on both sides and Spark can split a digest that many rows share
    known = materialise(known, "known", root)
    if not new.isEmpty():
        new.write.mode("append").parquet(path)
    return ids.join(known, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
