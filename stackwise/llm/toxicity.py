"""Operator 9: toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct words, word pairs and pairs with one word between, ASCII-lower-cased, with every
byte below 0x80 that is no letter or digit as separator, hashed into 2^18 places. Per-coordinate rates and L1 leave few
non-zero weights; the model is at most 1 MB whatever the corpus, and goes to the executors with the task.

The model is fitted on every labelled document outside the held-out fold, and one text of each, the first by hash, however
many rows it has. Documents are dealt by a hash of doc_id to parts of about PART to 2 PART; each part is fitted by itself, without
features of fewer than MIN_DOCS of its documents, and the model is the mean of the parts' weights by their documents
(parameter mixing). Fewer than 2 PART documents are one part. Weights are summed as whole numbers, so any order gives the same.
``sample`` fits on so many documents with the smallest hashes only; no query sets it.
Labels, lang, source and doc_id are no features.

Defined results: repeated labels of a document count as toxic if one says so, null labels are ignored; a null doc_id is
never held out or used for fitting; repeated rows of a labelled doc_id are fitted as one; null and empty texts have the
model's bias as score; a long text is scored whole; equal texts (ties) have equal scores; with fewer than one document of
each class there is no model and every score is 0. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import C1, LOWER, U, flat_bytes, join2, materialise, mix64, scratch, slices, word_hashes
from .minhash import likely

BITS = 18
PART = 12_000
SCALE = 1 << 24  # of weights summed as whole numbers
THRESHOLD = 0.3
MIN_DOCS = 4
ALPHA, BETA, L1, L2 = 2.0, 1.0, 5.0, 0.01

SOLID = np.zeros(256, dtype=bool)
SOLID[48:58] = SOLID[65:91] = SOLID[97:123] = True
SOLID[128:] = True


def feature_rows(texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of every text and n+1 offsets."""
    b, off = flat_bytes(texts)
    if not len(b):
        return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
    solid = SOLID[b]
    edge = np.zeros(len(b) + 1, dtype=bool)
    edge[off] = True
    before, after = np.concatenate([[False], solid[:-1]]), np.concatenate([solid[1:], [False]])
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    own = np.searchsorted(starts, off)
    w = word_hashes(b, starts, ends, lower=True)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(own))
    pairs = join2(w[:-1], w[1:]) ^ C1
    skips = join2(w[:-2], w[2:]) ^ U(0x2545F4914F6CDD1D)
    one, two = doc[:-1] == doc[1:], doc[:-2] == doc[2:]
    feats = np.concatenate([w, mix64(pairs[one]), mix64(skips[two])]) >> U(64 - BITS)
    keys = np.concatenate([doc, doc[:-1][one], doc[:-2][two]]).astype(np.uint64) << U(BITS) | feats
    keys = np.unique(keys)
    return (keys & U((1 << BITS) - 1)).astype(np.int32), np.searchsorted(keys >> U(BITS), np.arange(len(off)).astype(np.uint64))


def weights_of(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
    return np.where(np.abs(z) <= L1, 0.0, w)


MODEL = "documents long, toxic long, bias double, places array<int>, weights array<float>"


def fit(key, table):
    """FTRL-proximal over a part in a fixed order; the last coordinate is the bias, which L1 spares."""
    order = np.argsort(mix64(table["doc_id"].to_numpy().astype(np.uint64)), kind="stable")
    y = table["toxic"].to_numpy().astype(float)
    pieces = [feature_rows(b["text"]) for b in slices(table.to_batches(), "text")]
    flat = np.concatenate([f for f, _ in pieces])
    off = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(o) for _, o in pieces]))])
    often = (np.bincount(flat, minlength=1 << BITS) >= MIN_DOCS)[flat]
    off, flat = np.concatenate([[0], np.cumsum(often)])[off], flat[often]
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bz = bn = 0.0
    for _ in range(max(3, min(10, 36_000 // max(1, len(y))))):  # small parts are read more often
        for i in order.tolist():
            at = flat[off[i] : off[i + 1]]
            w = weights_of(z[at], n[at])
            bias = -bz / ((BETA + math.sqrt(bn)) / ALPHA + L2)
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, w.sum() + bias))))
            g = p - y[i]
            nn = n[at] + g * g
            z[at] += g - (np.sqrt(nn) - np.sqrt(n[at])) / ALPHA * w
            n[at] = nn
            bz += g - (math.sqrt(bn + g * g) - math.sqrt(bn)) / ALPHA * bias
            bn += g * g
    w = weights_of(z, n).astype(np.float32)
    at = np.flatnonzero(w).astype(np.int32)
    bias = -bz / ((BETA + math.sqrt(bn)) / ALPHA + L2)
    one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind))
    return pa.table({"documents": pa.array([len(y)], pa.int64()), "toxic": pa.array([int(y.sum())], pa.int64()), "bias": pa.array([bias], pa.float64()), "places": one(at, pa.int32()), "weights": one(w[at], pa.float32())})


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fitted_rows(docs: DataFrame, labels: DataFrame, sample: int | None = None) -> DataFrame:
    """doc_id, toxic, text: one row for each labelled id of docs, or for those with the ``sample`` smallest hashes."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    chosen = chosen.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    if sample is not None:
        chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # only texts with a label are moved, and copies are combined before
    texts = likely(docs.select(F.col("doc_id").alias("tid"), "text"), chosen.select(F.col("doc_id").alias("id")))
    texts = texts.groupBy(F.col("tid").alias("doc_id")).agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return texts.join(chosen, "doc_id").select("doc_id", "toxic", "text")


def train(docs: DataFrame, labels: DataFrame, sample: int | None = None) -> tuple[np.ndarray, float] | None:
    """Dense weights and bias, or None without both classes. docs: doc_id, text; labels: doc_id, toxic."""
    with scratch(docs.sparkSession) as root:
        rows = materialise(fitted_rows(docs, labels, sample), "fitted", root)
        part = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(max(1, rows.count() // PART)))
        parts = materialise(rows.groupBy(part.alias("part")).applyInArrow(fit, MODEL), "parts", root)
        whole = lambda w: F.sum(F.round(w * F.col("documents") * SCALE).cast("long"))
        total = parts.agg(F.sum("documents").alias("n"), F.sum("toxic").alias("toxic"), whole(F.col("bias")).alias("bias")).first()
        if not total["toxic"] or total["toxic"] == total["n"]:
            return None
        each = parts.select("documents", F.explode(F.arrays_zip("places", "weights")).alias("x"))
        each = each.groupBy(F.col("x.places").alias("place")).agg(whole(F.col("x.weights").cast("double")).alias("w")).toArrow()
    w = np.zeros(1 << BITS, np.float32)
    w[each["place"].to_numpy()] = each["w"].to_numpy() / (total["n"] * SCALE)
    return w, total["bias"] / (total["n"] * SCALE)


def scorer(model):
    """Replaces the text by its score; all other columns pass."""

    def step(batches):
        for batch in slices(batches, "text"):
            score = np.zeros(batch.num_rows)
            if model is not None:
                w, bias = model
                flat, off = feature_rows(batch["text"])
                total = np.concatenate([[0.0], np.cumsum(w[flat], dtype=np.float64)])
                score = 1 / (1 + np.exp(-np.clip(total[off[1:]] - total[off[:-1]] + bias, -35, 35)))
            names = batch.schema.names
            columns = [pa.array(score) if n == "text" else batch[n] for n in names]
            yield pa.RecordBatch.from_arrays(columns, ["score" if n == "text" else n for n in names])

    return step


def scored(docs: DataFrame, labels: DataFrame, sample: int | None = None, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """doc_id, score, and with ``keep`` the row itself as ``row``."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *([F.struct("*").alias("row")] if keep else []))
    model = train(d.select("doc_id", "text"), labels, sample)
    rows = d.select("doc_id", "text", *(["row"] if keep else []))
    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType()), *rows.schema.fields[2:]])
    return rows.mapInArrow(scorer(model), out)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    out = scored(docs, labels, sample, id_col, text_col)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with a score below the threshold; each row by its own text."""
    return scored(docs, labels, sample, id_col, text_col, keep=True).where(F.col("score") < threshold).select("row.*")


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
