"""Operator 13: language identification by a convolutional network over bytes.

A text's UTF-8 bytes are cut into windows of WINDOW bytes that overlap by the widest filter less one, the last one filled
up. Bytes are embedded, filters of several widths slide over them, each filter's highest value in the window goes through
a rectifier, and a softmax gives the window's language. A text's scores are the means of its windows' logits, weighed by
their bytes, so every byte of every text counts. Training is Adam on windows cut from labelled texts, in numpy, a third of
them shortened, so that short texts are known too.

The network is fitted on at most ``sample`` labelled texts outside the held-out fold, PIECES windows of each: of every
language an equal number, the first by a hash of the id, one row for equal rows; what is gathered does not grow with the
corpus. Weights are some 20 KB and go to the tasks. Neither lang, source nor doc_id is an input.

Defined results: null, empty and letterless texts are ``und`` with score 0, and so is every text if no row has a language;
a null doc_id is never held out and never learned from; rows with null lang are not learned from; repeated rows each get
their answer; equal texts (ties) have equal answers (scores have six places), equal logits go to the first language in code-point order; a long
text is read whole, a window at a time; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import flat_bytes, slices

WINDOW, PIECES = 192, 3
WIDTHS, FILTERS, EMBEDDED = (2, 3, 4), 16, 8
WIDEST = max(WIDTHS)
STRIDE = WINDOW - WIDEST + 1
PAD = 256
SAMPLE = 6_000
STEPS, BATCH, RATE = 1_500, 64, 0.01
AT_ONCE = 256  # windows convolved together, some 9 MB
UNKNOWN = "und"


def windows(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row of WINDOW bytes from each start, PAD from its end on."""
    at = starts[:, None] + np.arange(WINDOW)
    return np.where(at < ends[:, None], b[np.minimum(at, max(len(b) - 1, 0))].astype(np.int16) if len(b) else PAD, PAD)


def _mask() -> np.ndarray:
    """Which places of the widest filter each filter has."""
    return np.repeat(np.array([[j < w for w in WIDTHS] for j in range(WIDEST)], np.float32), FILTERS, axis=1)


class Network:
    """emb (257 x E), kernel (widest * E x filters), bias, out (filters x languages), out_bias; all float32."""

    NAMES = ("emb", "kernel", "bias", "out", "out_bias")

    def __init__(self, languages: list[str], seed: int = 13):
        rng = np.random.default_rng(seed)
        n = len(WIDTHS) * FILTERS
        self.languages = languages
        self.mask = np.repeat(_mask(), EMBEDDED, axis=0)
        self.emb = rng.normal(0, 0.5, (PAD + 1, EMBEDDED)).astype(np.float32)
        self.kernel = (rng.normal(0, 0.3, (WIDEST * EMBEDDED, n)) * self.mask).astype(np.float32)
        self.bias = np.zeros(n, np.float32)
        self.out = rng.normal(0, 0.1, (n, len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)

    def convolved(self, x: np.ndarray) -> np.ndarray:
        """windows x places x filters, before bias and rectifier, which keep the order of values."""
        e = self.emb[x]
        around = np.concatenate([e[:, j : j + STRIDE] for j in range(WIDEST)], axis=2)
        return (around.reshape(-1, WIDEST * EMBEDDED) @ self.kernel).reshape(len(x), STRIDE, -1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(self.convolved(x).max(axis=1) + self.bias, 0) @ self.out + self.out_bias

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        c = self.convolved(x)
        place = c.argmax(axis=1)
        top = np.take_along_axis(c, place[:, None], axis=1)[:, 0] + self.bias
        pooled = np.maximum(top, 0)
        z = pooled @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        loss = float(-np.log(p[np.arange(len(y)), y] + 1e-12).mean())
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        g = (p @ self.out.T) * (top > 0)  # only the place with the highest value learns
        seen = x[np.arange(len(x))[:, None, None], place[:, :, None] + np.arange(WIDEST)]
        e = self.emb[seen].reshape(len(x), -1, WIDEST * EMBEDDED)
        emb = np.zeros_like(self.emb)
        back = (g[:, :, None] * self.kernel.T).reshape(-1, EMBEDDED)
        for k in range(EMBEDDED):
            emb[:, k] = np.bincount(seen.ravel(), weights=back[:, k], minlength=PAD + 1)
        return loss, {"emb": emb, "kernel": np.einsum("nf,nfk->kf", g, e) * self.mask, "bias": g.sum(axis=0), "out": pooled.T @ p, "out_bias": p.sum(axis=0)}

    def weights(self) -> bytes:
        return b"".join(getattr(self, n).tobytes() for n in self.NAMES)

    @classmethod
    def of(cls, languages: list[str], weights: bytes) -> Network:
        net, at = cls(languages), 0
        flat = np.frombuffer(weights, np.float32)
        for n in cls.NAMES:
            shape = getattr(net, n).shape
            size = int(np.prod(shape))
            setattr(net, n, flat[at : at + size].reshape(shape))
            at += size
        return net


def train(x: np.ndarray, y: np.ndarray, languages: list[str], steps: int = STEPS, seed: int = 13) -> Network:
    """Adam with a falling rate; batches hold all languages alike."""
    net, rng = Network(languages, seed), np.random.default_rng(seed)
    first = {n: np.zeros_like(getattr(net, n)) for n in Network.NAMES}
    second = {n: np.zeros_like(getattr(net, n)) for n in Network.NAMES}
    rows_of = [np.flatnonzero(y == k) for k in range(len(languages))]
    for t in range(1, steps + 1):
        of = rng.integers(0, len(languages), BATCH)
        at = np.array([rows_of[k][rng.integers(0, len(rows_of[k]))] for k in of])
        batch = x[at].copy()
        cut = rng.integers(8, WINDOW, BATCH)
        short = rng.random(BATCH) < 1 / 3
        batch[short[:, None] & (np.arange(WINDOW) >= cut[:, None])] = PAD
        _, g = net.gradients(batch, y[at])
        rate = RATE * (1 - t / (steps + 1))
        for n in Network.NAMES:
            first[n] = 0.9 * first[n] + 0.1 * g[n]
            second[n] = 0.999 * second[n] + 0.001 * g[n] ** 2
            step = rate * (first[n] / (1 - 0.9**t)) / (np.sqrt(second[n] / (1 - 0.999**t)) + 1e-8)
            setattr(net, n, (getattr(net, n) - step).astype(np.float32))
    return net


def fit(table: pa.Table) -> pa.Table:
    rows = sorted(zip(table["lang"].to_pylist(), table["doc_id"].to_pylist(), table["pieces"].to_pylist(), strict=True))
    languages = sorted({r[0] for r in rows})
    pieces = [(languages.index(lang), p.encode()[:WINDOW]) for lang, _, ps in rows for p in ps if p]
    b, off = flat_bytes(pa.array([p for _, p in pieces], pa.binary()))
    net = train(windows(b, off[:-1], off[1:]), np.array([k for k, _ in pieces]), languages)
    return pa.table({"languages": pa.array([languages], pa.list_(pa.string())), "weights": pa.array([net.weights()], pa.binary())})


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def sample_of(docs: DataFrame, sample: int) -> DataFrame:
    """At most ``sample`` rows of doc_id, lang, pieces; docs: doc_id, text, lang. Rows are thinned by hash to about twice
    what is wanted of a language before any of them is moved; the counts need two short columns."""
    rows = docs.where("doc_id is not null and lang is not null").where(~held_out())
    # of more languages than the sample has rows, the most frequent ones; so few that they can be broadcast
    counts = rows.groupBy("lang").agg(F.count("*").alias("of")).orderBy(F.desc("of"), "lang").limit(sample)
    turns = counts.agg(F.greatest(F.lit(1), F.ceil(F.lit(sample) / F.count("*"))).cast("int").alias("turns"))
    kept = counts.crossJoin(F.broadcast(turns)).select(F.col("lang").alias("name"), "turns", ((2 * F.col("turns") + 200) / F.col("of")).alias("share"))
    place = F.xxhash64(F.lit(13), "doc_id")
    rows = rows.join(F.broadcast(kept), F.col("lang") == F.col("name")).where(F.pmod(place, F.lit(1 << 20)) < F.col("share") * (1 << 20))
    rows = rows.where(F.col("text").rlike(r"\p{L}"))
    length = F.char_length("text")
    start = [F.lit(1), *(F.greatest(F.lit(1), F.floor((length - WINDOW) * (k / (PIECES - 1))).cast("int") + 1) for k in range(1, PIECES))]
    pieces = F.array_distinct(F.array(*[F.substring("text", s, F.lit(WINDOW)) for s in start]))
    rows = rows.groupBy("lang", "turns", "doc_id", F.xxhash64("text").alias("h")).agg(F.first(pieces).alias("pieces"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(13), "doc_id"), "doc_id", "h")
    rows = rows.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= F.col("turns"))
    return rows.orderBy("turn", F.xxhash64("lang"), "lang").limit(sample).select("doc_id", "lang", "pieces")


def network(docs: DataFrame, sample: int = SAMPLE) -> Network | None:
    """The fitted network, or None without labelled rows."""
    rows = sample_of(docs, sample)
    model = rows.groupBy(F.lit(0).alias("one")).applyInArrow(lambda table: fit(table), "languages array<string>, weights binary").first()
    return None if model is None else Network.of(model["languages"], model["weights"])


def answers(net: Network | None, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    n = len(texts)
    if net is None:
        return [UNKNOWN] * n, np.zeros(n)
    known = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    b, off = flat_bytes(texts)
    sizes = np.where(known, np.diff(off), 0)
    of = np.maximum(1, -(-(sizes - WIDEST + 1) // STRIDE)) * known
    doc = np.repeat(np.arange(n), of)
    starts = off[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(of) - of, of)) * STRIDE
    ends = off[doc + 1]
    total = np.zeros((n, len(net.languages)))
    for i in range(0, len(doc), AT_ONCE):
        s = slice(i, i + AT_ONCE)
        z = net.logits(windows(b, starts[s], ends[s])).astype(float) * np.minimum(WINDOW, ends[s] - starts[s])[:, None]
        np.add.at(total, doc[s], z)
    total /= np.maximum(np.bincount(doc, weights=np.minimum(WINDOW, ends - starts), minlength=n), 1)[:, None]
    p = np.exp(total - total.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    best = p.argmax(axis=1)
    return [net.languages[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), known.tolist(), strict=True)], np.where(known, p[np.arange(n), best].round(6), 0.0)


def predictor(net: Network | None):
    def step(batches):
        for batch in slices(batches, "text"):
            lang, score = answers(net, batch["text"])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return step


def identify(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    net = network(d, sample)
    return d.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(predictor(net), "doc_id long, held_out boolean, lang_pred string, score double")


def op13_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
