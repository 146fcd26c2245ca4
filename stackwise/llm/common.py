"""Shared pieces of the training-data operators: word scanning in numpy, shared folders.

Words are always the maximal runs of bytes other than 0x20 and 0x09-0x0D of the UTF-8 text, which is the same
as ``[^\\x20\\x09-\\x0D]+`` on characters, since those bytes never occur inside a multi-byte character.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

U = np.uint64
C1, C2, C3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_KEY = np.random.default_rng(20240611).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
POWERS = np.multiply.accumulate(np.concatenate([[U(1)], np.full(4095, U(0xD6E8FEB86659FD93))]).astype(np.uint64))


def shared_dir(spark: SparkSession, below: str | None = None) -> str:
    """A new folder below the given one, or the cluster's checkpoint folder, which is also set for checkpoint()."""
    path = f"{below}/{uuid.uuid4().hex}" if below else shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    return path


def materialise(df: DataFrame, name: str, root: str | None = None) -> DataFrame:
    """Writes df as Parquet below the shared folder and reads it back, so that its lineage ends there."""
    spark = df.sparkSession
    path = f"{root or shared_dir(spark)}/{name}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def own_ids(docs: DataFrame, id_col: str = "doc_id") -> bool:
    """Whether every row has a whole number of its own there, so that it can be told from others by that."""
    whole = dict(docs.dtypes)[id_col] in ("bigint", "int", "smallint", "tinyint")
    return whole and docs.groupBy(id_col).agg(F.count("*").alias("n")).where(F.col(id_col).isNull() | (F.col("n") > 1)).isEmpty()


def discard(spark: SparkSession, root: str) -> None:
    """Deletes a shared folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A new shared folder that goes with the block; what outlives the block must be written elsewhere or collected."""
    root = shared_dir(spark)
    try:
        yield root
    finally:
        discard(spark, root)


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x *= C2
    x ^= x >> U(27)
    x *= C3
    x ^= x >> U(31)
    return x


def join2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ordered, non-linear combination of two equally long hash arrays."""
    r = a * C1
    r += b
    r ^= r >> U(32)
    r *= C2
    return r


def flat_bytes(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of the texts one after another, and n+1 offsets; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.large_string())
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, off, data = texts.buffers()
    o = np.frombuffer(off, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    b = np.frombuffer(data, dtype=np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return b, o - o[0]


def slices(batches, *columns: str, limit: int = 1 << 20):
    """The batches in parts with about ``limit`` bytes of text each, so that working memory does not follow Arrow's
    batch size; a longer text is a part of its own."""
    for batch in batches:
        size = np.zeros(batch.num_rows, np.int64)
        for c in columns:
            size += pc.fill_null(pc.binary_length(batch[c]), 0).to_numpy(zero_copy_only=False)
        total, i = np.concatenate([[0], np.cumsum(size + 64)]), 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(total, total[i] + limit)) - 1)
            yield batch.slice(i, j - i)
            i = j


def word_spans(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and n+1 offsets of the documents' words; no word crosses a document."""
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~SPACE[b]
    cut = np.zeros(len(b) + 1, dtype=bool)
    cut[offsets] = True
    prev = np.concatenate([[False], solid[:-1]])
    starts = np.flatnonzero(solid & (~prev | cut[:-1]))
    after = np.concatenate([solid[1:], [False]])
    ends = np.flatnonzero(solid & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of every word, the same wherever the word stands."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    out = np.empty(len(starts), np.uint64)
    step = 65536
    for i in range(0, len(starts), step):
        s, e = starts[i : i + step], ends[i : i + step]
        piece = b[s[0] : e[-1]]
        if lower:
            piece = LOWER[piece]
        lens = e - s
        first = np.concatenate([[0], np.cumsum(lens)[:-1]])
        rel = np.arange(int(lens.sum())) - np.repeat(first, lens)
        at = rel + np.repeat(s - s[0], lens)
        p = POWERS
        if (m := int(lens.max())) > len(p):
            p = np.multiply.accumulate(np.concatenate([[U(1)], np.full(m - 1, POWERS[1])]).astype(np.uint64))
        out[i : i + step] = np.add.reduceat(BYTE_KEY[piece[at]] * p[rel], first) + lens.astype(np.uint64) * C3
    return mix64(out)


def pack(keys: np.ndarray, more: np.ndarray | None = None) -> bytes:
    """Ascending 64-bit keys, and 32-bit values beside them, in few bytes: differences, byte planes, zstd."""
    d = np.diff(keys, prepend=U(0)).view(np.uint8).reshape(-1, 8).T.tobytes()
    if more is not None:
        d += more.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(d).to_bytes(8, "little") + pa.compress(d, codec="zstd", asbytes=True)


def unpack(blob: bytes, with_more: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    size = int.from_bytes(blob[:8], "little")
    d = np.frombuffer(pa.decompress(blob[8:], decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
    n = size // (12 if with_more else 8)
    keys = np.cumsum(np.ascontiguousarray(d[: 8 * n].reshape(8, n).T).view(np.uint64).ravel(), dtype=np.uint64)
    return keys, np.ascontiguousarray(d[8 * n :].reshape(4, n).T).view(np.uint32).ravel() if with_more else None


def pack_bytes(a: np.ndarray) -> bytes:
    d = a.tobytes()
    return len(d).to_bytes(8, "little") + pa.compress(d, codec="zstd", asbytes=True)


def unpack_bytes(blob: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True), np.uint8)
