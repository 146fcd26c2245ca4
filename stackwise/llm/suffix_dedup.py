"""Operator 1: suffix-array dedup by depth-limited most-significant-digit radix sort.

Suffixes are ordered by their bytes, and only through ``threshold`` of them, in digits of eight: the leading digit deals
them into groups, and each later pass reads the next digit of the groups that still have two members and splits those
whose digits differ. Suffixes that are alone drop out early; groups that are whole after the last pass are exactly the
repeated windows, and a member is a repeat if the group has a smaller doc_id. Suffixes at an anchor that occurs once in
the corpus are alone already and never leave their block; the others are dealt by anchor, in runs (see repeats.py).

Defined results: a null or empty text has no bytes and no spans; a null doc_id counts as the largest possible id; rows
with the same doc_id never shadow each other, repeated rows get equal results; texts are bytes, so a cut may fall inside
a character; texts of any length are read whole, in overlapping pieces; of equal windows (ties) all but those of the
smallest doc_id are removed; extra columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import BYTE_KEY
from .repeats import GROUP, Block, Spec, Suffixes, radix_order, repeated

THRESHOLD = 50
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"


def byte_tokens(b: np.ndarray, offsets: np.ndarray):
    return BYTE_KEY[b], offsets, None, b


def repeats_of_smaller_ids(b: np.ndarray, tokens: np.ndarray, at: np.ndarray, n: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """Which suffixes equal, through ``length`` bytes, one with a smaller id."""
    perm, group = radix_order(Suffixes(b), at, np.full(len(at), length))
    ids = ids[perm]
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(perm) else perm
    least = np.repeat(np.minimum.reduceat(ids, first), np.diff(first, append=len(perm))) if len(perm) else ids
    seen = np.empty(len(perm), bool)
    seen[perm] = least < ids
    return seen


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal marked runs that don't cross a document: starts, ends, and each document's first run."""
    edge = np.zeros(len(mask) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate([[False], mask[:-1]]) if len(mask) else mask
    after = np.concatenate([mask[1:], [False]]) if len(mask) else mask
    starts = np.flatnonzero(mask & (~before | edge[:-1]))
    ends = np.flatnonzero(mask & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def finish(b: Block, mask: np.ndarray) -> pa.Table:
    off = b.offsets
    starts, ends, first = runs(mask, off)
    n, removed, digests, spans = [], [], [], []
    for d in range(len(off) - 1):
        lo, hi, i, j = int(off[d]), int(off[d + 1]), int(first[d]), int(first[d + 1])
        own = [(s - lo, e - lo) for s, e in zip(starts[i:j].tolist(), ends[i:j].tolist(), strict=True)]
        h, at = hashlib.sha256(), lo
        for s, e in own:
            h.update(b.bytes[at : s + lo])
            at = e + lo
        h.update(b.bytes[at:hi])
        n.append(hi - lo)
        removed.append(sum(e - s for s, e in own))
        digests.append(h.hexdigest())
        spans.append([{"start": s, "end": e} for s, e in own])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.table({"doc_id": b.table["doc_id"].cast(pa.int64()), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array([len(s) for s in spans], pa.int64()), "kept_sha256": pa.array(digests, pa.string()), "spans": pa.array(spans, kind)})


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, block_bytes: int = 6 << 20, group: int = GROUP) -> DataFrame:
    """Per document, the byte spans that repeat a window of ``threshold`` bytes of a document with a smaller id."""
    spec = Spec(threshold, max(1, threshold * 12 // 25), False, True, byte_tokens, repeats_of_smaller_ids, group)
    return repeated(docs, spec, finish, RESULT, id_col, text_col, block_bytes)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
