"""Operator 3: substring dedup with prefix-partitioned suffix trees.

Suffixes of word sequences are split by prefixes of variable length into groups that fit a task's memory: those that
share the 16 words at their anchor are one group, but if the corpus has more than a bucket should hold at that prefix,
all 35 words of a window are the prefix (see repeats.py); a bucket in turn lengthens prefixes by two words at a time,
as far as their counts require. Each group becomes a subtree, given by its leaves in order (words, as far as the text
goes) and the depth at which neighbouring leaves part. Its internal nodes of depth 35 or more are the maximal repeats:
all leaves below such a node start equal windows, and are repeats if they stand for two places or more.

Suffixes at an anchor that occurs once in the corpus never leave their block.

Defined results: null and empty texts have no words; a window may repeat in its own document, overlapping itself; rows
with equal or null doc_id are documents of their own, so repeated rows remove each other; all of equal windows (ties) are
removed; texts of any length are read whole, in overlapping pieces; extra columns are ignored, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import U, word_hashes, word_spans
from .repeats import GROUP, Block, Spec, Suffixes, expand, refine, repeated

WINDOW = 35
LEAVES = 1 << 18
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def word_tokens(b: np.ndarray, offsets: np.ndarray):
    """Hashes, documents' offsets, and the words with one blank behind each."""
    starts, ends, own = word_spans(b, offsets)
    size = ends - starts + 1
    cuts = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    plain = np.full(cuts[-1], 0x20, np.uint8)
    solid = np.ones(len(plain), bool)
    solid[cuts[1:] - 1] = False
    plain[solid] = b[expand(starts, size - 1)]
    return word_hashes(b, starts, ends), own, cuts, plain


def subtree(s: Suffixes, at: np.ndarray, size: np.ndarray, leaves: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """A subtree's leaves in order, and each one's depth in words of the node that parts it from the one before. ``leaves``
    share the first ``depth`` digits."""
    perm = leaves.copy()
    refine(s, at, size, perm, np.zeros(len(perm), np.int64), depth)
    part = np.zeros(len(perm), np.int64)
    live, k = np.arange(1, len(perm)), 0
    while len(live):
        a, b = perm[live - 1], perm[live]
        left_a, left_b = size[a] - k * s.width, size[b] - k * s.width
        x, y = s.digit(at[a] + k * s.width, left_a), s.digit(at[b] + k * s.width, left_b)
        same = x == y
        part[live] += np.where(same, np.minimum(s.width, left_a), (x ^ y) >> U(32) == 0)
        k += 1
        live = live[same & (left_a > s.width) & (left_b > s.width)]
    return perm, part


def subtrees(s: Suffixes, at: np.ndarray, size: np.ndarray):
    """One subtree after another; a prefix is lengthened by a digit while it has more than LEAVES suffixes."""
    todo = [(np.arange(len(at)), 0)]
    while todo:
        leaves, depth = todo.pop()
        left = size[leaves] - depth * s.width
        if len(leaves) <= LEAVES or left.min() <= 0:
            yield subtree(s, at, size, leaves, depth)
            continue
        digit = s.digit(at[leaves] + depth * s.width, left)
        order = np.argsort(digit, kind="stable")
        cut = np.flatnonzero(np.diff(digit[order])) + 1
        # neighbouring prefixes that are small together make one subtree
        group, held = [], 0
        for part in np.split(leaves[order], cut):
            if len(part) > LEAVES:
                todo.append((part, depth + 1))
                continue
            if held + len(part) > LEAVES:
                todo.append((np.concatenate(group), depth))
                group, held = [], 0
            group.append(part)
            held += len(part)
        if group:
            todo.append((np.concatenate(group), depth))


def repeats_of_any_place(numbers: np.ndarray, tokens: np.ndarray, at: np.ndarray, n: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """Which suffixes lie below a node of depth ``length`` that stands for two places or more. Every run gets an end mark,
    so that a suffix reaches to the end of its run and no further."""
    run = np.repeat(np.arange(len(n)), n)
    ends = np.cumsum(tokens)
    s = Suffixes(np.insert(numbers, ends, 0))
    size = ends[run] - at + 1
    seen = np.zeros(len(at), bool)
    for leaves, part in subtrees(s, at + run, size):
        node = np.cumsum(part < length)
        seen[leaves] = np.bincount(node, weights=places[leaves])[node] > 1
    return seen


def finish(b: Block, mask: np.ndarray) -> pa.Table:
    n, removed, digests, kept = [], [], [], []
    for d in range(len(b.offsets) - 1):
        text = b.bytes[b.offsets[d] : b.offsets[d + 1]].tobytes()
        words = text.split()
        drop = mask[b.token_offsets[d] : b.token_offsets[d + 1]]
        if len(drop) and drop.any():
            rest = b" ".join([w for w, x in zip(words, drop.tolist(), strict=True) if not x])
        else:
            rest = b" ".join(words)
        n.append(len(words))
        removed.append(int(drop.sum()))
        digests.append(hashlib.sha256(rest).hexdigest())
        kept.append(rest.decode("utf-8", "replace"))
    return pa.table({"doc_id": b.table["doc_id"].cast(pa.int64()), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string()), "kept_text": pa.array(kept, pa.string())})


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block_bytes: int = 6 << 20, group: int = GROUP) -> DataFrame:
    """Per document, the text without words covered by a window of ``window`` words that starts anywhere else too."""
    spec = Spec(window, max(1, window * 16 // 35), True, False, word_tokens, repeats_of_any_place, group)
    return repeated(docs, spec, finish, RESULT, id_col, text_col, block_bytes)


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept_text")
