"""Repeated windows of a distributed corpus, found by ordering the suffixes that may repeat by their own tokens.

A window is ``length`` tokens, and a suffix is a place where one starts. Ordering every suffix of a corpus would move
each token ``length`` times, so suffixes travel in runs: every window is anchored at its leftmost smallest hashed
``gram`` of tokens, which equal windows share at the same place, and the neighbouring windows of one anchor are one run
of text with about a dozen suffixes in it. Rows are dealt over blocks by a hash, so no order or spread of ids, nulls or
copies can fill one block.

1. every block counts the different runs at each gram; a gram with a single run in the whole corpus drops out, since no
   window at it has an equal one outside that run's own copies (about three quarters do on ordinary text);
2. blocks send the text of each different run at a gram that is left to the gram's bucket, which orders the suffixes in
   it token by token (``Spec.judge``: radix passes or subtrees) and answers, bit by bit, which of them are repeats. More
   than ``Spec.group`` runs at one gram (a line that many documents share) are too many for a bucket: their windows are sent one
   by one, dealt by their whole content, equal ones of a block only once;
3. blocks mark the tokens.

Hashes only choose blocks, buckets and what may be left out; equality is always decided on the tokens themselves. A
block is read again in each step: keeping the runs between steps would cost 0.3 of the input's disk, reading them again
about 40 CPU seconds a GB.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import C2, U, flat_bytes, join2, mix64, pack, pack_bytes, unpack, unpack_bytes

GROUP = 4096
PIECE = 120_000
PLACE = 18  # bits of a place in a piece; a piece is shorter than twice PIECE and a window
KEY = 48
SLICE = 1 << 20
NO_ID = np.iinfo(np.int64).max


class Suffixes:
    """Tokens (bytes, or numbers from 1 with 0 as end mark) that can be read eight bytes at a time from any place; such
    a digit orders like its tokens."""

    def __init__(self, tokens: np.ndarray):
        z = tokens.itemsize
        raw = np.zeros(len(tokens) * z + 8, np.uint8)
        raw[:-8] = tokens.astype(f">u{z}").view(np.uint8)
        self.view = np.ndarray((len(tokens) + 1,), ">u8", raw, strides=(z,))
        self.width, self.bits = 8 // z, 8 * z

    def digit(self, at: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The next digit of suffixes with ``left`` (one or more) tokens to read; what lies behind them reads as 0."""
        d = self.view[at].astype(np.uint64)
        short = np.flatnonzero(left < self.width)
        if len(short):
            by = (self.bits * (self.width - left[short])).astype(np.uint64)
            d[short] = d[short] >> by << by
        return d


def refine(s: Suffixes, at: np.ndarray, size: np.ndarray, perm: np.ndarray, group: np.ndarray, passes: int = 0) -> None:
    """Most-significant-digit passes over suffixes in groups, from digit ``passes`` on. perm: suffixes in order; group:
    each one's group, by the place of its first member. Both are changed. Only groups with two or more members are read,
    and only those whose digits differ are sorted. Members of a group must have equal sizes, or end marks that differ."""
    live = np.arange(len(perm))
    while True:
        own, g = perm[live], group[live]
        left = size[own] - passes * s.width
        pair = g[1:] == g[:-1]
        many = np.zeros(len(g), bool)
        many[1:] = pair
        many[:-1] |= pair
        many &= left > 0
        live, own, g, left = live[many], own[many], g[many], left[many]
        if not len(live):
            return
        d = s.digit(at[own] + passes * s.width, left)
        parts = g[1:][(g[1:] == g[:-1]) & (d[1:] != d[:-1])]
        if len(parts):
            parts = parts[np.concatenate([[True], parts[1:] != parts[:-1]])]
            split = np.flatnonzero(parts[np.minimum(np.searchsorted(parts, g), len(parts) - 1)] == g)
            o = split[np.lexsort((d[split], g[split])) if len(parts) > 1 else np.argsort(d[split], kind="stable")]
            perm[live[split]] = own[o]
            d[split] = d[o]
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
            group[live] = np.maximum.accumulate(np.where(new, live, 0))
        passes += 1


def radix_order(s: Suffixes, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order through their first ``size`` tokens, and each one's group. The leading digit deals them into
    parts of a bounded number where it can, and each part is refined by itself."""
    if not len(at):
        return at, at
    d = s.digit(at, size)
    perm = np.argsort(d, kind="stable")
    d = d[perm]
    new = np.concatenate([[True], d[1:] != d[:-1]])
    del d
    group = np.maximum.accumulate(np.where(new, np.arange(len(perm)), 0))
    cuts = np.flatnonzero(new)
    i = 0
    while i < len(perm):
        k = np.searchsorted(cuts, i + SLICE)
        j = len(perm) if k == len(cuts) else int(cuts[k]) if cuts[k] == i + SLICE or cuts[k - 1] <= i else int(cuts[k - 1])
        part = group[i:j] - i
        refine(s, at, size, perm[i:j], part, 1)
        group[i:j] = part + i
        i = j
    return perm, group


@dataclass(frozen=True)
class Spec:
    """length: tokens of a window; gram: tokens of an anchor; words: tokens are words, not bytes.

    first: a window is a repeat if it stands in a document with a smaller id; otherwise if it starts anywhere else.
    judge: which of a bucket's suffixes are repeats; gets Suffixes, their places and values. A value is the smallest
    id (first) or the number of places of the suffix in the block that sent it.
    """

    length: int
    gram: int
    words: bool
    first: bool
    tokens: Callable
    judge: Callable
    group: int = GROUP


def powers(length: int) -> list[int]:
    return [1 << i for i in range(length.bit_length() - 1, -1, -1) if length >> i & 1]


def spans(levels: dict[int, np.ndarray], count: int, length: int) -> np.ndarray:
    """Hash of ``length`` tokens from each of the first ``count`` places."""
    out, o = None, 0
    for p in powers(length):
        part = levels[p][o : o + count]
        out = part if out is None else join2(out, part)
        o += p
    return out


def levels_of(x: np.ndarray, length: int) -> dict[int, np.ndarray]:
    levels, m = {1: x}, 1
    while m * 2 <= length and m * 2 <= len(x):
        h = levels[m]
        levels[m * 2] = join2(h[:-m], h[m:])
        m *= 2
    return levels


def pieces(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Cuts the documents into pieces of about PIECE tokens: first and last token, and for each part the first token,
    the number of windows that start there, and its document. Long documents go over several pieces, which overlap."""
    windows = np.maximum(np.diff(offsets) - length + 1, 0)
    parts = -(-windows // PIECE)
    owners = np.repeat(np.arange(len(windows)), parts)
    nth = np.arange(len(owners)) - np.repeat(np.cumsum(parts) - parts, parts)
    heads = offsets[:-1][owners] + nth * PIECE
    counts = np.minimum(windows[owners] - nth * PIECE, PIECE)
    i = 0
    while i < len(heads):
        j = max(i + 1, int(np.searchsorted(heads, heads[i] + PIECE)))
        yield int(heads[i]), int(heads[j - 1] + counts[j - 1] + length - 1), heads[i:j], counts[i:j], owners[i:j]
        i = j


@dataclass
class Runs:
    """Runs of a block. key: of the anchor's gram; at, n: first window's token and number of windows; own: document."""

    key: np.ndarray
    at: np.ndarray
    n: np.ndarray
    own: np.ndarray


def scan(tokens: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> Runs:
    out: list[list[np.ndarray]] = [[], [], [], []]
    w = length - gram + 1
    low = U((1 << PLACE) - 1)
    for lo, hi, heads, counts, owners in pieces(offsets, length):
        x = tokens[lo:hi]
        m = spans(levels_of(x, length), len(x) - gram + 1, gram) * C2
        m ^= m >> U(29)
        m &= ~low
        m |= np.arange(len(m), dtype=np.uint64)
        p = 1
        while p * 2 <= w:
            m = np.minimum(m[:-p], m[p:])
            p *= 2
        if p < w:
            m = np.minimum(m[: len(m) - (w - p)], m[w - p :])
        total = int(counts.sum())
        first = np.cumsum(counts) - counts
        at = np.arange(total) + np.repeat(heads - lo - first, counts)
        m = m[at]
        start = np.empty(total, dtype=bool)
        start[0] = True
        np.not_equal(m[1:], m[:-1], out=start[1:])
        start[first] = True
        s = np.flatnonzero(start)
        for part, v in zip(out, (mix64(m[s] >> U(PLACE)) >> U(64 - KEY), at[s] + lo, np.diff(s, append=total), owners[np.searchsorted(first, s, side="right") - 1]), strict=True):
            part.append(v)
    return Runs(*(np.concatenate(p) if p else np.zeros(0, k) for p, k in zip(out, (np.uint64, np.int64, np.int64, np.int64), strict=True)))


def expand(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """at, at + 1, ... at + n - 1 of every pair, one after another."""
    return np.repeat(at - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class Block:
    """Documents of a block and their runs. Apart from the order of its rows, everything is a function of the rows."""

    def __init__(self, table: pa.Table, spec: Spec):
        self.table, self.spec = table, spec
        self.ids = table["doc_id"].fill_null(NO_ID).to_numpy()
        self.bytes, self.offsets = flat_bytes(table["text"])
        self.tokens, self.token_offsets, self.cuts, self.ship_from = spec.tokens(self.bytes, self.offsets)
        self.runs = r = scan(self.tokens, self.token_offsets, spec.length, spec.gram)
        # different runs: by key and size, and then by their tokens
        order = np.lexsort((r.n, r.key))
        key, n = r.key[order], r.n[order]
        new = np.ones(len(order), bool)
        new[1:] = (key[1:] != key[:-1]) | (n[1:] != n[:-1])
        group = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        self._exact = None
        if not new.all():
            refine(self.exact, r.at, r.n + spec.length - 1, order, group)
        self.content, self.sample = numbered(order, group)
        self.content_key = r.key[self.sample]
        self.value = self.values(self.content, r.own, len(self.sample))
        self.key_of = np.cumsum(np.concatenate([[True], self.content_key[1:] != self.content_key[:-1]])) - 1 if len(self.sample) else np.zeros(0, np.int64)
        self.keys = self.content_key[np.concatenate([[True], self.key_of[1:] != self.key_of[:-1]])] if len(self.sample) else np.zeros(0, np.uint64)

    @property
    def exact(self) -> Suffixes:
        if self._exact is None:
            self._exact = Suffixes(self.ship_from if self.cuts is None else word_numbers(self.ship_from, self.cuts))
        return self._exact

    def values(self, group: np.ndarray, own: np.ndarray, count: int) -> np.ndarray:
        if not self.spec.first:
            return np.bincount(group, minlength=count)
        out = np.full(count, NO_ID)
        np.minimum.at(out, group, self.ids[own])
        return out

    def text(self, at: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Bytes of ``tokens`` tokens from each place, one after another."""
        if self.cuts is None:
            return self.ship_from[expand(at, tokens)]
        lo = self.cuts[at]
        return self.ship_from[expand(lo, self.cuts[at + tokens] - lo)]

    def choose(self, answers: list[dict], bits: int) -> None:
        """Decides by the answers to step 1 what is sent: runs at grams that are left, or single windows of hot ones.

        sent_at, sent_n, sent_value, sent_key: in order of bucket; sent_run: which run's content (-1: a window).
        """
        state = np.zeros(len(self.keys), np.uint8)
        where = {k: (s, e) for k, s, e in slices_of(self.keys, KEY, bits)}
        for r in answers:
            if r["kind"] == COUNTED:
                s, e = where[r["bucket"]]
                state[s:e] = unpack_bytes(r["payload"])
        state = state[self.key_of]
        r, spec = self.runs, self.spec
        cold = np.flatnonzero(state == LEFT)
        hot = np.flatnonzero((state == HOT)[self.content]) if len(state) else np.zeros(0, np.int64)
        self.window_at = at = expand(r.at[hot], r.n[hot])
        self.window_own = np.repeat(r.own[hot], r.n[hot])
        perm, group = radix_order(self.exact, at, np.full(len(at), spec.length)) if len(at) else (at, at)
        self.window, sample = numbered(perm, group)
        h = self.tokens[at[sample]]
        for k in range(1, spec.length):
            h = join2(h, self.tokens[at[sample] + k])
        self.window_value = self.values(self.window, self.window_own, len(sample))
        key = np.concatenate([self.content_key[cold], mix64(h) >> U(64 - KEY)])
        order = np.argsort(key, kind="stable")
        self.sent_key = key[order]
        self.sent_at = np.concatenate([r.at[self.sample[cold]], at[sample]])[order]
        self.sent_n = np.concatenate([r.n[self.sample[cold]], np.ones(len(sample), np.int64)])[order]
        self.sent_value = np.concatenate([self.value[cold], self.window_value])[order]
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self.cold = cold

    def marks(self, answers: list[dict], bits: int, more_bits: int) -> np.ndarray:
        """A mask of the tokens that repeats cover. Copies within the block count as well as what buckets answer."""
        self.choose(answers, bits)
        r, spec = self.runs, self.spec
        first = np.concatenate([[0], np.cumsum(self.sent_n)])
        seen = np.zeros(first[-1], bool)
        where = {k: (first[s], first[e]) for k, s, e in slices_of(self.sent_key, KEY, more_bits)}
        for a in answers:
            if a["kind"] == JUDGED:
                s, e = where[a["bucket"]]
                seen[s:e] = np.unpackbits(unpack_bytes(a["payload"]), count=e - s)
        own_copy = (lambda group, own, value: self.ids[own] > value[group]) if spec.first else (lambda group, own, value: value[group] > 1)
        starts = np.zeros(len(self.tokens) + 1, bool)
        whole = own_copy(self.content, r.own, self.value)
        starts[expand(r.at[whole], r.n[whole])] = True
        at_place = np.full(len(self.sample), -1, np.int64)
        at_place[self.cold] = self.place[: len(self.cold)]
        asked = np.flatnonzero(~whole & (at_place[self.content] >= 0)) if len(self.sample) else np.zeros(0, np.int64)
        bit = seen[expand(first[at_place[self.content[asked]]], r.n[asked])]
        starts[expand(r.at[asked], r.n[asked])[bit]] = True
        if len(self.window):
            hit = own_copy(self.window, self.window_own, self.window_value) | seen[first[self.place[len(self.cold) :][self.window]]]
            starts[self.window_at[hit]] = True
        cover = np.cumsum(starts, dtype=np.int64)
        out = cover[:-1].copy()
        out[spec.length :] -= cover[: max(0, len(out) - spec.length)]
        return out > 0


def numbered(perm: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group number of every member, first member of every group) of an order with groups."""
    new = np.ones(len(perm), bool)
    new[1:] = group[1:] != group[:-1]
    number = np.empty(len(perm), np.int64)
    number[perm] = np.cumsum(new) - 1
    return number, perm[new]


def word_numbers(b: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Words (each with the blank behind it) as numbers from 1 in byte order."""
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(np.ascontiguousarray(cuts)), pa.py_buffer(np.ascontiguousarray(b))])
    d = words.dictionary_encode()
    rank = np.empty(len(d.dictionary), np.uint32)
    rank[pa.compute.sort_indices(d.dictionary.cast(pa.binary()) if len(b) < 1 << 31 else d.dictionary).to_numpy()] = np.arange(1, len(rank) + 1)
    return rank[d.indices.to_numpy()]


def slices_of(keys: np.ndarray, size: int, bits: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of ascending keys; buckets are the leading bits."""
    digit = (keys >> U(size - bits)).astype(np.int64)
    cut = np.flatnonzero(np.diff(digit, prepend=-1))
    for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(keys)][: len(cut)], strict=True):
        yield int(digit[s]), s, e


ROWS = "block int, part int, bucket int, payload binary, kind int"
SCHEMA = pa.schema([("block", pa.int32()), ("part", pa.int32()), ("bucket", pa.int32()), ("payload", pa.binary()), ("kind", pa.int32())])
COUNTED, JUDGED = 1, 2  # kinds of answers
LEFT, HOT = 1, 2  # states of a gram; 0: a single run


def rows_table(rows: list[tuple]) -> pa.Table:
    return pa.table({f.name: pa.array([r[i] for r in rows], f.type) for i, f in enumerate(SCHEMA)}, schema=SCHEMA)


def parts_of(table: pa.Table, limit: int) -> Iterator[tuple[int, pa.Table]]:
    """A block in parts of at most twice ``limit`` bytes (or a text), in an order that doesn't depend on the rows' order.
    Only equal rows of one input partition, which a hash cannot deal apart, make a block so large."""
    size = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in table["text"]]) if table["text"].nbytes > 2 * limit else np.zeros(0, np.int64)
    if size.sum() <= 2 * limit:
        yield 0, table
        return
    ids = table["doc_id"].fill_null(NO_ID).to_numpy()
    order = np.lexsort(([zlib.crc32(x.as_buffer()) if x.is_valid else 0 for x in table["text"]], size, ids))
    total = np.concatenate([[0], np.cumsum(size[order])])
    i, k = 0, 0
    while i < len(order):
        j = max(i + 1, int(np.searchsorted(total, total[i] + limit)) - 1)
        yield k, table.take(pa.array(order[i:j]))
        i, k = j, k + 1


def send_keys(spec: Spec, bits: int, limit: int) -> Callable:
    def step(key, table):
        rows = []
        for part, t in parts_of(table, limit):
            b = Block(t, spec)
            runs = np.bincount(b.key_of, minlength=len(b.keys))
            rows += [(key[0].as_py(), part, k, pack(b.keys[s:e], runs[s:e]), 0) for k, s, e in slices_of(b.keys, KEY, bits)]
        return rows_table(rows)

    return step


def count_keys(spec: Spec) -> Callable:
    """States of a bucket's grams, for each block that has one left."""

    def step(key, table):
        parts = [unpack(x) for x in table["payload"].to_pylist()]
        sizes = [len(p[0]) for p in parts]
        keys, runs = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        order = np.argsort(keys, kind="stable")
        new = np.ones(len(keys), bool)
        new[1:] = keys[order][1:] != keys[order][:-1]
        group = np.cumsum(new) - 1
        total = np.bincount(group, weights=runs[order])[group]
        state = np.empty(len(keys), np.uint8)
        state[order] = np.where(total > spec.group, HOT, np.where(total > 1, LEFT, 0))
        out, at = [], 0
        for block, part, n in zip(table["block"].to_pylist(), table["part"].to_pylist(), sizes, strict=True):
            if (own := state[at : at + n]).any():
                out.append((block, part, key[0].as_py(), pack_bytes(own), COUNTED))
            at += n
        return rows_table(out)

    return step


def send_runs(spec: Spec, bits: int, more_bits: int, limit: int) -> Callable:
    def step(key, docs, answers):
        rows, by_part = [], answers.to_pylist()
        for part, t in parts_of(docs, limit):
            b = Block(t, spec)
            b.choose([r for r in by_part if r["part"] == part], bits)
            for k, s, e in slices_of(b.sent_key, KEY, more_bits):
                n, value = b.sent_n[s:e].astype(np.uint16), b.sent_value[s:e].astype(np.int64)
                text = b.text(b.sent_at[s:e], b.sent_n[s:e] + spec.length - 1)
                head = np.concatenate([np.array([len(n)], np.int64).view(np.uint8), n.view(np.uint8).reshape(-1, 2).T.ravel(), value.view(np.uint8).reshape(-1, 8).T.ravel()])
                rows.append((key[0].as_py(), part, k, pack_bytes(np.concatenate([head, text])), 0))
        return rows_table(rows)

    return step


def judge_runs(spec: Spec) -> Callable:
    def step(key, table):
        counts, values, texts = [], [], []
        for x in table["payload"]:
            raw = unpack_bytes(x.as_py())
            m = int(raw[:8].view(np.int64)[0])
            counts.append(np.ascontiguousarray(raw[8 : 8 + 2 * m].reshape(2, m).T).view(np.uint16).ravel().astype(np.int64))
            values.append(np.ascontiguousarray(raw[8 + 2 * m : 8 + 10 * m].reshape(8, m).T).view(np.int64).ravel())
            texts.append(raw[8 + 10 * m :])
        sent = [int(c.sum()) for c in counts]
        n, value, b = np.concatenate(counts), np.concatenate(values), np.concatenate(texts)
        del counts, values, texts
        cuts = np.concatenate([[0], np.flatnonzero(b == 0x20) + 1]) if spec.words else None
        tokens = n + spec.length - 1
        at = expand(np.cumsum(tokens) - tokens, n)
        seen = spec.judge(b if cuts is None else word_numbers(b, cuts), tokens, at, n, np.repeat(value, n), spec.length)
        out, i = [], 0
        for block, part, m in zip(table["block"].to_pylist(), table["part"].to_pylist(), sent, strict=True):
            if (own := seen[i : i + m]).any():
                out.append((block, part, key[0].as_py(), pack_bytes(np.packbits(own)), JUDGED))
            i += m
        return rows_table(out)

    return step


def dealt_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> tuple[DataFrame, int]:
    """(doc_id, text, block): rows dealt by a hash of their content and input partition over as many blocks as hold
    block_bytes each on average; and that number. Equal rows of different partitions are dealt apart."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = d.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64).alias("n")).first()["n"] or 0
    blocks = int(size // block_bytes) + 1
    return d.withColumn("block", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(blocks)).cast("int")), blocks


def repeated(docs: DataFrame, spec: Spec, finish: Callable, schema: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 6 << 20) -> DataFrame:
    """finish(block, mask of tokens) gives the result rows of one block, as an Arrow table of ``schema``."""
    d, blocks = dealt_blocks(docs, id_col, text_col, block_bytes)
    more_bits = max(3, (blocks - 1).bit_length())
    bits = max(2, more_bits - 2)  # a bucket of keys is much smaller than one of runs
    d = d.repartition(max(2, blocks // 2), "block")
    keys = d.groupBy("block").applyInArrow(send_keys(spec, bits, block_bytes), ROWS)
    counted = keys.groupBy("bucket").applyInArrow(count_keys(spec), ROWS)
    runs = d.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(send_runs(spec, bits, more_bits, block_bytes), ROWS)
    judged = runs.groupBy("bucket").applyInArrow(judge_runs(spec), ROWS)

    def last(key, table, answers):
        out, by_part = [], answers.to_pylist()
        for part, t in parts_of(table, block_bytes):
            b = Block(t, spec)
            out.append(finish(b, b.marks([r for r in by_part if r["part"] == part], bits, more_bits)))
        return pa.concat_tables(out)

    return d.groupBy("block").cogroup(counted.unionByName(judged).groupBy("block")).applyInArrow(last, schema)
