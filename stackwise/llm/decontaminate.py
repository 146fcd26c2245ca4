"""Operator 7: benchmark decontamination by latent semantic retrieval.

1. All documents are hashed word by word once, and kept so for the passes that follow. Document frequencies over all of them
   give the IDF weights (2^18 places, a fixed size).
2. A randomised SVD of TF-IDF passages, of a block of benchmark passages and of the whole corpus, each word of it in one
   passage, gives the latent space: every task multiplies its rows A with a matrix G and returns its share of A'(A G); the
   sum, a few MB, is made orthogonal on the driver and goes round once more. RANK directions (of few passages three
   quarters) are fewer than the passages, so the space keeps what passages have in common and drops what is single; CORPUS
   of the weight in it is the corpus', by the words that the latent lane compares.
3. Latent lane: every document is read in windows that start every STEP words, as long as the items are. Windows and items
   are projected, and windows whose cosine to an item is COSINE or more, with NORM of its length, are candidates.
4. A candidate is confirmed by the longest common subsequence of item and words around the window: it covers LCS of the
   item, or, for paraphrases, LCS_ANSWER of it and also LCS of the item's last ANSWER words, with ANSWER_WEIGHT of the
   item's weight, and of a longer item for its last passage.
5. Lexical lane: a space of fewer directions cannot promise each copy. Stretches of SPAN times an item's words that share
   the least weight a part LCS of its words can have are confirmed by that part too, so no stretch with LCS of an item is
   lost, whatever the space is. Paraphrases come by the latent lane only. Each hit names its lane.

The benchmark is read passage by passage. The hashed corpus is read twice for each block's space and once for all blocks
whose models fit in MODELS bytes (some 3,000 passages), which is also the most that goes to a task; a larger benchmark takes
a pass for each such part.

Words are runs of letters, digits and bytes from 0x80, ASCII-lower-cased. Defined results: null and empty texts, and
items without words, match nothing; items of any length are looked for, very short ones as they stand; a long text is read
whole; an item that several rows give (ties, repeated rows) is found once; null doc_ids keep their rows, and are
contaminated if any of their texts is, like repeated doc_ids; extra columns are ignored, whatever their names; empty
tables give empty results or no matches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, flat_bytes, materialise, pack_bytes, shared_dir, slices, unpack_bytes, word_hashes
from .toxicity import SOLID

BITS = 18
SLABS = 16
PASSAGE = 64
STEP = 8
SPAN = 3
CHUNK = 4096
LCS, LCS_ANSWER = 0.7, 0.5
ANSWER = 5
ANSWER_WEIGHT = 0.3
RANK = 96
BLOCK = 256
GROUP = 512  # corpus passages that are multiplied at a time
CORPUS = 0.25
COSINE, NORM = 0.6, 0.5
MODELS = 128 << 20
HASHED = "ids array<long>, ends binary, words binary"
HITS = "doc_id long, item_id long, lcs double, lane string"


def terms(texts) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the normalised words of all texts, and n+1 offsets."""
    b, off = flat_bytes(texts)
    if not len(b):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    solid = SOLID[b]
    edge = np.zeros(len(b) + 1, dtype=bool)
    edge[off] = True
    before, after = np.concatenate([[False], solid[:-1]]), np.concatenate([solid[1:], [False]])
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return word_hashes(b, starts, ends, lower=True), np.searchsorted(starts, off)


def places(h: np.ndarray) -> np.ndarray:
    return (h >> U(64 - BITS)).astype(np.int64)


VECTOR = "slab int, part int, payload binary"


def vector_rows(v: np.ndarray, part: int):
    rows = np.split(v, SLABS)
    return pa.RecordBatch.from_arrays([pa.array(range(SLABS), pa.int32()), pa.array([part] * SLABS, pa.int32()), pa.array([pack_bytes(r) for r in rows], pa.binary())], ["slab", "part", "payload"])


def task_number() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def summed(rows: DataFrame, dtype: str, fan: int) -> np.ndarray:
    """Sum of all tasks' vectors, in two levels of at most about fan rows each; the result has a fixed size."""

    def add(key, table):
        total = None
        for x in table["payload"]:
            v = unpack_bytes(x.as_py()).view(dtype)
            total = v.copy() if total is None else total + v
        return pa.table({"slab": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([0], pa.int32()), "payload": pa.array([pack_bytes(total)], pa.binary())})

    first = rows.withColumn("part", F.col("part") % fan).groupBy("slab", "part").applyInArrow(add, VECTOR)
    parts = {r["slab"]: unpack_bytes(r["payload"]).view(dtype) for r in first.groupBy("slab").applyInArrow(add, VECTOR).collect()}
    return np.concatenate([parts[i] for i in range(SLABS)]) if parts else np.zeros(0, dtype)


def hash_documents(batches):
    """About 1 MB of text to a row: its ids, offsets and word hashes."""
    for batch in slices(batches, "text"):
        h, off = terms(batch["text"])
        ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch["doc_id"])
        yield pa.RecordBatch.from_arrays([ids, pa.array([pack_bytes(off.astype(np.int64))], pa.binary()), pa.array([pack_bytes(h)], pa.binary())], ["ids", "ends", "words"])


def hashed_rows(batches) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(ids, word hashes, offsets) of each row of HASHED."""
    for batch in batches:
        for ids, ends, words in zip(batch["ids"], batch["ends"], batch["words"], strict=True):
            yield ids.values, unpack_bytes(words.as_py()).view(np.uint64), unpack_bytes(ends.as_py()).view(np.int64)


def count_documents(batches):
    df, n = np.zeros((1 << BITS) + SLABS, np.int64), 0
    for ids, h, off in hashed_rows(batches):
        doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
        keys = doc.astype(np.int64) << BITS | places(h)
        keys.sort()
        df[:-SLABS] += np.bincount(keys[np.diff(keys, prepend=-1) != 0] & ((1 << BITS) - 1), minlength=1 << BITS)
        n += len(ids)
    df[-1] = n
    yield vector_rows(df, task_number())


def inverse_frequencies(hashed: DataFrame) -> np.ndarray:
    """Weights of all places."""
    df = summed(hashed.mapInArrow(count_documents, VECTOR), "int64", 1024)
    n = int(df[-1]) if len(df) else 0
    df = df[:-SLABS] if len(df) else np.zeros(1 << BITS, np.int64)
    return np.log((1 + n) / (1 + df)).astype(np.float32) + np.float32(0.05)


def passages(benchmark: DataFrame) -> Iterator[tuple[int, bool, np.ndarray]]:
    """(item, whether its end is here, word hashes), one after another; an item's last passage is joined to the one before if it
    is short."""
    for r in benchmark.toLocalIterator():
        h, _ = terms(pa.array([r["text"]], pa.string()))
        cuts = list(range(0, max(1, len(h) - PASSAGE // 2), PASSAGE))
        for k, at in enumerate(cuts):
            words = h[at : (cuts + [len(h)])[k + 1]] if k + 1 < len(cuts) else h[at:]
            if len(words):
                yield r["item_id"], k + 1 == len(cuts), words


def needs(block: list, idf: np.ndarray, feats: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
    """(each passage's features, how often and how heavy; the weight that a copy shares at least; whether a feature is light,
    that is, weighs little in every passage)."""
    times, light, least = [], np.ones(len(feats), bool), np.zeros(len(block))
    for k, (_, _, h) in enumerate(block):
        at, n = np.unique(np.searchsorted(feats, places(h)), return_counts=True)
        w2 = idf[feats[at]].astype(np.float64) ** 2
        times.append((at, n, w2))
        least[k] = 0.999 * least_weight(np.repeat(w2, n))
        order = np.argsort(w2, kind="stable")
        light[at[order][np.cumsum((n * w2)[order]) > least[k] / 2]] = False
    return times, least, light


def corpus_sharer(g: np.ndarray, lookup: np.ndarray, idf: np.ndarray, size: int):
    """Share of A'(A g) and of A's squared length. Rows of A are all passages of PASSAGE words, of unit length over all of their
    words, of which A has those that lookup knows; a word's count goes in by its root, so that a length is a plain sum. lookup: place to row of g, or -1."""
    weight = np.zeros(len(g), np.float32)
    weight[lookup[lookup >= 0]] = idf[lookup >= 0]

    def share(batches):
        b, total = np.zeros(g.shape, np.float32), 0.0
        for _, h, off in hashed_rows(batches):
            p = places(h)
            parts = -(-np.diff(off) // PASSAGE)
            starts = np.repeat(off[:-1], parts) + (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * PASSAGE
            at = lookup[p]
            take = np.flatnonzero(at >= 0)
            if not len(take):
                continue
            length = np.sqrt(np.add.reduceat(idf[p] ** 2, starts))
            key, count = np.unique((np.searchsorted(starts, take, side="right") - 1) * len(g) + at[take], return_counts=True)
            own, word = key // len(g), key % len(g)
            w = (np.sqrt(count) * weight[word] / length[own]).astype(np.float32)
            total += float((w.astype(np.float64) ** 2).sum())
            cuts = np.searchsorted(own, np.arange(0, len(starts) + GROUP, GROUP))
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i == j:
                    continue
                new = np.diff(own[i:j], prepend=-1) != 0
                y = np.add.reduceat(g[word[i:j]] * w[i:j, None], np.flatnonzero(new), axis=0)
                order = np.argsort(word[i:j], kind="stable")
                by_word = word[i:j][order]
                first = np.flatnonzero(np.diff(by_word, prepend=-1))
                b[by_word[first]] += np.add.reduceat(y[(np.cumsum(new) - 1)[order]] * w[i:j][order, None], first, axis=0)
        v = np.zeros(size, np.float32)
        v[: b.size] = b.ravel()
        v[b.size] = total
        yield vector_rows(v, task_number())

    return share


def latent_space(spark, block: list, idf: np.ndarray, corpus: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(features that the block has, ascending; their coordinates in the space, orthonormal columns). corpus: HASHED."""
    feats = np.unique(np.concatenate([places(h) for _, _, h in block]))
    rank = min(RANK, max(1, 3 * len(block) // 4), len(feats))
    width = min(rank + 8, len(feats))  # a few directions more make the first ones right
    size = -(-(len(feats) * width + 1) // SLABS) * SLABS
    times, _, light = needs(block, idf, feats)
    lookup = np.full(1 << BITS, -1, np.int32)
    lookup[feats[~light]] = np.flatnonzero(~light)
    own = np.zeros((len(block), len(feats)), np.float32)
    for k, (at, n, _) in enumerate(times):
        w = n * idf[feats[at]]
        own[k, at] = w / max(1e-9, np.sqrt((w * w).sum()))

    q = np.random.default_rng(4711).standard_normal((len(feats), width)).astype(np.float32)
    for _ in range(2):
        y = own.T @ (own @ q)
        rest = summed(corpus.mapInArrow(corpus_sharer(q, lookup, idf, size), VECTOR), "float32", 16)
        if len(rest) and rest[y.size] > 0:
            y += np.float32(CORPUS / (1 - CORPUS) * len(block) / rest[y.size]) * rest[: y.size].reshape(y.shape)
        u, s, _ = np.linalg.svd(y.astype(np.float64), full_matrices=False)
        q = u.astype(np.float32)
    return feats, u[:, :rank][:, s[:rank] > 1e-9 * s[0]].astype(np.float32)


def lcs(a: list[int], b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit-parallel rows (a as bits)."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        if m := masks.get(x):
            both = row & m
            row = ((row + both) | (row - both)) & full
    return len(a) - row.bit_count()


def least_weight(w2: np.ndarray) -> float:
    """The least weight that a stretch with a part LCS of an item's words in order shares with it: that of as many of its
    lightest words. w2: squared weights of the item's words."""
    return float(np.sort(w2)[: at_least(LCS, len(w2))].sum())


def at_least(share: float, n: int) -> int:
    """The smallest count k with k / n >= share."""
    return next(k for k in range(int(share * n), n + 1) if k / n >= share)


def confirmed(item: list[int], region: np.ndarray, weight: float = 1.0, answered: bool = True) -> tuple[bool, float]:
    """weight: the share of the item's weight that the region holds, which the answer rule looks at; answered: whether
    the item's last words are its answer, and no place where a longer item was cut."""
    share = lcs(item, region) / len(item)
    if share >= LCS:
        return True, share
    answer = item[-ANSWER:]
    return answered and share >= LCS_ANSWER and weight >= ANSWER_WEIGHT and len(item) > ANSWER and lcs(answer, region) >= LCS * len(answer), share


def model_of(block: list, idf: np.ndarray, feats: np.ndarray, v: np.ndarray) -> tuple[Callable, int]:
    """(search in texts given as word hashes and offsets, size of the model in bytes)."""
    items = [i for i, _, _ in block]
    words = [h.view(np.int64).tolist() for _, _, h in block]
    # each item's words by number (-1: others; the last column is for words outside the space), how often and how heavy
    local = np.full((len(block), len(feats) + 1), -1, np.int16)
    times, least, light = needs(block, idf, feats)
    for k, (at, _, _) in enumerate(times):
        local[k, at] = np.arange(len(at))
    times = [(n, w2) for _, n, w2 in times]
    # Words that weigh little in every item are most of a text. They are left out of the products, and an item then needs
    # that much less. part: per word, its share of what each item needs.
    part = np.zeros((len(feats), len(block)), np.float32)
    for k, (n, w2) in enumerate(times):
        at = np.flatnonzero(local[k, :-1] >= 0)
        part[at, k] = 1.0001 * n * w2 / (least[k] - (n * w2)[light[at]].sum())
    # the latent lane: a word's coordinates, and the items' directions and lengths, by their windows' segments; light words,
    # which all passages share, are left out on both sides
    coordinates = (np.where(light, 0, idf[feats])[:, None] * v).astype(np.float32)
    points = np.stack([(coordinates[np.flatnonzero(local[k, :-1] >= 0)] * n[:, None]).sum(axis=0) for k, (n, _) in enumerate(times)])
    lengths = np.sqrt((points * points).sum(axis=1))
    directions = points / np.maximum(lengths, 1e-9)[:, None]
    span = np.array([-(-len(x) // STEP) + 1 for x in words])
    # a window is no longer than its words together: where these have less than a part NORM of the item's length, it is no candidate
    reach = np.append(1.0001 * np.sqrt((coordinates * coordinates).sum(axis=1)), 0)
    near = []
    for k in np.unique(span):
        at = np.flatnonzero((span == k) & (lengths > 1e-6))
        if len(at):
            near.append((int(k), at, np.ascontiguousarray(directions[at].T), lengths[at]))
    most_common, half = ([at_least(share, len(x)) for x in words] for share in (LCS, LCS_ANSWER))
    lookup = np.full(1 << BITS, -1, np.int32)
    lookup[feats] = np.arange(len(feats))
    heavy = np.append(~light, False)
    # a window of so many segments holds every stretch of SPAN times the item's words that starts in its first segment
    long = np.array([-(-(SPAN * len(x) + STEP - 1) // STEP) for x in words])
    classes = [(int(k), (which := np.flatnonzero(long == k)), np.ascontiguousarray(part[:, which]), part[:, which].max(axis=1)) for k in np.unique(long)]

    def search(h: np.ndarray, off: np.ndarray) -> list[tuple[int, int, float, str]]:
        """(text, item, longest common subsequence as a share of the passage, lane)."""
        known = lookup[places(h)]
        doc_of = np.repeat(np.arange(len(off) - 1), np.diff(off))
        found: dict[tuple[int, int], tuple[float, str]] = {}
        n = np.diff(off)
        segs = -(-n // STEP)
        seg_off = np.concatenate([[0], np.cumsum(segs)])
        seg_doc = np.repeat(np.arange(len(n)), segs)
        seg_lo = off[:-1][seg_doc] + (np.arange(seg_off[-1]) - seg_off[:-1][seg_doc]) * STEP
        seg_end = seg_off[1:][seg_doc]

        def check(d: int, item: int, lo: int, hi: int, lane: str) -> None:
            if found.get((d, item), (0.0, ""))[0] >= 1:
                return
            word = local[item, known[lo:hi]]
            same = word >= 0
            times_, w2 = times[item]
            both = np.minimum(np.bincount(word[same], minlength=len(times_)), times_)
            shared = both @ w2
            # a subsequence has no more words than both have, in any order
            if both.sum() < (most_common[item] if lane == "lexical" else half[item]) or lane == "lexical" and shared < least[item]:
                return
            ok, share = confirmed(words[item], h[lo:hi][same].view(np.int64), shared / (times_ @ w2), lane == "latent" and block[item][1])
            if ok and share > found.get((d, item), (0.0, ""))[0]:
                found[d, item] = share, lane

        def segment_of(take: np.ndarray) -> np.ndarray:
            return seg_off[:-1][doc_of[take]] + (take - off[:-1][doc_of[take]]) // STEP

        # latent lane, CHUNK windows at a time, with the segments that they reach
        take = np.flatnonzero(heavy[known])
        in_seg, widest = segment_of(take), max((k for k, *_ in near), default=0)
        reached = np.concatenate([[0], np.cumsum(np.bincount(in_seg, reach[known[take]], minlength=seg_off[-1]))])
        for base in range(0, int(seg_off[-1]) if near else 0, CHUNK):
            over = min(base + CHUNK + widest, int(seg_off[-1]))
            lo, hi = np.searchsorted(in_seg, [base, over])
            x = np.zeros((over - base + 1, coordinates.shape[1]))
            for j in range(lo, hi, 8192):
                e = min(j + 8192, hi)
                cut = np.flatnonzero(np.diff(in_seg[j:e], prepend=-1))
                x[in_seg[j:e][cut] - base + 1] += np.add.reduceat(coordinates[known[take[j:e]]], cut, axis=0)
            np.cumsum(x, axis=0, out=x)
            every = np.arange(base, min(base + CHUNK, int(seg_off[-1])))
            for k, which, unit, length in near:
                at = every[reached[np.minimum(every + k, seg_end[every])] - reached[every] >= NORM * length.min()]
                w = (x[np.minimum(at + k, seg_end[at]) - base] - x[at - base]).astype(np.float32)
                size = np.sqrt(np.einsum("ij,ij->i", w, w))
                some = np.flatnonzero(size >= NORM * length.min())
                cosine = (w[some] @ unit) / size[some, None]
                for i, j in zip(*np.nonzero((cosine >= COSINE) & (size[some, None] >= NORM * length)), strict=True):
                    g, item = int(at[some[i]]), int(which[j])
                    d, more = int(seg_doc[g]), len(words[item])
                    check(d, item, max(int(off[d]), int(seg_lo[g]) - more), min(int(off[d + 1]), int(seg_lo[g]) + k * STEP + more), "latent")
        # lexical lane, by items' lengths: none is reached where even the largest parts of the words do not sum up to 1
        at = np.arange(seg_off[-1])
        for k, which, own, most in classes:
            bound = np.concatenate([[0.0], np.cumsum(np.bincount(in_seg, most[known[take]], minlength=seg_off[-1]))])
            first = np.flatnonzero(bound[np.minimum(at + k, seg_end)] - bound[at] >= 1)
            for i in range(0, len(first), CHUNK):
                f = first[i : i + CHUNK]
                last = np.minimum(f + k, seg_end[f])
                # only the segments from this part's first to its last window
                base, over = f[0], int(last.max())
                need = np.zeros(over - base + 1, np.int64)
                np.add.at(need, f - base, 1)
                np.add.at(need, last - base, -1)
                needed = np.cumsum(need)[:-1] > 0
                number = np.concatenate([[0], np.cumsum(needed)])
                close = slice(*np.searchsorted(in_seg, [base, over]))
                chosen = needed[in_seg[close] - base]
                t, g = take[close][chosen], number[in_seg[close][chosen] - base]
                x = np.zeros((number[-1] + 1, len(which)))
                for j in range(0, len(t), 8192):
                    cut = np.flatnonzero(np.diff(g[j : j + 8192], prepend=-1))
                    x[g[j : j + 8192][cut] + 1] += np.add.reduceat(own[known[t[j : j + 8192]]], cut, axis=0)
                np.cumsum(x, axis=0, out=x)
                for a, b in zip(*np.nonzero(x[number[last - base]] - x[number[f - base]] >= 1), strict=True):
                    d = int(seg_doc[f[a]])
                    check(d, int(which[b]), int(seg_lo[f[a]]), int(min(off[d + 1], seg_lo[f[a]] + k * STEP)), "lexical")
        return [(d, items[i], share, lane) for (d, i), (share, lane) in found.items()]

    return search, part.nbytes + local.nbytes + lookup.nbytes + coordinates.nbytes


def searcher(models: list[Callable]):
    def step(batches):
        for ids, h, off in hashed_rows(batches):
            found = [x for search in models for x in search(h, off)]
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[d].as_py() for d, *_ in found], pa.int64()), pa.array([i for _, i, *_ in found], pa.int64()), pa.array([x for *_, x, _ in found], pa.float64()), pa.array([lane for *_, lane in found], pa.string())],
                    ["doc_id", "item_id", "lcs", "lane"],
                )

    return step


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, lcs, lane): documents with a passage of a benchmark item; of both lanes, the one that found more
    of it, the latent one of equals."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = passages(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null"))
    hits, models, size, idf, root = [], [], 0, None, shared_dir(spark)
    while block := list(islice(items, BLOCK)):
        if idf is None:
            hashed = materialise(d.mapInArrow(hash_documents, HASHED), "hashed", root)
            idf = inverse_frequencies(hashed)
        search, n = model_of(block, idf, *latent_space(spark, block, idf, hashed))
        if models and size + n > MODELS:
            hits.append(materialise(hashed.mapInArrow(searcher(models), HITS), f"hits{len(hits)}", root))
            models, size = [], 0
        models.append(search)
        size += n
    if models:
        hits.append(hashed.mapInArrow(searcher(models), HITS))
    out = reduce(DataFrame.unionByName, hits) if hits else spark.createDataFrame([], HITS)
    best = F.max(F.struct("lcs", (F.col("lane") == "latent").alias("latent"), "lane"))
    return out.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.lcs", "b.lane")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, contaminated, item_ids (ascending), lcs (largest share) for every row of docs."""
    hits = leaks(docs, benchmark, id_col, text_col).groupBy(F.col("doc_id").alias("hit")).agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("lcs").alias("lcs"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id")).join(hits, F.col("doc_id").eqNullSafe(F.col("hit")), "left")
    return rows.select("doc_id", F.col("lcs").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"), "lcs")


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
