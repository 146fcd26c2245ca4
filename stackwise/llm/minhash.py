"""Operator 2: near-duplicate detection with min-max MinHash signatures.

Every permutation gives two signature values, the smallest and the largest permuted shingle, so 96 hash evaluations
make 192 values. Bands of them are the candidate buckets; with the rows of a band chosen for the threshold, a pair at
the threshold shares no band with a probability below 1e-6. Sets with equal SHA-256 digests are one node from the start.

Links are confirmed on full sets, never on signatures, and no bucket is expanded into its pairs:

1. in ROUNDS rounds, each member of a bucket that is not yet connected to the bucket's pivot (another one each round, the
   smallest id first) is compared with it, and linked documents form components;
2. the members of buckets that still hold different components are *open*, and compared by their sets in units of two
   chunks of at most CHUNK members: members of the bucket's largest component against all others, and these among each
   other, but none with one of its own component; a bucket of at most CHUNK members is one unit. A larger one with k members outside of that component sends k texts for each
   chunk of the others, so work grows with its *unlinked* members, and shared shingles are counted by matrix products; only
   links that join components are emitted. Equal buckets are compared once.

Defined results: null text, and text without words, has an empty set, no links and its own id; fewer words than a
shingle are one shingle; a long text counts whole; a null doc_id gets a null component and is kept; rows with the same
doc_id are one document, linked where any of its texts is, so repeated rows are all kept; of copies (ties) the smallest doc_id is kept; extra
columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, flat_bytes, join2, materialise, mix64, shared_dir, slices, word_hashes, word_spans
from .graph import components

PERMUTATIONS = 96
ROUNDS = 2
CHUNK = 128
SLAB = 4096
BITS = 1 << 25
FACTORS = np.random.default_rng(7001).integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * U(2) + U(1)
OFFSETS = np.random.default_rng(7002).integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)


def shingle_sets(texts, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, ascending within it, and n+1 offsets."""
    b, off = flat_bytes(texts)
    starts, ends, own = word_spans(b, off)
    w = word_hashes(b, starts, ends, lower=True)
    n = np.diff(own)
    acc = w.copy()
    for j in range(1, width):
        acc = join2(acc[: max(0, len(w) - j)], w[j:])
    sets = []
    for s, k in zip(own[:-1].tolist(), n.tolist(), strict=True):
        if k >= width:
            sets.append(np.unique(acc[s : s + k - width + 1]))
        elif k:
            x = w[s : s + 1]
            for j in range(1, k):
                x = join2(x, w[s + j : s + j + 1])
            sets.append(mix64(x ^ U(k)))
        else:
            sets.append(acc[:0])
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), offsets


def rows_per_band(percent: int) -> int:
    t = percent / 100
    return max((r for r in range(1, 17) if (1 - t**r) ** (2 * PERMUTATIONS // r) <= 1e-6), default=1)


def band_keys(flat: np.ndarray, offsets: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each (non-empty) set."""
    docs = len(offsets) - 1
    sig = np.empty((2 * PERMUTATIONS, docs), np.uint64)
    i = 0
    while i < docs:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + 32768)) - 1)
        piece, cut = flat[offsets[i] : offsets[j]], (offsets[i:j] - offsets[i])
        for p in range(PERMUTATIONS):
            h = piece * FACTORS[p]
            h += OFFSETS[p]
            sig[p, i:j] = np.minimum.reduceat(h, cut)
            sig[PERMUTATIONS + p, i:j] = np.maximum.reduceat(h, cut)
        i = j
    bands = 2 * PERMUTATIONS // rows
    keys = np.empty((docs, bands), np.uint64)
    for k in range(bands):
        acc = np.full(docs, U(k + 1))
        for r in range(rows):
            acc = join2(acc, sig[k * rows + r])
        keys[:, k] = mix64(acc)
    return keys


SKETCH = "doc_id long, n_shingles long, digest binary, bands array<long>"


def lists(flat: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.view(np.int64)))


def sketcher(width: int, rows: int):
    def step(batches):
        for batch in slices(batches, "text"):
            flat, off = shingle_sets(batch["text"], width)
            n = np.diff(off)
            full = np.flatnonzero(n)
            keys = band_keys(flat, np.append(off[:-1][full], len(flat)), rows) if len(full) else np.zeros((0, 0), np.uint64)
            ends = np.zeros(len(n) + 1, np.int64)
            ends[1:][full] = keys.shape[1]
            digests = [hashlib.sha256(flat[s:e].tobytes()).digest() if e > s else None for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(n.astype(np.int64)), pa.array(digests, pa.binary()), lists(keys.ravel(), np.cumsum(ends))], ["doc_id", "n_shingles", "digest", "bands"])

    return step


def linked(shared: int, a: int, b: int, percent: int) -> bool:
    return shared > 0 and 100 * shared >= percent * (a + b - shared)


def pair_checker(width: int, percent: int):
    def step(batches):
        for batch in slices(batches, "ta", "tb"):
            fa, oa = shingle_sets(batch["ta"], width)
            fb, ob = shingle_sets(batch["tb"], width)
            good = []
            for i in range(batch.num_rows):
                x, y = fa[oa[i] : oa[i + 1]], fb[ob[i] : ob[i + 1]]
                if min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                    both = np.concatenate([x, y])
                    both.sort()
                    good.append(linked(int((both[1:] == both[:-1]).sum()), len(x), len(y), percent))
                else:
                    good.append(False)
            keep = batch.filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays([keep["a"], keep["b"]], ["a", "b"])

    return step


def likely(texts: DataFrame, ids: DataFrame, by: str = "tid") -> DataFrame:
    """Rows of texts whose tid may be one of ids (id): all that are, and few others. Each id sets one of BITS bits, 4 MB for
    any number of ids, which are broadcast; a join with the ids then moves these texts and not all. by: tid's name."""

    def place(c: str):
        return F.pmod(F.xxhash64(c), F.lit(BITS))

    bits = ids.select(place("id").alias("place")).groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    at = F.bitmap_bit_position(place(by))
    byte = F.conv(F.hex(F.substring("bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = texts.join(F.broadcast(bits), F.bitmap_bucket_number(place(by)) == F.col("bucket"))
    return found.where(F.getbit(byte, at % 8) == 1).select(texts.columns)


def confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int, name: str, root: str) -> DataFrame:
    """The links among distinct (a, b), written. a's text meets b's by joins whose hot sides Spark can split."""
    texts = likely(texts, pairs.select(F.explode(F.array("a", "b")).alias("id")))
    with_a = pairs.join(texts, F.col("a") == F.col("tid")).select("a", "b", F.col("text").alias("ta"))
    with_both = with_a.join(texts, F.col("b") == F.col("tid")).select("a", "b", "ta", F.col("text").alias("tb"))
    return materialise(with_both.mapInArrow(pair_checker(width, percent), "a long, b long"), name, root)


def relabelled(nodes: DataFrame, links: DataFrame, below: str | None = None) -> DataFrame:
    """nodes (rep, comp) with the components that new links between reps give."""
    here = nodes.select("rep", "comp")
    ends = links.join(here.select(F.col("rep").alias("a"), F.col("comp").alias("ca")), "a").join(here.select(F.col("rep").alias("b"), F.col("comp").alias("cb")), "b")
    joined = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")), below).withColumnRenamed("comp", "to")
    return nodes.join(joined, F.col("comp") == F.col("id"), "left").withColumn("comp", F.coalesce("to", "comp")).drop("id", "to")


def unit_checker(width: int, percent: int):
    def step(key, table):
        """Links that join components, among the pairs of a unit: of chunk u with chunk v, or within one chunk."""
        u, v = key[1].as_py(), key[2].as_py()
        ids, comp, chunk = (table[c].to_numpy() for c in ("rep", "comp", "chunk"))
        pieces = [shingle_sets(b["text"], width) for b in slices(table.to_batches(), "text")]
        flat = np.concatenate([f for f, _ in pieces])
        off = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(o) for _, o in pieces]))])
        n, own = np.diff(off), np.repeat(np.arange(len(ids)), np.diff(off))
        _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
        # a shingle that one member has is shared with none
        shared = count > 1
        number = np.cumsum(shared) - 1
        keep = shared[code]
        code, own = number[code[keep]], own[keep]
        order = np.argsort(code, kind="stable")
        code, own = code[order], own[order]
        left, right = np.flatnonzero(chunk == u), np.flatnonzero(chunk == v)
        both = np.zeros((len(left), len(right)), np.float32)
        cuts = np.searchsorted(code, np.arange(0, int(shared.sum()) + SLAB, SLAB))
        for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            x = np.zeros((len(ids), SLAB), np.float32)
            x[own[i:j], code[i:j] - k * SLAB] = 1
            both += x[left] @ x[right].T
        good = (both > 0) & (100 * both >= percent * (n[left][:, None] + n[right][None, :] - both))
        comp = np.unique(comp, return_inverse=True)[1]
        links = []
        for i in np.flatnonzero(good.any(axis=1)).tolist():
            for j in np.flatnonzero(good[i]).tolist():
                a, b = left[i], right[j]
                if comp[a] != comp[b]:
                    links.append((int(ids[a]), int(ids[b])))
                    comp[comp == comp[b]] = comp[a]
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return step


def units_of(here: DataFrame) -> DataFrame:
    """key, u, v, rep, comp, chunk: members of buckets with several components, once for each unit that needs them. here:
    key, rep, comp. Chunks of the largest component have the numbers from 0, those of the others follow."""
    parts = here.groupBy("key", "comp").agg(F.count("*").alias("c"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("content"))
    mixed = parts.groupBy("key").agg(F.count("*").alias("comps"), F.sum("c").alias("m"), F.sum("content").alias("content"), F.max(F.struct("c", "comp")).alias("top")).where("comps > 1")
    mixed = mixed.groupBy("content", "m").agg(F.min(F.struct("key", "top")).alias("k")).select("k.key", F.col("k.top.comp").alias("main"), F.ceil(F.col("k.top.c") / CHUNK).cast("int").alias("ca"), F.ceil((F.col("m") - F.col("k.top.c")) / CHUNK).cast("int").alias("cb"), "m")
    # few members are one chunk, and each goes to one unit only
    few = F.col("m") <= CHUNK
    mixed = mixed.withColumns({"main": F.when(~few, F.col("main")), "ca": F.when(few, 0).otherwise(F.col("ca")), "cb": F.when(few, 1).otherwise(F.col("cb"))}).drop("m")
    rows = here.join(mixed, "key").withColumn("inside", F.col("comp") == F.col("main"))
    rows = rows.withColumn("chunk", F.when(F.col("inside"), F.pmod(F.xxhash64("rep"), F.col("ca"))).otherwise(F.col("ca") + F.pmod(F.xxhash64("rep"), F.col("cb"))).cast("int"))
    first = F.when(F.col("inside"), F.col("ca")).otherwise(0)
    rows = rows.select("key", "rep", "comp", "chunk", F.explode(F.sequence(first, F.col("ca") + F.col("cb") - 1)).alias("other"))
    return rows.select("key", F.least("chunk", "other").alias("u"), F.greatest("chunk", "other").alias("v"), "rep", "comp", "chunk")


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, below: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: components of documents whose shingle sets have a Jaccard similarity of
    percent/100 or more. below: a shared folder for all that is written, which must last until the result is read."""
    spark = docs.sparkSession
    root = shared_dir(spark, below)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketch = materialise(d.mapInArrow(sketcher(width, rows_per_band(percent)), SKETCH), "sketch", root)
    nodes = sketch.where("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.first("bands").alias("bands"))
    nodes = materialise(nodes.withColumn("comp", F.col("rep")), "nodes0", root)
    texts = d.where("doc_id is not null").withColumnRenamed("doc_id", "tid")

    # a doc_id with several texts is one document
    several = sketch.where("digest is not null").groupBy("doc_id").agg(F.min("digest").alias("d0"), F.max("digest").alias("d1")).where("d0 <> d1").select("doc_id")
    same = several.join(sketch.select("doc_id", "digest"), "doc_id").join(nodes.select("digest", "rep"), "digest").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b")
    same = materialise(same.join(nodes.select("rep"), F.col("a") == F.col("rep"), "left_semi"), "same", root)

    # buckets with two members or more: all that later steps look at
    members = nodes.select("rep", "n", F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high").select("key")
    shared = materialise(shared, "shared", root)
    members = likely(members, shared.select(F.col("key").alias("id")), "key")
    members = materialise(members.join(shared, "key").select("key", "rep", "n"), "buckets", root)
    for r in range(rounds):
        here = members.join(nodes.select("rep", "comp"), "rep")
        turn = F.col("rep") if r == 0 else F.xxhash64(F.lit(r), "rep")
        pivot = F.min(F.struct(turn.alias("t"), "rep", "n", "comp")).alias("p")
        mixed = here.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), pivot).where("c0 <> c1").select("key", F.col("p.rep").alias("pivot"), F.col("p.n").alias("pn"), F.col("p.comp").alias("pc"))
        pairs = here.join(mixed, "key").where((F.col("comp") != F.col("pc")) & (F.least("n", "pn") * 100 >= percent * F.greatest("n", "pn"))).select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct()
        pairs = materialise(pairs, f"pairs{r}", root)
        links = confirm(pairs, texts, width, percent, f"links{r}", root)
        nodes = materialise(relabelled(nodes, links.unionByName(same) if r == 0 else links, below), f"nodes{r + 1}", root)

    units = materialise(units_of(members.join(nodes.select("rep", "comp"), "rep")), "units", root)
    # a text is shorter than its set, so texts go to the units
    asked = likely(texts, units.select(F.col("rep").alias("id")))
    asked = units.join(asked, F.col("rep") == F.col("tid")).select("key", "u", "v", "rep", "comp", "chunk", "text")
    links = asked.groupBy("key", "u", "v").applyInArrow(unit_checker(width, percent), "a long, b long")
    nodes = relabelled(nodes, materialise(links, "links", root), below)

    out = sketch.select("doc_id", "n_shingles", "digest").join(nodes.select("digest", "comp"), "digest", "left")
    out = out.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("comp")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op2_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=85)
