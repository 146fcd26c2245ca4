"""Operator 11: alignment of two tokenizers' tokens, with corpus-wide counts of linked ids.

Both tokenizers' tokens cover the same bytes (space + text); offsets where tokens of both end cut them into groups, and
tokens whose bytes overlap are linked. Documents are tokenized once, in units of about 1 MB; a unit is encoded as a whole
in numpy. It leaves a row for each document, and for each of BUCKETS buckets of B ids the multiplicities of (B id, A id,
document) as sorted, packed postings; pair counts are added up in the task before they leave it.

Counts and postings are then cogrouped by bucket: a stream sorted by bucket (Spark spills it), counts first. A task adds
the counts of a bucket's pairs, takes each B id's highest, and answers every unit's postings as they come, by the number
of a document in its unit. A bucket's counts are at most (B ids / BUCKETS) x (A ids) numbers whatever the corpus is; its
postings grow with the corpus, so a bucket goes over as many splits as its bytes need, each with the bucket's counts, and
a B id that a third of all links hold is divided by units. Answers return to their unit, and are added there.

Defined results: null and empty texts, and those whose tokens' bytes are not space + text, have zeros and an empty hash;
strings of special tokens are plain text; null and repeated doc_ids and repeated rows keep their rows, each counts; a long
text is a unit of its own and read whole; ids that tie for a B id's highest count are all best; extra columns are ignored,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, materialise, pack, pack_bytes, shared_dir, slices, unpack, unpack_bytes
from .token_counts import tokenizer_path

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
BUCKETS = 256
SPLIT_BYTES = 64 << 20
HELD_PAIRS = 1 << 19
DOC_BITS, A_BITS = U(16), U(20)  # a posting's key: B id of the bucket, A id, document of the unit (slices() has at most 2^14)
MADE = "kind string, unit string, doc int, bucket int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, payload binary, size long"
MADE_ARROW = pa.schema([("kind", pa.string()), ("unit", pa.string()), ("doc", pa.int32()), ("bucket", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("payload", pa.binary()), ("size", pa.int64())])
PROBE = ["It's 1234 words,\n\n  and\t(more)...  ", "naïve é中文 𝄞 ٣²"]
_LOADED: dict = {}


def byte_of_symbol() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for U+0100 and on, in order."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_level(path: str):
    """The vocabulary of a byte-level BPE file, and its encoder without special tokens.

    Where ids follow the order of merges (each merge makes the next id), the vocabulary is all that BPE needs, and tiktoken
    encodes with it, four times as fast as the file's own library; ids are the same. Else that library encodes."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    t.encode_special_tokens = True
    symbols, vocabulary = byte_of_symbol(), t.get_vocab()
    special = {x.content for x in t.get_added_tokens_decoder().values()}
    table = [b""] * (max(vocabulary.values()) + 1)
    for entry, i in vocabulary.items():
        table[i] = entry.encode() if entry in special else bytes(symbols[c] for c in entry)
    with open(path, encoding="utf-8") as f:
        merges = json.load(f)["model"].get("merges", [])
    joined = ["".join(m.split(" ") if isinstance(m, str) else m) for m in merges]
    slow = lambda texts: [e.ids for e in t.encode_batch_fast([f" {x}" for x in texts], add_special_tokens=False)]
    if joined and all(vocabulary.get(m) == 256 + k for k, m in enumerate(joined)):
        import public_tokenizers
        import tiktoken

        ranks = {b: i for i, b in enumerate(table) if i < 256 + len(joined)}
        k = tiktoken.Encoding(name=os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        fast = lambda texts: [k.encode_ordinary(f" {x}") for x in texts]
        if fast(PROBE) == slow(PROBE):  # the file cuts words as tiktoken is told to
            return table, fast
    return table, slow


class Side:
    """One tokenizer: encode texts, the bytes of each id, and the id as text before each separator."""

    def __init__(self, name: str):
        path = tokenizer_path(name)
        if name.endswith(".json"):
            self.bytes, self.encode = byte_level(path)
        else:
            import sentencepiece

            p = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: p.encode(texts, num_threads=1)
            ids = range(p.get_piece_size())
            self.bytes = [bytes([int(p.id_to_piece(i)[3:5], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace("▁", " ").encode() for i in ids]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        # an id and a separator as bytes, filled up with zeros
        width = len(str(len(self.bytes))) + 1
        self.shown = np.frombuffer(b"".join(f"{i}{end}".encode().ljust(width, b"\0") for i in range(len(self.bytes)) for end in ",|;"), np.uint8).reshape(-1, width)


def side(name: str) -> Side:
    if name not in _LOADED:
        _LOADED[name] = Side(name)
    return _LOADED[name]


def tokens(texts: list[str | None], a: Side, b: Side) -> tuple[list, list]:
    """Ids of both sides for every text; none where the bytes of a side are not space + text."""
    full = [i for i, t in enumerate(texts) if t]
    ids_a, ids_b = [[]] * len(texts), [[]] * len(texts)
    some = [texts[i] for i in full]
    for i, t, x, y in zip(full, some, a.encode(some), b.encode(some), strict=True):
        want = b" " + t.encode()
        if b"".join(map(a.bytes.__getitem__, x)) == want and b"".join(map(b.bytes.__getitem__, y)) == want:
            ids_a[i], ids_b[i] = x, y
    return ids_a, ids_b


class Aligned:
    """Groups and links of a unit of texts, all in one run of bytes; both sides end wherever a text ends."""

    def __init__(self, ids_a: list, ids_b: list, a: Side, b: Side):
        self.n_a, self.n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
        self.a, self.b = (np.array(list(chain.from_iterable(ids)), np.int64) for ids in (ids_a, ids_b))
        end_a, end_b = np.cumsum(a.lengths[self.a]), np.cumsum(b.lengths[self.b])
        size = int(end_a[-1]) + 1 if len(end_a) else 1
        ends_a, ends_b = np.zeros(size, bool), np.zeros(size, bool)
        ends_a[end_a] = ends_b[end_b] = True
        common = ends_a & ends_b
        # how many ends lie before each byte offset
        before = lambda ends: np.cumsum(ends, dtype=np.int32) - ends
        group = before(common)
        self.group_a, self.group_b = group[end_a], group[end_b]
        self.of_groups = int(common.sum())
        first_a = np.concatenate([[0], np.cumsum(self.n_a)])
        self.n_groups = np.diff(np.append(self.group_a, self.of_groups)[first_a])
        # between two ends, of whichever side, exactly one token of each side covers the bytes: one link
        ends = np.flatnonzero(ends_a | ends_b)
        self.link_a, self.link_b = before(ends_a)[ends], before(ends_b)[ends]
        self.link_doc = np.repeat(np.arange(len(ids_a)), self.n_a)[self.link_a]
        self.n_links = np.bincount(self.link_doc, minlength=len(ids_a)).astype(np.int64)

    def hashes(self, a: Side, b: Side) -> list[str]:
        """SHA-256 of each text's groups as written; empty without tokens."""
        if not len(self.a):
            return [""] * len(self.n_a)
        last_a = np.append(self.group_a[1:] != self.group_a[:-1], True)
        last_b = np.append(self.group_b[1:] != self.group_b[:-1], True)
        of_a = np.bincount(self.group_a, minlength=self.of_groups)
        of_b = np.bincount(self.group_b, minlength=self.of_groups)
        width = max(a.shown.shape[1], b.shown.shape[1])
        written = np.zeros((len(self.a) + len(self.b), width), np.uint8)
        at = np.arange(len(self.a)) + (np.cumsum(of_b) - of_b)[self.group_a]
        written[at, : a.shown.shape[1]] = a.shown[self.a * 3 + last_a]
        at = np.arange(len(self.b)) + np.cumsum(of_a)[self.group_b]
        written[at, : b.shown.shape[1]] = b.shown[self.b * 3 + 2 * last_b]
        solid = written != 0
        ends = np.concatenate([[0], np.cumsum(solid.sum(axis=1))])[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])].tolist()
        text = written[solid].tobytes()
        return [hashlib.sha256(text[lo : hi - 1]).hexdigest() if hi > lo else "" for lo, hi in zip(ends[:-1], ends[1:], strict=True)]


def unit_keys(links: Aligned, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets, keys (B id of the bucket, A id, document) and multiplicities of a unit's links, in order."""
    b = links.b[links.link_b].astype(np.uint64)
    inside = (b // U(buckets)) << (A_BITS + DOC_BITS) | links.a[links.link_a].astype(np.uint64) << DOC_BITS | links.link_doc.astype(np.uint64)
    keys, n = np.unique((b % U(buckets)) << U(52) | inside, return_counts=True)
    return (keys >> U(52)).astype(np.int32), keys & U((1 << 52) - 1), n


def add_up(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(keys) else n


def pack_counts(keys: np.ndarray, n: np.ndarray) -> bytes:
    return pack_bytes(np.concatenate([keys, n.astype(np.uint64)]))


def unpack_counts(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = unpack_bytes(blob).view(np.uint64)
    return both[: len(both) // 2], both[len(both) // 2 :].astype(np.int64)


def rows(**columns) -> pa.RecordBatch:
    n = max(len(v) for v in columns.values() if isinstance(v, list | np.ndarray))
    full = [columns.get(f.name) for f in MADE_ARROW]
    full = [[v] * n if v is None or isinstance(v, str) else v for v in full]
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(full, MADE_ARROW, strict=True)], schema=MADE_ARROW)


def aligner(name_a: str, name_b: str, buckets: int):
    def counts(held_keys, held_n):
        keys, n = add_up(np.concatenate(held_keys), np.concatenate(held_n))
        which = (keys >> U(52)).astype(np.int64)
        cut = np.flatnonzero(np.append(True, which[1:] != which[:-1]))
        inside = keys & U((1 << 52) - 1)
        blobs = [pack_counts(k, m) for k, m in zip(np.split(inside, cut[1:]), np.split(n, cut[1:]), strict=True)]
        return rows(kind="counts", bucket=which[cut].astype(np.int32), payload=blobs, size=[len(x) for x in blobs])

    def step(batches):
        a, b = side(name_a), side(name_b)
        held_keys, held_n, held = [], [], 0
        for batch in slices(batches, "text"):
            ids_a, ids_b = tokens(batch["text"].to_pylist(), a, b)
            links = Aligned(ids_a, ids_b, a, b)
            unit = uuid.uuid4().hex
            yield rows(kind="doc", unit=unit, doc=np.arange(batch.num_rows, dtype=np.int32), doc_id=batch["doc_id"].to_pylist(), n_a=links.n_a, n_b=links.n_b, n_groups=links.n_groups, n_links=links.n_links, groups_sha256=links.hashes(a, b))
            bucket, keys, n = unit_keys(links, buckets)
            if not len(keys):
                continue
            cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            blobs = [pack(k, m) for k, m in zip(np.split(keys, cut[1:]), np.split(n, cut[1:]), strict=True)]
            yield rows(kind="postings", unit=unit, bucket=bucket[cut], payload=blobs, size=[len(x) for x in blobs])
            keys, n = add_up(bucket.astype(np.uint64) << U(52) | keys >> DOC_BITS, n)
            held_keys.append(keys)
            held_n.append(n)
            held += len(keys)
            if held > HELD_PAIRS:
                keys, n = add_up(np.concatenate(held_keys), np.concatenate(held_n))
                if len(keys) > HELD_PAIRS // 2:
                    yield counts([keys], [n])
                    held_keys, held_n, held = [], [], 0
                else:
                    held_keys, held_n, held = [keys], [n], len(keys)
        if held:
            yield counts(held_keys, held_n)

    return step


def answers(batches):
    """A stream of buckets, the counts of each before its postings: for every unit's postings, the documents with the
    links of highest count and the sum of counts. unit is null for counts."""
    now, held, merged = None, [], None
    for batch in batches:
        out_unit, out_blob = [], []
        for unit, bucket, split, blob in zip(*(batch[c].to_pylist() for c in ("unit", "bucket", "split", "payload")), strict=True):
            if (bucket, split) != now:
                now, held, merged = (bucket, split), [], None
            if unit is None:
                held.append(unpack_counts(blob))
                if len(held) > 16:
                    held = [add_up(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))]
                continue
            if merged is None:
                pairs, n = add_up(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))
                ids = pairs >> A_BITS
                first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
                top = np.repeat(np.maximum.reduceat(n, first), np.diff(np.append(first, len(ids))))
                merged, held = (pairs, n, n == top), []
            pairs, n, best = merged
            keys, times = unpack(blob)
            at = np.searchsorted(pairs, keys >> DOC_BITS)
            doc = (keys & U((1 << 16) - 1)).astype(np.int64)
            order = np.argsort(doc, kind="stable")
            doc, at, times = doc[order], at[order], times[order].astype(np.int64)
            first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            out_unit.append(unit)
            out_blob.append(pack_bytes(np.concatenate([doc[first], np.add.reduceat(times * best[at], first), np.add.reduceat(times * n[at], first)])))
        yield pa.RecordBatch.from_arrays([pa.array(out_unit, pa.string()), pa.array(out_blob, pa.binary())], ["unit", "payload"])


def summer(batches):
    """A stream of units: the answers to a unit are added up by document."""

    def close(unit, total):
        docs = sorted(total)
        return pa.RecordBatch.from_arrays([pa.array([unit] * len(docs), pa.string()), pa.array(docs, pa.int32()), pa.array([total[d][0] for d in docs], pa.int64()), pa.array([total[d][1] for d in docs], pa.int64())], ["unit", "doc", "n_best", "count_sum"])

    now, total = None, {}
    for batch in batches:
        for unit, blob in zip(batch["unit"].to_pylist(), batch["payload"].to_pylist(), strict=True):
            if unit != now:
                if total:
                    yield close(now, total)
                now, total = unit, {}
            doc, best, count = unpack_bytes(blob).view(np.int64).reshape(3, -1).tolist()
            for d, x, y in zip(doc, best, count, strict=True):
                had = total.get(d, (0, 0))
                total[d] = (had[0] + x, had[1] + y)
    if total:
        yield close(now, total)


def alignment(docs: DataFrame, a: str = A, b: str = B, buckets: int = BUCKETS, split_bytes: int = SPLIT_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of docs."""
    spark = docs.sparkSession
    root = shared_dir(spark)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made = materialise(d.mapInArrow(aligner(a, b, buckets), MADE), "made", root)
    postings, counts = (made.where(F.col("kind") == kind).select("unit", "bucket", "payload", "size") for kind in ("postings", "counts"))
    splits = postings.groupBy("bucket").agg(F.ceil(F.sum("size") / split_bytes).cast("int").alias("splits"))
    splits = F.broadcast(materialise(splits, "splits", root))  # at most a row for each bucket
    postings = postings.join(splits, "bucket").withColumn("split", F.pmod(F.xxhash64("unit"), F.col("splits")).cast("int"))
    counts = counts.join(splits, "bucket").withColumn("split", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)))
    both = postings.unionByName(counts).select("unit", "bucket", "split", "payload")
    both = both.repartition("bucket", "split").sortWithinPartitions("bucket", "split", F.col("unit").asc_nulls_first())
    found = both.mapInArrow(answers, "unit string, payload binary")
    found = found.repartition("unit").sortWithinPartitions("unit").mapInArrow(summer, "unit string, doc int, n_best long, count_sum long")
    rows_ = made.where(F.col("kind") == "doc").select("unit", "doc", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows_.join(found, ["unit", "doc"], "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def op11_alignment(spark, sf_dir: str) -> DataFrame:
    return alignment(spark.read.parquet(f"{sf_dir}/documents.parquet"))
