import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stackwise.llm.repeats import Suffixes, dealt_blocks, parts_of, radix_order
from stackwise.llm.substring_dedup import subtree, substring_dedup
from stackwise.llm.suffix_dedup import suffix_dedup


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 7))) for _ in range(40)]
    say = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    shared = [say(rng.randint(5, 90)) for _ in range(6)]
    rows = [(1, None), (2, ""), (3, "x"), (4, "ab " * 400), (5, "ab " * 300 + "z")]
    for i in range(6, n):
        parts = [say(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(shared)[: rng.randint(1, 400)], say(rng.randint(0, 30))]
        rows.append((i * rng.choice([1, 7]), rng.choice([" ", "\n", "\t "]).join(parts)))
    rows += [(900 + i, " ".join([say(5)] + [rng.choice(vocab)] * rng.randint(30, 60) + [say(30)] + say(rng.randint(2, 9)).split() * 9 + [say(8)])) for i in range(12)]
    line = shared[0][:45]
    rows += [(10_000 + i, say(12) + " " + line + " " + say(12)) for i in range(40)]
    rows += [(20_000, rows[9][1]), (20_000, rows[9][1]), (None, rows[9][1]), (None, rows[12][1])]
    rng.shuffle(rows)
    return rows


def brute_bytes(rows, size):
    first = {}
    key = lambda d: float("inf") if d is None else d
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - size + 1):
            first[b[i : i + size]] = min(first.get(b[i : i + size], float("inf")), key(d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        m = [False] * len(b)
        for i in range(len(b) - size + 1):
            if first[b[i : i + size]] < key(d):
                m[i : i + size] = [True] * size
        spans = sum(x and not (i and m[i - 1]) for i, x in enumerate(m))
        out.append((d, len(b), sum(m), spans, hashlib.sha256(bytes(x for x, y in zip(b, m) if not y)).hexdigest()))
    return sorted(out, key=str)


def brute_words(rows, size):
    from collections import Counter

    count = Counter()
    for _, t in rows:
        w = (t or "").encode().split()
        count.update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for d, t in rows:
        w = (t or "").encode().split()
        m = [False] * len(w)
        for i in range(len(w) - size + 1):
            if count[tuple(w[i : i + size])] > 1:
                m[i : i + size] = [True] * size
        out.append((d, len(w), sum(m), hashlib.sha256(b" ".join(x for x, y in zip(w, m) if not y)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,block,group", [(1, 3000, 4096), (2, 900, 3), (3, 1 << 20, 8)])
def test_bytes_match_brute_force(spark, seed, block, group):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, block string, kind int")
    got = suffix_dedup(df, threshold=50, block_bytes=block, group=group).drop("spans").collect()
    assert sorted(map(tuple, got), key=str) == brute_bytes(rows, 50)


@pytest.mark.parametrize("seed,block,size,group", [(1, 3000, 35, 4096), (2, 900, 12, 3), (3, 1 << 20, 35, 8)])
def test_words_match_brute_force(spark, seed, block, size, group):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup(df, window=size, block_bytes=block, group=group).drop("kept_text").collect()
    assert sorted(map(tuple, got), key=str) == brute_words(rows, size)


def test_outlying_and_null_ids_do_not_fill_one_block(spark):
    say = " ".join(f"w{i}" for i in range(400))
    rows = [(i, f"{i} {say}") for i in range(300)] + [(2**62, say)] + [(None, f"{say} {i}") for i in range(300)] + [(7, say)] * 200
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    d, blocks = dealt_blocks(df, "doc_id", "text", 20_000)
    sizes = [r["n"] for r in d.groupBy("block").agg(F.sum(F.length("text")).alias("n")).collect()]
    # equal rows of one input partition stand together, and are then cut into parts
    assert len(sizes) > blocks / 2 and max(sizes) < 5 * 20_000
    whole = pa.table({"doc_id": [1] * 50, "text": [say] * 50})
    assert max(sum(len(t) for t in p["text"].to_pylist()) for _, p in parts_of(whole, 10_000)) <= 10_000
    assert sum(p.num_rows for _, p in parts_of(whole, 10_000)) == 50


def test_passes_split_only_groups_and_order_like_bytes():
    rng = np.random.default_rng(5)
    b = rng.choice(np.frombuffer(b"ab", np.uint8), 3000)
    at = np.arange(2900)
    perm, group = radix_order(Suffixes(b), at, np.full(len(at), 50))
    keys = [b[i : i + 50].tobytes() for i in perm]
    assert keys == sorted(keys)
    assert all((group[i] == group[i - 1]) == (keys[i] == keys[i - 1]) for i in range(1, len(keys)))


def test_subtree_depths_are_common_prefixes():
    rng = np.random.default_rng(6)
    numbers = np.append(rng.integers(1, 3, 400).astype(np.uint32), np.uint32(0))
    at = np.arange(400)
    leaves, depth = subtree(Suffixes(numbers), at, 401 - at, at, 0)
    words = [numbers[i:].tolist() for i in leaves]
    assert words == sorted(words)
    common = [next(k for k, (x, y) in enumerate(zip(a, b)) if x != y) for a, b in zip(words, words[1:])]
    assert depth[1:].tolist() == common


def test_a_very_long_text_and_clashing_columns(spark):
    rng = random.Random(4)
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60))
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60_000))
    rows = [(1, passage, 1, "p"), (2, f"{long} {passage} {long[:5000]}", 2, "q"), (3, None, 3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, bucket int, payload string")
    plain = [(d, t) for d, t, *_ in rows]
    assert sorted(map(tuple, suffix_dedup(df).drop("spans").collect()), key=str) == brute_bytes(plain, 50)
    assert sorted(map(tuple, substring_dedup(df).drop("kept_text").collect()), key=str) == brute_words(plain, 35)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup(df).count() == 0
    assert substring_dedup(df).count() == 0
