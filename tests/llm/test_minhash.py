import random
import re

import pytest

from stackwise.llm.graph import components
from stackwise.llm.minhash import likely, near_duplicates


def sets_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def brute(rows, percent):
    s = [(d, sets_of(t)) for d, t in rows]
    up = {d: d for d, _ in s}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(s):
        for b, y in s[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((root(a), root(b)))
                up[q] = p
    return sorted((d, len(x), root(d), root(d) == d) for d, x in s)


@pytest.mark.parametrize("percent", [80, 85])
def test_components_match_brute_force(spark, percent):
    rng = random.Random(percent)
    vocab = [f"w{i}é" for i in range(3000)]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one Two"), (5, "ONE two"), (6, "one two three four five")]
    for g in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randint(30, 200))]
        for _ in range(rng.randint(1, 12)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((rng.randint(100, 10**9), " ".join(w)))
    chain = [rng.choice(vocab) for _ in range(150)]
    for i in range(12):
        chain = [*chain[3:], *[rng.choice(vocab) for _ in range(3)]]
        rows.append((50 + i, "\t".join(chain).upper() if i % 2 else " ".join(chain)))
    rng.shuffle(rows)
    df = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, bands string")
    got = near_duplicates(df, percent=percent).collect()
    lower_rows = [(d, t) for d, t in rows]
    assert sorted(map(tuple, got)) == brute(lower_rows, percent)


@pytest.mark.parametrize("rounds", [1, 3])
def test_a_cluster_around_the_threshold(spark, rounds):
    """One large group whose members are linked through others, in a bucket with members that are not linked at all."""
    rng = random.Random(11)
    vocab = [f"v{i}" for i in range(4000)]
    base = [rng.choice(vocab) for _ in range(100)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(1, 5)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near_duplicates(df, 80, rounds=rounds).collect())) == brute(rows, 80)


def test_repeated_and_null_ids_and_a_long_text(spark):
    say = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    rows = [(5, say("a", 40)), (5, say("a", 40)), (5, say("b", 40)), (3, say("b", 40)), (9, say("a", 40) + " end"), (None, say("a", 40)), (None, None), (7, say("c", 60_000)), (8, say("c", 60_000) + " x")]
    got = near_duplicates(spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, comp int, digest string")).collect()
    assert sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in got), key=str) == sorted([(5, 3, False)] * 3 + [(3, 3, True), (9, 3, False), (None, None, True), (None, None, True), (7, 7, True), (8, 7, False)], key=str)


def test_recall_at_the_threshold(spark):
    """Links found among the 1,000 documents of sf0.01 are those of a program that compares all of them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = sorted(map(tuple, near_duplicates(docs, 80).collect()))
    assert got == brute([tuple(r) for r in docs.collect()], 80)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    got = {r["id"]: r["comp"] for r in components(e).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}


def test_joins_move_the_texts_of_their_ids_only(spark):
    """A bitmap keeps every text that is asked for, and hardly another."""
    rng = random.Random(4)
    ids = [rng.randrange(-(2**63), 2**63) for _ in range(20_000)] + [0, -1, 2**63 - 1, -(2**63)]
    texts = spark.createDataFrame([(i, str(i)) for i in ids], "tid long, text string")
    asked = ids[::10] + ids[-4:]
    got = {r["tid"] for r in likely(texts, spark.createDataFrame([(i,) for i in asked], "id long")).collect()}
    assert set(asked) <= got and len(got) <= len(set(asked)) + 20
    assert likely(texts, spark.createDataFrame([], "id long")).count() == 0


def test_members_of_a_small_bucket_go_to_one_unit(spark):
    from stackwise.llm import minhash

    here = spark.createDataFrame([(1, r, 1 if r < 4 else r) for r in range(1, 11)] + [(2, r, 20 if r < 250 else r) for r in range(20, 290)], "key long, rep long, comp long")
    units = minhash.units_of(here).collect()
    assert sorted(u["rep"] for u in units if u["key"] == 1) == [*range(1, 11)]
    pairs = {}
    for u in (u for u in units if u["key"] == 2):
        pairs.setdefault((u["u"], u["v"]), []).append((u["rep"], u["comp"], u["chunk"]))
    met = {frozenset((a[0], b[0])) for (x, y), own in pairs.items() for a in own for b in own if a[2] == x and b[2] == y}
    assert {frozenset((a, b)) for a in range(20, 290) for b in range(250, 290) if a != b} <= met
