import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stackwise.llm import spelling
from stackwise.llm.spelling import document_words, near_words, op12_spelling, spelling_variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(docs):
    out = Counter()
    for i, text in docs:
        run = []
        for c in (text or "") + " ":
            if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ":
                run.append(chr(ord(c) + 32))
            elif "a" <= c <= "z" or "À" <= c <= "ÿ":
                run.append(c)
            elif run:
                w = "".join(run)
                h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
                if h % 199 == 0:
                    k = h % len(w)
                    w = w[:k] + w[k + 1 :]
                out[w] += 1
                run = []
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def brute(words):
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    near = {w: [v for k in (len(w) - 1, len(w), len(w) + 1) for v in by_length.get(k, []) if one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = set()
    for w in words:
        r = w
        while form[r]:
            r = form[r]
        out.add((w, form[w], r, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def same(df, want):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(want) and set(rows) == want


def vocabulary(n, letters, seed, longest=9):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.randint(6, longest))) for _ in range(n)}


@pytest.mark.parametrize(("letters", "trie_words"), [("ab", 50_000), ("ab", 4), ("abcÿ", 50_000), ("abcÿ", 7), ("aab", 1)])
def test_near_words_equal_all_pairs(spark, letters, trie_words):
    words = {w: 5 + zlib.crc32(w.encode()) % 40 for w in vocabulary(250, letters, len(letters))}
    got = near_words(spark.createDataFrame(list(words.items()), "word string, n long"), trie_words).collect()
    want = {}
    for w in words:
        near = [v for v in words if one_edit(w, v)]
        if near:
            want[w] = (len(near), min((-words[v], v) for v in near))
    assert {r["word"]: (r["n_near"], tuple(r["best"])) for r in got} == want and len(got) == len(want)


def test_all_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(brute_words(docs))
    assert any(r[1] for r in want)
    same(op12_spelling(spark, sf), want)


def test_edges_and_hot_words(spark):
    rng = random.Random(7)
    base = sorted(vocabulary(60, "abcdeé", 3))
    docs = [(i, " ".join(rng.choice(base) for _ in range(60))) for i in range(80)]
    docs += [(None, None), (None, "COLOUR Colour colour,colour;colour"), (1, ""), (5, "12 _ !"), (6, "×÷×÷×÷ " * 6), (7, "short word x")]
    docs += [(8, "colour " * 400), (9, "colours " * 30), (10, "colors colors colors colors colors colors"), docs[0], docs[0]]
    docs += [(11, "aaaaaa " * 9 + "aaaaaaa " * 50 + "aaaaaaaa " * 6 + "baaaaaa " * 300), (12, "straße strasse " * 5 + "ÉCOLES écoles " * 7)]
    docs += [(100 + i, " ".join(["hotword"] * 50 + ["hotwird"])) for i in range(40)]
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, word string, n int")
    want = brute(brute_words(docs))
    assert any(r[2] != r[1] and r[1] for r in want)
    same(spelling_variants(d, typo_every=199), want)
    same(spelling_variants(d.repartition(7), typo_every=199, trie_words=2), want)
    assert spelling_variants(d.limit(0)).count() == 0


def test_flushed_counts_and_long_text(spark, monkeypatch):
    long = "variant " * 150_000 + "variants " * 6
    assert document_words(1, long, typo_every=0) == {"variant": 150_000, "variants": 6}
    monkeypatch.setattr(spelling, "FLUSH_WORDS", 10)
    words = sorted(vocabulary(100, "abcdef", 9))
    docs = [(i, " ".join(words[i : i + 30])) for i in range(70)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    same(spelling_variants(d, typo_every=199), brute(brute_words(docs)))


def test_root_follows_a_chain(spark):
    docs = [(1, "abcdef " * 5 + "abcdeg " * 25 + "abcdhg " * 125 + "abciihg " * 3 + "abckhg " * 700)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["word"]: (r["form"], r["root"]) for r in spelling_variants(d).collect()}
    assert got == {"abcdef": ("abcdeg", "abckhg"), "abcdeg": ("abcdhg", "abckhg"), "abcdhg": ("abckhg", "abckhg"), "abckhg": (None, "abckhg")}
    assert spelling_variants(d).where(F.col("root").isNull()).count() == 0
