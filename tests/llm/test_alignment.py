import hashlib
import random
from collections import Counter

import pytest

from stackwise.llm import alignment as al

EDGES = [None, "", " ", "plain words", "  two  spaces\nand\tlines ", "é中𝄞 ▁ under", "<|endoftext|> <s> <0x41> </s>", " x", "ÀÿŸ naïve façade", "\x00\x01ctl", "‮rtl אבג", "a" * 3000]


def brute(texts):
    """Occurrence by occurrence, from the libraries' own tables."""
    import sentencepiece
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path(al.A))
    t.encode_special_tokens = True
    p = sentencepiece.SentencePieceProcessor(model_file=path(al.B))
    bs = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    symbol, k = {chr(b): b for b in bs}, 0
    for b in range(256):
        if b not in bs:
            symbol[chr(256 + k)] = b
            k += 1
    docs, count = [], Counter()
    for text in texts:
        a = b = []
        if text:
            a = [(i, bytes(symbol[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
            b = []
            for i in p.encode(text):
                piece = p.id_to_piece(i)
                b.append((i, bytes([int(piece[3:5], 16)]) if p.is_byte(i) else piece.replace("▁", " ").encode()))
            want = (" " + text).encode()
            if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
                a = b = []

        def spans(toks):
            out, at = [], 0
            for i, x in toks:
                out.append((i, at, at + len(x)))
                at += len(x)
            return out

        a, b = spans(a), spans(b)
        links, j = [], 0
        for i, s, e in a:
            while j and b[j][1] > s:
                j -= 1
            while j < len(b) and b[j][2] <= s:
                j += 1
            x = j
            while x < len(b) and b[x][1] < e:
                links.append((i, b[x][0]))
                x += 1
        both = sorted({e for _, _, e in a} & {e for _, _, e in b})
        shown, lo = [], 0
        ia = ib = 0
        for hi in both:
            ga, gb = [], []
            while ia < len(a) and a[ia][2] <= hi:
                ga.append(str(a[ia][0]))
                ia += 1
            while ib < len(b) and b[ib][2] <= hi:
                gb.append(str(b[ib][0]))
                ib += 1
            shown.append(",".join(ga) + "|" + ",".join(gb))
            lo = hi
        docs.append((len(a), len(b), len(both), links, hashlib.sha256(";".join(shown).encode()).hexdigest() if a else ""))
        count.update(links)
    top = {}
    for (_, b), n in count.items():
        top[b] = max(top.get(b, 0), n)
    return [(na, nb, ng, len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links), h) for na, nb, ng, links, h in docs]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("how", [{}, {"buckets": 3, "split_bytes": 4000}])
def test_edges_and_copies_equal_brute_force(spark, how):
    rng = random.Random(2)
    words = ["the", "alignment", "Größe", "naïve", "日本語", "x", "(a+b)", "don't", "1234567", "—", "\n"]
    texts = EDGES + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 80))) for _ in range(120)] + ["the same text"] * 60
    rows = [(None if i % 7 == 0 else i // 2, t, "extra", 1) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string, unit string, n_a int").repartition(5)
    got = al.alignment(d, **how)
    assert got.columns == ["doc_id", *COLUMNS]
    want = sorted(((r[0] is None, r[0] or 0), *b) for r, b in zip(rows, brute(texts), strict=True))
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), *(r[c] for c in COLUMNS)) for r in got.collect()) == want
    assert al.alignment(d.limit(0)).count() == 0


def test_held_counts_are_flushed(spark, monkeypatch):
    a, b = al.side(al.A), al.side(al.B)
    texts = [f"some words number {i} of the text" for i in range(200)]
    whole = al.Aligned(*al.tokens(texts, a, b), a, b)
    assert whole.n_links.sum() == whole.n_a.sum() + whole.n_b.sum() - whole.n_groups.sum()
    monkeypatch.setattr(al, "HELD_PAIRS", 20)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(200)), "text": texts})
    made = [r for out in al.aligner(al.A, al.B, 4)([batch.slice(i, 50) for i in range(0, 200, 50)]) for r in out.to_pylist()]
    assert sum(al.unpack_counts(r["payload"])[1].sum() for r in made if r["kind"] == "counts") == whole.n_links.sum()
    assert sum(r["kind"] == "counts" for r in made) > 4


def test_all_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = {(i, *b) for (i, _), b in zip(docs, brute([t for _, t in docs]), strict=True)}
    got = [tuple(r) for r in al.op11_alignment(spark, sf).collect()]
    assert len(got) == len(docs) and set(got) == want


def test_fast_encoder_gives_the_librarys_ids():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path(al.A))
    t.encode_special_tokens = True
    rng = random.Random(6)
    odd = ["\u00a0", "\u2003", "\u3000", "\u0085", "\u200b", "\u1680", "'s", "'LL", "\u0345", "\u0130", "\u01c5", "\u0663", "\u00b2", "\u2167", "\U0001f1e9", "\u0301", "\r\n", "\x1c", "_", "<|endoftext|>", "a", "Z", " ", "9", "\ufeff", "\ufffd", "\U000e0001", "\u07fd"]
    texts = [e for e in EDGES if e] + ["".join(rng.choice(odd) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    assert al.side(al.A).encode(texts) == [t.encode(" " + x, add_special_tokens=False).ids for x in texts]
