import random
import zlib

import numpy as np
import pyarrow as pa

from stackwise.llm import language_id as li
from stackwise.llm.language_id import Network, answers, identify, op13_language_id, sample_of, windows

WORDS = {"en": ["the", "and", "thing", "which", "house"], "de": ["und", "über", "nicht", "straße", "schön"], "ru": ["это", "что", "дом", "язык", "который"]}


def text(lang, n, rng):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    net = Network(["a", "b", "c"])
    for n in Network.NAMES:
        setattr(net, n, getattr(net, n).astype(np.float64))
    x, y = rng.integers(0, 257, (5, li.WINDOW)), np.array([0, 1, 2, 1, 0])
    _, g = net.gradients(x, y)
    for n in Network.NAMES:
        w = getattr(net, n)
        used = np.argwhere(np.abs(g[n]) > 1e-6)
        for at in used[rng.integers(0, len(used), 5)]:
            at, eps = tuple(at), 1e-6
            keep = w[at]
            w[at] = keep + eps
            up, _ = net.gradients(x, y)
            w[at] = keep - eps
            down, _ = net.gradients(x, y)
            w[at] = keep
            assert abs((up - down) / (2 * eps) - g[n][at]) < 1e-4


def test_windows_cover_every_byte():
    net = Network(["a", "b"])
    for size in (1, 3, li.WINDOW - 1, li.WINDOW, li.WINDOW + 1, li.STRIDE + li.WINDOW, 5000):
        t = "x" * size
        of = max(1, -(-(size - li.WIDEST + 1) // li.STRIDE))
        starts = np.arange(of) * li.STRIDE
        assert starts[-1] < size <= starts[-1] + li.WINDOW
        plain = windows(np.frombuffer(t.encode(), np.uint8), starts, np.full(of, size))
        w = np.minimum(li.WINDOW, size - starts)
        z = (net.logits(plain) * w[:, None]).sum(axis=0) / w.sum()
        p = np.exp(z - z.max())
        got = answers(net, pa.array([None, "q", t, "12"]))
        assert abs(got[1][2] - (p / p.sum()).max()) < 1e-5 and got[0][0] == got[0][3] == "und"


def test_held_out_and_edges(spark):
    rng = random.Random(5)
    docs = [(i, text(lang, rng.randint(3, 60), rng), lang) for i in range(300) for lang in [rng.choice(list(WORDS))]]
    odd = [(None, text("de", 30, rng), None), (None, text("ru", 9, rng), "ru"), (1000, None, "en"), (1001, "", "en"), (1002, "12 -- 34 ...", "de"), (1003, text("ru", 60_000, rng), "ru"), (1004, text("en", 20, rng), None)]
    hot = [(2000, "the same thing and the house", "en")] * 200
    d = spark.createDataFrame([(*r, "x", 0.0) for r in docs + odd + hot], "doc_id long, text string, lang string, held_out string, score double")
    got = identify(d, sample=240).collect()
    assert len(got) == len(docs) + len(odd) + len(hot)
    truth = {i: lang for i, _, lang in docs}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 30 and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    by_id = {r["doc_id"]: r for r in got}
    assert [by_id[i]["lang_pred"] for i in (1000, 1001, 1002, 1003, 1004)] == ["und"] * 3 + ["ru", "en"]
    assert by_id[1000]["score"] == 0 and all(0 <= r["score"] <= 1 for r in got)
    assert sorted(r["lang_pred"] for r in got if r["doc_id"] is None) == ["de", "ru"]
    assert len({(r["lang_pred"], r["score"]) for r in got if r["doc_id"] == 2000}) == 1
    chosen = sample_of(d.select("doc_id", "text", "lang"), 40).collect()
    assert len(chosen) == 40 and sum(r["doc_id"] == 2000 for r in chosen) <= 1
    assert not any(r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in chosen)
    assert min(sum(r["lang"] == k for r in chosen) for k in WORDS) >= 12


def test_no_labels(spark):
    d = spark.createDataFrame([(1, "some text", None), (2, None, None)], "doc_id long, text string, lang string")
    assert [(r["lang_pred"], r["score"]) for r in identify(d).collect()] == [("und", 0.0)] * 2
    assert identify(d.limit(0)).count() == 0


def test_documents(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op13_language_id(spark, sf).where("held_out and lang_pred <> 'und'").collect()
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in got) / len(got) > 0.97
