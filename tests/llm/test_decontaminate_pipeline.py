import random

import pytest

import corpus_pipeline
from stackwise.llm.decontaminate import confirmed, decontaminate, lcs


def test_lcs():
    import numpy as np

    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(1, 30))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert lcs(a, np.array(b)) == t[-1][-1]


def test_finds_copies_and_paraphrases(spark):
    rng = random.Random(9)
    vocab = [f"term{i}" for i in range(4000)] + ["the", "of"] * 600
    say = lambda k: [rng.choice(vocab) for _ in range(k)]
    items = [say(rng.randint(15, 150)) for _ in range(30)]
    docs, truth = [(9001, None), (9002, ""), (None, "the of")], {}
    for i in range(400):
        w = say(rng.randint(0, 300))
        if i % 4 == 0:
            k = rng.randrange(30)
            p = list(items[k])
            if i % 8 == 0:
                for _ in range(len(p) // 6):
                    p[rng.randrange(len(p))] = "other"
            at = rng.randint(0, len(w))
            w[at:at] = p
            truth[i] = k
        docs.append((i, " ".join(w).replace("term1 ", "Term1, ")))
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, lcs int")
    b = spark.createDataFrame([*[(k, " ".join(w)) for k, w in enumerate(items)], (99, None), (98, " - ")], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate(d, b).collect()}
    assert len(got) == len(docs)
    assert {i for i, r in got.items() if r["contaminated"]} == set(truth)
    assert all(truth[i] in got[i]["item_ids"] for i in truth)
    assert decontaminate(d, b.limit(0)).where("contaminated").count() == 0
    assert decontaminate(d.limit(0), b).count() == 0


def test_finds_every_copy_of_a_large_benchmark(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(3000)] + ["the", "of"] * 300
    say = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    items = [say(rng.randint(20, 60)) for _ in range(1100)]
    docs = [f"{say(40)} {x} {say(40)}" for x in items]
    d = spark.createDataFrame([*enumerate(docs), (5000, say(200))], "doc_id long, text string")
    b = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    got = {r["doc_id"]: r["item_ids"] for r in decontaminate(d, b).collect()}
    missed = [i for i in range(1100) if i not in got[i]]
    assert not missed, f"{len(missed)} of 1100 missed"
    assert not got[5000]


@pytest.mark.parametrize("size", [1, 4, 8, 16, 18, 20, 40])
def test_finds_short_widespread_and_reworded_items(spark, size):
    rng = random.Random(size)
    vocab = [f"w{i}" for i in range(3000)] + ["the", "of", "and", "in"] * 500
    say = lambda k: [rng.choice(vocab) for _ in range(k)]
    # the first item stands in a third of all documents, the others in few
    items = [[f"x{k}y", *say(size - 1)] for k in range(20)]
    docs, truth = [], {}
    for i in range(600):
        w = [f"rare{rng.randrange(10**9)}" if rng.random() < 0.2 else x for x in say(rng.randint(40, 200))]
        if i % 3 == 0 or i % 3 == 1 and i % 2:
            k = 0 if i % 3 == 0 else rng.randrange(1, 20)
            p = list(items[k])
            if k:
                for j in rng.sample(range(size), int(0.3 * size)):
                    p[j] = f"new{rng.randrange(10**9)}"
            at = rng.randint(0, len(w))
            w[at:at] = p
            truth[i] = k
        docs.append((i, " ".join(w)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {r["doc_id"]: r["item_ids"] for r in decontaminate(d, b).collect()}
    missed = [i for i in truth if truth[i] not in got[i]]
    assert not missed, f"{len(missed)} of {len(truth)} missed"
    if size >= 16:
        assert {i for i in got if got[i]} == set(truth)


def test_answer_rule_needs_weight():
    import numpy as np

    item, region = list(range(20)), np.array([*range(6), *range(15, 20)])
    assert confirmed(item, region, 0.4) == (True, 0.55) and confirmed(item, region, 0.1) == (False, 0.55)
    assert confirmed(item, np.arange(14), 0.1) == (True, 0.7)


def test_long_texts_ties_and_clashing_columns(spark):
    rng = random.Random(2)
    item = [f"i{k}" for k in range(30)]
    long = [f"w{rng.randrange(5000)}" for _ in range(60_000)]
    docs = [(1, " ".join(long[:40_000] + item + long[40_000:])), (2, " ".join(long)), (None, " ".join(item)), (5, "x"), (5, " ".join(item)), (5, " ".join(item))]
    d = spark.createDataFrame([(*r, 1, "w") for r in docs], "doc_id long, text string, item_id int, hit string")
    b = spark.createDataFrame([(7, " ".join(item), 1), (7, " ".join(item), 2), (8, " ".join(item), 3)], "item_id long, text string, doc_id long")
    got = sorted(((r["doc_id"], r["contaminated"], r["item_ids"]) for r in decontaminate(d, b).collect()), key=str)
    assert got == sorted([(1, True, [7, 8]), (2, False, []), (None, True, [7, 8])] + [(5, True, [7, 8])] * 3, key=str)


def test_only_an_items_end_is_its_answer():
    import numpy as np

    item, region = list(range(20)), np.array([*range(6), *range(15, 20)])
    assert confirmed(item, region, 0.4, False) == (False, 0.55)


def test_benchmark_in_several_passes(spark, monkeypatch):
    from stackwise.llm import decontaminate as module

    monkeypatch.setattr(module, "MODELS", 1)
    items = [" ".join(f"t{k}w{i}" for i in range(20)) for k in range(600)]
    d = spark.createDataFrame([(k, f"a b {x} c d") for k, x in enumerate(items)], "doc_id long, text string")
    b = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    assert all(r["item_ids"] == [r["doc_id"]] for r in module.decontaminate(d, b).collect())


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == columns and after.count() <= docs.count()
        docs = after
    rows = corpus_pipeline.run(spark, sf_dir)
    assert rows.columns == ["doc_id", "size", "source_size", "target", "taken", "text", "lang", "source"]
    assert sorted(map(str, rows.select("doc_id", "text").collect())) == sorted(map(str, docs.select("doc_id", "text").collect()))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_stages_judge_rows_not_ids(spark, sf_dir):
    """Repeated and null ids, and columns with the operators' own names."""
    say = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    leak = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()["text"]
    rows = [(5, say("a", 50))] * 3 + [(5, say("b", 50)), (None, say("a", 50)), (None, say("c", 50)), (None, f"{say('d', 30)} {leak}"), (6, None), (6, ""), (7, f"{say('e', 30)} {leak}"), (7, say("f", 50))]
    docs = spark.createDataFrame([(d, t, "en", "s", 0, 1, "x") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, kept int, item_ids string")
    stages = dict(corpus_pipeline.STAGES)
    near = stages["near_duplicates"](spark, docs, sf_dir)
    assert near.columns == docs.columns
    texts = sorted(str(r["text"]) for r in near.collect())
    assert texts == sorted(map(str, {t for _, t in rows}))
    clean = sorted(str((r["doc_id"], r["text"])) for r in stages["decontamination"](spark, docs, sf_dir).collect())
    assert clean == sorted(str((d, t)) for d, t in rows if not t or leak not in t)
    assert sorted(map(str, stages["toxicity"](spark, docs, sf_dir).collect())) == sorted(map(str, docs.collect()))
    mixed = stages["mixing"](spark, docs, sf_dir)
    assert sorted(str((r["doc_id"], r["text"])) for r in mixed.collect()) == sorted(str(r) for r in rows)


def reworded(rng, n_items=120, n_docs=360, kept=0.62):
    """Items, and documents of which every second holds an item with some of its words replaced, but for its last ones:
    too few in order for the lexical lane."""
    vocab = [f"term{i}" for i in range(3000)] + ["the", "of", "and"] * 400
    say = lambda k: [rng.choice(vocab) for _ in range(k)]
    items = [say(rng.randint(24, 60)) for _ in range(n_items)]
    docs, truth = [], {}
    for i in range(n_docs):
        w = say(rng.randint(40, 250))
        if i % 2:
            k = rng.randrange(n_items)
            p = list(items[k])
            for j in rng.sample(range(len(p) - 5), round((1 - kept) * len(p))):
                p[j] = f"new{rng.randrange(10**9)}"
            at = rng.randint(0, len(w))
            w[at:at] = p
            truth[i] = k
        docs.append((i, " ".join(w)))
    return items, docs, truth


def test_paraphrases_come_by_the_latent_space(spark, monkeypatch):
    """Recall of items that keep 62 % of their words; without the space, none of them is found."""
    import numpy as np

    from stackwise.llm import decontaminate as module

    items, docs, truth = reworded(random.Random(21))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    ranks, real = [], module.latent_space
    monkeypatch.setattr(module, "latent_space", lambda *a: (lambda r: (ranks.append(r[1].shape[1]), r)[1])(real(*a)))
    hits = module.leaks(d, b).collect()
    found = {(r["doc_id"], r["item_id"]) for r in hits}
    assert ranks and max(ranks) < len(items)
    assert sum((i, k) in found for i, k in truth.items()) >= 0.9 * len(truth)
    assert {r["doc_id"] for r in hits} <= set(truth) and sum(r["lane"] == "latent" for r in hits) >= 0.9 * len(hits)
    monkeypatch.setattr(module, "latent_space", lambda *a: (lambda r: (r[0], np.zeros_like(r[1])))(real(*a)))
    assert module.leaks(d, b).count() <= 0.1 * len(truth)


def test_lexical_lane_finds_all_that_the_space_drops(spark, monkeypatch):
    import numpy as np

    from stackwise.llm import decontaminate as module

    items, docs, truth = reworded(random.Random(22), kept=0.75)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    both = {(r["doc_id"], r["item_id"]): r["lane"] for r in module.leaks(d, b).collect()}
    real = module.latent_space
    monkeypatch.setattr(module, "latent_space", lambda *a: (lambda r: (r[0], np.zeros_like(r[1])))(real(*a)))
    alone = {(r["doc_id"], r["item_id"]): r["lane"] for r in module.leaks(d, b).collect()}
    assert set(alone) == set(both) == set(truth.items()) and set(alone.values()) == {"lexical"} and "latent" in both.values()


def test_space_is_the_blocks_main_directions(spark):
    """The distributed SVD's space holds as much of the passages' weight as the exact one."""
    import numpy as np

    from stackwise.llm import decontaminate as module

    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(900)] + ["the", "of"] * 200
    say = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    b = spark.createDataFrame([(k, say(40)) for k in range(200)], "item_id long, text string")
    idf = np.ones(1 << module.BITS, np.float32)
    block = list(module.passages(b))
    none = spark.createDataFrame([], "words array<long>")
    feats, v = module.latent_space(spark, block, idf, none)
    assert v.shape[1] == module.RANK < len(block) and np.abs(v.T @ v - np.eye(module.RANK)).max() < 1e-3
    a = np.zeros((len(block), len(feats)))
    for k, (_, _, h) in enumerate(block):
        at, n = np.unique(np.searchsorted(feats, module.places(h)), return_counts=True)
        a[k, at] = n / np.sqrt((n * n).sum())
    s = np.linalg.svd(a, compute_uv=False)
    assert ((a @ v) ** 2).sum() >= 0.97 * (s[: module.RANK] ** 2).sum()


def test_space_is_fitted_on_every_passage(spark, monkeypatch):
    """Words that stand together at the ends of documents, not in their middles: the space holds as much of the weight of
    the benchmark and all passages as the exact one."""
    import numpy as np

    from stackwise.llm import decontaminate as module

    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(400)]
    items = [rng.sample(vocab, 24) for _ in range(40)]
    docs = []
    for i in range(300):
        topic = vocab[i % 10 * 40 : i % 10 * 40 + 40]
        docs.append((i, " ".join([*rng.sample(topic, 30), *(f"x{rng.randrange(10**6)}" for _ in range(162)), *rng.sample(topic, 30)])))
    docs.append((None, None))
    seen, real = [], module.latent_space
    monkeypatch.setattr(module, "CORPUS", 0.95)
    monkeypatch.setattr(module, "latent_space", lambda *a: (lambda r: (seen.append((a[1], a[2], *r)), r)[1])(real(*a)))
    b = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    module.leaks(spark.createDataFrame(docs, "doc_id long, text string"), b)
    [(block, idf, feats, v)] = seen

    light = module.needs(block, idf, feats)[2]

    def row(p, root):
        at, n = np.unique(p, return_counts=True)
        w = (np.sqrt(n) if root else n) * idf[at]
        inside = np.isin(at, feats[~light] if root else feats)
        out = np.zeros(len(feats))
        out[np.searchsorted(feats, at[inside])] = (w / np.sqrt((w * w).sum()))[inside]
        return out

    import pyarrow as pa

    own = [row(module.places(h), False) for _, _, h in block]
    words = [module.places(module.terms(pa.array([t]))[0]) for _, t in docs[:-1]]
    rest = np.array([row(p[i : i + 64], True) for p in words for i in range(0, len(p), 64)])
    a = np.concatenate([own, rest * np.sqrt(19 * len(own) / (rest**2).sum())])
    s = np.linalg.svd(a, compute_uv=False)
    assert ((a @ v) ** 2).sum() >= 0.95 * (s[: v.shape[1]] ** 2).sum()


def test_pipeline_fits_its_space_on_every_word(spark, sf_dir, monkeypatch):
    import pyarrow as pa

    from stackwise.llm import decontaminate as module

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    corpora, real = [], module.latent_space
    monkeypatch.setattr(module, "latent_space", lambda *a: (corpora.append(a[3]), real(*a))[1])
    dict(corpus_pipeline.STAGES)["decontamination"](spark, docs, sf_dir)
    words = sum(len(h) for _, h, _ in module.hashed_rows(b for c in corpora[:1] for b in c.toArrow().to_batches()))
    assert words == sum(len(module.terms(pa.array([r["text"]], pa.string()))[0]) for r in docs.select("text").collect()) > 0


def test_stages_clear_what_nothing_reads(spark, sf_dir, tmp_path, monkeypatch):
    """Sketches, buckets and links are gone when the verdicts are written, and tables between stages with the next one."""
    import uuid

    from stackwise.llm import common

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    monkeypatch.setattr(common, "shared_folder", lambda spark: f"{tmp_path}/{uuid.uuid4().hex}")
    for name, stage in corpus_pipeline.STAGES[:2]:
        stage(spark, docs, sf_dir).collect()
        left = {p.name for p in tmp_path.glob("*/*")}
        assert left == {"toxicity": set(), "near_duplicates": {"rows", "copies"}}[name]
    mixed = corpus_pipeline.run(spark, sf_dir)
    assert not [p for p in tmp_path.glob("*/*") if p.name in dict(corpus_pipeline.STAGES)]
    assert mixed.count() > 0


def test_rows_with_ids_of_their_own_are_not_copied(spark, sf_dir, tmp_path, monkeypatch):
    """Only where ids are null or repeated are rows numbered and written; the mix reads its rows in place, with equal results."""
    import uuid

    from stackwise.llm import common
    from stackwise.llm.mixing import mix_sources

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    monkeypatch.setattr(common, "shared_folder", lambda spark: f"{tmp_path}/{uuid.uuid4().hex}")
    stages = dict(corpus_pipeline.STAGES)
    for name, d, n in (("near_duplicates", docs, 0), ("decontamination", docs, 0), ("decontamination", docs.unionByName(docs.limit(1)), docs.count() + 1)):
        known = set(tmp_path.glob("*/rows"))
        stages[name](spark, d, sf_dir)
        [rows] = set(tmp_path.glob("*/rows")) - known
        assert spark.read.parquet(str(rows)).count() == n
    mixed = stages["mixing"](spark, docs, sf_dir)
    [sizes] = tmp_path.glob("*/sizes")
    assert "text" not in spark.read.parquet(str(sizes)).schema["kept"].dataType.names
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mix_sources(docs, keep=corpus_pipeline.KEPT).collect()))


def test_windows_are_bounded_by_items_of_their_length(monkeypatch):
    """A word of a short item again and again: within a short window it is too little, and a long item has none of it."""
    import numpy as np
    import pyarrow as pa

    from stackwise.llm import decontaminate as module

    words = lambda t: module.terms(pa.array([t]))[0]
    say = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    block = [(1, True, words(say("s", 10))), (2, True, words(say("l", 400)))]
    idf = np.ones(1 << module.BITS, np.float32)
    feats = np.unique(np.concatenate([module.places(h) for _, _, h in block]))
    search, _ = module.model_of(block, idf, feats, np.zeros((len(feats), 1), np.float32))
    sizes, real = [], np.nonzero
    monkeypatch.setattr(np, "nonzero", lambda a: (sizes.append(a.size * (a.ndim == 2)), real(a))[1])
    h = words(" ".join(f"s{i // 100 % 10}" if i % 100 == 0 else f"x{i}" for i in range(20_000)))
    assert search(h, np.array([0, len(h)])) == [] and sum(sizes) == 0
    h = np.concatenate([h, block[0][2], h])
    assert [(i, share) for _, i, share, _ in search(h, np.array([0, len(h)]))] == [(1, 1.0)] and 0 < sum(sizes) < 100
