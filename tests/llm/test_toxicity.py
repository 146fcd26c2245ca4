import random
import zlib

from stackwise.llm.toxicity import fitted_rows, toxicity, without_toxic

BAD = ["vile", "nasty", "rotten"]


def rows(n, seed=3):
    rng = random.Random(seed)
    vocab = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randint(5, 60))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            for b in rng.sample(BAD, 2):
                w.insert(rng.randrange(len(w)), b.upper() if rng.random() < 0.5 else b + ".")
        docs.append((i, " ".join(w), "x"))
        labels.append((i, 1, toxic))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = rows(800)
    docs += [(None, None, None), (5000, "", "x"), (5001, "clean words only", None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    lab = spark.createDataFrame([*labels, (0, None, None), labels[1], (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity(d, lab).collect()
    assert len(got) == len(docs)
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r["held_out"]]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == r["held_out"] for r in got if r["doc_id"] is not None)
    assert sum(r["predicted"] == truth.get(r["doc_id"], 0) for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    assert sorted(map(str, got)) == sorted(map(str, toxicity(d, lab).collect()))


def test_no_model(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    lab = spark.createDataFrame([], "doc_id long, toxic int")
    assert [(r["score"], r["predicted"]) for r in toxicity(d, lab).collect()] == [(0.0, 0)] * 2


def test_each_row_is_kept_by_its_own_score(spark):
    docs, labels = rows(400)
    long = "word1 " * 50_000
    docs += [(None, "vile nasty rotten", "x"), (9000, long, "x"), (9000, "nasty vile vile rotten", "x"), (9000, long, "x")]
    d = spark.createDataFrame([(*r, 1.0) for r in docs], "doc_id long, text string, row string, score double")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    stay = without_toxic(d, lab)
    assert stay.columns == d.columns
    kept = [(r["doc_id"], r["text"]) for r in stay.collect()]
    assert kept.count((9000, long)) == 2 and (9000, "nasty vile vile rotten") not in kept and (None, "vile nasty rotten") not in kept
    scores = toxicity(d, lab).where("predicted = 0").count()
    assert len(kept) == scores
    assert without_toxic(d.limit(0), lab).count() == 0


def test_a_labelled_id_on_a_third_of_all_rows_is_fitted_once(spark):
    docs, labels = rows(300)
    hot = [(1, f"vile {i % 3}", "x") for i in range(3000)]
    d = spark.createDataFrame(docs + hot, "doc_id long, text string, source string").repartition(5)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    fitted = fitted_rows(d, lab, 100)
    assert fitted.count() == 100 and fitted.select("doc_id").distinct().count() == 100
    whole = fitted_rows(d, lab).collect()
    assert sum(r["doc_id"] == 1 for r in whole) == 1
    assert sorted(map(str, whole)) == sorted(map(str, fitted_rows(d.repartition(3), lab).collect()))


def test_every_labelled_document_is_fitted(spark):
    d = spark.range(17_000).selectExpr("id AS doc_id", "concat('word', id % 50, IF(id % 7 = 0, ' vile', ' fine')) AS text")
    lab = d.selectExpr("doc_id", "IF(doc_id % 7 = 0, 1, 0) AS toxic")
    fitted = fitted_rows(d, lab)
    assert fitted.count() == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(17_000)) > 12_000


def test_parts_make_one_model(spark, monkeypatch):
    """Parts of about 100 documents, whatever their order and partitions; labels of ids that no row has make no parts."""
    from stackwise.llm import toxicity as module

    docs, labels = rows(1200)
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    lab = spark.createDataFrame([*labels, *((i, 1, i % 2) for i in range(50_000, 52_000))], "doc_id long, quality int, toxic int")
    n = fitted_rows(d, lab).count()
    assert n == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(1200))
    monkeypatch.setattr(module, "PART", 100)
    seen, real = [], module.materialise
    monkeypatch.setattr(module, "materialise", lambda df, name, root: (lambda r: (seen.extend(x["documents"] for x in r.collect() if name == "parts"), r)[1])(real(df, name, root)))
    got = toxicity(d, lab).collect()
    assert len(seen) == n // 100 and sum(seen) == n and min(seen) >= 50
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.9
    assert sorted(map(str, got)) == sorted(map(str, toxicity(d.repartition(3), lab.repartition(5)).collect()))
