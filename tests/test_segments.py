import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stackwise.operators import search, segments
from stackwise.operators.segments import Maintained

WORDS = ["river", "stone", "grün", "house", "2", "the", "night", "black", "storm", "黑客", "ocean", "forest"]
NIGHT = int(datetime(2024, 3, 1, 3, 30, tzinfo=segments.WINDOW_ZONE).timestamp())
DAY = int(datetime(2024, 3, 1, 12, 0, tzinfo=segments.WINDOW_ZONE).timestamp())


def corpus(spark, rows):
    return spark.createDataFrame([(i, t, o, 1.0) for i, (t, o) in sorted(rows.items())], "doc_id long, title string, overview string, boost double")


def text(rng):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 4))), " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 12)))


def rounded(df, only=None):
    rows = df if only is None else df.where(F.col("doc_id").isin(*only))
    return sorted((r["doc_id"], r["field"], r["term"], r["kind"], round(r["weight"], 9)) for r in search.weights(rows).collect())


def tables(index):
    names = sorted(map(str, index.table("names").select("name", "kind", "doc_id", "key", "boost").collect()))
    return names, sorted(map(tuple, index.table("vocabulary").select("term", "kind", "df").collect())), index.n_docs, round(index.avgdl, 9)


@pytest.fixture
def start(spark, tmp_path):
    rng = random.Random(11)
    rows = {i: text(rng) for i in range(40)}
    return rng, rows, Maintained.create(spark, str(tmp_path / "m"), corpus(spark, rows), buckets=4), tmp_path


def test_batches_equal_a_rebuild(spark, start):
    rng, rows, m, tmp = start
    last = []
    for k in range(3):
        changed = rng.sample(sorted(rows), 5)
        for i in changed[:3]:
            rows[i] = text(rng)
        for i in changed[3:]:
            del rows[i]
        rows[100 + k] = text(rng)
        m.enqueue(spark.createDataFrame([(i,) for i in [*changed, 100 + k, changed[0], None]], "doc_id long"), DAY + k)
        assert m.drain(corpus(spark, rows), DAY + k) == 6
        last = [i for i in [*changed, 100 + k] if i in rows]
    whole = search.build_index(corpus(spark, rows), str(tmp / "whole"), buckets=4)
    index = m.open()
    assert tables(index) == tables(whole)
    assert rounded(index.table("terms"), last) == rounded(whole.table("terms"), last)
    assert {r["doc_id"] for r in index.table("terms").select("doc_id").distinct().collect()} == {i for i, (t, o) in rows.items() if t}
    assert len(index.segments) == 4 and m.drain(corpus(spark, rows), DAY) == 0
    # compaction changes no row
    before = rounded(index.table("terms")), tables(index)
    m.compact()
    assert (rounded(m.open().table("terms")), tables(m.open())) == before and len(m.open().segments) == 1
    m.vacuum()
    assert len(list((tmp / "m" / "segments").iterdir())) == 1 and m.pending().count() == 0
    # a week later, by night: all documents come to the present weights, and search finds what it finds in the rebuild
    m.drain(corpus(spark, rows), NIGHT)
    assert m.drain(corpus(spark, rows), NIGHT + 8 * 86_400 + 3 * 3600) == 0  # not at half past six
    turns = 0
    while n := m.drain(corpus(spark, rows), NIGHT + 8 * 86_400, limit=25):
        turns += n
    assert turns == len(rows) and m.manifests.latest()[1]["reweight_after"] is None
    assert rounded(m.open().table("terms")) == rounded(whole.table("terms"))
    for ask in ("black river", "grun house 2", "黑客", "fores"):
        assert search.search(m.open(), ask).collect() == search.search(whole, ask).collect()


def test_pending_goes_before_reweighting_and_oldest_first(spark, start):
    rng, rows, m, _ = start
    docs = corpus(spark, rows)
    m.drain(docs, NIGHT)
    week = NIGHT + 7 * 86_400
    m.enqueue(spark.createDataFrame([(i,) for i in range(12)], "doc_id long"), week - 5)
    m.enqueue(spark.createDataFrame([(30,)], "doc_id long"), week - 9)
    assert m.drain(docs, week) == 10
    assert sorted(r["doc_id"] for r in m.pending().collect()) == [9, 10, 11]  # 30 was first
    assert m.manifests.latest()[1]["reweight_after"] is None
    m.enqueue(spark.createDataFrame([(9,)], "doc_id long"), week + 1)  # again, before its batch
    assert m.drain(docs, week) == 3 and m.pending().count() == 0
    m.enqueue(spark.createDataFrame([(9,)], "doc_id long"), week + 2)  # and after it
    assert m.pending().count() == 1
    m.drain(docs, week)
    assert m.drain(docs, week) == 10 and m.manifests.latest()[1]["reweight_after"] == 9


def test_a_failure_keeps_the_queue_and_waits(spark, start, monkeypatch):
    rng, rows, m, _ = start
    docs = corpus(spark, rows)
    before = tables(m.open())
    m.enqueue(spark.createDataFrame([(1,), (2,)], "doc_id long"), DAY)

    def fails(*args):
        raise RuntimeError

    with monkeypatch.context() as c:
        c.setattr(segments, "write_terms", fails)
        with pytest.raises(RuntimeError):
            m.drain(docs, DAY)
    assert m.manifests.latest()[1]["last_error"] == "RuntimeError" and tables(m.open()) == before
    assert m.drain(docs, DAY + 29) == 0 and m.pending().count() == 2
    assert m.drain(docs, DAY + 30) == 2 and m.manifests.latest()[1]["last_error"] == ""


def test_unindexed_documents_are_found(spark, start):
    rng, rows, m, _ = start
    rows[77] = ("lost stone", "")
    m.enqueue_unindexed(corpus(spark, rows), DAY)
    assert [r["doc_id"] for r in m.pending().collect()] == [77]
    m.drain(corpus(spark, rows), DAY)
    assert 77 in {r["doc_id"] for r in search.search(m.open(), "lost stone").collect()}
