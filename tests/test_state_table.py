import random

import pytest
from pyspark.sql import functions as F

from stackwise.operators import upserts
from stackwise.sources.manifests import Conflict
from stackwise.sources.state_table import StateTable

LATEST = lambda old, new: upserts.latest_wins(old, new, ["k"], [F.desc("n")])


def rows(spark, data):
    return spark.createDataFrame(data, "k string, v string, n int")


def test_merges_equal_a_dictionary(spark, tmp_path):
    rng = random.Random(4)
    t = StateTable.create(spark, str(tmp_path / "t"), rows(spark, []).schema, ["k"], buckets=8)
    assert t.read().count() == 0 and t.merge(rows(spark, []), LATEST) == 0
    want = {}
    for i in range(4):
        new = [(rng.choice(["a", "b", "c", "d", "e", "f", None]), f"v{i}{j}", j) for j in range(rng.randint(1, 6))]
        t.merge(rows(spark, new).where("k is not null"), LATEST)
        want |= {k: (v, n) for k, v, n in sorted(new, key=lambda r: r[2]) if k is not None}
        assert {r["k"]: (r["v"], r["n"]) for r in t.read().collect()} == want
    assert {r["k"] for r in t.lookup(spark.createDataFrame([("a",), ("zz",)], "k string")).collect()} == {"a"} & set(want)
    t.vacuum()
    assert len(t.manifests.numbers()) == 1 and t.read().count() == len(want)


def files(tmp_path):
    return {p.relative_to(tmp_path): p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}


def test_untouched_files_keep_their_names(spark, tmp_path):
    t = StateTable.create(spark, str(tmp_path), rows(spark, []).schema, ["k"], buckets=16)
    t.merge(rows(spark, [(f"k{i}", "a", 0) for i in range(200)]), LATEST)
    before = files(tmp_path)
    assert t.merge(rows(spark, [("k3", "b", 1)]), LATEST) == 1
    t.vacuum()
    after = files(tmp_path)
    assert len(set(after) - set(before)) == 1 and all(before[p] == after[p] for p in set(before) & set(after))
    # the old folder stays while 15 buckets are in it
    assert len(set(before) & set(after)) == len(before)
    assert t.read().count() == 200 and t.read().where("v = 'b'").count() == 1


@pytest.mark.parametrize("how,want", [
    (lambda o, n: upserts.insert_only(o, n, ["k"], ["n"]), [("a", "1", 1), ("b", "2", 2)]),
    (lambda o, n: upserts.merge_monotone(o, n, ["k"], ["n"], ["v"]), [("a", "9", 5), ("b", "2", None)]),
    (lambda o, n: upserts.merge_non_empty(o, n, ["k"], ["v", "n"]), [("a", "9", 5), ("b", "2", 2)]),
])
def test_the_other_merges(spark, tmp_path, how, want):
    t = StateTable.create(spark, str(tmp_path), rows(spark, []).schema, ["k"], buckets=4)
    t.merge(rows(spark, [("a", "1", 1)]), LATEST)
    t.merge(rows(spark, [("a", "9", 5), ("b", "2", 2)]), how)
    assert sorted(map(tuple, t.read().collect())) == want


def test_the_slower_writer_fails(spark, tmp_path, monkeypatch):
    a = StateTable.create(spark, str(tmp_path), rows(spark, []).schema, ["k"], buckets=4)
    b = StateTable(spark, str(tmp_path))

    def slow(old, new):
        b.merge(rows(spark, [("x", "first", 0)]), LATEST)
        return LATEST(old, new)

    with pytest.raises(Conflict):
        a.merge(rows(spark, [("x", "second", 0)]), slow)
    assert [r["v"] for r in a.read().collect()] == ["first"]
