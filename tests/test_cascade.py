import pytest

from stackwise.operators import cascade


def library(spark):
    items = spark.createDataFrame([(i, f"t{i}") for i in range(1, 7)], "item_id long, title string")
    editions = spark.createDataFrame([(10, 1, "a"), (20, 2, "a"), (21, 2, "b"), (30, 3, "b"), (40, 4, None), (50, 5, "a"), (51, 5, "a"), (60, 3, None), (61, 2, None)], "edition_id long, item_id long, fingerprint string")
    links = spark.createDataFrame([(1, 10, "x"), (2, 20, "x"), (3, 20, "y"), (4, 30, "z"), (5, 21, None), (6, 30, None), (7, 50, "q"), (8, 50, "q")], "link_id long, edition_id long, share string")
    ratings = spark.createDataFrame([(2, 7.0), (3, 8.0), (4, 6.0)], "item_id long, rating double")
    return items, editions, links, {"ratings": ratings}


def changes(spark, rows):
    return spark.createDataFrame(rows, "old long, new long")


def test_chains_fold_everything_below(spark):
    m = cascade.cascade(changes(spark, [(3, 2), (2, 1), (4, 4), (None, 1), (6, None)]), *library(spark))
    assert sorted(r["item_id"] for r in m.items.collect()) == [1, 4, 5, 6]
    assert sorted((r["edition_id"], r["item_id"]) for r in m.editions.collect()) == [(10, 1), (21, 1), (40, 4), (50, 5), (51, 5), (60, 1), (61, 1)]
    assert sorted((r["link_id"], r["edition_id"]) for r in m.links.collect()) == [(1, 10), (3, 10), (4, 21), (5, 21), (6, 21), (7, 50), (8, 50)]
    assert sorted(map(tuple, m.once["ratings"].collect())) == [(1, 7.0), (4, 6.0)]
    assert cascade.orphans(m).count() == 0
    stored = spark.createDataFrame([(1, 1, 1), (2, 3, 3), (3, 2, 2), (4, 99, 99), (5, 2, 2), (6, 0, 0)], "item_id long, editions long, links long")
    assert sorted(map(tuple, cascade.recounted(m, stored).collect())) == [(1, 4, 5), (4, 99, 99), (5, 2, 2), (6, 0, 0)]


def test_loops_and_empty_maps(spark):
    for loop in ([(1, 2), (2, 1)], [(1, 2), (2, 3), (3, 1)]):
        with pytest.raises(ValueError):
            cascade.closed(changes(spark, loop))
    m = cascade.cascade(changes(spark, []), *library(spark))
    assert m.items.count() == 6 and m.editions.count() == 9 and m.links.count() == 8 and m.touched.count() == 0
