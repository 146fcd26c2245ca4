import pytest
from pyspark.sql import functions as F

from stackwise.sources import bundles
from stackwise.sources.bundles import Library, Matched, Plan
from stackwise.sources.manifests import Conflict

ITEMS = "id long, ident string, title string, year int, kind string, match_status string, ext long, inherited_note string"
PLAN = Plan(Matched("items", "id", [["ident"], ["title", "year"], ["title", "year", "kind"]], ["ext", "inherited_note"], kind="kind"), kept={"cache": ["key"]})


def items(spark, rows):
    return spark.createDataFrame([(*r, None) if len(r) == 7 else r for r in rows], ITEMS)


def cache(spark, rows):
    return spark.createDataFrame(rows, "key string, value int")


def state(lib):
    return {n: sorted(map(str, lib.read(n).drop("inherited").collect())) for n in ("items", "cache")}


def first(spark, lib):
    return lib.install({"items": items(spark, [(1, "a", "A", 2000, "tv", "exact", 10), (2, "b", "B", 2001, "movie", "candidate", 20), (3, "c", "C", 2002, "movie", "exact", 30), (4, "d", "C", 2002, "tv", "needs_review", 40)]), "cache": cache(spark, [("x", 1)])}, PLAN)


def second(spark):
    # by ident; by title and year; by kind within a title and year that is there twice; ambiguous; new
    rows = [(11, "a", "A2", 1999, "movie", "unmatched", None), (12, "b2", "B", 2001, "movie", "unmatched", None), (13, "c2", "C", 2002, "movie", "unmatched", None), (14, "d2", "C", 2002, "tv", "unmatched", None), (15, "e", "E", None, "tv", "unmatched", None)]
    return {"items": items(spark, rows), "cache": cache(spark, [("x", 2), ("y", 3)])}


def test_versions_inherit_and_roll_back(spark, tmp_path):
    lib = Library(spark, str(tmp_path / "lib"))
    assert lib.current() is None and lib.backup() is None
    with pytest.raises(ValueError):
        lib.read("items")
    first(spark, lib)
    before = state(lib)
    b = lib.install(second(spark), PLAN)
    got = {r["id"]: (r["kind"], r["match_status"], r["ext"], r["inherited"]) for r in lib.read("items").collect()}
    assert got == {11: ("tv", "exact", 10, "current"), 12: ("movie", "candidate", 20, "current"), 13: ("movie", "exact", 30, "current"), 14: ("tv", "needs_review", 40, "current"), 15: ("tv", "unmatched", None, None)}
    assert b.counts == {"inherited_from_current": 4} and b.tables["items"]["rows"] == 5
    assert sorted(map(tuple, lib.read("cache").collect())) == [("x", 2), ("y", 3)]
    lib.rollback()
    assert state(lib) == before
    with pytest.raises(ValueError):
        lib.rollback()


def test_backup_only_upgrades(spark, tmp_path):
    lib = Library(spark, str(tmp_path / "lib"))
    first(spark, lib)
    # the second version lost a match (review instead of exact) and keeps one that is better than the backup's
    lib.install({"items": items(spark, [(1, "a", "A", 2000, "tv", "needs_review", 11), (2, "b", "B", 2001, "movie", "exact", 21)]), "cache": cache(spark, [("x", 5), ("z", 1)])})
    lib.install({"items": items(spark, [(7, "a", "A", 2000, "tv", "unmatched", None), (8, "b", "B", 2001, "movie", "unmatched", None)]), "cache": cache(spark, [("x", 9)])}, PLAN)
    got = {r["id"]: (r["match_status"], r["ext"], r["inherited"]) for r in lib.read("items").collect()}
    assert got == {7: ("exact", 10, "backup"), 8: ("exact", 21, "current")}
    assert sorted(map(tuple, lib.read("cache").collect())) == [("x", 9), ("z", 1)]
    assert len(lib.manifests.numbers()) == 2 and len(list((tmp_path / "lib" / "versions").iterdir())) == 2


class Stop(Exception):
    pass


@pytest.mark.parametrize("at", range(4))
def test_a_crash_leaves_the_old_version(spark, tmp_path, monkeypatch, at):
    """The writer stops before each of its writes, and after the last table."""
    lib = Library(spark, str(tmp_path / "lib"))
    first(spark, lib)
    before, n = state(lib), [0]

    def stops(real):
        def call(*args):
            if n[0] == at:
                raise Stop
            n[0] += 1
            return real(*args)

        return call

    with monkeypatch.context() as m:
        m.setattr(Library, "_write_table", stops(Library._write_table))
        m.setattr(Library, "_commit", stops(Library._commit))
        if at == 3:
            m.setattr(Library, "_drop_older", stops(Library._drop_older))
        with pytest.raises(Stop):
            lib.install(second(spark), PLAN)
    seen = Library(spark, str(tmp_path / "lib"))
    assert (state(seen) == before) == (at < 3)  # after the manifest the new version is there, whole
    assert seen.read("items").count() == (4 if at < 3 else 5) and seen.read("cache").count() == (1 if at < 3 else 2)
    b = seen.install(second(spark), PLAN)
    assert seen.read("items").count() == 5 and seen.current() == b


def test_two_writers(spark, tmp_path, monkeypatch):
    lib = Library(spark, str(tmp_path / "lib"))
    first(spark, lib)
    other, real = Library(spark, str(tmp_path / "lib")), Library._commit

    def late(self, bundle):
        monkeypatch.setattr(Library, "_commit", real)
        other.install(second(spark), PLAN)
        real(self, bundle)

    monkeypatch.setattr(Library, "_commit", late)
    with pytest.raises(Conflict):
        lib.install({"items": items(spark, []), "cache": cache(spark, [])}, PLAN)
    assert lib.read("items").count() == 5


def test_check_and_empty_tables(spark, tmp_path):
    lib = Library(spark, str(tmp_path / "lib"))
    first(spark, lib)
    before = state(lib)
    with pytest.raises(ValueError):
        lib.install({"items": items(spark, []), "cache": cache(spark, [])}, Plan(check=lambda t: not t["items"].isEmpty()))
    assert state(lib) == before
    lib.install({"items": items(spark, []), "cache": cache(spark, [])}, PLAN)
    assert lib.read("items").count() == 0 and lib.read("cache").count() == 1
    assert lib.read("items").where(bundles.rank_of(F.lit(None).cast("string")) > 0).count() == 0
