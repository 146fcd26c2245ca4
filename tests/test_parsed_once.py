

def test_a_fold_parses_repeated_texts_once(spark, monkeypatch):
    parsed = []
    monkeypatch.setattr(ingest, "written", lambda df, name: parsed.append(df.count()) or written(df, name))
    rows = [(0, i, f"Alpha {i % 2}", "", f"https://115.com/s/a{i % 3}", None, "S01 1080p", i, None) for i in range(60)]
    out = ingest.fold_library(spark.createDataFrame(rows, "source_priority int, row_no long, title string, preferred string, link string, code string, note string, created long, deleted long"))
    assert parsed == [3, 2]
    assert sorted(r["occurrences"] for r in out["links"].collect()) == [20, 20, 20] and out["provenance"].count() == 60
