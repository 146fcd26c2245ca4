import gzip
import json

import pytest

from stackwise.operators import liveness, upserts
from stackwise.sources import files
from stackwise.sources.catalog import Catalog
from stackwise.streaming import events as S


def test_sheet_and_jsonl(spark, tmp_path):
    p = tmp_path / "sheet.csv"
    p.write_text("note,,\n﻿ id ,title,link\n7,A,x\n,skipped,y\n9,B,\n", encoding="utf-8")
    got = files.read_sheet(spark, str(p), "id", ["id", "title", "link"]).collect()
    assert [(r["row_number"], r["id"], r["title"]) for r in got] == [(3, "7", "A"), (5, "9", "B")]
    with pytest.raises(ValueError):
        files.read_sheet(spark, str(p), "id", ["id", "nope"])
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        f.write(json.dumps({"k": 1}) + "\nnot json\n")
    assert [r["k"] for r in files.read_jsonl(spark, str(tmp_path / "a.jsonl.gz"), "k long").collect()] == [1, None]
    assert files.read_jsonl(spark, str(tmp_path / "missing.jsonl"), "k long").count() == 0


def test_publish_and_rollback(spark, tmp_path):
    root = str(tmp_path / "lib")
    for n in (3, 5):
        files.publish(spark.range(n).toDF("id"), root, lambda df: df.count() > 0)
    assert spark.read.parquet(f"{root}/current").count() == 5
    with pytest.raises(ValueError):
        files.publish(spark.range(0).toDF("id"), root, lambda df: df.count() > 0)
    assert spark.read.parquet(f"{root}/current").count() == 5
    assert spark.read.parquet(files.rollback(spark, root)).count() == 3


def test_streaming_matches_batch(spark, sf_dir, tmp_path):
    stream = S.streaming_dedup(S.read_stream(spark, sf_dir)).select("event_key", "event_type")
    out = S.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    n = out.count()
    batch = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("event_key", S.dedup_key())
    assert n == batch.select("event_key").distinct().count()
    assert S.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "cp")).count() == n


def test_rate_limit_stream(spark, sf_dir, tmp_path):
    pytest.importorskip("google.protobuf")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = S.streaming_rate_limit(S.read_stream(spark, sf_dir), 3, 2 * 86_400)
    got = S.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    want = S.rate_limit(spark.read.parquet(f"{sf_dir}/events.parquet"), 3, 2 * 86_400)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_deleted_link_never_raises_a_count(spark, sf_dir):
    c = Catalog.from_tables(spark, sf_dir)
    live = liveness.live_links(c.links, c.checks)
    before = {r["edition_id"]: r["link_count"] for r in liveness.recount_editions(c.editions, live).collect()}
    fewer = liveness.live_links(c.links.withColumn("deleted", c.links["deleted"] | (c.links["line"] == 1)), c.checks)
    assert all(r["link_count"] <= before[r["edition_id"]] for r in liveness.recount_editions(c.editions, fewer).collect())


def test_ids_follow_code_points(spark):
    rows = spark.createDataFrame([(x,) for x in ["b", "a", "aa", "é", "ab", None, "Z"]], "k string")
    got = {r["k"]: r["id"] for r in upserts.assign_ids(rows, "k", "id").collect()}
    assert [k for k, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(["b", "a", "aa", "é", "ab", "Z"])
