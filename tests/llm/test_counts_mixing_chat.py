import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from stackwise.llm.chat import SQL, chat_format, op10_chat
from stackwise.llm.mixing import mix_sources, sainte_lague, targets
from stackwise.llm.token_counts import CACHE, compact_cache, counter, token_counts, tokenizer_path


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_token_counts_and_cache(spark, tmp_path, name):
    texts = ["a tale", "a tale", "", None, "<s> </s>", "x" * 30_000, "Zwölf\nBoxkämpfer"]
    d = spark.createDataFrame([*[(i, t, i) for i, t in enumerate(texts)], (None, "a tale", 0), (0, "a tale", 1)], "doc_id long, text string, n_tokens int")
    path = str(tmp_path / "cache")
    count = counter(tokenizer_path(name))
    want = sorted(((i, len((t or "").encode()), count([t or ""])[0]) for i, t in [*enumerate(texts), (None, "a tale"), (0, "a tale")]), key=str)
    for _ in range(2):
        got = token_counts(d, tokenizer=name, cache_path=path).collect()
        assert sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got), key=str) == want
        assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in got)
    cache = spark.read.schema(CACHE).parquet(path)
    assert cache.select("digest").distinct().count() == len({t or "" for t in texts})
    assert cache.count() == len({t or "" for t in texts})


def test_repeated_rows_are_encoded_once(spark, tmp_path):
    path = str(tmp_path / "cache")
    d = spark.createDataFrame([(None, "same")] * 5 + [(7, "other")] * 4 + [(7, "same")], "doc_id long, text string").repartition(3)
    assert token_counts(d, cache_path=path).count() == 10
    assert spark.read.parquet(path).count() == 2
    compact_cache(spark, path, str(tmp_path / "compact"))
    assert token_counts(d, cache_path=str(tmp_path / "compact")).where("n_tokens > 0").count() == 10
    assert token_counts(d.limit(0), cache_path=str(tmp_path / "none")).count() == 0


def test_sainte_lague_matches_highest_quotients():
    rng = random.Random(1)
    for _ in range(200):
        w = [float(rng.choice([0, 1, 3, rng.randint(1, 1000)])) for _ in range(rng.randint(1, 9))]
        seats = rng.randint(0, 60)
        want = [0] * len(w)
        for _ in range(seats if sum(w) else 0):
            i = max(range(len(w)), key=lambda j: (w[j] / (2 * want[j] + 1), -j))
            want[i] += 1
        assert sum(sainte_lague(w, seats)) == sum(want)
        assert sorted(a / (b or 1) for a, b in zip(sainte_lague(w, seats), w)) == sorted(a / (b or 1) for a, b in zip(want, w))


def test_targets():
    assert targets([100, 100], [5, 2], 300, 2) == [200.0, 100.0]
    assert targets([0, 10], [5, 2], 15, 2) == [0.0, 15.0]
    assert targets([], [], 0, 2) == []


def test_mixing(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randint(0, 50)), rng.choice(["a", "a", "a", "b", "c", "é", None])) for i in range(3000)]
    rows += [(None, "x y", "a"), (7, None, None), (7, "q", "a"), (7, "q", "a"), (9001, "lone \t words\x0bhere now", "z")]
    d = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    got = mix_sources(d).collect()
    assert len(got) == len(rows)
    assert sorted(map(str, got)) == sorted(map(str, mix_sources(d.repartition(7)).collect()))
    goal, taken = {}, {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        goal[r["source_size"]] = r["target"]
        taken[r["source_size"]] = taken.get(r["source_size"], 0) + r["taken"]
    assert abs(sum(goal.values()) - 1.5 * sum(r["size"] for r in got)) < 1
    for s, t in goal.items():
        assert abs(taken[s] - t) <= max(2, 0.05 * t)


def test_mixing_takes_the_words_of_a_listed_stream(spark):
    """One source, one shard: every word of the stream listed, every block taken as often as the quota says."""
    rng = random.Random(7)
    rows = [(rng.choice([None, i, i // 2]), " ".join(f"w{rng.randrange(9)}" for _ in range(rng.randint(0, 40)))) for i in range(300)]
    rows += rows[:40] * 5 + [(None, "one hot text of many rows")] * 400
    d = spark.createDataFrame([(i, t, "a") for i, t in rows], "doc_id long, text string, source string").repartition(6)
    order = [F.xxhash64(F.lit(18), "doc_id", F.xxhash64("text")), F.col("doc_id"), F.xxhash64("text")]
    docs = [(r["doc_id"], len(r["text"].split())) for r in d.orderBy(*order).collect()]
    size = sum(n for _, n in docs)
    goal = 1.5 * size
    block = max(1, min(64, int(goal // 32)))
    assert len(docs) <= 1000  # one shard
    blocks = -(-size // block)
    quota = min(round(goal / block), 2 * blocks)
    times = [quota // blocks + ((i + 1) * (quota % blocks) + 17 * 7919 % blocks) // blocks - (i * (quota % blocks) + 17 * 7919 % blocks) // blocks for i in range(blocks)]
    stream, want = [k for k, (_, n) in enumerate(docs) for _ in range(n)], [0] * len(docs)
    for place, k in enumerate(stream):
        want[k] += times[place // block]
    got = mix_sources(d).collect()
    assert sorted(map(str, [(r["doc_id"], r["size"], r["taken"]) for r in got])) == sorted(map(str, [(i, n, w) for (i, n), w in zip(docs, want)]))


def test_mixing_empty(spark):
    assert mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    got = mix_sources(spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in got] == [(0, 0.0, 0)] * 2


def test_mixing_keeps_columns_and_spreads_null_ids(spark):
    rows = [(None, f"w{i} w w", "a", "en") for i in range(5000)] + [(1, "x " * 9000, "b", "fr")]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string, shard string"), keep=("text", "shard")).collect()
    assert sorted((r["text"], r["shard"]) for r in got) == sorted((t, s) for _, t, _, s in rows)
    a = [r for r in got if r["shard"] == "en"]
    assert abs(sum(r["taken"] for r in a) - a[0]["target"]) <= 0.02 * a[0]["target"] and len({r["taken"] for r in a}) > 1


def test_chat_rotation(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob", None), (1, 1, "ann", "hi <|end|>"), (1, 70, "ann", "later"), (2, 0, "system", "alone"), (None, None, None, "lost")]
    d = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, segment int")
    got = {(r["conv_id"], r["perspective"], r["segment"]): r for r in chat_format(d).collect()}
    assert set(got) == {(1, "ann", 0), (1, "bob", 0), (None, "unknown", None)}
    r = got[1, "ann", 0]
    assert r["text"] == "<|system|>\nbe kind<|end|>\n<|assistant|>\nhi < |end| ><|end|>\n<|user name=bob|>\n<|end|>\n<|assistant|>\nlater<|end|>\n"
    assert [r["text"][m["start"] : m["end"]] for m in r["masks"]] == ["hi < |end| ><|end|>", "later<|end|>"]
    r = got[1, "bob", 0]
    assert r["text"].startswith("<|system|>\nbe kind<|end|>\n<|user name=ann|>\nhi") and [r["text"][m["start"] : m["end"]] for m in r["masks"]] == ["<|end|>"]
    assert chat_format(d.limit(0)).count() == 0


def rendered(turns, perspective):
    """The whole dialogue, turn by turn."""
    out, spans = "", []
    for _, _, role, text in turns:
        out += "<|system|>\n" if role == "system" else "<|assistant|>\n" if role == perspective else f"<|user name={role}|>\n"
        if role == perspective:
            spans.append((len(out), len(out) + len(text) + 7))
        out += f"{text}<|end|>\n"
    return out, spans


def test_pieces_of_long_dialogues_join_to_the_whole(spark):
    rng = random.Random(8)
    turns = [(1, 0, "system", "rules"), *[(1, i, "ann" if i % 2 else "bob", "t" * rng.randint(0, 9) + str(i)) for i in range(1, 100)], (1, 100, "cat", "x" * 60_000), (1, 100, "system", "late"), *[(1, 7, "ann", f"tie{i:03d}") for i in range(30)]]
    hot = [(2, None, "ann" if i % 3 else "bob", f"n{i:05d}") for i in range(4000)] + [(2, None, "system", "s")]  # most turns, without a number
    d = spark.createDataFrame([(*t, 0) for t in turns + hot], "conv_id long, turn long, role string, text string, part int").repartition(6)
    rows = chat_format(d, segment=40, part=64).collect()
    assert max(r["n_turns"] for r in rows) <= 64 and len({(r["segment"], r["part"]) for r in rows if r["conv_id"] == 2}) == 63
    for conv, own in ((1, turns), (2, hot)):
        own = sorted(own, key=lambda t: (t[1] is not None, t[1] or 0, t[2], t[3]))
        for who in {t[2] for t in own} - {"system"}:
            mine = sorted((r for r in rows if r["conv_id"] == conv and r["perspective"] == who), key=lambda r: (r["segment"] is not None, r["segment"] or 0, r["part"]))
            text, spans = rendered(own, who)
            assert "".join(r["text"] for r in mine) == text
            assert [r["begin_char"] for r in mine] == [sum(len(x["text"]) for x in mine[:i]) for i in range(len(mine))]
            assert [(r["begin_char"] + m["start"], r["begin_char"] + m["end"]) for r in mine for m in r["masks"]] == spans
    # rows for use by themselves begin with the system turns of those before
    ann = sorted((r for r in chat_format(d, segment=40, part=64, heads=True).collect() if r["conv_id"] == 1 and r["perspective"] == "ann"), key=lambda r: (r["segment"], r["part"]))
    assert len(ann) > 2 and all(r["text"].startswith("<|system|>\nrules<|end|>\n") for r in ann) and all(r["text"].count("rules") == 1 for r in ann)


@pytest.mark.parametrize("table", ["given", "long"])
def test_chat_matches_its_sql(spark, tmp_path, table):
    if table == "given":
        folder = "/root/testdata/sf0.01"
    else:
        folder, rng = str(tmp_path), random.Random(3)
        rows = [(c, rng.choice([None, rng.randrange(1200), rng.randrange(1200)]), rng.choice(["system", "ann", "bob", None, "cat"]), rng.choice(["", None, f"said {i}", "<|end|>"])) for c in (1, 2, None) for i in range(1500)]
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{folder}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet{'' if table == 'given' else '/*.parquet'}'")
    got = op10_chat(spark, folder)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({SQL})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
