from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from symweave.operators import retrieve, textindex
from symweave.operators.store import Conflict
from symweave.operators.textindex import TextIndex


def test_searches_as_a_scan_does_and_skips_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "RANGE", 4)
    monkeypatch.setattr(textindex, "FIRST", 2)
    rng = random.Random(7)
    word = lambda: f"w{min(int(rng.paretovariate(0.6)), 300)}"
    docs = {i: " ".join(word() for _ in range(rng.randrange(1, 30))) for i in range(300)}
    docs |= {300: "", 301: None, 302: "rare w1 rare", 303: "w1 rare"}
    table = lambda rows: spark.createDataFrame(rows, "key long, text string")
    asked = spark.createDataFrame([(1, "rare w1"), (2, "w2 w40 w41 w40"), (3, "none here"), (4, ""), (5, "w1")], "query_id int, query string")
    index = TextIndex(spark, f"file://{tmp_path}/index")

    def same():
        got = {(r["query_id"], r["rank"]): (r["key"], round(r["score"], 6)) for r in index.search(asked, 3).collect()}
        scan = retrieve.bm25(table([*docs.items()]), asked, "key", "text", 3)
        assert got == {(r["query_id"], r["rank"]): (r["key"], round(r["score"], 6)) for r in scan.collect()} and got

    index.update(table([*docs.items()]))
    same()
    assert 0 < index.read < index.met
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "index").rglob("*.parquet")}
    docs[5], docs[400] = "rare rare w41", "w1 rare and new"
    del docs[302]
    index.update(table([(5, docs[5]), (400, docs[400])]), deleted=table([(302, ""), (999, "")]))
    same()
    assert all(p.stat().st_mtime_ns == at for p, at in before.items())  # an update leaves other segments as they are
    index.compact()
    same()
    assert len(index._store.pinned()["segments"]) == 1
    assert {r["key"] for r in index.documents().select("key").collect()} == docs.keys()


def test_empty_tables_and_the_second_of_two_writers(spark, tmp_path):
    table = lambda rows: spark.createDataFrame(rows, "key long, text string, n int, terms string")
    asked = spark.createDataFrame([(1, "word")], "query_id int, query string")
    index = TextIndex(spark, f"file://{tmp_path}/index")
    index.update(table([]))
    assert index.search(asked).count() == 0
    index.update(table([(1, "Word", 1, "x"), (2, "other", 2, "y")]))
    stale = index._store.pinned()
    index.update(table([(3, "word word", 3, "z")]))
    with pytest.raises(Conflict):
        index._store._publish(stale, stale["number"])
    assert [r["key"] for r in index.search(asked).orderBy("rank").collect()] == [3, 1]
    assert index.search(asked.limit(0)).count() == 0


def test_an_update_shuffles_blocks_alone(spark, tmp_path):
    """Neither texts nor a row for each posting: documents that share their words are few blocks."""
    text = " ".join(f"w{i}" for i in range(400))
    docs = spark.range(2000).select("id", F.lit(text).alias("text")).coalesce(2)
    status = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = status()
    index = TextIndex(spark, f"file://{tmp_path}/index")
    index.update(docs, "id", "text")
    assert status() - before < 2000 * len(text) * 2  # a row for each posting would be 4.7 times the texts
    rows = spark.read.parquet(f"file://{tmp_path}/index/segment-*/postings").agg(F.sum("size"), F.max("top_tf"), F.min("low_n")).first()
    assert tuple(rows) == (2000 * 400, 1, 400) and index.documents().select("number").distinct().count() == 2000
