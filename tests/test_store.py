from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from symweave import schemas
from symweave.operators import report, store


def test_upsert_keeps_ids_and_overwrites_with_nulls(spark):
    old = spark.createDataFrame([(1, "a", "x"), (4, "b", "y")], "id long, path string, v string")
    new = spark.createDataFrame([("b", None), ("d", "z"), ("c", "w")], "path string, v string")
    assert sorted(map(tuple, store.upsert(old, new, ["path"]).collect())) == [(1, "a", "x"), (4, "b", None), (5, "c", "w"), (6, "d", "z")]
    assert sorted(map(tuple, store.upsert(old.limit(0), new, ["path"]).collect())) == [(1, "b", None), (2, "c", "w"), (3, "d", "z")]


def test_numbers_follow_the_order_over_partitions(spark):
    rows = spark.range(1000).selectExpr("(id * 7919) % 1000 AS k").repartition(7)
    assert all(r["id"] == r["k"] + 6 for r in store.numbered(rows, ["k"], 5).collect())


def test_edges_keep_the_first_of_a_natural_key_and_tiers_apart(spark):
    ddl = "src_symbol_id long, dst_symbol_id long, kind string, tier string, seq int"
    old = spark.createDataFrame([(1, 2, "calls", "heuristic", 0)], ddl)
    new = spark.createDataFrame([(1, 2, "calls", "heuristic", 1), (1, 2, "calls", "resolved", 3), (1, 2, "calls", "resolved", 2)], ddl)
    assert [tuple(r) for r in store.insert_edges(old, new, ["seq"]).collect()] == [(1, 2, "calls", "resolved", 2)]
    with pytest.raises(ValueError, match="tier 'guess'"):
        store.check_tiers(spark.createDataFrame([(1, 2, "calls", "guess", 1)], ddl))


def test_cascade(spark):
    tables = {
        "file": spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, path string"),
        "symbol": spark.createDataFrame([(10, 1), (20, 2), (30, 3)], "id long, file_id long"),
        "chunk": spark.createDataFrame([(1, 1), (2, 2)], "id long, file_id long"),
        "edge": spark.createDataFrame([(1, 10, 20, 2), (2, 20, 30, 1), (3, 20, 30, 3), (4, 30, 10, 3), (5, 20, 30, None)], "id long, src_symbol_id long, dst_symbol_id long, evidence_file_id long"),
    }
    left = store.delete_files(tables, tables["file"].where("id = 1"))
    assert sorted(r["id"] for r in left["file"].collect()) == [2, 3] and sorted(r["id"] for r in left["symbol"].collect()) == [20, 30]
    assert [r["id"] for r in left["chunk"].collect()] == [2]
    assert sorted(((r["id"], r["evidence_file_id"]) for r in left["edge"].collect())) == [(2, None), (3, 3), (5, None)]
    assert [r["id"] for r in store.delete_edges_of_file(tables["edge"], 3).orderBy("id").collect()] == [1, 2, 5]


def test_runs_fold_and_report(spark):
    events = spark.createDataFrame([(1, 0, "running", None), (1, 1, None, 3), (1, 2, "ok", None), (2, 0, "running", 0)], "run_id long, seq int, status string, files int")
    assert sorted(map(tuple, store.fold_runs(events).collect())) == [(1, "ok", 3), (2, "running", 0)]
    t = datetime(2024, 1, 1)
    runs = spark.createDataFrame([(1, 1, t, datetime(2024, 1, 1, 0, 0, 9), "s1"), (2, 1, t, None, "s2"), (3, 2, t, datetime(2024, 1, 1, 0, 1), "s3")], "id long, repo_id long, started_at timestamp, finished_at timestamp, to_sha string")
    assert sorted((r["repo_id"], r["id"], r["duration_seconds"]) for r in report.latest_runs(runs).collect()) == [(1, 2, None), (2, 3, 60.0)]
    assert sorted((r["id"], r["from_sha"]) for r in report.run_from_sha(runs).collect()) == [(1, None), (2, "s1"), (3, None)]


def test_counts_are_zero_filled_in_listing_order(spark):
    counts = report.symbol_counts(spark.createDataFrame([("class",), ("class",), ("file",)], "kind string")).collect()
    assert [(r["kind"], r["n"]) for r in counts] == [("file", 1), ("module", 0), ("class", 2), ("function", 0), ("method", 0), ("variable", 0)]
    assert [(r["tier"], r["n"]) for r in report.edge_counts(spark.createDataFrame([], "tier string")).collect()] == [(t, 0) for t in schemas.TIERS]


@pytest.mark.parametrize(
    ("args", "case"),
    [((None, "x", None), "untracked"), (("a", None, None), "detached"), (("a", "a", None), "current"), (("a", "b", 3), "behind"), (("a", "b", None), "diverged")],
)
def test_drift(args, case):
    assert report.drift(*args) == (case, {"current": 0, "behind": 3}.get(case))


def test_costs_of_tokens(spark):
    usage = spark.createDataFrame([("m", "ask", 1000, 500), ("m", "ask", 1000, 0), ("n", "ask", 5, 5), ("m", "map", 0, 2_000_000)], "model string, step string, tokens_in long, tokens_out long")
    prices = spark.createDataFrame([("m", 3.0, 15.0)], "model string, price_in double, price_out double")
    assert {r["step"]: (r["tokens_in"], r["tokens_out"], r["cost"]) for r in report.token_costs(usage, prices, ["step"]).collect()} == {"ask": (2005, 505, None), "map": (0, 2_000_000, 30.0)}


def test_store_round_trip_and_version(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    assert s.table("edge").count() == 0 and s.size_bytes() == 0 and s.delete() is False
    edge = spark.createDataFrame([(1, 7, 1, 2, "calls", "resolved", 1.0, None, None)], schemas.EDGE)
    s.commit({"edge": edge})
    again = store.Store(spark, str(tmp_path / "s"))
    again.commit({"edge": again.table("edge").unionByName(spark.createDataFrame([(2, 8, 1, 2, "calls", "resolved", 1.0, 3, 4)], schemas.EDGE))})
    assert sorted(r["id"] for r in again.table("edge").collect()) == [1, 2] and again.size_bytes() > 0
    assert again.table("edge").columns == schemas.EDGE.names
    with pytest.raises(ValueError, match="tier"):
        again.commit({"edge": edge.selectExpr(*[c if c != "tier" else "'x' AS tier" for c in edge.columns])})
    state = max((tmp_path / "s").glob("state-*.json"))
    (tmp_path / "s" / f".{state.name}.crc").unlink()
    state.write_text(state.read_text().replace(f'"version": {schemas.SCHEMA_VERSION}', '"version": 99'))
    with pytest.raises(ValueError, match="schema version 99"):
        store.Store(spark, str(tmp_path / "s"))
    assert again.delete() is True


def edges(spark, *rows):
    return spark.createDataFrame([(i, repo, 1, 2, "calls", "resolved", 1.0, None, None) for i, repo in rows], schemas.EDGE)


def test_readers_keep_what_they_read_while_others_commit(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    s.commit({"edge": edges(spark, (1, 7), (2, 8))})
    held = s.table("edge")
    s.commit({"edge": edges(spark, (3, 7))}, repo_id=7)
    s.commit({}, gone=(8,))
    assert sorted(r["id"] for r in held.collect()) == [1, 2]
    assert [r["id"] for r in s.table("edge").collect()] == [r["id"] for r in s.table("edge", 7).collect()] == [3]
    assert s.table("edge", 8).count() == 0 and s.top_id("edge") == 3
    assert s.vacuum() == 0 and s.vacuum(0) == 2  # both repositories' first folders
    assert [r["id"] for r in s.table("edge").collect()] == [3]
    s.commit({"edge": edges(spark)}, repo_id=7)
    assert s.table("edge").count() == 0 and s.top_id("edge") == 3
    with pytest.raises(ValueError, match="other repositories"):
        s.commit({"edge": edges(spark, (9, 8))}, repo_id=7)


def test_of_two_writers_the_second_is_told(spark, tmp_path, monkeypatch):
    a, b = (store.Store(spark, str(tmp_path / "s")) for _ in range(2))
    a.commit({"edge": edges(spark, (1, 1), (2, 2))})
    read = a.pinned()
    held = a.table("edge", 1, read)
    b.commit({"edge": edges(spark, (5, 1))}, repo_id=1)
    # what was read and changed is no longer current
    with pytest.raises(store.Conflict):
        a.commit({"edge": held.unionByName(edges(spark, (4, 1)))}, repo_id=1, base=read)
    with pytest.raises(store.Conflict):
        a.commit({"edge": edges(spark, (4, 1))}, base=read)
    with pytest.raises(store.Conflict):
        a.commit({}, repo_id=2, base=read, alone=True)
    # of another repository, and another table, it is
    a.commit({"edge": edges(spark, (6, 2))}, repo_id=2, base=read)
    a.commit({"chunk": spark.createDataFrame([(1, 1, 3, None, 1, 2, "t", 1)], schemas.CHUNK)}, repo_id=1, base=read)
    assert sorted(r["id"] for r in a.table("edge").collect()) == [5, 6] and b.table("chunk").count() == 1
    # another writer publishes between the look at the states and the renaming
    publish, states = store.Store._publish, store.Store._states

    def late(self, state, base):
        monkeypatch.setattr(store.Store, "_publish", publish)
        b.commit({"edge": edges(spark, (7, 3))}, repo_id=3)
        monkeypatch.setattr(store.Store, "_states", lambda self: {n: x for n, x in states(self).items() if n <= base} if self is a else states(self))
        try:
            publish(self, state, base)
        finally:
            monkeypatch.setattr(store.Store, "_states", states)

    monkeypatch.setattr(store.Store, "_publish", late)
    a.commit({"edge": edges(spark, (8, 1))}, repo_id=1)
    assert sorted(r["id"] for r in b.table("edge").collect()) == [6, 7, 8]


def test_ids_are_handed_out_once(spark, tmp_path):
    a, b = (store.Store(spark, str(tmp_path / "s")) for _ in range(2))
    assert [a.reserve("symbol", 5), b.reserve("symbol", 2), a.reserve("symbol", 0), a.reserve("edge", 1)] == [0, 5, 7, 0]


def test_only_buckets_that_change_are_written(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    rows = spark.range(20_000).selectExpr("id", "7L AS repo_id", "id % 5000 AS file_id", "'class' AS kind", "sha2(cast(id AS string), 256) AS name", "'q' AS qualified_name", "NULL AS scip_symbol", "1 AS start_line", "2 AS end_line", "NULL AS signature", "NULL AS docstring")
    s.commit({"symbol": rows}, 7, buckets=store.buckets_for(5000))
    whole = s.size_bytes()
    before = s.table("symbol", 7)
    of_file = before.where("file_id = 77")
    s.commit(None, 7, parts={"symbol": (of_file.where("id < 6000").withColumn("name", F.lit("new")), of_file.select("id", "file_id"))})
    assert 0 < s.size_bytes() - whole < 0.02 * whole
    after = s.table("symbol", 7)
    assert after.count() == 20_000 - 2 and before.count() == 20_000
    assert sorted(r["id"] for r in after.where("name = 'new'").collect()) == [77, 5077]
    assert after.where("file_id != 77").exceptAll(before.where("file_id != 77")).isEmpty()
    # a bucket that loses all rows goes, and a repository without rows takes parts
    s.commit(None, 7, parts={"symbol": (after.limit(0), after.select("id", "file_id"))})
    assert s.table("symbol").count() == 0
    s.commit(None, 9, parts={"edge": (edges(spark, (3, 9)), edges(spark).select("id", "evidence_file_id"))})
    s.commit(None, 9, parts={"edge": (edges(spark, (4, 9)), edges(spark, (3, 9)).select("id", "evidence_file_id"))})
    assert [r["id"] for r in s.table("edge", 9).collect()] == [4]
    with pytest.raises(ValueError, match="other repositories"):
        s.commit(None, 9, parts={"edge": (edges(spark, (5, 8)), edges(spark).select("id", "evidence_file_id"))})
