from __future__ import annotations

import os

import pytest

from symweave.shared import scratch, shared_root, tidy, written


def tables(spark):
    root = shared_root(spark).removeprefix("file://") + "/symweave"
    return set(os.listdir(root)) if os.path.isdir(root) else set()


def test_tables_that_a_result_does_not_read_are_deleted(spark):
    before = tables(spark)

    @tidy
    def inner(n):
        gone = written(spark.range(n), "gone")
        kept = written(gone.selectExpr("id * 2 AS id"), "kept")
        return kept.where("id > 2")

    @tidy
    def outer():
        a, b = inner(5), written(inner(9).selectExpr("id"), "late")
        return a.join(b, "id"), b.count()

    df, n = outer()
    assert n == 7 and sorted(r["id"] for r in df.collect()) == [4, 6, 8]
    assert sorted(t.split("-")[0] for t in tables(spark) - before) == ["kept", "late"]

    @tidy
    def held():
        return written(spark.range(4), "held").persist()

    assert held().count() == 4 and any(t.startswith("held") for t in tables(spark))

    @tidy
    def fails():
        written(spark.range(3), "half")
        raise ValueError("no")

    with pytest.raises(ValueError, match="no"):
        fails()
    assert not any(t.startswith("half") for t in tables(spark) - before)
    assert tidy(lambda: written(spark.range(2), "plain").count())() == 2 and not any(t.startswith("plain") for t in tables(spark))
    assert scratch(spark, "x") != scratch(spark, "x")


def test_an_index_leaves_nothing_behind(spark, tmp_path):
    from symweave.engine import Engine

    engine = Engine(spark, str(tmp_path / "s"))
    before = tables(spark)
    engine.index("/r", files=spark.createDataFrame([("a.py", bytearray(b"def f(): g()\ndef g(): pass\n"))], "path string, content binary"))
    assert tables(spark) == before
