from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from symweave.operators import intervals

SPANS = "f int, s int, a long, b long"


def spans(seed, n, top):
    r = random.Random(seed)
    out = []
    for i in range(n):
        a = r.randint(-5, top)
        out.append((r.randint(0, 2), i, a, a + r.choice([0, 1, 2, 3, 7, 8, 9, top // 3, top, -1])))
    return [*out, (0, n, None, 4), (0, n + 1, 4, None)]


@pytest.mark.parametrize("top", [40, 2_000_000_000, 1 << 45])
def test_points_in_spans(spark, top):
    rows = spans(1, 150, top)
    r = random.Random(2)
    at = [(r.randint(0, 3), i, r.choice([r.randint(-9, top * 2), r.choice(rows)[2], None])) for i in range(300)]
    left = spark.createDataFrame(at, "f int, p int, x long")
    got = intervals.around(left, spark.createDataFrame(rows, SPANS), ["f"], "x", "a", "b").select("p", "s").collect()
    assert sorted(map(tuple, got)) == sorted((p, s) for f, p, x in at for g, s, a, b in rows if f == g and None not in (x, a, b) and a <= x <= b)


@pytest.mark.parametrize("top", [40, 2_000_000_000])
def test_overlaps_are_found_once(spark, top):
    rows, others = spans(3, 90, top), spans(4, 90, top)
    right = spark.createDataFrame(others, "f int, t int, c long, d long")
    got = intervals.overlapping(spark.createDataFrame(rows, SPANS), right, ["f"], ("a", "b"), ("c", "d")).select("s", "t").collect()
    fits = lambda *x: None not in x and x[0] <= x[1] and x[2] <= x[3] and x[0] <= x[3] and x[2] <= x[1]
    assert sorted(map(tuple, got)) == sorted((s, t) for f, s, a, b in rows for g, t, c, d in others if f == g and fits(a, b, c, d))


def test_a_span_is_few_rows_however_long(spark):
    rows = spark.createDataFrame([(0, i, 1000 * i + 1, 1000 * i + 10**k) for k in range(13) for i in range(8)], SPANS)
    filed = intervals.filed(rows, "a", "b").groupBy("s", "b").count()
    assert filed.agg(F.max("count")).first()[0] <= 2


def test_empty(spark):
    none = spark.createDataFrame([], SPANS)
    assert intervals.around(spark.createDataFrame([(0, 1, 5)], "f int, p int, x long"), none, ["f"], "x", "a", "b").count() == 0


def test_neither_side_is_broadcast_as_both_have_more_rows_than_were_read(spark, tmp_path):
    spark.range(1000).selectExpr("id AS f", "id AS x").write.parquet(str(tmp_path / "points"))
    points = spark.read.parquet(str(tmp_path / "points"))
    left = points.select("f", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("x"))
    joined = intervals.around(left, points.selectExpr("f", "x AS a", "x + 9 AS b"), ["f"], "x", "a", "b")
    joined.collect()
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
