from __future__ import annotations

import random

import pytest

from symweave.operators import resolve as r
from symweave.plans import fixtures as fx

CALLABLE, CLASS = {"function", "method", "class"}, {"class"}


def plain(symbols, refs):
    """The rules in a straight line: (file_id, ref_seq) -> target id."""
    by_name = {q: (i, k) for i, _f, k, q in sorted(symbols)}
    out = {}
    for f, n, kind, src, target, _line in refs:
        if kind not in ("calls", "inherits", "references", "imports"):
            continue
        allowed = CALLABLE if kind == "calls" else CLASS if kind == "inherits" else None
        fits = lambda s, allowed=allowed: s is not None and (allowed is None or s[1] in allowed)
        scopes = [".".join(src.split(".")[:i]) for i in range(len(src.split(".")), 0, -1)]
        hit = None
        head, _, member = target.partition(".")
        if kind == "calls" and head in ("self", "cls") and member and "." not in member:
            owner = next((s for s in scopes if by_name.get(s, (0, ""))[1] == "class"), None)
            hit = by_name.get(f"{owner}.{member}") if owner else None
        if hit is None and fits(by_name.get(target)):
            hit = by_name[target]
        if hit is None and "." not in target and kind != "imports":
            hit = next((by_name[f"{s}.{target}"] for s in scopes if fits(by_name.get(f"{s}.{target}"))), None)
            if hit is None:
                imports = [x[4] for x in sorted(refs) if x[0] == f and x[2] == "imports"]
                first = next((by_name[i] for i in imports if i.split(".")[-1] == target and i in by_name), None)
                hit = first if fits(first) else None
            if hit is None:
                named = [(i, k) for i, _f, k, q in symbols if q.split(".")[-1] == target and (allowed is None or k in allowed)]
                hit = named[0] if len(named) == 1 else None
        if hit:
            out[f, n] = hit[0]
    return out


def found(spark, symbols, refs):
    rows = r.resolved_targets(spark.createDataFrame(symbols, fx.SYMBOL_DDL), spark.createDataFrame(refs, fx.REF_DDL)).collect()
    return {(x["file_id"], x["ref_seq"]): x["dst"] for x in rows}


def test_fixture(spark):
    assert found(spark, fx.SYMBOL_ROWS, fx.REF_ROWS) == plain(fx.SYMBOL_ROWS, fx.REF_ROWS)


@pytest.mark.parametrize("seed", range(4))
def test_random_tables(spark, seed):
    rng = random.Random(seed)
    names = ["a", "b", "c", "self", "run"]
    name = lambda n: ".".join(rng.choices(names, k=n))
    symbols = [(i + 1, rng.randint(1, 3), rng.choice(["file", "class", "function", "method", "variable"]), name(rng.randint(1, 4))) for i in range(60)]
    refs = []
    for f in (1, 2, 3):
        for n in range(60):
            target = rng.choice([name(1), name(2), name(3), "self." + name(1), "cls." + name(1)])
            refs.append((f, n, rng.choice(["calls", "inherits", "references", "imports"]), rng.choice(symbols)[3], target, n))
    assert found(spark, symbols, refs) == plain(symbols, refs)


def test_edges_to_itself_and_from_nowhere_are_dropped(spark):
    symbols = spark.createDataFrame([(1, 1, "function", "m.f")], fx.SYMBOL_DDL)
    refs = spark.createDataFrame([(1, 0, "calls", "m.f", "f", 1), (1, 1, "calls", "m.none", "f", 2)], fx.REF_DDL)
    assert r.heuristic_edges(symbols, refs).count() == 0


def reads(df, column):
    """How often a plan reads a table that has the column."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(column in leaves.apply(i).output().mkString(",") for i in range(leaves.size()))


def test_all_rules_look_up_their_names_in_one_join(spark, tmp_path):
    for name, df in (("symbols", fx.symbols(spark)), ("refs", fx.refs(spark))):
        df.write.parquet(f"{tmp_path}/{name}")
    symbols, refs = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("symbols", "refs"))
    edges = r.heuristic_edges(symbols, refs)
    # the imports are looked up before, as they are names themselves; what symbols are called is a table by then
    assert reads(edges, "target_text") == 2 and reads(edges, "qualified_name") == 2
    assert sorted(map(tuple, edges.collect())) == sorted(map(tuple, r.heuristic_edges(fx.symbols(spark), fx.refs(spark)).collect())) and edges.count() > 5


def test_many_names_are_dealt_before_they_are_counted(spark, monkeypatch):
    """No map of names grows with a task's share of the symbols."""
    for name in ("TASK_REFS", "TASK_NAMES"):
        monkeypatch.setattr(r, name, 1)
    monkeypatch.setattr(r, "FEW_TASKS", 1)
    plan = r._named(fx.symbols(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("Exchange") > plan.rindex("HashAggregate") and "SortAggregate" not in plan
    assert found(spark, fx.SYMBOL_ROWS, fx.REF_ROWS) == plain(fx.SYMBOL_ROWS, fx.REF_ROWS)


def test_references_that_share_a_key_share_a_target(spark):
    symbols = spark.createDataFrame([(1, 1, "function", "m.f"), (2, 1, "function", "m.g"), (3, 1, "function", "m.h"), (4, 1, "function", "m.h.g")], fx.SYMBOL_DDL)
    refs = spark.createDataFrame([(1, 5, "calls", "m.f", "m.g", 1), (1, 5, "references", "m.h", "g", 9), (1, 5, "references", "m.h", "g", 9)], fx.REF_DDL)
    edges = [(x["src_symbol_id"], x["dst_symbol_id"], x["kind"], x["evidence_line"]) for x in r.heuristic_edges(symbols, refs).collect()]
    assert sorted(edges) == [(1, 2, "calls", 1), (3, 2, "references", 9), (3, 2, "references", 9)]


def test_defines_edges_stay_in_their_file_and_take_the_last_parent(spark):
    symbols = spark.createDataFrame(
        [(1, 1, "class", "m.A", 1, 9), (2, 1, "class", "m.A", 11, 19), (3, 1, "method", "m.A.f", 2, 3), (4, 2, "method", "m.A.f", 2, 3)],
        "id long, file_id long, kind string, qualified_name string, start_line int, end_line int",
    )
    parents = spark.createDataFrame([(1, None), (2, None), (3, "m.A"), (4, "m.A")], "id long, parent_qualified_name string")
    assert [(x["src_symbol_id"], x["dst_symbol_id"], x["evidence_line"]) for x in r.defines_edges(symbols, parents).collect()] == [(2, 3, 2)]


def test_innermost_over_block_borders_and_ties(spark):
    symbols = spark.createDataFrame([(1, 1, 1, 1000), (2, 1, 60, 70), (3, 1, 62, 66), (4, 1, 62, 66), (5, 2, 1, 5)], "id long, file_id long, start_line int, end_line int")
    probes = spark.createDataFrame([(1, n) for n in (1, 63, 64, 68, 71, 1000, 1001)] + [(3, 1)], "file_id long, line int")
    assert {(x["line"], x["symbol_id"]) for x in r.innermost(probes, symbols, []).collect()} == {(1, 1), (63, 3), (64, 3), (68, 2), (71, 1), (1000, 1)}


def test_scip_edges(spark):
    symbols = spark.createDataFrame(
        [(1, 1, "class", "m.A", 1, 9), (2, 1, "method", "m.A.f", 3, 5), (3, 2, "function", "n.g", 1, 4)], "id long, file_id long, kind string, qualified_name string, start_line int, end_line int"
    )
    files = spark.createDataFrame([(1, "m.py"), (2, "n.py")], "id long, path string")
    refs = spark.createDataFrame([(2, 0, "calls", "n.g", "f", 2), (2, 1, "calls", "n.g", "f", 3), (1, 0, "calls", "m.A.f", "f", 4)], fx.REF_DDL)
    occurrences = spark.createDataFrame(
        [("m.py", 2, "s f", True), ("n.py", 1, "s f", False), ("n.py", 2, "s f", False), ("n.py", 2, "s x", False), ("m.py", 3, "s f", False), ("gone.py", 0, "s f", True)], fx.OCCURRENCE_DDL
    )
    rows = [(x["src_symbol_id"], x["dst_symbol_id"], x["tier"], x["evidence_line"]) for x in r.scip_edges(symbols, refs, occurrences, files).collect()]
    assert rows == [(3, 2, "resolved", 2)]


def test_all_rules_on_the_small_example(spark):
    """Rows that the star schema cannot show: ambiguous names, nested scopes, dotted targets."""
    import duckdb

    sql = f"WITH syms AS ({fx.SYMBOLS_SQL}), refs AS ({fx.REFS_SQL}), {fx.RESOLVE_SQL} SELECT file_id, ref_seq, place, dst FROM targets"
    expected = duckdb.connect().execute(sql).fetchall()
    got = r.resolved_targets(fx.symbols(spark), fx.refs(spark)).collect()
    assert sorted(map(tuple, got)) == sorted(expected) and len(expected) > 10
