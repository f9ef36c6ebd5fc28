from __future__ import annotations

import os
import random
import re

import pytest
from pyspark.sql import functions as F
from symweave.functions import text
from symweave.operators import impact, report, retrieve
from symweave.operators import traverse as t
from symweave.plans import star_graph

NAMES = {c: i + 1 for i, c in enumerate("ABCDEFGH")}


def graph(spark, edges):
    """edges: (src, dst[, kind[, tier]])"""
    rows = []
    for n, e in enumerate(edges):
        src, dst, kind, tier = (*e, "calls", "heuristic")[:4] if len(e) == 2 else (*e, "heuristic")[:4]
        rows.append((n + 1, NAMES[src], NAMES[dst], kind, tier, 7, n))
    return spark.createDataFrame(rows, "id long, src_symbol_id long, dst_symbol_id long, kind string, tier string, evidence_file_id long, evidence_line int")


def deps(spark, edges, seed, depth=4, tiers=None, **more):
    back = {v: k for k, v in NAMES.items()}
    found = t.reverse_dependencies(graph(spark, edges), NAMES[seed], depth, tiers, **more).collect()
    return sorted((back[r["src_symbol_id"]], r["depth"], r["kind"]) for r in found)


@pytest.mark.parametrize(
    ("edges", "seed", "depth", "tiers", "expected"),
    [
        ([("A", "B")], "B", 4, None, [("A", 1, "calls")]),
        ([("A", "B")], "A", 4, None, []),
        ([("A", "B"), ("B", "C")], "C", 4, None, [("A", 2, "calls"), ("B", 1, "calls")]),
        ([("A", "B"), ("B", "C")], "C", 1, None, [("B", 1, "calls")]),
        ([("A", "B"), ("A", "C"), ("B", "D"), ("C", "D")], "D", 4, None, [("A", 2, "calls"), ("B", 1, "calls"), ("C", 1, "calls")]),
        ([("A", "D"), ("A", "B"), ("B", "C"), ("C", "D")], "D", 4, None, [("A", 1, "calls"), ("B", 2, "calls"), ("C", 1, "calls")]),
        ([("A", "B"), ("B", "C"), ("C", "A"), ("D", "A")], "A", 10, None, [("B", 2, "calls"), ("C", 1, "calls"), ("D", 1, "calls")]),
        ([("A", "A")], "A", 4, None, []),
        ([("A", "B"), ("A", "B", "imports")], "B", 4, None, [("A", 1, "calls"), ("A", 1, "imports")]),
        ([("A", "B"), ("C", "B", "calls", "resolved")], "B", 4, ["resolved"], [("C", 1, "calls")]),
        ([("A", "B"), ("B", "C", "calls", "resolved")], "C", 4, ["resolved"], [("B", 1, "calls")]),
        ([("A", "B"), ("C", "B", "calls", "resolved")], "B", 4, [], [("A", 1, "calls"), ("C", 1, "calls")]),
        ([("A", "B", "inherits"), ("C", "B", "references")], "B", 4, None, [("A", 1, "inherits"), ("C", 1, "references")]),
    ],
)
def test_reverse_dependencies(spark, edges, seed, depth, tiers, expected):
    assert deps(spark, edges, seed, depth, tiers) == expected


def test_an_edge_in_two_tiers_collapses_to_the_lower_id_unless_tiers_are_kept_apart(spark):
    edges = [("A", "B", "calls", "heuristic"), ("A", "B", "calls", "resolved")]
    assert [r["tier"] for r in t.reverse_dependencies(graph(spark, edges), 2, 1).collect()] == ["heuristic"]
    both = t.reverse_dependencies(graph(spark, edges), 2, 1, collapse=("kind", "tier")).collect()
    assert sorted(r["tier"] for r in both) == ["heuristic", "resolved"]


def test_against_a_plain_search_on_random_graphs(spark):
    rng = random.Random(3)
    for _ in range(3):
        edges = [(rng.choice("ABCDEFGH"), rng.choice("ABCDEFGH"), rng.choice(["calls", "imports"])) for _ in range(20)]
        depth = {"A": 0}
        for d in range(1, 5):
            for s, x, _k in edges:
                if depth.get(x) == d - 1 and s not in depth:
                    depth[s] = d
        expected = sorted({(s, depth[s], k) for s, x, k in edges if s in depth and depth[s] and depth.get(x) == depth[s] - 1})
        assert deps(spark, edges, "A") == expected


def test_the_frontier_need_not_be_broadcast(spark, monkeypatch):
    monkeypatch.setattr(t, "BROADCAST_ROWS", 0)
    assert deps(spark, [("A", "B"), ("B", "C")], "C") == [("A", 2, "calls"), ("B", 1, "calls")]


def test_one_hop_lists_and_limits(spark):
    g = graph(spark, [("A", "B"), ("C", "B", "imports"), ("B", "D")])
    assert [r["id"] for r in t.edges_to(g, 2).collect()] == [1, 2]
    assert [r["id"] for r in t.edges_to(g, 2, kind="imports").collect()] == [2]
    assert [r["id"] for r in t.edges_from(g, 2).collect()] == [3]
    assert [r["id"] for r in t.edges_to(g, 2, limit=1).collect()] == [1]


def test_depth_is_clamped():
    assert [t.clamp_depth(d) for d in (-1, 0, 1, 4, 99)] == [1, 1, 1, 4, 4]


def test_edges_of_a_small_subgraph_are_not_shuffled(spark, tmp_path):
    """Only what is counted moves, also where Spark takes no table for small."""
    edges = spark.createDataFrame([(i, i, i + 1, "calls", "heuristic") for i in range(9)], "id long, src_symbol_id long, dst_symbol_id long, kind string, tier string")
    edges.write.parquet(f"{tmp_path}/edges")
    symbols = spark.range(10).withColumn("file_id", F.col("id") % 2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        stored = spark.read.parquet(f"{tmp_path}/edges")
        inside = t.subgraph_edges(stored, t.subgraph(stored, 4, 2, 3), symbols, 4)
        plan = inside._jdf.queryExecution().executedPlan().toString()
        rows = sorted(map(tuple, inside.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan
    assert rows == [("s2", "s3", "calls", 1), ("s3", "s4", "calls", 1), ("s4", "s5", "calls", 1), ("s5", "f0", "calls", 1)]


def test_cycles_and_subgraph(spark):
    g = graph(spark, [("A", "B"), ("B", "C"), ("C", "A"), ("D", "A"), ("E", "E")])
    assert {(r["symbol_id"], r["length"]) for r in t.cycles(g, 4).collect()} == {(1, 3), (2, 3), (3, 3), (5, 1)}
    near = {r["symbol_id"]: (r["depth"], r["kept"]) for r in t.subgraph(g, 1, 1, budget=2).collect()}
    assert near == {2: (1, True), 3: (1, True), 4: (1, False)}


@pytest.fixture(scope="module")
def tables(spark):
    symbols = spark.createDataFrame(
        [(1, 1, "class", "m.A", 1, 20), (2, 1, "method", "m.A.f", 3, 9), (3, 1, "method", "m.A.g", 3, 9), (4, 2, "function", "n.h", 1, 5), (5, 2, "function", "n.h", 6, 7)],
        "id long, file_id long, kind string, qualified_name string, start_line int, end_line int",
    )
    files = spark.createDataFrame([(1, "m.py"), (2, "n.py")], "id long, path string")
    edges = spark.createDataFrame(
        [(1, 4, 2, "calls", "resolved", 2, 3), (2, 1, 2, "defines", "heuristic", 1, 3), (3, 3, 2, "calls", "heuristic", 9, 4), (4, 99, 2, "calls", "heuristic", 1, 1)],
        "id long, src_symbol_id long, dst_symbol_id long, kind string, tier string, evidence_file_id long, evidence_line int",
    )
    return symbols, files, edges


@pytest.mark.parametrize(
    ("address", "expected"),
    [("m.A", 1), ("m.py:1", 1), ("m.py:5", 2), ("m.py:10", 1), ("n.h", 4), ("m.py:99", None), ("none.py:3", None), ("absent", None), ("m.A:x", None)],
)
def test_addresses(tables, address, expected):
    assert t.resolve_address(tables[0], tables[1], address) == expected


def test_references_are_enriched_and_in_reading_order(tables):
    rows = t.find_references(*tables, "m.A.f").collect()
    assert [(r["tier"], r["qualified_name"], r["evidence_path"]) for r in rows] == [("heuristic", "m.A", "m.py"), ("heuristic", "m.A.g", None), ("resolved", "n.h", "n.py")]
    assert t.find_references(*tables, "nobody") is None
    assert t.find_references(*tables, "n.h").count() == 0
    hits = t.find_references(*tables, "m.A.f", 99)
    tiers = [r["tier"] for r in t.by_tier(hits).collect()]
    assert tiers == sorted(tiers) and len(tiers) == hits.count()
    grouped = {r["tier"]: r["n"] for r in t.tier_counts(hits).collect()}
    assert grouped == {"heuristic": 2, "resolved": 1}


def test_mermaid(spark, tables):
    symbols, _, edges = tables
    text = t.mermaid(edges, symbols).first()["text"]
    assert text.startswith("graph LR\n") and '-->|calls|' in text


def test_tier_filters_reach_the_scan(spark, tmp_path):
    graph(spark, [("A", "B")]).write.parquet(f"{tmp_path}/edges")
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = t.edges_to(spark.read.parquet(f"{tmp_path}/edges"), 2, "calls", ["resolved"])._jdf.queryExecution().toString()
    assert "In(tier" in plan or "EqualTo(tier" in plan
    assert "EqualTo(dst_symbol_id,2)" in plan


def test_symbols_on_cycles_of_any_length(spark):
    rng = random.Random(3)
    ring = [(f"r{i}", f"r{(i + 1) % 9}") for i in range(9)]
    rows = ring + [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(55)] + [("r0", "n0"), ("x", "x")]
    names = sorted({n for r in rows for n in r})
    ids = {n: i for i, n in enumerate(names, 1)}
    edges = [(k, ids[a], ids[b], "calls", "heuristic") for k, (a, b) in enumerate(rows)]
    g = spark.createDataFrame(edges, "id long, src_symbol_id long, dst_symbol_id long, kind string, tier string")
    out = {}
    for a, b in rows:
        out.setdefault(ids[a], set()).add(ids[b])

    def reached(start):
        seen, todo = set(), [*out.get(start, ())]
        while todo:
            k = todo.pop()
            if k not in seen:
                seen.add(k)
                todo += out.get(k, ())
        return seen

    far = {ids[n]: reached(ids[n]) for n in names}
    expected = {i: max(j for j in far[i] if i in far[j]) for i in far if i in far[i]}
    assert {r["symbol_id"]: r["component"] for r in t.strongly_connected(g).collect()} == expected
    lengths = {r["symbol_id"]: r["length"] for r in t.cycles(g, 6).collect()}
    assert lengths.keys() == expected.keys() and all(lengths[ids[f"r{i}"]] is None for i in range(9)) and lengths[ids["x"]] == 1
    assert t.strongly_connected(g.limit(0)).count() == 0


DDL = "id long, src_symbol_id long, dst_symbol_id long, kind string, tier string"


def _brute(pairs):
    """Components by reaching, and of each the first of its shortest cycles."""
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)

    def paths_from(start):
        level, seen = {b: (start, b) for b in sorted(out.get(start, ()))}, {}
        while level:
            seen |= level
            step = {}
            for at, path in level.items():
                for b in out.get(at, ()):
                    if b not in seen:
                        step[b] = min(step.get(b, path + (b,)), path + (b,))
            level = step
        return seen

    reached = {n: paths_from(n) for n in {x for pair in pairs for x in pair}}
    component = {n: max(m for m in reached[n] if n in reached[m]) for n in reached if n in reached[n]}
    first = {}
    for n, c in component.items():
        path = reached[n][n]
        if min(path) == n and (c not in first or (len(path), path) < (len(first[c]), first[c])):
            first[c] = path
    return component, first


@pytest.mark.parametrize("seed,nodes,links", [(2, 40, 44), (3, 40, 90)])
def test_components_and_first_cycles_against_brute_force(spark, seed, nodes, links):
    rng = random.Random(seed)
    pairs = {(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(links)}
    pairs |= {(100, 101), (101, 100), (101, 102), (102, 103), (103, 101), (110, 111), (111, 110), (111, 0)}
    g = spark.createDataFrame([(k, a, b, "calls", "heuristic") for k, (a, b) in enumerate(sorted(pairs))], DDL)
    component, first = _brute(pairs)
    assert {r["symbol_id"]: r["component"] for r in t.strongly_connected(g).collect()} == component
    rows = t.cycle_paths(g, 4).collect()
    assert {r["component"]: r["symbols"] for r in rows} == {c: [*component.values()].count(c) for c in component.values()}
    for r in rows:
        path = first[r["component"]]
        assert (r["length"], r["path"]) == ((len(path) - 1, [*path]) if len(path) <= 5 else (None, None))


def test_cycles_of_a_tier_alone_and_of_no_edges(spark):
    rows = [(1, 1, 2, "calls", "resolved"), (2, 2, 1, "calls", "heuristic"), (3, 2, 3, "calls", "resolved"), (4, 3, 1, "calls", "resolved"), (5, None, 1, "calls", "resolved"), (6, 1, None, "calls", "resolved")]
    g = spark.createDataFrame(rows, DDL)
    assert [r["path"] for r in t.cycle_paths(g).collect()] == [[1, 2, 1]]
    assert [r["path"] for r in t.cycle_paths(g, tiers=["resolved"]).collect()] == [[1, 2, 3, 1]]
    assert t.cycle_paths(g, tiers=["heuristic"]).count() == 0 and t.cycle_paths(g.limit(0)).count() == 0


def test_rounds_grow_with_the_logarithm_of_a_chain(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(t, "written", lambda df, tag, keep=t.written: tables.append(tag) or keep(df, tag))

    def rounds(n):
        tables.clear()
        links = [(i, i + 1) for i in range(n)] + [(n, n // 2)] + [(n + 1 + i, n + 2 + i) for i in range(n)] + [(2 * n + 1, n + 1)]
        g = spark.createDataFrame([(k, a, b, "calls", "resolved") for k, (a, b) in enumerate(links)], DDL)
        sizes = {r["component"]: r["count"] for r in t.strongly_connected(g).groupBy("component").count().collect()}
        assert sizes == {n: n - n // 2 + 1, 2 * n + 1: n + 1}
        return tables.count("cycle-step") + tables.count("highest")

    few, many = rounds(40), rounds(640)
    assert many <= 2.5 * few and many <= 30, (few, many)


def test_impact_tells_sure_from_unsure_and_the_way(spark):
    ddl = "id long, src_symbol_id long, dst_symbol_id long, kind string, tier string"
    rows = [(2, 1, "heuristic"), (3, 2, "resolved"), (4, 1, "resolved"), (5, 4, "resolved"), (2, 5, "resolved"), (6, 3, "resolved"), (1, 6, "resolved")]
    edges = spark.createDataFrame([(i, a, b, "calls", tier) for i, (a, b, tier) in enumerate(rows)], ddl)
    symbols = spark.createDataFrame([(i, i % 2) for i in range(1, 7)], "id long, file_id long")
    files = spark.createDataFrame([(0, "src/a.py"), (1, "tests/test_a.py")], "id long, path string")
    seeds = spark.createDataFrame([(1,)], "symbol_id long")
    got = {r["symbol_id"]: (r["depth"], r["certainty"], r["is_test"], r["path"]) for r in impact.impact(edges, seeds, symbols, files, 4).collect()}
    assert got == {
        2: (1, "definite", False, [1, 2]), 3: (2, "definite", True, [1, 2, 3]), 4: (1, "definite", False, [1, 4]), 5: (2, "definite", True, [1, 4, 5]), 6: (3, "possible", False, [1, 2, 3, 6]),
    }
    near = {r["symbol_id"]: r["certainty"] for r in impact.impact(edges, seeds, symbols, files, 2).collect()}
    assert near == {2: "possible", 3: "possible", 4: "definite", 5: "definite"}
    assert impact.impact(edges, seeds.limit(0), symbols, files).count() == 0


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_duplicate_chunks_are_those_of_brute_force(spark, threshold):
    rng = random.Random(6)
    base = [[f"w{rng.randrange(60)}" for _ in range(rng.randint(1, 60))] for _ in range(25)]
    texts = [" ".join(b) for b in base]
    for b in base:
        for share in (0.01, 0.03, 0.08):
            texts.append(" ".join("new" if rng.random() < share else w for w in b))
    texts += [texts[0].upper(), "", "...", "one", "one"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    pairs, of = retrieve.duplicate_chunks(chunks, "id", "text", threshold)
    sets = {}
    for i, text in enumerate(texts):
        words = re.findall("[a-z0-9]+", text.lower())
        if words:
            sets[i] = frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))
    first = {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
    assert {r["id"]: r["representative"] for r in of.collect()} == first
    kept = sorted(set(first.values()))
    expected = {(a, b) for a in kept for b in kept if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}
    found = pairs.collect()
    assert {(r["a"], r["b"]) for r in found} == expected and len(found) == len(expected)


def test_redaction(spark):
    said = "key AbC9xYz0QwErTyUiOp12LmNoPqRs and AAAAAAAAAAAAAAAAAAAAAAAA1 and plain"
    df = spark.createDataFrame([(said, "a/.env"), (None, "x")], "t string, p string")
    one, none = df.select(text.redact_keys(F.col("t")).alias("k"), text.is_env_path(F.col("p")).alias("e")).collect()
    assert one["k"] == "key [REDACTED] and AAAAAAAAAAAAAAAAAAAAAAAA1 and plain" and one["e"] and none["k"] is None and not none["e"]


@pytest.mark.parametrize(("seeds", "forward"), [(3, False), (200, False), (130, True)])
def test_sets_of_seeds_reach_what_each_seed_reaches(spark, seeds, forward):
    rng = random.Random(seeds)
    rows = [(i, rng.randint(0, 60), rng.randint(0, 60), "calls", rng.choice(["resolved", "heuristic"])) for i in range(130)]
    edges = spark.createDataFrame(rows, "id long, src_symbol_id long, dst_symbol_id long, kind string, tier string")
    starts = spark.createDataFrame([(s * 10, rng.randint(0, 70)) for s in range(seeds) for _ in range(2)] + [(None, 1), (5, None)], "seed_id long, symbol_id long")
    for tiers in (None, ["resolved"]):
        got = sorted(map(tuple, t.reach_sets(edges, starts, 4, tiers, forward=forward).collect()))
        one = t.reach(edges, starts.dropna(), 4, tiers, forward=forward, collapse=()).select("seed_id", "symbol_id", "depth")
        assert got == sorted(map(tuple, one.collect())) and got
    assert t.reach_sets(edges, starts.limit(0), 4).count() == 0


def test_sizes_halfway_between_two_tenths_take_the_even_one(spark):
    sizes = {1023: "1023 B", 1024: "1.0 KB", 1280: "1.2 KB", 1792: "1.8 KB", 1281: "1.3 KB", 5 << 18: "1.2 MB", 7 << 18: "1.8 MB", 5 << 28: "1.2 GB", (1 << 20) - 1: "1024.0 KB", None: None}
    rows = spark.createDataFrame([(s,) for s in sizes], "s long").select("s", text.byte_size(F.col("s")).alias("t")).collect()
    assert {r["s"]: r["t"] for r in rows} == sizes


@pytest.mark.parametrize("n", [0, 1, 3, 60])
def test_guesses_by_folder_are_counted_without_a_row_for_each(spark, n):
    rng = random.Random(n)
    path = lambda: rng.choice([f"{rng.choice('ab')}/{rng.choice(['', 'c/'])}f{rng.randint(0, 9)}.py", f"top{rng.randint(0, 4)}.py", None])
    changed = spark.createDataFrame([(rng.choice([1, 2, 3, None]), path()) for _ in range(n)], "case_id long, path string")
    files = spark.createDataFrame([(path(),) for _ in range(40)], "path string")
    long_way = report.precision_recall(impact.same_directory(changed, files), changed, ["case_id", "path"])
    counted = impact.same_directory_score(changed, files)
    assert counted.columns == long_way.columns and counted.collect() == long_way.collect()


def test_counting_guesses_is_linear_in_the_files_of_a_folder(spark):
    """200,000 files of one folder and a hundred changes are 20 million guesses, and ten times as many files a hundred times the pairs."""
    changed = spark.range(200_000).selectExpr("id % 100 AS case_id", "concat('d/f', id) AS path")
    assert impact.same_directory_score(changed, changed.select("path")).first()[:3] == (200_000, 20_000_000, 200_000)


def test_stored_edges_hold_their_ids_and_lines_alone(spark, tmp_path):
    """The ends, kind and tier are in the id: strings and keys were shuffled and stored beside it before."""
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("the driver's tables are not here")
    kept = star_graph.stored_edges(spark, sf)
    assert spark.read.parquet(star_graph._STORED[spark.sparkContext.applicationId, sf]).columns == ["id", "evidence_line"]
    assert kept.count() == kept.select("src_symbol_id", "dst_symbol_id", "kind", "tier").distinct().count() == star_graph.edges(spark, sf).count()
    packed = spark.createDataFrame([(((2_000_000_011 * (1 << 28) + (1 << 28) - 1) * 8 + 3) * 2 + 1, 7)], "id long, evidence_line int")
    assert star_graph._unpacked(packed).first()[1:5] == (2_000_000_011, (1 << 28) - 1, "inherits", "resolved")


def test_sets_of_seeds_group_once_a_level(spark, monkeypatch):
    """What was visited was written and grouped again at each level, and edges made distinct."""
    tags, own = [], t.written
    monkeypatch.setattr(t, "written", lambda df, tag: tags.append(tag) or own(df, tag))
    edges = spark.createDataFrame([(i, i, i + 1, "calls", "resolved") for i in range(9)], "id long, src_symbol_id long, dst_symbol_id long, kind string, tier string")
    starts = spark.createDataFrame([(1, 0), (2, 3)], "seed_id long, symbol_id long")
    got = sorted(map(tuple, t.reach_sets(edges, starts, 3, forward=True).collect()))
    assert got == [(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 4, 1), (2, 5, 2), (2, 6, 3)] and "visited" not in tags


def test_rounds_of_components_send_no_table_through_the_driver(spark, monkeypatch):
    plans, own = [], t.written
    monkeypatch.setattr(t, "written", lambda df, tag: plans.append(df._jdf.queryExecution().executedPlan().toString()) or own(df, tag))
    rows = [(i, a, b, "calls", "resolved") for i, (a, b) in enumerate([(1, 2), (2, 1), (1, 3), (3, 2)])]
    edges = spark.createDataFrame(rows, "id long, src_symbol_id long, dst_symbol_id long, kind string, tier string")
    assert sorted(map(tuple, t.strongly_connected(edges).collect())) == [(1, 3), (2, 3), (3, 3)]
    assert plans and not any("BroadcastHashJoin" in p or "BroadcastExchange" in p for p in plans)


def test_edges_move_a_line_once_and_group_where_they_lie(spark, tmp_path, monkeypatch):
    """One shuffle, of a row for each line; a part or supplier may be null, and equal edges stay one."""
    small = "/root/testdata/sf0.001"
    if not os.path.exists(small):
        pytest.skip("no tables")
    for name in ("nation", "supplier", "customer", "orders", "part"):
        spark.read.parquet(f"{small}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    lines = spark.read.parquet(f"{small}/lineitem.parquet")
    odd = lines.withColumn("l_partkey", F.lit(None).cast("long")).unionByName(lines.withColumn("l_suppkey", F.lit(None).cast("long")))
    lines.unionByName(odd).write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(star_graph, "TASK_LINES", 1000, raising=False)
    whole = star_graph._packed_edges(spark, small)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan
    with_odd = star_graph._packed_edges(spark, str(tmp_path))
    assert with_odd.count() == with_odd.select("id").distinct().count() == whole.count() and with_odd.exceptAll(whole).isEmpty()


@pytest.mark.parametrize(("step", "most"), [(1, 0), (-3, 0), (1_000_003, None)])
def test_sets_of_seeds_shuffle_no_row_of_the_result(spark, monkeypatch, step, most):
    """Near ids are their own places: the result was joined to a table of all seeds' numbers before."""
    tags, own = [], t.written
    monkeypatch.setattr(t, "written", lambda df, tag: tags.append(tag) or own(df, tag))
    edges = spark.createDataFrame([(i, i, i + 1, "calls", "resolved") for i in range(300)], "id long, src_symbol_id long, dst_symbol_id long, kind string, tier string")
    starts = spark.createDataFrame([(i * step, i) for i in range(200)], "seed_id long, symbol_id long")
    out = t.reach_sets(edges, starts, 2, forward=True)
    assert sorted(map(tuple, out.collect())) == sorted((i * step, i + d, d) for i in range(200) for d in (1, 2))
    assert ("places" in tags) == (most is None) and tags.count("frontier") == 2
    if most is not None:
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join") == 1  # of the last level's edges
