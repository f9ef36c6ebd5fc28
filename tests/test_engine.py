from __future__ import annotations

import json
import random
import socket

import pytest

from symweave import cli
from symweave.engine import Engine
from symweave.operators import retrieve
from symweave.operators.store import Conflict
from symweave.plans.fixtures import OCCURRENCE_DDL, SIMPLE_FILES
from symweave.streaming.incremental import affected_files, file_changes, watch


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in SIMPLE_FILES.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(text)
    (root / "README.md").write_text("no code\n")
    (root / "pkg" / "broken.py").write_bytes(b"\xff\xfe")
    return root


@pytest.fixture(scope="module")
def engine(spark, tree, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("store")))
    e.first = e.index(str(tree))
    return e


def names(engine, root):
    return {r["id"]: r["qualified_name"] for r in engine.symbols(root).collect()}


def edges(engine, root):
    q = names(engine, root)
    return {(q[r["src_symbol_id"]], r["kind"], q[r["dst_symbol_id"]], r["tier"]) for r in engine.edges(root).collect()}


CALLS = {
    ("pkg.shapes.Shape.area", "calls", "pkg.shapes._square"), ("pkg.shapes.make", "calls", "pkg.shapes.Shape"), ("pkg.shapes.make", "references", "pkg.shapes.Shape"),
    ("pkg.use", "imports", "pkg.shapes.Shape"), ("pkg.use", "imports", "pkg.shapes.make"), ("pkg.use.build", "calls", "pkg.shapes.make"), ("pkg.use.build", "references", "pkg.shapes.Shape"),
    ("run", "imports", "pkg.use.build"), ("run", "calls", "run.main"), ("run.main", "calls", "pkg.use.build"),
}


def test_first_index(engine, tree):
    r = engine.first
    assert (r.files_indexed, r.files_skipped, r.scip_status) == (4, 2, "skipped")
    assert {k: v for k, v in r.symbols.items() if v} == {"file": 4, "class": 1, "function": 4, "method": 2, "variable": 2}
    assert r.edges == {"resolved": 0, "heuristic": 19, "inferred": 0}
    assert {e[:3] for e in edges(engine, str(tree)) if e[1] != "defines"} == CALLS


def test_questions(engine, tree):
    root = str(tree)
    rows = engine.refs(root, "pkg.shapes.make", 2).collect()
    assert [(r["depth"], r["qualified_name"], r["kind"]) for r in rows] == [
        (1, "pkg.shapes", "defines"), (1, "pkg.use", "imports"), (1, "pkg.use.build", "calls"), (2, "run", "imports"), (2, "run.main", "calls"),
    ]
    assert engine.refs(root, "pkg/shapes.py:15").count() == 3
    assert engine.refs(root, "absent") is None
    assert engine.refs(root, "pkg.shapes.make", tiers=["resolved"]).count() == 0
    with pytest.raises(ValueError, match="unknown tier"):
        engine.refs(root, "pkg", tiers=["sure"])
    with pytest.raises(KeyError):
        engine.symbols("/nowhere")
    hits = engine.search(root, "square", 3).collect()
    assert hits[0]["qualified_name"] == "pkg.shapes._square"
    changed = engine.spark.createDataFrame([("pkg/shapes.py", 18, 19)], "path string, first_line int, last_line int")
    q = names(engine, root)
    assert {q[r["symbol_id"]] for r in engine.impact_of(root, changed, 1).collect()} == {"pkg.shapes.Shape.area"}  # the file changed itself
    assert {q[r["symbol_id"]] for r in engine.subgraph(root, "run.main", 1).collect()} == {"run", "pkg.use.build"}
    assert engine.find_symbol(root, "run.main").first()["kind"] == "function" and engine.find_symbol(root, "no").count() == 0
    files = engine.spark.createDataFrame([("run.py", bytearray((tree / "run.py").read_bytes()))], "path string, content binary")
    assert [(r["symbol_id"], r["start_line"]) for r in engine.chunks(root, files).collect()] == [(None, 1)]
    assert [r["path"] for r in engine.list_files(root, 2).collect()] == ["pkg/__init__.py", "pkg/shapes.py"]


def test_index_again_with_occurrences_and_remove(spark, engine, tree):
    root = str(tree)
    before = edges(engine, root)
    occurrences = spark.createDataFrame([("pkg/shapes.py", 13, "s make", True), ("pkg/use.py", 6, "s make", False)], OCCURRENCE_DDL)
    again = engine.index(root, occurrences=occurrences)
    assert again.edges == {"resolved": 1, "heuristic": 19, "inferred": 0} and again.scip_status == "ok"
    assert edges(engine, root) == before | {("pkg.use.build", "calls", "pkg.shapes.make", "resolved")}
    assert [r["scip_symbol"] for r in engine.symbols(root).where("name = 'make'").collect()] == ["s make"]
    status = engine.status(root)
    assert status.last_run_status == "ok" and status.scip_status == "ok" and status.size_bytes > 0
    assert engine.listing().count() == 1
    files = spark.createDataFrame([("run.py", bytearray(b"x = 1\n")), ("new.py", bytearray(b""))], "path string, content binary")
    assert {r["path"]: r["change"] for r in engine.changes(root, files).collect()} == {
        "run.py": "changed", "new.py": "added", "pkg/__init__.py": "deleted", "pkg/shapes.py": "deleted", "pkg/use.py": "deleted",
    }
    pruned = engine.index(root, files=files, prune=True)
    assert pruned.symbols["file"] == 2 and pruned.files_indexed == 2
    with pytest.raises(Exception, match="path"):
        engine.index(root, files=spark.createDataFrame([(1,)], "nothing int"))
    assert engine.status(root).last_run_status == "interrupted"
    assert engine.remove(root) is True and engine.remove(root) is False


def whole(engine, root):
    """Everything that an index says, by names."""
    q = names(engine, root)
    paths = {r["id"]: r["path"] for r in engine.files(root).collect()}
    found = [(q[r["src_symbol_id"]], r["kind"], q[r["dst_symbol_id"]], r["tier"], paths.get(r["evidence_file_id"]), r["evidence_line"]) for r in engine.edges(root).collect()]
    symbols = [(r["qualified_name"], r["kind"], paths[r["file_id"]], r["start_line"], r["scip_symbol"]) for r in engine.symbols(root).collect()]
    return sorted(map(repr, found)), sorted(map(repr, symbols)), sorted(paths.values())


EDITS = [
    {"pkg/use.py": "from pkg.shapes import Shape, make\n\n\ndef build() -> Shape:\n    return other(1)\n"},
    {"pkg/extra.py": "def other(x):\n    return make(x)\n\n\nclass Shape:\n    def area(self):\n        return self.sides\n"},
    {"pkg/shapes.py": "class Shape:\n    pass\n\n\ndef make(name):\n    return Shape()\n\n\ndef main():\n    make('x')\n"},
    {"pkg/extra.py": None},
    {"run.py": "from pkg.use import build\nfrom pkg.shapes import make\n\n\ndef main():\n    make(build())\n\n\ndef make(y):\n    return main\n"},
    {},
]


def test_an_incremental_index_says_what_a_new_one_says(spark, tmp_path, monkeypatch):
    from symweave.sources import python_source

    root, texts = tmp_path / "tree", dict(SIMPLE_FILES)
    engine = Engine(spark, str(tmp_path / "store"))
    frame = lambda: spark.createDataFrame([(p, bytearray(t.encode())) for p, t in texts.items()], "path string, content binary")
    engine.index(str(root), files=frame())
    for n, edit in enumerate(EDITS):
        for path, text in edit.items():
            texts.pop(path, None)
            if text is not None:
                texts[path] = text
        before = {r["path"]: r["id"] for r in engine.symbols(str(root)).where("kind = 'file'").join(engine.files(str(root)).selectExpr("id AS file_id", "path"), "file_id").collect()}
        done = engine.index(str(root), files=frame(), prune=True)
        assert (done.files_indexed, done.files_unchanged) == (len(texts), len(texts) - sum(t is not None for t in edit.values()))
        new = Engine(spark, str(tmp_path / f"store{n}"))
        new.index(str(root), files=frame())
        assert whole(engine, str(root)) == whole(new, str(root)), n
        after = {r["path"]: r["id"] for r in engine.symbols(str(root)).where("kind = 'file'").join(engine.files(str(root)).selectExpr("id AS file_id", "path"), "file_id").collect()}
        assert all(after[p] == before[p] for p in texts if p not in edit)
        ids = [r["id"] for r in engine.edges(str(root)).collect()]
        assert len(ids) == len(set(ids))
    forced = engine.index(str(root), files=frame(), force=True)
    assert forced.files_unchanged == 0 and whole(engine, str(root)) == whole(new, str(root))


def test_changes_and_affected_files(spark):
    changes = file_changes(
        spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, blob_sha string"), spark.createDataFrame([("b", "2"), ("c", "1"), ("d", "1")], "path string, blob_sha string")
    )
    assert {r["path"]: r["change"] for r in changes.collect()} == {"a": "deleted", "b": "changed", "c": "unchanged", "d": "added"}
    files = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "e")], "id long, path string")
    symbols = spark.createDataFrame([(10, 1), (20, 2), (30, 3), (40, 4)], "id long, file_id long")
    links = spark.createDataFrame([(30, 20), (40, 30)], "src_symbol_id long, dst_symbol_id long")
    assert {r["file_id"] for r in affected_files(changes, files, symbols, links).collect()} == {1, 2, 3}


def test_stream_of_snapshots(spark, tmp_path):
    folder, seen = str(tmp_path / "snapshots"), []
    spark.createDataFrame([("a.py", bytearray(b"x"))], "path string, content binary").write.parquet(folder)
    for n in (1, 2):
        watch(spark, folder, str(tmp_path / "check"), lambda df, batch: seen.extend(r["path"] for r in df.collect())).awaitTermination()
        assert len(seen) == n
        spark.createDataFrame([(f"b{n}.py", bytearray(b"y"))], "path string, content binary").write.mode("append").parquet(folder)


def test_two_repositories_indexed_at_once_both_land(spark, tmp_path):
    store = str(tmp_path / "store")
    a, b = Engine(spark, store), Engine(spark, store)
    frame = lambda name: spark.createDataFrame([(f"{name}.py", bytearray(f"def {name}():\n    return {name}()\n".encode()))], "path string, content binary")
    # at each stage of one run another writer does a whole run, of another root or of one that it knows
    others = {"discover": "/b", "parse": "/c", "resolve": "/b", "write": "/d"}
    a.index("/a", files=frame("first"), progress=lambda stage: b.index(others[stage], files=frame(stage)))
    repos = {r["root_path"]: r["id"] for r in a.store.table("repo").collect()}
    assert sorted(repos) == ["/a", "/b", "/c", "/d"] and len(set(repos.values())) == 4
    assert {r["path"] for r in a.store.table("file").collect()} == {"first.py", "discover.py", "parse.py", "resolve.py", "write.py"}
    for name in ("file", "symbol", "edge", "index_run"):
        ids = [r["id"] for r in b.store.table(name).collect()]
        assert len(ids) == len(set(ids)) and ids, name
    assert sorted(r["status"] for r in a.store.table("index_run").collect()) == ["ok"] * 5
    assert a.status("/a").last_run_status == "ok" and a.store.table("reference").count() == 5
    # the same repository cannot be changed by two runs at once
    with pytest.raises(Conflict):
        a.index("/a", files=frame("again"), progress=lambda stage: stage == "resolve" and b.index("/a", files=frame("other")))
    assert {r["path"] for r in a.files("/a").collect()} == {"first.py", "other.py"}
    assert a.remove("/b") and sorted(r["root_path"] for r in b.listing().collect()) == ["/a", "/c", "/d"]


def test_a_stream_ends_in_the_index_of_its_last_snapshots(spark, tmp_path):
    engine, texts = Engine(spark, str(tmp_path / "store")), dict(SIMPLE_FILES)
    ddl = "path string, seq long, content binary"
    rows = lambda seq, of: spark.createDataFrame([(p, seq, None if t is None else bytearray(t.encode())) for p, t in of.items()], ddl)
    assert engine.apply_snapshots("/r", rows(5, texts), 0, "s")
    for n, edit in enumerate(EDITS[:3], 1):
        texts |= edit
        older = rows(4, {p: "def late():\n    pass\n" for p in SIMPLE_FILES}).unionByName(rows(5 + n, edit))
        assert engine.apply_snapshots("/r", older, n, "s")
        # a batch that is given twice is applied once
        assert not engine.apply_snapshots("/r", rows(99, dict.fromkeys(texts)), n, "s")
    texts = {p: t for p, t in texts.items() if t is not None}
    new = Engine(spark, str(tmp_path / "new"))
    new.index("/r", files=rows(0, texts).select("path", "content"))
    assert whole(engine, "/r") == whole(new, "/r")
    state = {r["path"]: r["gone"] for r in engine.store.table("snapshot").collect()}
    assert {p for p, gone in state.items() if not gone} == set(texts)


def test_follow_a_folder(spark, tmp_path):
    engine, folder = Engine(spark, str(tmp_path / "store")), str(tmp_path / "snapshots")
    for n, (seq, text) in enumerate([(1, "def f():\n    pass\n"), (3, "def g():\n    pass\n"), (2, "def late():\n    pass\n"), (4, None)]):
        spark.createDataFrame([("m.py", seq, text and bytearray(text.encode()))], "path string, seq long, content binary").write.mode("append").parquet(folder)
        engine.follow("/r", folder, str(tmp_path / "check")).awaitTermination()
        assert {r["name"] for r in engine.symbols("/r").where("kind = 'function'").collect()} == [{"f"}, {"g"}, {"g"}, set()][n]


def test_indexing_opens_no_connection_beyond_this_machine(spark, tree, tmp_path, monkeypatch):
    connect = socket.socket.connect

    def local_only(self, address):
        assert not isinstance(address, tuple) or address[0] in ("127.0.0.1", "localhost", "::1"), address
        return connect(self, address)

    monkeypatch.setattr(socket.socket, "connect", local_only)
    before = sorted(p.name for p in tree.rglob("*"))
    Engine(spark, str(tmp_path / "s")).index(str(tree))
    assert sorted(p.name for p in tree.rglob("*")) == before


def test_command_line(spark, tree, tmp_path, capsys):
    call = lambda *a: cli.main(["--workspace", str(tmp_path / "w"), *a], spark)
    assert call("status", str(tree)) == 1
    assert call("index", str(tmp_path / "none")) == 1
    assert call("index", str(tree), "--no-scip") == 0
    assert "4 files indexed, 2 skipped" in capsys.readouterr().out
    assert call("list") == 0 and "1 repositories" in capsys.readouterr().out
    assert call("status", str(tree)) == 0 and "heuristic=19" in capsys.readouterr().out
    import os

    here = os.getcwd()
    os.chdir(tree)
    try:
        assert call("refs", "run.main") == 0 and "run  calls  run.py:9" in capsys.readouterr().out
        assert call("refs", "nobody") == 1 and call("refs", "run", "--tier", "x") == 1
        capsys.readouterr()
        said = lambda: json.loads(capsys.readouterr().out)
        assert call("search", "square", "--json", "--kind", "function") == 0 and said()[0]["qualified_name"] == "pkg.shapes._square"
        assert call("impact", "pkg/shapes.py:18-19", "--json") == 0 and {"pkg.shapes.Shape.area"} <= {r["qualified_name"] for r in said()}
        assert call("impact", "nonsense") == 1 and call("graph", "nobody") == 1
        capsys.readouterr()
        assert call("graph", "run.main", "--radius", "1", "--json") == 0 and said()["nodes"]
        assert call("graph", "run.main", "--radius", "1") == 0 and capsys.readouterr().out.startswith("graph LR\n")
        assert call("status", str(tree), "--json") == 0 and said()["drift"] == "untracked"
        assert call("index", str(tree), "--no-scip", "--json") == 0 and said()["files_unchanged"] == 4
        assert call("list", "--json") == 0 and len(said()) == 1
    finally:
        os.chdir(here)
    assert call("remove", str(tree)) == 0 and call("remove", str(tree)) == 1
    assert (tree / "run.py").exists()


def test_context_duplicates_and_tests(spark, tmp_path):
    body = "    total = 0\n    for item in items:\n        total = total + item.price * item.count\n        total = total - item.discount(item.count, item.price)\n    return round(total, 2)\n"
    texts = {
        "shop/cart.py": f"def cart_total(items):\n{body}", "shop/order.py": f"def cart_total(items):\n{body}",
        "tests/test_cart.py": "from shop.cart import cart_total\n\n\ndef test_total():\n    assert cart_total([]) == 0\n",
    }
    files = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in texts.items()], "path string, content binary")
    e = Engine(spark, str(tmp_path / "store"))
    e.index("/shop", files=files)
    found = e.duplicates("/shop", files).collect()
    assert len(found) == 1 and found[0]["similarity"] == 1.0
    shown = e.context("/shop", files, "discount of an item price").collect()
    assert shown[0]["rank"] == 1 and "discount" in shown[0]["text"] and sum(r["n_tokens"] for r in shown) <= 8000
    assert {r["qualified_name"] for r in e.tests_of("/shop", "shop.cart.cart_total").collect()} == {"tests.test_cart", "tests.test_cart.test_total"}
    assert e.tests_of("/shop", "nobody") is None


def test_citations_and_fusion(spark):
    files = spark.createDataFrame([(1, "a.py")], "id long, path string")
    symbols = spark.createDataFrame([(5, 1, 2, 9)], "id long, file_id long, start_line int, end_line int")
    cited = spark.createDataFrame([("a.py", 3, 4), ("a.py", 1, 4), ("b.py", 1, 1), ("a.py", 4, 3)], "path string, start_line int, end_line int")
    assert {(r["path"], r["start_line"], r["verified"]) for r in retrieve.check_citations(cited, symbols, files).collect()} == {("a.py", 3, True), ("a.py", 1, False), ("b.py", 1, False), ("a.py", 4, False)}


def test_budget_of_one_query_with_many_ranks(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "RANKS", 7)
    rows = [(q, r, (r * 7919) % 5) for q in (1, 2, None) for r in range(1, 100 if q == 1 else 30)]
    for budget in (0, 3, 50, 10_000):
        expected = []
        for q in (1, 2, None):
            used = 0
            for _, r, n in sorted(x for x in rows if x[0] == q):
                used += n
                if used <= budget:
                    expected.append((q, r, n, used))
        got = retrieve.context_budget(spark.createDataFrame(rows, "query_id long, rank long, n_tokens long"), budget).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)


def test_cosine_in_blocks_of_queries(spark, monkeypatch):
    vectors = spark.createDataFrame([(i, [float(i % 5 + 1), float(i % 3), 1.0]) for i in range(40)] + [(90, [0.0, 0.0, 0.0])], "id long, v array<float>")
    queries = vectors.where("id % 4 = 0").selectExpr("id AS query_id", "v AS query")
    one = retrieve.cosine_top_k(vectors, queries, "id", "v", 3).collect()
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", 3)
    assert sorted(one) == sorted(retrieve.cosine_top_k(vectors, queries, "id", "v", 3).collect())
    assert len(one) == 30 and all(r["id"] != 90 for r in one)


@pytest.mark.parametrize("numbers", [1 << 16, 200])
def test_cosine_is_that_of_a_plain_loop_with_copies_and_odd_vectors(spark, monkeypatch, numbers):
    monkeypatch.setattr(retrieve, "LEAST_NUMBERS", numbers)
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(60)]
    rows += [(60 + i, rows[i % 3][1]) for i in range(40)] + [(100, [0.0] * 6), (101, None), (102, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (103, [1.0, 2.0]), (104, [1e200] * 6), (105, []), (106, [1e-170] * 6)]

    def cosine(a, b):
        if not a or not b or None in a + b or len(a) != len(b):
            return None
        d = p = q = 0.0
        for x, y in zip(a, b, strict=True):
            d, p, q = d + x * y, p + x * x, q + y * y
        return round(d / p**0.5 / q**0.5, 9) if p > 0 and q > 0 else None

    asked = [r for r in rows if r[0] % 4 == 0]
    expected = []
    for i, q in asked:
        best = sorted((-s, j) for j, v in rows if (s := cosine(v, q)) is not None and s == s)[:5]
        expected += [(i, j, -s, n + 1) for n, (s, j) in enumerate(best)]
    vectors = spark.createDataFrame(rows, "id long, v array<double>")
    got = retrieve.cosine_top_k(vectors, vectors.where("id % 4 = 0").select(vectors.id.alias("query_id"), vectors.v.alias("query")), "id", "v", 5)
    assert got.columns == ["query_id", "id", "score", "rank"]
    odd = {104}  # lengths that overflow
    assert sorted(tuple(r) for r in got.collect() if r[0] not in odd) == sorted(r for r in expected if r[0] not in odd)


def test_cosine_deals_vectors_to_blocks_and_multiplies_matrices(spark, monkeypatch):
    """Queries met all vectors in one broadcast join of interpreted loops; the driver held them."""
    vectors = spark.range(50).selectExpr("id", "array(cast(id AS float), 1f, cast(id % 7 AS float)) AS v")
    plan = retrieve.cosine_top_k(vectors, vectors.selectExpr("id AS query_id", "v AS query"), "id", "v", 3)._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "FlatMapCoGroupsInArrow" in plan
