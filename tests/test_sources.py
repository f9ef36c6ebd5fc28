from __future__ import annotations

import os
import subprocess

import pytest

from symweave.sources import discover as d
from symweave.sources import registry, scip
from symweave.sources.python_source import count_lines, module_name, parse_files, parse_python


def names(path, text, key="symbols"):
    return getattr(parse_python(path, text), key)


def symbol(text, qualified, path="m.py"):
    return next(s for s in parse_python(path, text).symbols if s["qualified_name"] == qualified)


def targets(text, kind, path="m.py"):
    return [r["target_text"] for r in parse_python(path, text).references if r["kind"] == kind]


@pytest.mark.parametrize(("path", "name"), [("pkg/sub/mod.py", "pkg.sub.mod"), ("pkg/sub/__init__.py", "pkg.sub"), ("__init__.py", "__init__"), ("a.py", "a")])
def test_module_names(path, name):
    assert module_name(path) == name


@pytest.mark.parametrize(("text", "n"), [("", 0), ("a", 1), ("a\n", 1), ("a\nb", 2), ("\n\n", 2)])
def test_line_counts(text, n):
    assert count_lines(text) == n


def test_kinds_and_nesting():
    text = "class A:\n    class B:\n        def m(self):\n            def inner(): pass\n    x: int\n    y = 1\ndef f():\n    local = 1\n"
    found = {s["qualified_name"]: s["kind"] for s in parse_python("m.py", text).symbols}
    assert found == {
        "m": "file", "m.A": "class", "m.A.B": "class", "m.A.B.m": "method", "m.A.B.m.inner": "function", "m.A.x": "variable", "m.A.y": "variable", "m.f": "function",
    }
    assert symbol(text, "m.A.B.m.inner")["parent_qualified_name"] == "m.A.B.m"
    assert symbol(text, "m")["parent_qualified_name"] is None


def test_variables_are_plain_names_only():
    text = "a, b = 1, 2\nx = 1\nx += 1\no.p = 3\nc = d = 4\n(q): int = 5\nif 1:\n    hidden = 1\n"
    assert [s["name"] for s in parse_python("m.py", text).symbols[1:]] == ["x", "c"]


def test_spans_start_at_the_first_decorator():
    f = symbol("@a\n@b(1)\ndef f():\n    pass\n", "m.f")
    assert (f["start_line"], f["end_line"]) == (1, 4)


@pytest.mark.parametrize(
    ("text", "name", "signature"),
    [
        ("def f(a: int, b: str = 'x') -> bool:\n    pass\n", "m.f", "f(a: int, b: str = 'x') -> bool"),
        ("async def f(x):\n    return x\n", "m.f", "f(x)"),
        ("def f(\n    a,\n    b=(1, 2),\n):\n    pass\n", "m.f", "f( a, b=(1, 2), )"),
        ("def f[T](x: T) -> dict[str, T]: ...\n", "m.f", "f(x: T) -> dict[str, T]"),
        ("class C:\n    def é(self, ü='('): pass\n", "m.C.é", "é(self, ü='(')"),
    ],
)
def test_signatures_are_verbatim(text, name, signature):
    assert symbol(text, name)["signature"] == signature


@pytest.mark.parametrize(("body", "doc"), [('"""a\\n b"""', "a\\n b"), ("'x'", "x"), ("''", None), ("'a' 'b'", None), ("1", None), ("r'raw'", "raw"), ("x = 1\n'late'", None)])
def test_docstrings(body, doc):
    assert parse_python("m.py", body + "\n").symbols[0]["docstring"] == doc


@pytest.mark.parametrize(
    ("text", "path", "expected"),
    [
        ("import os.path as p, sys\n", "m.py", ["os.path", "sys"]),
        ("from a.b import C as D, e\n", "m.py", ["a.b.C", "a.b.e"]),
        ("from a import *\n", "m.py", ["a"]),
        ("from . import s\n", "pkg/mod.py", ["pkg.s"]),
        ("from .sub import h\n", "pkg/mod.py", ["pkg.sub.h"]),
        ("from . import x\n", "pkg/sub/__init__.py", ["pkg.sub.x"]),
        ("from .. import t\n", "pkg/sub/mod.py", ["pkg.t"]),
        ("from .. import t\n", "pkg/mod.py", []),
        ("from ... import t\n", "pkg/mod.py", []),
        ("from . import t\n", "mod.py", []),
        ("from __future__ import annotations\n", "m.py", []),
        ("def f():\n    import json\n", "m.py", ["json"]),
        ("if 1:\n    import late\n", "m.py", ["late"]),
    ],
)
def test_imports(text, path, expected):
    assert targets(text, "imports", path) == expected


def test_calls():
    text = "f(g(), *h())\na.b.c()\nx = [i() for i in y()]\n(lambda: no())()\nd[0]()\nwith w() as v:\n    if t():\n        z()\ndef k(p=default()):\n    inner()\n@deco()\nclass Q(base()): pass\n"
    found = targets(text, "calls")
    assert found == ["inner", "f", "g", "h", "a.b.c", "i", "y", "w", "t", "z"]
    refs = parse_python("m.py", text).references
    assert next(r for r in refs if r["target_text"] == "inner")["src_qualified_name"] == "m.k"


def test_inherits_decorators_and_annotations():
    text = "@d1\n@m.d2\n@d3(1)\nclass A(B, p.C, G[int], metaclass=M, *rest): pass\ndef f(a: X, *b: q.Y, c: list[int] = 1, **d: 'S') -> Z: pass\nv: W = 1\n"
    assert targets(text, "inherits") == ["B", "p.C", "G"]
    assert targets(text, "references") == ["d1", "m.d2", "d3", "X", "q.Y", "Z", "W"]


def test_broken_source_keeps_its_lines_and_what_parses():
    p = parse_python("m.py", "def ok():\n    pass\ndef f(:\n    bad !!\nclass C:\n    y = 1\n")
    assert [(s["qualified_name"], s["start_line"]) for s in p.symbols] == [("m", 1), ("m.ok", 1), ("m.C", 5), ("m.C.y", 6)]
    assert symbol("a = 1\x0c\u2028\nb = 2\r\ndef f(x): pass\n", "m.f")["signature"] == "f(x)"
    for text in ("    bad (\n", "\n  )\n", "def f(:\n", "\x00", "(" * 300, "é" * 10 + "\n  x", "class \n"):
        assert parse_python("m.py", text).symbols[0]["kind"] == "file"


def test_a_broken_method_does_not_take_its_class_along():
    text = "class C(Base):\n    x: int = 1\n\n    @deco\n    def ok(self,\n           a):\n        return f(a)\n\n    def bad(self):\n        y = = 2\n        return g(self)\n\n    def worse(self:\n        pass\n\n    class Inner:\n        z = (\n\n        def deep(self): return h()\n\n\ndef after(): pass\n"
    p = parse_python("m.py", text)
    assert [(s["qualified_name"], s["start_line"]) for s in p.symbols] == [
        ("m", 1), ("m.C", 1), ("m.C.x", 2), ("m.C.ok", 4), ("m.C.bad", 9), ("m.C.Inner", 16), ("m.C.Inner.deep", 19), ("m.after", 22),
    ]
    assert next(s for s in p.symbols if s["name"] == "ok")["signature"] == "ok(self, a)"
    assert {(r["kind"], r["target_text"]) for r in p.references} >= {("inherits", "Base"), ("calls", "f"), ("calls", "g"), ("calls", "h")}
    assert parse_python("m.py", "class C:\n    def a(self):\n        )\n").symbols[-1]["qualified_name"] == "m.C.a"


def test_files_that_are_not_text_are_left_out(spark):
    files = spark.createDataFrame([("a.py", bytearray(b"x = 1\n")), ("b.py", bytearray(b"\xff\xfe"))], "path string, content binary")
    rows = parse_files(files).collect()
    assert [(r["path"], r["n_lines"], len(r["symbols"])) for r in rows] == [("a.py", 1, 2)]


@pytest.fixture
def tree(tmp_path):
    for name in ("a.py", "pkg/__init__.py", "pkg/_b.py", "node_modules/x.py", ".hidden/y.py", ".dot.py", "with space%41.py"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x = 1\n")
    (tmp_path / "big.py").write_text("#" * 200)
    os.symlink(tmp_path / "a.py", tmp_path / "link.py")
    return tmp_path


def paths(df):
    return sorted(r["path"] for r in df.select("path").collect())


def test_walk(spark, tree):
    found = d.discover(spark, str(tree), size_cap=100)
    assert paths(found) == [".dot.py", "a.py", "pkg/__init__.py", "pkg/_b.py", "with space%41.py"]
    assert found.where("path = 'with space%41.py'").first()["content"] == b"x = 1\n"
    assert paths(d.discover(spark, str(tree), size_cap=100, exclude=(f"{tree}/pkg",))) == [".dot.py", "a.py", "with space%41.py"]
    assert {r["path"]: r["lang"] for r in d.with_language(found).collect()}["a.py"] == "python"


def test_git(spark, tree):
    run = lambda *a: subprocess.run(["git", "-C", str(tree), "-c", "user.email=a@b", "-c", "user.name=n", *a], check=True, capture_output=True)
    assert d.current_sha(str(tree)) is None
    run("init", "-q")
    assert d.current_sha(str(tree)) is None
    (tree / ".gitignore").write_text("pkg/\n")
    run("add", "a.py")
    run("commit", "-qm", "one")
    first = d.current_sha(str(tree))
    assert "node_modules/x.py" in paths(d.discover(spark, str(tree), size_cap=100))
    assert "node_modules/x.py" not in paths(d.discover(spark, str(tree), size_cap=100, strict_skip=True))
    assert not any(p.startswith("pkg/") for p in paths(d.discover(spark, str(tree))))
    (tree / "a.py").write_text("x = 2\n")
    run("commit", "-qam", "two")
    assert d.commits_behind(str(tree), first) == 1
    assert d.commits_behind(str(tree), "0" * 40) is None
    assert d.changed_paths(str(tree), first) == {"a.py"}


def _varint(n):
    n &= (1 << 64) - 1
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _field(number, value):
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _occurrence(symbol, roles=0, old=None, packed=True, **typed):
    out = b"" if old is None else _field(1, b"".join(map(_varint, old))) if packed else b"".join(_field(1, n) for n in old)
    out += _field(2, symbol) + _field(3, roles)
    for number, line in ((8, typed.get("single")), (9, typed.get("multi"))):
        if line is not None:
            out += _field(number, _field(1, line) + _field(2, 5))
    return _field(2, out)


def test_scip_decoding(spark, tmp_path):
    document = _field(1, "pkg\\a.py") + _occurrence("s A", 1, [4, 0, 3]) + _occurrence("s B", 8, [5, 0, 6, 1], packed=False) + _occurrence("s C", 9, [1, 2])
    document += _occurrence("", 1, [1, 0, 1]) + _occurrence("s D", 0, [9, 9, 9], single=7) + _occurrence("s E", 3, multi=0)
    data = _field(1, b"") + _field(2, document)
    expected = [("pkg/a.py", 4, "s A", True), ("pkg/a.py", 5, "s B", False), ("pkg/a.py", 7, "s D", False), ("pkg/a.py", 0, "s E", True)]
    assert scip.decode_index(data) == expected
    (tmp_path / "index.scip").write_bytes(data)
    assert [tuple(r) for r in scip.read_occurrences(spark, str(tmp_path / "index.scip")).collect()] == expected
    for bad in (b"\x12\xff", b"\x0b", b"\xff" * 12):
        with pytest.raises(scip.ScipUnavailable):
            scip.decode_index(bad)


def test_indexer_that_is_missing_or_fails(tmp_path, monkeypatch):
    monkeypatch.setenv("PATH", str(tmp_path))
    with pytest.raises(scip.ScipUnavailable, match="not on the path"):
        scip.run_indexer(str(tmp_path), str(tmp_path / "out/i.scip"), "p")
    tool = tmp_path / scip.INDEXER
    tool.write_text("#!/bin/sh\necho broken >&2\nexit 3\n")
    tool.chmod(0o755)
    with pytest.raises(scip.ScipUnavailable, match="ended with 3: broken"):
        scip.run_indexer(str(tmp_path), str(tmp_path / "out/i.scip"), "p")
    tool.write_text("#!/bin/sh\nexit 0\n")
    with pytest.raises(scip.ScipUnavailable, match="left no"):
        scip.run_indexer(str(tmp_path), str(tmp_path / "out/i.scip"), "p")


def test_registry_and_lock(spark, tmp_path):
    space = registry.Workspace(str(tmp_path / "w"))
    assert space.listing() == [] and space.size("/x") == 0 and space.remove("/x") is False
    space.register("/x/../y")
    space.register("/y")
    (entry,) = space.listing()
    assert entry["root_path"] == "/y" and not entry["exists"] and len(entry["repo_hash"]) == 16
    assert space.registry(spark).count() == 1
    with space.lock("/y"), pytest.raises(registry.Locked), space.lock("/y"):
        pass
    lock = space.repo_dir("/y") / "lock"
    lock.write_text('{"pid": 999999999}')
    with space.lock("/y"):
        (space.repo_dir("/y") / "data").write_text("12345")
    assert space.size("/y") == 5
    assert space.remove("/y") is True and space.listing() == []


def test_listing_on_the_executors_is_that_of_the_driver(spark, tmp_path, monkeypatch):
    for i in range(12):
        for inner in ("", "deep/", ".hidden/", "build/"):
            (tmp_path / f"d{i}" / inner).mkdir(parents=True, exist_ok=True)
            (tmp_path / f"d{i}" / f"{inner}f.py").write_text("x" * i)
    rows = lambda df: sorted((r["path"], r["length"]) for r in df.collect())
    whole = rows(d.listed(spark, f"file://{tmp_path}", d.SKIP_DIRS))
    assert len(whole) == 24 and whole == rows(d.walked(spark, str(tmp_path), d.SKIP_DIRS))
    monkeypatch.setattr(d, "LISTED_HERE", 4)
    assert rows(d.listed(spark, f"file://{tmp_path}", d.SKIP_DIRS)) == whole
    assert len(rows(d.listed(spark, f"file://{tmp_path}"))) == 48
