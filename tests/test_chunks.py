from __future__ import annotations

import random

from symweave.sources.chunks import chunk_source, chunks, count_tokens


def check(text, found, most):
    lines = text.splitlines(keepends=True)
    covered = [x for _, a, b, _, _ in found for x in range(a, b + 1)]
    assert len(covered) == len(set(covered))
    assert {i + 1 for i, x in enumerate(lines) if count_tokens(x)} <= set(covered)
    for _, a, b, t, n in found:
        assert t == "".join(lines[a - 1 : b]) and n == count_tokens(t) > 0


def body(n, indent="    "):
    return "".join(f"{indent}x{i} = f({i})\n" for i in range(n))


def test_symbols_are_chunks_and_small_ones_stay_with_their_parent():
    text = "import a\n\n\ndef big():\n" + body(10) + "\n\ndef small():\n    pass\n\n\nclass C:\n    y = 1\n\n    def m(self):\n" + body(12, "        ") + "\nz = 2\n"
    found = chunk_source("m.py", text)
    check(text, found, 800)
    assert [c[0] for c in found] == [None, "m.big", None, "m.C", None]
    assert "def small" in found[2][3]


def test_large_symbols_give_their_parts_and_are_cut_at_statements():
    text = "class C:\n    '''doc'''\n\n    def a(self):\n" + body(200, "        ") + "\n    def b(self):\n" + body(20, "        ")
    found = chunk_source("m.py", text, most=300)
    check(text, found, 300)
    names = [c[0] for c in found]
    assert names[0] == "m.C" and "m.C.b" in names and names.count("m.C.a") >= 3
    assert all(c[4] <= 300 for c in found)
    long = "x = [\n" + "".join(f"    {i},\n" for i in range(500)) + "]\ny = 1\n"
    found = chunk_source("m.py", long, most=300)
    check(long, found, 300)
    assert [c[1:3] for c in found] == [(1, 502), (503, 503)]


def test_any_source_is_covered_once():
    rng = random.Random(2)
    parts = ["def f():\n", "    x = 1\n", "class A:\n", "\n", "    def m(self): return 1\n", "        y = 2\n", "@d\n", "if 1:\n", "bad (\n", "'''a\n", "f(1)\n", "def g(): pass; x = 2\n"]
    for _ in range(300):
        text = "".join(rng.choices(parts, k=rng.randint(0, 25)))
        check(text, chunk_source("m.py", text, least=rng.choice([1, 5, 50]), most=rng.choice([5, 20, 800])), 800)


def test_chunks_of_a_table(spark):
    files = spark.createDataFrame([("a.py", bytearray(b"x = 1\n")), ("b.py", bytearray(b"\xff")), ("c.py", bytearray(b""))], "path string, content binary")
    assert [tuple(r) for r in chunks(files).collect()] == [("a.py", None, 1, 1, "x = 1\n", 3)]
