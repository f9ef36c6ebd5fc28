from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import pytest

from symweave.llm import trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
DDL = "conv_id long, turn long, role string, text string, base string, A int, node string, depth string"


def brute(rows):
    """The contract, by comparing whole paths."""
    own = {}
    said = lambda r, t: hashlib.sha256(f"{len(r or '')}:{r or ''}{t or ''}".encode()).hexdigest()
    for c, n, r, t in sorted((x for x in rows if x[0] is not None), key=lambda x: (x[0], x[1] is not None, x[1] or 0, said(*x[2:]))):
        own.setdefault(c, []).append((r or "", t or ""))
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        paths[c] = tuple(own.get(base, [])[:h] + turns[h:])
    nodes = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes.setdefault(p[:d], []).append(c)
    out = []
    for v, members in nodes.items():
        under = [u for u in nodes if u[: len(v)] == v]
        kids = lambda u: sum(len(w) == len(u) + 1 and w[: len(u)] == u for w in nodes)
        ends = ",".join(map(str, sorted(c for c in members if paths[c] == v)))
        saved = sum((len(nodes[u]) - 1) * len(u[-1][1]) for u in under if u)
        out.append((min(members), len(v), min(nodes[v[:-1]]) if v else None, len(members), kids(v), sum(not kids(u) for u in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def forked(seed, families, turns):
    r = random.Random(seed)
    rows = []
    for f in range(families):
        for c in r.sample(range(100 * f, 100 * f + 100), 12):
            rows += [(c, n, r.choice(["user", "bot", None]), r.choice(["a", "b é", "", None])) for n in range(r.randint(1, turns))]
    return rows


CASES = [
    [],
    [(None, 1, "user", "no id")],
    [(5, 0, "user", "one turn")],
    [(c, 0, "user", "hello") for c in range(0, 700, 7)],
    [(101, 0, "u", "lost"), (102, 0, "u", "lost"), (103, 0, "u", "x")],
    [(-5, 0, "u", "a"), (-105, 0, "u", "a"), (0, 0, "u", "a"), (7, None, "u", "b"), (7, 0, "u", "a"), (7, None, "u", "b")],
    [(c, n, "u", f"{n % 3}") for c in (0, 1, 200, 201) for n in range(400)],
    [(1, 0, "u" * 9, "☃" * 200_000), (0, 0, "u" * 9, "☃" * 200_000)],
    forked(1, 3, 9),
    forked(2, 6, 3) + [(i, 0, "user", "same") for i in range(1000, 3000, 10)],
]


@pytest.mark.parametrize("rows", CASES)
@pytest.mark.parametrize("chunk", [1 << 18, 20])
def test_trie_equals_brute_force(spark, monkeypatch, rows, chunk):
    monkeypatch.setattr(trie, "CHUNK", chunk)
    out = trie.prefix_trie(spark.createDataFrame([(*r, "x", 1, "n", "d") for r in rows], DDL).repartition(3))
    got = sorted(map(tuple, out.select(COLUMNS).collect()), key=repr)
    assert got == sorted(brute(rows), key=repr)
    names = [r["node"] for r in out.select("node").collect()]
    assert len(set(names)) == len(names)


@pytest.mark.parametrize("rows", [c for c in CASES if c and len(c) < 300])
def test_sql_equals_brute_force(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({trie.ORACLE_SQL})").fetchall(), key=repr) == sorted(brute(rows), key=repr)
