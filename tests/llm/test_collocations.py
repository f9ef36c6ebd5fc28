from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from symweave.llm import collocations as co

DDL = "lang string, text string, phrase string, A string, id string, rank int"


def brute(rows, least=30, longest=4, covered=80, first=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    out = []
    big = {x: a for x, a in f.items() if a >= least}
    for (lang, p), a in big.items():
        if len(p) < 2:
            continue
        over = any(x == lang and len(q) > len(p) and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (x, q), b in big.items())
        if not over:
            score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
            out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        mine = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(x[0], i, *x[1:]) for i, x in enumerate(mine[:first], 1)]
    return sorted(ranked)


def prose(seed, words, vocabulary="the of and A b,c;d . ! new york city \t \n émile 𝄞 x:y  z".split(" ")):
    r = random.Random(seed)
    return " ".join(r.choice(vocabulary) for _ in range(words))


CASES = [
    [],
    [("en", None), (None, ""), ("en", " \t.\n")],
    [("en", "new york " * 40), (None, "New York, new york;" * 20), ("und", "NEW YORK " * 3)],
    [("en", "a " * 100), ("en", "a a\ta.a"), ("en", "a,a")],
    [("en" if i % 3 else None, prose(i, 400)) for i in range(12)],
    [("fr", prose(99, 150_000)), ("fr", "word" * 30_000 + " " + "aé" * 9)],
]


@pytest.mark.parametrize("rows", CASES)
@pytest.mark.parametrize(("read", "group", "widest"), [(1 << 18, 4_000_000, 26), (50, 40, 12)])
def test_collocations_equal_brute_force(spark, monkeypatch, rows, read, group, widest):
    if widest == 12 and len(rows) == 2:
        pytest.skip("as many slices and groups as this takes are many jobs")
    monkeypatch.setattr(co, "READ", read)
    monkeypatch.setattr(co, "GROUP_CHARS", group * 40 if sum(len(t or "") for _, t in rows) > 5000 else group)
    monkeypatch.setattr(co, "WIDEST", widest)
    monkeypatch.setattr(co, "WIDE", 64 if widest == 26 else 2)
    out = co.collocations(spark.createDataFrame([(*r, "p", "a", "i", 1) for r in rows], DDL).repartition(3))
    got = sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in out.collect())
    assert got == brute(rows)


@pytest.mark.parametrize("rows", CASES[1:5])
def test_sql_equals_brute_force(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (lang VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(con.execute(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({co.ORACLE_SQL})").fetchall()) == brute(rows)


def test_arithmetic_is_exact_beyond_64_bits(spark, monkeypatch):
    big = 9_000_000_000_000_000
    counts = spark.createDataFrame([("en", "a", 1, 2 * big + 1), ("en", "b", 1, 3 * big), ("en", "a b", 2, big)], "lang string, phrase string, size int, a long")
    monkeypatch.setattr(co, "phrase_counts", lambda *a: (counts, spark.createDataFrame([("en", 9 * big)], "lang string, n long")))
    (row,) = co.collocations(counts).collect()
    assert row["score"] == 2_000_000 * big // (5 * big + 1)


def test_sketches_bound_from_above():
    r = np.random.default_rng(3)
    h = co.mixed(r.zipf(1.3, 50_000).astype(np.uint64))
    sketch = co.Sketch(12)
    sketch.add(h)
    distinct, times = np.unique(h, return_counts=True)
    for row, at in zip(sketch.rows, co.places(distinct, 12)):
        assert (row[at] >= np.minimum(times, co.FULL)).all() and row.max() <= co.FULL


def test_words_of_bytes():
    texts = ["The cat.  sat\tOn,", "", "é x", "..", "end"]
    words = co.Words([t.encode() for t in texts], [1, 2, 3, 4, 1])
    assert [words.phrase(i, 1) for i in range(len(words.begin))] == ["the", "cat", "sat", "on", "é", "x", "end"]
    assert words.doc.tolist() == [0, 0, 0, 0, 2, 2, 4]
    fits = [f.tolist() for _, f in words.phrases(2)][1]
    assert fits == [True, False, True, False, True, False]
    assert co.guarded(b"A  b.c\t,") == " a b \n c \n "


def test_texts_are_scanned_as_often_however_many_candidates_there_are(spark, monkeypatch):
    rows = [("en", " ".join(f"w{i % 50} w{(i * 7) % 50}" for i in range(4000)))]
    docs, scans = spark.createDataFrame(rows, "lang string, text string"), []
    made = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: (scans.append(schema), made(self, f, schema))[1])
    monkeypatch.setattr(co, "READ", 500)
    found = []
    for chars in (6_000_000, 300):
        monkeypatch.setattr(co, "GROUP_CHARS", chars)
        scans.clear()
        counts, words = co.phrase_counts(docs)
        found.append((len(scans), sorted(map(tuple, counts.collect())), words.collect()))
    assert found[0] == found[1] and len(found[0][1]) > 100
