from __future__ import annotations

import os
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from symweave.llm import exact, mixing, packing, quality, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
here = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def shingles_of(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


@here
def test_stages_take_effect_on_all_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, before, SF)
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "packing":
            assert docs.columns == columns
        rows = Counter((r["doc_id"], r["text"]) for r in before.collect())
        if name == "quality":
            weights = quality.train_quality(before, spark.read.parquet(f"{SF}/labels.parquet"))
            features = quality.Features()
            expected = Counter({k: n for k, n in rows.items() if quality.score_text(weights, features, k[1]) >= quality.THRESHOLD})
        elif name == "exact_dedup":
            classes = {}
            for i, t in rows:
                classes.setdefault(t.encode().lower(), []).append((i, t))
            expected = Counter(max(c) for c in classes.values())
        elif name == "near_dedup":
            # the standing rule, by brute force: five-word shingles at a Jaccard similarity of 0.8 or more
            sets = {k: shingles_of(k[1]) for k in rows}
            left = sorted(rows)
            expected = Counter()
            while left:
                group, left, todo = [], left[1:], [left[0]]
                while todo:
                    a = todo.pop()
                    group.append(a)
                    near = [b for b in left if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
                    left = [b for b in left if b not in near]
                    todo += near
                expected[min(group)] += 1
        elif name == "mixing":
            expected = Counter()
            texts = dict(rows)
            for r in mixing.mix_plan(before).collect():
                expected[r["id"]] += r["copies"]
            assert Counter(r["doc_id"] for r in docs.collect()) == +expected and texts
            continue
        else:
            packed = Counter(r["doc_id"] for r in docs.collect() if r["piece"] == 0)
            assert packed == Counter(i for (i, _), n in rows.items() for _ in range(n))
            # run() is these stages, one after the other
            said = lambda df: Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
            assert said(corpus_pipeline.run(spark, SF)) == said(docs)
            continue
        assert Counter((r["doc_id"], r["text"]) for r in docs.collect()) == expected


def test_odd_tables_pass_all_stages(spark, tmp_path):
    good = "a calm line of plain words that people read and write about the {} of the day {}"
    rows = [(i, good.format(i, i * 7), "s", f"x{i}") for i in range(60)] + [(i, "BUY!! NOW$$$ click### free&&& win%%%" * 3, "t", "y") for i in range(60, 100)]
    rows += [(None, None, None, None), (None, good.format(1, 2), "s", "z"), (7, good.format(7, 49), "s", "x7"), (200, "", "s", "e"), (201, "word " * 60_000 + "end", "s", "long")]
    ddl = "doc_id long, text string, source string, __score string"
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(100)], "doc_id long, quality int")
    for n, (some, taught) in enumerate([(rows, labels), (rows, labels.limit(0)), (rows[:0], labels)]):
        folder = str(tmp_path / f"t{n}")
        spark.createDataFrame(some, ddl).write.parquet(f"{folder}/documents.parquet")
        taught.write.parquet(f"{folder}/labels.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        left = {}
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, folder).write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            left[name] = docs.count()
            assert name == "packing" or docs.columns == ["doc_id", "text", "source", "__score"]
        assert left["exact_dedup"] <= left["quality"] <= len(some) and (left["packing"] > 0) == bool(some)
        if n == 1:
            assert left["quality"] == len(rows)


@here
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = con.execute(queries.oracle_sql()[name])
    names = sorted(d[0] for d in cursor.description)
    at = [[d[0] for d in cursor.description].index(n) for n in names]
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == names
    assert sorted(repr(tuple(r[c] for c in names)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in cursor.fetchall())


@here
def test_every_operator_has_one_query_over_its_whole_table(spark):
    found = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in found) == list(range(1, 11))
    for name, table in (("op1", "documents"), ("op2", "embeddings"), ("op5", "documents"), ("op7", "pages"), ("op10", "documents")):
        query = next(q for n, q in found.items() if n.startswith(name + "_"))
        assert query(spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert set(entry.queries()) >= {*found, "pipeline"}


def test_entry_works_without_the_subpackage(tmp_path):
    """A copy of the repository without the folders of these operators still imports."""
    root = Path(corpus_pipeline.__file__).parent
    for p in [root / "__spark_entry__.py", *(root / "symweave").rglob("*.py")]:
        to = tmp_path / p.relative_to(root)
        if "llm" not in to.parts:
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_bytes(p.read_bytes())
    code = "import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env={**os.environ, "PYTHONPATH": ""})


def test_nothing_else_imports_the_subpackage():
    root = Path(corpus_pipeline.__file__).parent / "symweave"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "llm" not in p.read_text(), p
    assert exact and packing
