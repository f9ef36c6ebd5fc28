from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from symweave.llm import common, components, exact, nearcopies, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, d string, fp string, root string"


def docs(spark, rows):
    """rows: (doc_id, text); further columns have names that the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", "d", "f", "r") for i, t in rows], DOCS)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


CASES = [
    [],
    [(1, None)],
    [(1, None), (2, ""), (3, " ")],
    [(1, "Aé"), (2, "aé"), (3, "aÉ"), (4, "Á")],
    [(5, "x"), (5, "x"), (5, "x")],
    [(5, "x"), (5, "y"), (6, "y"), (None, "y"), (None, "z")],
    [(i, "copy" if i % 3 else f"own {i}") for i in range(60)],
    [(1, "long " * 50_000), (2, "LONG " * 50_000), (3, "long " * 49_999)],
]


@pytest.mark.parametrize("rows", CASES)
@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_groups(spark, rows, keep):
    classes = {}
    for i, t in rows:
        classes.setdefault(lower(t), []).append(i)
    pick = max if keep == "largest" else min
    best = {t: pick((i for i in ids if i is not None), default=None) for t, ids in classes.items()}
    expected = [(i, best[lower(t)], len(classes[lower(t)]), i == best[lower(t)], hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in rows]
    key = lambda r: [str(x) for x in r]
    assert sorted(map(tuple, exact.exact_groups(docs(spark, rows), keep=keep).collect()), key=key) == sorted(expected, key=key)


@pytest.mark.parametrize("rows", CASES)
def test_drop_copies_keeps_one_of_each_text(spark, rows):
    table = docs(spark, rows)
    out = exact.drop_copies(table)
    assert out.columns == table.columns
    left = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert set(left) <= set(rows)
    assert sorted(lower(t) for _, t in left) == sorted({lower(t) for _, t in rows})
    for i, t in left:
        ids = [j for j, u in rows if lower(u) == lower(t) and j is not None]
        assert i == max(ids, default=None)


def test_a_digest_collision_does_not_join_texts(spark, monkeypatch):
    monkeypatch.setattr(exact, "digest", lambda t: F.unhex(F.lpad(F.length(t).cast("string"), 32, "0")))
    rows = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact.exact_groups(docs(spark, [(1, "aa"), (2, "bb"), (3, "AA"), (4, "c")])).collect()}
    assert rows == {1: (3, 2), 2: (2, 1), 3: (3, 2), 4: (4, 1)}


def test_exact_dedup_stays_on_native_expressions(spark):
    plan = exact.exact_groups(docs(spark, CASES[6]))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|MapIn", plan)


def test_looks_listed_never_misses_a_listed_key(spark):
    listed = spark.range(0, 3000, 3)
    marked = common.looks_listed(spark.range(3000), F.col("id"), listed, F.col("id"), "hit").collect()
    assert all(r["hit"] for r in marked if r["id"] % 3 == 0)
    assert sum(r["hit"] for r in marked) < 1100
    assert not common.looks_listed(spark.range(9), F.col("id"), spark.range(0), F.col("id"), "hit").where("hit").count()


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "One two THREE", "a b c d", "a b c d e a b c d e", "é x ß y z\x1cw v", "w " * 5000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def plain_components(fps, distance):
    fps = list(fps)
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    return {f: find(i) for i, f in enumerate(fps)}


@pytest.mark.parametrize("limit", [simhash.RUN_LIMIT, 6])
@pytest.mark.parametrize("blocks", [5, 6, 8])
def test_links_connect_what_brute_force_connects(spark, limit, blocks):
    rng = random.Random(blocks)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for f in list(fps)[:20]:
        for _ in range(4):
            for b in rng.sample(range(64), rng.randint(1, 5)):
                f ^= 1 << b
            fps.add(f)
    dense = rng.getrandbits(64)
    fps |= {dense ^ (1 << a) ^ (1 << b) for a in range(6) for b in range(8)} | {0, 15, 31}
    signed = [(simhash._signed(f),) for f in fps]
    links = simhash.fingerprint_links(spark.createDataFrame(signed, "fp long"), blocks=blocks, limit=limit)
    assert links.count() < 40 * len(fps)
    roots = {r["node"] & (1 << 64) - 1: r["root"] for r in components.components(links).collect()}
    plain = plain_components(fps, 4)
    groups, expected = {}, {}
    for f in fps:
        groups.setdefault(roots.get(f, f"own {f}"), set()).add(f)
        expected.setdefault(plain[f], set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_plans_of_blocks_grow_with_the_table():
    plans = [simhash.plan_blocks(n) for n in (1, 1000, 10**6, 10**9, 10**11)]
    assert plans == sorted(plans) and plans[0] >= 5
    for k in set(plans):
        masks = simhash.block_masks(k)
        assert len(masks) == len(set(masks)) and all(m < 1 << 64 for m in masks)


BASE = " ".join(f"w{i % 97}x{i % 13}" for i in range(400))
NEAR = [(3, BASE), (1, BASE), (2, BASE + " tail"), (7, "quite another text with words of its own"), (9, None), (8, ""), (7, "quite another text with words of its own"), (4, BASE.upper())]


def test_near_groups_and_one_of_each_stays(spark):
    rows = {(r["doc_id"], r["component_id"]) for r in simhash.near_groups(docs(spark, NEAR)).collect()}
    linked = (plain_fingerprint(BASE) ^ plain_fingerprint(BASE + " tail")).bit_count() <= 4
    assert rows == {(1, 1), (2, 1 if linked else 2), (3, 1), (4, 1), (7, 7), (8, 8), (9, 8)}
    left = simhash.drop_near_copies(docs(spark, NEAR))
    assert left.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    assert sorted(r["doc_id"] for r in left.collect()) == sorted({c for _, c in rows})


@pytest.mark.parametrize("rows", [[], [(None, "a b c"), (None, "a b c")], [(1, "a b c d e"), (1, "z y x w v u")], [(2, "same"), (2, "same"), (1, "same")]])
def test_near_dedup_of_odd_tables(spark, rows):
    left = [(r["doc_id"], r["text"]) for r in simhash.drop_near_copies(docs(spark, rows)).collect()]
    assert sorted({t for _, t in left}) == sorted({t for _, t in rows})
    assert len(left) == len({t for _, t in rows})


def test_components_of_chains_stars_and_odd_links(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(200, 200), (None, 3), (5, None), (300, 299), (299, 300)]
    rng.shuffle(links)
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 160)} | {299: 299, 300: 299}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert np.bitwise_count(np.uint64(7)) == 3


def test_columns_of_any_name_are_kept(spark):
    names = ["doc_id", "text", "__id", "__sha", "__shared", "__place", "__bucket", "__bits", "__look", "__row", "__print", "rows", "fp", "root", "component_id"]
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(i, t, *[f"{n}{i}" for n in names[2:]]) for i, t in enumerate([long, long.upper(), long, "other", None, "", f"{long} x"])] + [(3, "other", *["again"] * 13)]
    docs = spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"{n} string" for n in names[1:]))
    apart = (simhash.fingerprint(long) ^ simhash.fingerprint(f"{long} x")).bit_count() > simhash.MAX_DISTANCE
    for drop, kept in ((exact.drop_copies, {2, 3, 5, 6}), (simhash.drop_near_copies, {0, 3, 4} | ({6} if apart else set())), (nearcopies.drop_near_copies, {0, 3, 4})):
        out = drop(docs)
        found = [tuple(r) for r in out.collect()]
        assert out.columns == names and {r[0] for r in found} == kept and len(found) == len(kept) and set(found) <= set(rows)
