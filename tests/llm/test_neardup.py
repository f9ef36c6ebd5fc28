from __future__ import annotations

import random

import numpy as np
import pytest

from symweave.llm import neardup


def plain(rows, threshold=0.95):
    """(n_links, component) by id, by brute force; ids differ."""
    good = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = list(good)
    links = {i: [j for j in ids if j != i and len(good[i]) == len(good[j]) and good[i] @ good[j] / np.linalg.norm(good[i]) / np.linalg.norm(good[j]) >= threshold] for i in ids}
    root = {}
    for i in sorted(ids):
        todo = [i] if i not in root else []
        while todo:
            k = todo.pop()
            if k not in root:
                root[k] = i
                todo += links[k]
    return {i: (len(links.get(i, ())), root.get(i, i)) for i, _ in rows}


def vectors(n, dim=16, groups=6, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=dim).tolist()) for i in range(n)]
    at = n
    for g in range(groups):
        base = rng.normal(size=dim)
        for _ in range(10 + 5 * g):
            rows.append((at, (base + rng.normal(size=dim) * rng.choice([0.02, 0.1, 0.25])).tolist()))
            at += 1
    for k in range(5):
        rows += [(at, rows[k][1]), (at + 1, [2 * x for x in rows[k][1]])]
        at += 2
    rows += [(at, None), (at + 1, []), (at + 2, [0.0] * dim), (at + 3, [None] + [1.0] * (dim - 1)), (at + 4, [float("nan")] * dim), (at + 5, [float("inf")] * dim), (at + 6, [1.0, 1.0]), (at + 7, [1.0, 1.1])]
    random.Random(seed).shuffle(rows)
    return rows


def run(spark, rows):
    table = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], "vec_id long, embedding array<float>, label int, rep string, w int")
    return neardup.near_groups(table).collect()


@pytest.mark.parametrize("cell", [neardup.CELL_ROWS, 40])
def test_links_and_components(spark, monkeypatch, cell):
    monkeypatch.setattr(neardup, "CELL_ROWS", cell)
    monkeypatch.setattr(neardup, "SHARD_ROWS", 100)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in vectors(150)]
    got = run(spark, rows)
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == plain(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert {r["audit_recall"] for r in got} == {1.0}


def test_odd_tables(spark):
    assert run(spark, []) == []
    assert [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in run(spark, [(4, None)])] == [(4, 0, 4, True)]
    one = [1.0, 2.0]
    got = {(r["vec_id"], r["n_links"], r["component_id"]) for r in run(spark, [(5, one), (5, one), (3, one), (None, one)])}
    assert got == {(5, 2, 3), (3, 2, 3), (None, 0, None)}


def test_graph_search_finds_what_is_in_range():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(5, 32))
    x = neardup.unit(np.concatenate([rng.normal(size=(300, 32)), *[b + rng.normal(size=(60, 32)) * 0.1 for b in base]]))
    lists = neardup.robust_graph(x)
    assert max(map(len, lists)) < 200 and all(i not in row for i, row in enumerate(lists))
    q, v, stuck = neardup.search_in_range(x, lists, 0.95)
    assert stuck < 0.2 * len(x)
    truth = {(int(a), int(b)) for a, b in zip(*np.nonzero(x @ x.T >= 0.95), strict=True) if a != b}
    found = set(zip(q.tolist(), v.tolist(), strict=True))
    assert found <= truth and len(found) >= 0.99 * len(truth) and len(q) == len(found)
    assert len(neardup.search_in_range(x[:1], neardup.robust_graph(x[:1]), 0.95)[0]) == 0


def test_an_audit_below_the_bound_widens_the_index_and_is_an_error_at_last(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(neardup, "_audit", lambda *a: 0.5)
    linked = neardup._linked
    monkeypatch.setattr(neardup, "_linked", lambda v, c, overlap, t: seen.append(overlap) or linked(v, c, overlap, t))
    with pytest.raises(RuntimeError, match="0.500"):
        run(spark, [(i, [float(i % 7 + 1), float(i % 3), 1.0]) for i in range(20)])
    assert seen == [3, 6, 12]


def test_searches_start_where_walks_arrive(monkeypatch):
    """With walks that go nowhere all but the medoid's surroundings is searched from the vectors themselves."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(4, 16))
    x = neardup.unit(np.repeat(base, 30, axis=0) + rng.normal(size=(120, 16)) * 0.02)
    lists = neardup.robust_graph(x)
    q, v, stuck = neardup.search_in_range(x, lists, 0.95)
    assert len(q) == 4 * 30 * 29 and stuck == 0
    visited = []
    monkeypatch.setattr(neardup, "_walk", lambda x, graph: visited.append(1) or (np.full(len(x), 0), x @ x[0]))
    again = neardup.search_in_range(x, lists, 0.95)
    assert visited and again[2] == 90 and len(again[0]) == len(q)
    # arrived beside itself, a search sees what is linked there and nothing of its own list
    alone = [np.zeros(0, np.int64) for _ in x]
    assert set(zip(*neardup.search_in_range(x, alone, 0.95)[:2], strict=True)) <= {(i, 0) for i in range(1, 30)}


def test_recall_is_null_where_nothing_links(spark):
    got = run(spark, [(i, np.eye(12)[i].tolist()) for i in range(12)])
    assert {(r["n_links"], r["kept"], r["audit_recall"]) for r in got} == {(0, True, None)}


@pytest.mark.parametrize("scale", [1.0, 1e300, 1e-300])
def test_doubles_are_compared_as_they_are(spark, scale):
    """A pair that rounding to floats would part or join, at any size."""
    a = [1.0, 0.0]
    inside, outside = 0.95 + 1e-12, 0.95 - 1e-12
    rows = [(1, a), (2, [inside, -((1 - inside**2) ** 0.5)]), (3, [outside, (1 - outside**2) ** 0.5])]
    table = spark.createDataFrame([(i, [x * scale for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    assert {r["vec_id"]: r["n_links"] for r in neardup.near_groups(table).collect()} == {1: 1, 2: 1, 3: 0}


def test_large_clusters_are_split_by_centroids_of_their_own(spark, monkeypatch):
    for name, value in (("CELL_ROWS", 60), ("SPLIT_ROWS", 120), ("SHARD_ROWS", 40), ("SAMPLE", 40), ("SPLIT_SAMPLE", 200), ("ASSIGN_ROWS", 50)):
        monkeypatch.setattr(neardup, name, value)
    seen, split = [], neardup._split

    def watched(assigned, overlap, threshold):
        out = split(assigned, overlap, threshold)
        seen.append((assigned.select("shard").distinct().count(), out.select("shard").distinct().count(), out.groupBy("rep", "v", "shard").count().where("count > 1").count()))
        return out

    monkeypatch.setattr(neardup, "_split", watched)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in vectors(900, dim=8, groups=12)]
    got = run(spark, rows)
    truth = plain(rows)
    assert seen and all(after > 3 * before and twice == 0 for before, after, twice in seen)
    links = sum(n for n, _ in truth.values())
    assert all(r["n_links"] <= truth[r["vec_id"]][0] for r in got)
    assert 0.97 * links <= sum(r["n_links"] for r in got) and {r["audit_recall"] >= 0.9 for r in got} == {True}


def tight_families(families, size, cosine, dim=64, seed=1):
    """Families of very tight vectors around centres that have this cosine with each other."""
    rng = np.random.default_rng(seed)
    base = np.linalg.qr(rng.normal(size=(dim, families + 1)))[0].T
    centres = np.sqrt(cosine) * base[0] + np.sqrt(1 - cosine) * base[1:]
    return np.repeat(centres, size, axis=0) + rng.normal(size=(families * size, dim)) * 2e-4


@pytest.mark.parametrize(("families", "size", "cosine"), [(3, 100, 0.97), (6, 100, 0.97), (10, 60, 0.99)])
def test_tight_families_in_range_of_each_other_are_linked(families, size, cosine):
    x = neardup.unit(tight_families(families, size, cosine))
    q, _, _ = neardup.search_in_range(x, neardup.robust_graph(x), 0.95)
    assert len(q) >= 0.98 * len(x) * (len(x) - 1)


def test_cells_are_compared_exactly_if_the_graph_does_not_do(spark, monkeypatch):
    monkeypatch.setattr(neardup, "_linked", lambda v, c, overlap, t: v.sparkSession.createDataFrame([], "rep long, links long, root long"))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(tight_families(3, 60, 0.97))]
    got = run(spark, rows)
    assert {(r["n_links"], r["component_id"], r["audit_recall"]) for r in got} == {(179, 0, 1.0)}


def test_an_audit_of_few_links_takes_others_in(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(3000, 24))
    base[2980:] = base[:20] + 0.001 * rng.normal(size=(20, 24))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "vec_id long, embedding array<float>")
    seen, audited = [], neardup._audited

    def noted(*a):
        seen.append(audited(*a))
        return seen[-1]

    monkeypatch.setattr(neardup, "_audited", noted)
    got = neardup.near_groups(table).collect()
    assert {r["audit_recall"] for r in got} == {1.0} and sum(r["n_links"] for r in got) == 40
    assert [x[2] for x in seen] == [512, 2048, 3000] and seen[-1][:2] == (40, 40)
