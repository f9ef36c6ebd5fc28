"""Embedding near-dedup on robust-pruned flat graphs.

1. Equal vectors are collapsed to one with a weight, so copies cost nothing further on.
2. Centroids are fitted on a bounded sample, no two of them within the threshold of each other, so that
   a tight family is not cut up; every vector is indexed in its OVERLAP nearest clusters. A cluster of
   more than SPLIT_ROWS is split by centroids of its own, level by level, so the number of clusters
   grows with the table. What is left too large for one task, as a dense clump, is cut into chunks, and
   each pair of chunks is a cell of its own, so nothing is cut off and no task is unbounded.
3. Each cell builds a flat graph by robust pruning of its nearest candidates, and adds far edges: to
   the nearest of thinner and thinner samples and to a few members at random, so that tight families
   are not shut off from each other. The adjacency lists of a vector are united over its cells.
4. Each cell searches for all its vectors on the united graph: greedily from the medoid, and where
   the walk arrived in range, from neighbour to neighbour as far as they are in range or within SLACK
   of it. A walk that gets stuck out of range is counted, and goes on from the vector's own list.
   What is found is verified by cosine in double precision.
5. A pair that several cells hold is counted in one of them only, which both ends know from the
   clusters they are in. So counts are sums, and no cell emits its pairs: it returns a count
   and a root for each vector.
6. An audit compares the links of some vectors, half of them found to have links, with brute force over
   all rows, and takes more vectors while they hold few links. Below RECALL the index is rebuilt with
   more overlap, candidates and degree; if that does not help, the cells are compared exactly, in
   blocks; a recall that stays below LEAST_RECALL is an error.

Defined results: null, empty and zero vectors and those with null or non-finite components
link with nothing, nor do vectors of different lengths; rows with a null id take no part and
have a null component; rows that share an id are one vector as far as links go; repeated rows
count as other vectors; vectors are compared as they are, floats or doubles of any size; where no
audited vector has a link the recall is null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import bounded_by_hash, discard, small_batches, table, tidy, written
from .components import components

THRESHOLD = 0.95
#: Vectors that centroids are fitted on, at most about; and vectors for each centroid.
SAMPLE, SHARD_ROWS = 20_000, 1000
OVERLAP = 3
#: Rows of a cell, at most about; larger clusters are cut into chunks of half of it.
CELL_ROWS = 4000
#: Rows of a cluster that is split, so many times at most; rows that its centroids are fitted on, and rows of a task that assigns.
SPLIT_ROWS, LEVELS, SPLIT_SAMPLE, ASSIGN_ROWS = 8 * CELL_ROWS, 4, 4000, 20_000
CANDIDATES, DEGREE, ALPHA = 48, 16, 1.2
#: Far edges of a vector: to each sample, one in THIN of the one before, and to members at random.
FAR, THIN, AT_RANDOM = 4, 8, 2
SLACK = 0.1
AUDIT, RECALL, LEAST_RECALL, ATTEMPTS = 512, 0.98, 0.9, 3
#: True links that an audit should hold, and the most vectors that it takes for that.
AUDIT_LINKS, MOST_AUDITED = 2000, 8192
#: Pairs handled together in a search.
STEP_PAIRS = 200_000


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)  # squares of very large or small numbers would not be finite or zero
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def fit_centroids(x: np.ndarray, k: int, apart: float = THRESHOLD, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from spread starting points, x being unit vectors in a fixed order; of
    centroids whose cosine is `apart` or more the first stays."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 0, sums / np.maximum(size, 1e-300), c)
    free, keep = np.ones(len(c), bool), []
    for i in range(len(c)):
        if free[i]:
            keep.append(i)
            free &= c @ c[i] < apart
    return c[keep]


def robust_graph(x: np.ndarray, candidates: int = CANDIDATES, degree: int = DEGREE, alpha: float = ALPHA) -> list[np.ndarray]:
    """Adjacency lists: of the nearest candidates, those that no kept one is much closer to; both ways."""
    m = len(x)
    if m == 1:
        return [np.zeros(0, np.int64)]
    f = x.astype(np.float32)
    n = min(candidates, m - 1)
    near = np.empty((m, n), np.int64)
    sim = np.empty((m, n), np.float32)
    for i in range(0, m, 512):
        s = f[i : i + 512] @ f.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -2
        top = np.argpartition(-s, n - 1, axis=1)[:, :n]
        val = np.take_along_axis(s, top, 1)
        order = np.lexsort((top, -val))
        near[i : i + 512], sim[i : i + 512] = np.take_along_axis(top, order, 1), np.take_along_axis(val, order, 1)
    out_a, out_b = [], []
    for i in range(0, m, 256):
        cand, val = near[i : i + 256], sim[i : i + 256]
        rows = np.arange(len(cand))
        vectors = f[cand]
        between = 1 - np.einsum("mad,mbd->mab", vectors, vectors)
        away = 1 - val
        alive = np.ones(cand.shape, bool)
        for _ in range(degree):
            pick = alive.argmax(axis=1)
            on = alive[rows, pick]
            if not on.any():
                break
            out_a.append(i + rows[on])
            out_b.append(cand[rows, pick][on])
            # squared distances: alpha enters as its square
            alive &= ~((alpha * alpha * between[rows, pick] <= away) & on[:, None])
            alive[rows, pick] = False
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    far_a, far_b = _far_edges(f) if m > n + 1 else (a[:0], b[:0])
    pairs = np.unique(np.concatenate((a * m + b, b * m + a, far_a * m + far_b)))
    return np.split(pairs % m, np.searchsorted(pairs // m, np.arange(1, m)))


def _far_edges(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One way to the nearest of each sample, both ways to members at random; chosen by the vectors, not by their places."""
    m, d = f.shape
    order = np.lexsort((f[:, 0], (f.astype(np.float64) @ np.random.default_rng(d).normal(size=d) * 1e4) % 1))
    out_a, out_b = [], []
    size = m // THIN
    while size:
        sample = order[:size]
        for i in range(0, m, 512):
            s = f[i : i + 512] @ f[sample].T
            k = min(FAR, size)
            top = sample[np.argpartition(-s, k - 1, axis=1)[:, :k]].ravel()
            a = np.repeat(np.arange(i, i + len(s)), k)
            out_a.append(a[a != top])
            out_b.append(top[a != top])
        size //= THIN
    for r in range(AT_RANDOM):
        other = order[np.random.default_rng(r).permutation(m)]
        on = order != other
        out_a += [order[on], other[on]]
        out_b += [other[on], order[on]]
    return np.concatenate(out_a), np.concatenate(out_b)


def all_in_range(x: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """search_in_range() by comparing all, in blocks."""
    out = []
    for i in range(0, len(x), 256):
        q, v = np.nonzero(x[i : i + 256] @ x.T >= threshold)
        out.append(np.stack((q + i, v)))
    q, v = np.concatenate(out, axis=1)
    return q[q != v], v[q != v]


def search_in_range(x: np.ndarray, lists: list[np.ndarray], threshold: float, slack: float = SLACK) -> tuple[np.ndarray, np.ndarray, int]:
    """(query, found) for each ordered pair of different vectors found with cosine >= threshold; how many walks got stuck."""
    m = len(x)
    degree = max(1, max(map(len, lists)))
    graph = np.full((m, degree), -1, np.int64)
    for i, row in enumerate(lists):
        graph[i, : len(row)] = row
    at, best = _walk(x, graph)
    # what is in range of the query is reached from where its walk arrived; out of range, the walk is stuck
    stuck = best < threshold - slack
    q, v = np.arange(m), np.where(stuck, np.arange(m), at)
    seen = np.zeros((m, m), bool)
    found_q, found_v = [], []
    seen[q, v] = True
    frontier = [(q, v)]
    while frontier:
        q, v = frontier.pop()
        ok = (q != v) & (np.einsum("nd,nd->n", x[q], x[v]) >= threshold)
        found_q.append(q[ok])
        found_v.append(v[ok])
        for i in range(0, len(q), STEP_PAIRS // degree + 1):
            part = slice(i, i + STEP_PAIRS // degree + 1)
            nbr = graph[v[part]]
            code = (q[part][:, None] * m + nbr)[nbr >= 0]
            code = code[~seen.reshape(-1)[code]]
            code = np.unique(code)
            nq, nv = code // m, code % m
            seen[nq, nv] = True
            near = np.empty(len(nq), bool)
            for j in range(0, len(nq), 50_000):
                near[j : j + 50_000] = np.einsum("nd,nd->n", x[nq[j : j + 50_000]], x[nv[j : j + 50_000]]) >= threshold - slack
            if near.any():
                frontier.append((nq[near], nv[near]))
    return np.concatenate(found_q), np.concatenate(found_v), int(stuck.sum())


def _walk(x: np.ndarray, graph: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where greedy walks from the medoid arrive, one for each vector as query, and the cosine there.

    Each query goes to the best neighbour until none is better, as it is not at itself.
    """
    m = len(x)
    medoid = int((x @ x.mean(axis=0)).argmax())
    at, best = np.full(m, medoid), x @ x[medoid]
    active = np.nonzero(at != np.arange(m))[0]
    while len(active):
        nbr = graph[at[active]]
        s = np.empty(nbr.shape)
        for i in range(0, len(active), 2048):
            s[i : i + 2048] = np.einsum("qrd,qd->qr", x[nbr[i : i + 2048]], x[active[i : i + 2048]])
        s[nbr < 0] = -2
        pick = s.argmax(axis=1)
        rows = np.arange(len(active))
        better = s[rows, pick] > best[active]
        active, pick_id, pick_s = active[better], nbr[rows, pick][better], s[rows, pick][better]
        at[active], best[active] = pick_id, pick_s
        active = active[at[active] != active]
    return at, best


def _usable(column: str) -> F.Column:
    v = F.col(column)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _centroids(vectors: DataFrame, threshold: float) -> dict[int, np.ndarray]:
    """By length of vector, from the bounded sample."""
    n = vectors.count()
    rows = bounded_by_hash(vectors, F.col("rep"), n, SAMPLE).orderBy("rep", F.xxhash64("v")).select("v").toArrow().column("v").to_pylist()
    out = {}
    for d in {len(r) for r in rows}:
        x = unit(np.array([r for r in rows if len(r) == d]))
        k = max(1, min(-(-n * len(x) // (max(1, len(rows)) * SHARD_ROWS)), len(x) // 10))
        out[d] = fit_centroids(x, k, threshold)
    return out


def _nearest(x: np.ndarray, c: np.ndarray, overlap: int) -> np.ndarray:
    return np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :overlap]


def _assigned(vectors: DataFrame, centroids: dict[int, np.ndarray], overlap: int) -> DataFrame:
    """(rep, w, v, homes, dim, shard): a row for each cluster a vector is indexed in; homes are all of them."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = np.array([len(v) for v in b.column("v")])
            for d in np.unique(lengths):
                on = np.nonzero(lengths == d)[0]
                part = b.take(pa.array(on))
                c = shared.value.get(int(d))
                top = np.zeros((len(on), 1), np.int64) if c is None else _nearest(unit(_matrix(part.column("v"))), c, overlap)
                homes = pa.array(np.sort(top, axis=1).tolist(), pa.list_(pa.int64()))
                for j in range(top.shape[1]):
                    yield pa.RecordBatch.from_arrays(
                        [part.column("rep"), part.column("w"), part.column("v"), homes, pa.array(np.full(len(on), d, np.int32)), pa.array(top[:, j].astype(np.int64))],
                        ["rep", "w", "v", "homes", "dim", "shard"],
                    )

    kind = vectors.schema["v"].dataType.simpleString()
    return vectors.mapInArrow(assign, f"rep long, w long, v {kind}, homes array<long>, dim int, shard long")


def _split(assigned: DataFrame, overlap: int, threshold: float) -> DataFrame:
    """assigned with clusters of more than SPLIT_ROWS replaced by clusters inside them.

    A cluster's centroids come from a bounded sample of it, in a task of their own; its rows meet
    them in groups of about ASSIGN_ROWS. A cluster that has one centroid only is left as it is.
    """
    rows, kind = assigned, assigned.schema["v"].dataType.simpleString()
    tried, any_split = None, False
    for _ in range(LEVELS):
        large = rows.groupBy("dim", "shard").agg(F.count("*").alias("n")).where(F.col("n") > SPLIT_ROWS)
        large = written(large if tried is None else large.join(tried, ["dim", "shard"], "left_anti"), "large")
        if large.isEmpty():
            break
        sample = rows.join(large, ["dim", "shard"]).where(F.pmod(F.xxhash64("rep", "v", F.lit(5)), F.col("n")) < SPLIT_SAMPLE)

        def fit(part: pa.Table) -> pa.Table:
            order = np.lexsort((part.column("at").to_numpy(), part.column("rep").to_numpy()))
            x = unit(_matrix(part.column("v").combine_chunks()))[order]
            c = fit_centroids(x, max(1, min(-(-part.column("n")[0].as_py() // SHARD_ROWS), len(x) // 10)), threshold)
            return pa.table({"dim": part.column("dim")[:1], "shard": part.column("shard")[:1], "n": part.column("n")[:1], "c": pa.array([c.ravel().tolist()], pa.list_(pa.float64()))})

        inner = sample.select("dim", "shard", "n", "rep", F.xxhash64("v").alias("at"), "v").groupBy("dim", "shard").applyInArrow(fit, "dim int, shard long, n long, c array<double>")
        inner = written(inner, "inner")
        one = inner.where(F.size("c") <= F.col("dim")).select("dim", "shard")
        tried = written(one if tried is None else one.unionByName(tried), "tried")
        inner = inner.where(F.size("c") > F.col("dim")).withColumn("turns", F.ceil(F.col("n") / ASSIGN_ROWS).cast("int"))
        if inner.isEmpty():
            break
        any_split = True
        moved = rows.join(inner.select("dim", "shard", "turns"), ["dim", "shard"]).withColumn("turn", F.pmod(F.xxhash64("rep", "v"), F.col("turns")).cast("int"))
        heads = inner.select("dim", "shard", "c", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"))

        def assign(part: pa.Table, head: pa.Table) -> pa.Table:
            shard = head.column("shard")[0].as_py()
            c = np.array(head.column("c")[0].as_py()).reshape(-1, head.column("dim")[0].as_py())
            top = _nearest(unit(_matrix(part.column("v").combine_chunks())), c, overlap)
            out = [
                part.select(["rep", "w", "v", "dim"]).append_column("shard", pa.array((shard * 1_000_003 + 1) % (1 << 62) + top[:, j])) for j in range(top.shape[1])
            ]
            return pa.concat_tables(out)

        new = moved.select("rep", "w", "v", "dim", "shard", "turn").groupBy("dim", "shard", "turn")
        new = new.cogroup(heads.groupBy("dim", "shard", "turn")).applyInArrow(assign, f"rep long, w long, v {kind}, dim int, shard long")
        kept = rows.join(inner.select("dim", "shard"), ["dim", "shard"], "left_anti").select("rep", "w", "v", "dim", "shard")
        rows = written(kept.unionByName(new), "split")
    if not any_split:
        return assigned
    homes = rows.groupBy("rep", "v", "w", "dim").agg(F.array_sort(F.collect_set("shard")).alias("homes"))
    return homes.select("rep", "w", "v", "homes", "dim", F.explode("homes").alias("shard"))


def _cells(assigned: DataFrame) -> DataFrame:
    """assigned with chunk, and the cell (dim, shard, i, j); clusters of one chunk have one cell."""
    sizes = assigned.groupBy("dim", "shard").agg(F.count("*").alias("n"))
    sizes = sizes.select("dim", "shard", F.when(F.col("n") <= CELL_ROWS, 1).otherwise(F.ceil(F.col("n") / (CELL_ROWS // 2))).cast("int").alias("chunks"))
    rows = assigned.join(sizes, ["dim", "shard"]).withColumn("chunk", F.pmod(F.xxhash64("rep", "v"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return rows.select("rep", "w", "v", "homes", "dim", "shard", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))


_CELL = ["dim", "shard", "i", "j"]


def _build(more: int):
    def build(table_: pa.Table) -> pa.Table:
        rep = table_.column("rep").to_numpy()
        lists = robust_graph(unit(_matrix(table_.column("v").combine_chunks())), CANDIDATES * more, DEGREE * more)
        return pa.table({"rep": pa.array(rep), "near": pa.array([rep[x].tolist() for x in lists], pa.list_(pa.int64()))})

    return build


def _search(threshold: float, exact: bool = False):
    def search(table_: pa.Table) -> pa.Table:
        rep, w = table_.column("rep").to_numpy(), table_.column("w").to_numpy()
        shard, i, j = (table_.column(c)[0].as_py() for c in ("shard", "i", "j"))
        chunk = table_.column("chunk").to_numpy()
        x = unit(_matrix(table_.column("v").combine_chunks()))
        if exact:
            (q, v), walks, stuck = all_in_range(x, threshold), 0, 0
        else:
            place: dict[int, list[int]] = {}
            for k, r in enumerate(rep.tolist()):
                place.setdefault(r, []).append(k)
            lists = [np.array(sorted({k for r in near for k in place.get(r, ())}), np.int64) for near in table_.column("near").to_pylist()]
            walks = len(rep)
            q, v, stuck = search_in_range(x, lists, threshold)
        other = rep[q] != rep[v]
        q, v = q[other], v[other]
        # the one cell that counts a pair: the first cluster that both are in, and there the chunks of the two
        homes = table_.column("homes").to_pylist()
        width = max(map(len, homes))
        grid = np.array([h + [-1] * (width - len(h)) for h in homes], np.int64)
        common = np.full(len(q), np.iinfo(np.int64).max)
        for a in range(width):
            h = grid[q, a]
            shared = (h[:, None] == grid[v]).any(axis=1) & (h >= 0)
            common = np.where(shared, np.minimum(common, h), common)
        own = (common == shard) & (np.minimum(chunk[q], chunk[v]) == i) & (np.maximum(chunk[q], chunk[v]) == j)
        links = np.bincount(q[own], weights=w[v[own]], minlength=len(rep)).astype(np.int64)
        root = np.arange(len(rep))
        while len(q):
            new = root.copy()
            np.minimum.at(new, q, root[v])
            np.minimum.at(new, root, new.copy())
            new = new[new]
            if (new == root).all():
                break
            root = new
        keep = np.unique(q)
        # the last row, of no vector, tells how many walks got stuck, of how many
        return pa.table({
            "rep": pa.array([*rep[keep].tolist(), None], pa.int64()), "links": pa.array([*links[keep].tolist(), stuck], pa.int64()),
            "root": pa.array([*rep[root[keep]].tolist(), walks], pa.int64()),
        })

    return search


def _indexed(vectors: DataFrame, centroids: dict[int, np.ndarray], overlap: int, threshold: float) -> DataFrame:
    first = written(_assigned(vectors, centroids, overlap), "assigned")
    return written(_cells(_split(first, overlap, threshold)), "cells")


def _linked(vectors: DataFrame, centroids: dict[int, np.ndarray], overlap: int, threshold: float) -> DataFrame:
    cells = _indexed(vectors, centroids, overlap, threshold)
    graph = cells.groupBy(*_CELL).applyInArrow(_build(max(1, overlap // OVERLAP)), "rep long, near array<long>")
    united = graph.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    both = cells.join(united, "rep")
    found = written(both.groupBy(*_CELL).applyInArrow(_search(threshold), "rep long, links long, root long"), "found")
    discard(cells)
    return found


def _linked_exactly(vectors: DataFrame, centroids: dict[int, np.ndarray], overlap: int, threshold: float) -> DataFrame:
    cells = _indexed(vectors, centroids, overlap, threshold)
    found = written(cells.groupBy(*_CELL).applyInArrow(_search(threshold, exact=True), "rep long, links long, root long"), "found")
    discard(cells)
    return found


def _audit(vectors: DataFrame, found: DataFrame, threshold: float) -> float | None:
    """Share of the links of some vectors, found by brute force, that the search found; null where they have none."""
    size, linked = AUDIT, found.where("links > 0 AND rep IS NOT NULL").select("rep").distinct().count()
    while True:
        truth, got, taken = _audited(vectors, found, threshold, min(size // 2, linked), size)
        if truth >= AUDIT_LINKS or taken < size or size >= MOST_AUDITED:  # fewer are there only where all are in
            return got / truth if truth else None
        size *= 4


def _audited(vectors: DataFrame, found: DataFrame, threshold: float, linked: int, size: int) -> tuple[int, int, int]:
    """Links of `size` vectors by brute force, those of them that were found, and the vectors there were.

    So many of them as `linked` says are of those found to have links, so that there is something to count; the
    rest are others, so that vectors whose links were all missed come in.
    """
    order = [F.xxhash64("rep", F.lit(11)), "rep"]
    some = vectors.join(found.where("links > 0 AND rep IS NOT NULL").select("rep").distinct(), "rep", "left_semi").orderBy(*order).limit(linked).select("rep").distinct()
    others = vectors.join(F.broadcast(some), "rep", "left_anti").orderBy(*order).limit(size - linked).select("rep").distinct()
    queries = vectors.join(F.broadcast(some.union(others)), "rep", "left_semi").select("rep", "v").toArrow()  # some `size` rows at most, but for rows that share an id
    ids, rows = queries.column("rep").to_numpy(), queries.column("v").to_pylist()
    by = {d: [k for k, r in enumerate(rows) if len(r) == d] for d in {len(r) for r in rows}}
    matrices = {d: unit(np.array([rows[k] for k in ks])) for d, ks in by.items()}
    shared = vectors.sparkSession.sparkContext.broadcast((ids, by, matrices))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, by, matrices = shared.value
        total = np.zeros(len(ids), np.int64)
        for b in batches:
            lengths = np.array([len(v) for v in b.column("v")])
            for d, ks in by.items():
                part = b.take(pa.array(np.nonzero(lengths == d)[0]))
                if part.num_rows:
                    near = unit(_matrix(part.column("v"))) @ matrices[d].T >= threshold
                    near &= part.column("rep").to_numpy()[:, None] != ids[ks]
                    total[ks] += part.column("w").to_numpy() @ near
        yield pa.RecordBatch.from_pydict({"rep": pa.array(ids), "truth": pa.array(total)})

    truth = vectors.mapInArrow(count, "rep long, truth long").groupBy("rep").agg(F.sum("truth").alias("truth"))
    got = found.groupBy("rep").agg(F.sum("links").alias("links"))
    both = truth.where("rep IS NOT NULL").join(got, "rep", "left").agg(F.sum("truth"), F.sum(F.least("truth", F.coalesce("links", F.lit(0))))).first()
    return both[0] or 0, both[1] or 0, len(ids)


@tidy
def near_groups(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(key, n_links, component_id, kept, audit_recall, walks_stuck) for every row.

    The last two are of the whole index: the audited recall, and the share of walks that got stuck.
    """
    small_batches(rows.sparkSession)
    kind = "array<float>" if isinstance(rows.schema[vector].dataType.elementType, FloatType) else "array<double>"
    base = written(rows.select(rows[f"`{key}`"].cast("long").alias("id"), rows[f"`{vector}`"].cast(kind).alias("v")), "vectors")
    good = base.where(F.col("id").isNotNull() & _usable("v"))
    vectors = written(good.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("w")), "distinct")
    if vectors.isEmpty():
        none = base.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
        return none.withColumns({"audit_recall": F.lit(None).cast("double"), "walks_stuck": F.lit(None).cast("double")})
    centroids = _centroids(vectors, threshold)
    for attempt in range(ATTEMPTS):
        found = _linked(vectors, centroids, OVERLAP << attempt, threshold)
        recall = _audit(vectors, found, threshold)
        if recall is None or recall >= RECALL:
            break
    else:
        found = _linked_exactly(vectors, centroids, OVERLAP << attempt, threshold)
        recall = _audit(vectors, found, threshold)
        if recall is not None and recall < LEAST_RECALL:
            raise RuntimeError(f"the audit found {recall:.3f} of the links only, even with cells compared exactly")
    stuck, walks = found.where("rep IS NULL").agg(F.sum("links"), F.sum("root")).first()
    found = found.where("rep IS NOT NULL")
    links = found.select(F.col("rep").alias("a"), F.col("root").alias("b"))
    roots = components(links)
    of = (
        vectors.select("v", "rep", "w")
        .join(found.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left")
        .join(roots.withColumnRenamed("node", "rep"), "rep", "left")
        .select("v", (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("root", "rep").alias("root"))
    )
    both = base.where(F.col("id").isNotNull() & _usable("v")).join(of, "v").select("id", "n", "root")
    rest = base.where(F.col("id").isNull() | ~_usable("v")).select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("root"))
    return both.unionByName(rest).select(
        F.col("id").alias(key),
        F.col("n").alias("n_links"),
        F.col("root").alias("component_id"),
        F.col("id").eqNullSafe(F.col("root")).alias("kept"),
        F.lit(recall).cast("double").alias("audit_recall"),
        F.lit(stuck / walks if walks else None).cast("double").alias("walks_stuck"),
    )


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "embeddings"))
