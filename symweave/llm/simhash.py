"""SimHash near-dedup: 64-bit fingerprints, pigeonhole blocks, verified Hamming distance.

Only different fingerprints are compared; rows of one fingerprint share its component, so a
group of copies is one fingerprint whatever its size. With k blocks two fingerprints that
differ in at most d bits agree in at least k - d of them, so each fingerprint is filed once
under every choice of k - d blocks. k is the least number for which a choice has so many
bits that chance meetings stay rare at the table's size; any k finds the same links.

Fingerprints filed alike are met in sorted runs, in bounded batches. A run gives the links
of a spanning forest and never all its pairs. A run longer than RUN_LIMIT is cut into
chunks whose pairs are compared in separate tasks, so that it is neither gathered in one
task nor cut short.

Defined results: null and empty texts and texts of white space alone have fingerprint zero,
which links like any other; repeated rows come out as often as they went in; null ids stay
null and are ignored when a component is named, unless it has no other; very long texts are hashed
whole; an empty table gives an empty result; other columns are ignored (`near_groups`) or kept,
whatever their names (`drop_near_copies`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import looks_listed, small_batches, table, tidied, tidy, unused, written
from .components import components

BITS, MAX_DISTANCE, SHINGLE, SEED = 64, 4, 4, 42
#: Fingerprints of one run compared in one task, at most.
RUN_LIMIT = 20_000
#: Chance meetings for each fingerprint that the plan allows.
CHANCE = 0.25

_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_XXH = xxhash.xxh64_intdigest


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Unsigned 64 bits; the lower-casing and the split see ASCII bytes only."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = [_XXH(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-width])).tolist()
        hashes = [_XXH(joined[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)]
    columns = np.array(hashes, np.uint64).astype("<u8").view(np.uint8).reshape(-1, 8)
    out = 0
    for i in range(8):
        ones = np.bincount(columns[:, i], minlength=256) @ _BYTE_BITS
        out |= int((2 * ones > len(hashes)) @ (1 << np.arange(8))) << (8 * i)
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp): fp is the signed long of the fingerprint's bits."""
    small_batches(docs.sparkSession)
    rows = docs.select(docs[f"`{key}`"].alias("id"), docs[f"`{text}`"].alias("t"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column("t").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fp)], ["id", "fp"])

    return rows.mapInArrow(tidied(hashed), f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def block_masks(k: int, distance: int = MAX_DISTANCE, bits: int = BITS) -> list[int]:
    """Every choice of k - distance of k blocks, as masks of their bits."""
    edges = [bits * i // k for i in range(k + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, k - distance)]


def plan_blocks(n: int, distance: int = MAX_DISTANCE, bits: int = BITS) -> int:
    """The least number of blocks that keeps chance meetings rare among n fingerprints."""
    for k in range(distance + 1, 17):
        if n * comb(k, distance) <= CHANCE * 2 ** (bits * (k - distance) / k):
            return k
    return 16


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links from fingerprints to the root of their tree, for unsigned distinct fps."""
    m = len(fps)
    label = np.arange(m, dtype=np.int32)
    step = max(1, 250_000 // m)
    while True:
        new = label.copy()
        for i in range(0, m, step):
            near = np.bitwise_count(fps[i : i + step, None] ^ fps[None, :]) <= distance
            new[i : i + step] = np.where(near, label[None, :], np.int32(m)).min(axis=1)
        np.minimum.at(new, label, new.copy())
        new = new[new]
        if (new == label).all():
            break
        label = new
    child = np.nonzero(label != np.arange(m))[0]
    return fps[child], fps[label[child]]


def _pairs_schema() -> str:
    return "a long, b long, over boolean, t int, key long"


def _met_in_runs(distance: int, limit: int):
    """Reads (t, key, fp) sorted by t, key; yields forest links, and the rows of long runs."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        at, size, over = None, 0, False

        def rows(a, b, over, t, key) -> pa.RecordBatch:
            n = len(a)
            return pa.RecordBatch.from_pydict({
                "a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64)), "over": pa.array(np.full(n, over)),
                "t": pa.array(np.full(n, t, np.int32)), "key": pa.array(np.full(n, key, np.int64)),
            })

        def close() -> Iterator[pa.RecordBatch]:
            if not over and size > 1:
                a, b = _forest(np.unique(np.concatenate(held)), distance)
                if len(a):
                    yield rows(a, b, False, *at)

        for batch in batches:
            t, key = batch.column("t").to_numpy(), batch.column("key").to_numpy()
            fp = batch.column("fp").to_numpy().view(np.uint64)
            if not len(t):
                continue
            cuts = np.nonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1]))[0] + 1
            begins, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(t)]))
            # runs of one row inside the batch have nothing to meet
            keep = (ends - begins > 1) | (begins == 0) | (ends == len(t))
            for i, j in zip(begins[keep].tolist(), ends[keep].tolist(), strict=True):
                now = (int(t[i]), int(key[i]))
                if now != at:
                    yield from close()
                    held, at, size, over = [], now, 0, False
                size += j - i
                held.append(fp[i:j].copy())
                if size > limit:
                    over = True
                    for x in held:
                        yield rows(x, x, True, *at)
                    held = []
        if at is not None:
            yield from close()

    return met


def _met_in_chunks(long_runs: DataFrame, distance: int, limit: int) -> DataFrame:
    """Links (a, b) of the runs that are too long for one task: chunks against chunks."""
    sizes = long_runs.groupBy("t", "key").agg(F.ceil(F.count("*") / (limit // 2)).cast("int").alias("chunks"))
    cells = (
        long_runs.join(F.broadcast(sizes) if sizes.count() < 100_000 else sizes, ["t", "key"])
        .withColumn("c", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("t", "key", "fp", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"))
    )
    cells = cells.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j")
    cells = cells.select("t", F.xxhash64("t", "key", "i", "j").alias("key"), "fp")
    return cells.mapInArrow(tidied(_met_in_runs(distance, 1 << 62)), _pairs_schema()).select("a", "b")


def fingerprint_links(distinct: DataFrame, distance: int = MAX_DISTANCE, blocks: int | None = None, limit: int = RUN_LIMIT) -> DataFrame:
    """(a, b): links that connect all fingerprints (column fp, all different) within `distance`.

    Fingerprints within the distance end up connected, others only through such links; pairs
    that others connect already are left out.
    """
    masks = block_masks(blocks or plan_blocks(distinct.count(), distance), distance)
    filed = distinct.select(
        "fp",
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("t", "key"),
    ).select("t", "key", "fp")
    filed = filed.repartition("t", "key").sortWithinPartitions("t", "key")
    met = written(filed.mapInArrow(tidied(_met_in_runs(distance, limit)), _pairs_schema()), "met")
    links = met.where("NOT over").select("a", "b")
    long_runs = met.where("over").select("t", "key", F.col("a").alias("fp"))
    if long_runs.isEmpty():
        return links.distinct()
    return links.unionByName(_met_in_chunks(long_runs, distance, limit)).distinct()


@tidy
def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = MAX_DISTANCE) -> DataFrame:
    """(key, fp, root, component_id) for every row; fp and root, a component's least fp, are signed."""
    rows = written(fingerprints(docs, key, text), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("id").alias("id")), "distinct")
    roots = components(fingerprint_links(distinct.select("fp"), distance))
    named = (
        distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
        .select("fp", "id", F.coalesce("root", "fp").alias("root"))
    )
    names = named.groupBy("root").agg(F.min("id").alias("component_id"))
    of = named.join(names, "root").select("fp", "root", "component_id")
    return rows.join(of, "fp").select(F.col("id").alias(key), "fp", "root", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


@tidy
def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = MAX_DISTANCE) -> DataFrame:
    """One document of each component stays, one with the component's id; all columns."""
    groups = written(near_groups(docs, key, text, distance), "near")
    return keep_one_of_each(docs, groups, lambda again: fingerprints(again, "id", "t"), key, text)


def keep_one_of_each(docs: DataFrame, groups: DataFrame, prints: Callable[[DataFrame], DataFrame], key: str, text: str) -> DataFrame:
    """docs without all but one row of each component of groups (key, fp, root, component_id); prints makes (id, t) into (id, fp).

    Ids that several rows have are looked up by fingerprint as well, so that of repeated rows
    one stays and a row is never kept for another row's sake. Rows whose id stays and is
    theirs alone pass where they are.
    """
    named = F.col(key).eqNullSafe(F.col("component_id"))
    look, row, print_ = unused(docs, "__look", "__row", "__print")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    ids = written(groups.groupBy(F.col(key).alias("__id")).agg(F.count("*").alias("rows"), F.bool_or(named).alias("some")), "kept")
    single, several = ids.where("some AND rows = 1").select("__id"), ids.where("some AND rows > 1").select("__id")
    # ids that one row has and that stay need no join; the others are those to look up
    others = ids.where("NOT (some AND rows = 1)").select("__id")
    marked = looks_listed(docs, docs[f"`{key}`"], others, F.col("__id"), look)
    passed, looked = marked.where(~F.col(look)).select(*columns), marked.where(look).select(*columns)
    is_in = lambda of: looked[f"`{key}`"].eqNullSafe(of["__id"])
    stay = passed.unionByName(looked.join(single, is_in(single), "left_semi"))
    if several.isEmpty():
        return stay
    again = looked.join(several, is_in(several), "left_semi").withColumn(row, F.struct(*columns))
    found = prints(again.select(F.col(row).alias("id"), F.col(f"`{text}`").alias("t"))).select("id", F.col("fp").alias(print_))
    roots = groups.where(named).select(F.col(key).alias("__id"), F.col("fp").alias("__fp"), F.col("root").alias("__root")).distinct()
    chosen = found.join(roots, found["id"][key].eqNullSafe(roots["__id"]) & (found[print_] == roots["__fp"])).dropDuplicates(["__id", "__root"])
    return stay.unionByName(chosen.select("id.*"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")
