"""Document fingerprints by locally consistent parsing.

A text's bytes are symbols. At each level runs of one symbol become one symbol; deterministic coin
tossing then gives neighbours different labels: a symbol's label is the lowest bit in which it differs
from the symbol before and that bit's value, which after a few rounds leaves six labels, and two sweeps
of the larger ones leave three. Blocks begin at the labels' local maxima, so they are two to four symbols long
inside a text, and their borders depend on a few symbols to either side only. A block's name is a
hash of its symbols, and the names are the symbols of the next level. Equal substrings thus get equal
names but near their ends, wherever they stand.

The fingerprint holds the root's name (equal for equal texts) and min-hash sketches of the names
on two levels: the highest up to TOP that still has LEAST phrases, and the one below it. Likeness
is the share of phrases that two texts have in common (the Dice coefficient that the sketches
give) on the highest level that both fingerprints hold, so it needs no texts.

Each text is compared with an edited one, whose last quarter comes from the next document by id.
Documents are dealt to buckets of consecutive ids by cuts from a sample of ids, and sorted there; the first
document of a bucket also goes to the bucket before it. So a text moves once, and a task reads its rows as
a stream.

Defined results: a null text is the empty text, whose fingerprint has no level; it is like the empty text only;
texts that differ in length so much that their fingerprints share no level have likeness 0; null ids come first;
rows with one id go by a hash of their text and then by the text, and repeated rows follow each other; the document
after the last is the first, so a single document follows itself; an empty table gives an empty result; very
long texts are parsed whole, in some 60 bytes of a task's memory for a byte of text; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_by_hash, small_batches, table, tidied, tidy

#: Highest level that is sketched, phrases that a sketched level should have, and slots of a sketch.
TOP, LEAST, SLOTS = 4, 32, 64
#: Bytes of text dealt to a bucket, at most so many buckets, and ids drawn for each cut.
BUCKET_BYTES, MOST_BUCKETS, DRAWN = 16 << 20, 20_000, 40
#: Bytes parsed at once.
PARSED = 1 << 18

_MUL, _RUN, _NAME = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_32, _29 = np.uint64(32), np.uint64(29)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _32)) * _NAME
    x = (x ^ (x >> _29)) * _RUN
    return x ^ (x >> _32)


#: Symbols of the bytes, and multipliers of the slots.
BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * _MUL)
TIMES = mixed(np.arange(1001, 1001 + SLOTS, dtype=np.uint64) * _MUL) | np.uint64(1)

#: The lowest set bit of a byte (0 for 0), and the least label of 0, 1, 2 that is not among two others.
_LOWEST = np.array([0] + [(n & -n).bit_length() - 1 for n in range(1, 256)], np.uint8)
_FREE = np.array([[min({0, 1, 2} - {a, b}) for b in range(7)] for a in range(7)], np.uint8)


def labels(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels 0 to 2 of symbols (64-bit numbers or bytes), of which no two neighbours are equal; first: where a text begins."""
    lab = x
    if x.dtype != np.uint8:
        before = np.empty_like(x)
        before[1:] = x[:-1]
        before[first] = x[first] ^ np.uint64(1)
        differ = x ^ before
        k = np.bitwise_count(~differ & (differ - np.uint64(1)))
        lab = 2 * k + ((x >> k.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)
    for _ in range(3):
        old = np.empty_like(lab)
        old[1:] = lab[:-1]
        old[first] = lab[first] ^ 1
        k = _LOWEST[lab ^ old]
        lab = 2 * k + ((lab >> k) & 1)
    none = 6
    begins = np.zeros(len(lab) + 1, bool)
    begins[first] = begins[-1] = True
    for v in (5, 4, 3):
        at = np.flatnonzero(lab == v)
        left = np.where(begins[at], none, lab[at - 1])
        right = np.where(begins[at + 1], none, lab[np.minimum(at + 1, len(lab) - 1)])
        lab[at] = _FREE[left, right]
    return lab


def next_level(x: np.ndarray, first: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of a level, and where each text's begin, from the symbols below (names or bytes); no text is empty.

    Bytes toss by themselves, as neighbouring runs are of different bytes.
    """
    begins = np.zeros(len(x), bool)
    begins[first] = True
    # runs of one symbol
    new = begins.copy()
    new[1:] |= x[1:] != x[:-1]
    at = np.flatnonzero(new)
    shorter = len(at) < len(x)
    if shorter:
        length = np.diff(at, append=len(x))
        x, begins = x[at], begins[at]
        first = np.flatnonzero(begins)
    tossed = x
    if x.dtype == np.uint8:
        x = BYTES[x]
    if shorter:
        more = np.flatnonzero(length > 1)
        x[more] = mixed(x[more] * _RUN + length[more].astype(np.uint64))
        tossed = tossed if tossed.dtype == np.uint8 else x
    lab = labels(tossed, first)
    peak = np.zeros(len(x), bool)
    peak[1:-1] = (lab[1:-1] > lab[:-2]) & (lab[1:-1] > lab[2:])
    # a text's last symbol begins no block of its own, and the one before it has a neighbour within the text
    peak[first[1:] - 1] = False
    peak[first] = True
    at = np.flatnonzero(peak)
    end = np.append(at[1:], len(x))
    size = end - at
    name = mixed((x[at] ^ np.uint64(level * int(_MUL) % (1 << 64))) * _MUL)
    for j in range(1, int(size.max())):
        on = np.flatnonzero(size > j)
        name[on] = mixed((name[on] ^ x[at[on] + j]) * _MUL)
    return name, np.flatnonzero(begins[at])


def sketches(names: np.ndarray, first: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """16 bits for each slot [text, slot], for the texts in rows."""
    size = np.diff(first, append=len(names))
    each = size[rows]
    starts = np.cumsum(each) - each
    x = names[np.repeat(first[rows] - starts, each) + np.arange(int(each.sum()))]
    out = np.empty((len(rows), SLOTS), np.uint16)
    for j in range(SLOTS):
        out[:, j] = mixed(np.minimum.reduceat(x * TIMES[j], starts)) >> np.uint64(48)
    return out


EMPTY = "0" * 16 + ".0"


def fingerprints(texts: list[bytes]) -> list[str]:
    """`root.level.sketch[.sketch]` in hexadecimal digits: of the level named, and of the one below."""
    out = [EMPTY] * len(texts)
    live = np.array([i for i, t in enumerate(texts) if t], np.int64)
    if not len(live):
        return out
    size = np.array([len(texts[i]) for i in live])
    x, first = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size
    n = len(live)
    root, own, kept = np.zeros(n, np.uint64), np.ones(n, np.int64), []
    on, level = np.arange(n), 0
    while len(on):
        level += 1
        x, first = next_level(x, first, level)
        size = np.diff(first, append=len(x))
        if level <= TOP:
            own[on[size >= LEAST]] = level
            kept.append((on, x, first))
        done = size == 1
        if done.any():
            root[on[done]] = x[first[done]]
            on, x, size = on[~done], x[np.repeat(~done, size)], size[~done]
            first = np.cumsum(size) - size
    parts: list[list[str]] = [[f"{r:016x}.{lv}"] for r, lv in zip(root.tolist(), own.tolist(), strict=True)]
    for higher in (0, 1):  # first the level named, then the one below
        for lv, (there, names, starts) in enumerate(kept, 1):
            rows = np.flatnonzero(own[there] - higher == lv)
            if len(rows):
                for i, s in zip(there[rows].tolist(), sketches(names, starts, rows), strict=True):
                    parts[i].append(s.astype(">u2").tobytes().hex())
    for i, p in zip(live.tolist(), parts, strict=True):
        out[i] = ".".join(p)
    return out


def likeness(a: str, b: str) -> float:
    """Share of phrases in common, from 0 to 1."""
    if a == b:
        return 1.0
    (_, la, *own_a), (_, lb, *own_b) = a.split("."), b.split(".")
    level = min(int(la), int(lb))
    i, j = int(la) - level, int(lb) - level
    if not level or i >= len(own_a) or j >= len(own_b):
        return 0.0
    same = np.frombuffer(bytes.fromhex(own_a[i]), np.uint16) == np.frombuffer(bytes.fromhex(own_b[j]), np.uint16)
    jaccard = float(same.mean())
    return 2 * jaccard / (1 + jaccard)


def edited(text: str, after: str) -> str:
    """text, whose last quarter is replaced by the beginning of the next."""
    part = len(text) // 4
    return text[: len(text) - part] + after[:part]


def _parsed(texts: list[bytes]) -> list[str]:
    """Fingerprints of texts, PARSED bytes or one text at a time."""
    out: list[str] = []
    at = 0
    while at < len(texts):
        end, held = at, 0
        while end < len(texts) and (end == at or held + len(texts[end]) <= PARSED):
            held += len(texts[end])
            end += 1
        out += fingerprints(texts[at:end])
        at = end
    return out


def compared(rows: Iterator[tuple[int, bool, int | None, str]]) -> Iterator[tuple]:
    """A result for each row (bucket, tail, id, text) that is no tail; rows come in order and each bucket ends with its tails."""
    held = None
    for part in iter(lambda: list(itertools.islice(rows, 256)), []):
        texts = [t.encode() for _, _, _, t in part]
        prints = _parsed(texts)
        pairs = []
        for (bucket, tail, key, text), own in zip(part, prints, strict=True):
            if held and held[0] == bucket:
                pairs.append((*held[1:], text, own))
                held = None
            if not tail:
                held = bucket, key, text, own
        changed = [edited(text, after).encode() for _, text, _, after, _ in pairs]
        for (key, text, own, _, following), new, other in zip(pairs, changed, _parsed(changed), strict=True):
            yield key, len(text), hashlib.sha256(new).hexdigest(), own, other, likeness(own, other), likeness(own, following)


def _place(known: bool, key: int | None, digest: int) -> tuple[bool, int, int]:
    return known, key or 0, digest


@tidy
def near_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row."""
    spark = docs.sparkSession
    small_batches(spark)
    read = docs.select(docs[f"`{key}`"].cast("long").alias("id"), F.coalesce(docs[f"`{text}`"].cast("string"), F.lit("")).alias("t"))
    read = read.select("id", F.xxhash64("t").alias("h"), "t")
    keys = read.select("id", "h", F.octet_length("t").alias("n"))
    rows, size = keys.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    buckets = min(MOST_BUCKETS, max(1, -(-size // BUCKET_BYTES)))
    drawn = sorted((_place(r["id"] is not None, r["id"], r["h"]), r["n"] + 1) for r in bounded_by_hash(keys, F.struct("id", "h"), rows, DRAWN * buckets).collect()) if buckets > 1 else []
    cuts, total, so_far = [], sum(n for _, n in drawn), 0
    for place, n in drawn:
        if so_far * buckets >= (len(cuts) + 1) * total and (not cuts or cuts[-1] < place):
            cuts.append(place)
        so_far += n

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, digests = b.column(0).to_pylist(), b.column(1).to_pylist()
            at = [bisect.bisect_right(cuts, _place(i is not None, i, h)) for i, h in zip(ids, digests, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *b.columns], ["bucket", *b.schema.names])

    # the first place of each bucket; buckets are bounded in number
    least = keys.select("id", "h").mapInArrow(tidied(numbered), "bucket int, id long, h long")
    found = least.groupBy("bucket").agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), F.col("id"), F.col("h"))).alias("p")).collect()
    begins = {r["bucket"]: _place(*r["p"]) for r in found}
    order = sorted(begins)
    before = {b: order[i - 1] for i, b in enumerate(order)}

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "tail", "id", "h", "t"]
        for b in numbered(batches):
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array(np.zeros(b.num_rows, bool)), *b.columns[1:]], names)
            yield out
            at, ids, digests = (b.column(i).to_pylist() for i in range(3))
            tails = [i for i in range(b.num_rows) if begins[at[i]] == _place(ids[i] is not None, ids[i], digests[i])]
            if tails:
                moved = out.take(pa.array(tails))
                yield pa.RecordBatch.from_arrays([pa.array([before[at[i]] for i in tails], pa.int32()), pa.array(np.ones(len(tails), bool)), *moved.columns[2:]], names)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True))
        results = compared(stream)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        for some in iter(lambda: list(itertools.islice(results, 512)), []):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], names)

    moved = read.mapInArrow(tidied(dealt), "bucket int, tail boolean, id long, h long, t string")
    # of equal places the one that comes first among a bucket's rows, which is the least text, must also be the first of its tails
    placed = moved.repartition("bucket").sortWithinPartitions("bucket", "tail", "id", "h", "t")
    out = placed.mapInArrow(tidied(told), "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("id", key)


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_texts(table(spark, sf_dir, "documents"))
