"""Best-fit packing of documents into sequences by exact-complement hashing.

Packing depends on lengths alone, so it is planned on the histogram of lengths, of at most
`room` numbers, with multiplicities: a pattern (lengths that fill a sequence) and how often it
is used. From the longest length down, the gap that it leaves is looked up in an index of single
lengths, sums of two and sums of three, kept under the counts that are left; a combination that
fills it exactly is consumed as often as they allow. What then is left goes best-fit: the longest first, into
the smallest gap that holds it, a new sequence if none does.

Documents meet the plan by length and rank: each pattern takes a stretch of ranks of each of
its lengths. Ranks are numbered in buckets, so one very common length is spread over many
tasks. Only the histogram and the plan, both bounded by `room`, pass the driver.

Defined results: null and empty texts have the end id only; documents longer than a sequence
are cut so that only the first piece may be shorter, all others are full; null ids are packed
like any other; repeated rows are packed as often as they occur; very long texts are encoded
whole; pieces of one length are interchangeable in the plan and go by bucket, id and piece; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buckets_for, ranked, small_batches, table, tidied, tidy, written
from .tokens import END_ID, default_path, encoder, in_blocks

ROOM = 2048


@dataclass
class Pattern:
    """(length, how many) of each sequence, and the number of such sequences."""

    items: list[tuple[int, int]]
    times: int

    @property
    def gap(self) -> int:
        return ROOM - sum(n * m for n, m in self.items)


class Histogram:
    """Available lengths, and an index of the sums of one, two and three of them, as sets of bits.

    Singles are exact at all times, and their mirrored set gives the pairs of a sum in one step.
    The sums of two and of three are made anew when a length has run out since; until then, and
    where a scarce length would be used twice, they may hold too much, so a combination counts
    only once its lengths are found among the counts.
    """

    def __init__(self, counts: dict[int, int], room: int = ROOM) -> None:
        self.n, self.room = [0] * (room + 1), room
        for length, count in counts.items():
            self.n[length] += count
        self._single = sum(1 << x for x, count in enumerate(self.n) if x and count > 0)
        self._mirror = sum(1 << (room - x) for x, count in enumerate(self.n) if x and count > 0)
        self._pair = self._triple = 0
        self._stale = True

    def add(self, length: int, count: int) -> None:
        """Change the count of a length."""
        had, self.n[length] = self.n[length] > 0, self.n[length] + count
        if had != (self.n[length] > 0):
            self._single ^= 1 << length
            self._mirror ^= 1 << (self.room - length)

    def use(self, length: int, count: int) -> None:
        self.add(length, -count)
        self._stale |= not self.n[length]

    def _indexed(self) -> None:
        below = (1 << (self.room + 1)) - 1
        lengths = _bits(self._single)
        self._pair = self._triple = 0
        for x in lengths:
            self._pair |= (self._single ^ (1 << x if self.n[x] < 2 else 0)) << x
        self._pair &= below
        for x in lengths:
            self._triple |= self._pair << x
        self._triple &= below
        self._stale = False

    def exact(self, gap: int, without: int = 0) -> tuple[int, ...] | None:
        """One, two or three available lengths with the sum gap, the longest first; one of `without` is taken."""
        if self._stale:
            self._indexed()
        if without:
            self.add(without, -1)
        found = self._one(gap) or self._two(gap) or self._three(gap)
        if without:
            self.add(without, 1)
        return found

    def _one(self, gap: int) -> tuple[int] | None:
        return (gap,) if self._single >> gap & 1 else None

    def _two(self, gap: int) -> tuple[int, int] | None:
        """The pair with the longest length."""
        if not self._pair >> gap & 1:
            return None
        low = self._single & (self._mirror >> (self.room - gap)) & ((1 << (gap // 2 + 1)) - 1)
        if gap % 2 == 0 and self.n[gap // 2] < 2:
            low &= ~(1 << (gap // 2))
        if not low:
            return None
        x = (low & -low).bit_length() - 1
        return gap - x, x

    def _three(self, gap: int) -> tuple[int, int, int] | None:
        if not self._triple >> gap & 1:
            return None
        for x in reversed(_bits(self._single & ((1 << gap) - 1))):
            if 3 * x < gap:
                break
            self.add(x, -1)
            two = self._two(gap - x)
            self.add(x, 1)
            if two and two[0] <= x:
                return (x, *two)
        return None


def _bits(x: int) -> list[int]:
    """Places of the bits that are set, in ascending order."""
    return [i for i, c in enumerate(reversed(bin(x)[2:])) if c == "1"]


def plan_packing(counts: dict[int, int], room: int = ROOM) -> list[Pattern]:
    """Patterns that use each length just as often as counts has it."""
    h, out = Histogram(counts, room), []
    for length in range(room, 0, -1):
        while h.n[length] > 0:
            gap = room - length
            found = h.exact(gap, length) if gap else ()
            if found is None:
                break
            use = Counter((length, *found))
            times = min(h.n[x] // m for x, m in use.items())
            for x, m in use.items():
                h.use(x, m * times)
            out.append(Pattern(sorted(use.items(), reverse=True), times))
    return out + _best_fit(h.n, room)


def _best_fit(n: list[int], room: int) -> list[Pattern]:
    """The rest, longest first; sequences of one content are handled together."""
    open_: dict[int, list[Pattern]] = {}
    for length in range(room, 0, -1):
        left = n[length]
        while left:
            gap = next((g for g in range(length, room) if open_.get(g)), None)
            p = open_[gap].pop() if gap is not None else Pattern([], left)
            free = room if gap is None else gap
            each = min(free // length, left)
            times = min(p.times, left // each)
            if p.times > times and gap is not None:
                open_[gap].append(Pattern(p.items, p.times - times))
            filled = Pattern([*p.items, (length, each)], times)
            open_.setdefault(free - each * length, []).append(filled)
            left -= each * times
    return [p for group in open_.values() for p in group]


@dataclass
class Slots:
    """Where the ranks of each length go, as columns sorted by length and first rank."""

    length: np.ndarray
    first: np.ndarray
    many: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray

    @classmethod
    def of(cls, patterns: list[Pattern]) -> Slots:
        used: dict[int, int] = {}
        rows, sequence = [], 0
        for p in patterns:
            offset = 0
            for length, many in p.items:
                rows.append((length, used.get(length, 0), many, sequence, offset))
                used[length] = used.get(length, 0) + many * p.times
                offset += length * many
            sequence += p.times
        rows.sort()
        return cls(*(np.array(c, np.int64) for c in (zip(*rows, strict=True) if rows else ([],) * 5)))

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces by length and rank."""
        begin, end = np.searchsorted(self.length, length, "left"), np.searchsorted(self.length, length, "right")
        at = np.empty(len(length), np.int64)
        for x in np.unique(length):
            here = length == x
            i, j = begin[here][0], end[here][0]
            at[here] = i + np.searchsorted(self.first[i:j], rank[here], "right") - 1
        into = rank - self.first[at]
        return self.sequence[at] + into // self.many[at], self.offset[at] + into % self.many[at] * length


def cut(n: int, room: int = ROOM) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids."""
    head = n % room or min(n, room)
    return [(0, head), *[(i, room) for i in range(head, n, room)]]


def pieces_of(docs: DataFrame, tokenizer: str | None = None, key: str = "doc_id", room: int = ROOM) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece."""
    small_batches(docs.sparkSession)
    tokenizer = tokenizer or default_path()
    wanted = docs.select(docs[f"`{key}`"].alias("id"), docs["text"].alias("text"))
    end = int(END_ID).to_bytes(4, "little")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in in_blocks(batches, "text"):
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(enc.encode_column(b.column("text"))):
                raw = ids + end
                for k, (at, n) in enumerate(cut(len(raw) // 4, room)):
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(n)
                    crc.append(crc32(raw[at * 4 : (at + n) * 4]))
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = wanted.schema["id"].dataType.simpleString()
    return wanted.mapInArrow(tidied(encoded), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


@tidy
def packed(docs: DataFrame, tokenizer: str | None = None, key: str = "doc_id", room: int = ROOM) -> DataFrame:
    """The pieces with sequence_id and offset."""
    spark = docs.sparkSession
    pieces = written(pieces_of(docs, tokenizer, key, room), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `room` rows
    slots = spark.sparkContext.broadcast(Slots.of(plan_packing(counts, room)))
    buckets = buckets_for(sum(counts.values()))
    rows = pieces.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    rows = ranked(rows, ["length"], ["__bucket"], ["doc_id", "piece", "ids_crc32"], "__rank").drop("__bucket")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = slots.value.place(b.column("length").to_numpy(), b.column("__rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*[b.column(x) for x in names], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.select(*names, F.col("__rank").cast("long").alias("__rank"))
    return rows.mapInArrow(tidied(placed), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
