"""Interval joins by nested bins.

A span is filed once or twice, in the bins of the size that just holds it: bins of size 2^k for a
span of up to 2^k + 1 lines. A line looks in one bin of each size that some span has, which are no more than
the bits of a line number. So both sides meet in an equi join however long spans are, and
what meets in a bin but does not fit is a constant share of what fits or lies close by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SIZE, _BIN = "__size", "__bin"


def _bin(line: Column, size: Column) -> Column:
    return F.floor(line / F.pow(F.lit(2.0), size))


def _placed(bin_: Column, size: Column) -> Column:
    """A bin and its size in one number, as rows of it are shuffled; sizes are below 64."""
    return bin_ * 64 + size


def filed(spans: DataFrame, start: str, end: str) -> DataFrame:
    """spans with the bins that each is filed in; those that end before they start, or have no ends, are in none."""
    a, b = F.col(start).cast("long"), F.col(end).cast("long")
    sized = spans.where(a <= b).withColumn(_SIZE, F.ceil(F.log2(b - a + 1)).cast("int"))
    return sized.withColumn(_BIN, F.explode(F.sequence(_bin(a, F.col(_SIZE)), _bin(b, F.col(_SIZE)))))


def around(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str) -> DataFrame:
    """points joined with the spans of the same keys that hold them, ends included; other columns must be named apart."""
    inside = filed(spans, start, end)
    sizes = inside.agg(F.collect_set(_SIZE).alias("s")).scalar()  # as many as a line number has bits, at most
    place = _placed(F.col(_BIN), F.col(_SIZE))
    inside = inside.withColumn(_BIN, place).drop(_SIZE)
    probes = points.withColumn(_SIZE, sizes).withColumn(_SIZE, F.explode(_SIZE)).withColumn(_BIN, _bin(F.col(at).cast("long"), F.col(_SIZE))).withColumn(_BIN, place).drop(_SIZE)
    # both sides have several rows for each that was read, which Spark's sizes leave out: neither is one to broadcast
    met = probes.join(inside.hint("merge"), [*keys, _BIN])
    return met.where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop(_BIN)


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], left_ends: tuple[str, str], right_ends: tuple[str, str]) -> DataFrame:
    """left joined with what of right overlaps it: one of both begins inside the other, so each pair is found once."""
    (a, b), (c, d) = left_ends, right_ends
    first = around(left.where(F.col(a) <= F.col(b)), right, keys, a, c, d)
    later = around(right.where(F.col(c) <= F.col(d)), left, keys, c, a, b).where(F.col(c) > F.col(a))
    return first.unionByName(later)
