"""What the operators of this subpackage share: table access, the shared folder, small helpers."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..shared import discard, scratch, shared_root, tidy, written
from ..shipping import ship

__all__ = ["discard", "scratch", "shared_root", "tidy", "written"]

#: Rows and bytes of an Arrow batch handed to Python, at most but for its last row. Texts may be long, so batches stay small.
ARROW_ROWS, ARROW_BYTES = 512, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidied(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f for mapInArrow, giving freed memory back at a task's end: workers live on, and allocators keep what they can."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only glibc has it
                ctypes.CDLL(None).malloc_trim(0)

    return run


def small_batches(spark: SparkSession) -> None:
    """Make ready for Python on the executors: ship the package, and bound the rows and bytes of
    an Arrow batch, as a few very long texts must fit in a worker."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, longer where df has a column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def crc_of_id(column: Column) -> Column:
    """crc32 of an id written as decimal text; null ids count as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def held_out(column: Column) -> Column:
    """Rows that no model may learn from: crc32(id as text) mod 4 is 2."""
    return crc_of_id(column) % 4 == 2


def bounded_by_hash(df: DataFrame, key: Column, rows: int, bound: int) -> DataFrame:
    """About `bound` of the `rows` rows of df, chosen by a hash of key, so that reruns agree."""
    if rows <= bound:
        return df
    return df.where(F.pmod(F.xxhash64(key, F.lit(7)), F.lit(1 << 30)) < int(bound / rows * (1 << 30)))


def buckets_for(rows: int, each: int = 250_000) -> int:
    """Into how many buckets a group may have to be split so that a task sorts about `each` rows."""
    return max(16, -(-rows // each))


def ranked(df: DataFrame, keys: list[str], parts: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """df with the 0-based rank of each row in its group of `keys`, by `parts` and then `order`.

    Rows are numbered inside (keys, parts) only, and the sizes of earlier parts are added, so
    a group that holds much of the table is sorted in as many tasks as it has parts. Sizes are
    added up one part after the other, so that no window holds more than the values of one part.
    keys and parts must not be null.
    """
    sizes = written(df.groupBy(*keys, *parts).agg(F.count("*").alias("__n")), "sizes")
    before, earlier = sizes, []
    for i, part in enumerate(parts):
        outer = [*keys, *parts[:i]]
        window = Window.partitionBy(*outer).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
        sums = sizes.groupBy(*outer, part).agg(F.sum("__n").alias("__n"))
        sums = sums.select(*outer, part, F.coalesce(F.sum("__n").over(window), F.lit(0)).alias(f"__before{i}"))
        before, earlier = before.join(sums.hint("merge"), [*outer, part]), [*earlier, F.col(f"__before{i}")]
    before = before.select(*keys, *parts, sum(earlier[1:], earlier[0]).alias("__before"))
    here = F.row_number().over(Window.partitionBy(*keys, *parts).orderBy(*order)) - 1
    # sizes grow with the table until all parts are there, so they are no side to broadcast; rows are dealt by these keys as they are
    return df.withColumn("__here", here).join(before.hint("merge"), [*keys, *parts]).withColumn(name, F.col("__before") + F.col("__here")).drop("__here", "__before")


#: Places of the bitmap that looks_listed() broadcasts: 2^24 bits are 2 MB at most, whatever the data.
BITMAP_PLACES = 1 << 24


def looks_listed(df: DataFrame, column: Column, listed: DataFrame, key: Column, name: str) -> DataFrame:
    """df with a boolean: false only for rows whose column is surely not among the keys of listed.

    The keys set bits by hash in a bitmap of fixed size, which is broadcast. A key may be
    taken for another, so what looks listed has yet to be joined; all else needs no shuffle.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(BITMAP_PLACES)) + 1
    at, bucket, bits = unused(df, "__place", "__bucket", "__bits")
    listed_bits = (
        listed.select(place(key).alias(at))
        .groupBy(F.bitmap_bucket_number(at).alias(bucket))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias(bits))
    )
    bit = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring(bits, (F.shiftright(bit, 3) + 1).cast("int"), 1)), 16, 10).cast("int")
    hit = F.pmod(F.floor(byte / F.pow(F.lit(2.0), F.pmod(bit, F.lit(8)))), F.lit(2)) == 1
    probed = df.withColumn(at, place(column)).withColumn(bucket, F.bitmap_bucket_number(at))
    return probed.join(F.broadcast(listed_bits), bucket, "left").withColumn(name, F.coalesce(hit, F.lit(False))).drop(at, bucket, bits)
