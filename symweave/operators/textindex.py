"""A full-text index that is kept: postings in blocks with bounds, updated in segments, searched without the blocks that cannot matter."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..shared import tidy, written
from ..shipping import ship
from .retrieve import K1, B, tokens, top_k
from .store import Store
from .traverse import _sized

#: Documents of a block, in the order of their numbers; buckets of terms; ranges of a query that are scored for a first bound.
RANGE, BUCKETS, FIRST = 64, 64, 8
#: Ranges of one bucket that are written in one task.
TASK_RANGES = 4096
#: Given, as partitions without rows have no file that tells it.
POSTINGS = "term string, range long, top_tf long, low_n int, size long, entries array<struct<number: long, tf: long, n: int>>, bucket int"
BLOCKS = "term string, range long, entries array<struct<number: long, tf: long, n: int>>"


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, number, n, terms, tfs) of rows (key, number, t): each token of a row once, and how often it is there."""
    for batch in batches:
        key, number, t = batch.columns
        words = t.flatten().dictionary_encode()
        different = max(len(words.dictionary), 1)
        of = pc.list_parent_indices(t).to_numpy().astype(np.int64)
        each, tf = np.unique(of * different + words.indices.to_numpy(), return_counts=True)
        ends = pa.array(np.searchsorted(each, np.arange(len(t) + 1) * different).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, x, mask=t.is_null()) for x in (words.dictionary.take(pa.array(each % different)), pa.array(tf))]
        yield pa.RecordBatch.from_arrays([key, number, pc.list_value_length(t), *lists], ["key", "number", "n", "terms", "tfs"])


def _in_blocks(span: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """BLOCKS of rows (number, n, terms, tfs), by term; rows of a range that come in two batches give two blocks of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, n, terms, tfs = batch.columns
            words = terms.flatten().dictionary_encode()
            if not len(words):
                continue
            of = pc.list_parent_indices(terms)
            place = np.empty(len(words.dictionary), np.int64)
            by_name = pc.array_sort_indices(words.dictionary).to_numpy()
            place[by_name] = np.arange(len(place))
            at, term = number.take(of).to_numpy(), place[words.indices.to_numpy()]
            order = np.lexsort((at, term))
            at, term = at[order], term[order]
            first = np.flatnonzero(np.r_[True, (np.diff(term) != 0) | (np.diff(at // span) != 0)])
            entries = pa.StructArray.from_arrays([pa.array(at), tfs.flatten().take(pa.array(order)), n.take(of).take(pa.array(order))], ["number", "tf", "n"])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(at)].astype(np.int32)), entries)
            named = words.dictionary.take(pa.array(by_name[term[first]]))
            yield pa.RecordBatch.from_arrays([named, pa.array(at[first] // span), lists], ["term", "range", "entries"])

    return run


class TextIndex:
    """Documents (key, text) below a root that all executors share.

    An update writes one segment: the documents that are new, their postings, and the numbers and terms of
    those that they replace; it reads of other segments only what is replaced. A state names the segments
    and is published as a whole; of two writers the second gets a Conflict. Scores are those of retrieve.bm25() over
    the documents that are alive. A null text counts as a document without a length; keys are unique in an update.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self._store = spark, root.rstrip("/"), Store(spark, root)
        #: Ranges that hold a term of a query, and those of them that the last search() read, over all queries.
        self.met = self.read = 0

    def _part(self, state: dict, name: str) -> DataFrame:
        read = self.spark.read.schema(POSTINGS) if name == "postings" else self.spark.read
        parts = [read.parquet(f"{self.root}/segment-{n}/{name}") for n in state["segments"]]
        return reduce(DataFrame.unionByName, [p.select("key", "number", "n", "terms") for p in parts] if name == "docs" else parts)

    def documents(self, state: dict | None = None) -> DataFrame:
        """(key, number, n, terms) of the documents that are alive."""
        state = state or self._store.pinned()
        return self._part(state, "docs").join(self._part(state, "dead").select("number"), "number", "left_anti")

    def _write_blocks(self, blocks: DataFrame, place: str) -> None:
        """BLOCKS below place, with their heads."""
        spread = blocks.withColumn("bucket", _bucket(F.col("term"))).repartition("bucket", F.floor(F.col("range") / TASK_RANGES)).sortWithinPartitions("bucket", "term", "range")
        heads = [F.array_max("entries.tf").alias("top_tf"), F.array_min("entries.n").alias("low_n"), F.size("entries").cast("long").alias("size")]
        spread.select("term", "range", *heads, "entries", "bucket").write.partitionBy("bucket").parquet(f"{place}/postings")

    @tidy
    def update(self, docs: DataFrame, key: str = "key", text: str = "text", deleted: DataFrame | None = None) -> None:
        """Add docs, in place of those with their keys, and take out the keys of deleted.

        Texts are read once: documents are numbered as they lie, with gaps between partitions, and written with their
        terms and counts. Those of a range then lie together, so blocks are made where they are, and only they are shuffled.
        """
        ship(self.spark)
        state = self._store.pinned()
        base, segment = state["number"], uuid.uuid4().hex  # of two writers none writes into the other's folder
        place = f"{self.root}/segment-{segment}"
        start = F.monotonically_increasing_id() + (state.get("numbers", -1) + 1)
        cut = docs.select(F.col(key).alias("key"), start.alias("number"), tokens(F.col(text)).alias("t"))
        schema = StructType([StructField("key", cut.schema["key"].dataType), *StructType.fromDDL("number long, n int, terms array<string>, tfs array<long>")])
        cut.mapInArrow(_counted, schema).write.parquet(f"{place}/docs")
        cut = self.spark.read.schema(schema).parquet(f"{place}/docs")
        self._write_blocks(cut.select("number", "n", "terms", "tfs").mapInArrow(_in_blocks(RANGE), BLOCKS), place)
        gone = cut.select("key") if deleted is None else cut.select("key").unionByName(deleted.select(F.col(key).alias("key")))
        if base:
            old = self.documents(state).join(gone.distinct(), "key", "left_semi").select("number", "n", "terms")
        else:
            old = cut.select("number", "n", "terms").limit(0)
        old.write.parquet(f"{place}/dead")
        count = lambda df: df.agg(F.count("*"), F.count("n"), F.coalesce(F.sum("n"), F.lit(0)), F.max("number")).first()
        new, dead = count(cut), count(self.spark.read.parquet(f"{place}/dead"))
        for i, name in enumerate(("docs", "sized", "words")):
            state[name] = state.get(name, 0) + new[i] - dead[i]
        state["numbers"] = max(state.get("numbers", -1), -1 if new[3] is None else new[3])
        state["segments"] = [*state.get("segments", []), segment]
        self._store._publish(state, base)

    def _postings(self, state: dict, terms: DataFrame) -> DataFrame:
        """Blocks of the buckets that terms lie in; the list of buckets is at most BUCKETS long and prunes the files."""
        buckets = [r[0] for r in terms.select(_bucket(F.col("term"))).distinct().collect()]
        return self._part(state, "postings").where(F.col("bucket").isin(buckets))

    @tidy
    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """(query_id, key, score, rank): the k best of each query (query_id, query), as bm25() gives them.

        Of a block its head is read first: with the largest count and the shortest document in it no document
        there can score more, and the sum over a query's terms bounds a range of documents. The best ranges are scored
        first; others are only read if their bound reaches the k-th score found there.
        """
        state = self._store.pinned()
        terms = written(queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term")), "terms")
        n = terms.count()
        blocks, asked = self._postings(state, terms), _sized(terms.select("term").distinct(), n)
        heads = written(blocks.select("term", "range", "top_tf", "low_n", "size").join(asked, "term"), "heads")
        less = self._part(state, "dead").select(F.explode("terms").alias("term")).join(asked, "term").groupBy("term").agg(F.count("*").alias("less"))
        df = heads.groupBy("term").agg(F.sum("size").alias("df")).join(less, "term", "left").select("term", (F.col("df") - F.coalesce("less", F.lit(0))).alias("df"))
        idf = F.ln((F.lit(state["docs"]) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        weighed = _sized(written(terms.join(df, "term").select("query_id", "term", idf.alias("idf")), "weighed"), n)
        mean = state["words"] / max(state["sized"], 1) or 1.0
        weight = lambda tf, n: F.col("idf") * (F.col(tf) * (K1 + 1) / (F.col(tf) + K1 * (1 - B + B * F.col(n) / F.lit(mean))))
        bounds = heads.join(weighed, "term").groupBy("query_id", "range").agg(F.sum(weight("top_tf", "low_n")).alias("bound"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "range"))
        bounds = written(bounds, "bounds")
        first = written(bounds.withColumn("place", place).where(F.col("place") <= FIRST).select("query_id", "range"), "first")
        dead = self._part(state, "dead").select("number")

        def scores(ranges: DataFrame, rows: int) -> DataFrame:
            read = blocks.select("term", "range", "entries").join(weighed, "term").join(_sized(ranges, rows), ["query_id", "range"], "left_semi")
            each = read.select("query_id", "idf", F.inline("entries")).join(dead, "number", "left_anti")
            return each.groupBy("query_id", "number").agg(F.round(F.sum(weight("tf", "n")), 9).alias("score"))

        best = written(scores(first, first.count()), "best")
        least = top_k(best, "query_id", F.desc("score"), "number", k).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        rest = bounds.join(first, ["query_id", "range"], "left_anti").join(least, "query_id", "left").where("least IS NULL OR bound >= least - 1e-6")
        rest = written(rest.select("query_id", "range"), "rest")
        left = rest.count()
        self.met, self.read = bounds.count(), first.count() + left
        # ties with the k-th stay until their keys are known
        tied = F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
        found = written(best.unionByName(scores(rest, left)).withColumn("tied", tied).where(F.col("tied") <= k), "found")
        keyed = found.join(self._part(state, "docs").select("number", "key"), "number")
        return top_k(keyed.select("query_id", "key", "score"), "query_id", F.desc("score"), "key", k)

    @tidy
    def compact(self) -> None:
        """All segments as one, without what is gone; numbers and scores stay. Texts are not needed for it.

        The folders of older segments are left to readers that still hold an earlier state.
        """
        state = self._store.pinned()
        if len(state.get("segments", [])) < 2:
            return
        base, segment = state["number"], uuid.uuid4().hex
        place, dead = f"{self.root}/segment-{segment}", self._part(state, "dead")
        self.documents(state).select("key", "number", "n", "terms").write.parquet(f"{place}/docs")
        each = self._part(state, "postings").select("term", F.inline("entries")).join(dead.select("number"), "number", "left_anti")
        entries = F.array_sort(F.collect_list(F.struct("number", "tf", "n"))).alias("entries")
        self._write_blocks(each.groupBy("term", F.floor(F.col("number") / RANGE).alias("range")).agg(entries), place)
        dead.limit(0).write.parquet(f"{place}/dead")
        state["segments"] = [segment]
        self._store._publish(state, base)
