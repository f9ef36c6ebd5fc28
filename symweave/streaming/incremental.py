"""Incremental re-indexing: which files changed, as a batch and as a stream of file snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import ancestor_scopes, last_segment


def file_changes(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(path, change, old_sha, new_sha) of two snapshots (path, blob_sha): added, changed, unchanged or deleted."""
    a, b = stored.select("path", F.col("blob_sha").alias("old_sha")), current.select("path", F.col("blob_sha").alias("new_sha"))
    change = (
        F.when(F.col("old_sha").isNull(), "added").when(F.col("new_sha").isNull(), "deleted").when(F.col("old_sha") == F.col("new_sha"), "unchanged").otherwise("changed")
    )
    return a.join(b, "path", "full_outer").select("path", change.alias("change"), "old_sha", "new_sha")


def affected_files(changes: DataFrame, files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(file_id) to read again: changed files and those with an edge to or from a symbol in one."""
    touched = changes.where(F.col("change").isin("changed", "deleted")).join(files.select("path", F.col("id").alias("file_id")), "path").select("file_id").distinct()
    of = symbols.select(F.col("id").alias("symbol_id"), "file_id")
    ends = edges.select(F.col("src_symbol_id").alias("a"), F.col("dst_symbol_id").alias("b"))
    both = ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b")))
    inside = of.join(touched, "file_id", "left_semi").select(F.col("symbol_id").alias("a"))
    near = both.join(inside, "a", "left_semi").select(F.col("b").alias("symbol_id")).join(of, "symbol_id").select("file_id")
    return touched.unionByName(near).distinct()


def affected_sources(references: DataFrame, names: DataFrame) -> DataFrame:
    """(src_qualified_name) of sources whose edges may differ once symbols of the names (qualified_name) have come, gone or changed.

    Every rule of resolution ends in a symbol whose last segment is that of the target, and depends
    besides on the scopes around the source alone. All references of a source are resolved together,
    as they share its edges.
    """
    bare = names.select(last_segment(F.col("qualified_name")).alias("bare")).distinct()
    by_target = references.withColumn("bare", last_segment(F.col("target_text"))).join(bare, "bare", "left_semi").select("src_qualified_name")
    scopes = references.select("src_qualified_name").distinct().withColumn("scope", F.explode(ancestor_scopes(F.col("src_qualified_name"))))
    by_scope = scopes.join(names.select(F.col("qualified_name").alias("scope")).distinct(), "scope", "left_semi").select("src_qualified_name")
    return by_target.unionByName(by_scope).distinct()


def newest(stored: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Of snapshots (path, seq, content or null), the latest of each path that is later than the stored one (path, seq).

    Snapshots with one seq should say the same; if not, the one with the highest content counts. A
    path may come any number of times: all but the last are dropped before the shuffle.
    """
    place = F.struct("seq", F.col("content").isNotNull(), F.sha2("content", 256))
    last = snapshots.where("path IS NOT NULL AND seq IS NOT NULL").groupBy("path").agg(F.max_by(F.struct("seq", "content"), place).alias("s")).select("path", "s.seq", "s.content")
    before = stored.select("path", F.col("seq").alias("was"))
    return last.join(before, "path", "left").where("was IS NULL OR seq > was").select("path", "seq", "content")


def watch(spark: SparkSession, folder: str, checkpoint: str, apply: Callable[[DataFrame, int], None], available_now: bool = True) -> StreamingQuery:
    """Stream snapshots of files (path, seq, content, as Parquet in a folder) into apply(files, batch).

    A batch that fails, or whose end was not noted before the driver was lost, is given again with its number:
    apply must be repeatable, or refuse a number that it knows.
    """
    source = spark.readStream.schema("path string, seq long, content binary").parquet(folder)
    writer = source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
