"""Counts and status, zero-filled over the domains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import byte_size
from ..schemas import SYMBOL_KINDS, TIERS, domain
from .store import one_of_each
from .traverse import DEFAULT_LIMIT


def _filled(df: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    all_ = domain(df.sparkSession, values, column)
    return all_.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"), "place").orderBy("place").drop("place")


def symbol_counts(symbols: DataFrame) -> DataFrame:
    return _filled(symbols, "kind", SYMBOL_KINDS)


def edge_counts(edges: DataFrame) -> DataFrame:
    return _filled(edges, "tier", TIERS)


def latest_runs(runs: DataFrame) -> DataFrame:
    """The run with the highest id of each repository, with its duration in seconds, null while it runs."""
    last = one_of_each(runs, ["repo_id"], ["id"], last=True)
    seconds = F.unix_micros(F.col("finished_at").cast("timestamp")) / 1e6 - F.unix_micros(F.col("started_at").cast("timestamp")) / 1e6
    return last.withColumn("duration_seconds", seconds)


def run_from_sha(runs: DataFrame) -> DataFrame:
    """runs with from_sha, the to_sha of the run before."""
    return runs.withColumn("from_sha", F.lag("to_sha").over(Window.partitionBy("repo_id").orderBy("id")))


def indexed_totals(files: DataFrame, read: DataFrame) -> DataFrame:
    """One row: files indexed, and files that were read but skipped."""
    return read.select(F.count("*").alias("seen")).crossJoin(files.select(F.count("*").alias("indexed"))).select("indexed", (F.col("seen") - F.col("indexed")).alias("skipped"))


def sizes(files: DataFrame) -> DataFrame:
    """(root_path, size_bytes, files) of files (root_path, length)."""
    return files.groupBy("root_path").agg(F.sum("length").alias("size_bytes"), F.count("*").alias("files"))


def first_files(files: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    return files.orderBy("path", "id").limit(limit)


def first_symbols(symbols: DataFrame, file_id: int | None = None, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Of a file in reading order, or of all by id."""
    return (symbols.orderBy("id") if file_id is None else symbols.where(F.col("file_id") == file_id).orderBy("start_line", "id")).limit(limit)


def listing(registry: DataFrame, repos: DataFrame, sizes: DataFrame) -> DataFrame:
    """Registered repositories with size and status; one without an index is listed with nulls."""
    own = repos.select("root_path", "indexed_sha", "indexed_at", "scip_status")
    joined = registry.join(own, "root_path", "left").join(sizes, "root_path", "left")
    size = F.coalesce("size_bytes", F.lit(0))
    return joined.select("root_path", "registered_at", "indexed_sha", "indexed_at", "scip_status", size.alias("size_bytes"), byte_size(size).alias("size"))


def drift(indexed_sha: str | None, current_sha: str | None, behind: int | None) -> tuple[str, int | None]:
    """How an index stands to its working copy, as one of five cases, and by how many commits if that is known.

    untracked: indexed outside of git; detached: no git there now; current; behind; diverged: not to be counted.
    """
    if indexed_sha is None:
        return "untracked", None
    if current_sha is None:
        return "detached", None
    if indexed_sha == current_sha:
        return "current", 0
    return ("diverged", None) if behind is None else ("behind", behind)


def token_costs(usage: DataFrame, prices: DataFrame, by: list[str]) -> DataFrame:
    """Tokens and their cost for each value of `by`; usage: (model, tokens_in, tokens_out), prices: (model, price_in, price_out) a million.

    A model without a price costs null, not nothing.
    """
    priced = usage.join(prices, "model", "left")
    cost = (F.col("tokens_in") * F.col("price_in") + F.col("tokens_out") * F.col("price_out")) / 1e6
    sums = priced.groupBy(*by).agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum(cost).alias("cost"), F.count_if(cost.isNull()).alias("unpriced"))
    return sums.select(*by, "tokens_in", "tokens_out", F.when(F.col("unpriced") == 0, F.col("cost")).alias("cost"))


def precision_recall(predicted: DataFrame, truth: DataFrame, keys: list[str], by: str | None = None) -> DataFrame:
    """Hits, predictions, truths, precision and recall, for each value of `by` among the predictions."""
    groups = [by] if by else []
    known = truth.select(*keys).distinct()
    total = known.agg(F.count("*").alias("truths"))
    marked = predicted.select(*keys, *groups).distinct().join(known.withColumn("hit", F.lit(1)), keys, "left")
    counts = marked.groupBy(*groups).agg(F.count("hit").alias("hits"), F.count("*").alias("predictions"))
    return counts.crossJoin(total).select(
        *groups, "hits", "predictions", "truths",
        F.when(F.col("predictions") > 0, F.col("hits") / F.col("predictions")).alias("precision"),
        F.when(F.col("truths") > 0, F.col("hits") / F.col("truths")).alias("recall"),
    )
