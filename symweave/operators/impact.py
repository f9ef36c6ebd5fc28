"""Change impact: from changed lines to changed symbols to what depends on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import written
from .intervals import overlapping
from .traverse import _sized, clamp_depth

DEFAULT_DEPTH = 3
#: Paths that hold tests.
TEST_PATH = r"(^|/)(tests?/|test_[^/]*$|[^/]*_test\.[^/]*$)"


def changed_symbols(changes: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol_id) of symbols whose span overlaps a changed stretch (file_id, first_line, last_line)."""
    spans = symbols.select(F.col("id").alias("symbol_id"), "file_id", "start_line", "end_line")
    stretches = changes.select("file_id", "first_line", "last_line")
    return overlapping(stretches, spans, ["file_id"], ("first_line", "last_line"), ("start_line", "end_line")).select("symbol_id").distinct()


def impact(edges: DataFrame, seeds: DataFrame, symbols: DataFrame, files: DataFrame, depth: int = DEFAULT_DEPTH) -> DataFrame:
    """(symbol_id, depth, certainty, is_test, path) of what depends on the seeds (symbol_id).

    A symbol that resolved edges alone lead to within the depth is a definite hit, any other a possible
    one; symbols in test files and symbols with a `tests` edge among the way's edges are marked. The path is
    that of symbol ids from a seed to the symbol, of the least depth and then the lowest ids. One traversal
    tells all: it reaches symbols, and again those that so far only unsure edges led to.
    """
    used = edges.select(F.col("dst_symbol_id").alias("at"), F.col("src_symbol_id").alias("symbol_id"), (F.col("tier") == "resolved").alias("solid"), (F.col("kind") == "tests").alias("tested"))
    first = seeds.select("symbol_id").distinct().select("symbol_id", F.lit(True).alias("sure"), F.array("symbol_id").alias("path"), F.lit(False).alias("tested"))
    frontier = first.persist()
    held, rows = [frontier], frontier.count()
    total, visited, levels = rows, frontier.select("symbol_id", "sure"), []
    for d in range(1, clamp_depth(depth) + 1):
        if not rows:
            break
        hop = used.join(_sized(frontier.select(F.col("symbol_id").alias("at"), "sure", "path", F.col("tested").alias("before")), rows), "at")
        hop = hop.select("symbol_id", (F.col("sure") & F.col("solid")).alias("sure"), F.concat("path", F.array("symbol_id")).alias("path"), (F.col("tested") | F.col("before")).alias("tested"))
        best = hop.groupBy("symbol_id").agg(F.max("sure").alias("sure"), F.min("path").alias("path"), F.min_by("path", F.struct(~F.col("sure"), "path")).alias("solid_path"), F.max("tested").alias("tested"))
        known = _sized(visited.groupBy("symbol_id").agg(F.max("sure").alias("was_sure")), total)
        new = best.join(known, "symbol_id", "left").where("was_sure IS NULL OR (sure AND NOT was_sure)")
        found = new.select("symbol_id", F.lit(d).alias("depth"), "sure", "path", "solid_path", "tested").persist()
        # sure ways go on along their own path
        frontier = found.select("symbol_id", "sure", F.when(F.col("sure"), F.col("solid_path")).otherwise(F.col("path")).alias("path"), "tested")
        held.append(found)
        levels.append(found)
        rows = found.count()
        total += rows
        visited = visited.unionByName(found.select("symbol_id", "sure"))
    if not levels:
        levels = [first.limit(0).select("symbol_id", F.lit(0).alias("depth"), "sure", "path", F.col("path").alias("solid_path"), "tested")]
    states = reduce(DataFrame.unionByName, levels)
    # a symbol may be there twice, first by unsure edges and deeper by sure ones
    hits = states.groupBy("symbol_id").agg(F.min("depth").alias("depth"), F.max("sure").alias("sure"), F.min_by("path", "depth").alias("path"), F.max("tested").alias("tested"))
    hits = written(hits, "impact")
    for df in held:
        df.unpersist()
    named = hits.join(symbols.select(F.col("id").alias("symbol_id"), "file_id"), "symbol_id").join(files.select(F.col("id").alias("file_id"), F.col("path").alias("file")), "file_id", "left")
    return named.select(
        "symbol_id", "depth", F.when(F.col("sure"), "definite").otherwise("possible").alias("certainty"),
        (F.col("tested") | F.coalesce(F.col("file").rlike(TEST_PATH), F.lit(False))).alias("is_test"), "path",
    )


def test_edges(edges: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """`tests` edges, of the inferred tier: from symbols in test files to what they use outside of them.

    One for each pair of symbols, with the evidence of its edge of the lowest id.
    """
    of = symbols.select("id", "file_id").join(files.select(F.col("id").alias("file_id"), F.col("path").rlike(TEST_PATH).alias("t")), "file_id")
    a, b = (of.select(F.col("id").alias(c), F.col("t").alias(n)) for c, n in (("src_symbol_id", "ta"), ("dst_symbol_id", "tb")))
    used = edges.where(F.col("kind").isin("calls", "references", "inherits", "imports")).join(a.where("ta"), "src_symbol_id").join(b.where("NOT tb"), "dst_symbol_id")
    one = used.groupBy("src_symbol_id", "dst_symbol_id").agg(F.min(F.struct("id", "evidence_file_id", "evidence_line")).alias("e"))
    return one.select("src_symbol_id", "dst_symbol_id", F.lit("tests").alias("kind"), F.lit("inferred").alias("tier"), "e.evidence_file_id", "e.evidence_line")


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, r"[^/]*$", "")


def same_directory(changed: DataFrame, files: DataFrame) -> DataFrame:
    """(case_id, path): the plain guess that a change (case_id, path) touches the other files of its folder."""
    near = changed.withColumn("folder", _folder(F.col("path"))).join(files.select(F.col("path").alias("other"), _folder(F.col("path")).alias("folder")), "folder")
    return near.where("other != path").select("case_id", F.col("other").alias("path")).distinct()


def same_directory_score(changed: DataFrame, files: DataFrame) -> DataFrame:
    """Hits, predictions, truths, precision and recall of same_directory() against the changes (case_id, path) themselves.

    Counted without a row for a guess: a change with several paths in a folder guesses all files there, and
    one with a single path all others, so counts of each change and folder tell how many there are.
    """
    truth = changed.select("case_id", "path").distinct()
    known = files.select("path").distinct()
    marked = truth.join(known.withColumn("known", F.lit(1)), "path", "left").withColumn("folder", _folder(F.col("path")))
    own = marked.groupBy("case_id", "folder").agg(F.count("*").alias("paths"), F.count("known").alias("known"))
    sizes = known.groupBy(_folder(F.col("path")).alias("folder")).agg(F.count("*").alias("files"))
    single, count = F.col("paths") == 1, lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long"))
    guessed = own.join(sizes, "folder").agg(
        count(F.when(~single & F.col("case_id").isNotNull(), F.col("known"))).alias("hits"),
        count(F.col("files") - F.when(single, F.col("known")).otherwise(0)).alias("predictions"),
    )
    return guessed.crossJoin(truth.agg(F.count("*").alias("truths"))).select(
        "hits", "predictions", "truths",
        F.when(F.col("predictions") > 0, F.col("hits") / F.col("predictions")).alias("precision"),
        F.when(F.col("truths") > 0, F.col("hits") / F.col("truths")).alias("recall"),
    )
