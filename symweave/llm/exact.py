"""Exact dedup on native expressions only.

Equality is after lower-casing A-Z only. Texts meet by a 128-bit digest; within digests
that several rows share the bytes themselves are compared, so a digest collision cannot join
different texts. Shuffles carry digests and ids. Texts move only for shared digests, and
there the map-side combine leaves one row per task and distinct text: a text that a third
of all rows repeat is never gathered row by row.

Defined results: a null text is the empty text; rows with a null id take part, and a group
of null ids only keeps null; repeated rows with equal ids are all kept or all dropped; an
empty table gives an empty result; very long texts are hashed and compared whole; other columns of
the input are ignored (`exact_groups`) or kept, whatever their names (`drop_copies`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import looks_listed, table, tidy, unused, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; for pure ASCII that is the much faster lower()."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def digest(text: Column) -> Column:
    """128 bits."""
    return F.unhex(F.md5(text.cast("binary")))


@tidy
def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "largest") -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256) for every row.

    keep: which id of a group stays, "smallest" or "largest"; both are stable on reruns.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    best = F.max if keep == "largest" else F.min
    k, t = docs[f"`{key}`"], docs[f"`{text}`"]
    rows = written(
        docs.select(k.alias("id"), ascii_lower(t).alias("t")).select("id", digest(F.col("t")).alias("d"), F.sha2("t", 256).alias("sha")),
        "digests",
    )
    groups = rows.groupBy("d").agg(best("id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = written(groups, "groups")
    shared = groups.where("group_size > 1").select("d")
    # bytes inside shared digests: classes of equal text, and how many each digest has
    all_texts = docs.select(k.alias("id"), ascii_lower(t).alias("t")).select("id", "t", digest(F.col("t")).alias("d"))
    texts = (
        looks_listed(all_texts, F.col("d"), shared, F.col("d"), "shared")
        .where("shared")
        .join(shared, "d", "left_semi")
        .groupBy("d", "t")
        .agg(best("id").alias("keep_id"), F.count("*").alias("group_size"))
        .select("d", F.sha2("t", 256).alias("sha"), "keep_id", "group_size")
    )
    classes = written(texts, "classes")
    split = classes.groupBy("d").agg(F.count("*").alias("n")).where("n > 1").select("d")
    if split.isEmpty():
        out = rows.join(groups, "d")
    else:  # digests that stand for several texts: told apart by a second, independent digest
        if not classes.join(split, "d", "left_semi").groupBy("d", "sha").count().where("count > 1").isEmpty():
            raise RuntimeError("two digests collide on the same pair of texts")
        apart = classes.join(split, "d", "left_semi").select("d", "sha", "keep_id", "group_size")
        out = rows.join(split, "d", "left_anti").join(groups, "d").unionByName(rows.join(apart, ["d", "sha"]))
    return out.select(
        F.col("id").alias(key),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


@tidy
def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of docs that stay, all columns.

    Of rows that also share the id, as repeated rows do, one stays. Only rows whose text looks
    shared are joined with the groups; the others pass where they are.
    """
    id_, sha, look = unused(docs, "__id", "__sha", "__shared")
    groups = written(exact_groups(docs, key, text, keep).select(F.col(key).alias(id_), F.col("text_sha256").alias(sha), "group_size", "kept"), "exact")
    several = groups.where("group_size > 1").select(id_, sha, "kept")
    keepers = written(several.where("kept").groupBy(id_, sha).agg(F.count("*").alias("rows")), "keepers")
    repeated, keepers = keepers.where("rows > 1").select(id_, sha), keepers.select(id_, sha)
    k, t = docs[f"`{key}`"], docs[f"`{text}`"]
    marked = docs.withColumns({sha: F.sha2(ascii_lower(t), 256), id_: k})
    marked = looks_listed(marked, F.col(sha), several.select(sha), F.col(sha), look)
    alone, looked = marked.where(~F.col(look)), marked.where(look)
    same = lambda a, b: a[id_].eqNullSafe(b[id_]) & (a[sha] == b[sha])
    alone = alone.unionByName(looked.join(several.select(sha).distinct(), sha, "left_anti").select(*[F.col(f"`{c}`") for c in marked.columns]))
    stay = looked.join(keepers, same(looked, keepers), "left_semi")
    if not repeated.isEmpty():
        once = stay.join(repeated, same(stay, repeated), "left_semi").dropDuplicates([id_, sha])
        stay = stay.join(repeated, same(stay, repeated), "left_anti").unionByName(once)
    return alone.unionByName(stay).select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


ORACLE_SQL = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS n FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY n) AS keep_id, count(*) OVER (PARTITION BY n) AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY n) AS kept, sha256(n) AS text_sha256
FROM t
"""
