"""Mixing sources to target weights by systematic sampling.

Sources in code point order, null last, weigh 3, 1, 2 and so on, and share a multiple of all
words. A target stops at a multiple of its source's size; what is over goes to the others by
weight until none is above. A document's expected copies are target over size of its source.
Their prefix sum runs along the source in bands of nearby sizes, one random offset is added,
and a document is emitted once for each integer that its stretch crosses. Sampling along
sizes keeps a source's words within about one band of its target.

The prefix sum of equal steps is the rank times the step; ranks come from bands and buckets
that are numbered apart, so the source that holds a third of all rows is spread over many
tasks. The table of sources has one row for each source and is the only thing sorted as one.

Defined results: null texts have size 0; null sources are one source, the last; null ids
go to buckets by a hash of their text and come first there; repeated rows are sampled one by one; very long texts are measured whole; ties of size go by id; sources of size 0 have
target 0 and no words; an empty table gives an empty result; other columns are ignored
(`mix_plan`) or kept (`mixed`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ranked, table, tidy, written

WORD = r"[^\x20\x09-\x0D]+"
#: Fixed values of the standing mix.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
SEED = 20240229
#: Words in a band of sizes, and the number of bands; the last one has all larger sizes.
BAND, BANDS = 32, 1024
#: Into how many buckets a band of a source is split, so that one may hold a third of all rows; the same at every size.
BUCKETS = 256


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sources (none, s, source_size, in key order none, s) with their target."""
    order = Window.orderBy("none", "s")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    # sources fill up in the order of cap over weight; level: what a weight of 1 gets if this and all later ones stay below
    ranked_ = sources.withColumn("w", weight).withColumn("ratio", F.col("source_size") * most / F.col("w"))
    all_, fill = Window.partitionBy(), Window.orderBy("ratio", "none", "s")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    levels = ranked_.select(
        "*",
        F.row_number().over(fill).alias("place"),
        (
            (F.sum("source_size").over(all_) * F.lit(float(share)) - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most)
            / (F.sum("w").over(all_) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        ).alias("level"),
    )
    below = F.col("level") < F.col("ratio")
    first = levels.withColumn("at", F.min(F.when(below, F.col("place"))).over(all_))
    found = first.withColumn("common", F.max(F.when(F.col("place") == F.col("at"), F.col("level"))).over(all_))
    full = F.col("at").isNull() | (F.col("place") < F.col("at"))
    target = F.when(full, (F.col("source_size") * most).cast("double")).otherwise(F.col("common") * F.col("w"))
    return found.select("none", "s", "source_size", target.alias("target"))


@tidy
def mix_plan(docs: DataFrame, key: str = "doc_id", seed: int = SEED, most: int = MOST) -> DataFrame:
    """(id, size, source_size, target, copies) for every row."""
    text = F.coalesce(docs["text"], F.lit(""))
    sized = written(
        docs.select(
            docs[f"`{key}`"].alias("id"),
            docs["source"].isNull().alias("none"),
            F.coalesce(docs["source"], F.lit("")).alias("s"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
            F.coalesce(F.pmod(docs[f"`{key}`"], F.lit(BUCKETS)), F.conv(F.substring(F.md5(text), 1, 2), 16, 10)).cast("int").alias("bucket"),
        ),
        "sizes",
    )
    rows = sized.withColumn("band", F.least(F.floor(F.col("size") / BAND), F.lit(BANDS - 1)))
    rows = ranked(rows, ["none", "s"], ["band", "bucket"], ["size", "id"])
    plan = targets(sized.groupBy("none", "s").agg(F.sum("size").alias("source_size")), most=most)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.when(F.col("none"), "null").otherwise(F.concat(F.lit("="), "s")))), 1, 8), 16, 10)
    plan = plan.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    plan = written(plan.withColumn("offset", offset.cast("double") / 4294967296.0), "targets")
    crossed = F.floor(F.col("offset") + (F.col("rank") + 1) * F.col("rate")) - F.floor(F.col("offset") + F.col("rank") * F.col("rate"))
    return rows.join(plan, ["none", "s"]).select(
        "id", "none", "s", "size", "source_size", "target", F.least(crossed, F.lit(most)).cast("long").alias("copies")
    )


@tidy
def mixed(docs: DataFrame, key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """The rows that the mix takes, as often as it takes them, with all columns.

    Rows that share id, source and size are interchangeable, and share their copies out.
    """
    plan = mix_plan(docs, key, seed).groupBy("id", "none", "s", "size").agg(F.count("*").alias("rows"), F.sum("copies").alias("total"))
    plan = written(plan.where("total > 0"), "mix")  # narrow; documents move once
    columns = docs.columns
    row = docs.select(F.struct(*[docs[f"`{c}`"] for c in columns]).alias("row"), docs[f"`{key}`"].alias("of"), docs["source"].alias("source"), docs["text"].alias("text"))
    marked = row.select(
        "row", "of", F.col("source").isNull().alias("no"), F.coalesce("source", F.lit("")).alias("by"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("long"),
    )
    same = marked["of"].eqNullSafe(plan["id"]) & (marked["no"] == plan["none"]) & (marked["by"] == plan["s"]) & (marked["long"] == plan["size"])
    # the plan has a row for almost every document, so it is never a side to broadcast
    taken = marked.join(plan.hint("merge"), same).select("row", "of", "no", "by", "long", "rows", "total")
    single = taken.where("rows = 1").withColumn("copies", F.col("total"))
    plain = [F.col("row").getField(c) for c in columns if "map" not in docs.schema[c].dataType.simpleString()]
    alike = Window.partitionBy("of", "no", "by", "long").orderBy(F.xxhash64(*plain))
    several = taken.where("rows > 1").withColumn("at", F.row_number().over(alike) - 1)
    share = F.floor((F.col("at") + 1) * F.col("total") / F.col("rows")) - F.floor(F.col("at") * F.col("total") / F.col("rows"))
    both = single.unionByName(several.withColumn("copies", share).drop("at"))
    repeated = both.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return repeated.select(*[F.col("row").getField(c).alias(c) for c in columns])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(table(spark, sf_dir, "documents"))
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE_SQL = f"""
WITH sized AS (
  SELECT doc_id, source IS NULL AS none, coalesce(source, '') AS s,
    CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
    coalesce((doc_id % {BUCKETS} + {BUCKETS}) % {BUCKETS}, CAST('0x' || substr(md5(coalesce(text, '')), 1, 2) AS BIGINT)) AS bucket FROM documents
), banded AS (
  SELECT *, least(size // {BAND}, {BANDS - 1}) AS band FROM sized
), ranks AS (
  SELECT *, row_number() OVER (PARTITION BY none, s ORDER BY band, bucket, size, doc_id NULLS FIRST) - 1 AS rank FROM banded
), src AS (
  SELECT none, s, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY ALL
), weighted AS (
  SELECT *, [3, 1, 2][1 + ((row_number() OVER (ORDER BY none, s) - 1) % 3)] AS w FROM src
), leveled AS (
  SELECT *, source_size * 2 / w AS ratio, row_number() OVER fill AS place,
    (sum(source_size) OVER () * CAST(1.5 AS DOUBLE) - coalesce(sum(source_size) OVER before, 0) * 2)
      / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM weighted
  WINDOW fill AS (ORDER BY source_size * 2 / w, none, s),
    before AS (ORDER BY source_size * 2 / w, none, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), cut AS (
  SELECT min(place) AS stop, arg_min(level, place) AS common FROM leveled WHERE level < ratio
), goal AS (
  SELECT none, s, source_size, CASE WHEN stop IS NULL OR place < stop THEN CAST(source_size * 2 AS DOUBLE) ELSE common * w END AS target
  FROM leveled, cut
), rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
    CAST(CAST('0x' || substr(md5('{SEED}:' || CASE WHEN none THEN 'null' ELSE '=' || s END), 1, 8) AS UBIGINT) AS DOUBLE) / 4294967296.0 AS u
  FROM goal
)
SELECT doc_id, size, source_size, target,
  size * CAST(least(floor(u + (rank + 1) * rate) - floor(u + rank * rate), 2) AS BIGINT) AS taken
FROM ranks JOIN rates USING (none, s)
"""
