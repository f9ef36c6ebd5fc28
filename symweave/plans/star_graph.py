"""A symbol graph over the star-schema tables, as DataFrames and as the same in SQL.

Ids are packed from keys, so no row has to be numbered: an edge's id orders by source, target,
kind and tier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import scratch

FILE0, CLASS0, FUNCTION0, METHOD0, VARIABLE0 = 1_000_000, 2_000_000, 3_000_000, 10_000_000, 5_000_000
WIDE_SEED, DEEP_SEED = 2_000_001, 5_000_008


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def files(spark: SparkSession, sf: str) -> DataFrame:
    n = _t(spark, sf, "nation")
    return n.select((F.lit(FILE0) + F.col("n_nationkey")).cast("long").alias("id"), F.concat(F.lit("r"), "n_regionkey", F.lit("/n"), "n_nationkey", F.lit(".py")).alias("path"))


def symbols(spark: SparkSession, sf: str) -> DataFrame:
    """(id, file_id, kind, name, qualified_name, start_line, end_line)."""
    n = _t(spark, sf, "nation").select("n_nationkey", F.concat(F.lit("r"), "n_regionkey", F.lit(".n"), "n_nationkey").alias("nq"))
    s, c, o, p = (_t(spark, sf, t) for t in ("supplier", "customer", "orders", "part"))

    def row(id_: Column, file: Column, kind: str, name: Column, qualified: Column, start: Column, length: int) -> list[Column]:
        return [
            id_.cast("long").alias("id"), (F.lit(FILE0) + file).cast("long").alias("file_id"), F.lit(kind).alias("kind"), name.alias("name"),
            qualified.alias("qualified_name"), start.cast("int").alias("start_line"), (start + length).cast("int").alias("end_line"),
        ]

    key = lambda letter, column: F.concat(F.lit(letter), F.col(column))
    nation = n.select(*row(FILE0 + F.col("n_nationkey"), F.col("n_nationkey"), "file", F.concat(key("n", "n_nationkey"), F.lit(".py")), F.col("nq"), F.lit(1), 1_999_999_998))
    sn = s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"])
    supplier = sn.select(*row(CLASS0 + F.col("s_suppkey"), F.col("s_nationkey"), "class", key("s", "s_suppkey"), F.concat("nq", F.lit("."), key("s", "s_suppkey")), F.col("s_suppkey") * 10 + 1, 8))
    cn = c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"])
    cq = F.concat("nq", F.lit("."), key("c", "c_custkey"))
    start = F.col("c_custkey") * 10 + 100_000_001
    customer = cn.select(*row(FUNCTION0 + F.col("c_custkey"), F.col("c_nationkey"), "function", key("c", "c_custkey"), cq, start, 8))
    on = o.join(cn, o["o_custkey"] == cn["c_custkey"])
    order = on.select(*row(METHOD0 + F.col("o_orderkey"), F.col("c_nationkey"), "method", key("o", "o_orderkey"), F.concat(cq, F.lit("."), key("o", "o_orderkey")), start + 1 + F.col("o_orderkey") % 7, 0))
    part = p.select(*row(VARIABLE0 + F.col("p_partkey"), F.col("p_partkey") % 25, "variable", key("p", "p_partkey"), key("p", "p_partkey"), F.col("p_partkey") * 10 + 500_000_001, 0))
    return nation.unionByName(supplier).unionByName(customer).unionByName(order).unionByName(part)


_KIND_PLACE = {"calls": 0, "defines": 1, "imports": 2, "inherits": 3, "references": 4}
_TIER_PLACE = {"heuristic": 0, "resolved": 1}
_BITS = 1 << 28


#: Lines of orders that meet in one task, about; their edges fit its memory.
TASK_LINES = 500_000


def _packed_edges(spark: SparkSession, sf: str) -> DataFrame:
    """(id, evidence_line), one row for each natural key, which the id holds: what is shuffled and stored of an edge.

    All edges of a source are brought together as one narrow row for each row of the tables, in so many parts that
    one fits a task, and become edges there: a line is moved once for its two, and equal ones meet without a shuffle.
    """
    n, s, c, o, li, p = (_t(spark, sf, t) for t in ("nation", "supplier", "customer", "orders", "lineitem", "part"))
    col, nil = F.col, F.lit(None).cast("long")

    def row(df: DataFrame, src: Column, dst: Column, kind: str, place: Column | None = None, line: Column | None = None, other: Column | None = None) -> DataFrame:
        place = place if place is not None else F.lit(_TIER_PLACE["heuristic"])
        rest = [F.lit(_KIND_PLACE[kind] * 2).cast("int") + place.cast("int"), (line if line is not None else F.lit(1)).cast("int"), other.cast("long") if other is not None else nil]
        return df.select(src.cast("long").alias("src"), dst.cast("long").alias("dst"), *[x.alias(name) for x, name in zip(rest, ("place", "line", "part"), strict=True)])

    tier = F.when(col("l_linestatus") == "F", _TIER_PLACE["resolved"]).otherwise(_TIER_PLACE["heuristic"])
    rows = [
        row(s, FILE0 + col("s_nationkey"), CLASS0 + col("s_suppkey"), "defines"),
        row(c, FILE0 + col("c_nationkey"), FUNCTION0 + col("c_custkey"), "defines"),
        row(o, FUNCTION0 + col("o_custkey"), METHOD0 + col("o_orderkey"), "defines"),
        row(li, METHOD0 + col("l_orderkey"), CLASS0 + col("l_suppkey"), "calls", tier, col("l_linenumber"), VARIABLE0 + col("l_partkey")),
        row(n, FILE0 + col("n_nationkey"), FILE0 + (col("n_nationkey") * 7 + 3) % 25, "imports"),
        row(p.where("p_partkey % 8 != 0"), VARIABLE0 + col("p_partkey"), VARIABLE0 + col("p_partkey") - 1, "inherits"),
    ]
    all_ = rows[0]
    for part in rows[1:]:
        all_ = all_.unionByName(part)
    # a nation's file defines very many customers, so a source's rows are dealt by their target too, but for those of an order's lines
    of_line = F.shiftright("place", 1) == _KIND_PLACE["calls"]
    deal = F.when(of_line, col("src")).otherwise(F.xxhash64("src", "dst"))
    parts = max(1, -(-(li.count() + o.count() // 2) // TASK_LINES))
    dealt = all_.withColumn("deal", deal).repartition(parts, "deal")
    called = F.struct("dst", "place", "line")
    used = F.struct(col("part").alias("dst"), (col("place") + 2 * (_KIND_PLACE["references"] - _KIND_PLACE["calls"])).alias("place"), "line")
    each = dealt.select("deal", "src", F.inline(F.when(of_line, F.array(called, used)).otherwise(F.array(called)))).where("src != dst")
    id_ = (col("src") * _BITS + col("dst")) * 16 + col("place")
    fits = (col("src") >= 0) & (col("src") < 1 << 31) & (col("dst") >= 0) & (col("dst") < _BITS)
    packed = each.select("deal", F.when(fits, id_).otherwise(F.raise_error(F.lit("a key is too large for an edge's id"))).cast("long").alias("id"), "line")
    return packed.groupBy("deal", "id").agg(F.min("line").alias("evidence_line")).select("id", "evidence_line")


def _unpacked(packed: DataFrame) -> DataFrame:
    """(id, src_symbol_id, dst_symbol_id, kind, tier, evidence_file_id, evidence_line) of packed edges."""
    id_ = F.col("id")

    def named(of: dict[str, int], place: Column) -> Column:
        (first, at), *rest = of.items()
        chosen = F.when(place == at, first)
        for name, at in rest:
            chosen = chosen.when(place == at, name)
        return chosen

    src = F.shiftright(id_, 32)
    return packed.select(
        id_, src.alias("src_symbol_id"), F.shiftright(id_, 4).bitwiseAND(F.lit(_BITS - 1)).alias("dst_symbol_id"), named(_KIND_PLACE, F.shiftright(id_, 1).bitwiseAND(F.lit(7))).alias("kind"),
        named(_TIER_PLACE, id_.bitwiseAND(F.lit(1))).alias("tier"), (F.lit(FILE0) + src % 27).cast("long").alias("evidence_file_id"), "evidence_line",
    )


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """(id, src_symbol_id, dst_symbol_id, kind, tier, evidence_file_id, evidence_line), one row for each natural key."""
    return _unpacked(_packed_edges(spark, sf))


_STORED: dict[tuple[str, str], str] = {}


def stored_edges(spark: SparkSession, sf: str) -> DataFrame:
    """edges() from a stored table, as an index has one: written once for a session and folder, packed."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STORED:
        path = scratch(spark, "star-edges")
        _packed_edges(spark, sf).write.parquet(path)
        _STORED[key] = path
    return _unpacked(spark.read.parquet(_STORED[key]))


_CASE = lambda of, column: f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in of.items()) + " END"

FILES_SQL = f"SELECT CAST({FILE0} + n_nationkey AS BIGINT) AS id, 'r' || n_regionkey || '/n' || n_nationkey || '.py' AS path FROM nation"

SYMBOLS_SQL = f"""
SELECT CAST({FILE0} + n_nationkey AS BIGINT) AS id, CAST({FILE0} + n_nationkey AS BIGINT) AS file_id, 'file' AS kind, 'n' || n_nationkey || '.py' AS name,
  'r' || n_regionkey || '.n' || n_nationkey AS qualified_name, 1 AS start_line, 1999999999 AS end_line FROM nation
UNION ALL SELECT CAST({CLASS0} + s_suppkey AS BIGINT), CAST({FILE0} + s_nationkey AS BIGINT), 'class', 's' || s_suppkey,
  'r' || n_regionkey || '.n' || n_nationkey || '.s' || s_suppkey, CAST(s_suppkey * 10 + 1 AS INT), CAST(s_suppkey * 10 + 9 AS INT)
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT CAST({FUNCTION0} + c_custkey AS BIGINT), CAST({FILE0} + c_nationkey AS BIGINT), 'function', 'c' || c_custkey,
  'r' || n_regionkey || '.n' || n_nationkey || '.c' || c_custkey, CAST(c_custkey * 10 + 100000001 AS INT), CAST(c_custkey * 10 + 100000009 AS INT)
  FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT CAST({METHOD0} + o_orderkey AS BIGINT), CAST({FILE0} + c_nationkey AS BIGINT), 'method', 'o' || o_orderkey,
  'r' || n_regionkey || '.n' || n_nationkey || '.c' || c_custkey || '.o' || o_orderkey,
  CAST(c_custkey * 10 + 100000002 + o_orderkey % 7 AS INT), CAST(c_custkey * 10 + 100000002 + o_orderkey % 7 AS INT)
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT CAST({VARIABLE0} + p_partkey AS BIGINT), CAST({FILE0} + p_partkey % 25 AS BIGINT), 'variable', 'p' || p_partkey, 'p' || p_partkey,
  CAST(p_partkey * 10 + 500000001 AS INT), CAST(p_partkey * 10 + 500000001 AS INT) FROM part
"""

EDGES_SQL = f"""
SELECT ((src_symbol_id * {_BITS} + dst_symbol_id) * 8 + {_CASE(_KIND_PLACE, "kind")}) * 2 + {_CASE(_TIER_PLACE, "tier")} AS id, src_symbol_id, dst_symbol_id, kind, tier,
  {FILE0} + src_symbol_id % 27 AS evidence_file_id, evidence_line
FROM (
  SELECT src AS src_symbol_id, dst AS dst_symbol_id, kind, tier, CAST(min(line) AS INT) AS evidence_line FROM (
    SELECT CAST({FILE0} + s_nationkey AS BIGINT) AS src, CAST({CLASS0} + s_suppkey AS BIGINT) AS dst, 'defines' AS kind, 'heuristic' AS tier, 1 AS line FROM supplier
    UNION ALL SELECT {FILE0} + c_nationkey, {FUNCTION0} + c_custkey, 'defines', 'heuristic', 1 FROM customer
    UNION ALL SELECT {FUNCTION0} + o_custkey, {METHOD0} + o_orderkey, 'defines', 'heuristic', 1 FROM orders
    UNION ALL SELECT {METHOD0} + l_orderkey, {CLASS0} + l_suppkey, 'calls', CASE WHEN l_linestatus = 'F' THEN 'resolved' ELSE 'heuristic' END, l_linenumber FROM lineitem
    UNION ALL SELECT {METHOD0} + l_orderkey, {VARIABLE0} + l_partkey, 'references', CASE WHEN l_linestatus = 'F' THEN 'resolved' ELSE 'heuristic' END, l_linenumber FROM lineitem
    UNION ALL SELECT {FILE0} + n_nationkey, {FILE0} + (n_nationkey * 7 + 3) % 25, 'imports', 'heuristic', 1 FROM nation
    UNION ALL SELECT {VARIABLE0} + p_partkey, {VARIABLE0} + p_partkey - 1, 'inherits', 'heuristic', 1 FROM part WHERE p_partkey % 8 <> 0
  ) WHERE src <> dst GROUP BY ALL
)
"""


def with_graph(body: str, recursive: str = "") -> str:
    """SQL with files, symbols and edges as common tables; recursive: further ones."""
    return f"WITH RECURSIVE gfiles AS ({FILES_SQL}), gsymbols AS ({SYMBOLS_SQL}), gedges AS ({EDGES_SQL}){', ' + recursive if recursive else ''} {body}"


def reach_sql(seed: int, depth: int, tiers: tuple[str, ...] = (), collapse: tuple[str, ...] = ("kind",)) -> str:
    """Common tables up to `hits`: edges by which symbols depend on the seed, with their depth."""
    where = f" AND tier IN ({', '.join(map(repr, tiers))})" if tiers else ""
    return f"""used AS (SELECT * FROM gedges WHERE true{where}),
walk AS (
  SELECT CAST({seed} AS BIGINT) AS node, 0 AS depth
  UNION SELECT src_symbol_id, depth + 1 FROM walk JOIN used ON dst_symbol_id = node WHERE depth < {depth}
), shortest AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node),
hits AS (
  SELECT e.*, s.depth FROM shortest s JOIN used e ON e.src_symbol_id = s.node JOIN shortest t ON e.dst_symbol_id = t.node AND t.depth = s.depth - 1 WHERE s.node <> {seed}
  QUALIFY row_number() OVER (PARTITION BY e.src_symbol_id, {", ".join(f"e.{c}" for c in collapse)} ORDER BY e.id) = 1
)"""
