"""Named queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import impact, report, resolve, retrieve, store, traverse
from ..schemas import SYMBOL_KINDS, TIERS
from ..shared import written
from ..sources import python_source
from ..streaming.incremental import file_changes
from . import fixtures as fx
from . import star_graph as g

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    from . import extraction, features  # noqa: F401, as they register theirs

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """What depends on the widest class within four hops, with names and evidence."""
    name = g.symbols(spark, sf).where(F.col("id") == g.WIDE_SEED).select("qualified_name").first()[0]
    return traverse.find_references(g.symbols(spark, sf), g.files(spark, sf), _kept_edges(spark, sf), name, 4)


def _kept_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges for several hops, which an index has stored."""
    return g.stored_edges(spark, sf)


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# -- edges and traversal

_EDGE = "id, src_symbol_id, dst_symbol_id, kind, tier, evidence_file_id, evidence_line"


@_query(g.with_graph(f"SELECT {_EDGE} FROM gedges WHERE dst_symbol_id = {g.WIDE_SEED} ORDER BY id LIMIT 1000"))
def edges_to_one_hop(spark, sf):
    return traverse.edges_to(g.edges(spark, sf), g.WIDE_SEED)


@_query(g.with_graph(f"SELECT {_EDGE} FROM gedges WHERE src_symbol_id = {g.METHOD0 + 1} ORDER BY id LIMIT 1000"))
def edges_from_one_hop(spark, sf):
    return traverse.edges_from(g.edges(spark, sf), g.METHOD0 + 1)


@_query(g.with_graph(f"SELECT {_EDGE} FROM gedges WHERE dst_symbol_id = {g.WIDE_SEED} AND tier IN ('resolved', 'inferred') ORDER BY id LIMIT 1000"))
def edges_by_tier_filter(spark, sf):
    return traverse.edges_to(g.edges(spark, sf), g.WIDE_SEED, tiers=["resolved", "inferred"])


@_query(g.with_graph(f"SELECT {_EDGE} FROM gedges WHERE dst_symbol_id = {g.DEEP_SEED} AND kind = 'inherits' ORDER BY id LIMIT 1000"))
def edges_by_kind_filter(spark, sf):
    return traverse.edges_to(g.edges(spark, sf), g.DEEP_SEED, kind="inherits")


def _reverse(name: str, seed: int, depth: int, tiers: tuple[str, ...] = (), collapse: tuple[str, ...] = ("kind",)) -> None:
    def run(spark, sf):
        return traverse.reverse_dependencies(_kept_edges(spark, sf), seed, depth, tiers, collapse)

    run.__name__ = name
    _query(g.with_graph(f"SELECT depth, {_EDGE} FROM hits", g.reach_sql(seed, depth, tiers, collapse)))(run)


_reverse("reverse_deps_d1", g.WIDE_SEED, 1)
_reverse("reverse_deps_d2", g.WIDE_SEED, 2)
_reverse("reverse_deps_d4", g.DEEP_SEED, 4)
_reverse("reverse_deps_resolved_only", g.WIDE_SEED, 4, ("resolved",))
_reverse("reverse_deps_cycle", g.FILE0, 4)
_reverse("reverse_deps_tiers_apart", g.WIDE_SEED, 4, (), ("kind", "tier"))

_HIT = "depth, h.tier, s.qualified_name, h.src_symbol_id, h.kind, h.id, f.path AS evidence_path, h.evidence_line, s.kind AS symbol_kind"
_HIT_JOIN = "FROM hits h JOIN gsymbols s ON s.id = h.src_symbol_id LEFT JOIN gfiles f ON f.id = h.evidence_file_id"
_HIT_COLUMNS = ["depth", "tier", "qualified_name", "src_symbol_id", "kind", "id", "evidence_path", "evidence_line", "symbol_kind"]


@_query(g.with_graph(f"SELECT {_HIT} {_HIT_JOIN}", g.reach_sql(g.WIDE_SEED, 4)))
def refs_by_qname(spark, sf):
    return flagship(spark, sf).select(*_HIT_COLUMNS)


@_query(g.with_graph(f"SELECT {_HIT} {_HIT_JOIN}", g.reach_sql(g.FUNCTION0 + 1, 2)))
def refs_by_location(spark, sf):
    """The address is a line inside the span of a customer that no order narrows."""
    where = g.symbols(spark, sf).where(F.col("id") == g.FUNCTION0 + 1).join(g.files(spark, sf).withColumnRenamed("id", "file_id"), "file_id")
    at = where.select(F.concat("path", F.lit(":"), F.col("end_line"))).first()[0]
    return traverse.find_references(g.symbols(spark, sf), g.files(spark, sf), _kept_edges(spark, sf), at, 2).select(*_HIT_COLUMNS)


@_query(g.with_graph(f"SELECT h.tier, count(*) AS n, count(DISTINCT h.src_symbol_id) AS sources {_HIT_JOIN} GROUP BY 1", g.reach_sql(g.WIDE_SEED, 4)))
def refs_grouped_by_tier(spark, sf):
    return traverse.tier_counts(flagship(spark, sf))


_SEEDS = [g.WIDE_SEED, g.DEEP_SEED, g.FILE0]


@_query(
    g.with_graph(
        "SELECT seed_id, node AS symbol_id, min(depth) AS depth FROM walk WHERE node <> seed_id GROUP BY ALL",
        f"walk AS (SELECT CAST(s AS BIGINT) AS seed_id, CAST(s AS BIGINT) AS node, 0 AS depth FROM (SELECT unnest({_SEEDS}) AS s) "
        "UNION SELECT seed_id, src_symbol_id, depth + 1 FROM walk JOIN gedges ON dst_symbol_id = node WHERE depth < 2)",
    )
)
def reach_of_many_seeds(spark, sf):
    seeds = spark.createDataFrame([(s, s) for s in _SEEDS], "seed_id long, symbol_id long")
    return traverse.reach(_kept_edges(spark, sf), seeds, 2).groupBy("seed_id", "symbol_id").agg(F.min("depth").alias("depth"))


@_query(
    g.with_graph(
        "SELECT node AS symbol_id, min(depth) AS depth FROM walk WHERE depth > 0 AND node <> 10000001 GROUP BY ALL",
        f"walk AS (SELECT CAST({g.METHOD0 + 1} AS BIGINT) AS node, 0 AS depth UNION SELECT dst_symbol_id, depth + 1 FROM walk JOIN gedges ON src_symbol_id = node WHERE depth < 3)",
    )
)
def forward_dependencies(spark, sf):
    seeds = spark.createDataFrame([(0, g.METHOD0 + 1)], "seed_id long, symbol_id long")
    return traverse.reach(_kept_edges(spark, sf), seeds, 3, forward=True).groupBy("symbol_id").agg(F.min("depth").alias("depth"))


def _both_ways(seed: int, radius: int) -> str:
    step = "(SELECT CAST({s} AS BIGINT) AS node, 0 AS depth UNION SELECT {far}, depth + 1 FROM {w} JOIN gedges ON {near} = node WHERE depth < {r})"
    back = "back AS " + step.format(s=seed, far="src_symbol_id", near="dst_symbol_id", w="back", r=radius)
    ahead = "ahead AS " + step.format(s=seed, far="dst_symbol_id", near="src_symbol_id", w="ahead", r=radius)
    return f"{back}, {ahead}"


@_query(
    g.with_graph(
        "SELECT node AS symbol_id, depth, direction, row_number() OVER (ORDER BY depth, node) <= 40 AS kept FROM "
        "(SELECT node, min(depth) AS depth, arg_min(direction, depth * 2 + CASE direction WHEN 'out' THEN 1 ELSE 0 END) AS direction FROM "
        f"(SELECT node, depth, 'in' AS direction FROM back UNION ALL SELECT node, depth, 'out' FROM ahead) WHERE node <> {g.DEEP_SEED} GROUP BY node)",
        _both_ways(g.DEEP_SEED, 2),
    )
)
def subgraph_with_budget(spark, sf):
    return traverse.subgraph(_kept_edges(spark, sf), g.DEEP_SEED, 2)


def _cycles_sql(where: str, most: int) -> str:
    return g.with_graph(
        "SELECT symbol_id, length FROM (SELECT DISTINCT start AS symbol_id FROM reach WHERE start = node) "
        "LEFT JOIN (SELECT start AS symbol_id, min(n) AS length FROM walk WHERE node = start GROUP BY 1) USING (symbol_id)",
        f"used AS (SELECT DISTINCT src_symbol_id AS a, dst_symbol_id AS b FROM gedges WHERE {where}), "
        "reach AS (SELECT a AS start, b AS node FROM used UNION SELECT start, b FROM reach JOIN used ON a = node), "
        f"walk AS (SELECT a AS start, b AS node, 1 AS n FROM used UNION SELECT start, b, n + 1 FROM walk JOIN used ON a = node WHERE n < {most} AND node <> start)",
    )


@_query(_cycles_sql("tier = 'heuristic' AND kind IN ('imports', 'inherits', 'defines')", 6))
def cycles_by_tier(spark, sf):
    """Of the edges that a file or part has of its own accord; the calls of orders lie on no cycle."""
    return traverse.cycles(_kept_edges(spark, sf).where(F.col("kind").isin("imports", "inherits", "defines")), 6, ["heuristic"])


@_query(_cycles_sql("kind = 'imports'", 3))
def cycles_longer_than_asked(spark, sf):
    """Symbols on a longer cycle are found too, without a length."""
    return traverse.cycles(_kept_edges(spark, sf).where("kind = 'imports'"), 3)


# -- counts, runs, listing


@_query(g.with_graph(f"SELECT k AS kind, (SELECT count(*) FROM gsymbols WHERE kind = k) AS n FROM (SELECT unnest({list(SYMBOL_KINDS)}) AS k)"))
def symbol_counts_by_kind(spark, sf):
    return report.symbol_counts(g.symbols(spark, sf))


@_query(g.with_graph(f"SELECT t AS tier, (SELECT count(*) FROM gedges WHERE tier = t) AS n FROM (SELECT unnest({list(TIERS)}) AS t)"))
def edge_counts_by_tier(spark, sf):
    return report.edge_counts(g.edges(spark, sf))


def _runs(spark, sf) -> DataFrame:
    e = _t(spark, sf, "events")
    finished = F.when(F.col("event_id") % 7 != 0, F.timestamp_add("SECOND", (F.col("event_id") % 90).cast("int"), F.col("ts")))
    return e.select(F.col("event_id").alias("id"), (F.col("user_id") % 50).alias("repo_id"), F.col("ts").alias("started_at"), finished.alias("finished_at"), F.sha2(F.col("event_id").cast("string"), 256).alias("to_sha"))


_RUNS_SQL = """runs AS (SELECT event_id AS id, user_id % 50 AS repo_id, ts AS started_at,
  CASE WHEN event_id % 7 <> 0 THEN ts + to_seconds(event_id % 90) END AS finished_at, sha256(CAST(event_id AS VARCHAR)) AS to_sha FROM events)"""


@_query(f"WITH {_RUNS_SQL} SELECT repo_id, id, to_sha FROM runs QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY id DESC) = 1")
def latest_run(spark, sf):
    return report.latest_runs(_runs(spark, sf)).select("repo_id", "id", "to_sha")


@_query(f"WITH {_RUNS_SQL} SELECT id, epoch_us(finished_at) / 1e6 - epoch_us(started_at) / 1e6 AS duration_seconds FROM runs QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY id DESC) = 1")
def run_duration(spark, sf):
    return report.latest_runs(_runs(spark, sf)).select("id", "duration_seconds")


@_query(f"WITH {_RUNS_SQL} SELECT id, lag(to_sha) OVER (PARTITION BY repo_id ORDER BY id) AS from_sha FROM runs")
def from_sha_lag(spark, sf):
    return report.run_from_sha(_runs(spark, sf)).select("id", "from_sha")


@_query("SELECT user_id AS run_id, arg_max(event_type, event_id) AS status, arg_max(value, event_id) FILTER (WHERE value > 50) AS files_done FROM events GROUP BY 1")
def run_lifecycle_fold(spark, sf):
    e = _t(spark, sf, "events")
    return store.fold_runs(e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"), F.when(F.col("value") > 50, F.col("value")).alias("files_done")))


@_query("SELECT source AS root_path, CAST(sum(n_chars) AS BIGINT) AS size_bytes, count(*) AS files FROM documents GROUP BY 1")
def repo_size_total(spark, sf):
    return report.sizes(_t(spark, sf, "documents").select(F.col("source").alias("root_path"), F.col("n_chars").alias("length")))


_SIZE = "CASE WHEN s < 1024 THEN printf('%d B', s) WHEN s < 1048576 THEN printf('%.1f KB', s / 1024.0) WHEN s < 1073741824 THEN printf('%.1f MB', s / 1048576.0) ELSE printf('%.1f GB', s / 1073741824.0) END"


@_query(f"SELECT doc_id, {_SIZE} AS size FROM (SELECT doc_id, n_chars * (1 + doc_id % 5 * 20000) AS s FROM documents)")
def repo_size_format(spark, sf):
    size = F.col("n_chars") * (1 + F.col("doc_id") % 5 * 20000)
    return _t(spark, sf, "documents").select("doc_id", text.byte_size(size).alias("size"))


@_query("SELECT DISTINCT source AS root_path, substr(sha256(source), 1, 16) AS repo_hash FROM documents")
def repo_hash(spark, sf):
    return _t(spark, sf, "documents").select(F.col("source").alias("root_path"), text.repo_hash(F.col("source")).alias("repo_hash")).distinct()


@_query(
    "SELECT c.source AS root_path, count(d.doc_id) AS documents, CAST(coalesce(sum(d.n_chars), 0) AS BIGINT) AS size_bytes FROM (SELECT DISTINCT source FROM documents) c "
    "LEFT JOIN (SELECT * FROM documents WHERE lang = 'fr') d ON d.source = c.source GROUP BY 1"
)
def registry_listing(spark, sf):
    d = _t(spark, sf, "documents")
    registry = d.select(F.col("source").alias("root_path"), F.lit(None).cast("timestamp").alias("registered_at")).distinct()
    repos = registry.select("root_path", *[F.lit(None).cast("string").alias(c) for c in ("indexed_sha", "scip_status")], F.lit(None).cast("timestamp").alias("indexed_at"))
    own = d.where("lang = 'fr'").groupBy(F.col("source").alias("root_path")).agg(F.sum("n_chars").alias("size_bytes"), F.count("*").alias("documents"))
    listed = report.listing(registry, repos, own.select("root_path", "size_bytes")).join(own.select("root_path", "documents"), "root_path", "left")
    return listed.select("root_path", F.coalesce("documents", F.lit(0)).alias("documents"), "size_bytes")


# -- resolution


def _star_refs(spark, sf) -> DataFrame:
    """A reference of each order, by number to a customer in scope, a supplier by its bare name, a dotted name or a name that nothing has."""
    s = g.symbols(spark, sf).where("kind = 'method'")
    key = F.col("id") - g.METHOD0
    target = (
        F.when(key % 4 == 0, F.regexp_extract("qualified_name", r"\.(c[0-9]+)\.", 1))
        .when(key % 4 == 1, F.concat(F.lit("s"), (key % 10 + 1)))
        .when(key % 4 == 2, F.regexp_replace("qualified_name", r"\.o[0-9]+$", ""))
        .otherwise(F.concat(F.lit("absent"), key))
    )
    kind = F.when(key % 3 == 0, "calls").when(key % 3 == 1, "references").otherwise("inherits")
    return s.select("file_id", key.cast("int").alias("ref_seq"), kind.alias("kind"), F.col("qualified_name").alias("src_qualified_name"), target.alias("target_text"), F.lit(1).alias("evidence_line"))


_STAR_REFS_SQL = f"""SELECT file_id, CAST(key AS INT) AS ref_seq, CASE key % 3 WHEN 0 THEN 'calls' WHEN 1 THEN 'references' ELSE 'inherits' END AS kind, qualified_name AS src_qualified_name,
  CASE key % 4 WHEN 0 THEN regexp_extract(qualified_name, '\\.(c[0-9]+)\\.', 1) WHEN 1 THEN 's' || (key % 10 + 1) WHEN 2 THEN regexp_replace(qualified_name, '\\.o[0-9]+$', '')
  ELSE 'absent' || key END AS target_text, 1 AS evidence_line FROM (SELECT *, id - {g.METHOD0} AS key FROM gsymbols WHERE kind = 'method')"""


@_query(g.with_graph("SELECT file_id, ref_seq, place, dst FROM targets", f"syms AS (SELECT * FROM gsymbols), refs AS ({_STAR_REFS_SQL}), {fx.RESOLVE_SQL}"))
def resolve_star_graph(spark, sf):
    return resolve.resolved_targets(g.symbols(spark, sf), _star_refs(spark, sf))

def _class_symbols(spark, sf) -> DataFrame:
    """The star graph's symbols with customers as classes, whose methods are their orders."""
    return g.symbols(spark, sf).withColumn("kind", F.when(F.col("kind") == "function", "class").otherwise(F.col("kind")))


def _all_refs(spark, sf) -> DataFrame:
    """References of every kind: those of _star_refs, of each order to the last order of its customer or to a name that its class
    lacks, by self and cls, and of each file to the suppliers of the nation before."""
    key = F.col("id") - g.METHOD0
    orders = g.symbols(spark, sf).where("kind = 'method'").withColumn("owner", F.regexp_replace("qualified_name", r"\.o[0-9]+$", ""))
    last = F.max(key).over(Window.partitionBy("owner"))  # the orders of one customer
    target = F.when(key % 3 == 0, F.concat(F.lit("self.o"), "last")).when(key % 3 == 1, F.concat(F.lit("cls.o"), "last")).otherwise(F.lit("self.absent"))
    own = orders.withColumn("last", last).select("file_id", (key + 500_000_000).cast("int").alias("ref_seq"), F.lit("calls").alias("kind"), F.col("qualified_name").alias("src_qualified_name"), target.alias("target_text"), F.lit(2).alias("evidence_line"))
    files = g.symbols(spark, sf).where("kind = 'file'").select(F.col("id").alias("file_id"), F.col("qualified_name").alias("src_qualified_name"))
    suppliers = g.symbols(spark, sf).where("kind = 'class'").select(
        (F.lit(g.FILE0) + (F.col("file_id") - g.FILE0 + 1) % 25).alias("file_id"), (F.lit(g.CLASS0) - F.col("id")).cast("int").alias("ref_seq"), F.lit("imports").alias("kind"), F.col("qualified_name").alias("target_text"), F.lit(1).alias("evidence_line")
    )
    imports = suppliers.join(F.broadcast(files), "file_id")  # a row for each nation
    return _star_refs(spark, sf).unionByName(own).unionByName(imports)


def _stored_refs(spark, sf) -> DataFrame:
    """_all_refs() as a stored table, as an index has one."""
    return written(_all_refs(spark, sf), "refs", resolve.TABLE_ROWS)


_ALL_REFS_SQL = f"""SELECT * FROM ({_STAR_REFS_SQL})
  UNION ALL SELECT file_id, CAST(key + 500000000 AS INT), 'calls', qualified_name, CASE key % 3 WHEN 0 THEN 'self.o' || last WHEN 1 THEN 'cls.o' || last ELSE 'self.absent' END, 2
  FROM (SELECT *, id - {g.METHOD0} AS key, max(id - {g.METHOD0}) OVER (PARTITION BY regexp_replace(qualified_name, '\\.o[0-9]+$', '')) AS last FROM gsymbols WHERE kind = 'method')
  UNION ALL SELECT f.id, CAST({g.CLASS0} - s.id AS INT), 'imports', f.qualified_name, s.qualified_name, 1 FROM gsymbols s JOIN gsymbols f ON f.kind = 'file' AND f.id = {g.FILE0} + (s.file_id - {g.FILE0} + 1) % 25 WHERE s.kind = 'class'"""
_RESOLUTION_SQL = f"syms AS MATERIALIZED (SELECT id, file_id, CASE kind WHEN 'function' THEN 'class' ELSE kind END AS kind, qualified_name FROM gsymbols), refs AS MATERIALIZED ({_ALL_REFS_SQL}), {fx.RESOLVE_SQL}"


@_query(g.with_graph("SELECT file_id, ref_seq, place, dst FROM targets", _RESOLUTION_SQL))
def resolve_chain(spark, sf):
    return resolve.resolved_targets(_class_symbols(spark, sf), _stored_refs(spark, sf))


def _rule(name: str, low: int, high: int) -> None:
    def query(spark, sf):
        return resolve.resolved_targets(_class_symbols(spark, sf), _stored_refs(spark, sf), (low,)).select("file_id", "ref_seq", "dst")

    query.__name__ = name
    _query(g.with_graph(f"SELECT file_id, ref_seq, arg_min(dst, place) AS dst FROM candidates WHERE place BETWEEN {low} AND {high} GROUP BY ALL", _RESOLUTION_SQL))(query)


_rule("resolve_exact", resolve.EXACT, resolve.EXACT)
_rule("resolve_ancestor", resolve.SCOPE, 99_999)
_rule("resolve_self_cls", resolve.SELF, resolve.SELF)
_rule("resolve_same_file_import", resolve.IMPORT, resolve.IMPORT)
_rule("resolve_unique_bare", resolve.UNIQUE, resolve.UNIQUE)


@_query(
    g.with_graph(
        "SELECT p.file_id, p.ref_seq, s.dst AS src_symbol_id, p.dst AS dst_symbol_id, p.kind FROM picked p JOIN names s ON s.name = p.src_qualified_name WHERE p.dst <> s.dst",
        f"{_RESOLUTION_SQL}, picked AS MATERIALIZED (SELECT r.*, t.dst FROM r JOIN targets t ON t.file_id = r.file_id AND t.ref_seq = r.ref_seq)",
    )
)
def heuristic_edges(spark, sf):
    return resolve.heuristic_edges(_class_symbols(spark, sf), _stored_refs(spark, sf)).select("file_id", "ref_seq", "src_symbol_id", "dst_symbol_id", "kind")


@_query(g.with_graph("SELECT r.file_id, r.ref_seq, max(s.id) AS dst FROM refs r JOIN syms s ON s.qualified_name = r.target_text WHERE r.kind = 'imports' GROUP BY ALL", _RESOLUTION_SQL))
def resolve_imports(spark, sf):
    imports = _all_refs(spark, sf).where("kind = 'imports'")
    return resolve.resolved_targets(_class_symbols(spark, sf), imports).select("file_id", "ref_seq", "dst")


_PARENT_SQL = "CASE WHEN contains(c.qualified_name, '.') THEN regexp_replace(c.qualified_name, '\\.[^.]*$', '') END"


@_query(
    g.with_graph(
        f"SELECT max(p.id) AS src_symbol_id, c.id AS dst_symbol_id, c.start_line AS evidence_line FROM gsymbols c JOIN gsymbols p ON p.file_id = c.file_id AND p.qualified_name = {_PARENT_SQL} "
        "WHERE p.id <> c.id GROUP BY c.id, c.start_line"
    )
)
def defines_edges(spark, sf):
    s = g.symbols(spark, sf)
    name = F.col("qualified_name")
    parents = s.select("id", F.when(name.contains("."), F.regexp_replace(name, r"\.[^.]*$", "")).alias("parent_qualified_name"))
    return resolve.defines_edges(s, parents).select("src_symbol_id", "dst_symbol_id", "evidence_line")


# -- locations

_SPANS_SQL = """spans AS MATERIALIZED (SELECT l_orderkey * 10 + l_linenumber AS sid, l_orderkey AS fid, l_linenumber AS a, l_linenumber + CAST(q AS INT) % 3 AS b
  FROM (SELECT l_orderkey, l_linenumber, min(l_quantity) AS q FROM lineitem GROUP BY ALL)),
probes AS (SELECT o_orderkey AS fid, CAST(unnest(range(1, 11)) AS INT) AS line FROM orders)"""


def _spans(spark, sf) -> DataFrame:
    one = _t(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"))
    end = F.col("l_linenumber") + F.col("q").cast("int") % 3
    return one.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("start_line"), end.alias("end_line"))


@_query(f"WITH {_SPANS_SQL} SELECT p.fid AS file_id, line, arg_min(sid, (b - a) * 1000000000000 + sid) AS symbol_id FROM probes p JOIN spans s ON s.fid = p.fid AND line BETWEEN a AND b GROUP BY ALL")
def symbol_at_location(spark, sf):
    probes = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("file_id"), F.explode(F.sequence(F.lit(1), F.lit(10))).alias("line"))
    return resolve.innermost(probes, _spans(spark, sf), [])


@_query(
    g.with_graph(
        "SELECT p.file_id, p.line, arg_min(s.id, (s.end_line - s.start_line)::HUGEINT * 1000000000000 + s.id) AS symbol_id "
        "FROM (SELECT DISTINCT 1000000 + o_orderkey % 25 AS file_id, o_custkey * 10 + 100000001 + o_orderkey % 12 AS line FROM orders) p JOIN gsymbols s ON s.file_id = p.file_id AND p.line BETWEEN s.start_line AND s.end_line GROUP BY ALL"
    )
)
def symbol_at_location_in_long_files(spark, sf):
    """Spans of one line to two thousand million, the file's own among them."""
    file, line = F.lit(g.FILE0) + F.col("o_orderkey") % 25, F.col("o_custkey") * 10 + 100_000_001 + F.col("o_orderkey") % 12
    return resolve.innermost(_t(spark, sf, "orders").select(file.alias("file_id"), line.alias("line")), g.symbols(spark, sf), [])


_CLEAN_SQL = f"""occ AS (SELECT replace(path, '\\', '/') AS path, line0, symbol, is_definition FROM ({fx.OCCURRENCES_SQL}) WHERE symbol <> '' AND line0 IS NOT NULL),
clean AS (SELECT path, line0, is_definition, min(symbol) AS symbol FROM occ GROUP BY path, line0, is_definition HAVING count(DISTINCT symbol) = 1)"""


@_query(f"WITH {_CLEAN_SQL} SELECT path, line0, is_definition, symbol FROM clean")
def scip_unambiguous_lines(spark, sf):
    return resolve.unambiguous(spark.createDataFrame(fx.OCCURRENCE_ROWS, fx.OCCURRENCE_DDL))


def _star_occurrences(spark, sf) -> DataFrame:
    """A definition on the first line of each span, and a reference from the next order's file; some lines name two symbols."""
    li = _t(spark, sf, "lineitem")
    path = lambda k: F.concat(F.lit("f"), k, F.lit(".py"))
    key = F.col("l_orderkey")
    defs = li.select(path(key).alias("path"), (F.col("l_linenumber") - 1).alias("line0"), F.concat(F.lit("s"), key, F.lit("#"), F.col("l_linenumber")).alias("symbol"), F.lit(True).alias("is_definition"))
    refs = li.select(path(key + 1).alias("path"), (F.col("l_linenumber") - 1).alias("line0"), F.concat(F.lit("s"), key, F.lit("#"), F.when(F.col("l_quantity") > 45, 1).otherwise(F.col("l_linenumber"))).alias("symbol"), F.lit(False).alias("is_definition"))
    return defs.unionByName(refs)


_STAR_OCC_SQL = """occ AS (
  SELECT 'f' || l_orderkey || '.py' AS path, l_linenumber - 1 AS line0, 's' || l_orderkey || '#' || l_linenumber AS symbol, true AS is_definition FROM lineitem
  UNION ALL SELECT 'f' || (l_orderkey + 1) || '.py', l_linenumber - 1, 's' || l_orderkey || '#' || CASE WHEN l_quantity > 45 THEN 1 ELSE l_linenumber END, false FROM lineitem
), clean AS MATERIALIZED (SELECT path, line0, is_definition, min(symbol) AS symbol FROM occ GROUP BY path, line0, is_definition HAVING count(DISTINCT symbol) = 1),
ofiles AS (SELECT DISTINCT o_orderkey AS id, 'f' || o_orderkey || '.py' AS path FROM orders),
defs AS (SELECT f.id AS fid, line0 + 1 AS line, symbol AS scip_symbol FROM clean JOIN ofiles f USING (path) WHERE is_definition),
found AS MATERIALIZED (SELECT arg_min(sid, (b - a) * 1000000000000 + sid) AS symbol_id, scip_symbol, d.fid AS file_id, line FROM defs d JOIN spans s ON s.fid = d.fid AND line BETWEEN a AND b GROUP BY ALL)"""


def _order_files(spark, sf) -> DataFrame:
    return _t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("f"), "o_orderkey", F.lit(".py")).alias("path")).distinct()


@_query(f"WITH {_SPANS_SQL}, {_STAR_OCC_SQL} SELECT symbol_id, scip_symbol, file_id, line FROM found")
def scip_definition_map(spark, sf):
    return resolve.scip_definitions(_star_occurrences(spark, sf), _order_files(spark, sf), _spans(spark, sf))


@_query(
    f"""WITH {_SPANS_SQL}, {_STAR_OCC_SQL}, ours AS MATERIALIZED (SELECT scip_symbol, arg_max(symbol_id, file_id * 1000 + line) AS dst FROM found GROUP BY 1),
lines AS (SELECT f.id AS file_id, line0 + 1 AS evidence_line, symbol AS scip_symbol FROM clean JOIN ofiles f USING (path) WHERE NOT is_definition)
SELECT s.fid AS file_id, s.sid AS src_symbol_id, o.dst AS dst_symbol_id, s.a AS evidence_line FROM spans s JOIN lines l ON l.file_id = s.fid AND l.evidence_line = s.a JOIN ours o USING (scip_symbol) WHERE o.dst <> s.sid"""
)
def scip_resolved_edges(spark, sf):
    name = F.concat(F.lit("x"), F.col("id"))
    spans = _spans(spark, sf).withColumns({"qualified_name": name, "kind": F.lit("function")})
    refs = spans.select("file_id", F.col("start_line").alias("ref_seq"), F.lit("calls").alias("kind"), F.col("qualified_name").alias("src_qualified_name"), F.lit("t").alias("target_text"), F.col("start_line").alias("evidence_line"))
    return resolve.scip_edges(spans, refs, _star_occurrences(spark, sf), _order_files(spark, sf)).select("file_id", "src_symbol_id", "dst_symbol_id", "evidence_line")


@_query(f"WITH {_SPANS_SQL}, {_STAR_OCC_SQL} SELECT s.sid AS id, max(scip_symbol) AS scip_symbol FROM spans s LEFT JOIN found f ON f.symbol_id = s.sid GROUP BY 1")
def scip_backfill(spark, sf):
    spans = _spans(spark, sf).withColumn("scip_symbol", F.lit(None).cast("string"))
    return store.backfill_scip(spans, resolve.scip_definitions(_star_occurrences(spark, sf), _order_files(spark, sf), spans)).select("id", "scip_symbol")


# -- mutations


@_query(
    "SELECT l_orderkey AS src_symbol_id, l_suppkey AS dst_symbol_id, 'calls' AS kind, l_linestatus AS tier, min(l_partkey * 10 + l_linenumber) AS seq FROM lineitem WHERE l_orderkey % 3 <> 0 OR l_linestatus <> 'F' GROUP BY ALL"
)
def edge_dedupe_first_wins(spark, sf):
    """Edges of a third of the orders are there already in one tier."""
    li = _t(spark, sf, "lineitem")
    new = li.select(F.col("l_orderkey").alias("src_symbol_id"), F.col("l_suppkey").alias("dst_symbol_id"), F.lit("calls").alias("kind"), F.col("l_linestatus").alias("tier"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return store.insert_edges(new.where("src_symbol_id % 3 = 0 AND tier = 'F'"), new, ["seq"])


@_query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def upsert_latest_wins(spark, sf):
    return store.one_of_each(_t(spark, sf, "events"), ["user_id"], ["ts", "event_id"], last=True).select("user_id", "event_id")


@_query(
    """WITH old AS (SELECT doc_id + 1 AS id, 'd' || doc_id AS path, n_chars AS n FROM documents WHERE doc_id % 3 <> 0), new AS (SELECT 'd' || doc_id AS path, CASE WHEN doc_id % 4 <> 0 THEN -1 END AS n FROM documents WHERE doc_id % 2 = 0)
SELECT path, coalesce(new.n, CASE WHEN new.path IS NULL THEN old.n END) AS n, coalesce(old.id, (SELECT max(id) FROM old) + row_number() OVER (PARTITION BY old.id IS NULL ORDER BY path)) AS id FROM old FULL OUTER JOIN new USING (path)"""
)
def upsert_keeps_ids(spark, sf):
    d = _t(spark, sf, "documents")
    old = d.where("doc_id % 3 != 0").select((F.col("doc_id") + 1).alias("id"), F.concat(F.lit("d"), "doc_id").alias("path"), F.col("n_chars").alias("n"))
    new = d.where("doc_id % 2 = 0").select(F.concat(F.lit("d"), "doc_id").alias("path"), F.when(F.col("doc_id") % 4 != 0, -1).cast("long").alias("n"))
    return store.upsert(old, new, ["path"])


@_query(
    "SELECT o_orderkey AS id, o_custkey AS file_id, o_totalprice AS v FROM orders WHERE o_custkey % 5 <> 0 UNION ALL SELECT o_orderkey + 1000000000, o_custkey, -1.0 FROM orders WHERE o_custkey % 10 = 0"
)
def replace_symbols(spark, sf):
    o = _t(spark, sf, "orders")
    old = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("file_id"), F.col("o_totalprice").alias("v"))
    new = o.where("o_custkey % 10 = 0").select((F.col("o_orderkey") + 1_000_000_000).alias("id"), F.col("o_custkey").alias("file_id"), F.lit(-1.0).alias("v"))
    return store.replace_of_files(old, new, old.where("file_id % 5 = 0").select(F.col("file_id").alias("id")).distinct())


@_query(
    g.with_graph(
        "SELECT e.id, CASE WHEN e.evidence_file_id IN (SELECT id FROM gone) THEN NULL ELSE e.evidence_file_id END AS evidence_file_id FROM gedges e "
        "WHERE src_symbol_id NOT IN (SELECT id FROM dead) AND dst_symbol_id NOT IN (SELECT id FROM dead)",
        "gone AS (SELECT id FROM gfiles WHERE id % 4 = 0), dead AS (SELECT s.id FROM gsymbols s JOIN gone ON gone.id = s.file_id)",
    )
)
def cascade_delete(spark, sf):
    tables = {"file": g.files(spark, sf), "symbol": g.symbols(spark, sf), "edge": g.edges(spark, sf)}
    return store.delete_files(tables, tables["file"].where("id % 4 = 0"))["edge"].select("id", "evidence_file_id")


@_query("SELECT event_id AS id, row_number() OVER (ORDER BY ts, event_id) AS number FROM events")
def numbered_ids(spark, sf):
    return store.numbered(_t(spark, sf, "events").select(F.col("event_id").alias("id"), "ts"), ["ts", "id"], name="number").select("id", "number")


@_query(
    """WITH a AS (SELECT source || '/' || doc_id AS path, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 1), b AS (SELECT source || '/' || doc_id AS path, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 10 <> 2)
SELECT path, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'deleted' WHEN a.h = b.h THEN 'unchanged' ELSE 'changed' END AS change FROM a FULL OUTER JOIN b USING (path)"""
)
def cdc_added_changed_deleted(spark, sf):
    d = _t(spark, sf, "documents")
    path = F.concat("source", F.lit("/"), "doc_id").alias("path")
    old = d.where("doc_id % 10 != 1").select(path, F.sha2("text", 256).alias("blob_sha"))
    new = d.where("doc_id % 10 != 2").select(path, F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("blob_sha"))
    return file_changes(old, new).select("path", "change")


# -- scalar functions and lists


@_query("SELECT page_id, url FROM pages ORDER BY url, page_id LIMIT 1000")
def list_files_topk(spark, sf):
    return report.first_files(_t(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("path"))).select(F.col("id").alias("page_id"), F.col("path").alias("url"))


@_query(g.with_graph(f"SELECT id, start_line FROM gsymbols WHERE file_id = {g.FILE0 + 3} ORDER BY start_line, id LIMIT 1000"))
def list_symbols_by_file(spark, sf):
    return report.first_symbols(g.symbols(spark, sf), g.FILE0 + 3).select("id", "start_line")


_PATH_SQL = "CASE doc_id % 3 WHEN 0 THEN 'pkg/' || source || '/m' || doc_id || '.py' WHEN 1 THEN source || '/sub/__init__.py' ELSE '__init__.py' END"


def _paths(spark, sf) -> DataFrame:
    path = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("pkg/"), "source", F.lit("/m"), "doc_id", F.lit(".py"))).when(F.col("doc_id") % 3 == 1, F.concat("source", F.lit("/sub/__init__.py"))).otherwise("__init__.py")
    return _t(spark, sf, "documents").select("doc_id", path.alias("path"))


@_query(
    f"""SELECT doc_id, CASE WHEN p LIKE '%.\\_\\_init\\_\\_' ESCAPE '\\' THEN substr(p, 1, length(p) - 9) ELSE p END AS qualified_name, array_to_string(list_slice(string_split(path, '/'), 1, len(string_split(path, '/')) - 1), '.') AS package,
  regexp_extract(path, '(\\.[^./]+)$', 1) AS extension FROM (SELECT doc_id, path, replace(regexp_replace(path, '\\.py$', ''), '/', '.') AS p FROM (SELECT doc_id, {_PATH_SQL} AS path FROM documents))"""
)
def qname_from_path(spark, sf):
    p = F.col("path")
    return _paths(spark, sf).select("doc_id", text.qualified_name_of_path(p).alias("qualified_name"), F.array_join(text.package_of_path(p), ".").alias("package"), text.extension(p).alias("extension"))


@_query("SELECT doc_id, CAST(length(text) - length(replace(text, chr(10), '')) + CASE WHEN length(text) > 0 AND right(text, 1) <> chr(10) THEN 1 ELSE 0 END AS INT) AS n_lines FROM documents")
def n_lines(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", text.line_count(F.col("text")).alias("n_lines"))


@_query("SELECT page_id, sha256(html) AS blob_sha FROM pages")
def content_hash(spark, sf):
    return _t(spark, sf, "pages").select("page_id", text.content_hash(F.col("html")).alias("blob_sha"))


@_query(
    g.with_graph(
        "SELECT id, array_to_string(list_slice(string_split(qualified_name, '.'), 1, len(string_split(qualified_name, '.')) - up), '.') AS scope, CAST(up AS INT) AS up FROM (SELECT *, unnest(range(0, len(string_split(qualified_name, '.')))) AS up FROM gsymbols)"
    )
)
def ancestor_scopes(spark, sf):
    return g.symbols(spark, sf).select("id", F.posexplode(text.ancestor_scopes(F.col("qualified_name"))).alias("up", "scope"))


@_query("SELECT page_id, trim(regexp_replace(url || '  ' || url, '\\s+', ' ', 'g')) AS collapsed, split_part(split_part(url, '://', 2), '.', -1) AS last FROM pages")
def collapse_and_last_segment(spark, sf):
    url = F.col("url")
    return _t(spark, sf, "pages").select("page_id", text.collapsed(F.concat(url, F.lit("  "), url)).alias("collapsed"), text.last_segment(F.substring_index(url, "://", -1)).alias("last"))


_REDACT_SQL = "text"
for _p in text.SECRET_PATTERNS:
    _REDACT_SQL = f"regexp_replace({_REDACT_SQL}, '{_p}', '[REDACTED]', 'g')"


@_query(f"SELECT doc_id, regexp_replace({_REDACT_SQL}, '(?i)\\b(token|secret|password|api_key)(\\s*[=:]\\s*[\"'']?)[A-Za-z0-9+/_-]{{16,}}', '\\1\\2[REDACTED]', 'g') AS text FROM documents")
def redact_secrets(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", text.redact(F.col("text")).alias("text"))


# -- retrieval

_BM25_SQL = """q AS (SELECT item_id AS query_id, text AS query FROM benchmark WHERE item_id % 20 = 0),
terms AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[\\p{L}\\p{N}]+')) AS term FROM q),
sized AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS t FROM documents),
stats AS (SELECT count(*) AS docs, avg(len(t)) AS mean FROM sized),
tf AS (SELECT term, doc_id, n, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM sized) WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
bm AS (SELECT query_id, doc_id, round(sum(ln((docs - df + 0.5) / (df + 0.5) + 1) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean)))), 9) AS score FROM tf JOIN df USING (term) JOIN terms USING (term), stats GROUP BY ALL),
bmr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm QUALIFY rank <= 10)"""


def _bm25(spark, sf) -> DataFrame:
    """The query set is every twentieth benchmark passage."""
    asked = _t(spark, sf, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return retrieve.bm25(_t(spark, sf, "documents"), asked, "doc_id", "text")


@_query(f"WITH {_BM25_SQL} SELECT query_id, doc_id, round(score, 6) AS score FROM bmr")
def bm25_topk(spark, sf):
    return _bm25(spark, sf).select("query_id", "doc_id", F.round("score", 6).alias("score"))


_COSINE_SQL = """pairs AS (SELECT q.vec_id AS query_id, e.vec_id AS vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0),
cosr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs QUALIFY rank <= 10)"""


def _cosine(spark, sf) -> DataFrame:
    e = _t(spark, sf, "embeddings")
    return retrieve.cosine_top_k(e, e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), "vec_id", "embedding")


@_query(f"WITH {_COSINE_SQL} SELECT query_id, vec_id, round(score, 6) AS score FROM cosr")
def cosine_topk(spark, sf):
    return _cosine(spark, sf).select("query_id", "vec_id", F.round("score", 6).alias("score"))


_FUSED = "round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score"


@_query(
    f"WITH {_BM25_SQL}, {_COSINE_SQL}, both_ AS (SELECT query_id, doc_id, rank FROM bmr UNION ALL SELECT query_id, vec_id, rank FROM cosr), "
    f"f AS (SELECT query_id, doc_id, {_FUSED} FROM both_ GROUP BY ALL) SELECT query_id, doc_id, round(score, 9) AS score FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10"
)
def rrf_fusion(spark, sf):
    near = _cosine(spark, sf).select("query_id", F.col("vec_id").alias("doc_id"), "rank")
    return retrieve.rank_fusion([_bm25(spark, sf), near], "doc_id").select("query_id", "doc_id", F.round("score", 9).alias("score"))


@_query(f"WITH {_BM25_SQL} SELECT query_id, doc_id, round({_FUSED.split(' AS ')[0]}, 9) AS score FROM bmr GROUP BY ALL")
def rrf_one_empty(spark, sf):
    ranked = _bm25(spark, sf)
    return retrieve.rank_fusion([ranked, ranked.limit(0)], "doc_id").select("query_id", "doc_id", F.round("score", 9).alias("score"))


@_query("SELECT query_id, doc_id, used FROM (SELECT lang AS query_id, doc_id, CAST(sum(n_chars) OVER (PARTITION BY lang ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM documents) WHERE used <= 50000")
def context_budget(spark, sf):
    d = _t(spark, sf, "documents").select(F.col("lang").alias("query_id"), "doc_id", F.col("doc_id").alias("rank"), "n_chars")
    return retrieve.context_budget(d, 50_000, "n_chars").select("query_id", "doc_id", "used")


@_query(
    g.with_graph(
        "SELECT f.path, o_orderkey AS start_line, o_orderkey + 3 AS end_line, exists(SELECT 1 FROM gsymbols s WHERE s.file_id = f.id AND s.kind <> 'file' AND o_orderkey >= s.start_line AND o_orderkey + 3 <= s.end_line) AS verified "
        "FROM orders JOIN gfiles f ON f.id = 1000000 + o_orderkey % 25"
    )
)
def citation_check(spark, sf):
    files = g.files(spark, sf)
    cited = _t(spark, sf, "orders").select((F.lit(g.FILE0) + F.col("o_orderkey") % 25).alias("id"), F.col("o_orderkey").alias("start_line"), (F.col("o_orderkey") + 3).alias("end_line"))
    return retrieve.check_citations(cited.join(files, "id").drop("id"), g.symbols(spark, sf).where("kind != 'file'"), files).select("path", "start_line", "end_line", "verified")


@_query(
    g.with_graph(
        "SELECT f.path, o_orderkey * 40000 AS start_line, o_orderkey * 40000 + o_custkey AS end_line, exists(SELECT 1 FROM gsymbols s WHERE s.file_id = f.id AND o_orderkey * 40000 >= s.start_line AND o_orderkey * 40000 + o_custkey <= s.end_line) AS verified "
        "FROM orders JOIN gfiles f ON f.id = 1000000 + o_orderkey % 25"
    )
)
def citation_check_in_long_files(spark, sf):
    """Citations that lie in the file's own symbol, and some beyond its last line."""
    files, start = g.files(spark, sf), F.col("o_orderkey") * 40_000
    cited = _t(spark, sf, "orders").select((F.lit(g.FILE0) + F.col("o_orderkey") % 25).alias("id"), start.alias("start_line"), (start + F.col("o_custkey")).alias("end_line"))
    return retrieve.check_citations(cited.join(files, "id").drop("id"), g.symbols(spark, sf), files).select("path", "start_line", "end_line", "verified")


@_query(
    """WITH p AS (SELECT DISTINCT doc_id, lang AS tier FROM documents), t AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1)
SELECT tier, count(t.doc_id) AS hits, count(*) AS predictions, (SELECT count(*) FROM t) AS truths, count(t.doc_id) / count(*) AS precision, count(t.doc_id) / (SELECT count(*) FROM t) AS recall FROM p LEFT JOIN t USING (doc_id) GROUP BY 1"""
)
def retrieval_precision_recall(spark, sf):
    predicted = _t(spark, sf, "documents").select("doc_id", F.col("lang").alias("tier"))
    return report.precision_recall(predicted, _t(spark, sf, "labels").where("quality = 1"), ["doc_id"], "tier")


# -- impact


@_query(
    f"""WITH {_SPANS_SQL}, changed AS (SELECT o_orderkey AS fid, CAST(o_custkey % 5 + 1 AS INT) AS a2, CAST(o_custkey % 5 + 1 + o_orderkey % 3 AS INT) AS b2 FROM orders)
SELECT DISTINCT sid AS symbol_id FROM changed c JOIN spans s ON s.fid = c.fid AND s.a <= c.b2 AND s.b >= c.a2"""
)
def impact_span_seed(spark, sf):
    o = _t(spark, sf, "orders")
    first = F.col("o_custkey") % 5 + 1
    return impact.changed_symbols(o.select(F.col("o_orderkey").alias("file_id"), first.alias("first_line"), (first + F.col("o_orderkey") % 3).alias("last_line")), _spans(spark, sf))


def _impact_sql(seeds: str, depth: int) -> str:
    """Level by level, as a symbol may be reached again by surer edges."""
    parts = [f"f0 AS (SELECT id AS node, true AS sure, [id] AS path FROM ({seeds}))", "v0 AS (SELECT node, sure FROM f0)"]
    for d in range(1, depth + 1):
        parts.append(
            f"h{d} AS (SELECT e.src_symbol_id AS node, f.sure AND e.tier = 'resolved' AS sure, list_append(f.path, e.src_symbol_id) AS path FROM f{d - 1} f JOIN gedges e ON e.dst_symbol_id = f.node), "
            f"b{d} AS (SELECT node, bool_or(sure) AS sure, min(path) AS least, coalesce(min(path) FILTER (WHERE sure), min(path)) AS path FROM h{d} GROUP BY 1), "
            f"f{d} AS (SELECT b.* FROM b{d} b LEFT JOIN (SELECT node, bool_or(sure) AS was FROM v{d - 1} GROUP BY 1) k USING (node) WHERE was IS NULL OR (sure AND NOT was)), "
            f"v{d} AS (SELECT * FROM v{d - 1} UNION ALL SELECT node, sure FROM f{d})"
        )
    all_ = " UNION ALL ".join(f"SELECT node, {d} AS depth, sure, least FROM f{d}" for d in range(1, depth + 1))
    return ", ".join([*parts, f"reached AS (SELECT node AS symbol_id, min(depth) AS depth, bool_or(sure) AS sure, arg_min(least, depth) AS path FROM ({all_}) GROUP BY 1)"])


_TESTED = "CASE WHEN id % 5 = 0 THEN 'tests/' ELSE '' END || path"


@_query(
    g.with_graph(
        f"SELECT symbol_id, depth, CASE WHEN sure THEN 'definite' ELSE 'possible' END AS certainty, {_TESTED} LIKE 'tests/%' AS is_test, array_to_string(r.path, '/') AS path "
        "FROM reached r JOIN gsymbols s ON s.id = symbol_id JOIN (SELECT id AS fid, path AS fpath FROM gfiles) ON fid = file_id".replace("SELECT id AS fid, path AS fpath", f"SELECT id AS fid, {_TESTED} AS fpath"),
        _impact_sql("SELECT id FROM gsymbols WHERE kind = 'class' AND id % 7 = 0", impact.DEFAULT_DEPTH),
    ).replace(f"{_TESTED} LIKE", "fpath LIKE")
)
def impact_groups(spark, sf):
    """Every fifth file holds tests here."""
    seeds = g.symbols(spark, sf).where("kind = 'class' AND id % 7 = 0").select(F.col("id").alias("symbol_id"))
    hits = impact.impact(_kept_edges(spark, sf), seeds, g.symbols(spark, sf), _test_files(spark, sf))
    return hits.withColumn("path", F.array_join("path", "/"))


def _test_files(spark, sf) -> DataFrame:
    return g.files(spark, sf).withColumn("path", F.concat(F.when(F.col("id") % 5 == 0, "tests/").otherwise(""), "path"))


@_query(
    g.with_graph(
        "SELECT src_symbol_id, dst_symbol_id, 'tests' AS kind, 'inferred' AS tier, arg_min(evidence_file_id, e.id) AS evidence_file_id, arg_min(evidence_line, e.id) AS evidence_line FROM gedges e "
        "JOIN gsymbols a ON a.id = src_symbol_id JOIN gsymbols b ON b.id = dst_symbol_id WHERE e.kind IN ('calls', 'references', 'imports', 'inherits') AND a.file_id % 5 = 0 AND b.file_id % 5 <> 0 GROUP BY 1, 2"
    )
)
def test_associations(spark, sf):
    return impact.test_edges(_kept_edges(spark, sf), g.symbols(spark, sf), _test_files(spark, sf))


# -- extraction


@_query(
    fx.values_sql(
        [
            ("pkg", "file", 1, 1, None), ("pkg.shapes", "file", 1, 19, None), ("pkg.shapes.Shape", "class", 4, 11, "pkg.shapes"), ("pkg.shapes.Shape.sides", "variable", 5, 5, "pkg.shapes.Shape"),
            ("pkg.shapes.Shape.__init__", "method", 7, 8, "pkg.shapes.Shape"), ("pkg.shapes.Shape.area", "method", 10, 11, "pkg.shapes.Shape"), ("pkg.shapes.make", "function", 14, 15, "pkg.shapes"),
            ("pkg.shapes._square", "function", 18, 19, "pkg.shapes"), ("pkg.use", "file", 1, 7, None), ("pkg.use.DEFAULT", "variable", 3, 3, "pkg.use"), ("pkg.use.build", "function", 6, 7, "pkg.use"),
            ("run", "file", 1, 9, None), ("run.main", "function", 4, 5, "run"),
        ],
        "qualified_name, kind, start_line, end_line, parent_qualified_name",
    )
)
def parse_simple_fixture(spark, sf):
    files = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in fx.SIMPLE_FILES.items()], "path string, content binary")
    return python_source.parse_files(files).select(F.inline("symbols")).select("qualified_name", "kind", "start_line", "end_line", "parent_qualified_name")
