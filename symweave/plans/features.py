"""Queries of retrieval, graphs and reports beyond the plain ones, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import impact, report, retrieve, traverse
from ..operators.textindex import TextIndex
from ..shared import scratch
from ..streaming import incremental
from . import fixtures as fx
from . import star_graph as g
from .registry import _BM25_SQL, _both_ways, _kept_edges, _query, _star_refs, _STAR_REFS_SQL, _t

# -- graphs

_SUPPLIERS_SQL = """walk AS (
  SELECT id AS seed, id AS node, 0 AS depth FROM gsymbols WHERE kind IN ('class', 'variable')
  UNION SELECT w.seed, e.src_symbol_id, w.depth + 1 FROM walk w JOIN (SELECT DISTINCT src_symbol_id, dst_symbol_id FROM gedges) e ON e.dst_symbol_id = w.node WHERE w.depth < 3)"""


@_query(g.with_graph("SELECT seed AS seed_id, node AS symbol_id, min(depth) AS depth FROM walk GROUP BY ALL HAVING min(depth) > 0", _SUPPLIERS_SQL))
def reverse_deps_of_all(spark, sf):
    """What depends on each supplier and each part within three hops, all of them as seeds at once."""
    seeds = g.symbols(spark, sf).where("kind IN ('class', 'variable')").select(F.col("id").alias("seed_id"), F.col("id").alias("symbol_id"))
    return traverse.reach_sets(_kept_edges(spark, sf), seeds, 3)


_NODES = f"nodes AS (SELECT node AS symbol_id, min(depth) AS depth, row_number() OVER (ORDER BY min(depth), node) <= 40 AS kept FROM (SELECT * FROM back UNION ALL SELECT * FROM ahead) WHERE node <> {g.DEEP_SEED} GROUP BY node)"


@_query(g.with_graph("SELECT s.file_id, min(depth) AS depth, count(*) AS n FROM nodes JOIN gsymbols s ON s.id = symbol_id WHERE NOT kept GROUP BY 1", f"{_both_ways(g.DEEP_SEED, 2)}, {_NODES}"))
def subgraph_overflow(spark, sf):
    return traverse.overflow(traverse.subgraph(_kept_edges(spark, sf), g.DEEP_SEED, 2), g.symbols(spark, sf))


_LABELS = f"label AS (SELECT s.id, CASE WHEN coalesce(kept, true) THEN 's' || s.id ELSE 'f' || s.file_id END AS l FROM gsymbols s LEFT JOIN nodes ON symbol_id = s.id WHERE symbol_id IS NOT NULL OR s.id = {g.DEEP_SEED})"


@_query(
    g.with_graph(
        "SELECT a.l AS a, b.l AS b, kind, count(*) AS n FROM gedges JOIN label a ON a.id = src_symbol_id JOIN label b ON b.id = dst_symbol_id WHERE a.l <> b.l OR a.l LIKE 's%' GROUP BY ALL",
        f"{_both_ways(g.DEEP_SEED, 2)}, {_NODES}, {_LABELS}",
    )
)
def subgraph_clustered_edges(spark, sf):
    edges = _kept_edges(spark, sf)
    return traverse.subgraph_edges(edges, traverse.subgraph(edges, g.DEEP_SEED, 2), g.symbols(spark, sf), g.DEEP_SEED)


@_query(
    g.with_graph(
        "SELECT 'graph LR' || chr(10) || string_agg(DISTINCT '  s' || a.id || '[\"' || a.qualified_name || '\"] -->|' || e.kind || '| s' || b.id || '[\"' || b.qualified_name || '\"]', chr(10) "
        "ORDER BY '  s' || a.id || '[\"' || a.qualified_name || '\"] -->|' || e.kind || '| s' || b.id || '[\"' || b.qualified_name || '\"]') AS text "
        "FROM gedges e JOIN gsymbols a ON a.id = src_symbol_id JOIN gsymbols b ON b.id = dst_symbol_id WHERE e.kind = 'imports'"
    )
)
def mermaid_of_imports(spark, sf):
    return traverse.mermaid(_kept_edges(spark, sf).where("kind = 'imports'"), g.symbols(spark, sf))


_PICTURE_SQL = "picture AS (SELECT a.l AS a, b.l AS b, kind, count(*) AS n FROM gedges JOIN label a ON a.id = src_symbol_id JOIN label b ON b.id = dst_symbol_id WHERE a.l <> b.l OR a.l LIKE 's%' GROUP BY ALL)"


@_query(
    g.with_graph(
        "SELECT to_json({'nodes': (SELECT list(DISTINCT x ORDER BY x) FROM (SELECT a AS x FROM picture UNION SELECT b FROM picture)), 'edges': (SELECT list({'a': a, 'b': b, 'kind': kind, 'n': n} ORDER BY a, b, kind) FROM picture)})::VARCHAR AS text",
        f"{_both_ways(g.DEEP_SEED, 2)}, {_NODES}, {_LABELS}, {_PICTURE_SQL}",
    )
)
def graph_as_json(spark, sf):
    edges = _kept_edges(spark, sf)
    return traverse.graph_json(traverse.subgraph_edges(edges, traverse.subgraph(edges, g.DEEP_SEED, 2), g.symbols(spark, sf), g.DEEP_SEED))


@_query(
    g.with_graph(
        "SELECT start AS symbol_id, max(node) AS component FROM reach r WHERE EXISTS (SELECT 1 FROM reach b WHERE b.start = r.node AND b.node = r.start) AND EXISTS (SELECT 1 FROM reach c WHERE c.start = r.start AND c.node = r.start) GROUP BY 1",
        "used AS (SELECT DISTINCT src_symbol_id AS a, dst_symbol_id AS b FROM gedges WHERE kind = 'imports'), reach AS (SELECT a AS start, b AS node FROM used UNION SELECT start, b FROM reach JOIN used ON a = node)",
    )
)
def strongly_connected_files(spark, sf):
    return traverse.strongly_connected(_kept_edges(spark, sf).where("kind = 'imports'"))


def _next_parts(spark, sf):
    """Edges from the part of an order's line to that of its next one, from the fifth line on: nearly all parts are one component."""
    li = _t(spark, sf, "lineitem")
    after = li.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("next"))
    tier = F.when(F.col("l_linestatus") == "F", "resolved").otherwise("heuristic")
    rows = li.where("l_linenumber >= 5").join(after, ["l_orderkey", "l_linenumber"]).where("l_partkey != next")
    return rows.select((F.lit(g.VARIABLE0) + F.col("l_partkey")).cast("long").alias("src_symbol_id"), (F.lit(g.VARIABLE0) + F.col("next")).cast("long").alias("dst_symbol_id"), F.lit("references").alias("kind"), tier.alias("tier"))


def _component_sql(where: str) -> str:
    return f"""used AS (SELECT DISTINCT {g.VARIABLE0} + x.l_partkey AS a, {g.VARIABLE0} + y.l_partkey AS b
  FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND y.l_linenumber = x.l_linenumber + 1 WHERE x.l_linenumber >= 5 AND x.l_partkey <> y.l_partkey{where}),
reach AS (SELECT a, b FROM used UNION SELECT r.a, u.b FROM reach r JOIN used u ON r.b = u.a),
members AS (SELECT r.a AS symbol_id, max(r.b) AS component FROM reach r JOIN reach t ON r.a = t.b AND r.b = t.a GROUP BY 1)"""


@_query(f"WITH RECURSIVE {_component_sql(" AND x.l_linestatus = 'F'")} SELECT symbol_id, component FROM members")
def strongly_connected_parts(spark, sf):
    """Parts that lead round to themselves by finished lines: one large component and small ones."""
    return traverse.strongly_connected(_next_parts(spark, sf), ["resolved"])


@_query(
    f"""WITH RECURSIVE {_component_sql(" AND x.l_linestatus = 'F'")},
inside AS (SELECT a, b, m.component FROM used JOIN members m ON a = m.symbol_id JOIN members o ON b = o.symbol_id WHERE m.component = o.component),
walk AS (SELECT component, a AS start, b AS here, [a, b] AS path FROM inside WHERE b >= a
  UNION ALL SELECT w.component, w.start, i.b, list_append(w.path, i.b) FROM walk w JOIN inside i ON i.a = w.here WHERE w.here > w.start AND i.b >= w.start AND len(w.path) < 5),
best AS (SELECT component, len(path) - 1 AS length, array_to_string(path, '>') AS path FROM walk WHERE start = here QUALIFY row_number() OVER (PARTITION BY component ORDER BY len(path), path) = 1)
SELECT component, count(*) AS symbols, CAST(any_value(length) AS INT) AS length, any_value(best.path) AS path FROM members LEFT JOIN best USING (component) GROUP BY 1"""
)
def shortest_cycle_of_components(spark, sf):
    found = traverse.cycle_paths(_next_parts(spark, sf), 4, ["resolved"])
    return found.withColumn("path", F.concat_ws(">", F.col("path"))).withColumn("path", F.when(F.col("length").isNotNull(), F.col("path")))


# -- retrieval

_INDEXES: dict[tuple[str, str], TextIndex] = {}


def stored_text_index(spark, sf) -> TextIndex:
    """An index of all documents, written once for a session and folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _INDEXES:
        index = TextIndex(spark, scratch(spark, "text-index"))
        index.update(_t(spark, sf, "documents"), "doc_id", "text")
        _INDEXES[key] = index
    return _INDEXES[key]


@_query(f"WITH {_BM25_SQL} SELECT query_id, doc_id, round(score, 6) AS score FROM bmr")
def bm25_from_index(spark, sf):
    """bm25_topk answered by the stored index."""
    asked = _t(spark, sf, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return stored_text_index(spark, sf).search(asked).select("query_id", F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))



@_query(
    g.with_graph(
        "SELECT query_id, node AS symbol_id, min(hop) AS hop, CAST(arg_min(rank, hop * 1000 + rank) AS INT) AS rank FROM walk GROUP BY 1, 2",
        "seeds AS (SELECT CAST(id % 3 AS BIGINT) AS query_id, id, CAST(row_number() OVER (PARTITION BY id % 3 ORDER BY id) AS INT) AS rank FROM gsymbols WHERE kind = 'file'), "
        "both_ AS (SELECT src_symbol_id AS a, dst_symbol_id AS b FROM gedges WHERE kind IN ('imports', 'defines') UNION SELECT dst_symbol_id, src_symbol_id FROM gedges WHERE kind IN ('imports', 'defines')), "
        "walk AS (SELECT query_id, id AS node, 0 AS hop, rank FROM seeds UNION SELECT query_id, b, hop + 1, rank FROM walk JOIN both_ ON a = node WHERE hop < 2)",
    )
)
def expansion_by_two_hops(spark, sf):
    """From every file, ranked within three queries, along imports and definitions both ways."""
    files = g.symbols(spark, sf).where("kind = 'file'").select((F.col("id") % 3).alias("query_id"), F.col("id").alias("symbol_id"))
    at = files.select(F.col("query_id"), F.col("symbol_id").alias("other"))
    ranked = files.join(at, "query_id").where("other <= symbol_id").groupBy("query_id", "symbol_id").agg(F.count("*").cast("int").alias("rank"))
    return retrieve.expand(ranked, _kept_edges(spark, sf).where(F.col("kind").isin("imports", "defines")))


_PASSAGES = [
    ("a:1", 1, "the parser reads a file and returns its tree", 9), ("a:9", 2, "a tree of symbols is written to the store", 9), ("b:1", 3, "the store keeps edges between symbols", 7),
    ("c:1", None, "notes on weather and rain", 5), ("d:1", 4, "unrelated helper", 2), ("e:1", 5, "far away", 2),
]


@_query(fx.values_sql([(0, "a:1", 0, 1), (0, "a:9", 0, 2), (0, "d:1", 1, 3), (0, "e:1", 2, 4)], "query_id, chunk_id, hop, rank"))
def hybrid_context(spark, sf):
    """The best two by words, then by hops along 1-4 and 4-5; b:1 is three hops away."""
    chunks = spark.createDataFrame(_PASSAGES, "chunk_id string, symbol_id long, text string, n_tokens int")
    edges = spark.createDataFrame([(1, 4, 1, "calls", "resolved"), (2, 4, 5, "calls", "resolved"), (3, 5, 3, "calls", "resolved")], "id long, src_symbol_id long, dst_symbol_id long, kind string, tier string")
    asked = spark.createDataFrame([(0, "parser tree file")], "query_id int, query string")
    return retrieve.hybrid(chunks, asked, edges, k=2).select("query_id", "chunk_id", "hop", "rank")


_SETS_SQL = """t AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS t FROM documents),
sets AS (SELECT id, list_sort(list_distinct(list_transform(range(1, greatest(1, len(t) - 4) + 1), lambda i: array_to_string(list_slice(t, i, i + 4), ' ')))) AS s FROM t WHERE len(t) > 0),
reps AS (SELECT s, min(id) AS r FROM sets GROUP BY 1)"""


@_query(
    f"WITH {_SETS_SQL}, each AS (SELECT r, len(s) AS n, unnest(s) AS x FROM reps), pairs AS (SELECT a.r AS a, b.r AS b, count(*) AS c, any_value(a.n + b.n) AS n FROM each a JOIN each b USING (x) WHERE a.r < b.r GROUP BY 1, 2) "
    "SELECT a, b, round(c / (n - c), 9) AS similarity FROM pairs WHERE c / (n - c) >= 0.8"
)
def duplicate_texts(spark, sf):
    """Documents as chunks: pairs of different texts at a Jaccard similarity of 0.8."""
    pairs, _ = retrieve.duplicate_chunks(_t(spark, sf, "documents"), "doc_id", "text")
    return pairs.select("a", "b", F.round("similarity", 9).alias("similarity"))


@_query(f"WITH {_SETS_SQL} SELECT id AS doc_id, r AS representative FROM sets JOIN reps USING (s)")
def copies_of_texts(spark, sf):
    return retrieve.duplicate_chunks(_t(spark, sf, "documents"), "doc_id", "text")[1]


@_query(
    g.with_graph(
        f"SELECT s.id FROM gsymbols s JOIN gfiles f ON f.id = s.file_id WHERE s.kind = 'class' AND (f.path = 'r1' OR f.path LIKE 'r1/%')"
    )
)
def search_filters(spark, sf):
    """By kind and path prefix; r1 is whole segments, so r10 would not count."""
    files = g.files(spark, sf).withColumn("lang", F.lit("python"))
    return retrieve.search_filter(g.symbols(spark, sf), files, language="python", path_prefix="r1", kind="class").select("id")


# -- impact and incremental


@_query(
    """WITH s AS (SELECT 'u' || user_id || '/' || event_type AS path, event_id AS seq, event_id % 7 = 0 AS gone, (event_id * 7919) % 4 AS batch FROM events)
SELECT path, max(seq) AS seq, arg_max(gone, seq) AS gone FROM s GROUP BY path"""
)
def stream_of_snapshots(spark, sf):
    """Events as snapshots of files that arrive in four batches out of order, some saying that the file is gone; the state after all."""
    e = _t(spark, sf, "events")
    content = F.when(F.col("event_id") % 7 != 0, F.encode(F.col("event_id").cast("string"), "utf-8"))
    rows = e.select(F.concat(F.lit("u"), "user_id", F.lit("/"), "event_type").alias("path"), F.col("event_id").alias("seq"), content.alias("content"), ((F.col("event_id") * 7919) % 4).alias("batch"))
    state = rows.limit(0).select("path", "seq", F.lit(True).alias("gone"))
    for batch in (0, 1, 2, 3):
        new = incremental.newest(state, rows.where(F.col("batch") == batch)).select("path", "seq", F.col("content").isNull().alias("gone"))
        state = state.join(new.select("path"), "path", "left_anti").unionByName(new)
    return state


@_query(
    """WITH c AS (SELECT CAST(user_id % 100 AS BIGINT) AS case_id, 'd' || user_id % 7 || '/f' || user_id || '.py' AS path FROM (SELECT DISTINCT user_id FROM events)),
guess AS (SELECT DISTINCT a.case_id, b.path FROM c a JOIN (SELECT DISTINCT path FROM c) b ON regexp_replace(a.path, '[^/]*$', '') = regexp_replace(b.path, '[^/]*$', '') AND a.path <> b.path),
truth AS (SELECT DISTINCT case_id, path FROM c)
SELECT (SELECT count(*) FROM guess JOIN truth USING (case_id, path)) AS hits, (SELECT count(*) FROM guess) AS predictions, (SELECT count(*) FROM truth) AS truths,
  (SELECT count(*) FROM guess JOIN truth USING (case_id, path)) / (SELECT count(*) FROM guess) AS precision, (SELECT count(*) FROM guess JOIN truth USING (case_id, path)) / (SELECT count(*) FROM truth) AS recall"""
)
def same_directory_baseline(spark, sf):
    """Users stand for changed files, a hundred changes of some; what the plain guess by folder finds of them."""
    users = _t(spark, sf, "events").select("user_id").distinct()
    path = F.concat(F.lit("d"), F.col("user_id") % 7, F.lit("/f"), "user_id", F.lit(".py"))
    changed = users.select((F.col("user_id") % 100).alias("case_id"), path.alias("path"))
    return impact.same_directory_score(changed, changed.select("path"))


_NAMES_SQL = "SELECT qualified_name FROM gsymbols WHERE kind = 'class' AND id % 50 = 1 UNION ALL SELECT qualified_name FROM gsymbols WHERE kind = 'function' AND id % 100 = 7"


@_query(
    g.with_graph(
        "SELECT DISTINCT src_qualified_name FROM refs r WHERE split_part(target_text, '.', -1) IN (SELECT split_part(qualified_name, '.', -1) FROM names) "
        "OR EXISTS (SELECT 1 FROM names n WHERE src_qualified_name = n.qualified_name OR starts_with(src_qualified_name, n.qualified_name || '.'))",
        f"refs AS ({_STAR_REFS_SQL}), names AS ({_NAMES_SQL})",
    )
)
def sources_a_change_concerns(spark, sf):
    s = g.symbols(spark, sf)
    names = s.where("kind = 'class' AND id % 50 = 1 OR kind = 'function' AND id % 100 = 7").select("qualified_name")
    return incremental.affected_sources(_star_refs(spark, sf), names)


_TOUCHED = "CASE WHEN id % 9 = 1 THEN 'changed' WHEN id % 9 = 2 THEN 'added' ELSE 'unchanged' END"


@_query(
    g.with_graph(
        "SELECT DISTINCT file_id FROM (SELECT id AS file_id FROM gfiles WHERE id % 9 = 1 UNION SELECT b.file_id FROM gedges JOIN gsymbols a ON a.id = src_symbol_id JOIN gsymbols b ON b.id = dst_symbol_id WHERE kind = 'imports' AND a.file_id % 9 = 1 "
        "UNION SELECT a.file_id FROM gedges JOIN gsymbols a ON a.id = src_symbol_id JOIN gsymbols b ON b.id = dst_symbol_id WHERE kind = 'imports' AND b.file_id % 9 = 1)".replace("WHERE kind", "WHERE gedges.kind")
    )
)
def files_a_change_concerns(spark, sf):
    files = g.files(spark, sf)
    changes = files.select("path", F.expr(_TOUCHED).alias("change"))
    return incremental.affected_files(changes, files, g.symbols(spark, sf), _kept_edges(spark, sf).where("kind = 'imports'"))


# -- reports and texts


@_query(
    """SELECT role AS step, CAST(sum(length(text)) AS BIGINT) AS tokens_in, CAST(sum(turn) AS BIGINT) AS tokens_out,
CASE WHEN count(*) FILTER (WHERE conv_id % 3 = 2 AND role = 'assistant') = 0 THEN round(sum(CASE conv_id % 3 WHEN 0 THEN length(text) * 3.0::DOUBLE + turn * 15 ELSE length(text) * 0.5::DOUBLE + turn * 2 END) / 1e6, 9) END AS cost FROM conversations GROUP BY 1"""
)
def token_costs(spark, sf):
    """Models by conversation; the third has a price for all but the assistant."""
    c = _t(spark, sf, "conversations")
    model = F.when(F.col("conv_id") % 3 == 0, "large").when((F.col("conv_id") % 3 == 2) & (F.col("role") == "assistant"), "unknown").otherwise("small")
    usage = c.select(model.alias("model"), F.col("role").alias("step"), F.length("text").cast("long").alias("tokens_in"), F.col("turn").cast("long").alias("tokens_out"))
    prices = spark.createDataFrame([("large", 3.0, 15.0), ("small", 0.5, 2.0)], "model string, price_in double, price_out double")
    return report.token_costs(usage, prices, ["step"]).withColumn("cost", F.round("cost", 9))


@_query(f"SELECT doc_id, 'key ' || CASE WHEN doc_id % 2 = 0 THEN '[REDACTED]' ELSE repeat('ab1', 8) END || ' end ' || doc_id AS text FROM documents")
def redact_by_entropy(spark, sf):
    """Every other document has a random key, the others a repeated one that says little."""
    key = F.upper(F.base64(F.unhex(F.sha2(F.col("doc_id").cast("string"), 256))))
    random = F.when(F.col("doc_id") % 2 == 0, F.concat(F.left(key, F.lit(40)), F.lit("x1"))).otherwise(F.repeat(F.lit("ab1"), 8))
    texts = _t(spark, sf, "documents").select("doc_id", F.concat(F.lit("key "), random, F.lit(" end "), "doc_id").alias("text"))
    return texts.select("doc_id", text.redact_keys(F.col("text"), bits=3.5).alias("text"))


@_query(
    "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'conf/.env' WHEN doc_id % 3 = 1 THEN 'prod.env' ELSE 'env.py' END AS path, CASE WHEN doc_id % 3 < 2 THEN '# for ' || doc_id || chr(10) || 'export A_B=[REDACTED]' || chr(10) || 'PORT =[REDACTED]' "
    "ELSE '# for ' || doc_id || chr(10) || 'export A_B=x' || doc_id || chr(10) || 'PORT = 80' END AS text FROM documents"
)
def redact_settings_files(spark, sf):
    path = F.when(F.col("doc_id") % 3 == 0, "conf/.env").when(F.col("doc_id") % 3 == 1, "prod.env").otherwise("env.py")
    body = F.concat(F.lit("# for "), "doc_id", F.lit("\nexport A_B=x"), "doc_id", F.lit("\nPORT = 80"))
    return _t(spark, sf, "documents").select("doc_id", path.alias("path"), text.redact_file(path, body).alias("text"))


@_query("SELECT page_id, path = 'en' OR starts_with(path, 'en/') AS below FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+/(.*)$', 1) AS path FROM pages)")
def path_prefix(spark, sf):
    path = F.regexp_extract("url", "^[a-z]+://[^/]+/(.*)$", 1)
    return _t(spark, sf, "pages").select("page_id", text.has_path_prefix(path, "en/").alias("below"))


@_query(g.with_graph(f"SELECT depth, id FROM hits", g.reach_sql(g.DEEP_SEED, traverse.MAX_DEPTH)))
def depth_is_clamped(spark, sf):
    """A depth of 99 is one of four."""
    symbols = g.symbols(spark, sf)
    name = symbols.where(F.col("id") == g.DEEP_SEED).first()["qualified_name"]
    return traverse.find_references(symbols, g.files(spark, sf), _kept_edges(spark, sf), name, 99).select("depth", "id")


@_query("SELECT doc_id, round(-sum(n / t * log2(n / t)), 9) AS bits FROM (SELECT doc_id, c, count(*) AS n, any_value(len) AS t FROM (SELECT doc_id, unnest(string_split(left(source || lang || doc_id, 40), '')) AS c, length(left(source || lang || doc_id, 40)) AS len FROM documents) GROUP BY 1, 2) GROUP BY 1")
def entropy_of_texts(spark, sf):
    said = F.left(F.concat("source", "lang", "doc_id"), F.lit(40))
    return _t(spark, sf, "documents").where(F.col("source").isNotNull() & F.col("lang").isNotNull()).select("doc_id", F.round(text.entropy(said), 9).alias("bits"))
