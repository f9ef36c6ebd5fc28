"""Queries over literal sources: what is read from files, what an index says of them, with literal SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..operators import report, store
from ..shared import scratch
from ..sources import chunks as chunk_source
from ..sources import discover, python_source, scip
from . import fixtures as fx
from . import star_graph as g
from .registry import _query, _t

RICH = '''\
"What the module is for."
from __future__ import annotations
import os.path as p, sys
from a.b import C as D, e
from . import near
from .sub import deep
from .. import up
from a import *


@register
@hooks.on("x")
class Base(D, p.Path, Generic[T], metaclass=Meta):
    """A base."""

    size: Size = 1

    @property
    def width(self, unit: "Unit" = None) -> p.Width:
        """Its width."""
        return self.measure(unit) + near.scale(2)

    def measure(self, unit: Unit, *rest: e.Rest):
        def inner(x):
            return deep(x)
        return [inner(u) for u in units()]


@cache
def make(n: int, *, flag=default()) -> Base:
    if n:
        from late import tool
        return tool.run(n)
    return (lambda: hidden())


TOP = make(1)
'''
FILES = {"pkg/rich.py": RICH, "pkg/empty.py": "", "pkg/one.py": "X = 1"}


def _files(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    return spark.createDataFrame([(p, bytearray(t.encode())) for p, t in texts.items()], "path string, content binary")


def _symbols(spark: SparkSession) -> DataFrame:
    return python_source.parse_files(_files(spark, FILES)).select("path", F.inline("symbols"))


def _refs(spark: SparkSession, kind: str) -> DataFrame:
    found = python_source.parse_files(_files(spark, FILES)).select(F.inline("references"))
    return found.where(F.col("kind") == kind).select("src_qualified_name", "target_text", "evidence_line")


@_query(fx.values_sql([("pkg.rich", "What the module is for."), ("pkg.rich.Base", "A base."), ("pkg.rich.Base.width", "Its width.")], "qualified_name, docstring"))
def extract_docstrings(spark, sf):
    return _symbols(spark).where("docstring IS NOT NULL").select("qualified_name", "docstring")


@_query(
    fx.values_sql(
        [
            ("pkg.rich.Base.width", 'width(self, unit: "Unit" = None) -> p.Width'), ("pkg.rich.Base.measure", "measure(self, unit: Unit, *rest: e.Rest)"),
            ("pkg.rich.make", "make(n: int, *, flag=default()) -> Base"), ("pkg.rich.Base.measure.inner", "inner(x)"),
        ],
        "qualified_name, signature",
    )
)
def extract_signatures(spark, sf):
    return _symbols(spark).where("signature IS NOT NULL").select("qualified_name", "signature")


@_query(fx.values_sql([("pkg.rich.Base", 11, 26), ("pkg.rich.Base.width", 18, 21), ("pkg.rich.make", 29, 34)], "qualified_name, start_line, end_line"))
def extract_decorated_spans(spark, sf):
    """The span of a decorated symbol begins at its decorators."""
    return _symbols(spark).where(F.col("name").isin("Base", "width", "make")).select("qualified_name", "start_line", "end_line")


@_query(
    fx.values_sql(
        [
            ("pkg/rich.py", "pkg.rich", "file", None), ("pkg/rich.py", "pkg.rich.Base", "class", "pkg.rich"), ("pkg/rich.py", "pkg.rich.Base.size", "variable", "pkg.rich.Base"),
            ("pkg/rich.py", "pkg.rich.Base.width", "method", "pkg.rich.Base"), ("pkg/rich.py", "pkg.rich.Base.measure", "method", "pkg.rich.Base"),
            ("pkg/rich.py", "pkg.rich.Base.measure.inner", "function", "pkg.rich.Base.measure"), ("pkg/rich.py", "pkg.rich.make", "function", "pkg.rich"),
            ("pkg/rich.py", "pkg.rich.TOP", "variable", "pkg.rich"), ("pkg/empty.py", "pkg.empty", "file", None), ("pkg/one.py", "pkg.one", "file", None), ("pkg/one.py", "pkg.one.X", "variable", "pkg.one"),
        ],
        "path, qualified_name, kind, parent_qualified_name",
    )
)
def extract_symbols(spark, sf):
    return _symbols(spark).select("path", "qualified_name", "kind", "parent_qualified_name")


@_query(
    fx.values_sql(
        [
            ("pkg.rich", "os.path", 3), ("pkg.rich", "sys", 3), ("pkg.rich", "a.b.C", 4), ("pkg.rich", "a.b.e", 4), ("pkg.rich", "pkg.near", 5), ("pkg.rich", "pkg.sub.deep", 6),
            ("pkg.rich", "a", 8), ("pkg.rich.make", "late.tool", 32),
        ],
        "src_qualified_name, target_text, evidence_line",
    )
)
def extract_imports(spark, sf):
    """Relative ones against the package; `from .. import` beyond the root is none."""
    return _refs(spark, "imports")


@_query(
    fx.values_sql(
        [
            ("pkg.rich.Base.width", "self.measure", 21), ("pkg.rich.Base.width", "near.scale", 21), ("pkg.rich.Base.measure.inner", "deep", 25), ("pkg.rich.Base.measure", "inner", 26),
            ("pkg.rich.Base.measure", "units", 26), ("pkg.rich.make", "tool.run", 33), ("pkg.rich", "make", 37),
        ],
        "src_qualified_name, target_text, evidence_line",
    )
)
def extract_calls(spark, sf):
    """Nothing is read inside lambdas; defaults and decorators are no calls."""
    return _refs(spark, "calls")


@_query(fx.values_sql([("pkg.rich.Base", "D", 13), ("pkg.rich.Base", "p.Path", 13), ("pkg.rich.Base", "Generic", 13)], "src_qualified_name, target_text, evidence_line"))
def extract_inherits(spark, sf):
    return _refs(spark, "inherits")


_REFERENCES = [
    ("pkg.rich.Base", "register", 11), ("pkg.rich.Base", "hooks.on", 11), ("pkg.rich.Base.size", "Size", 16), ("pkg.rich.Base.width", "property", 18), ("pkg.rich.Base.width", "p.Width", 18),
    ("pkg.rich.Base.measure", "Unit", 23), ("pkg.rich.Base.measure", "e.Rest", 23), ("pkg.rich.make", "cache", 29), ("pkg.rich.make", "int", 29), ("pkg.rich.make", "Base", 29),
]


@_query(fx.values_sql(_REFERENCES, "src_qualified_name, target_text, evidence_line"))
def extract_decorators_and_annotations(spark, sf):
    """Of a symbol's first line, where its decorators begin; an annotated variable is its own source."""
    return _refs(spark, "references")


_ODD = [("a.py", "python", b"x = 1\n"), ("bad.py", "python", b"\xff\xfe"), ("same.py", "python", b"y = 2\n"), ("read.me", None, b"text"), ("old.py", "python", b"z = 4\n")]
_KNOWN_SQL = "SELECT 'same.py' AS path, sha256('y = 2' || chr(10)) AS blob_sha UNION ALL SELECT 'old.py', sha256('z = 3' || chr(10))"


@_query(fx.values_sql([("a.py", "parsed", 1), ("bad.py", "skipped", None), ("same.py", "unchanged", None), ("read.me", "skipped", None), ("old.py", "parsed", 1)], "path, outcome, n_lines"))
def strict_utf8_and_unchanged(spark, sf):
    files = spark.createDataFrame([(p, lang, bytearray(c)) for p, lang, c in _ODD], "path string, lang string, content binary")
    known = spark.createDataFrame([("same.py", "y = 2\n"), ("old.py", "z = 3\n")], "path string, t string").select("path", F.sha2("t", 256).alias("blob_sha"))
    return python_source.parse_changed(files, known).select("path", "outcome", "n_lines")


@_query(fx.values_sql([(None, 1, 27), ("pkg.big", 28, 47)], "qualified_name, start_line, end_line"))
def chunks_along_symbols(spark, sf):
    """Small symbols stay with what is around them; a larger one is a chunk of its own."""
    small = "".join(f"def f{i}(x):\n    return x + {i}\n\n" for i in range(9))
    big = "def big(x):\n" + "".join(f"    x = step(x, {i}, x + {i})\n" for i in range(18)) + "    return x\n"
    return chunk_source.chunks(_files(spark, {"pkg.py": small + big})).select("qualified_name", "start_line", "end_line")


# -- SCIP


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _field(number: int, value: int | bytes | str) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _scip_occurrence(symbol: str, roles: int, span: list[int] | None, line: int | None = None) -> bytes:
    old = _field(scip.OCCURRENCE_RANGE, b"".join(map(_varint, span))) if span else b""
    typed = _field(scip.OCCURRENCE_SINGLE_LINE, _field(scip.RANGE_LINE, line)) if line is not None else b""
    return _field(scip.DOCUMENT_OCCURRENCES, old + _field(scip.OCCURRENCE_SYMBOL, symbol) + _field(scip.OCCURRENCE_ROLES, roles) + typed)


#: symbol, roles, range of three or four numbers, line of a typed range
_SCIP_ROWS = [("s A", 1, [4, 0, 3], None), ("s B", 8, [5, 0, 300, 1], None), ("s C", 9, [1, 2], None), ("", 1, [1, 0, 1], None), ("s D", 0, [9, 9, 9], 700), ("s E", 3, None, 0), ("s A", 0, [6, 1, 2], None)]


@_query(fx.values_sql([("pkg/a.py", 4, "s A", True), ("pkg/a.py", 5, "s B", False), ("pkg/a.py", 700, "s D", False), ("pkg/a.py", 0, "s E", True), ("pkg/a.py", 6, "s A", False)], "path, line0, symbol, is_definition"))
def scip_decoding(spark, sf):
    """From the bytes of an index: old and typed ranges, roles as bits, what has no symbol or line left out."""
    data = _field(scip.INDEX_DOCUMENTS, _field(scip.DOCUMENT_PATH, "pkg\\a.py") + b"".join(_scip_occurrence(*r) for r in _SCIP_ROWS))
    path = scratch(spark, "scip")
    spark.createDataFrame([(bytearray(data),)], "content binary").write.format("parquet").save(path)
    held = spark.read.parquet(path).select("content")
    return held.mapInArrow(scip.decoded_batches, scip.DECODED)


# -- discovery


@_query(
    """WITH p AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'src/' WHEN 1 THEN 'node_modules/x/' WHEN 2 THEN '.cache/' WHEN 3 THEN 'a/build/b/' ELSE 'buildings/' END || 'm' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.PY' ELSE '.txt' END AS path FROM documents)
SELECT doc_id, path, doc_id % 5 IN (1, 2, 3) AS skipped, CASE WHEN doc_id % 3 < 2 THEN 'python' END AS lang FROM p"""
)
def discovery_rules(spark, sf):
    folder = F.element_at(F.array(*map(F.lit, ("src/", "node_modules/x/", ".cache/", "a/build/b/", "buildings/"))), (F.col("doc_id") % 5 + 1).cast("int"))
    ending = F.element_at(F.array(*map(F.lit, (".py", ".PY", ".txt"))), (F.col("doc_id") % 3 + 1).cast("int"))
    paths = _t(spark, sf, "documents").select("doc_id", F.concat(folder, F.lit("m"), "doc_id", ending).alias("path"))
    return discover.with_language(paths.withColumn("skipped", discover.in_skipped_dir(F.col("path"))))


@_query("SELECT count(*) FILTER (WHERE doc_id % 4 <> 1) AS indexed, count(*) FILTER (WHERE doc_id % 4 = 1) AS skipped FROM documents")
def files_indexed_and_skipped(spark, sf):
    d = _t(spark, sf, "documents")
    return report.indexed_totals(d.where("doc_id % 4 != 1"), d)


@_query(g.with_graph(f"SELECT id, evidence_file_id FROM gedges WHERE evidence_file_id <> {g.FILE0 + 4}"))
def delete_edges_of_a_file(spark, sf):
    return store.delete_edges_of_file(g.stored_edges(spark, sf), g.FILE0 + 4).select("id", "evidence_file_id")


@_query(g.with_graph("SELECT 'symbol' AS t, id FROM gsymbols WHERE id % 3 <> 1 UNION ALL SELECT 'edge', id FROM gedges WHERE src_symbol_id % 3 <> 1 UNION ALL SELECT 'repo', i FROM (VALUES (0), (2)) v(i)"))
def delete_a_repository(spark, sf):
    tables = {
        "symbol": g.symbols(spark, sf).withColumn("repo_id", F.col("id") % 3), "edge": g.stored_edges(spark, sf).withColumn("repo_id", F.col("src_symbol_id") % 3),
        "repo": spark.range(3),
    }
    left = store.delete_repo(tables, 1)
    return left["symbol"].select(F.lit("symbol").alias("t"), "id").unionByName(left["edge"].select(F.lit("edge").alias("t"), "id")).unionByName(left["repo"].select(F.lit("repo").alias("t"), "id"))


# -- the engine on literal files

_CHANGED = {"pkg/use.py": "from pkg.shapes import Shape\n\n\ndef build() -> Shape:\n    return Shape('y')\n", "pkg/extra.py": "def make(x):\n    return x\n"}
_INDEXED: dict[str, tuple[Engine, object, object]] = {}


def _indexed(spark: SparkSession) -> tuple[Engine, object, object]:
    """An engine with the simple files in one root, and in another those files indexed and then changed; once for a session."""
    key = spark.sparkContext.applicationId
    if key not in _INDEXED:
        engine = Engine(spark, scratch(spark, "engine"))
        first = engine.index("/simple", files=_files(spark, fx.SIMPLE_FILES))
        engine.index("/changed", files=_files(spark, fx.SIMPLE_FILES))
        again = engine.index("/changed", files=_files(spark, fx.SIMPLE_FILES | _CHANGED))
        _INDEXED[key] = engine, first, again
    return _INDEXED[key]


def _edges_by_name(engine: Engine, root: str) -> DataFrame:
    name = lambda end: engine.symbols(root).select(F.col("id").alias(f"{end}_symbol_id"), F.col("qualified_name").alias(end))
    return engine.edges(root).join(name("src"), "src_symbol_id").join(name("dst"), "dst_symbol_id").select("src", "kind", "dst", "tier", "evidence_line")


_SIMPLE_EDGES = [
    ("pkg.shapes.Shape.area", "calls", "pkg.shapes._square", 11), ("pkg.shapes.make", "calls", "pkg.shapes.Shape", 15), ("pkg.shapes.make", "references", "pkg.shapes.Shape", 14),
    ("pkg.use", "imports", "pkg.shapes.Shape", 1), ("pkg.use", "imports", "pkg.shapes.make", 1), ("pkg.use.build", "calls", "pkg.shapes.make", 7), ("pkg.use.build", "references", "pkg.shapes.Shape", 6),
    ("run", "imports", "pkg.use.build", 1), ("run", "calls", "run.main", 9), ("run.main", "calls", "pkg.use.build", 5),
    ("pkg.shapes", "defines", "pkg.shapes.Shape", 4), ("pkg.shapes.Shape", "defines", "pkg.shapes.Shape.sides", 5), ("pkg.shapes.Shape", "defines", "pkg.shapes.Shape.__init__", 7),
    ("pkg.shapes.Shape", "defines", "pkg.shapes.Shape.area", 10), ("pkg.shapes", "defines", "pkg.shapes.make", 14), ("pkg.shapes", "defines", "pkg.shapes._square", 18),
    ("pkg.use", "defines", "pkg.use.DEFAULT", 3), ("pkg.use", "defines", "pkg.use.build", 6), ("run", "defines", "run.main", 4),
]
_GONE = {("pkg.use", "imports", "pkg.shapes.make"), ("pkg.use.build", "calls", "pkg.shapes.make"), ("pkg.use.build", "references", "pkg.shapes.Shape"), ("pkg.use", "defines", "pkg.use.DEFAULT"), ("pkg.use", "defines", "pkg.use.build")}
_CHANGED_EDGES = [e for e in _SIMPLE_EDGES if e[:3] not in _GONE] + [
    ("pkg.use.build", "calls", "pkg.shapes.Shape", 5), ("pkg.use.build", "references", "pkg.shapes.Shape", 4), ("pkg.use", "defines", "pkg.use.build", 4), ("pkg.extra", "defines", "pkg.extra.make", 1),
]


def _edges_sql(rows: list[tuple]) -> str:
    return fx.values_sql([(s, k, d, "heuristic", n) for s, k, d, n in rows], "src, kind, dst, tier, evidence_line")


@_query(_edges_sql(_SIMPLE_EDGES))
def index_of_simple_files(spark, sf):
    return _edges_by_name(_indexed(spark)[0], "/simple")


@_query(_edges_sql(_CHANGED_EDGES))
def index_again_after_a_change(spark, sf):
    """Two files are parsed, three are as they were, and edges are those of a new index."""
    return _edges_by_name(_indexed(spark)[0], "/changed")


@_query(fx.values_sql([("/simple", 4, 0, 0), ("/changed", 5, 0, 3)], "root_path, files_indexed, files_skipped, files_unchanged"))
def index_results(spark, sf):
    _, first, again = _indexed(spark)
    rows = [(r, x.files_indexed, x.files_skipped, x.files_unchanged) for r, x in (("/simple", first), ("/changed", again))]
    return spark.createDataFrame(rows, "root_path string, files_indexed int, files_skipped int, files_unchanged int")


@_query(fx.values_sql([("/changed", "ok", 5, None, "skipped"), ("/simple", "ok", 4, None, "skipped")], "root_path, status, files_done, indexed_sha, scip_status"))
def index_runs_and_repositories(spark, sf):
    engine = _indexed(spark)[0]
    runs = report.latest_runs(engine.store.table("index_run")).select(F.col("repo_id").alias("id"), "status", "files_done")
    return engine.store.table("repo").join(runs, "id").select("root_path", "status", "files_done", "indexed_sha", "scip_status")


@_query(fx.values_sql([("pkg.shapes.make", "function", 14), ("pkg.shapes.Shape.area", "method", 10)], "qualified_name, kind, start_line"))
def lookups_by_name_and_id(spark, sf):
    engine = _indexed(spark)[0]
    by_name = engine.find_symbol("/simple", "pkg.shapes.make")
    other = engine.find_symbol("/simple", "pkg.shapes.Shape.area").first()["id"]
    by_id = engine.symbols("/simple").where(F.col("id") == other)
    return by_name.unionByName(by_id).select("qualified_name", "kind", "start_line")


@_query(fx.values_sql([(p,) for p in sorted(fx.SIMPLE_FILES)], "path"))
def files_of_a_repository(spark, sf):
    return _indexed(spark)[0].list_files("/simple").select("path")


@_query(fx.values_sql([(1, "run", "imports"), (1, "run.main", "calls"), (1, "pkg.use", "defines")], "depth, qualified_name, kind"))
def references_in_an_index(spark, sf):
    """`run` is reached at once by its import, so its call of main does not list it again."""
    hits = _indexed(spark)[0].refs("/simple", "pkg/use.py:7", 9)
    return hits.select("depth", "qualified_name", "kind")


@_query(fx.values_sql([("pkg.shapes.Shape", "class"), ("pkg.shapes.Shape.sides", "variable"), ("pkg.shapes.Shape.__init__", "method"), ("pkg.shapes.Shape.area", "method")], "qualified_name, kind"))
def search_below_a_path(spark, sf):
    """Of language, path prefix and kind the path narrows; `shape` stands in four qualified names below it."""
    found = _indexed(spark)[0].search("/simple", "Shape", language="python", path_prefix="pkg/shapes.py")
    return found.where("qualified_name LIKE 'pkg.shapes.Shape%'").select("qualified_name", "kind")
