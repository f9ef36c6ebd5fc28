"""Table schemas, enumerated domains and the schema version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

SCHEMA_VERSION = 3

# The domains, in the order in which counts are listed.
SYMBOL_KINDS = ("file", "module", "class", "function", "method", "variable")
EDGE_KINDS = ("calls", "imports", "inherits", "references", "defines", "tests")
TIERS = ("resolved", "heuristic", "inferred")
SCIP_STATUSES = ("ok", "degraded", "skipped")
RUN_STATUSES = ("running", "ok", "failed", "interrupted")


def _schema(text: str) -> StructType:
    """`name type` pairs, with `?` after the type of a nullable column."""
    types = {"long": LongType(), "int": IntegerType(), "string": StringType(), "double": DoubleType(), "timestamp": TimestampType(), "boolean": BooleanType()}
    fields = []
    for part in text.split(","):
        name, kind = part.split()
        fields.append(StructField(name, types[kind.rstrip("?")], kind.endswith("?")))
    return StructType(fields)


REPO = _schema("id long, root_path string, remote_url string?, indexed_sha string?, indexed_at timestamp?, scip_status string?")
FILE = _schema("id long, repo_id long, path string, lang string, blob_sha string, n_lines int?")
SYMBOL = _schema(
    "id long, repo_id long, file_id long, kind string, name string, qualified_name string, scip_symbol string?, "
    "start_line int, end_line int, signature string?, docstring string?"
)
EDGE = _schema(
    "id long, repo_id long, src_symbol_id long, dst_symbol_id long, kind string, tier string, confidence double, evidence_file_id long?, evidence_line int?"
)
CHUNK = _schema("id long, repo_id long, file_id long, symbol_id long?, start_line int, end_line int, text string, n_tokens int")
INDEX_RUN = _schema(
    "id long, repo_id long, started_at timestamp, finished_at timestamp?, from_sha string?, to_sha string?, status string, "
    "files_done int, files_total int?, scip_status string?, error string?"
)
#: Raw references as they were read, so that files that did not change need not be read again.
REFERENCE = _schema("repo_id long, file_id long, ref_seq int, kind string, src_qualified_name string, target_text string, evidence_line int")
#: Of a stream of file snapshots: the last one of each path, and whether it said that the file is gone.
SNAPSHOT = _schema("repo_id long, path string, seq long, gone boolean")
OCCURRENCE = _schema("path string, line0 int, symbol string, is_definition boolean")
REGISTRY = _schema("repo_hash string, root_path string, registered_at timestamp")

TABLES = {"repo": REPO, "file": FILE, "symbol": SYMBOL, "edge": EDGE, "chunk": CHUNK, "index_run": INDEX_RUN, "reference": REFERENCE, "snapshot": SNAPSHOT}


def empty(spark: SparkSession, schema: StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def domain(spark: SparkSession, values: tuple[str, ...], column: str) -> DataFrame:
    """(column, place) of a domain, for zero-filled counts in listing order."""
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"{column} string, place int")
