"""Small literal inputs for rules that the star-schema tables cannot show, as rows and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SYMBOL_ROWS = [
    (1, 1, "file", "pkg"), (2, 1, "class", "pkg.Base"), (3, 1, "method", "pkg.Base.run"), (4, 1, "method", "pkg.Base.stop"), (5, 1, "function", "pkg.helper"),
    (6, 2, "file", "app"), (7, 2, "class", "app.Main"), (8, 2, "method", "app.Main.run"), (9, 2, "function", "app.Main.run.inner"), (10, 2, "variable", "app.limit"),
    (11, 2, "function", "app.twice"), (12, 2, "function", "app.twice"), (13, 3, "file", "lib"), (14, 3, "function", "lib.only"), (15, 3, "variable", "lib.helper"),
    (16, 3, "class", "lib.Base"), (17, 3, "variable", "lib.Solo"), (18, 3, "class", "lib.deep.Solo"),
]
#: file_id, ref_seq, kind, src_qualified_name, target_text, evidence_line
REF_ROWS = [
    (2, 0, "imports", "app", "pkg.helper", 1), (2, 1, "imports", "app", "lib.helper", 2), (2, 2, "imports", "app", "nowhere.x", 3), (2, 3, "calls", "app.Main.run", "self.run", 9),
    (2, 4, "calls", "app.Main.run", "self.absent", 10), (2, 5, "calls", "app.Main.run.inner", "cls.run", 11), (2, 6, "calls", "app.Main.run", "self.a.b", 12),
    (2, 7, "calls", "app.Main.run", "inner", 13), (2, 8, "calls", "app.Main.run", "helper", 14), (2, 9, "calls", "app.Main.run", "only", 15),
    (2, 10, "calls", "app.Main.run", "limit", 16), (2, 11, "references", "app.Main.run", "limit", 17), (2, 12, "calls", "app.Main.run", "twice", 18),
    (2, 13, "inherits", "app.Main", "Base", 6), (2, 14, "inherits", "app.Main", "pkg.Base", 6), (2, 15, "calls", "app.Main.run", "pkg.Base.stop", 19),
    (2, 16, "calls", "app.Main.run", "mod.only", 20), (2, 17, "inherits", "app.Main", "Solo", 6), (2, 18, "references", "app.Main.run", "Solo", 21),
    (3, 0, "calls", "lib.only", "helper", 4), (3, 1, "calls", "lib.only", "stop", 5), (3, 2, "calls", "lib.missing", "only", 6), (3, 3, "calls", "lib.only", "only", 7),
    (3, 4, "references", "lib.only", "helper", 8), (3, 5, "imports", "lib", "pkg", 1), (3, 6, "defines", "lib", "pkg.helper", 1),
]

SYMBOL_DDL = "id long, file_id long, kind string, qualified_name string"
REF_DDL = "file_id long, ref_seq int, kind string, src_qualified_name string, target_text string, evidence_line int"


def symbols(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SYMBOL_ROWS, SYMBOL_DDL)


def refs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REF_ROWS, REF_DDL)


def values_sql(rows: list[tuple], names: str) -> str:
    literal = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    said = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {said}) AS v({names})"


SYMBOLS_SQL = f"SELECT CAST(id AS BIGINT) AS id, CAST(file_id AS BIGINT) AS file_id, kind, qualified_name FROM ({values_sql(SYMBOL_ROWS, 'id, file_id, kind, qualified_name')})"
_REF_VALUES = values_sql(REF_ROWS, "file_id, ref_seq, kind, src_qualified_name, target_text, evidence_line")
REFS_SQL = f"SELECT CAST(file_id AS BIGINT) AS file_id, ref_seq, kind, src_qualified_name, target_text, evidence_line FROM ({_REF_VALUES})"

_OK = "CASE WHEN r.kind = 'calls' THEN n.dst_kind IN ('function', 'method', 'class') WHEN r.kind = 'inherits' THEN n.dst_kind = 'class' ELSE true END"
#: Common tables from syms and refs to targets (file_id, ref_seq, place, dst).
RESOLVE_SQL = f"""
names AS MATERIALIZED (SELECT qualified_name AS name, arg_max(id, id) AS dst, arg_max(kind, id) AS dst_kind FROM syms GROUP BY 1),
r AS MATERIALIZED (SELECT * FROM refs WHERE kind IN ('calls', 'inherits', 'references', 'imports')),
scopes AS MATERIALIZED (
  SELECT file_id, ref_seq, kind, target_text, up, array_to_string(list_slice(parts, 1, len(parts) - up), '.') AS scope
  FROM (SELECT *, string_split(src_qualified_name, '.') AS parts, unnest(range(0, len(string_split(src_qualified_name, '.')))) AS up FROM r)
), owners AS MATERIALIZED (
  SELECT file_id, ref_seq, target_text, arg_min(scope, up) AS owner FROM scopes JOIN names n ON n.name = scope AND n.dst_kind = 'class'
  WHERE kind = 'calls' AND regexp_full_match(target_text, '(self|cls)\\.[^.]+') GROUP BY ALL
), firsts AS MATERIALIZED (
  SELECT file_id, split_part(target_text, '.', -1) AS bare, arg_min(n.dst, ref_seq) AS dst, arg_min(n.dst_kind, ref_seq) AS dst_kind
  FROM r JOIN names n ON n.name = target_text WHERE r.kind = 'imports' GROUP BY ALL
), bares AS MATERIALIZED (
  SELECT split_part(qualified_name, '.', -1) AS bare, kind AS dst_kind, count(*) AS c, min(id) AS dst FROM syms GROUP BY ALL
), candidates AS MATERIALIZED (
  SELECT o.file_id, o.ref_seq, 0 AS place, n.dst FROM owners o JOIN names n ON n.name = owner || '.' || split_part(target_text, '.', -1)
  UNION ALL SELECT r.file_id, r.ref_seq, 1, n.dst FROM r JOIN names n ON n.name = r.target_text WHERE {_OK}
  UNION ALL SELECT r.file_id, r.ref_seq, CAST(2 + r.up AS INT), n.dst FROM scopes r JOIN names n ON n.name = r.scope || '.' || r.target_text
    WHERE NOT contains(r.target_text, '.') AND r.kind <> 'imports' AND {_OK}
  UNION ALL SELECT r.file_id, r.ref_seq, 100000, n.dst FROM r JOIN firsts n ON n.file_id = r.file_id AND n.bare = r.target_text WHERE r.kind <> 'imports' AND {_OK}
  UNION ALL SELECT r.file_id, r.ref_seq, 200000, min(n.dst) FROM r JOIN bares n ON n.bare = r.target_text
    WHERE NOT contains(r.target_text, '.') AND r.kind <> 'imports' AND {_OK} GROUP BY r.file_id, r.ref_seq HAVING sum(c) = 1
), targets AS MATERIALIZED (SELECT file_id, ref_seq, min(place) AS place, arg_min(dst, place) AS dst FROM candidates GROUP BY ALL)
"""

#: path, line0, symbol, is_definition
OCCURRENCE_ROWS = [
    ("pkg/a.py", 4, "s A#", True), ("pkg/a.py", 4, "s A#", True), ("pkg/a.py", 9, "s f().", True), ("pkg/a.py", 9, "s f().(x)", True), ("pkg/b.py", 2, "s A#", False),
    ("pkg/b.py", 3, "s A#", False), ("pkg/b.py", 3, "s f().", False), ("pkg\\b.py", 7, "s g().", False), ("pkg/b.py", 8, "", False), ("else.py", 1, "s h().", True),
]
OCCURRENCE_DDL = "path string, line0 int, symbol string, is_definition boolean"
OCCURRENCES_SQL = values_sql(OCCURRENCE_ROWS, "path, line0, symbol, is_definition")

SIMPLE_FILES = {
    "pkg/__init__.py": '"""A package."""\n',
    "pkg/shapes.py": (
        '"""Shapes."""\n\n\nclass Shape:\n    sides = 0\n\n    def __init__(self, name: str) -> None:\n        self.name = name\n\n'
        "    def area(self) -> float:\n        return _square(self.sides)\n\n\ndef make(name: str) -> Shape:\n    return Shape(name)\n\n\ndef _square(x):\n    return x * x\n"
    ),
    "pkg/use.py": "from pkg.shapes import Shape, make\n\nDEFAULT = 'box'\n\n\ndef build() -> Shape:\n    return make(DEFAULT)\n",
    "run.py": "from pkg.use import build\n\n\ndef main():\n    build()\n\n\nif __name__ == '__main__':\n    main()\n",
}
