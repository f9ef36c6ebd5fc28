"""Symbols and raw references of Python source files, as one table function over (path, content).

The syntax tree is the standard library's. A file that does not parse is read again without
the statements that break it, at the top level and inside defs and classes whose head is sound, with
all other lines in place; at the least it has its file symbol. Statements inside control flow give no symbols, but calls and imports there count
for the enclosing scope; nothing is read inside lambdas.
"""

from __future__ import annotations

import ast
import hashlib
import io
import re
import tokenize
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..shipping import ship
from .discover import read_bytes

_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_SCOPES = (*_FUNCTIONS, ast.ClassDef, ast.Lambda)
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+")
_STRING = re.compile(r"(?is)\A([a-z]*)('''|\"\"\"|'|\")(.*)\2\Z")


@dataclass
class Parsed:
    path: str
    n_lines: int
    symbols: list[dict] = field(default_factory=list)
    references: list[dict] = field(default_factory=list)


def module_name(path: str) -> str:
    parts = path.removesuffix(".py").split("/")
    return ".".join(parts[:-1] if len(parts) > 1 and parts[-1] == "__init__" else parts)


def count_lines(text: str) -> int:
    return text.count("\n") + bool(text and not text.endswith("\n"))


def source_lines(text: str) -> list[str]:
    """Lines with their ends, as the grammar counts them: no other separators."""
    return _LINE.findall(text)


def _tree(text: str) -> ast.Module | None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


#: Lines that the head of a block may have, with its decorators.
_HEAD_LINES = 40


def _statements(lines: list[str], a: int, b: int, indent: str) -> list[tuple[int, int]]:
    """Stretches of lines that each begin a statement at the indentation, decorators with what follows them."""
    n = len(indent)
    starts = [i for i in range(a, b) if lines[i].startswith(indent) and lines[i][n : n + 1].strip() and lines[i][n] not in "#)]}" and not lines[i][n:].startswith(("else", "elif", "except", "finally"))]
    starts = [x for k, x in enumerate(starts) if k == 0 or not lines[starts[k - 1]][n:].startswith("@")]
    return list(zip(starts, [*starts[1:], b][: len(starts)], strict=True))


def _keep(lines: list[str], a: int, b: int, heads: list[str], indent: str, kept: list[str]) -> bool:
    """Copy to kept what parses of a statement below the heads; of a broken def or class, its head and what parses of its body."""
    if _tree("".join([*heads, *lines[a:b]])) is not None:
        kept[a:b] = lines[a:b]
        return True
    first = next((i for i in range(a, b) if not lines[i][len(indent) :].startswith("@")), b)
    if first == b or not re.match(r"(?:async\s+)?def\b|class\b", lines[first][len(indent) :]):
        return False
    end = next((h for h in range(first + 1, min(b, first + _HEAD_LINES)) if _tree("".join([*heads, *lines[a:h], f"{indent}  pass\n"])) is not None), None)
    inner = next((lines[i][: len(lines[i]) - len(lines[i].lstrip())] for i in range(end or b, b) if lines[i].strip() and not lines[i].lstrip().startswith("#")), "")
    if end is None or not inner.startswith(indent) or len(inner) <= len(indent):
        return False
    kept[a:end] = lines[a:end]
    some = [_keep(lines, x, y, [*heads, *lines[a:end]], inner, kept) for x, y in _statements(lines, end, b, inner)]
    if not any(some):
        kept[end] = f"{inner}pass\n"
    return True


def _recovered(text: str) -> tuple[ast.Module | None, str]:
    """The tree of the text without what is broken, which becomes blank lines.

    Broken statements go one by one at the top level and, where a def or class has a sound head, inside it.
    """
    lines = source_lines(text)
    kept = ["\n"] * len(lines)
    try:
        for a, b in _statements(lines, 0, len(lines), ""):
            _keep(lines, a, b, [], "", kept)
    except RecursionError:
        return None, text
    text = "".join(kept)
    return _tree(text), text


class _Reader:
    def __init__(self, path: str, text: str, shown: str) -> None:
        self.out = Parsed(path, count_lines(text))
        self.package = path.removesuffix(".py").split("/")[:-1]
        self.lines = source_lines(shown)
        self.encoded = [x.encode() for x in self.lines]
        self.shown = shown
        self.parameters = self._parameter_lists()

    # -- text of nodes

    def text(self, node: ast.AST) -> str:
        a, b = node.lineno - 1, node.end_lineno - 1
        if a == b:
            return self.encoded[a][node.col_offset : node.end_col_offset].decode()
        return b"".join([self.encoded[a][node.col_offset :], *self.encoded[a + 1 : b], self.encoded[b][: node.end_col_offset]]).decode()

    def _parameter_lists(self) -> dict[tuple[int, int], str]:
        """The parenthesised parameters of each def, by line of `def` and number of the def on it."""
        found: dict[tuple[int, int], str] = {}
        try:
            tokens = list(tokenize.generate_tokens(io.StringIO(self.shown).readline))
        except (tokenize.TokenError, SyntaxError, IndentationError):
            return found
        for i, t in enumerate(tokens):
            if t.type != tokenize.NAME or t.string != "def":
                continue
            depth, begin, square = 0, None, 0
            for u in tokens[i + 1 :]:
                if u.type != tokenize.OP:
                    continue
                square += (u.string == "[") - (u.string == "]") if begin is None else 0
                if u.string in "([{" and (begin is not None or u.string == "(" and not square):
                    begin = begin or u.start
                    depth += 1
                elif u.string in ")]}" and begin is not None:
                    depth -= 1
                    if not depth:
                        found[t.start] = self._between(begin, u.end)
                        break
        return found

    def _between(self, begin: tuple[int, int], end: tuple[int, int]) -> str:
        if begin[0] == end[0]:
            return self.lines[begin[0] - 1][begin[1] : end[1]]
        return "".join([self.lines[begin[0] - 1][begin[1] :], *self.lines[begin[0] : end[0] - 1], self.lines[end[0] - 1][: end[1]]])

    def docstring(self, body: list[ast.stmt]) -> str | None:
        if not body or not isinstance(body[0], ast.Expr):
            return None
        value = body[0].value
        if not (isinstance(value, ast.Constant) and isinstance(value.value, str | bytes)):
            return None
        found = _STRING.match(self.text(value))
        # adjacent strings are one value but not one string
        if not found or found[2] in re.sub(r"(?s)\\.", "", found[3]):
            return None
        return found[3] or None

    def signature(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> str | None:
        begin = self.lines[node.lineno - 1].find("def", len(self.encoded[node.lineno - 1][: node.col_offset].decode()))
        listed = self.parameters.get((node.lineno, begin))
        if listed is None:
            return None
        said = node.name + " ".join(listed.split())
        return f"{said} -> {self.text(node.returns)}" if node.returns is not None else said

    # -- output

    def symbol(self, kind: str, name: str, qualified: str, start: int, end: int, parent: str | None, signature: str | None = None, docstring: str | None = None) -> None:
        self.out.symbols.append({
            "symbol_seq": len(self.out.symbols), "kind": kind, "name": name, "qualified_name": qualified, "start_line": start, "end_line": end,
            "signature": signature, "docstring": docstring, "parent_qualified_name": parent,
        })

    def reference(self, kind: str, source: str, target: str, line: int) -> None:
        self.out.references.append({"ref_seq": len(self.out.references), "kind": kind, "src_qualified_name": source, "target_text": target, "evidence_line": line})

    def named(self, kind: str, source: str, node: ast.expr | None, line: int | None = None) -> None:
        if isinstance(node, ast.Name | ast.Attribute):
            self.reference(kind, source, self.text(node), line or node.lineno)

    # -- the walk: the definitions of a block first, then its calls and imports

    def block(self, body: list[ast.stmt], scope: str, *, in_class: bool, variables: bool) -> None:
        for node in body:
            if isinstance(node, _FUNCTIONS):
                self.function(node, scope, "method" if in_class else "function")
            elif isinstance(node, ast.ClassDef):
                self.class_(node, scope)
            elif variables and isinstance(node, ast.Assign | ast.AnnAssign):
                self.variable(node, scope)
        for node in body:
            self.scan(node, scope)

    def _decorated(self, node, qualified: str, start: int) -> None:
        for d in node.decorator_list:
            self.named("references", qualified, d.func if isinstance(d, ast.Call) else d, start)

    @staticmethod
    def _start(node) -> int:
        return min([node.lineno, *[d.lineno for d in node.decorator_list]])

    def function(self, node, scope: str, kind: str) -> None:
        qualified, start = f"{scope}.{node.name}", self._start(node)
        self.symbol(kind, node.name, qualified, start, node.end_lineno, scope, self.signature(node), self.docstring(node.body))
        self._decorated(node, qualified, start)
        a = node.args
        for p in [*a.posonlyargs, *a.args, *[x for x in (a.vararg,) if x], *a.kwonlyargs, *[x for x in (a.kwarg,) if x]]:
            self.named("references", qualified, p.annotation, start)
        self.named("references", qualified, node.returns, start)
        self.block(node.body, qualified, in_class=False, variables=False)

    def class_(self, node: ast.ClassDef, scope: str) -> None:
        qualified, start = f"{scope}.{node.name}", self._start(node)
        self.symbol("class", node.name, qualified, start, node.end_lineno, scope, None, self.docstring(node.body))
        self._decorated(node, qualified, start)
        for base in node.bases:
            self.named("inherits", qualified, base.value if isinstance(base, ast.Subscript) else base)
        self.block(node.body, qualified, in_class=True, variables=True)

    def variable(self, node: ast.Assign | ast.AnnAssign, scope: str) -> None:
        target = node.targets[0] if isinstance(node, ast.Assign) else node.target
        if not isinstance(target, ast.Name) or isinstance(node, ast.AnnAssign) and not node.simple:
            return
        qualified = f"{scope}.{target.id}"
        self.symbol("variable", target.id, qualified, node.lineno, node.end_lineno, scope)
        self.named("references", qualified, getattr(node, "annotation", None))

    def scan(self, node: ast.AST, scope: str) -> None:
        """Calls and imports below a statement, in reading order, not inside scopes of their own."""
        found, todo = [], [node]
        while todo:
            n = todo.pop()
            if isinstance(n, _SCOPES):
                continue
            if isinstance(n, ast.Call | ast.Import | ast.ImportFrom):
                found.append(n)
            todo += ast.iter_child_nodes(n)
        for n in sorted(found, key=lambda n: (n.lineno, n.col_offset, -n.end_lineno, -n.end_col_offset)):
            if isinstance(n, ast.Call):
                self.named("calls", scope, n.func, n.lineno)
            elif isinstance(n, ast.Import):
                for name in n.names:
                    self.reference("imports", scope, name.name, n.lineno)
            else:
                for target in self.imported(n):
                    self.reference("imports", scope, target, n.lineno)

    def imported(self, node: ast.ImportFrom) -> list[str]:
        module = node.module or ""
        if module == "__future__" and not node.level:
            return []
        if node.level:
            up = node.level - 1
            if up > len(self.package):
                return []
            parts = [*self.package[: len(self.package) - up], *([module] if module else [])]
            if not parts:
                return []
            module = ".".join(parts)
        names = [n.name for n in node.names if n.name != "*"]
        return [f"{module}.{n}" for n in names] or [module]


def parse_python(path: str, text: str) -> Parsed:
    """Never raises on bad source."""
    tree, shown = _tree(text), text
    if tree is None:
        tree, shown = _recovered(text)
    name = module_name(path)
    try:
        reader = _Reader(path, text, shown)
        reader.symbol("file", path.rpartition("/")[2], name, 1, max(reader.out.n_lines, 1), None, None, reader.docstring(tree.body) if tree else None)
        if tree:
            reader.block(tree.body, name, in_class=False, variables=True)
        return reader.out
    except (RecursionError, IndexError, UnicodeError):
        out = Parsed(path, count_lines(text))
        out.symbols = [{
            "symbol_seq": 0, "kind": "file", "name": path.rpartition("/")[2], "qualified_name": name, "start_line": 1, "end_line": max(out.n_lines, 1),
            "signature": None, "docstring": None, "parent_qualified_name": None,
        }]
        return out


#: Files that a task reads, about.
FILES_A_TASK = 200

PARSED = (
    "path string, blob_sha string, n_lines int, "
    "symbols array<struct<symbol_seq:int,kind:string,name:string,qualified_name:string,start_line:int,end_line:int,signature:string,docstring:string,parent_qualified_name:string>>, "
    "references array<struct<ref_seq:int,kind:string,src_qualified_name:string,target_text:string,evidence_line:int>>"
)


def parse_files(files: DataFrame) -> DataFrame:
    """A row for each file (path, content) that is UTF-8; others are left out. Columns as in PARSED."""
    ship(files.sparkSession)
    schema = to_arrow_schema(StructType.fromDDL(PARSED))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, content, sha in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), b.column("blob_sha").to_pylist(), strict=True):
                try:
                    text = content.decode("utf-8")
                except UnicodeDecodeError:
                    continue
                p = parse_python(path, text)
                rows.append({"path": path, "blob_sha": sha, "n_lines": p.n_lines, "symbols": p.symbols, "references": p.references})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("path", "content", F.sha2("content", 256).alias("blob_sha")).mapInArrow(parsed, PARSED)


CHANGED = f"outcome string, {PARSED}"


def parse_changed(files: DataFrame, known: DataFrame) -> DataFrame:
    """A row for each file (path, lang, and uri or content) that can be read, with its outcome: parsed, unchanged or skipped.

    known: (path, blob_sha) of files as they were read before; a file of the same content is not parsed
    again. Files without a language and files that are not UTF-8 are skipped. A file is read once, by the
    task that parses it.
    """
    spark = files.sparkSession
    ship(spark)
    schema, by_uri = to_arrow_schema(StructType.fromDDL(CHANGED)), "uri" in files.columns
    source = "uri" if by_uri else "content"
    both = files.select("path", "lang", source).join(known.select("path", F.col("blob_sha").alias("known")), "path", "left")
    if by_uri:  # names are small and files are not, so rows are spread by their number
        both = both.repartition(max(spark.sparkContext.defaultParallelism, -(-files.count() // FILES_A_TASK)))

    def row(path: str, lang: str | None, given: str | bytes, sha: str | None) -> dict | None:
        out = {"path": path, "outcome": "skipped", "blob_sha": None, "n_lines": None, "symbols": [], "references": []}
        if lang is None:
            return out
        content = read_bytes(given) if by_uri else given
        if content is None:
            return None
        out["blob_sha"] = hashlib.sha256(content).hexdigest()
        if out["blob_sha"] == sha:
            return out | {"outcome": "unchanged"}
        from .typescript_source import parse_typescript

        try:
            p = {"python": parse_python, "typescript": parse_typescript}[lang](path, content.decode("utf-8"))
        except UnicodeDecodeError:
            return out
        return out | {"outcome": "parsed", "n_lines": p.n_lines, "symbols": p.symbols, "references": p.references}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                rows = [row(*r) for r in zip(*(part.column(c).to_pylist() for c in ("path", "lang", source, "known")), strict=True)]
                yield pa.RecordBatch.from_pylist([r for r in rows if r], schema)

    return both.select("path", "lang", source, "known").mapInArrow(read, CHANGED)
