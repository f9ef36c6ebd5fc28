"""Chunks of source files along symbols, for retrieval.

A function, method or class is a chunk of its own while it has MOST tokens at most and LEAST
at least. A larger one gives its parts as chunks, and what is left of it is cut at statements
into stretches of MOST tokens at most; a smaller one stays with what is around it. Lines outside
of symbols are chunks of the file. Every line with a token is in exactly one chunk.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .python_source import _recovered, _tree, parse_python, source_lines

LEAST, MOST = 50, 800
_TOKEN = re.compile(r"\w+|[^\w\s]")
_KINDS = ("class", "function", "method")


@dataclass
class _Node:
    name: str | None
    start: int
    end: int
    kids: list[_Node] = field(default_factory=list)


def count_tokens(text: str) -> int:
    return len(_TOKEN.findall(text))


def _nested(symbols: list[dict], last: int) -> _Node:
    """Symbols by span; one that is not inside another's span is the file's."""
    root = _Node(None, 1, last)
    stack = [root]
    for s in sorted((s for s in symbols if s["kind"] in _KINDS), key=lambda s: (s["start_line"], -s["end_line"])):
        while len(stack) > 1 and s["start_line"] > stack[-1].end:
            stack.pop()
        node = _Node(s["qualified_name"], s["start_line"], min(s["end_line"], stack[-1].end))
        # symbols on one line share it, the first has it
        if stack[-1].kids and stack[-1].kids[-1].end >= node.start or node.start == stack[-1].start and len(stack) > 1:
            continue
        stack[-1].kids.append(node)
        stack.append(node)
    return root


def chunk_source(path: str, text: str, least: int = LEAST, most: int = MOST) -> list[tuple[str | None, int, int, str, int]]:
    """(qualified name or null, first line, last line, text, tokens) in line order."""
    lines = source_lines(text)
    sizes = [count_tokens(x) for x in lines]
    symbols = parse_python(path, text).symbols
    tree = _tree(text) or _recovered(text)[0]
    starts = {n.lineno for n in ast.walk(tree) if isinstance(n, ast.stmt)} if tree else set()
    out: list[tuple[str | None, int, int]] = []

    def size(a: int, b: int) -> int:
        return sum(sizes[a - 1 : b])

    def stretches(name: str | None, run: list[int]) -> None:
        """A run of lines, cut before statements once a stretch would grow too large."""
        begin, held = None, 0
        for i, line in enumerate(run):
            ahead = next((j for j in range(i + 1, len(run)) if run[j] in starts), len(run))
            if begin is not None and line in starts and held + sum(sizes[x - 1] for x in run[i:ahead]) > most:
                out.append((name, begin, run[i - 1]))
                begin, held = None, 0
            begin = line if begin is None else begin
            held += sizes[line - 1]
        if begin is not None:
            out.append((name, begin, run[-1]))

    def split(node: _Node) -> None:
        apart = [k for k in node.kids if size(k.start, k.end) >= least]
        covered = {x for k in apart for x in range(k.start, k.end + 1)}
        run: list[int] = []
        for line in range(node.start, min(node.end, len(lines)) + 1):
            if line in covered:
                stretches(node.name, run)
                run = []
            else:
                run.append(line)
        stretches(node.name, run)
        for k in apart:
            if size(k.start, k.end) <= most:
                out.append((k.name, k.start, k.end))
            else:
                split(k)

    split(_nested(symbols, len(lines)))
    return [(n, a, b, "".join(lines[a - 1 : b]), size(a, b)) for n, a, b in sorted(out, key=lambda c: c[1:]) if size(a, b)]


def chunks(files: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(path, qualified_name, start_line, end_line, text, n_tokens) of files (path, content); those that are not UTF-8 have none."""
    ship(files.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    rows += [(path, *c) for c in chunk_source(path, content.decode("utf-8"), least, most)]
                except UnicodeDecodeError:
                    continue
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32())
            columns = zip(*rows, strict=True) if rows else ([],) * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "qualified_name", "start_line", "end_line", "text", "n_tokens"])

    return files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(cut, "path string, qualified_name string, start_line int, end_line int, text string, n_tokens int")
