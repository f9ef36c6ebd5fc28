"""Occurrences from an external SCIP index: a small decoder of its wire format, and the indexer's run."""

from __future__ import annotations

import os
import shutil
import subprocess
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship
from .discover import SKIP_DIRS

INDEXER, TIMEOUT_SECONDS = "scip-python", 120.0
# Fixed values of the public format: field numbers and the role bit of a definition.
INDEX_DOCUMENTS, DOCUMENT_PATH, DOCUMENT_OCCURRENCES = 2, 1, 2
OCCURRENCE_RANGE, OCCURRENCE_SYMBOL, OCCURRENCE_ROLES, OCCURRENCE_SINGLE_LINE, OCCURRENCE_MULTI_LINE = 1, 2, 3, 8, 9
RANGE_LINE, DEFINITION = 1, 1


class ScipUnavailable(Exception):
    """The indexer or its output cannot be used; indexing goes on without it."""


def _varint(data: memoryview, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value & 0xFFFFFFFFFFFFFFFF, at
        shift += 7
        if shift > 63:
            raise ValueError("a number is too long")


def fields(data: memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """(field number, value) of a message: a number, or the bytes of a text or message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"unknown wire type {kind}")
        if at > len(data):
            raise ValueError("the message ends early")
        yield tag >> 3, value


def _int32(value: int) -> int:
    value &= 0xFFFFFFFF
    return value - (1 << 32) if value >> 31 else value


def _line(typed: memoryview | None, old: list[int]) -> int | None:
    """A typed range counts before the old one, which has three or four numbers."""
    if typed is not None:
        line = 0
        for number, value in fields(typed):
            if number == RANGE_LINE:
                line = _int32(value)
        return line
    return _int32(old[0]) if len(old) in (3, 4) else None


def _occurrence(data: memoryview) -> tuple[int | None, str, bool]:
    typed, old, symbol, roles = None, [], "", 0
    for number, value in fields(data):
        if number == OCCURRENCE_RANGE:
            if isinstance(value, int):
                old.append(value)
            else:
                at = 0
                while at < len(value):
                    n, at = _varint(value, at)
                    old.append(n)
        elif number == OCCURRENCE_SYMBOL:
            symbol = bytes(value).decode("utf-8")
        elif number == OCCURRENCE_ROLES:
            roles = value
        elif number in (OCCURRENCE_SINGLE_LINE, OCCURRENCE_MULTI_LINE):
            typed = value
    return _line(typed, old), symbol, bool(roles & DEFINITION)


def decode_index(data: bytes) -> list[tuple[str, int, str, bool]]:
    """(path, line0, symbol, is_definition) of occurrences that have a symbol and a line."""
    out = []
    try:
        for number, value in fields(memoryview(data)):
            if number != INDEX_DOCUMENTS:
                continue
            path, occurrences = "", []
            for inner, x in fields(value):
                if inner == DOCUMENT_PATH:
                    path = bytes(x).decode("utf-8").replace("\\", "/")
                elif inner == DOCUMENT_OCCURRENCES:
                    occurrences.append(_occurrence(x))
            out += [(path, line, symbol, definition) for line, symbol, definition in occurrences if symbol and line is not None]
    except (IndexError, ValueError, TypeError) as e:
        raise ScipUnavailable(f"not a valid index: {e}") from e
    return out


DECODED = "path string, line0 int, symbol string, is_definition boolean"


def decoded_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of the index files in a column of bytes."""
    for b in batches:
        for content in b.column("content").to_pylist():
            rows = decode_index(content)
            columns = zip(*rows, strict=True) if rows else ([],) * 4
            kinds = (pa.string(), pa.int32(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "line0", "symbol", "is_definition"])


def read_occurrences(spark: SparkSession, path: str) -> DataFrame:
    """Occurrences of all index files at a path; one task decodes one file."""
    ship(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(decoded_batches, DECODED)


def run_indexer(root: str, output: str, project: str, version: str | None = None, timeout: float = TIMEOUT_SECONDS) -> str:
    """Run the external indexer in root; the path of its index. Any failure raises ScipUnavailable."""
    if shutil.which(INDEXER) is None:
        raise ScipUnavailable(f"{INDEXER} is not on the path; install it, or index without it")
    target = Path(output)
    target.parent.mkdir(parents=True, exist_ok=True)
    try:
        relative = os.path.relpath(target, root)
    except ValueError as e:
        raise ScipUnavailable(f"{target} cannot be written relative to {root}: {e}") from e
    # an empty environment keeps it from listing installed packages
    environment = target.parent / "environment.json"
    environment.write_text("[]", encoding="utf-8")
    command = [INDEXER, "index", "--project-name", project, "--project-version", version or "unversioned", "--output", relative]
    command += ["--environment", str(environment), "--exclude", ",".join(f"**/{d}/**" for d in sorted(SKIP_DIRS)), "--no-progress-bar"]
    try:
        done = subprocess.run(command, cwd=root, timeout=timeout, capture_output=True)
    except FileNotFoundError as e:
        raise ScipUnavailable(f"{INDEXER} cannot be run: {e}") from e
    except subprocess.TimeoutExpired as e:
        raise ScipUnavailable(f"{INDEXER} took more than {timeout:.0f} s") from e
    if done.returncode:
        raise ScipUnavailable(f"{INDEXER} ended with {done.returncode}: {done.stderr.decode('utf-8', 'replace').strip()[:500] or 'no message'}")
    if not target.exists():
        raise ScipUnavailable(f"{INDEXER} left no {target}")
    decode_index(target.read_bytes())
    return str(target)
