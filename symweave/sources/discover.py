"""Discovery of the files to index: on any file system that Spark reads, or by git on the driver."""

from __future__ import annotations

import os
import stat
import subprocess
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extension, has_path_prefix
from ..shared import written
from ..shipping import ship

SIZE_CAP_BYTES = 1_000_000
# Directories that are never walked, besides those that start with a dot.
SKIP_DIRS = (
    ".git", ".hg", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".svn", ".tox", ".venv", "__pycache__", "bower_components", "build", "dist", "env",
    "node_modules", "site-packages", "venv",
)
LANGUAGES = {".py": "python", ".ts": "typescript", ".tsx": "typescript"}


def git(root: str, *args: str) -> str | None:
    """Output of a git command in a working copy whose top is root; None where that fails."""
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, timeout=120)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout.decode("utf-8", "surrogateescape") if done.returncode == 0 else None


def clone(url: str, folder: str) -> str:
    """The working copy of a git repository below the folder, cloned with its newest commit alone, or brought up to it."""
    if url.startswith("-"):
        raise ValueError(f"{url!r} is not the URL of a repository")
    if is_git_root(folder):
        done = git(folder, "fetch", "--quiet", "--depth", "1", "origin", "HEAD") is not None and git(folder, "reset", "--quiet", "--hard", "FETCH_HEAD") is not None
    else:
        Path(folder).parent.mkdir(parents=True, exist_ok=True)
        done = git(str(Path(folder).parent), "clone", "--quiet", "--depth", "1", "--", url, folder) is not None
    if not done:
        raise ValueError(f"git could not read {url}")
    return folder


def is_git_root(root: str) -> bool:
    top = git(root, "rev-parse", "--show-toplevel")
    return top is not None and Path(top.rstrip("\n")).resolve() == Path(root).resolve()


def current_sha(root: str) -> str | None:
    """None outside of git and before the first commit."""
    sha = git(root, "rev-parse", "--verify", "HEAD") if is_git_root(root) else None
    return sha.strip() if sha else None


def commits_behind(root: str, from_sha: str, to_sha: str = "HEAD") -> int | None:
    """None if unknown: no git, or a commit that is no longer there."""
    n = git(root, "rev-list", "--count", f"{from_sha}..{to_sha}") if is_git_root(root) else None
    return int(n) if n and n.strip().isdigit() else None


def changed_paths(root: str, from_sha: str, to_sha: str = "HEAD") -> set[str]:
    return {x for x in (git(root, "diff", "--name-only", "-z", f"{from_sha}..{to_sha}") or "").split("\0") if x}


def git_listing(spark: SparkSession, root: str) -> DataFrame:
    """(path): tracked files and those that are neither tracked nor ignored."""
    raw = git(root, "ls-files", "--cached", "--others", "--exclude-standard", "-z") or ""
    return spark.createDataFrame([(p.replace("\\", "/"),) for p in sorted(set(raw.split("\0"))) if p], "path string")


def in_skipped_dir(path: Column, skip: tuple[str, ...] = SKIP_DIRS) -> Column:
    """Whether a directory of the path is skipped; the file's own name does not count."""
    dirs = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    return F.exists(dirs, lambda d: d.isin(*skip) | d.startswith("."))


def _skipped(name: str, skip: tuple[str, ...]) -> bool:
    return name in skip or name.startswith(".")


_LISTED = "path string, uri string, length long"


def walked(spark: SparkSession, root: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """(path relative to root, uri, length) of the files of a local folder, links and skipped folders left out."""
    rows, todo = [], [(root, "")]
    while todo:
        folder, prefix = todo.pop()
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            continue
        for e in entries:
            if e.is_dir(follow_symlinks=False):
                if not skip or not _skipped(e.name, skip):
                    todo.append((e.path, f"{prefix}{e.name}/"))
            elif e.is_file(follow_symlinks=False):
                rows.append((f"{prefix}{e.name}", f"file:{e.path}", e.stat(follow_symlinks=False).st_size))
    return spark.createDataFrame(rows, _LISTED)


def git_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, uri, length) of what git lists below the top of a working copy, links left out; nothing is walked."""
    rows = []
    for r in git_listing(spark, root).toLocalIterator():
        full = f"{root.rstrip('/')}/{r['path']}"
        try:
            found = os.lstat(full)
        except OSError:
            continue
        linked = any(os.path.islink(os.path.join(root, *r["path"].split("/")[:k])) for k in range(1, r["path"].count("/") + 1))
        if stat.S_ISREG(found.st_mode) and not linked:
            rows.append((r["path"], f"file:{full}", found.st_size))
    return spark.createDataFrame(rows, _LISTED)


#: Folders of one level that the driver lists itself; more are listed by the executors.
LISTED_HERE = 64


def listed(spark: SparkSession, root: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """(path relative to root, uri, length) of every file below root that is in no skipped folder.

    Folders are listed level by level by the file system itself, as Spark's file sources leave out
    names that start with an underscore, and `__init__.py` is one. A level of many folders is listed
    on the executors.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    top = hadoop.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base = fs.makeQualified(top).toString().rstrip("/") + "/"
    rows, parts, level = [], [], [""]
    while len(level) <= LISTED_HERE and level:
        deeper = []
        for folder in level:
            for found in fs.listStatus(hadoop.Path(base + folder) if folder else top):
                name = found.getPath().getName()
                if found.isDirectory():
                    if not skip or not _skipped(name, skip):
                        deeper.append(f"{folder}{name}/")
                elif found.isFile():
                    rows.append((folder + name, found.getPath().toString(), found.getLen()))
        level = deeper
    if level:
        ship(spark)
        folders = spark.createDataFrame([(x,) for x in level], "path string")

        def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for folder in b.column("path").to_pylist():
                    fs, inner = _opened(base + folder)
                    found = fs.get_file_info(pafs.FileSelector(inner, recursive=False))
                    kept = [f for f in found if f.type == pafs.FileType.File or f.type == pafs.FileType.Directory and (not skip or not _skipped(f.base_name, skip))]
                    folder_marks = [f.type == pafs.FileType.Directory for f in kept]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([folder + f.base_name + "/" * d for f, d in zip(kept, folder_marks, strict=True)], pa.string()),
                            pa.array([base + folder + f.base_name for f in kept], pa.string()),
                            pa.array([f.size or 0 for f in kept], pa.int64()), pa.array(folder_marks, pa.bool_()),
                        ], ["path", "uri", "length", "folder"],
                    )

        while not folders.isEmpty():
            spread = folders.repartition(max(spark.sparkContext.defaultParallelism, LISTED_HERE))
            here = written(spread.mapInArrow(entries, f"{_LISTED}, folder boolean"), "listed")
            parts.append(here.where("NOT folder").drop("folder"))
            folders = here.where("folder").select("path")
    return reduce(DataFrame.unionByName, parts, spark.createDataFrame(rows, _LISTED))


def read_bytes(uri: str) -> bytes | None:
    """None if it cannot be read."""
    try:
        fs, inner = _opened(uri)
        with fs.open_input_stream(inner) as source:
            return source.read()
    except OSError:
        return None


def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """Local names are taken as they are, as they come unquoted."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def with_content(files: DataFrame) -> DataFrame:
    """(path, content, length) of listed files; one that cannot be read is left out."""
    ship(files.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, uri, length in zip(*(b.column(c).to_pylist() for c in ("path", "uri", "length")), strict=True):
                if (content := read_bytes(uri)) is not None:
                    rows.append((path, content, length))
            columns = zip(*rows, strict=True) if rows else ([],) * 3
            kinds = (pa.string(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "content", "length"])

    return files.select("path", "uri", "length").mapInArrow(read, "path string, content binary, length long")


def found_files(
    spark: SparkSession, root: str, *, size_cap: int = SIZE_CAP_BYTES, skip: tuple[str, ...] = SKIP_DIRS, exclude: tuple[str, ...] = (), strict_skip: bool = False
) -> DataFrame:
    """(path, uri, length) of the files to look at; nothing is read.

    At the top of a git working copy git says which files there are, and skipped directories
    apply with strict_skip only; elsewhere everything outside skipped and dot directories is
    taken. exclude: paths, by whole segments. Links and files over the cap are left out.
    """
    local = Path(root.removeprefix("file://"))
    known = "://" not in root.removeprefix("file://") and local.is_dir()
    if known and is_git_root(str(local)):
        files = git_files(spark, str(local))
        files = files.where(~in_skipped_dir(F.col("path"), skip)) if strict_skip else files
    else:
        files = walked(spark, str(local), skip) if known else listed(spark, root, skip)
    files = files.where(F.col("length") <= size_cap)
    for prefix in exclude:
        files = files.where(~has_path_prefix(F.regexp_replace("uri", r"^file:/+", "/"), prefix.removeprefix("file://")))
    return files


def discover(
    spark: SparkSession, root: str, *, size_cap: int = SIZE_CAP_BYTES, skip: tuple[str, ...] = SKIP_DIRS, exclude: tuple[str, ...] = (), strict_skip: bool = False
) -> DataFrame:
    """(path, content, length) of found_files()."""
    return with_content(found_files(spark, root, size_cap=size_cap, skip=skip, exclude=exclude, strict_skip=strict_skip))


def with_language(files: DataFrame) -> DataFrame:
    """files with lang by extension, null where no language pack has it."""
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return files.withColumn("lang", F.try_element_at(known, extension(F.col("path"))))
