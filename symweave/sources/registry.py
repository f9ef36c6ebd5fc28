"""The registry of indexed repositories, and the lock that one index run holds. Driver side."""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import shutil
from collections.abc import Iterator
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..schemas import REGISTRY


class Locked(Exception):
    """Another live process indexes the repository."""


def normalized(path: str) -> str:
    return str(Path(path).expanduser().resolve())


def repo_hash(root_path: str) -> str:
    return hashlib.sha256(root_path.encode()).hexdigest()[:16]


class Workspace:
    """A folder with a registry and one folder for each repository."""

    def __init__(self, root: str) -> None:
        self.root = Path(root).expanduser()

    def repo_dir(self, root_path: str) -> Path:
        return self.root / repo_hash(normalized(root_path))

    @property
    def _file(self) -> Path:
        return self.root / "registry.json"

    def _entries(self) -> dict[str, dict]:
        return json.loads(self._file.read_text("utf-8")) if self._file.exists() else {}

    def _write(self, entries: dict[str, dict]) -> None:
        self.root.mkdir(parents=True, exist_ok=True)
        new = self._file.with_suffix(".new")
        new.write_text(json.dumps(entries, indent=2, sort_keys=True) + "\n", "utf-8")
        new.replace(self._file)

    def register(self, root_path: str) -> None:
        """A known repository keeps the time of its first registration."""
        root_path, entries = normalized(root_path), self._entries()
        entries.setdefault(repo_hash(root_path), {"root_path": root_path, "registered_at": datetime.now(UTC).isoformat(timespec="seconds")})
        self._write(entries)

    def unregister(self, root_path: str) -> None:
        entries = self._entries()
        if entries.pop(repo_hash(normalized(root_path)), None):
            self._write(entries)

    def listing(self) -> list[dict]:
        """Entries by root path, with whether their folder exists and its size."""
        rows = [{"repo_hash": k, **v, "exists": self.repo_dir(v["root_path"]).exists(), "size_bytes": self.size(v["root_path"])} for k, v in self._entries().items()]
        return sorted(rows, key=lambda r: r["root_path"])

    def registry(self, spark: SparkSession) -> DataFrame:
        rows = [(k, v["root_path"], datetime.fromisoformat(v["registered_at"])) for k, v in self._entries().items()]
        return spark.createDataFrame(rows, REGISTRY)

    def size(self, root_path: str) -> int:
        folder = self.repo_dir(root_path)
        return sum(f.stat().st_size for f in folder.rglob("*") if f.is_file()) if folder.exists() else 0

    def remove(self, root_path: str) -> bool:
        """Delete a repository's index under its lock, and then its entry; False if there is none."""
        folder = self.repo_dir(root_path)
        if not folder.exists():
            return False
        with self.lock(root_path):
            for child in folder.iterdir():
                if child.name != "lock":
                    shutil.rmtree(child) if child.is_dir() else child.unlink()
        shutil.rmtree(folder, ignore_errors=True)
        self.unregister(root_path)
        return True

    @contextlib.contextmanager
    def lock(self, root_path: str) -> Iterator[None]:
        """Held by one process; a lock whose process is gone is taken over."""
        path = self.repo_dir(root_path) / "lock"
        path.parent.mkdir(parents=True, exist_ok=True)
        for _ in range(2):
            try:
                handle = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
                break
            except FileExistsError:
                if _alive(path):
                    raise Locked(f"{root_path} is being indexed by another process") from None
                path.unlink(missing_ok=True)
        else:
            raise Locked(f"{root_path} is being indexed by another process")
        os.write(handle, json.dumps({"pid": os.getpid()}).encode())
        os.close(handle)
        try:
            yield
        finally:
            path.unlink(missing_ok=True)


def _alive(path: Path) -> bool:
    try:
        pid = int(json.loads(path.read_text("utf-8"))["pid"])
        os.kill(pid, 0)
    except (OSError, ValueError, KeyError, TypeError) as e:
        return isinstance(e, PermissionError)
    return True
