"""Mutations as DataFrame functions, and the Parquet store that applies them.

A table is only ever rebuilt from its old rows and the change: keyed merges, anti joins, and
cascades that follow the references between tables. The store writes new versions beside the old
ones, bucket by bucket, and then publishes a state that names them, so a reader never sees a half-written table and no
path is read and overwritten at once.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import SCHEMA_VERSION, TABLES, TIERS, empty
from ..shared import written

_NATURAL = ["src_symbol_id", "dst_symbol_id", "kind", "tier"]


def one_of_each(rows: DataFrame, keys: list[str], order: list[str], *, last: bool = False) -> DataFrame:
    """The first row of each key by order, or the last; combined before the shuffle, so a key may be frequent."""
    pick = F.max_by if last else F.min_by
    row, place = F.struct(*[F.col(c) for c in rows.columns]), F.struct(*[F.col(c) for c in order])
    return rows.groupBy(*keys).agg(pick(row, place).alias("__row")).select("__row.*")


def numbered(rows: DataFrame, order: list[str], start: int = 0, name: str = "id") -> DataFrame:
    """rows with ids from start + 1 on in the given order.

    The order is total over the table, so rows are sorted by range and counted by partition;
    no window gathers them in one task; they are written once, so that the
    numbers cannot change when a part is computed again.
    """
    ordered = rows.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    marked = written(ordered.withColumn("__m", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__m", 33)
    sizes = marked.groupBy(part.alias("__p")).agg(F.count("*").alias("__c"))
    # one row for each partition
    before = sizes.select("__p", F.coalesce(F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    at = F.col("__m").bitwiseAND((1 << 33) - 1)
    placed = marked.withColumn("__p", part).join(F.broadcast(before), "__p")
    return placed.withColumn(name, (F.col("__b") + at + 1 + start).cast("long")).drop("__m", "__p", "__b")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], top: int = 0) -> DataFrame:
    """old with the rows of new, which has no id: a known key keeps its id and takes every other value, nulls too.

    New keys are numbered from top + 1 on, by default from the highest id that old has.
    """
    known = old.select(*keys, F.col("id").cast("long").alias("id"))
    top = top or old.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    kept = new.join(known, keys).select(*old.columns)
    fresh = numbered(new.join(known, keys, "left_anti"), keys, top).select(*old.columns)
    return old.join(new.select(*keys), keys, "left_anti").select(*old.columns).unionByName(kept).unionByName(fresh)


def replace_of_files(old: DataFrame, new: DataFrame, file_ids: DataFrame, column: str = "file_id") -> DataFrame:
    """old without the rows of the files in file_ids, and new."""
    return old.join(file_ids.select(F.col("id").alias(column)), column, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def insert_edges(old: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """Edges to add: the first of each natural key by order that old does not have."""
    first = one_of_each(new, _NATURAL, order)
    return first.join(old.select(*_NATURAL), _NATURAL, "left_anti").select(*new.columns)


def check_tiers(edges: DataFrame) -> None:
    bad = edges.where(F.col("tier").isNull() | ~F.col("tier").isin(*TIERS)).limit(1).collect()
    if bad:
        raise ValueError(f"an edge has the tier {bad[0]['tier']!r}")


def delete_edges_of_file(edges: DataFrame, file_id: int) -> DataFrame:
    return edges.where(~F.col("evidence_file_id").eqNullSafe(F.lit(file_id)))


def backfill_scip(symbols: DataFrame, found: DataFrame) -> DataFrame:
    """symbols with the names of found (symbol_id, scip_symbol) where it has one; a symbol takes the last by name."""
    one = found.groupBy(F.col("symbol_id").alias("id")).agg(F.max("scip_symbol").alias("__new"))
    joined = symbols.join(one, "id", "left").withColumn("scip_symbol", F.coalesce("__new", "scip_symbol"))
    return joined.select(*symbols.columns)


def delete_files(tables: dict[str, DataFrame], file_ids: DataFrame) -> dict[str, DataFrame]:
    """tables without the files (column id): their symbols and chunks go, then edges at those symbols;
    edges elsewhere that had evidence in the files lose it."""
    gone = file_ids.select(F.col("id").alias("file_id")).distinct()
    out = dict(tables)
    out["file"] = tables["file"].join(gone.withColumnRenamed("file_id", "id"), "id", "left_anti")
    symbols = tables["symbol"]
    dead = symbols.join(gone, "file_id", "left_semi").select("id")
    out["symbol"] = symbols.join(gone, "file_id", "left_anti").select(*symbols.columns)
    for name in ("chunk", "reference"):
        if name in tables:
            out[name] = tables[name].join(gone, "file_id", "left_anti").select(*tables[name].columns)
    edges = tables["edge"]
    for end in ("src_symbol_id", "dst_symbol_id"):
        edges = edges.join(dead.withColumnRenamed("id", end), end, "left_anti")
    lost = gone.select(F.col("file_id").alias("evidence_file_id"), F.lit(True).alias("__lost"))
    edges = edges.join(lost, "evidence_file_id", "left").withColumn("evidence_file_id", F.when(F.col("__lost").isNull(), F.col("evidence_file_id")))
    out["edge"] = edges.select(*tables["edge"].columns)
    return out


def delete_repo(tables: dict[str, DataFrame], repo_id: int) -> dict[str, DataFrame]:
    return {n: df.where(F.col("id" if n == "repo" else "repo_id") != repo_id) for n, df in tables.items()}


def fold_runs(events: DataFrame) -> DataFrame:
    """Run events (run_id, seq and any values) folded to one row: the last value of each column that has one."""
    values = [c for c in events.columns if c not in ("run_id", "seq")]
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in values]
    return events.groupBy("run_id").agg(*last)


class Conflict(RuntimeError):
    """Another writer committed what this one read or replaces."""


#: Which column's hash deals a table's rows to the buckets of their repository: the file that a row is of.
BUCKET_OF = {"file": "id", "symbol": "file_id", "reference": "file_id", "chunk": "file_id", "edge": "evidence_file_id", "snapshot": "path"}
#: Files for each bucket, and buckets of a repository at most.
FILES_A_BUCKET, MOST_BUCKETS = 16, 256


def buckets_for(files: int) -> int:
    return min(MOST_BUCKETS, 1 << (max(1, files) // FILES_A_BUCKET).bit_length())


def _bucket(name: str, n: int) -> Column:
    return F.pmod(F.xxhash64(F.col(BUCKET_OF[name])), F.lit(n)).cast("int") if name in BUCKET_OF else F.lit(0)


class Store:
    """The tables of one or more repositories below a folder that Spark can reach.

    A table is kept by repository, and there in buckets of files. A commit writes the buckets that it
    changes to new folders and then publishes a numbered state file, which names the folders of every bucket; the
    state with the highest number is current, and a number can be published once. Readers never see
    a missing or half-written state, and what a state names stays on disk for RETAIN_SECONDS after a later one, so
    that DataFrames read before keep working.

    A writer pins the state that it reads (`pinned`) and passes it to `commit`. If others committed since, the
    commit goes through as long as they changed other repositories or other tables, and is a Conflict
    otherwise. Ids are handed out by `reserve`, so writers at work at once have different ones.
    """

    RETAIN_SECONDS = 24 * 3600

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._path = self._hadoop.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        state = self.pinned()
        if state["number"] and state["version"] != SCHEMA_VERSION:
            raise ValueError(f"{root} has schema version {state['version']}; this is {SCHEMA_VERSION}")

    # -- states

    def _states(self) -> dict[int, object]:
        """Status of each published state file by its number."""
        found = self._fs.globStatus(self._path(f"{self.root}/state-*.json")) if self._fs.exists(self._path(self.root)) else []
        return {int(s.getPath().getName()[6:-5]): s for s in found or []}

    def pinned(self, number: int | None = None) -> dict:
        """The current state, or that of a number, to read from and to commit upon."""
        if number is None:
            number = max(self._states(), default=0)
        if not number:
            return {"version": SCHEMA_VERSION, "number": 0, "tables": {}, "top": {}, "applied": {}}
        source = self._fs.open(self._path(f"{self.root}/state-{number:09d}.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()

    def _publish(self, state: dict, base: int) -> None:
        """Make state the one after base."""
        state["number"] = base + 1
        new = self._path(f"{self.root}/.new-{uuid.uuid4().hex}")
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps(state, sort_keys=True), "utf-8"))
        out.close()
        final = self._path(f"{self.root}/state-{state['number']:09d}.json")
        context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 0)
        try:
            if max(self._states(), default=0) != base:
                raise Conflict(f"state {base} of {self.root} is no longer the last")
            context.rename(self._fs.makeQualified(new), self._fs.makeQualified(final), options)  # fails if it exists
        except Py4JJavaError as e:
            if self._fs.exists(final):
                raise Conflict(f"state {state['number']} of {self.root} was published by another writer") from e
            raise
        finally:
            self._fs.delete(new, False)

    def _change(self, change: Callable[[dict], None]) -> None:
        """Apply change to the current state and publish it, again upon each state that others publish meanwhile."""
        while True:
            state = self.pinned()
            base = state["number"]
            change(state)
            try:
                return self._publish(state, base)
            except Conflict:
                if max(self._states(), default=0) == base:
                    raise

    def reserve(self, name: str, n: int) -> int:
        """The id below n ids that nobody else is given."""
        start = []

        def take(state: dict) -> None:
            start[:] = [int(state["top"].get(name, 0))]
            state["top"][name] = start[0] + n

        if n:
            self._change(take)
            return start[0]
        return self.top_id(name)

    def top_id(self, name: str) -> int:
        """The highest id that a table ever had or was promised."""
        return int(self.pinned()["top"].get(name, 0))

    # -- reading

    def _leaves(self, repo: str, entry: dict, only: set[int] | None = None) -> list[str]:
        """Folders of a repository's buckets, each with its rows alone."""
        return [f"{self.root}/{folder}/__repo={repo}/__bucket={b}" for folder, bs in sorted(entry["places"].items()) for b in bs if only is None or b in only]

    def _read(self, name: str, leaves: list[str]) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(*leaves) if leaves else empty(self.spark, TABLES[name])

    def table(self, name: str, repo_id: int | None = None, state: dict | None = None) -> DataFrame:
        """A table, or what one repository has in it; of the current state or of one that is pinned."""
        entries = (state or self.pinned())["tables"].get(name, {})
        wanted = entries if repo_id is None else {k: e for k, e in entries.items() if k == str(repo_id)}
        return self._read(name, [x for k, e in sorted(wanted.items()) for x in self._leaves(k, e)])

    def tables(self, repo_id: int | None = None, state: dict | None = None) -> dict[str, DataFrame]:
        state = state or self.pinned()
        return {n: self.table(n, repo_id, state) for n in TABLES}

    # -- writing

    def _write(self, name: str, rows: DataFrame, n: int) -> dict[str, dict]:
        """Entries by repository of rows that are written to n buckets each."""
        if name == "edge":
            check_tiers(rows)
        place = f"{name}/{uuid.uuid4().hex}"
        typed = rows.select(*[F.col(f.name).cast(f.dataType) for f in TABLES[name]])
        placed = typed.withColumns({"__repo": F.col("id" if name == "repo" else "repo_id"), "__bucket": _bucket(name, n)})
        placed.repartition("__repo", "__bucket").write.partitionBy("__repo", "__bucket").parquet(f"{self.root}/{place}")
        out: dict[str, dict] = {}
        for repo in self._folders(place, "__repo="):
            out[repo] = {"buckets": n, "places": {place: sorted(int(b) for b in self._folders(f"{place}/__repo={repo}", "__bucket="))}}
        return out

    def _folders(self, place: str, start: str) -> list[str]:
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/{place}")) if s.isDirectory()]
        return [f.removeprefix(start) for f in found if f.startswith(start)]

    def commit(
        self, changed: dict[str, DataFrame] | None = None, repo_id: int | None = None, gone: tuple[int, ...] = (), *,
        parts: dict[str, tuple[DataFrame, DataFrame]] | None = None, base: dict | None = None, buckets: int = 1, alone: bool = False, numbered: bool = False, applied: dict[str, int] | None = None,
    ) -> None:
        """Write changes, all or none of which become current.

        changed: whole tables, in so many buckets; with repo_id they are that repository's and replace what
        it had. parts: (rows to add, rows to remove, by the column of BUCKET_OF and, if they have it, by id) of
        the repository; only the buckets that they are in are written. gone: repositories to forget.
        base: the state that was read, by default the current one. alone: no commit of others at all may lie between.
        numbered: ids come from `reserve`. applied: streams and the batch of each that this commit makes good.
        """
        base = base or self.pinned()
        mine, new = str(repo_id), {}
        for name, df in (changed or {}).items():
            new[name] = self._write(name, df, buckets if name in BUCKET_OF else 1)
            if repo_id is not None and set(new[name]) - {mine}:
                raise ValueError(f"rows of other repositories than {repo_id}")
        for name, (added, removed) in (parts or {}).items():
            new[name] = {mine: self._merged(name, added, removed, mine, base)}
        tops = {} if numbered else {n: self._read(n, [x for k, e in new[n].items() for x in self._leaves(k, e)]).agg(F.max("id")).first()[0] or 0 for n in new if "id" in TABLES[n].names}

        def version(state: dict, name: str) -> object:
            entries = state["tables"].get(name, {})
            return entries.get(mine, {}).get("commit") if repo_id is not None else {k: e["commit"] for k, e in entries.items()}

        def apply(state: dict) -> None:
            if state["number"] != base["number"]:
                lost = mine in base["tables"].get("repo", {}) and mine not in state["tables"].get("repo", {})
                if alone or lost or any(version(state, n) != version(base, n) for n in new):
                    raise Conflict(f"state {base['number']} of {self.root} was read, and {state['number']} changed the same")
                if any(state["applied"].get(k, -1) != base["applied"].get(k, -1) for k in applied or {}):
                    raise Conflict(f"a batch was applied twice at once to {self.root}")
            for g in gone:
                for entries in state["tables"].values():
                    entries.pop(str(g), None)
            for name, entries in new.items():
                now = state["tables"].setdefault(name, {})
                if repo_id is None:
                    now.clear()
                now.pop(mine, None)
                now.update({k: e | {"commit": state["number"] + 1} for k, e in entries.items() if e["places"]})
            for name, top in tops.items():
                state["top"][name] = max(state["top"].get(name, 0), top)
            state["applied"].update(applied or {})

        self._change(apply)
        self.vacuum()

    def _merged(self, name: str, added: DataFrame, removed: DataFrame, repo: str, base: dict) -> dict:
        """A repository's entry once the buckets that rows come to or go from are written anew."""
        entry = base["tables"].get(name, {}).get(repo) or {"buckets": 1, "places": {}}
        n, of = entry["buckets"], BUCKET_OF[name]
        at = _bucket(name, n).alias("b")
        touched = {r["b"] for r in added.select(at).unionByName(removed.select(at)).distinct().collect()}  # MOST_BUCKETS at most
        if not touched:
            return entry
        key = "id" if "id" in removed.columns else of
        left = self._read(name, self._leaves(repo, entry, touched)).join(removed.select(key), key, "left_anti")
        written_ = self._write(name, left.select(*TABLES[name].names).unionByName(added.select(*TABLES[name].names)), n)
        if set(written_) - {repo}:
            raise ValueError(f"rows of other repositories than {repo}")
        kept = {f: [b for b in bs if b not in touched] for f, bs in entry["places"].items()}
        return {"buckets": n, "places": {f: bs for f, bs in kept.items() if bs} | written_.get(repo, {"places": {}})["places"]}

    # -- disk

    def vacuum(self, retain_seconds: int | None = None) -> int:
        """Delete states that were replaced longer ago, and the data that only they name; the number of folders deleted."""
        keep_ms = 1000 * (self.RETAIN_SECONDS if retain_seconds is None else retain_seconds)
        states = sorted(self._states().items())
        # a state is replaced when the next one is written
        old = [n for (n, _), (_, after) in zip(states, states[1:], strict=False) if time.time() * 1000 - after.getModificationTime() >= keep_ms]
        if not old:
            return 0
        named = lambda ns: {x for n in ns for t in self.pinned(n)["tables"].values() for k, e in t.items() for x in self._leaves(k, e)}
        dead = named(old) - named([n for n, _ in states if n not in old])
        for p in sorted(dead):
            self._fs.delete(self._path(p), True)
        for n in old:
            self._fs.delete(self._path(f"{self.root}/state-{n:09d}.json"), False)
        return len(dead)

    def size_bytes(self) -> int:
        """Of all files below the folder; 0 if there is none."""
        path = self._path(self.root)
        return int(self._fs.getContentSummary(path).getLength()) if self._fs.exists(path) else 0

    def delete(self) -> bool:
        """False if there is nothing to delete."""
        path = self._path(self.root)
        return bool(self._fs.exists(path)) and bool(self._fs.delete(path, True))
