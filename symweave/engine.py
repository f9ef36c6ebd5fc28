"""The engine: index a folder of Python sources, ask what depends on a symbol, report status."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .operators import impact, report, resolve, retrieve, store, traverse
from .schemas import EDGE, FILE, INDEX_RUN, REPO, TIERS
from .shared import tidy, written
from .sources import chunks as chunk_source
from .sources import discover as found
from .sources import python_source, scip
from .streaming import incremental

_PHASE_DEFINES, _PHASE_HEURISTIC, _PHASE_RESOLVED = 0, 1, 2


@dataclass
class IndexResult:
    files_indexed: int
    files_skipped: int
    symbols: dict[str, int]
    edges: dict[str, int]
    scip_status: str
    warnings: list[str] = field(default_factory=list)
    #: of the files indexed, those that were not parsed again
    files_unchanged: int = 0


@dataclass
class Status:
    root_path: str
    indexed_sha: str | None
    current_sha: str | None
    #: one of the cases of report.drift(), and how many commits behind if that is known
    drift: str
    behind: int | None
    scip_status: str | None
    symbols: dict[str, int]
    edges: dict[str, int]
    last_run_status: str | None
    last_run_seconds: float | None
    size_bytes: int


class Engine:
    """One store of indexes. Repositories are told apart by their root path."""

    def __init__(self, spark: SparkSession, store_path: str) -> None:
        self.spark, self.store = spark, store.Store(spark, store_path)

    # -- index

    @tidy
    def index(
        self, root: str, *, occurrences: DataFrame | None = None, files: DataFrame | None = None, use_scip: bool = False, prune: bool = False, force: bool = False,
        remote_url: str | None = None, progress: Callable[[str], None] = lambda stage: None,
    ) -> IndexResult:
        """Index root, or the given files (path, content). A run that fails is recorded as interrupted.

        Files whose content is as it was are not parsed again, unless forced; references elsewhere that
        a change may concern are resolved again, so edges are those of a whole new index.
        occurrences: from a SCIP index; without them use_scip runs the indexer, and a run with neither
        leaves no resolved edges. prune: forget files that are gone from disk, which by default stay.
        remote_url: where the working copy came from, which is noted.
        """
        return self._run(root, remote_url, occurrences, files, use_scip, prune, force, progress)

    def _run(self, root, remote_url, *args, **more) -> IndexResult:
        repo_id, run_id = self._begin(root, remote_url)
        try:
            result = self._index(root, repo_id, remote_url, *args, **more)
        except BaseException as e:
            self._finish(repo_id, run_id, "interrupted", str(e)[:500], None)
            raise
        self._finish(repo_id, run_id, "ok", None, result.files_indexed)
        return result

    def _again(self, change: Callable[[dict], int | None]) -> int | None:
        """change, given a state to read and to commit upon, until no other writer comes between."""
        while True:
            try:
                return change(self.store.pinned())
            except store.Conflict:
                continue

    def _repo(self, root: str, **values) -> int:
        row = {"root_path": root, "remote_url": None, "indexed_sha": None, "indexed_at": None, "scip_status": None} | values

        def change(state: dict) -> int:
            known = self._repo_id(root, state)
            repo_id = known or self.store.reserve("repo", 1) + 1
            new = self.spark.createDataFrame([[repo_id, *[row[c] for c in REPO.names[1:]]]], REPO)
            # a new root must not be registered twice, so the state may have moved by its own reservation only
            self.store.commit({"repo": new}, repo_id, base=state if known else self.store.pinned(state["number"] + 1), alone=not known, numbered=True)
            return repo_id

        return self._again(change)

    def _begin(self, root: str, remote_url: str | None) -> tuple[int, int]:
        """A run that starts forgets what was known of the repository's last index."""
        repo_id = self._repo(root, remote_url=remote_url)
        run_id = self.store.reserve("index_run", 1) + 1

        def change(state: dict) -> None:
            runs = self.store.table("index_run", repo_id, state)
            before = runs.orderBy(F.desc("id")).select("to_sha").first()
            row = (run_id, repo_id, datetime.now(UTC).replace(tzinfo=None), None, before[0] if before else None, found.current_sha(root), "running", 0, None, None, None)
            self.store.commit({"index_run": runs.unionByName(self.spark.createDataFrame([row], INDEX_RUN))}, repo_id, base=state, numbered=True)

        self._again(change)
        return repo_id, run_id

    def _finish(self, repo_id: int, run_id: int, status: str, error: str | None, files_done: int | None) -> None:
        here = F.col("id") == run_id

        def change(state: dict) -> None:
            runs = self.store.table("index_run", repo_id, state).withColumns({
                "status": F.when(here, status).otherwise(F.col("status")),
                "finished_at": F.when(here, F.lit(datetime.now(UTC).replace(tzinfo=None))).otherwise(F.col("finished_at")),
                "error": F.when(here, F.lit(error)).otherwise(F.col("error")),
                "files_done": F.when(here & F.lit(files_done is not None), F.lit(files_done or 0)).otherwise(F.col("files_done")),
            })
            self.store.commit({"index_run": runs}, repo_id, base=state, numbered=True)

        self._again(change)

    @tidy
    def apply_snapshots(self, root: str, snapshots: DataFrame, batch: int, stream: str = "") -> bool:
        """Index a batch of a stream of file snapshots (path, seq, content or null for a file that is gone); False if it was applied before.

        A batch takes effect once: its number is published with what it changes. Of several snapshots of
        a path the one with the highest seq counts, and one that is older than what was applied before is refused.
        """
        name = f"{stream}@{root}"
        state = self.store.pinned()
        if state["applied"].get(name, -1) >= batch:
            return False
        repo_id = self._repo_id(root, state)
        stored = self.store.table("snapshot", repo_id or 0, state)
        new = written(incremental.newest(stored, snapshots), "snapshots")
        self._run(
            root, None, None, new.where("content IS NOT NULL").select("path", "content"), False, False, False, lambda stage: None,
            deleted=new.where("content IS NULL").select("path"), snapshots=new.select("path", "seq", F.col("content").isNull().alias("gone")), applied={name: batch},
        )
        return True

    def follow(self, root: str, folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        """Keep the index of root at the snapshots (path, seq, content) that arrive as Parquet files in a folder."""
        return incremental.watch(self.spark, folder, checkpoint, lambda files, batch: self.apply_snapshots(root, files, batch, checkpoint), available_now)

    def _index(self, root, repo_id, remote_url, occurrences, files, use_scip, prune, force, progress, deleted=None, snapshots=None, applied=None) -> IndexResult:
        progress("discover")
        read = found.with_language(files if files is not None else found.found_files(self.spark, root, exclude=(self.store.root,)))
        state = self.store.pinned()
        old = self.store.tables(repo_id, state)
        progress("parse")
        parsed = written(python_source.parse_changed(read, old["file"].limit(0) if force else old["file"]), "parsed")
        outcomes = {r["outcome"]: r["count"] for r in parsed.groupBy("outcome").count().collect()}
        new = parsed.where("outcome = 'parsed'")
        first = old["file"].isEmpty()
        more: dict = {"applied": applied}
        if snapshots is not None:
            more["parts"] = {"snapshot": (snapshots.withColumn("repo_id", F.lit(repo_id)), snapshots.select("path"))}
        if deleted is None:
            gone = old["file"].join(parsed.select("path"), "path", "left_anti").select("id")
        else:
            gone, prune = old["file"].join(deleted, "path", "left_semi").select("id"), True
        resolved = occurrences is not None or use_scip or not old["edge"].where("tier = 'resolved'").isEmpty()
        if not outcomes.get("parsed") and not first and not resolved and (not prune or gone.isEmpty()):
            if applied:
                self.store.commit(None, repo_id, base=state, numbered=True, **more)
            return self._indexed(root, remote_url, outcomes, "skipped", [])

        new_files = found.with_language(new).select(F.lit(repo_id).alias("repo_id"), "path", "lang", "blob_sha", "n_lines")
        known = old["file"].join(new_files.select("path"), "path", "left_semi").select(*FILE.names)
        fresh_paths = new_files.join(known.select("path"), "path", "left_anti")
        file_rows = written(store.upsert(known, new_files, ["repo_id", "path"], self.store.reserve("file", fresh_paths.count())), "files")
        file_ids = file_rows.select("id", "path")
        touched = file_ids.select("id")
        if prune:
            touched = written(touched.unionByName(gone), "touched")
        all_files = written(old["file"].join(touched, "id", "left_anti").select(*FILE.names).unionByName(file_rows.select(*FILE.names)), "files")
        status, warnings = "skipped", []
        if occurrences is None and use_scip:
            try:
                path = scip.run_indexer(root, f"{self.store.root}/scip/index.scip", root.rstrip("/").rpartition("/")[2] or "project")
                occurrences = scip.read_occurrences(self.spark, path)
            except scip.ScipUnavailable as e:
                status, warnings = "degraded", [str(e)]

        rows = new.join(file_ids.withColumnRenamed("id", "file_id"), "path").select("file_id", F.inline("symbols"))
        numbered = store.numbered(rows, ["file_id", "symbol_seq"], self.store.reserve("symbol", rows.count())).withColumns({"repo_id": F.lit(repo_id), "scip_symbol": F.lit(None).cast("string")})
        stale = old["symbol"].withColumn("scip_symbol", F.lit(None).cast("string"))
        symbols = written(store.replace_of_files(stale, numbered, touched), "symbols")
        fresh_refs = new.join(file_ids.withColumnRenamed("id", "file_id"), "path").select(F.lit(repo_id).alias("repo_id"), "file_id", F.inline("references"))
        refs = written(store.replace_of_files(old["reference"], fresh_refs, touched), "references")

        progress("resolve")
        own = symbols.where(F.col("repo_id") == repo_id)
        if first:
            heuristic = resolve.heuristic_edges(own, refs)
        else:
            # names that came, went, or are of symbols with new ids
            before = old["symbol"].join(touched.withColumnRenamed("id", "file_id"), "file_id", "left_semi").select("id", "qualified_name")
            names = before.select("qualified_name").unionByName(numbered.select("qualified_name")).distinct()
            sources = written(incremental.affected_sources(refs, names), "sources")
            again = refs.join(sources, "src_qualified_name", "left_semi")
            # a file's imports take part in the resolution of its other references
            context = refs.join(again.select("file_id").distinct(), "file_id", "left_semi")
            heuristic = resolve.heuristic_edges(own, context).join(again.select("file_id", "ref_seq"), ["file_id", "ref_seq"], "left_semi")
        parts = [
            resolve.defines_edges(own, numbered.select("id", "parent_qualified_name")).join(numbered.select(F.col("id").alias("dst_symbol_id"), F.col("symbol_seq").alias("ref_seq")), "dst_symbol_id")
            .withColumns({"phase": F.lit(_PHASE_DEFINES), "file_id": F.col("evidence_file_id")}),
            heuristic.withColumn("phase", F.lit(_PHASE_HEURISTIC)),
        ]
        if occurrences is not None:
            progress("scip")
            parts.append(resolve.scip_edges(own, refs, occurrences, all_files).withColumn("phase", F.lit(_PHASE_RESOLVED)))
            symbols = store.backfill_scip(symbols, resolve.scip_definitions(occurrences, all_files, own))
            status = "ok"
        fresh = parts[0]
        for p in parts[1:]:
            fresh = fresh.unionByName(p)
        kept = old["edge"].where("tier != 'resolved'").select(*EDGE.names)
        if not first:
            # edges of sources that are resolved again go, and those at symbols that are no more
            redone = own.join(sources.withColumnRenamed("src_qualified_name", "qualified_name"), "qualified_name", "left_semi").select(F.col("id").alias("src_symbol_id"), F.lit(True).alias("redone"))
            kept = kept.join(redone, "src_symbol_id", "left").where("redone IS NULL OR kind = 'defines'")
            for end in ("src_symbol_id", "dst_symbol_id"):
                kept = kept.join(own.select(F.col("id").alias(end)), end, "left_semi")
            kept = written(kept.select(*EDGE.names), "kept")
        added = written(store.insert_edges(kept, fresh, ["phase", "file_id", "ref_seq"]), "added")
        added = store.numbered(added, ["phase", "file_id", "ref_seq", "dst_symbol_id"], self.store.reserve("edge", added.count())).withColumns({"repo_id": F.lit(repo_id), "confidence": F.lit(1.0)})

        progress("write")
        added = added.select(*EDGE.names)
        if first or resolved:
            changed = {"file": all_files, "symbol": symbols, "reference": refs, "edge": kept.unionByName(added)}
            self.store.commit(changed, repo_id, base=state, buckets=store.buckets_for(all_files.count()), numbered=True, **more)
        else:
            of_files = touched.withColumnRenamed("id", "file_id")
            parts = {
                "file": (file_rows, touched),
                "symbol": (numbered, old["symbol"].join(of_files, "file_id", "left_semi").select("id", "file_id")),
                "reference": (fresh_refs, of_files),
                "edge": (added, old["edge"].select("id", "evidence_file_id").join(kept.select("id"), "id", "left_anti")),
            }
            more["parts"] = more.get("parts", {}) | parts
            self.store.commit(None, repo_id, base=state, numbered=True, **more)
        return self._indexed(root, remote_url, outcomes, status, warnings)

    def _indexed(self, root: str, remote_url: str | None, outcomes: dict[str, int], status: str, warnings: list[str]) -> IndexResult:
        self._repo(root, remote_url=remote_url, indexed_sha=found.current_sha(root), indexed_at=datetime.now(UTC).replace(tzinfo=None, microsecond=0), scip_status=status)
        unchanged = outcomes.get("unchanged", 0)
        return IndexResult(outcomes.get("parsed", 0) + unchanged, outcomes.get("skipped", 0), *self.counts(root), status, warnings, unchanged)

    def changes(self, root: str, files: DataFrame) -> DataFrame:
        """What a re-index of files (path, content) would find added, changed, unchanged and deleted."""
        current = files.select("path", F.sha2("content", 256).alias("blob_sha"))
        return incremental.file_changes(self._mine(root, "file"), current)

    # -- ask

    def _repo_id(self, root: str, state: dict) -> int | None:
        found_ = self.store.table("repo", state=state).where(F.col("root_path") == root).select("id").first()
        return found_ and found_[0]

    def _mine(self, root: str, name: str) -> DataFrame:
        state = self.store.pinned()
        repo_id = self._repo_id(root, state)
        if repo_id is None:
            raise KeyError(f"{root} is not indexed")
        return self.store.table(name, repo_id, state)

    def symbols(self, root: str) -> DataFrame:
        return self._mine(root, "symbol")

    def edges(self, root: str) -> DataFrame:
        return self._mine(root, "edge")

    def files(self, root: str) -> DataFrame:
        return self._mine(root, "file")

    def find_symbol(self, root: str, qualified_name: str) -> DataFrame:
        """The symbol of a name, with the lowest id if several have it."""
        return self.symbols(root).where(F.col("qualified_name") == qualified_name).orderBy("id").limit(1)

    def chunks(self, root: str, files: DataFrame) -> DataFrame:
        """Chunks of files (path, content) with the ids of their symbols and files here."""
        named = self.symbols(root).groupBy("file_id", "qualified_name").agg(F.max("id").alias("symbol_id"))
        cut = chunk_source.chunks(files).join(self.files(root).select("path", F.col("id").alias("file_id"), "repo_id"), "path")
        return cut.join(named, ["file_id", "qualified_name"], "left").select("repo_id", "file_id", "symbol_id", "start_line", "end_line", "text", "n_tokens")

    def list_files(self, root: str, limit: int = traverse.DEFAULT_LIMIT) -> DataFrame:
        return report.first_files(self.files(root), limit)

    def list_symbols(self, root: str, file_id: int | None = None, limit: int = traverse.DEFAULT_LIMIT) -> DataFrame:
        return report.first_symbols(self.symbols(root), file_id, limit)

    def refs(self, root: str, address: str, depth: int = 1, tiers: list[str] | None = None) -> DataFrame | None:
        """What depends on the symbol at a qualified name or `file:line`; None if there is none."""
        bad = [t for t in tiers or () if t not in TIERS]
        if bad:
            raise ValueError(f"unknown tier {bad[0]!r}; one of {', '.join(TIERS)}")
        return traverse.find_references(self.symbols(root), self.files(root), self.edges(root), address, depth, tiers)

    def impact_of(self, root: str, changed: DataFrame, depth: int = impact.DEFAULT_DEPTH) -> DataFrame:
        """changed: (path, first_line, last_line)."""
        files = self.files(root)
        lines = changed.join(files.select("path", F.col("id").alias("file_id")), "path")
        return impact.impact(self.edges(root), impact.changed_symbols(lines, self.symbols(root)), self.symbols(root), files, depth)

    def subgraph(self, root: str, address: str, radius: int = 2, budget: int = 40) -> DataFrame | None:
        symbol = traverse.resolve_address(self.symbols(root), self.files(root), address)
        return None if symbol is None else traverse.subgraph(self.edges(root), symbol, radius, budget)

    def drawing(self, root: str, address: str, radius: int = 2, budget: int = 40, form: str = "mermaid") -> str | None:
        """The subgraph around an address as Mermaid, or as JSON with what is beyond the budget clustered by file."""
        symbol = traverse.resolve_address(self.symbols(root), self.files(root), address)
        if symbol is None:
            return None
        nodes = traverse.subgraph(self.edges(root), symbol, radius, budget)
        if form == "json":
            return traverse.graph_json(traverse.subgraph_edges(self.edges(root), nodes, self.symbols(root), symbol)).first()["text"]
        shown = nodes.where("kept").select("symbol_id").unionByName(self.spark.createDataFrame([(symbol,)], "symbol_id long"))
        return traverse.mermaid(self.edges(root), self.symbols(root).join(shown.withColumnRenamed("symbol_id", "id"), "id", "left_semi")).first()["text"]

    def search(self, root: str, text: str, k: int = 10, *, language: str | None = None, path_prefix: str | None = None, kind: str | None = None) -> DataFrame:
        """Symbols whose name, signature or docstring match best, of a language, below a path, of a kind."""
        own = retrieve.search_filter(self.symbols(root), self.files(root), language=language, path_prefix=path_prefix, kind=kind)
        own = own.withColumn("__text", F.concat_ws(" ", F.translate("qualified_name", "._", "  "), "signature", "docstring"))
        hits = retrieve.bm25(own, self.spark.createDataFrame([(0, text)], "query_id int, query string"), "id", "__text", k)
        return hits.join(own.drop("__text"), "id").orderBy("rank")

    def _numbered_chunks(self, root: str, files: DataFrame) -> DataFrame:
        cut = self.chunks(root, files)
        return cut.withColumn("chunk_id", F.concat_ws(":", "file_id", "start_line"))

    def context(self, root: str, files: DataFrame, question: str, k: int = 10, hops: int = 2, budget: int = 8000) -> DataFrame:
        """Chunks of files (path, content) to show for a question: the best by words, then what their symbols' edges lead to, within a budget of tokens."""
        cut = self._numbered_chunks(root, files)
        asked = self.spark.createDataFrame([(0, question)], "query_id int, query string")
        shown = retrieve.hybrid(cut.select("chunk_id", "symbol_id", "text", "n_tokens"), asked, self.edges(root), k, hops, budget)
        return shown.join(cut.select("chunk_id", "file_id", "start_line", "end_line", "text"), "chunk_id").orderBy("rank")

    def duplicates(self, root: str, files: DataFrame, threshold: float = 0.8) -> DataFrame:
        """(a, b, similarity): chunks of different files (path, content) that say nearly the same, copies by one of them."""
        cut = self._numbered_chunks(root, files)
        pairs, of = retrieve.duplicate_chunks(cut, "chunk_id", "text", threshold)
        copies = of.where("chunk_id != representative").select(F.col("representative").alias("a"), F.col("chunk_id").alias("b"), F.lit(1.0).alias("similarity"))
        file_of = lambda c: F.substring_index(c, ":", 1)
        return pairs.unionByName(copies).where(file_of(F.col("a")) != file_of(F.col("b")))

    def tests_of(self, root: str, address: str) -> DataFrame | None:
        """Symbols in test files that use the symbol at an address."""
        symbol = traverse.resolve_address(self.symbols(root), self.files(root), address)
        if symbol is None:
            return None
        used = impact.test_edges(self.edges(root).where(F.col("dst_symbol_id") == symbol), self.symbols(root), self.files(root))
        return traverse.enrich(used, self.symbols(root), self.files(root))

    # -- report

    def counts(self, root: str) -> tuple[dict[str, int], dict[str, int]]:
        symbols, edges = report.symbol_counts(self.symbols(root)).collect(), report.edge_counts(self.edges(root)).collect()
        return {r["kind"]: r["n"] for r in symbols}, {r["tier"]: r["n"] for r in edges}

    def status(self, root: str) -> Status:
        self._mine(root, "file")
        repo = self.store.table("repo").where(F.col("root_path") == root).first()
        run = report.latest_runs(self.store.table("index_run").where(F.col("repo_id") == repo["id"])).first()
        now = found.current_sha(root)
        behind = found.commits_behind(root, repo["indexed_sha"], now) if repo["indexed_sha"] and now else None
        drift = report.drift(repo["indexed_sha"], now, behind)
        return Status(root, repo["indexed_sha"], now, *drift, repo["scip_status"], *self.counts(root), run and run["status"], run and run["duration_seconds"], self.store.size_bytes())

    def listing(self) -> DataFrame:
        """All repositories of the store with their last run."""
        runs = report.latest_runs(self.store.table("index_run")).select(F.col("repo_id").alias("id"), "status", "duration_seconds")
        return self.store.table("repo").join(runs, "id", "left").orderBy("root_path")

    def remove(self, root: str) -> bool:
        """Forget a repository; its sources are never touched. False if it is not indexed."""
        repo = self.store.table("repo").where(F.col("root_path") == root).first()
        if repo is None:
            return False
        self.store.commit(gone=(repo["id"],))
        return True


