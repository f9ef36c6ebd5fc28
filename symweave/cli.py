"""Command line: index, refs, search, impact, graph, list, status, remove."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .engine import Engine, Status
from .functions.text import byte_size
from .operators.impact import DEFAULT_DEPTH
from .schemas import TIERS
from .sources.discover import clone
from .sources.registry import Locked, Workspace, normalized

DEFAULT_WORKSPACE = "~/.symweave"


def _counts(counts: dict[str, int], zeros: bool = True) -> str:
    return ", ".join(f"{k}={v}" for k, v in counts.items() if v or zeros)


def _size(spark: SparkSession, size: int) -> str:
    return spark.range(1).select(byte_size(F.lit(size))).first()[0]


def _fail(text: str) -> int:
    print(f"error: {text}", file=sys.stderr)
    return 1


def _shown(value: object) -> object:
    return value.isoformat() if hasattr(value, "isoformat") else str(value)


def _json(value: object) -> int:
    print(json.dumps(value, default=_shown, ensure_ascii=False))
    return 0


def _drift(s: Status) -> str:
    """A status line of an index and its working copy."""
    behind = "one commit" if s.behind == 1 else f"{s.behind} commits"
    return {
        "untracked": "indexed outside of git", "detached": f"{s.indexed_sha}; git knows this folder no more", "current": f"{s.indexed_sha}, current",
        "behind": f"{s.indexed_sha}; {s.current_sha} is {behind} ahead", "diverged": f"{s.indexed_sha}; not an ancestor of {s.current_sha}",
    }[s.drift]


def _index(args: argparse.Namespace, spark: SparkSession, space: Workspace, root: str, store: str) -> int:
    if not Path(root).is_dir():
        return _fail(f"{root} is not a folder")
    try:
        with space.lock(root):
            space.register(root)
            done = Engine(spark, store).index(root, use_scip=not args.no_scip, force=args.force, remote_url=args.url)
    except Locked as e:
        return _fail(str(e))
    if args.json:
        return _json(asdict(done))
    if args.url:
        print(f"{args.url} is at {root}")
    print(f"{done.files_indexed} files indexed, {done.files_skipped} skipped\nsymbols: {_counts(done.symbols, False)}\nedges: {_counts(done.edges)}\nscip: {done.scip_status}")
    if done.files_unchanged:
        print(f"{done.files_unchanged} of the files were as they had been")
    for w in done.warnings:
        print(f"warning: {w}", file=sys.stderr)
    return 0


def _status(args: argparse.Namespace, spark: SparkSession, space: Workspace, engine: Engine, root: str) -> int:
    s = engine.status(root)
    if args.json:
        return _json(asdict(s))
    print(f"{s.root_path}\n  commit:   {_drift(s)}\n  scip:     {s.scip_status or 'n/a'}\n  symbols:  {_counts(s.symbols, False)}\n  edges:    {_counts(s.edges)}")
    seconds = "unknown" if s.last_run_seconds is None else f"{s.last_run_seconds:.2f}s"
    print(f"  last run: {s.last_run_status}, {seconds}\n  size:     {_size(spark, space.size(root))}")
    if s.scip_status == "degraded":
        print("  warning: the index has no resolved edges, as SCIP was not available")
    return 0


def _refs(args: argparse.Namespace, engine: Engine, root: str) -> int:
    bad = [t for t in args.tier or () if t not in TIERS]
    if bad:
        return _fail(f"unknown tier {bad[0]!r}; one of {', '.join(TIERS)}")
    hits = engine.refs(root, args.symbol, args.depth, args.tier)
    if hits is None:
        return _fail(f"no symbol {args.symbol!r}")
    rows = hits.collect()
    if args.json:
        return _json([r.asDict() for r in rows])
    for tier in TIERS:
        own = [r for r in rows if r["tier"] == tier]
        if own:
            print(f"{tier} ({len(own)})")
        for r in own:
            where = f"{r['evidence_path']}:{r['evidence_line']}" if r["evidence_path"] else "?"
            print(f"  {r['depth']}  {r['qualified_name']}  {r['kind']}  {where}")
    if not rows:
        print("nothing depends on it")
    return 0


def _search(args: argparse.Namespace, engine: Engine, root: str) -> int:
    rows = engine.search(root, args.text, args.limit, language=args.language, path_prefix=args.below, kind=args.kind).collect()
    if args.json:
        return _json([r.asDict() for r in rows])
    for r in rows:
        print(f"{r['score']:.3f}  {r['kind']}  {r['qualified_name']}")
    return 0


def _impact(args: argparse.Namespace, spark: SparkSession, engine: Engine, root: str) -> int:
    """Of what changed since the commit that was indexed, or of given `file:first-last` stretches."""
    stretches = []
    for given in args.changed:
        path, _, lines = given.rpartition(":")
        first, _, last = lines.partition("-")
        if not path or not first.isdigit() or last and not last.isdigit():
            return _fail(f"{given!r} is not file:line or file:first-last")
        stretches.append((path, int(first), int(last or first)))
    changed = spark.createDataFrame(stretches, "path string, first_line int, last_line int")
    names = engine.symbols(root).select(F.col("id").alias("symbol_id"), "qualified_name")
    rows = engine.impact_of(root, changed, args.depth).join(names, "symbol_id").orderBy("certainty", "depth", "qualified_name").collect()
    if args.json:
        return _json([r.asDict() for r in rows])
    for r in rows:
        print(f"{r['certainty']}  {r['depth']}  {r['qualified_name']}{'  (test)' if r['is_test'] else ''}")
    if not rows:
        print("nothing depends on it")
    return 0


def run(args: argparse.Namespace, spark: SparkSession) -> int:
    space = Workspace(args.workspace)
    if args.command == "list":
        rows = space.listing()
        if args.json:
            return _json(rows)
        for r in rows:
            state = "" if r["exists"] else "  (no index)"
            print(f"{r['root_path']}  {_size(spark, r['size_bytes'])}{state}")
        print(f"{len(rows)} repositories, {_size(spark, sum(r['size_bytes'] for r in rows))}")
        return 0
    given, args.url = getattr(args, "path", "."), None
    if args.command == "index" and ("://" in given or given.startswith("git@")):
        args.url = given
        try:
            given = clone(given, str(space.repo_dir(given) / "clone" / (given.rstrip("/").rpartition("/")[2].removesuffix(".git") or "project")))
        except ValueError as e:
            return _fail(str(e))
    root = normalized(given)
    if args.command == "remove":
        return 0 if space.remove(root) else _fail(f"{root} is not indexed")
    store = str(space.repo_dir(root) / "store")
    if args.command == "index":
        return _index(args, spark, space, root, store)
    if not Path(store).exists():
        return _fail(f"{root} is not indexed yet; run index first")
    engine = Engine(spark, store)
    if args.command == "status":
        return _status(args, spark, space, engine, root)
    if args.command == "refs":
        return _refs(args, engine, root)
    if args.command == "search":
        return _search(args, engine, root)
    if args.command == "impact":
        return _impact(args, spark, engine, root)
    text = engine.drawing(root, args.symbol, args.radius, args.budget, "json" if args.json else "mermaid")
    if text is None:
        return _fail(f"no symbol {args.symbol!r}")
    print(text)
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="symweave")
    parser.add_argument("--workspace", default=DEFAULT_WORKSPACE)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("index", "status", "remove"):
        commands.add_parser(name).add_argument("path", nargs="?", default=".")
    commands.choices["index"].add_argument("--no-scip", action="store_true")
    commands.choices["index"].add_argument("--force", action="store_true", help="parse files again that are as they were")
    commands.add_parser("list")
    refs = commands.add_parser("refs")
    refs.add_argument("symbol")
    refs.add_argument("--depth", type=int, default=1)
    refs.add_argument("--tier", action="append")
    search = commands.add_parser("search")
    search.add_argument("text")
    for name in ("--language", "--below", "--kind"):
        search.add_argument(name)
    search.add_argument("--limit", type=int, default=10)
    impact = commands.add_parser("impact")
    impact.add_argument("changed", nargs="+", metavar="file:first-last")
    impact.add_argument("--depth", type=int, default=DEFAULT_DEPTH)
    graph = commands.add_parser("graph")
    graph.add_argument("symbol")
    graph.add_argument("--radius", type=int, default=2)
    graph.add_argument("--budget", type=int, default=40)
    for command in commands.choices.values():
        command.add_argument("--json", action="store_true")
    args = parser.parse_args(argv)
    return run(args, spark or SparkSession.builder.appName("symweave").config("spark.sql.session.timeZone", "UTC").getOrCreate())


if __name__ == "__main__":
    sys.exit(main())
