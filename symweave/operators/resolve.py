"""Resolution of raw references to symbols: the names that its rules ask for, looked up in one join.

References have file_id, ref_seq (order of emission in the file), kind, src_qualified_name,
target_text and evidence_line; symbols have id, file_id, kind and qualified_name. Each rule
asks for one or more names, with its place in the order of rules, and the first that is found
decides a reference. An ambiguity gives no candidate and no edge.

Symbols are aggregated by name before references are joined, so a name that very many symbols
share costs one row. What all rules ask for is shuffled once by name, and what is found once by
reference, in so many parts that one fits a task at any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import last_segment
from ..shared import tidy, written
from .intervals import around

# Which kinds a reference of a kind may point to; others may point to any. Class kinds are callable too.
CALLABLE_KINDS, CLASS_KINDS = ("function", "method", "class"), ("class",)
#: Places of the rules; ancestor scopes take SCOPE and the following.
SELF, EXACT, SCOPE, IMPORT, UNIQUE = RULES = 0, 1, 2, 100_000, 200_000
#: What is looked up besides: classes around a `self.x` call, x in each scope, and the source of an edge.
_OWNER, _MEMBER, _SOURCE = -3, -2, -1
#: Where a name is looked up: qualified names, last segments, and what a file imports.
_NAMES, _BARES, _IMPORTED = 0, 1, 2
_KEY, _PLACE = ["file_id", "ref_seq"], ["space", "of", "name"]
#: References whose lookups, some ten for one, meet in one task, about, and names that are held there.
TASK_REFS, TASK_NAMES = 150_000, 500_000
#: Up to so many of such tasks the parts that Spark makes hold no more than fits one either, and are fewer.
FEW_TASKS = 32
#: Rows of a file of names or references, at most, so that tasks can share them out.
TABLE_ROWS = 500_000


def _grade(symbol_kind: Column) -> Column:
    """2 for a class, 1 for what else can be called, 0 for others."""
    return F.when(symbol_kind.isin(*CLASS_KINDS), 2).when(symbol_kind.isin(*CALLABLE_KINDS), 1).otherwise(0)


def _of_kind(ref_kind: Column, callable_: Column, class_: Column, any_: Column) -> Column:
    return F.when(ref_kind == "calls", callable_).when(ref_kind == "inherits", class_).otherwise(any_)


def by_qualified_name(symbols: DataFrame) -> DataFrame:
    """(name, dst, dst_kind): of several symbols with one name the last counts."""
    last = symbols.groupBy("qualified_name").agg(F.max(F.struct("id", "kind")).alias("s"))
    return last.select(F.col("qualified_name").alias("name"), F.col("s.id").alias("dst"), F.col("s.kind").alias("dst_kind"))


def _dealt(df: DataFrame, parts: int, keys: list[str]) -> DataFrame:
    return df.repartition(parts, *keys) if parts > FEW_TASKS else df


def _named(symbols: DataFrame) -> DataFrame:
    """(space, of, name, dst, grade, one_any, one_callable, one_class) for each qualified name and each last segment.

    dst is the last symbol of that name; the others are the only one of their kinds, or null.
    """
    places = F.array(*[F.struct(F.lit(space).alias("space"), name.alias("name")) for space, name in ((_NAMES, F.col("qualified_name")), (_BARES, last_segment(F.col("qualified_name"))))])
    rows = symbols.select("id", _grade(F.col("kind")).alias("grade"), F.inline(places)).where("name IS NOT NULL")
    only = {"one_any": F.col("id"), "one_callable": F.when(F.col("grade") >= 1, F.col("id")), "one_class": F.when(F.col("grade") == 2, F.col("id"))}
    counts = [f(x).alias(f"{n}_{c}") for c, x in only.items() for n, f in (("n", F.count), ("id", F.min))]
    # dealt first: a map of names before the shuffle would combine next to nothing and grow with a task's share of the symbols
    parts = 2 * symbols.count() // TASK_NAMES + 1
    met = _dealt(rows, parts, ["space", "name"]).groupBy("space", "name").agg(F.max("id").alias("dst"), F.max_by("grade", "id").alias("grade"), *counts)
    return met.select("space", F.lit(0).cast("long").alias("of"), "name", "dst", "grade", *[F.when(F.col(f"n_{c}") == 1, F.col(f"id_{c}")).alias(c) for c in only])


def _imported(refs: DataFrame, named: DataFrame) -> DataFrame:
    """Rows as those of _named() for what a file imports by its last segment: the first that names a symbol, of whatever kind."""
    names = named.where(F.col("space") == _NAMES).select(F.col("name").alias("target_text"), "dst", "grade")
    hits = refs.where("kind = 'imports'").select(*_KEY, "target_text").join(names, "target_text")
    first = hits.groupBy("file_id", last_segment(F.col("target_text")).alias("name")).agg(F.min_by(F.struct("dst", "grade"), "ref_seq").alias("s"))
    nil = F.lit(None).cast("long")
    return first.select(F.lit(_IMPORTED).alias("space"), F.col("file_id").cast("long").alias("of"), "name", "s.dst", "s.grade", *[nil.alias(c) for c in ("one_any", "one_callable", "one_class")])


def _lookups(refs: DataFrame, rules: tuple[int, ...]) -> DataFrame:
    """(file_id, ref_seq, kind, evidence_line, rule, up, space, of, name): each name that a rule asks for; up counts the scopes from the source's own."""
    kind, target, src, zero = F.col("kind"), F.col("target_text"), F.col("src_qualified_name"), F.lit(0)
    bare = ~target.contains(".") & (kind != "imports")
    of_self = (kind == "calls") & target.rlike(r"^(self|cls)\.[^.]+$")
    around_ = (bare & F.lit(SCOPE in rules)) | (of_self & F.lit(SELF in rules))
    scopes = F.when(around_ & src.isNotNull(), F.length(src) - F.length(F.replace(src, F.lit("."), F.lit(""))) + 1).otherwise(0)
    # step 0 asks for names as they are, step 1 in the scope of the source, and so on outwards
    each = refs.select("*", scopes.alias("scopes")).select("*", F.explode(F.sequence(zero, F.col("scopes"))).alias("step"))
    each = each.withColumn("scope", F.call_function("substring_index", src, F.lit("."), F.col("scopes") - F.col("step") + 1))
    member = F.concat("scope", F.lit("."), last_segment(target))

    def ask(rule: int, name: Column, space: int = _NAMES, of: Column = zero) -> Column:
        return F.struct(F.lit(rule).alias("rule"), F.lit(space).alias("space"), of.cast("long").alias("of"), name.alias("name"))

    plain = {EXACT: ask(EXACT, target), _SOURCE: ask(_SOURCE, src), IMPORT: ask(IMPORT, F.when(bare, target), _IMPORTED, F.col("file_id")), UNIQUE: ask(UNIQUE, F.when(bare, target), _BARES)}
    first = F.array(*[x for rule, x in plain.items() if rule in rules])
    asked = F.when(bare, F.array(ask(SCOPE, member))).otherwise(F.array(ask(_OWNER, F.col("scope")), ask(_MEMBER, member)))
    asked = F.when(F.col("step") == 0, first).otherwise(asked) if len(set(rules) & set(plain)) else F.when(F.col("step") > 0, asked)
    return each.select(*_KEY, "kind", "evidence_line", (F.col("step") - 1).alias("up"), F.inline(asked)).where("name IS NOT NULL")


def _decided(symbols: DataFrame, refs: DataFrame, rules: tuple[int, ...]) -> DataFrame:
    """What was found for each reference that has a target, with its deciding place and dst as c; kind and evidence_line are set in rows of the source."""
    refs = refs.where(F.col("kind").isin("calls", "inherits", "references", "imports"))
    named = written(_named(symbols), "names", TABLE_ROWS)
    parts = refs.count() // TASK_REFS + named.count() // TASK_NAMES + 1
    known = named.unionByName(_imported(refs, named)) if IMPORT in rules else named
    rule, kind, dst, grade = F.col("rule"), F.col("kind"), F.col("dst"), F.col("grade")
    fits = _of_kind(kind, grade >= 1, grade == 2, F.lit(True))
    found = (
        F.when(rule == UNIQUE, _of_kind(kind, F.col("one_callable"), F.col("one_class"), F.col("one_any")))
        .when(rule == _OWNER, F.when(grade == 2, dst))
        .when(rule.isin(_MEMBER, _SOURCE) | fits, dst)
    )
    # a name is one row, so a task holds its few and what is asked streams past them, without a sort
    asked = _dealt(_lookups(refs, rules), parts, _PLACE).join(_dealt(known, parts, _PLACE).hint("shuffle_hash"), _PLACE)
    of_source = [F.when(rule == _SOURCE, F.col(c)).alias(c) for c in ("kind", "evidence_line")]
    hits = asked.select(*_KEY, "rule", "up", found.alias("dst"), *of_source).where("dst IS NOT NULL")
    place = F.when(rule == SCOPE, rule + F.col("up")).otherwise(rule).alias("place")
    # a window and no lists, as several references may share a key: each sees what is found for all of them
    of_ref = Window.partitionBy(*reversed(_KEY))
    hits = _dealt(hits, parts, _KEY).withColumns({
        "c": F.min(F.when(rule > SELF, F.struct(place, "dst"))).over(of_ref),
        "owner": F.min(F.when(rule == _OWNER, F.col("up"))).over(of_ref),
    })
    # x of the nearest class around the source, and of no other
    own = F.min(F.when((rule == _MEMBER) & (F.col("up") == F.col("owner")), F.struct(F.lit(SELF).alias("place"), "dst"))).over(of_ref)
    return hits.withColumn("c", F.coalesce(own, "c")).where("c IS NOT NULL")


@tidy
def resolved_targets(symbols: DataFrame, refs: DataFrame, rules: tuple[int, ...] = RULES) -> DataFrame:
    """(file_id, ref_seq, place, dst): the deciding candidate of each reference that has one.

    SELF: a `self.x` or `cls.x` call means x of the nearest class around the source. EXACT: the target is a qualified
    name. SCOPE: a bare target in the scope of the source or the nearest one around it. IMPORT: a bare target among the
    file's imports, by the first that ends in it. UNIQUE: a bare target that one symbol of the allowed kinds ends in.
    """
    return _decided(symbols, refs, rules).select(*_KEY, "c.place", "c.dst").distinct()


@tidy
def heuristic_edges(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """(file_id, ref_seq, src_symbol_id, dst_symbol_id, kind, tier, evidence_file_id, evidence_line), self edges dropped."""
    hits = _decided(symbols, refs, (*RULES, _SOURCE)).where((F.col("rule") == _SOURCE) & F.col("file_id").isNotNull() & F.col("ref_seq").isNotNull())
    hits = hits.withColumns({"src_symbol_id": F.col("dst"), "dst_symbol_id": F.col("c.dst")})
    return hits.where("dst_symbol_id != src_symbol_id").select(
        *_KEY, "src_symbol_id", "dst_symbol_id", "kind", F.lit("heuristic").alias("tier"), F.col("file_id").alias("evidence_file_id"), "evidence_line"
    )


def defines_edges(symbols: DataFrame, parents: DataFrame) -> DataFrame:
    """Parent to child inside one file; of several parents with one name the last counts.

    parents: (id, parent_qualified_name) of the symbols. Evidence is the child's first line.
    """
    last = symbols.groupBy("file_id", F.col("qualified_name").alias("parent_qualified_name")).agg(F.max("id").alias("src_symbol_id"))
    children = symbols.join(parents, "id").where(F.col("parent_qualified_name").isNotNull())
    hits = children.join(last, ["file_id", "parent_qualified_name"]).where("id != src_symbol_id")
    return hits.select(
        "src_symbol_id", F.col("id").alias("dst_symbol_id"), F.lit("defines").alias("kind"), F.lit("heuristic").alias("tier"),
        F.col("file_id").alias("evidence_file_id"), F.col("start_line").alias("evidence_line"),
    )


def unambiguous(occurrences: DataFrame) -> DataFrame:
    """(path, line0, is_definition, symbol): lines where one symbol only is defined, or referred to."""
    usable = occurrences.where((F.col("symbol") != "") & F.col("line0").isNotNull()).withColumn("path", F.replace("path", F.lit("\\"), F.lit("/")))
    sets = usable.groupBy("path", "line0", "is_definition").agg(F.min("symbol").alias("symbol"), F.max("symbol").alias("last"))
    return sets.where("symbol = last").drop("last")


def innermost(probes: DataFrame, symbols: DataFrame, keep: list[str]) -> DataFrame:
    """probes (file_id, line and the columns `keep`) with symbol_id, the narrowest span around the line; ties to the lowest id."""
    spans = symbols.select(F.col("id").alias("symbol_id"), "file_id", "start_line", "end_line")
    keys = list(dict.fromkeys(["file_id", "line", *keep]))
    hits = around(probes.select(*keys), spans, ["file_id"], "line", "start_line", "end_line")
    best = F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("w"), "symbol_id"))
    return hits.groupBy(*keys).agg(best.alias("s")).select(*keys, F.col("s.symbol_id").alias("symbol_id"))


def scip_definitions(occurrences: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol_id, scip_symbol) of every definition inside a file that is indexed."""
    defs = unambiguous(occurrences).where("is_definition").join(files.select("path", F.col("id").alias("file_id")), "path")
    probes = defs.select("file_id", (F.col("line0") + 1).alias("line"), F.col("symbol").alias("scip_symbol"))
    return innermost(probes, symbols, ["scip_symbol"]).select("symbol_id", "scip_symbol", "file_id", "line")


def scip_edges(symbols: DataFrame, refs: DataFrame, occurrences: DataFrame, files: DataFrame) -> DataFrame:
    """Resolved-tier edges: the symbol that an index names on a reference's line, of whatever kind."""
    ours = scip_definitions(occurrences, files, symbols).groupBy("scip_symbol").agg(F.max_by("symbol_id", F.struct("file_id", "line")).alias("dst_symbol_id"))
    named = unambiguous(occurrences).where("NOT is_definition").join(files.select("path", F.col("id").alias("file_id")), "path")
    lines = named.select("file_id", (F.col("line0") + 1).alias("evidence_line"), F.col("symbol").alias("scip_symbol"))
    sources = by_qualified_name(symbols).select(F.col("name").alias("src_qualified_name"), F.col("dst").alias("src_symbol_id"))
    hits = refs.join(lines, ["file_id", "evidence_line"]).join(ours, "scip_symbol").join(sources, "src_qualified_name")
    return hits.where("dst_symbol_id != src_symbol_id").select(
        *_KEY, "src_symbol_id", "dst_symbol_id", "kind", F.lit("resolved").alias("tier"), F.col("file_id").alias("evidence_file_id"), "evidence_line"
    )
