"""Traversal of the typed, tiered edge table.

Edges have id, src_symbol_id, dst_symbol_id, kind and tier. A traversal runs level by level:
each hop is one scan of the edges with pushed-down kind and tier filters. The frontier and
what has been visited are joined by broadcast while their counted rows are within BROADCAST_ROWS,
and as plain joins beyond that.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..shared import tidy, written
from .store import numbered

MAX_DEPTH, DEFAULT_LIMIT = 4, 1000
#: Ids that a broadcast may hold, about 16 bytes each.
BROADCAST_ROWS = 1_000_000


def clamp_depth(depth: int) -> int:
    return max(1, min(depth, MAX_DEPTH))


def edge_filter(kind: str | None = None, tiers: list[str] | tuple[str, ...] | None = None) -> Column:
    """No kind and no or empty tiers filter nothing."""
    wanted = F.lit(True)
    if kind is not None:
        wanted = wanted & (F.col("kind") == kind)
    if tiers:
        wanted = wanted & F.col("tier").isin(*tiers)
    return wanted


def edges_from(edges: DataFrame, symbol_id: int, kind: str | None = None, tiers=None, limit: int = DEFAULT_LIMIT) -> DataFrame:
    return edges.where((F.col("src_symbol_id") == symbol_id) & edge_filter(kind, tiers)).orderBy("id").limit(limit)


def edges_to(edges: DataFrame, symbol_id: int, kind: str | None = None, tiers=None, limit: int = DEFAULT_LIMIT) -> DataFrame:
    return edges.where((F.col("dst_symbol_id") == symbol_id) & edge_filter(kind, tiers)).orderBy("id").limit(limit)


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def reach(edges: DataFrame, seeds: DataFrame, depth: int, tiers=None, *, forward: bool = False, collapse: tuple[str, ...] = ("kind",)) -> DataFrame:
    """What is reachable from each seed, with the shortest depth only.

    seeds: (seed_id, symbol_id). Against the direction of edges unless forward. Returns, for
    each seed, reached symbol and value of `collapse`, the edge with the lowest id by which the
    symbol is reached at its depth: (seed_id, symbol_id, depth, and the columns of that edge).
    A seed's own start symbols are never listed; cycles end because nothing is reached twice.
    """
    near, far = ("src_symbol_id", "dst_symbol_id") if forward else ("dst_symbol_id", "src_symbol_id")
    used = edges.where(edge_filter(None, tiers))
    columns = [c for c in edges.columns]
    frontier = seeds.select("seed_id", "symbol_id").distinct().persist()
    held, rows = [frontier], frontier.count()
    total, visited, levels = rows, frontier, []
    for d in range(1, depth + 1):
        if not rows:
            break
        hop = used.join(_sized(frontier.withColumnRenamed("symbol_id", near), rows), near)
        new = hop.join(_sized(visited.withColumnRenamed("symbol_id", far), total), ["seed_id", far], "left_anti")
        found = (
            new.groupBy("seed_id", F.col(far).alias("symbol_id"), *[F.col(c).alias(f"__{c}") for c in collapse])
            .agg(F.min_by(F.struct(*columns), F.col("id")).alias("edge"))
            .select("seed_id", "symbol_id", F.lit(d).alias("depth"), "edge.*")
        )
        if d < depth:
            found = found.persist()
            frontier = found.select("seed_id", "symbol_id").distinct().persist()
            held += [found, frontier]
            rows = frontier.count()
            total += rows
            visited = visited.unionByName(frontier)
        levels.append(found)
    if not levels:
        out = used.limit(0).select(F.lit(0).cast("long").alias("seed_id"), F.col(far).alias("symbol_id"), F.lit(0).alias("depth"), *columns)
    else:
        out = written(reduce(DataFrame.unionByName, levels), "reach")
    for df in held:
        df.unpersist()
    return out


#: Seeds that one word of bits stands for, and words that ids may take for one that numbered seeds take.
WORD, LOOSE = 64, 4


def _numbered_seeds(starts: DataFrame) -> DataFrame | None:
    """(seed_id, place) with small numbers; None if the ids lie so near each other that they can be their own places."""
    if isinstance(starts.schema["seed_id"].dataType, IntegralType):
        of = starts.select("seed_id").distinct().groupBy(F.shiftright(F.col("seed_id").cast("long"), 6).alias("word")).agg(F.count("*").alias("n"))
        words, n = of.agg(F.count("*"), F.sum("n")).first()
        if words <= LOOSE * -(-(n or 0) // WORD):
            return None
    return written(numbered(starts.select("seed_id").distinct(), ["seed_id"], -1, "place"), "places")


@tidy
def reach_sets(edges: DataFrame, seeds: DataFrame, depth: int, tiers=None, *, forward: bool = False) -> DataFrame:
    """(seed_id, symbol_id, depth): what is reachable from each of many seeds (seed_id, symbol_id), with the shortest depth.

    As reach(), without the edges, but for all seeds together: a bit stands for a seed, and a symbol's row
    carries a word of 64 of them. A level is one join of edges with the words of its frontier, and one
    grouped OR; bits that were there before go. So a level has at most symbols x words rows, however many
    seeds lead to each. Start symbols of a seed are not listed for it. Ids that lie near each other are their own places
    in the words, so that no row of the result is shuffled for its seed; the last level is left to the result.
    """
    near, far = ("src_symbol_id", "dst_symbol_id") if forward else ("dst_symbol_id", "src_symbol_id")
    used = edges.where(edge_filter(None, tiers)).select(F.col(near).alias("near"), F.col(far).alias("symbol_id"))
    starts = seeds.select("seed_id", "symbol_id").where("seed_id IS NOT NULL AND symbol_id IS NOT NULL")
    places = _numbered_seeds(starts)
    placed = starts.join(places, "seed_id") if places is not None else starts.withColumn("place", F.col("seed_id").cast("long"))
    words = lambda df: df.groupBy("symbol_id", "word").agg(F.bit_or("bits").alias("bits"))
    bit = F.expr(f"shiftleft(1L, CAST(place & {WORD - 1} AS INT))")
    frontier = written(words(placed.select("symbol_id", F.shiftright("place", 6).alias("word"), bit.alias("bits"))), "frontier")
    visited, levels, nil = frontier, [], F.lit(None).cast("long")
    for d in range(1, depth + 1):
        if frontier.isEmpty():
            break
        hop = used.join(frontier.withColumnRenamed("symbol_id", "near"), "near").select("symbol_id", "word", "bits", nil.alias("seen"))
        # what was there before is in words of their own, one for each level, and meets the new ones in the same grouping
        both = hop.unionByName(visited.select("symbol_id", "word", nil.alias("bits"), F.col("bits").alias("seen")))
        met = both.groupBy("symbol_id", "word").agg(F.bit_or("bits").alias("bits"), F.bit_or("seen").alias("seen"))
        new = met.select("symbol_id", "word", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("seen", F.lit(0).cast("long")))).alias("bits"))
        frontier = new.where("bits != 0")
        if d < depth:
            frontier = written(frontier, "frontier")
        levels.append(frontier.withColumn("depth", F.lit(d)))
        visited = visited.unionByName(frontier)
    rows = reduce(DataFrame.unionByName, levels) if levels else frontier.withColumn("depth", F.lit(0)).limit(0)
    each = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(WORD - 1)))).where("(shiftrightunsigned(bits, i) & 1) = 1")
    each = each.select((F.col("word") * WORD + F.col("i")).alias("place"), "symbol_id", "depth")
    if places is None:
        return each.select(F.col("place").cast(starts.schema["seed_id"].dataType).alias("seed_id"), "symbol_id", "depth")
    return each.join(places, "place").select("seed_id", "symbol_id", "depth")


def reverse_dependencies(edges: DataFrame, symbol_id: int, depth: int, tiers=None, collapse: tuple[str, ...] = ("kind",)) -> DataFrame:
    """Edges by which symbols depend on one, with depth; the depth is not clamped here.

    collapse: ("kind",) gives one edge for each source and kind; ("kind", "tier") keeps tiers apart.
    """
    seeds = edges.sparkSession.createDataFrame([(symbol_id, symbol_id)], "seed_id long, symbol_id long")
    return reach(edges, seeds, depth, tiers, collapse=collapse).drop("seed_id", "symbol_id")


def resolve_address(symbols: DataFrame, files: DataFrame, address: str) -> int | None:
    """The symbol at `file:line`, the innermost first, or else of that qualified name; lowest id."""
    path, _, line = address.rpartition(":")
    if path and line.isascii() and line.isdigit():
        at = files.where(F.col("path") == path).select(F.col("id").alias("file_id"))
        inside = symbols.join(F.broadcast(at), "file_id").where(F.lit(int(line)).between(F.col("start_line"), F.col("end_line")))
        found = inside.orderBy(F.col("end_line") - F.col("start_line"), "id").select("id").first()
        if found:
            return found[0]
    found = symbols.where(F.col("qualified_name") == address).agg(F.min("id")).first()
    return found[0]


def enrich(hits: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Source symbols and evidence paths of hits; a missing source drops the hit, a missing file does not."""
    sources = symbols.select(F.col("id").alias("src_symbol_id"), "qualified_name", F.col("kind").alias("symbol_kind"), F.col("file_id").alias("symbol_file_id"))
    paths = files.select(F.col("id").alias("evidence_file_id"), F.col("path").alias("evidence_path"))
    return hits.join(sources, "src_symbol_id").join(paths, "evidence_file_id", "left")


def find_references(symbols: DataFrame, files: DataFrame, edges: DataFrame, address: str, depth: int = 1, tiers=None, collapse: tuple[str, ...] = ("kind",)) -> DataFrame | None:
    """What depends on the symbol at an address, in reading order; None if there is no such symbol."""
    symbol_id = resolve_address(symbols, files, address)
    if symbol_id is None:
        return None
    hits = enrich(reverse_dependencies(edges, symbol_id, clamp_depth(depth), tiers, collapse), symbols, files)
    return hits.orderBy("depth", "tier", "qualified_name", "src_symbol_id", "kind")


def by_tier(hits: DataFrame) -> DataFrame:
    """hits, those of a tier one after the other and each tier's in reading order; a range sort, so no tier is gathered."""
    return hits.orderBy("tier", "depth", "qualified_name", "src_symbol_id", "kind")


def tier_counts(hits: DataFrame) -> DataFrame:
    """(tier, n, sources): hits of each tier, and different symbols among them."""
    return hits.groupBy("tier").agg(F.count("*").alias("n"), F.count_distinct("src_symbol_id").alias("sources"))


def subgraph(edges: DataFrame, symbol_id: int, radius: int, budget: int = 40, tiers=None) -> DataFrame:
    """(symbol_id, depth, direction, kept) around a symbol; the nearest `budget` symbols are kept.

    A symbol reachable both ways counts with its shorter depth; ties go to the lower id.
    """
    spark = edges.sparkSession
    seeds = spark.createDataFrame([(symbol_id, symbol_id)], "seed_id long, symbol_id long")
    both = [reach(edges, seeds, clamp_depth(radius), tiers, forward=f).select("symbol_id", "depth", F.lit(n).alias("direction")) for f, n in ((False, "in"), (True, "out"))]
    nodes = both[0].unionByName(both[1]).groupBy("symbol_id").agg(F.min(F.struct("depth", "direction")).alias("m")).select("symbol_id", "m.*")
    nearest = nodes.orderBy("depth", "symbol_id").limit(budget).select("symbol_id", F.lit(True).alias("kept"))
    return nodes.join(nearest, "symbol_id", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def overflow(nodes: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file_id, depth, n): the nodes of a subgraph() beyond its budget, as one cluster for each file, with its nearest depth."""
    rest = nodes.where("NOT kept").join(symbols.select(F.col("id").alias("symbol_id"), "file_id"), "symbol_id")
    return rest.groupBy("file_id").agg(F.min("depth").alias("depth"), F.count("*").alias("n"))


@tidy
def subgraph_edges(edges: DataFrame, nodes: DataFrame, symbols: DataFrame, centre: int) -> DataFrame:
    """(a, b, kind, n): edges inside a subgraph(), an end beyond the budget standing for its file's cluster.

    a and b are `s<symbol id>` for the centre and kept nodes and `f<file id>` for clusters; n counts edges.
    """
    spark = edges.sparkSession
    here = nodes.select("symbol_id", "kept").unionByName(spark.createDataFrame([(centre, True)], "symbol_id long, kept boolean"))
    label = here.join(symbols.select(F.col("id").alias("symbol_id"), "file_id"), "symbol_id")
    label = label.select("symbol_id", F.when(F.col("kept"), F.concat(F.lit("s"), "symbol_id")).otherwise(F.concat(F.lit("f"), "file_id")).alias("label"))
    # counted, as Spark takes a traversal's result for as large as the edges and would shuffle them all
    label = written(label, "labels")
    rows = label.count()
    a, b = (_sized(label.select(F.col("symbol_id").alias(c), F.col("label").alias(n)), rows) for c, n in (("src_symbol_id", "a"), ("dst_symbol_id", "b")))
    inside = edges.join(a, "src_symbol_id").join(b, "dst_symbol_id").where("a != b OR a LIKE 's%'")
    return inside.groupBy("a", "b", "kind").agg(F.count("*").alias("n"))


#: Lines of a drawing, at most; a larger one is an error, not cut.
MOST_DRAWN = 5000


def _few(df: DataFrame, what: str) -> DataFrame:
    if df.limit(MOST_DRAWN + 1).count() > MOST_DRAWN:
        raise ValueError(f"more than {MOST_DRAWN} {what} to draw; take a smaller radius or budget")
    return df


def mermaid(edges: DataFrame, names: DataFrame) -> DataFrame:
    """One row with a Mermaid text of the edges (src_symbol_id, dst_symbol_id, kind); names: (id, qualified_name)."""
    a, b = names.select(F.col("id").alias("src_symbol_id"), F.col("qualified_name").alias("a")), names.select(F.col("id").alias("dst_symbol_id"), F.col("qualified_name").alias("b"))
    line = F.format_string('  s%d["%s"] -->|%s| s%d["%s"]', "src_symbol_id", "a", "kind", "dst_symbol_id", "b")
    lines = _few(edges.join(a, "src_symbol_id").join(b, "dst_symbol_id").select(line.alias("line")).distinct(), "edges")
    return lines.agg(F.concat_ws("\n", F.lit("graph LR"), F.sort_array(F.collect_list("line"))).alias("text"))


def graph_json(edges: DataFrame) -> DataFrame:
    """One row with the edges of subgraph_edges() as JSON: nodes in order, and edges with kind and count."""
    few = _few(edges, "edges")
    nodes = few.select(F.explode(F.array("a", "b")).alias("x")).agg(F.sort_array(F.collect_set("x")).alias("nodes"))
    links = few.agg(F.sort_array(F.collect_list(F.struct("a", "b", "kind", "n"))).alias("edges"))
    return nodes.crossJoin(links).select(F.to_json(F.struct("nodes", "edges")).alias("text"))


def _apart(df: DataFrame) -> DataFrame:
    """df as a side of a join that is never broadcast: dozens of rounds would each send a table through the driver."""
    return df.hint("merge")


@tidy
def strongly_connected(edges: DataFrame, tiers=None) -> DataFrame:
    """(symbol_id, component) of all symbols that lie on a cycle of any length; the component is its highest id.

    Chains shrink first, see _shrunk(). Of what is left, the highest in a random order that reaches a symbol
    is spread along the edges, and against them among the symbols with one such; those that get one both
    ways are a component, and the rest starts anew. Then what shrank is laid out again, the last step
    first. Every step is a grouped maximum or a join of written tables.
    """
    all_ = edges.where(edge_filter(None, tiers)).select(F.col("src_symbol_id").alias("a"), F.col("dst_symbol_id").alias("b")).distinct()
    left, steps = written(all_.where("a != b"), "cycle-edges"), []
    found = left.select(F.col("a").alias("n"), F.col("b").alias("h")).limit(0)
    while True:
        left = _shrunk(left, steps)
        if left.isEmpty():
            break
        ahead = _spread(left)
        a, b = (_apart(ahead.select(F.col("n").alias(c), F.col("h").alias(f"h{c}"))) for c in "ab")
        same = written(left.join(a, "a").join(b, "b").where("ha = hb").select(F.col("b").alias("a"), F.col("a").alias("b")), "cycle-colours")
        one = written(ahead.join(_apart(_spread(same)), ["n", "h"]).select("n", "h"), "cycle-found")
        found = found.unionByName(one)
        left = written(left.join(_apart(one.select(F.col("n").alias("a"))), "a", "left_anti").join(_apart(one.select(F.col("n").alias("b"))), "b", "left_anti").select("a", "b"), "cycle-edges")
    for step in reversed(steps):
        # a symbol between p and p itself is a cycle of two, whatever else p lies on
        loops = step.where("p = q").select(F.col("p").alias("n"), F.col("p").alias("h")).distinct().join(_apart(found.select("n")), "n", "left_anti")
        found = found.unionByName(loops)
        p, q = (_apart(found.select(F.col("n").alias(c), F.col("h").alias(f"h{c}"))) for c in "pq")
        found = written(found.unionByName(step.join(p, "p").join(q, "q").where("hp = hq").select("n", F.col("hp").alias("h"))), "cycle-found")
    selves = all_.where("a = b").select(F.col("a").alias("n"), F.col("a").alias("h"))
    found = found.unionByName(selves.join(_apart(found.select("n")), "n", "left_anti"))
    highest = found.groupBy("h").agg(F.max("n").alias("component"))
    return found.join(_apart(highest), "h").select(F.col("n").alias("symbol_id"), "component")


def _shrunk(left: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """left (a, b) without the symbols that have no edge in or none out, and without those with one each.

    The latter are replaced by an edge from the symbol before to the one after: (n, p, q) goes to steps, and n
    lies on a cycle if p and q lie on one together. Of neighbours only the highest in a random order goes
    at a time, so a chain shrinks by a third a round, however long.
    """
    nil = F.lit(None).cast("long")
    while True:
        ends = left.select(F.col("a").alias("n"), nil.alias("p"), F.col("b").alias("q")).unionByName(left.select(F.col("b").alias("n"), F.col("a").alias("p"), nil.alias("q")))
        roles = ends.groupBy("n").agg(F.count("p").alias("ins"), F.count("q").alias("outs"), F.max("p").alias("p"), F.max("q").alias("q"))
        # another order each round: in one order the highest go first, and then one neighbour at a time
        order = F.struct(F.xxhash64("n", F.lit(len(steps))), F.col("n"))
        mid = roles.where("ins = 1 AND outs = 1").select("n", "p", "q", order.alias("o"))
        before, after = (_apart(mid.select(F.col("n").alias(c), F.col("o").alias(f"o{c}"))) for c in "pq")
        first = mid.join(before, "p", "left").join(after, "q", "left").where("(op IS NULL OR o > op) AND (oq IS NULL OR o > oq)")
        dead = roles.where("ins = 0 OR outs = 0").select("n", nil.alias("p"), nil.alias("q"))
        gone = written(first.select("n", "p", "q").unionByName(dead), "cycle-step")
        if gone.isEmpty():
            return left
        steps.append(gone.where("p IS NOT NULL"))
        kept = left.unionByName(gone.where("p != q").select(F.col("p").alias("a"), F.col("q").alias("b")))
        for end in "ab":
            kept = kept.join(_apart(gone.select(F.col("n").alias(end))), end, "left_anti")
        left = written(kept.select("a", "b").distinct(), "cycle-edges")


def _spread(edges: DataFrame) -> DataFrame:
    """(n, h) with h the highest that reaches n along the edges (a, b), in a random order; n itself if none is higher.

    A round takes the best of the symbols before, and of the one that was best so far what reaches that: the
    stretch that a symbol has seen grows by a factor a round, and not by one edge.
    """
    nodes = edges.select(F.col("a").alias("n")).union(edges.select(F.col("b").alias("n"))).distinct()
    high = written(nodes.select("n", F.struct(F.xxhash64("n").alias("x"), F.col("n").alias("h")).alias("g")), "highest")
    while True:
        along = edges.join(_apart(high.select(F.col("n").alias("a"), "g")), "a").select(F.col("b").alias("n"), "g")
        better = high.where("g.h != n").select(F.col("n").alias("via"), F.col("g").alias("far"))
        jumps = high.select("n", F.col("g.h").alias("via")).where("via != n").join(_apart(better), "via").select("n", F.col("far").alias("g"))
        come = along.unionByName(jumps).groupBy("n").agg(F.max("g").alias("c"))
        after = high.join(_apart(come), "n", "left").select("n", F.greatest("g", "c").alias("g"), F.coalesce(F.col("c") > F.col("g"), F.lit(False)).alias("rose"))
        after = written(after, "highest")
        high = after.select("n", "g")
        if after.where("rose").isEmpty():
            return high.select("n", F.col("g.h").alias("h"))


@tidy
def cycle_paths(edges: DataFrame, max_length: int = 6, tiers=None) -> DataFrame:
    """(component, symbols, length, path): a shortest cycle of each component of symbols on cycles, as its ids from the lowest round to it again.

    Of several shortest ones it is the first in the order of their ids. length and path are null if it has
    more than max_length edges. A cycle is looked for from its lowest id only, over higher ones; a pair of
    first and current symbol is kept at its first length, with the first of its paths, and a component is
    left once a cycle closes.
    """
    members = written(strongly_connected(edges, tiers), "cycle-members")
    used = edges.where(edge_filter(None, tiers)).select(F.col("src_symbol_id").alias("a"), F.col("dst_symbol_id").alias("b")).distinct()
    used = used.join(_apart(members.select(F.col("symbol_id").alias("a"), "component")), "a").join(_apart(members.select(F.col("symbol_id").alias("b"), F.col("component").alias("y"))), "b")
    used = written(used.where("component = y AND component IS NOT NULL").select("component", "a", "b"), "cycle-used")
    paths = written(used.where("b >= a").select("component", F.col("a").alias("start"), F.col("b").alias("at"), F.array("a", "b").alias("path")), "cycle-paths")
    seen, found = paths.select("start", "at"), []
    for n in range(1, max_length + 1):
        closed = written(paths.where("start = at").groupBy("component").agg(F.min("path").alias("path")).withColumn("length", F.lit(n)), "cycle-closed")
        found.append(closed)
        if n == max_length:
            break
        going = paths.join(closed.select("component"), "component", "left_anti")
        step = going.join(_apart(used.select(F.col("a").alias("at"), "b")), "at").where("b >= start")
        new = step.groupBy("component", "start", F.col("b").alias("at")).agg(F.min(F.concat("path", F.array("b"))).alias("path"))
        paths = written(new.join(_apart(seen), ["start", "at"], "left_anti").select("component", "start", "at", "path"), "cycle-paths")
        if paths.isEmpty():
            break
        seen = seen.unionByName(paths.select("start", "at"))
    sizes = members.groupBy("component").agg(F.count("*").alias("symbols"))
    return sizes.join(reduce(DataFrame.unionByName, found), "component", "left").select("component", "symbols", "length", "path")


@tidy
def cycles(edges: DataFrame, max_length: int = 6, tiers=None) -> DataFrame:
    """(symbol_id, length) of all symbols that lie on a cycle; the length of the shortest, null if it has more than max_length edges.

    Which symbols these are comes from strongly_connected(), and lengths from paths inside a
    component: pairs of first and current symbol, distinct at each length.
    """
    members = written(strongly_connected(edges, tiers), "cycle-members")
    used = edges.where(edge_filter(None, tiers)).select("src_symbol_id", "dst_symbol_id").distinct()
    used = used.join(members.select(F.col("symbol_id").alias("src_symbol_id"), F.col("component").alias("x")), "src_symbol_id")
    used = used.join(members.select(F.col("symbol_id").alias("dst_symbol_id"), F.col("component").alias("y")), "dst_symbol_id")
    used = written(used.where("x = y").select("src_symbol_id", "dst_symbol_id"), "cycle-used")
    paths = used.select(F.col("src_symbol_id").alias("symbol_id"), F.col("dst_symbol_id").alias("at"))
    found = None
    for n in range(1, max_length + 1):
        closed = paths.where("symbol_id = at").select("symbol_id", F.lit(n).alias("length"))
        found = closed if found is None else found.unionByName(closed)
        if n < max_length:
            # a symbol that closed has its shortest cycle
            open_ = paths.where("symbol_id != at").join(closed.select("symbol_id"), "symbol_id", "left_anti")
            step = open_.join(used.withColumnRenamed("src_symbol_id", "at"), "at").select("symbol_id", F.col("dst_symbol_id").alias("at"))
            paths = written(step.distinct(), "cycle-paths")
    lengths = found.groupBy("symbol_id").agg(F.min("length").alias("length"))
    return members.select("symbol_id").join(lengths, "symbol_id", "left")
