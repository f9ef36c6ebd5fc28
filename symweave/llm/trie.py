"""A prefix trie of conversations, built family by family and then merged.

A conversation is rebuilt from the first turns of its base conversation and its own later ones, so
all that its path needs lies within its family: the conversations of one base id. A family meets in one
task, is rebuilt there and becomes a small trie, whose nodes are named by a 128-bit hash
of the turns that lead to them. Only these nodes are shuffled, combined on the way, and merged into
the nodes of all conversations. Texts do not move: a turn travels as a hash and a length.

Sums over subtrees take two more passes, however deep the trie is. A merged node is owned by the
family of its smallest conversation, which has the whole way to the root. Each family adds up what it owns
below each of its nodes, deepest first, and these parts are added for each merged node.

Ids of the conversations that end at a node are hashed in one stream, as SHA-256 has to be; lists of
several families are sorted by range over all tasks first and reach the stream as long strings.

Defined results: rows without a conversation id are left out; null roles and texts are empty; rows of
one turn go by a hash of role and text, and repeated rows are turns of their own; a conversation may be
rebuilt to no turns, and is then a member of the root only; an empty table gives an empty result, without
a root; very long texts count whole; other columns, whatever their names, are ignored. A family's task
holds the hashes of that family's turns.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, tidied, tidy, written

#: Ids of one family, and turns that may come from the base conversation.
FAMILY, SHARED = 100, 6
#: Characters of ids that travel as one row.
CHUNK = 1 << 18
ROOT = bytes(16)

_NODES = "a long, b long, pa long, pb long, depth long, base long, conv_id long, n_convs long, chars long, n_ends long, ends string"


def base_of(conv: Column) -> Column:
    return conv - conv % F.lit(FAMILY)


def taken_from_base(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % F.lit(SHARED)


def _halves(key: bytes) -> tuple[int, int]:
    return struct.unpack(">qq", key)


def family_nodes(base: int, turns: dict[int, list[tuple[bytes, int]]], heads: dict[int, int]) -> Iterator[tuple]:
    """The rows of one family's trie. turns: (hash, characters) of each conversation in order; heads: turns that each takes from the base."""
    shared = turns.get(base, [])
    # name of the parent, depth, smallest member, members, characters of the last text, ids that end here
    nodes: dict[bytes, list] = {}
    for conv in sorted(turns):
        head = heads[conv]
        at, parent, depth, chars = ROOT, ROOT, 0, 0
        path = itertools.chain(shared[:head], itertools.islice(turns[conv], head, None))
        while True:
            node = nodes.get(at)
            if node is None:
                node = nodes[at] = [parent, depth, conv, 0, chars, []]
            node[3] += 1
            turn = next(path, None)
            if turn is None:
                node[5].append(conv)
                break
            parent, depth, chars = at, depth + 1, turn[1]
            at = hashlib.blake2b(at + turn[0], digest_size=16).digest()
    for at, (parent, depth, conv, members, chars, ends) in nodes.items():
        yield *_halves(at), *_halves(parent), depth, base, conv, members, chars, len(ends), ",".join(map(str, ends))


def _arrow(rows: Iterator[tuple], fields: list[tuple[str, pa.DataType]], each: int = 4096) -> Iterator[pa.RecordBatch]:
    for some in iter(lambda: list(itertools.islice(rows, each)), []):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*some, strict=True), fields, strict=True)], [n for n, _ in fields])


def _families(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for base, family in itertools.groupby(rows, lambda r: r[0]):
        turns: dict[int, list[tuple[bytes, int]]] = {}
        heads: dict[int, int] = {}
        for _, conv, head, digest, chars in family:
            turns.setdefault(conv, []).append((digest, chars))
            heads[conv] = head
        yield from family_nodes(base, turns, heads)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(a, b, leaves, saved) below each node of each family, of what the family owns; rows come by family, deepest first."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for _, family in itertools.groupby(rows, lambda r: r[0]):
        below: dict[tuple[int, int], list[int]] = {}
        for _, depth, a, b, pa_, pb, leaf, saved in family:
            more = below.pop((a, b), None)
            if more:
                leaf, saved = leaf + more[0], saved + more[1]
            if leaf or saved:
                yield a, b, leaf, saved
                if depth:
                    up = below.setdefault((pa_, pb), [0, 0])
                    up[0] += leaf
                    up[1] += saved


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(a, b, base, ids): ids of consecutive rows of a node as one string of up to CHUNK characters or one row's."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for (a, b), of in itertools.groupby(rows, lambda r: r[:2]):
        held, size, first = [], 0, None
        for _, _, base, ids in of:
            if held and size + len(ids) > CHUNK:
                yield a, b, first, ",".join(held)
                held, size = [], 0
            first = first if held else base
            held.append(ids)
            size += len(ids) + 1
        yield a, b, first, ",".join(held)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for (a, b), of in itertools.groupby(rows, lambda r: r[:2]):
        h, between = hashlib.sha256(), b""
        for *_, ids in of:
            h.update(between + ids.encode())
            between = b","
        yield a, b, h.hexdigest()


def _mapped(df: DataFrame, f, ddl: str) -> DataFrame:
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [(n, kinds[k]) for n, k in (x.split() for x in ddl.split(","))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _arrow(f(batches), fields)

    return df.mapInArrow(tidied(run), ddl)


@tidy
def prefix_trie(convs: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(node, parent: names as hexadecimal digits; conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) for every node."""
    small_batches(convs.sparkSession)
    word = lambda c: F.coalesce(convs[f"`{c}`"].cast("string"), F.lit(""))
    said = F.concat(F.char_length(word(role)).cast("string"), F.lit(":"), word(role), word(text))
    turns = convs.where(convs[f"`{conv}`"].isNotNull()).select(
        convs[f"`{conv}`"].cast("long").alias("c"), convs[f"`{turn}`"].alias("turn"),
        F.substring(F.unhex(F.sha2(said, 256)), 1, 16).alias("said"), F.char_length(word(text)).cast("long").alias("chars"),
    )
    # families meet, rebuilt where they meet
    together = turns.withColumns({"base": base_of(F.col("c")), "head": taken_from_base(F.col("c"))}).repartition("base")
    together = together.sortWithinPartitions("base", "c", F.col("turn").asc_nulls_first(), "said").select("base", "c", "head", "said", "chars")
    local = written(_mapped(together, _families, _NODES), "family-nodes")

    merged = local.groupBy("a", "b").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.sum("n_convs").alias("n_convs"),
        F.min("chars").alias("chars"), F.count_if(F.col("n_ends") > 0).alias("ending"),
    )
    merged = written(merged, "nodes")
    children = merged.where("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    nodes = written(merged.join(children, ["a", "b"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")

    value = F.when(F.col("depth") > 0, (F.col("n_convs") - 1) * F.col("chars")).otherwise(0)
    owned = nodes.select("a", "b", base_of(F.col("conv_id")).alias("base"), (F.col("n_children") == 0).cast("long").alias("leaf"), value.alias("saved"))
    parts = local.select("base", "depth", "a", "b", "pa", "pb").join(owned, ["a", "b", "base"], "left")
    parts = parts.select("base", "depth", "a", "b", "pa", "pb", F.coalesce("leaf", F.lit(0)).alias("leaf"), F.coalesce("saved", F.lit(0)).alias("saved"))
    sums = _mapped(parts.repartition("base").sortWithinPartitions("base", F.desc("depth")), _summed, "a long, b long, leaf long, saved long")
    sums = written(sums.groupBy("a", "b").agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens")), "sums")

    ids = local.where("n_ends > 0").select("a", "b", "base", "ends")
    several = nodes.where("ending > 1").select("a", "b")
    alone = ids.join(nodes.where("ending = 1").select("a", "b"), ["a", "b"]).select("a", "b", F.sha2("ends", 256).alias("ends_sha256"))
    shared = written(ids.join(several, ["a", "b"], "left_semi").select("a", "b", "base", "ends"), "ends")
    order = ["a", "b", "base"]
    chunks = _mapped(shared.repartitionByRange(*order).sortWithinPartitions(*order), _chunks, "a long, b long, base long, ends string")
    streams = _mapped(chunks.repartition("a", "b").sortWithinPartitions(*order), _hashed, "a long, b long, ends_sha256 string")
    ends = written(alone.unionByName(streams), "ends-sha256")

    # names are unique but for parents, which are many nodes' where they are hot
    ups = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("up"))
    out = nodes.join(sums, ["a", "b"]).join(ends, ["a", "b"], "left").join(ups, ["pa", "pb"], "left")
    name = lambda a, b: F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0"))
    below = F.col("depth") > 0
    return out.select(
        name("a", "b").alias("node"), F.when(below, name("pa", "pb")).alias("parent"), "conv_id", "depth", F.when(below, F.col("up")).alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations")).drop("node", "parent")


#: CRC-32 of a decimal number, bit by bit.
_CRC = """xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(c::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT),
    lambda x, y: list_reduce([xor(x, y)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda p, q: CASE WHEN p & 1 = 1 THEN xor(p >> 1, 3988292384) ELSE p >> 1 END)))"""

ORACLE_SQL = f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
      sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, c - c % 100 AS base, {_CRC} % {SHARED} AS h FROM (SELECT DISTINCT c FROM t)),
rebuilt AS (
  SELECT ids.c, 0 AS own, i, role, text FROM ids JOIN t ON t.c = ids.base AND i <= h
  UNION ALL SELECT ids.c, 1, i, role, text FROM ids JOIN t ON t.c = ids.c AND i > h),
paths AS (
  SELECT c, coalesce(list({{'r': role, 't': text}} ORDER BY own, i) FILTER (i IS NOT NULL), []) AS path
  FROM ids LEFT JOIN rebuilt USING (c) GROUP BY c),
prefixes AS (SELECT c, path[1:d] AS node, d, d = len(path) AS ends FROM paths, unnest(range(len(path) + 1)) AS u(d)),
nodes AS (
  SELECT node, d, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '') AS ids FROM prefixes GROUP BY node, d),
kids AS (SELECT node[1:d - 1] AS node, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
more AS (
  SELECT nodes.*, coalesce(n, 0) AS n_children, CASE WHEN nodes.d > 0 THEN (n_convs - 1) * length(nodes.node[nodes.d].t) ELSE 0 END AS saved
  FROM nodes LEFT JOIN kids ON kids.node = nodes.node AND kids.d = nodes.d),
sums AS (
  SELECT node[1:k] AS node, k AS d, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens
  FROM more, unnest(range(d + 1)) AS u(k) GROUP BY ALL)
SELECT m.conv_id, m.d::BIGINT AS depth, p.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves, s.saved_tokens, sha256(m.ids) AS ends_sha256
FROM more m JOIN sums s ON s.node = m.node AND s.d = m.d LEFT JOIN more p ON m.d > 0 AND p.d = m.d - 1 AND p.node = m.node[1:m.d - 1]
"""
