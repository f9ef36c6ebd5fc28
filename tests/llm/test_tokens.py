from __future__ import annotations

import io
import itertools
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from symweave.llm import common, mixing, packing, tokenfile
from symweave.llm import tokens as tk

PATH = tk.default_path()
SPECIAL = "<|endoftext|>"
TEXTS = ["", "a", " a", "a ", "The quick  brown\n\nfox\tjumps", "x\n y", "<|endoftext|> it's 42", "é 世界 🙂", "word " * 3000, "\xa0 ᠎ b", "a\r\nb \x1c c"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_pieces_encode_as_whole_texts(library, monkeypatch):
    enc = tk.Encoder(PATH)
    for text in TEXTS:
        assert enc.encode(text).tolist() == library(text)
    rng = random.Random(0)
    parts = ["a", "b", " ", "  ", "\n", "\t", "\x00", "\xa0", " ", "᠎", "\x85", "é", "1", "!", "'s", "​", "<|endoftext|>", "世", "🙂", "\r\n"]
    monkeypatch.setattr(tk, "MEMO_PIECES", 50)
    small = tk.Encoder(PATH)
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        assert enc.encode(text).tolist() == small.encode(text).tolist() == library(text), repr(text)
    assert enc.encode(None).tolist() == []
    column = pa.array([*TEXTS, None, *TEXTS], pa.string())
    for slice_ in (column, column[3:], column[:0]):
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode_column(slice_)] == [library(t) for t in slice_.to_pylist()]


def test_special_tokens_are_encoded_as_the_library_does(library):
    enc, rng = tk.Encoder(PATH), random.Random(7)
    assert library(f"a {SPECIAL} b") == [64, 220, 50256, 275]
    parts = ["a", " ", "\n", "b ", SPECIAL, SPECIAL[:-1], "<|", "|>", "\t", "é"]
    texts = [SPECIAL, SPECIAL * 2, f" {SPECIAL}", f"{SPECIAL} ", f"word {SPECIAL}\n x", SPECIAL.upper(), *["".join(rng.choices(parts, k=rng.randint(0, 9))) for _ in range(3000)]]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode_column(pa.array(texts))] == [library(t) for t in texts]


def test_batches_are_joined_to_blocks():
    batches = [pa.RecordBatch.from_pydict({"i": [n], "text": ["x" * 10]}) for n in range(7)]
    blocks = list(tk.in_blocks(iter(batches), "text", size=30))
    assert [r for b in blocks for r in b.column("i").to_pylist()] == list(range(7)) and 1 < len(blocks) < 7
    assert list(tk.in_blocks(iter([batches[0].slice(0, 0)]), "text")) == []


def ids_of(rng, n):
    return np.array([rng.randrange(50_000) for _ in range(n)], "<u4")


def test_token_file_round_trip_reads_only_the_frames_of_a_document():
    rng, out = random.Random(1), io.BytesIO()
    docs = [(i if i != 3 else None, ids_of(rng, n)) for i, n in enumerate([5, 0, 100, 1, 333, 7, 64])]
    writer = tokenfile.TokenWriter(out, frame_ids=64)
    for i, ids in docs:
        writer.add(i, ids.tobytes())
    writer.close()
    data = out.getvalue()
    reader = tokenfile.TokenReader(io.BytesIO(data), len(data))
    assert reader.docs == [i for i, _ in docs] and reader.counts.tolist() == [len(x) for _, x in docs]
    for i in (4, 0, 6, 1, 2, 3, 5):
        assert reader.ids(i).tolist() == docs[i][1].tolist()
    # any decoder that skips skippable frames sees one stream of ids
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert whole == b"".join(x.tobytes() for _, x in docs)
    seen, frame = [], reader.frame
    reader.frame = lambda f: seen.append(f) or frame(f)
    reader.ids(2)
    assert seen == [0, 1]
    broken = bytearray(data)
    broken[20] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        bad = tokenfile.TokenReader(io.BytesIO(bytes(broken)), len(broken))
        for i in range(len(docs)):
            bad.ids(i)
    with pytest.raises(ValueError, match="not a token file"):
        tokenfile.TokenReader(io.BytesIO(b"0" * 50), 50)


def test_an_empty_token_file():
    out = io.BytesIO()
    tokenfile.TokenWriter(out).close()
    reader = tokenfile.TokenReader(out, len(out.getvalue()))
    assert reader.docs == [] and len(reader.counts) == 0


ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(100, None), (7, "again"), (7, "again"), (None, "no id"), (-5, "first")]
DDL = "doc_id long, text string, source string, piece string, length string"


def table(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, "s", "p", "l") for i, t in rows], DDL)


def test_files_hold_all_documents_in_order(spark, library):
    files = tokenfile.write_tokens(table(spark), common.scratch(spark, "t"), rows=4)
    assert files.count() > 1
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in tokenfile.read_digests(files).collect())
    assert len(got) == len(ROWS) and [g[1] for g in got] == sorted((i for i, _ in ROWS), key=lambda i: (i is not None, i or 0))
    at, texts = 0, {}
    for i, t in ROWS:
        texts.setdefault(i, []).append([*library(t), 0])
    for start, i, n, crc in got:
        assert start == at and (n, crc) in [(len(x), crc32(np.array(x, "<u4").tobytes())) for x in texts[i]]
        at += n
    assert tokenfile.read_digests(tokenfile.write_tokens(table(spark, []), common.scratch(spark, "t"))).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2047, 2048, 2049, 4096, 5000])
def test_cuts(n):
    parts = packing.cut(n) if n else []
    assert sum(k for _, k in parts) == n and all(k == 2048 for _, k in parts[1:]) and len(parts) == -(-n // 2048)
    assert [s for s, _ in parts] == [sum(k for _, k in parts[:i]) for i in range(len(parts))]


@pytest.mark.parametrize("seed", range(6))
def test_plans_use_each_length_and_come_near_the_bound(seed):
    rng = random.Random(seed)
    counts = Counter(min(2048, max(1, int(rng.lognormvariate(6.3, 1)))) for _ in range(3000))
    if seed == 1:
        counts = Counter({1500: 10_000})
    if seed == 2:
        counts = Counter({1: 5000, 2047: 3, 700: 10**9, 648: 10**9})
    if seed == 3:
        counts = Counter()
    plan = packing.plan_packing(dict(counts))
    used = Counter()
    for p in plan:
        assert p.gap >= 0 and p.times > 0
        for n, m in p.items:
            used[n] += m * p.times
    assert used == counts
    bins, bound = sum(p.times for p in plan), max(-(-sum(n * k for n, k in counts.items()) // 2048), sum(k for n, k in counts.items() if n > 1024))
    assert bins <= bound * 1.02 + 1
    slots = packing.Slots.of(plan)
    if sum(counts.values()) < 20_000 and counts:
        length = np.repeat(list(counts), list(counts.values()))
        rank = np.concatenate([np.arange(k) for k in counts.values()])
        seq, off = slots.place(length, rank)
        order = np.lexsort((off, seq))
        end = off[order] + length[order]
        new = np.r_[True, seq[order][1:] != seq[order][:-1]]
        assert (off[order][new] == 0).all() and (off[order][1:][~new[1:]] == end[:-1][~new[1:]]).all() and end.max() <= 2048


def test_exact_combinations():
    h = packing.Histogram({100: 1, 50: 1, 30: 2, 7: 1})
    assert h.exact(100) == (100,) and h.exact(60) == (30, 30) and h.exact(87) == (50, 30, 7)
    assert h.exact(67) == (30, 30, 7) and h.exact(90) is None and h.exact(0) is None and h.exact(1) is None


def test_exact_combinations_are_found_whenever_there_are_any():
    """Against trying all, while lengths are used up."""
    rng = random.Random(11)
    for _ in range(150):
        room = rng.randint(3, 30)
        counts = {x: rng.randint(1, 3) for x in rng.sample(range(1, room + 1), rng.randint(1, min(room, 8)))}
        h = packing.Histogram(counts, room)
        for _ in range(6):
            gap, without = rng.randint(1, room), rng.choice([0, *[x for x in range(room + 1) if h.n[x]]])
            left = Counter({x: n for x, n in enumerate(h.n) if n}) - Counter({without: 1})
            every = [c for k in (1, 2, 3) for c in itertools.combinations_with_replacement(sorted(left, reverse=True), k) if sum(c) == gap and not Counter(c) - left]
            found = h.exact(gap, without)
            assert (found in every) if every else found is None
            if every:
                assert len(found) == len(every[0])
                for x in found:
                    h.use(x, 1)


def test_packed_pieces_cover_the_documents(spark, library):
    rows = [*ROWS, *((200 + i, "the same text for many rows") for i in range(300))]
    got = packing.packed(table(spark, rows)).collect()
    expected = Counter()
    for i, t in rows:
        ids = np.array([*library(t), 0], "<u4")
        for k, (s, n) in enumerate(packing.cut(len(ids))):
            expected[i, k, s, n, crc32(ids[s : s + n].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == expected
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-sum(r["length"] for r in got) // 2048) + 1
    assert packing.packed(table(spark, [])).count() == 0


def plain_targets(sizes):
    """Water-filling by rounds, as it is told."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    goal, full = 1.5 * sum(sizes.values()), set()
    while True:
        left = goal - sum(2 * sizes[s] for s in full)
        total = sum(weight[s] for s in order if s not in full)
        target = {s: 2.0 * sizes[s] if s in full else left * weight[s] / total for s in order}
        over = {s for s in order if target[s] > 2 * sizes[s] + 1e-9} - full
        if not over:
            return target
        full |= over


def mix_rows(seed):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * int(rng.lognormvariate(3, 1))), rng.choice(["b", "a", "é", "Z", "hot", "hot", "hot", None])) for i in range(1500)]
    return [*rows, (1, None, "a"), (None, "x y", "a"), (2, "", "empty"), (9000, "same words", "tie"), (9000, "same words", "tie"), (9001, "z\x0by\xa0x", "é")]


@pytest.mark.parametrize("seed", [0, 1])
def test_mix_hits_targets(spark, seed):
    rows = mix_rows(seed)
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size long, rank long")
    plan = mixing.mix_plan(docs).collect()
    assert len(plan) == len(rows)
    sizes, taken, target, largest = Counter(), Counter(), {}, Counter()
    for r in plan:
        s = None if r["none"] else r["s"]
        sizes[s] += r["size"]
        taken[s] += r["size"] * r["copies"]
        largest[s] = max(largest[s], r["size"])
        target[s] = r["target"]
        assert 0 <= r["copies"] <= 2
    plain = plain_targets(sizes)
    for s, t in target.items():
        assert t == pytest.approx(plain[s]) and abs(taken[s] - t) <= largest[s] + 0.02 * t
    assert sorted(map(str, mixing.mix_plan(docs.repartition(5)).collect())) == sorted(map(str, plan))
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    copies = Counter()
    for r in plan:
        copies[r["id"], None if r["none"] else r["s"], r["size"]] += r["copies"]
    words = lambda t: len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", t or "")])
    assert Counter((r["doc_id"], r["source"], words(r["text"])) for r in out.collect()) == +copies


def test_mix_keeps_columns_of_any_name_and_spreads_null_ids(spark):
    rows = [(None if i % 2 else i, f"{'w ' * (i % 5)}{i}", "s", "a", 1, 2, 3, {"k": i}) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __s string, __size int, __none int, row int, copies map<string, int>")
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    found = [tuple(r) for r in out.collect()]
    assert 500 < len(found) <= 800 and all(r in rows for r in found)
    assert mixing.mix_plan(docs).where("id IS NULL").count() == 200


def test_mix_of_odd_tables(spark):
    ddl = "doc_id long, text string, source string"
    assert mixing.mix_plan(spark.createDataFrame([], ddl)).count() == 0 and mixing.mixed(spark.createDataFrame([], ddl)).count() == 0
    empty = mixing.mix_plan(spark.createDataFrame([(1, None, None), (2, "", "a")], ddl)).collect()
    assert {(r["target"], r["copies"]) for r in empty} == {(0.0, 0)}
    (one,) = mixing.mix_plan(spark.createDataFrame([(1, "a b", "s")], ddl)).collect()
    assert one["target"] == 3.0 and one["copies"] in (1, 2)


def test_ranks_are_dense_in_each_group(spark):
    rows = spark.range(500).select((F.col("id") % 3).alias("k"), F.pmod(F.hash("id"), F.lit(4)).alias("p"), "id")
    found = {}
    for r in common.ranked(rows, ["k"], ["p"], ["id"]).collect():
        found.setdefault(r["k"], []).append((r["rank"], r["p"], r["id"]))
    for group in found.values():
        group.sort()
        assert [g[0] for g in group] == list(range(len(group))) and [g[1:] for g in group] == sorted(g[1:] for g in group)
