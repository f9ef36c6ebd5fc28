"""Phrase collocation mining: sketches bound every phrase's count from above, automata count what may be frequent.

Texts are cut into pieces at punctuation and line ends, and pieces into words. For each number of words from
one to LONGEST a count-min sketch adds up the phrases of that length, in one scan for one and two words and in another for
more, whose pairs must be possible by the first; the tasks' counters are summed by blocks, and a bit says which counters reach the least
count. No phrase that is frequent can miss its bits, so the phrases that have them are all candidates and
a few that are not. In one more scan each task takes a run of its texts at a time, finds the candidates in them, compiles
those into Aho-Corasick automata, a delimiter before and after each phrase, so that whole words match and overlapping
matches all count, and counts them in the run. A candidate that a run holds is in the run's automata, so the sums over
all runs are exact, and the texts are scanned as often however many candidates there are. Thresholds, scores and the
dropping of what a longer phrase covers are joins over phrases.

Sizes: a sketch has a counter for WIDE bytes of text, at most 2 to the WIDEST; beyond that phrases are dealt by their first word
to several sketches, one after the other, so what a task holds stays the same and the bounds stay as tight, for three more
scans of the texts for each. A task holds two rows of 8-bit counters for each of two lengths, or the bits of the sketches before and one run of
RUN_BYTES of text with automata of some GROUP_CHARS characters. Only bits, of a bounded size, pass the driver.

Defined results: a null text is the empty text and has no words; a null language is `und`; without frequent phrases
the result is empty, as for an empty table; repeated rows count as often as they are there; ties in score and count go by
the phrase's bytes; very long texts are cut at punctuation, and only a piece is held whole; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import functools
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, table, tidied, tidy, written

LONGEST, LEAST, COVERED, FIRST = 4, 30, 80, 2000
UNDETERMINED = "und"
#: Bytes of text for a counter of a sketch; log2 of the fewest and the most counters; rows of counters.
WIDE, NARROWEST, WIDEST, ROWS = 96, 12, 27, 2
#: Log2 of the counters that travel together, phrases added at once, and where counters stop.
BLOCK, ADDED, FULL = 16, 1 << 15, 255
#: Tasks of a scan for each core.
TASKS = 2
#: Bytes of text cut into words at once.
READ = 1 << 18
#: A run of texts ends where its candidates have so many characters, or its texts so many bytes.
GROUP_CHARS, RUN_BYTES = 14_000_000, 1 << 27

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: 0 inside a word, 1 between words, 2 between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t")], _KIND[list(_BREAKS)] = 1, 2
_BREAK = re.compile(b"[" + re.escape(_BREAKS) + b"]")
#: For scanning: lower case, one sign between pieces, one between words.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + _BREAKS, b"abcdefghijklmnopqrstuvwxyz " + b"\n" * len(_BREAKS))
_SPACES = re.compile(b" {2,}")

_STEP, _MUL, _SPREAD = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_32 = np.uint64(32)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _32)) * _SPREAD
    return x ^ (x >> _32)


@functools.cache
def _powers(log: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse modulo 2^64."""
    n = 1 << log
    up = np.full(n, _STEP)
    down = np.full(n, np.uint64(pow(int(_STEP), -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Words:
    """The words of some texts: where each begins and ends in the bytes, its hash with its language's, and its piece."""

    def __init__(self, texts: list[bytes], seeds: list[int]) -> None:
        joined = b"\n".join(texts) + b"\n"
        self.text = joined.translate(_LOWER)
        codes = np.frombuffer(self.text, np.uint8)
        kind = _KIND[codes]
        inside = kind == 0
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1  # the last byte is a line end
        if inside[0]:
            edge = np.concatenate(([0], edge))
        self.begin, self.end = edge[::2], edge[1::2]
        self.piece = np.cumsum(kind == 2, dtype=np.int64)[self.begin] if len(self.begin) else self.begin
        lengths = np.array([len(t) + 1 for t in texts])
        self.doc = np.searchsorted(np.cumsum(lengths), self.begin, "right")
        log = max(len(codes) - 1, 1).bit_length()
        up, down = _powers(log) if log <= 20 else _powers.__wrapped__(log)
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes + np.uint64(1)) * up[: len(codes)], out=sums[1:])
        word = (sums[self.end] - sums[self.begin]) * down[self.begin]
        self.hash = mixed(mixed(word) ^ np.array(seeds, np.uint64)[self.doc]) if len(word) else word

    def phrases(self, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For 1 to longest words: the phrases' hashes by first word, and which lie in one piece."""
        h = self.hash
        at, fits = h, np.ones(len(h), bool)
        yield at, fits
        for n in range(2, longest + 1):
            m = max(0, len(h) - n + 1)
            at = mixed(at[:m] * _MUL + h[n - 1 :])
            fits = self.piece[:m] == self.piece[n - 1 :]
            yield at, fits

    def phrase(self, i: int, n: int) -> str:
        return b" ".join(self.text[self.begin[j] : self.end[j]] for j in range(i, i + n)).decode()


def cut_texts(batch: pa.RecordBatch) -> Iterator[tuple[list[bytes], list[str]]]:
    """The texts and languages of a batch (lang, text), about READ bytes at a time; long texts are cut at punctuation."""
    texts, langs, held = [], [], 0
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        raw, at = text.encode(), 0
        while at < len(raw):
            stop = _BREAK.search(raw, at + READ) if len(raw) - at > READ else None
            part = raw[at : stop.end() if stop else len(raw)]
            at += len(part)
            if held and held + len(part) > READ:
                yield texts, langs
                texts, langs, held = [], [], 0
            texts.append(part)
            langs.append(lang)
            held += len(part)
    if texts:
        yield texts, langs


@functools.lru_cache(4096)
def seed_of(lang: str) -> int:
    h = 0
    for c in lang.encode():
        h = (h + c + 1) * int(_STEP) % (1 << 64)
    return h


def places(h: np.ndarray, log: int) -> list[np.ndarray]:
    """A counter in each row."""
    shift = np.uint64(64 - log)
    return [((h if r == 0 else mixed(h * _STEP)) >> shift).astype(np.int64) for r in range(ROWS)]


class Bits:
    """Which phrases of one length may be frequent, by sketch and slice of first words."""

    def __init__(self, log: int, rows: list[bytes]) -> None:
        self.log, self.rows = log, rows

    def may(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for at, row in zip(places(h, self.log), self.rows, strict=True):
            out &= (np.frombuffer(row, np.uint8)[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
        return out


class Sketch:
    """Counters that stop at `full`, in ROWS rows."""

    def __init__(self, log: int, full: int = FULL) -> None:
        self.log, self.full = log, full
        self.rows = np.zeros((ROWS, 1 << log), np.uint8)

    def add(self, h: np.ndarray) -> None:
        for i in range(0, len(h), ADDED):
            for row, at in zip(self.rows, places(h[i : i + ADDED], self.log), strict=True):
                at, times = np.unique(at[row[at] < self.full], return_counts=True)
                row[at] = np.minimum(row[at] + times, self.full)

    def blocks(self) -> Iterator[tuple[int, int, bytes]]:
        """(row, block, packed counters) of blocks that are not all zero."""
        pack, size = zstandard.ZstdCompressor(level=1), 1 << min(BLOCK, self.log)
        for r, row in enumerate(self.rows):
            for i in range(0, len(row), size):
                part = row[i : i + size]
                if part.any():
                    yield r, i // size, pack.compress(part.tobytes())


def _admitted(words: Words, bits: dict[int, Bits], part: int, parts: int, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, hashes, which may be frequent by bits) for 1 to n words; of the last, whose bits may be missing, by its parts."""
    first = words.hash % np.uint64(parts) == part if parts > 1 else None
    before = None
    for k, (h, fits) in enumerate(words.phrases(n), 1):
        good = fits.copy()
        if k > 1:
            good &= before[: len(h)]
            if parts == 1:
                good &= before[1 : len(h) + 1]
            else:
                good &= first[: len(h)] & single[k - 1 :][: len(h)]
        if k in bits:
            on = np.flatnonzero(good)
            good[on] = bits[k].may(h[on])
        yield k, h, good
        if k == 1:
            single = good
        before = good


def _summed(batches: Iterable[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(n, row, block, bits) of blocks that come one after the other."""
    unpack, now, total = zstandard.ZstdDecompressor(), None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.array([x], pa.int32()) for x in now], pa.array([np.packbits(total >= least).tobytes()], pa.binary())], ["n", "r", "block", "bits"])

    for b in batches:
        for *at, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if now != at:
                if now:
                    yield done()
                now, total = at, 0
            total = np.minimum(total + np.frombuffer(unpack.decompress(data), np.uint8).astype(np.uint16), FULL)
    if now:
        yield done()


@tidy
def _bits(read: DataFrame, lengths: tuple[int, ...], log: int, least: int, bits: dict[int, Bits], part: int, parts: int) -> dict[int, Bits]:
    """Sketch the phrases of some lengths, of first words in this part, and say which counters reach the least count; with the bits there are."""
    shared = read.sparkSession.sparkContext.broadcast(bits)

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches = {n: Sketch(log, min(least, FULL)) for n in lengths}
        for b in batches:
            for texts, langs in cut_texts(b):
                words = Words(texts, [seed_of(x) for x in langs])
                for k, h, good in _admitted(words, shared.value, part, parts, max(lengths)):
                    if k in sketches:
                        sketches[k].add(h[good])
        for n, sketch in sketches.items():
            for r, block, data in sketch.blocks():
                yield pa.RecordBatch.from_arrays([*[pa.array([x], pa.int32()) for x in (n, r, block)], pa.array([data], pa.binary())], ["n", "r", "block", "data"])

    at = ["n", "r", "block"]
    blocks = read.mapInArrow(tidied(sketched), "n int, r int, block int, data binary").repartition(*at).sortWithinPartitions(*at)
    sums = blocks.mapInArrow(tidied(lambda batches: _summed(batches, min(least, FULL))), "n int, r int, block int, bits binary")
    size = (1 << min(BLOCK, log)) // 8
    rows = {n: [bytearray((1 << log) // 8) for _ in range(ROWS)] for n in lengths}
    for x in sums.collect():  # ROWS << WIDEST bits of each length, at most
        rows[x["n"]][x["r"]][x["block"] * size : (x["block"] + 1) * size] = x["bits"]
    shared.unpersist()
    return bits | {n: Bits(log, [bytes(r) for r in of]) for n, of in rows.items()}


class Seen:
    """Hashes that came before: all in a set, and most in a table that tells for many at once."""

    def __init__(self) -> None:
        self._all: set[int] = set()
        self._last = np.zeros(1 << 20, np.uint64)

    def new(self, h: np.ndarray) -> np.ndarray:
        """Places of the hashes that come for the first time, one of each."""
        at = (h >> np.uint64(44)).astype(np.int64)
        on = np.flatnonzero(self._last[at] != h)
        if not len(on):
            return on
        self._last[at[on]] = h[on]
        distinct, first = np.unique(h[on], return_index=True)
        fresh = [i for i, x in zip(first.tolist(), distinct.tolist(), strict=True) if x not in self._all]
        self._all.update(distinct.tolist())
        return on[fresh]


def guarded(text: bytes) -> str:
    """Words with one space before and after each, pieces parted by a word of their own."""
    return _SPACES.sub(b" ", b" " + text.translate(_PLAIN).replace(b"\n", b" \n ") + b" ").decode()


def _matched(phrases: list[str], texts: list[bytes]) -> np.ndarray:
    """How often each of some sorted phrases is in the texts."""
    import ahocorasick

    automaton, found = ahocorasick.Automaton(), np.zeros(len(phrases), np.int64)
    for i, p in enumerate(phrases):
        automaton.add_word(f" {p} ", i)
    automaton.make_automaton()
    for text in texts:
        np.add.at(found, np.fromiter(map(itemgetter(1), automaton.iter(guarded(text))), np.int64), 1)
    return found


def _counted(read: DataFrame, bits: dict[int, Bits], part: int, parts: int, longest: int) -> DataFrame:
    """(lang, phrase, n): matches of the phrases whose bits are set, in each run of texts; only the first part has single words, and as a null phrase all words."""
    shared = read.sparkSession.sparkContext.broadcast(bits)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts_of, phrases_of, words_of = defaultdict(list), defaultdict(list), Counter()
        seen, chars, size = [Seen() for _ in range(longest + 1)], 0, 0

        def rows(lang: list[str], phrase: list[str | None], n: list[int] | np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(phrase, pa.string()), pa.array(n, pa.int64())], ["lang", "phrase", "n"])

        def run() -> Iterator[pa.RecordBatch]:
            seen.clear()
            while phrases_of:
                lang, phrases = phrases_of.popitem()
                phrases.sort()  # so that what is walked together lies together
                yield rows([lang] * len(phrases), phrases, _matched(phrases, texts_of.pop(lang)))
            texts_of.clear()

        for b in batches:
            for texts, langs in cut_texts(b):
                words = Words(texts, [seed_of(x) for x in langs])
                for x, text, n in zip(langs, texts, np.bincount(words.doc, minlength=len(texts)).tolist(), strict=True):
                    texts_of[x].append(text)
                    words_of[x] += n
                    size += len(text)
                for k, h, good in _admitted(words, shared.value, part, parts, longest):
                    if k == 1 and part:
                        continue
                    on = np.flatnonzero(good)
                    for i in on[seen[k].new(h[on])].tolist():
                        phrase = words.phrase(i, k)
                        phrases_of[langs[words.doc[i]]].append(phrase)
                        chars += len(phrase) + 2
                if chars >= GROUP_CHARS or size >= RUN_BYTES:
                    yield from run()
                    seen, chars, size = [Seen() for _ in range(longest + 1)], 0, 0
        yield from run()
        if not part:
            yield rows(list(words_of), [None] * len(words_of), list(words_of.values()))

    return read.mapInArrow(tidied(counted), "lang string, phrase string, n long")


@tidy
def phrase_counts(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, a) for every phrase of 1 to longest words that occurs at least `least` times, and (lang, n) of all words."""
    spark = docs.sparkSession
    small_batches(spark)
    read = docs.select(F.coalesce(docs[f"`{lang}`"].cast("string"), F.lit(UNDETERMINED)).alias("lang"), docs[f"`{text}`"].cast("string").alias("text")).where("text != ''")
    size = read.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # what a task tells of sketches, candidates and counts does not shrink with its share of the texts, so few long tasks tell less
    read = read.coalesce(TASKS * spark.sparkContext.defaultParallelism)
    wanted = max(NARROWEST, (size // WIDE).bit_length())
    log, parts = min(wanted, WIDEST), 1 << max(0, wanted - WIDEST)
    counts, single = None, {}
    for part in range(parts):
        # the shortest phrases have no shorter ones to go by, and the others none but these
        bits = _bits(read, (2,) if single else (1, 2), log, least, single, part, parts)
        single = {1: bits[1]}
        if longest > 2:
            bits = _bits(read, tuple(range(3, longest + 1)), log, least, bits, part, parts)
        of = _counted(read, bits, part, parts, longest).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        of = written(of.where(F.col("phrase").isNull() | (F.col("n") >= least)), "counts")
        counts = of if counts is None else counts.unionByName(of)
    frequent = counts.where("phrase IS NOT NULL").select("lang", "phrase", F.size(F.split("phrase", " ")).alias("size"), F.col("n").alias("a"))
    return frequent, counts.where("phrase IS NULL").select("lang", "n")


def _exact(c: Column) -> Column:
    return c.cast("decimal(19,0)")


@tidy
def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, longest: int = LONGEST, covered: int = COVERED, first: int = FIRST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases by score.

    covered: a phrase goes where a longer one that holds it is at least so many hundredths as frequent.
    """
    counts, words = phrase_counts(docs, lang, text, least, longest)
    several = counts.where("size >= 2")
    word = F.split("phrase", " ")
    joined = lambda start, n: F.array_join(F.slice(word, start, n), " ")
    cuts = several.select("lang", "phrase", "size", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": joined(F.lit(1), F.col("k")), "right": joined(F.col("k") + 1, F.col("size") - F.col("k"))})
    side = lambda name, n: counts.select("lang", F.col("phrase").alias(name), F.col("a").alias(n))
    cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    score = F.expr("CAST((CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0))) div (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0))) AS BIGINT)")
    lowest = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    scored = lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    starts = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: F.array_join(F.slice(word, i, n), " "))))
    inner = several.where("size >= 3").select("lang", F.explode(F.array_distinct(starts)).alias("phrase"), "a")
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    stay = scored.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (_exact(F.col("longer")) * 100 < _exact(F.col("a")) * covered))
    ranked = stay.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))).where(F.col("rank") <= first)
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE_SQL = f"""
WITH pieces AS MATERIALIZED (
  SELECT coalesce(lang, '{UNDETERMINED}') AS lang,
    unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
words AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
totals AS MATERIALIZED (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
spots AS MATERIALIZED (SELECT lang, unnest(w) AS w1, unnest(w[2:] || [NULL]) AS w2, unnest(w[3:] || [NULL, NULL]) AS w3, unnest(w[4:] || [NULL, NULL, NULL]) AS w4 FROM words WHERE len(w) > 0),
f AS MATERIALIZED (
  SELECT lang, w1 AS p, 1 AS size, count(*) AS a FROM spots WHERE w1 IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}
  UNION ALL SELECT lang, w1 || ' ' || w2, 2, count(*) FROM spots WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}
  UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, 3, count(*) FROM spots WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}
  UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, 4, count(*) FROM spots WHERE w4 IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}),
parts AS MATERIALIZED (
  SELECT lang, p, a, k, array_to_string(string_split(p, ' ')[1:k], ' ') AS p1, array_to_string(string_split(p, ' ')[k + 1:], ' ') AS p2
  FROM (SELECT *, unnest(range(1, size)) AS k FROM f WHERE size >= 2)),
cuts AS MATERIALIZED (
  SELECT c.lang, c.p, c.a, k, x.a AS l, y.a AS r, (2000000::HUGEINT * c.a) // (x.a::HUGEINT + y.a) AS score
  FROM parts c JOIN f x ON x.lang = c.lang AND x.p = p1 JOIN f y ON y.lang = c.lang AND y.p = p2),
lowest AS MATERIALIZED (SELECT lang, p, a, l, r, score::BIGINT AS score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inside AS MATERIALIZED (
  SELECT lang, array_to_string(string_split(p, ' ')[i:i + n - 1], ' ') AS p, max(a) AS longer
  FROM (SELECT *, unnest(range(1, size)) AS i FROM f WHERE size >= 3), (VALUES (2), (3)) AS v(n) WHERE n < size AND i + n - 1 <= size GROUP BY ALL),
kept AS MATERIALIZED (
  SELECT s.* FROM lowest s LEFT JOIN inside i ON i.lang = s.lang AND i.p = s.p WHERE longer IS NULL OR 100::HUGEINT * longer < {COVERED}::HUGEINT * s.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank FROM kept)
SELECT ranked.lang, rank, p AS phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {FIRST}
"""
