"""Language ID by segmentation-marginalised unigrams.

The pieces are a fixed public vocabulary; each language has a probability for every piece. A
word's probability in a language is the sum over all its segmentations into pieces, which a
forward pass over its characters gives; expected counts from the same pass and a backward one
re-estimate the probabilities (EM). A text's score in a language is the sum over its words and
the language's share; the posterior of the best language is returned.

Words are runs of letters with their marks, lower-cased and started with the vocabulary's word
mark. All pieces that can stand in such a word are used, and words are scored whole, however
long: the pass goes in windows of WINDOW characters, carries the last values over and rescales
them before they vanish. Characters outside the vocabulary count alike in all languages. Each
distinct word is scored once while it stays in a memo of MEMO_BYTES at most. Every text is
scored whole, where it lies, without a shuffle.

Training reads about TRAIN_ROWS texts of each language, chosen by a hash of the id among rows
that are not held out, longer words in overlapping windows of LEARNT_LETTERS letters; its counts are
summed on the executors, and one number per piece and language passes the driver. Languages are
MAX_LANGUAGES at most, as every worker holds all their probabilities; more are an error.

Defined results: null texts and texts without a letter (Unicode category L) are `und` with score
0; rows without a language teach nothing; with no language to learn all are `und`; languages that
score alike go by name; repeated rows score alike; very long texts and words are scored whole; an
empty table gives an empty result; extra columns are kept by `predict` unless it is told which to
keep, and columns called like its results, in any case, are replaced.
"""

from __future__ import annotations

import functools
import itertools
import sys
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import discard, held_out, small_batches, table, tidied, tidy, written

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
TRAIN_ROWS = 1500
#: Letters of a word that training looks at together, and how many of them the next window of a longer word has again.
LEARNT_LETTERS, AGAIN = 32, 8
MAX_LANGUAGES = 500
ROUNDS = 3
#: Added to each piece's expected count, and the probability of a character outside the vocabulary.
SMOOTH, UNKNOWN = 0.1, 1e-7
#: Words scored together, characters of them in all, and characters of a word at a time.
BLOCK, CELLS, WINDOW = 4096, 1 << 18, 128
#: Values below LOW are brought back up every RESCALE characters; a character costs 1e-12 at the least.
LOW, RESCALE = 1e-120, 8
MEMO_BYTES = 20_000_000
#: Characters of the texts whose words are held at once; a longer text is held as counts of its distinct words.
HELD = 1_000_000
UNDETERMINED = "und"

_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def windows(word: str) -> Iterator[str]:
    """The word, or overlapping windows of one that is longer than LEARNT_LETTERS."""
    yield word[: LEARNT_LETTERS + 1]
    step = LEARNT_LETTERS - AGAIN
    for at in range(step + 1, len(word) - AGAIN, step):
        yield word[at : at + LEARNT_LETTERS]


class Pieces:
    """Number of each usable piece from 1, found by a 64-bit hash of its characters; 0 is none.

    All substrings of a block of words are hashed by character position and length at once and
    looked up in an open table of TABLE_BITS bits, whose entries hold the whole hash.
    """

    TABLE_BITS = 17
    _STEP, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

    def __init__(self, pieces: list[str]) -> None:
        self.number: dict[str, int] = {}
        for p in pieces:
            if p and p not in self.number:
                self.number[p] = len(self.number) + 1
        self.longest = max(map(len, self.number), default=1)
        size = 1 << max(self.TABLE_BITS, (4 * len(self.number)).bit_length())
        self._shift = np.uint64(64 - size.bit_length() + 1)
        self._hash, self._piece = np.zeros(size + 64, np.uint64), np.zeros(size + 64, np.int32)
        self._probes = 1
        for p, n in self.number.items():
            h = self._text_hash(p)
            at = first = int(np.uint64(h * int(self._SPREAD) & 0xFFFFFFFFFFFFFFFF) >> self._shift)
            while self._piece[at]:
                if int(self._hash[at]) == h:
                    raise ValueError("two pieces have one hash")
                at += 1
            self._hash[at], self._piece[at] = h, n
            self._probes = max(self._probes, at - first + 1)

    def _text_hash(self, text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(self._STEP) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    @classmethod
    @functools.cache  # one for each process
    def load(cls, path: str) -> Pieces:
        """The vocabulary's pieces that can stand in a word."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        usual = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        inside = regex.compile(rf"{MARK}?[\p{{L}}\p{{M}}]*")
        return cls([p for p in usual if inside.fullmatch(p) and p == p.lower()])

    def _lookup(self, h: np.ndarray) -> np.ndarray:
        at = ((h * self._SPREAD) >> self._shift).astype(np.int64)
        found = np.where(self._hash[at] == h, self._piece[at], 0)
        for k in range(1, self._probes):
            found = np.where(self._hash[at + k] == h, self._piece[at + k], found)
        return found

    def window(self, codes: np.ndarray, lengths: np.ndarray, begin: int, end: int) -> np.ndarray:
        """Piece numbers [character, length - 1, word] ending after each of the characters from begin to end."""
        m, low = len(codes), max(0, begin - self.longest + 1)
        grid = np.zeros((end - begin, self.longest, m), np.int32)
        part = codes[:, low:end].astype(np.uint64)
        width = part.shape[1]
        h = np.zeros((m, width), np.uint64)
        for k in range(1, min(width, self.longest) + 1):
            # h[:, j] is the hash of the k characters from low + j on
            h = h[:, : width - k + 1] * self._STEP + part[:, k - 1 :]
            first = max(0, begin - low - k + 1)
            last = np.arange(low + first + k - 1, end)
            grid[last - begin, k - 1] = np.where(last < lengths[:, None], self._lookup(h[:, first:]), 0).T
        return grid

    def lattice(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The window of all characters, and lengths."""
        codes, lengths = _codes(words)
        return self.window(codes, lengths, 0, codes.shape[1]), lengths


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points plus one [word, character], 0 behind a word's end; and lengths."""
    lengths = np.array([len(w) for w in words])
    codes = np.zeros((len(words), int(lengths.max())), np.uint32)
    codes[np.arange(codes.shape[1]) < lengths[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32) + np.uint32(1)
    return codes, lengths


def _step_sets(grid: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """(character, length, piece numbers) of steps that some word can take; single characters always."""
    n, longest, _ = grid.shape
    return [(i, k, grid[i - 1, k - 1]) for i in range(1, n + 1) for k in range(1, min(i, longest) + 1) if k == 1 or grid[i - 1, k - 1].any()]


def forward(grid: np.ndarray, lengths: np.ndarray, p: np.ndarray) -> np.ndarray:
    """alpha [character, word, language]: sum over all segmentations of the first characters.

    p: [piece, language], with the probability of unknown characters at 0.
    """
    n, _, m = grid.shape
    alpha = np.zeros((n + 1, m, p.shape[1]))
    alpha[0] = 1
    for i, k, ids in _step_sets(grid):
        if k == 1:
            alpha[i] += alpha[i - 1] * p[ids]
        else:
            on = np.nonzero(ids)[0]
            alpha[i, on] += alpha[i - k, on] * p[ids[on]]
    return alpha


def word_scores(words: list[str], pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """Log-probability [word, language], over all segmentations of the whole word."""
    out = np.zeros((len(words), p.shape[1]))
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    at = 0
    while at < len(order):
        many = min(BLOCK, len(order) - at)
        while many > 1 and many * len(words[order[at + many - 1]]) > CELLS:
            many //= 2
        part = order[at : at + many]
        out[part] = _block_scores(*_codes([words[i] for i in part]), pieces, p)
        at += many
    return out


def _block_scores(codes: np.ndarray, lengths: np.ndarray, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    m, n = codes.shape
    out, scale = np.zeros((m, p.shape[1])), np.zeros((m, p.shape[1]))
    recent: deque[np.ndarray] = deque([np.ones((m, p.shape[1]))], maxlen=pieces.longest)
    for begin in range(0, n, WINDOW):
        grid = pieces.window(codes, lengths, begin, min(n, begin + WINDOW))
        some = grid.any(axis=2)
        for i, ids in enumerate(grid):
            now = recent[-1] * p[ids[0]]
            for k in range(2, len(recent) + 1):
                if some[i, k - 1]:
                    on = np.nonzero(ids[k - 1])[0]
                    now[on] += recent[-k][on] * p[ids[k - 1, on]]
            recent.append(now)
            done = begin + i + 1
            if (ended := lengths == done).any():
                out[ended] = np.log(now[ended]) + scale[ended]
            if done % RESCALE == 0 and (low := (now < LOW) & (lengths > done)[:, None]).any():
                for values in recent:
                    values[low] /= LOW
                scale[low] += np.log(LOW)
    return out


def expected_counts(words: list[str], times: np.ndarray, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in words of one language, p being its column."""
    total = np.zeros(len(p))
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    for at in range(0, len(order), BLOCK):
        part = order[at : at + BLOCK]
        grid, lengths = pieces.lattice([words[i] for i in part])
        cols = np.arange(len(part))
        alpha = forward(grid, lengths, p[:, None])[:, :, 0]
        beta = np.zeros_like(alpha)
        beta[lengths, cols] = 1
        weight = times[part] / alpha[lengths, cols]
        for i, k, ids in reversed(_step_sets(grid)):
            on = cols if k == 1 else np.nonzero(ids)[0]
            used = p[ids[on]] * beta[i, on]
            beta[i - k, on] += used
            np.add.at(total, ids[on], alpha[i - k, on] * used * weight[on])
    total[0] = 0
    return total


@dataclass
class Model:
    languages: list[str]
    #: [piece, language]
    p: np.ndarray
    #: log share of each language
    share: np.ndarray
    vocabulary: str

    def scorer(self) -> Scorer:
        """One for each process, as a broadcast model is one object in a worker."""
        if not hasattr(self, "_scorer"):
            self._scorer = Scorer(self)
        return self._scorer

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_scorer"}


class Scorer:
    """Scores of words, kept for as many as the memo takes, and of texts."""

    def __init__(self, model: Model) -> None:
        self.model, self.pieces = model, Pieces.load(model.vocabulary)
        self._place: dict[str, int] = {}
        self._scores = np.zeros((1024, len(model.languages)))
        self._bytes = 0

    def _learn(self, words: list[str]) -> None:
        at = len(self._place)
        while len(self._scores) < at + len(words):
            self._scores = np.concatenate((self._scores, np.zeros_like(self._scores)))
        self._scores[at : at + len(words)] = word_scores([MARK + w for w in words], self.pieces, self.model.p)
        self._place.update(zip(words, range(at, at + len(words)), strict=True))

    def _forget(self, words: list[str], known: int) -> None:
        """Of the last words to come, keep those that the memo has room for: a string, its place in the table, its scores."""
        room = MEMO_BYTES - self._bytes
        size = np.cumsum([sys.getsizeof(w) + 100 + 8 * len(self.model.languages) for w in words])
        keep = int(np.searchsorted(size, room, "right"))
        self._bytes += int(size[keep - 1]) if keep else 0
        if keep < len(words):
            for w in words[keep:]:
                del self._place[w]
            self._scores = self._scores[: max(1024, known + keep)].copy()

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.model.languages:
            return [(UNDETERMINED, 0.0)] * len(texts)
        out: list[tuple[str, float]] = []
        at = 0
        while at < len(texts):
            end, held = at, 0
            while end < len(texts) and (end == at or held + len(texts[end] or "") <= HELD):
                held += len(texts[end] or "")
                end += 1
            out += self._predict(texts[at:end])
            at = end
        return out

    def _predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        words = [words_of(t) if len(t or "") <= HELD else Counter(m[0] for m in _WORD.finditer(t.lower())) for t in texts]
        place = self._place
        known, new = len(place), list(set().union(*words).difference(place))
        if new:
            self._learn(new)
        out = []
        for ws in words:
            if not ws:
                out.append((UNDETERMINED, 0.0))
                continue
            each = self._scores[np.fromiter(map(place.__getitem__, ws), np.int64, len(ws))]
            s = (np.fromiter(ws.values(), float, len(ws)) @ each if isinstance(ws, Counter) else each.sum(axis=0)) + self.model.share
            best = int(s.argmax())
            out.append((self.model.languages[best], float(1 / np.exp(s - s[best]).sum())))
        if new:
            self._forget(new, known)
        return out


@tidy
def train(docs: DataFrame, learn: Column, key: str = "doc_id", rows: int = TRAIN_ROWS, rounds: int = ROUNDS, vocabulary: str | None = None) -> Model:
    """learn: which rows may be learnt from."""
    spark = docs.sparkSession
    small_batches(spark)
    vocabulary = vocabulary or vocabulary_path()
    usable = docs.where(learn & F.col("lang").isNotNull()).select(docs[f"`{key}`"].alias("id"), "lang", "text")
    found = usable.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    sizes = {r["lang"]: r["count"] for r in found}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((1, 0)), np.zeros(0), vocabulary)
    # one scan for all languages: the share of each language's ids below its own bound
    bounds = spark.createDataFrame([(x, int(min(1.0, rows / n) * (1 << 30))) for x, n in sizes.items()], "lang string, bound long")
    hashed = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30))
    sample = usable.join(F.broadcast(bounds), "lang").where(hashed < F.col("bound")).select("lang", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[str, Counter] = {}
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(x for w in words_of(text) for x in windows(MARK + w))
            for lang, c in seen.items():
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(c), pa.string()), "word": pa.array(list(c), pa.string()), "n": pa.array(c.values(), pa.int64())})

    types = written(sample.mapInArrow(tidied(counted), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    size = len(Pieces.load(vocabulary).number) + 1
    p = np.full((size, len(languages)), 1 / size)
    p[0] = UNKNOWN
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(p)

        def expected(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            own, total, held = Pieces.load(vocabulary), {}, []
            for b in itertools.chain(batches, [None]):
                if b is not None:
                    held.append(b)
                if held and (b is None or sum(x.num_rows for x in held) >= 5 * BLOCK):
                    part, held = pa.Table.from_batches(held).to_pandas(), []
                    for lang, rows_ in part.groupby("lang"):
                        j = languages.index(lang)
                        counts = expected_counts(rows_["word"].tolist(), rows_["n"].to_numpy(float), own, np.ascontiguousarray(now.value[:, j]))
                        total[j] = total[j] + counts if j in total else counts
            for j, counts in total.items():
                on = np.nonzero(counts)[0]
                yield pa.RecordBatch.from_pydict({"j": pa.array(np.full(len(on), j, np.int32)), "piece": pa.array(on.astype(np.int32)), "c": pa.array(counts[on])})

        sums = types.mapInArrow(tidied(expected), "j int, piece int, c double").groupBy("j", "piece").agg(F.sum("c").alias("c")).toArrow()
        now.unpersist()
        c = np.zeros_like(p)
        c[sums.column("piece").to_numpy(), sums.column("j").to_numpy()] = sums.column("c").to_numpy()
        c[1:] += SMOOTH
        p = c / c.sum(axis=0)
        p[0] = UNKNOWN
    discard(types)
    share = np.log(np.array([sizes[x] for x in languages]) / sum(sizes.values()))
    return Model(languages, p, share, vocabulary)


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """docs, or its columns to keep, with lang_pred and score; columns of these names are replaced."""
    spark = docs.sparkSession
    small_batches(spark)
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("lang_pred", "score")]
    read = docs.select(*[docs[f"`{c}`"] for c in keep], docs["text"].alias("__read"))
    shared = spark.sparkContext.broadcast(model)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for b in batches:
            said = scorer.predict(b.column(len(keep)).to_pylist())
            new = [pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new], [*keep, "lang_pred", "score"])

    fields = [*read.schema.fields[:-1], StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    return read.mapInArrow(tidied(predicted), StructType(fields))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, ~held_out(F.col("doc_id")))
    out = predict(docs, model, keep=["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
