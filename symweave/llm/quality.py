"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Features are words and runs of marks, pairs of neighbours, and repeats of one word, hashed
into 2^18 slots; a document's vector holds each slot's count divided by the number of features, times a fixed
scale, so long and short texts weigh alike. FTRL-proximal updates visit the training rows
in hash order. Scoring is a sparse dot product over the whole text.

Training uses at most about TRAIN_ROWS labelled rows of TRAIN_CHARS characters in all, chosen by
a hash of id, label and text, and sees text and label only. The bound is held after labels and
documents have met, as ids may repeat in both; it makes the single training task bounded. All
other rows are scored where they are, without a shuffle.

Defined results: a null text is scored as the empty text, whose score is that of the bias
alone; without usable labels or documents every score is 0.5; null or other labels than 0 and 1
are ignored; rows that repeat id, text and label teach once, contradicting labels both teach, and
so do different texts of one id; repeated documents score alike; very long texts are scored whole;
an empty table gives an empty result; extra columns are kept by `score_quality` unless it is told
which to keep, and a column called like its result, in any case, is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import bounded_by_hash, held_out, small_batches, table, tidied, tidy, written

BITS = 18
TRAIN_ROWS, TRAIN_CHARS = 12_000, 120_000_000
EPOCHS = 3
SCALE = 50.0
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
THRESHOLD = 0.7
CACHE_WORDS = 200_000

#: A pair of one word with itself, up to three words on, shares one slot whatever the word.
_REPEATS = [(k, crc32(b"\x00same %d" % k)) for k in (1, 2, 3)]
_TOKEN = re.compile(r"\w+|[^\w\s]+")


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = crc32(word.encode("utf-8", "surrogatepass"))
        return h


class Features:
    """Slots of a text's words and word pairs, with repeats."""

    def __init__(self, bits: int = BITS) -> None:
        self.bits, self.hashes = bits, _Hashes()

    def slots(self, text: str | None) -> np.ndarray:
        words = _TOKEN.findall(text or "")
        h = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - self.bits)
        mask = np.uint64((1 << self.bits) - 1)
        same = [np.full(int((h[k:] == h[:-k]).sum()), r, np.uint64) for k, r in _REPEATS]
        return np.concatenate((h & mask, pairs, *[r & mask for r in same])).astype(np.int64)


class Ftrl:
    """FTRL-proximal for logistic loss; the last slot is the bias, which has no penalty."""

    def __init__(self, slots: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(slots + 1), np.zeros(slots + 1)

    def weights(self, i: np.ndarray) -> np.ndarray:
        z, bias = self.z[i], i == len(self.z) - 1
        l1, l2 = np.where(bias, 0.0, self.l1), np.where(bias, 0.0, self.l2)
        w = -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(self.n[i])) / self.alpha + l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def update(self, i: np.ndarray, x: np.ndarray, y: float) -> float:
        w = self.weights(i)
        p = sigmoid(float(w @ x))
        g = (p - y) * x
        g2 = g * g
        self.z[i] += g - (np.sqrt(self.n[i] + g2) - np.sqrt(self.n[i])) / self.alpha * w
        self.n[i] += g2
        return p


def sigmoid(s: float) -> float:
    return 1 / (1 + np.exp(-max(-60.0, min(60.0, s))))


class TrainingSet:
    """Sparse rows in a few flat arrays; texts are not kept."""

    def __init__(self, bits: int = BITS) -> None:
        self.bits, self._features = bits, Features(bits)
        self._parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]] = []

    def add(self, texts: list[str | None], labels: list[int]) -> None:
        slots, values, ends = [], [], [0]
        for text in texts:
            i, n = np.unique(self._features.slots(text), return_counts=True)
            slots.append(i.astype(np.int32))
            values.append((n * (SCALE / max(1, n.sum()))).astype(np.float32))
            ends.append(ends[-1] + len(i))
        if texts:
            self._parts.append((np.concatenate(slots), np.concatenate(values), np.array(ends), labels))

    def fit(self, epochs: int = EPOCHS) -> np.ndarray:
        """2^bits weights and the bias."""
        model, bias = Ftrl(1 << self.bits), 1 << self.bits
        for _ in range(epochs):
            for slots, values, ends, labels in self._parts:
                for k, y in enumerate(labels):
                    row = slice(ends[k], ends[k + 1])
                    model.update(np.append(slots[row], bias).astype(np.int64), np.append(values[row], 1.0).astype(float), float(y))
        return model.weights(np.arange(bias + 1))


def train(texts: list[str | None], labels: list[int], bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    rows = TrainingSet(bits)
    rows.add(texts, labels)
    return rows.fit(epochs)


def score_text(weights: np.ndarray, features: Features, text: str | None) -> float:
    slots = features.slots(text)
    total = float(weights[slots].sum()) * SCALE / len(slots) if len(slots) else 0.0
    return sigmoid(total + float(weights[-1]))


def training_rows(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> DataFrame:
    """(id, text, label, h) of the bounded sample; h is a hash of the text."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("label")).distinct()
    sample = bounded_by_hash(usable, F.col("id"), usable.count(), bound)
    texts = docs.select(docs["doc_id"].alias("id"), docs["text"].alias("text"))
    met = texts.join(F.broadcast(sample), "id").withColumn("h", F.xxhash64("text"))
    rows = written(met.groupBy("id", "label", "h").agg(F.first("text").alias("text")).select("id", "text", "label", "h"), "labelled")
    size = rows.agg(F.count("*"), F.sum(F.char_length("text"))).first()
    share = max(size[0] / bound, (size[1] or 0) / chars)
    return bounded_by_hash(rows, F.struct("id", "label", "h"), size[0], int(size[0] / share)) if share > 1 else rows


@tidy
def train_quality(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> np.ndarray:
    """Weights, at most 2^BITS + 1 numbers, which come to the driver."""
    rows = training_rows(docs, labels, bound)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, any_ = TrainingSet(), False
        for b in batches:
            found.add(b.column("text").to_pylist(), b.column("label").to_pylist())
            any_ = any_ or b.num_rows > 0
        if any_:
            yield pa.RecordBatch.from_pydict({"w": pa.array([found.fit().astype("<f8").tobytes()])})

    small_batches(docs.sparkSession)
    in_order = rows.repartition(1).sortWithinPartitions(F.xxhash64("id"), "id", "label", "h").select("text", "label")
    found = in_order.mapInArrow(tidied(fit), "w binary").collect()
    return np.frombuffer(found[0][0], "<f8") if found else np.zeros((1 << BITS) + 1)


def score_quality(docs: DataFrame, weights: np.ndarray, name: str = "score", keep: list[str] | None = None) -> DataFrame:
    """docs, or its columns to keep, with the score; a column of that name is replaced."""
    spark = docs.sparkSession
    small_batches(spark)
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() != name.lower()]
    read = docs.select(*[docs[f"`{c}`"] for c in keep], docs["text"].alias("__read"))
    shared = spark.sparkContext.broadcast(weights)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, w = Features(), shared.value
        for b in batches:
            s = [score_text(w, features, t) for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s, pa.float64())], [*keep, name])

    return read.mapInArrow(tidied(scored), StructType([*read.schema.fields[:-1], StructField(name, DoubleType())]))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = train_quality(docs, table(spark, sf_dir, "labels"))
    out = score_quality(docs, weights, keep=["doc_id"])
    return out.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
