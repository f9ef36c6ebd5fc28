"""Token files: independent zstandard frames, an index of documents and a trailing seek table.

    frame 0 .. frame k-1     each FRAME_IDS ids (the last one fewer), little-endian unsigned 32 bit,
                             compressed on its own, so one can be read without the others
    skippable frame          the documents: count, ids, null marks, numbers of ids (zstandard)
    skippable frame          the seek table of the public seekable format: for each frame its
                             compressed and uncompressed size and the low 32 bits of the
                             XXH64 of its content, then a footer

Any zstandard decoder that skips skippable frames reads the ids as one stream. A reader that
wants one document decompresses only the frames that its ids lie in, and checks their sums.

A table becomes one file for each range of document ids. Files are written under a name of
their attempt and then renamed, so a lost executor or a second attempt leaves whole files.

Defined results: null and empty texts have the end id only; rows with a null id come first;
rows of one id go by a hash of their text; repeated rows are written as often as they occur; very
long texts are encoded whole and may span many frames; an empty table gives no files and an empty
result; other columns are ignored. Document ids are integers.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, small_batches, table, tidied, tidy, written
from .tokens import END_ID, default_path, encoder, in_blocks

FRAME_IDS = 1 << 16
LEVEL = 1
#: Rows in a file, about; 8192 documents of usual length are some 30 MB of text.
ROWS_PER_FILE = 8192

# Fixed values of the public zstandard formats.
SKIPPABLE, SEEKABLE, SEEK_FOOTER = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def _content_sum(raw: bytes) -> int:
    return xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF


class TokenWriter:
    """Writes documents one after the other, holding one frame at most besides the index."""

    def __init__(self, out, frame_ids: int = FRAME_IDS, level: int = LEVEL) -> None:
        self._out, self._bytes = out, frame_ids * 4
        self._zstd = zstandard.ZstdCompressor(level=level)
        self._held = bytearray()
        self._frames: list[tuple[int, int, int]] = []
        self._docs: list[int | None] = []
        self._counts: list[int] = []
        self.ids = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit integers."""
        self._docs.append(doc_id)
        self._counts.append(len(ids) // 4)
        self.ids += len(ids) // 4
        self._held += ids
        while len(self._held) >= self._bytes:
            self._flush(bytes(self._held[: self._bytes]))
            del self._held[: self._bytes]

    def _flush(self, raw: bytes) -> None:
        packed = self._zstd.compress(raw)
        self._out.write(packed)
        self._frames.append((len(packed), len(raw), _content_sum(raw)))

    def close(self) -> None:
        if self._held:
            self._flush(bytes(self._held))
        n = len(self._docs)
        index = struct.pack("<Q", n) + np.array([d or 0 for d in self._docs], "<i8").tobytes()
        index += np.array([d is None for d in self._docs], "u1").tobytes() + np.array(self._counts, "<u8").tobytes()
        packed = self._zstd.compress(index)
        self._out.write(struct.pack("<II", SKIPPABLE, len(packed) + 4) + packed + struct.pack("<I", len(packed)))
        table_ = b"".join(struct.pack("<III", *f) for f in self._frames) + struct.pack("<IBI", len(self._frames), CHECKSUMS, SEEK_FOOTER)
        self._out.write(struct.pack("<II", SEEKABLE, len(table_)) + table_)


class TokenReader:
    """Reads documents by place; only the frames asked for are read and decompressed."""

    def __init__(self, source, size: int) -> None:
        self._in, self._zstd = source, zstandard.ZstdDecompressor()
        frames, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_FOOTER or not flags & CHECKSUMS:
            raise ValueError("not a token file")
        table_ = size - 9 - 12 * frames
        entries = np.frombuffer(self._at(table_, 12 * frames), "<u4").reshape(-1, 3).astype(np.int64)
        self._packed, self._raw, self._sums = entries[:, 0], entries[:, 1], entries[:, 2]
        self._begin = np.concatenate(([0], np.cumsum(self._packed)))
        end = table_ - 8  # of the frame of documents, whose last number is its size
        (length,) = struct.unpack("<I", self._at(end - 4, 4))
        index = self._zstd.decompress(self._at(end - 4 - length, length))
        (n,) = struct.unpack_from("<Q", index)
        ids, null = np.frombuffer(index, "<i8", n, 8), np.frombuffer(index, "u1", n, 8 + 8 * n)
        self.docs = [None if z else int(d) for d, z in zip(ids, null, strict=True)]
        self.counts = np.frombuffer(index, "<u8", n, 8 + 9 * n).astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.counts)))
        self._first = np.concatenate(([0], np.cumsum(self._raw))) // 4
        self._kept = (-1, b"")

    def _at(self, offset: int, length: int) -> bytes:
        self._in.seek(int(offset))
        return self._in.read(int(length))

    def frame(self, i: int) -> bytes:
        if self._kept[0] != i:
            raw = self._zstd.decompress(self._at(self._begin[i], self._packed[i]), max_output_size=int(self._raw[i]))
            if len(raw) != self._raw[i] or _content_sum(raw) != self._sums[i]:
                raise ValueError(f"frame {i} is damaged")
            self._kept = (i, raw)
        return self._kept[1]

    def stretches(self, i: int) -> Iterator[bytes]:
        """The ids of document i, a stretch for each frame that it lies in."""
        at, end = int(self.starts[i]), int(self.starts[i + 1])
        f = int(np.searchsorted(self._first, at, "right")) - 1
        while at < end:
            first, last = int(self._first[f]), int(self._first[f + 1])
            upto = min(end, last)
            yield self.frame(f)[(at - first) * 4 : (upto - first) * 4]
            at, f = upto, f + 1

    def ids(self, i: int) -> np.ndarray:
        return np.frombuffer(b"".join(self.stretches(i)), "<u4")


@tidy
def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None, key: str = "doc_id", rows: int = ROWS_PER_FILE, frame_ids: int = FRAME_IDS) -> DataFrame:
    """Encode and write docs in ascending key order; (part, uri, documents, ids, first) of each file.

    first: the ids in all files before it.
    """
    small_batches(docs.sparkSession)
    tokenizer = tokenizer or default_path()
    wanted = docs.select(docs[f"`{key}`"].cast("long").alias("id"), docs["text"].alias("text"))
    parts = max(1, -(-wanted.count() // rows))
    # equal ids are told apart by their text, so that no key is too heavy for a range
    ordered = wanted.repartitionByRange(parts, "id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, writer = encoder(tokenizer), struct.pack("<I", END_ID), None
        part = TaskContext.get().partitionId()
        uri = f"{folder}/part-{part:07d}.tok"
        fs, path = _open(uri)
        trial, n = f"{path}.{uuid.uuid4().hex}", 0
        for b in in_blocks(batches, "text"):
            if writer is None:
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(trial)
                writer = TokenWriter(out, frame_ids)
            n += b.num_rows
            for i, ids in zip(b.column("id").to_pylist(), enc.encode_column(b.column("text")), strict=True):
                writer.add(i, ids + end)
        if writer is not None:
            writer.close()
            out.close()
            fs.move(trial, path)
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int64()), "uri": [uri], "documents": pa.array([n], pa.int64()), "ids": pa.array([writer.ids], pa.int64()),
            })

    files = written(ordered.mapInArrow(tidied(write), "part long, uri string, documents long, ids long"), "token-files")
    # one row for each file
    before = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return files.withColumn("first", F.coalesce(before, F.lit(0)))


def read_digests(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    spark = files.sparkSession

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, first in zip(b.column("uri").to_pylist(), b.column("first").to_pylist(), strict=True):
                fs, path = _open(uri)
                with fs.open_input_file(path) as source:
                    reader = TokenReader(source, source.size())
                    sums = []
                    for i in range(len(reader.docs)):
                        crc = 0
                        for raw in reader.stretches(i):
                            crc = crc32(raw, crc)
                        sums.append(crc)
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(reader.docs, pa.int64()), "start": pa.array(reader.starts[:-1] + first, pa.int64()),
                        "n_tokens": pa.array(reader.counts, pa.int64()), "ids_crc32": pa.array(sums, pa.int64()),
                    })

    parts = max(1, min(int(files.count()), 4 * spark.sparkContext.defaultParallelism))
    return files.repartition(parts, "part").mapInArrow(tidied(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_digests(write_tokens(table(spark, sf_dir, "documents"), scratch(spark, "tokens")))
