"""Encoding of texts with a public tokenizer, the pieces of texts once each.

A byte-level BPE never merges across its pre-tokens, and no pre-token goes on over a space
or line feed that a non-space character follows. Texts are therefore cut before each of these.
The pieces of a block of texts are made distinct column-wise, and the library encodes those
that a bounded memo does not hold. Texts with other white space, or with runs of it, are cut
one by one by the same rule; texts that hold the string of a special token, or a NUL, are given
to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The memo takes so many pieces, of so many bytes at most; it is some 40 bytes a piece.
MEMO_PIECES, MEMO_BYTES = 700_000, 40
#: Bytes of text in a block, about, and new words that the library gets as lines of one text.
BLOCK_BYTES, LINES = 5_000_000, 1000
DEFAULT_TOKENIZER = "byte_bpe_50k.json"
END_ID = 0

#: Marks the start of a text, as its first piece has no space before it.
_START = "\x00"
_CUT = re.compile(r"(?=[ \n]\S)")
_SPACE = re.compile(r"[\s᠎]")
#: Texts that a cut at every space and line feed would not cut by the rule.
_IRREGULAR = r"^[ \n]|[ \n]$|[ \n][ \n]|[\x00\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_encoders: dict[str, Encoder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_TOKENIZER)


def in_blocks(batches: Iterator[pa.RecordBatch], column: str, size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches joined to blocks of about so many bytes in the column, as each block costs one look at the memo."""
    held: list[pa.RecordBatch] = []
    total = 0
    for b in batches:
        held.append(b)
        total += b.column(column).nbytes
        if total >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, total = [], 0
    if any(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


class Encoder:
    """Token ids of texts, as the library's encode() gives them without added special tokens."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._special = sorted(t.content for t in self._tokenizer.get_added_tokens_decoder().values())
        (self._line_feed,) = self._tokenizer.encode("\n", add_special_tokens=False).ids
        #: Pieces, without their leading space if they have one; and where their ids are in _ids.
        self._known = pa.array([], pa.string())
        self._ids, self._ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _texts(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Words without white space, each after a space: a line feed between two stays apart."""
        out: list[bytes] = []
        for raw in self._texts([" " + "\n ".join(words[i : i + LINES]) for i in range(0, len(words), LINES)]):
            cuts = np.flatnonzero(np.frombuffer(raw, np.uint32) == self._line_feed) * 4
            begins, ends = [0, *(cuts + 4).tolist()], [*cuts.tolist(), len(raw)]
            out += [raw[i:j] for i, j in zip(begins, ends, strict=True)]
        return out

    def _new(self, keys: list[str]) -> list[bytes]:
        """Ids of distinct pieces by key, from the library."""
        plain = [k for k in keys if k and k[0] not in "\x00\n"]
        if _SPACE.search("".join(plain)):
            plain = [k for k in plain if not _SPACE.search(k)]
        found = dict(zip(plain, self._words(plain), strict=True))
        rest = [k for k in keys if k not in found]
        # a piece that starts with a line feed and then text was cut there
        said = [k[1:] if k[:1] == _START else k if k[:1] == "\n" and k[1:2].strip() else " " + k for k in rest]
        found.update(zip(rest, self._texts(said), strict=True))
        return [found[k] for k in keys]

    def _pieces(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct pieces: ids, and the first and the number of each one's."""
        at = pc.index_in(keys, value_set=self._known)
        missing = at.is_null()
        new = keys.filter(missing)
        raw = self._new(new.to_pylist())
        size = np.fromiter(map(len, raw), np.int64, len(raw)) >> 2
        ids = np.concatenate((self._ids, np.frombuffer(b"".join(raw), np.uint32)))
        ends = np.concatenate((self._ends, self._ends[-1] + np.cumsum(size)))
        place = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        place[missing.to_numpy(zero_copy_only=False)] = len(self._known) + np.arange(len(raw))
        begin = ends[place]
        room = MEMO_PIECES - len(self._known)
        if room > 0 and len(raw):
            short = pc.and_(pc.less_equal(pc.binary_length(new), MEMO_BYTES), pc.invert(pc.starts_with(new, _START)))
            keep = np.flatnonzero(short.to_numpy(zero_copy_only=False))[:room]
            self._known = pa.concat_arrays([self._known, new.take(pa.array(keep))])
            self._ids = np.concatenate((self._ids, np.frombuffer(b"".join([raw[i] for i in keep.tolist()]), np.uint32)))
            self._ends = np.concatenate((self._ends, self._ends[-1] + np.cumsum(size[keep])))
        return ids, begin, ends[place + 1] - begin

    def _joined(self, words: pa.Array, bounds: np.ndarray) -> list[bytes]:
        """Ids of texts, which are runs of pieces."""
        distinct = words.dictionary_encode()
        ids, begin, size = self._pieces(distinct.dictionary)
        at = distinct.indices.to_numpy()
        each = size[at].astype(np.int32)
        end = np.cumsum(each, dtype=np.int64)
        total = int(end[-1]) if len(end) else 0
        tokens = ids[np.repeat((begin[at] - end + each).astype(np.int32), each) + np.arange(total, dtype=np.int32)]
        cuts = np.concatenate(([0], end))[bounds].tolist()
        return [tokens[i:j].tobytes() for i, j in zip(cuts, cuts[1:], strict=False)]

    @staticmethod
    def _cut(text: str) -> list[str]:
        first, *rest = _CUT.split(text)
        if first == "" and rest:
            first, *rest = rest
        return [_START + first, *[p[1:] if p[0] == " " else p for p in rest]]

    def encode_column(self, texts: pa.Array) -> list[bytes]:
        """For each text its ids, as little-endian unsigned 32-bit integers; null is the empty text."""
        out: list[bytes] = [b""] * len(texts)
        full = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False).to_numpy(zero_copy_only=False)
        odd = pc.fill_null(pc.match_substring_regex(texts, _IRREGULAR), False).to_numpy(zero_copy_only=False)
        for special in self._special:
            odd |= pc.fill_null(pc.match_substring(texts, special), False).to_numpy(zero_copy_only=False)
        regular = np.flatnonzero(full & ~odd)
        if len(regular):
            marked = pc.binary_join_element_wise(_START, texts.take(pa.array(regular)), "")
            words = pc.split_pattern(pc.replace_substring(marked, "\n", " \n"), " ")
            for i, ids in zip(regular.tolist(), self._joined(words.flatten(), words.offsets.to_numpy() - words.offsets[0].as_py()), strict=True):
                out[i] = ids
        rest = np.flatnonzero(full & odd).tolist()
        said = [texts[i].as_py() for i in rest]
        whole = [any(mark in text for mark in (_START, *self._special)) for text in said]
        for i, text, uncut in zip(rest, said, whole, strict=True):
            if uncut:
                (out[i],) = self._texts([text])
        cut = [(i, self._cut(t)) for i, t, uncut in zip(rest, said, whole, strict=True) if not uncut]
        if cut:
            bounds = np.cumsum([0, *[len(k) for _, k in cut]])
            for (i, _), ids in zip(cut, self._joined(pa.array([k for _, ks in cut for k in ks], pa.string()), bounds), strict=True):
                out[i] = ids
        return out

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode_column(pa.array([text], pa.string()))[0], "<u4")


def encoder(path: str) -> Encoder:
    """One for each worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
