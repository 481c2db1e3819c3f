"""Vectorised words, lines and rolling hashes over Arrow text columns.

A word is a run of bytes other than space and 0x09-0x0D. Everything works on
the UTF-8 buffer of a record batch, a few megabytes at a time, so memory is
bounded by ``CHUNK_BYTES`` or by the longest single text. Null text counts as
empty. Hashes are 64 bits wide and depend on content only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: close inputs give unrelated outputs."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(1 << max(16, (n + 1).bit_length()))
    return up[:n], down[:n]


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each span, by one prefix sum."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=total[1:])
    raw = (total[ends] - total[starts]) * down[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def per_doc(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of mask over each document's range."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


class Chunk:
    """Some documents: their bytes, where each begins, and their words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.raw, self.offsets = data, offsets
        self.data = _LOWER[data] if lower else data
        self.n = len(offsets) - 1
        self.nonspace = ~_SPACE[data]
        self.starts, self.ends = self._runs(self.nonspace)
        self.doc = np.searchsorted(offsets, self.starts, side="right") - 1
        counts = np.bincount(self.doc, minlength=self.n) if self.n else np.zeros(0, np.int64)
        self.n_words = counts.astype(np.int64)
        self.word_offsets = np.concatenate([[0], np.cumsum(self.n_words)])

    def _runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = len(inside)
        first, last = np.zeros(size + 1, bool), np.zeros(size + 1, bool)
        first[:size] = inside
        first[1:size] &= ~inside[:-1]
        last[1:] = inside
        last[1:size] &= ~inside[1:]
        cuts = self.offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < size)]
        first[cuts] = inside[cuts]
        last[cuts] = inside[cuts - 1]
        return np.flatnonzero(first), np.flatnonzero(last)

    def hashes(self) -> np.ndarray:
        return spans_hash(_BYTE[self.data], self.starts, self.ends)

    def rolling(self, k: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Positions (word index in the chunk) and hashes of all k-word windows inside one document."""
        hashes = self.hashes() if hashes is None else hashes
        count = len(hashes) - k + 1
        if count <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[:count] == self.doc[k - 1 :])
        return at, spans_hash(hashes, at, at + k)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document of each \\n-split line, empty lines of non-empty texts included."""
        breaks = np.flatnonzero(self.raw == 10)
        starts = np.sort(np.concatenate([self.offsets[:-1], breaks + 1]))
        doc_of_break = np.searchsorted(self.offsets, breaks, side="right") - 1
        per = np.bincount(doc_of_break, minlength=self.n) + 1
        doc = np.repeat(np.arange(self.n), per)
        starts = np.concatenate([self.offsets[:-1], breaks + 1])
        order = np.argsort(np.concatenate([np.arange(self.n), doc_of_break]) * 1.0, kind="stable")
        starts = starts[order]
        ends = np.concatenate([starts[1:] - 1, [len(self.raw)]]) if len(starts) else starts
        tail = np.cumsum(per) - 1
        ends[tail] = self.offsets[1:]
        return starts, ends, doc

    def text(self, i: int) -> bytes:
        return self.raw[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def words(self, i: int) -> list[bytes]:
        return self.text(i).split()


def _text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def chunks(batch: pa.RecordBatch, column: str = "text", lower: bool = False, size: int = CHUNK_BYTES) -> Iterator[tuple[int, Chunk]]:
    """(index of the first row, chunk) over a batch; a chunk ends once it holds ``size`` bytes."""
    if not batch.num_rows:
        return
    data, offsets = _text_buffers(batch.column(batch.schema.get_field_index(column)))
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
        end = min(end, batch.num_rows)
        part = offsets[row : end + 1]
        yield row, Chunk(data[part[0] : part[-1]], part - part[0], lower)
        row = end


#: Bytes that belong to a term: ASCII letters and digits, and all of any other script.
TERM = np.zeros(256, bool)
TERM[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")] = True
TERM[128:] = True
_BLANKED = np.where(TERM, np.arange(256), 32).astype(np.uint8)


def terms(chunk: Chunk) -> Chunk:
    """The chunk with every byte outside terms as a space, in lower case (A-Z, and the Latin-1 capitals of UTF-8)."""
    data = _BLANKED[chunk.raw]
    latin = np.zeros(len(data), bool)
    latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    data[latin] += 32
    return Chunk(data, chunk.offsets, lower=True)


def byte_hashes(chunk: Chunk) -> np.ndarray:
    """The bytes' own random numbers, for spans_hash over parts of words."""
    return _BYTE[chunk.data]
