"""Words of whole Arrow batches as numpy arrays: spans in one byte buffer, and 64-bit hashes.

A word is a longest run of bytes outside white space (0x20, 0x09-0x0D). Texts stay UTF-8; no Python string
is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

PIECE_BYTES = 4 << 20
LONG_WORD = 512
_U = np.uint64
_MIX1, _MIX2, _STEP = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that separate words made of ASCII digits and letters and of all non-ASCII characters.
NO_LETTER = np.ones(256, bool)
NO_LETTER[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
NO_LETTER_KEEP_CASE = NO_LETTER.copy()
NO_LETTER_KEEP_CASE[0x41:0x5B] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


@dataclass
class Words:
    """Words of the rows [row, row + n) of a batch; `first[i]:first[i + 1]` are those of the i-th of them."""

    row: int
    n: int
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.start[i]:self.end[i]].tobytes()


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte buffer and offsets of a string column without copying; null is empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, values = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    return data[at[0]:at[-1]], at.astype(np.int64) - int(at[0])


def words_of(column: pa.Array, lower: bool = False, breaks: np.ndarray = SPACE, piece: int = PIECE_BYTES) -> Iterator[Words]:
    """The words of a string column, in runs of rows of about `piece` bytes (a longer text is a run of its own)."""
    data, at = text_buffer(column)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(at, at[row] + piece, "right")) - 1)
        part = data[at[row]:at[stop]]
        bounds = at[row:stop + 1] - at[row]
        if lower:
            part = LOWER[part]
        yield spans(part, bounds, row, breaks)
        row = stop


def spans(part: np.ndarray, bounds: np.ndarray, row: int, breaks: np.ndarray) -> Words:
    inside = ~breaks[part]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    firsts = bounds[:-1][bounds[:-1] < len(part)]
    before[firsts] = False
    lasts = bounds[1:][bounds[1:] > 0] - 1
    after[lasts] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(row, len(bounds) - 1, part, start, end, np.searchsorted(start, bounds))


def joined(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The words with one space after each (but not between rows that touch), and where each word begins there."""
    marks = np.zeros(len(w.data) + 1, np.int8)
    marks[w.start] += 1
    marks[w.end] -= 1
    inside = np.cumsum(marks[:-1], dtype=np.int8).astype(bool)
    keep = np.append(inside, False)
    keep[w.end] = True
    data = np.append(w.data, np.uint8(0x20))
    data[:-1][~inside] = 0x20
    return data[keep], (np.cumsum(keep) - 1)[w.start]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    h = (h ^ (h >> _U(30))) * _MIX1
    h = (h ^ (h >> _U(27))) * _MIX2
    return h ^ (h >> _U(31))


def loads(data: np.ndarray) -> np.ndarray:
    """View with the little-endian 64-bit number that begins at each byte."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(padded) - 7,), "<u8", buffer=padded, strides=(1,))


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes; equal bytes have equal hashes in every task."""
    size = end - start
    h = mix(size.astype(_U) * _STEP + _U(1))
    at8 = loads(data)
    rows = np.flatnonzero((size > 0) & (size <= LONG_WORD))
    done = 0
    while len(rows):
        left = size[rows] - done
        x = at8[start[rows] + done]
        keep = np.minimum(left, 8).astype(_U) * _U(8)
        x = np.where(keep >= 64, x, x & ((_U(1) << (keep % _U(64))) - _U(1)))
        h[rows] = mix((h[rows] ^ x) + _STEP)
        done += 8
        rows = rows[left > 8]
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = xxhash.xxh64_intdigest(data[start[i]:end[i]].tobytes())
    return h


def hash_words(w: Words) -> np.ndarray:
    return hash_spans(w.data, w.start, w.end)


def int64(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
