"""Elias-Fano sequences and a two-level n-gram trie over one flat buffer that can be memory-mapped."""

from __future__ import annotations

import mmap

import numpy as np

_U = np.uint64
_ONE = _U(1)
PACK_ROWS = 1 << 16


def _as_words(bits: np.ndarray) -> np.ndarray:
    """Packed bits as 64-bit words, with one spare word."""
    packed = np.packbits(bits, bitorder="little")
    return np.append(packed, np.zeros(16 - len(packed) % 8, np.uint8)).view(_U)


def pack_low(values: np.ndarray, width: int) -> np.ndarray:
    """The low `width` bits of each value, one after the other."""
    if width == 0 or not len(values):
        return np.zeros(2, _U)
    parts = []
    for a in range(0, len(values), PACK_ROWS):
        part = values[a:a + PACK_ROWS].astype("<u8").view(np.uint8).reshape(-1, 8)
        parts.append(np.packbits(np.unpackbits(part, axis=1, bitorder="little")[:, :width].ravel(), bitorder="little"))
    packed = np.concatenate(parts)
    return np.append(packed, np.zeros(16 - len(packed) % 8, np.uint8)).view(_U)


def select_in_words(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Position of the k-th (from 0) one bit of each word."""
    at = np.zeros(len(words), np.int64)
    left = k.copy()
    for width in (32, 16, 8, 4, 2, 1):
        ones = np.bitwise_count((words >> at.astype(_U)) & ((_ONE << _U(width)) - _ONE)).astype(np.int64)
        right = left >= ones
        left -= np.where(right, ones, 0)
        at += np.where(right, width, 0)
    return at


class EliasFano:
    """A monotone sequence: low bits packed, high bits in unary, with a count of ones before each word of 64 bits."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.width, self.low, self.high, self.ones = n, width, low, high, ones
        self.zeros = np.arange(len(ones), dtype=np.int64) * 64 - ones

    @staticmethod
    def build(values: np.ndarray, universe: int) -> "EliasFano":
        """`values` are sorted and below `universe`."""
        n = len(values)
        width = max(0, (universe // max(1, n)).bit_length() - 1)
        top = (values >> width).astype(np.int64)
        bits = np.zeros(n + (universe >> width) + 2, np.uint8)
        bits[top + np.arange(n)] = 1
        high = _as_words(bits)
        ones = np.append(0, np.cumsum(np.bitwise_count(high), dtype=np.int64))[:-1]
        return EliasFano(n, width, pack_low(values, width), high, ones)

    def arrays(self) -> list[np.ndarray]:
        return [self.low, self.high, self.ones]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if self.width == 0:
            return np.zeros(len(i), np.int64)
        at = i.astype(np.int64) * self.width
        word, off = at >> 6, (at & 63).astype(_U)
        up = np.where(off > 0, self.low[word + 1] << ((_U(64) - off) & _U(63)), _U(0))
        return (((self.low[word] >> off) | up) & ((_ONE << _U(self.width)) - _ONE)).astype(np.int64)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th zero of the unary part."""
        word = np.searchsorted(self.zeros, k, "right") - 1
        return word * 64 + select_in_words(~self.high[word], k - self.zeros[word])

    def access(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i, "right") - 1
        at = word * 64 + select_in_words(self.high[word], i - self.ones[word])
        return ((at - i) << self.width) | self._low(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first element that isn't below x; n if there is none. x is below the universe."""
        top = x >> self.width
        begin = np.where(top > 0, self._zero(np.maximum(top - 1, 0)) - np.maximum(top - 1, 0), 0)
        end = self._zero(top) - top
        want = x & ((1 << self.width) - 1)
        while True:
            open_ = np.flatnonzero(begin < end)
            if not len(open_):
                return begin
            mid = (begin[open_] + end[open_]) >> 1
            less = self._low(mid) < want[open_]
            begin[open_] = np.where(less, mid + 1, begin[open_])
            end[open_] = np.where(less, end[open_], mid)


def quantise(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """16-bit codes on an even grid from the least to the greatest value; and (least, step)."""
    lo, hi = (float(values.min()), float(values.max())) if len(values) else (0.0, 0.0)
    step = (hi - lo) / 65535 or 1.0
    return np.rint((values - lo) / step).astype(np.uint16), np.array([lo, step])


class Trie:
    """Words, and under each word the words that come before it.

    Level 1 has the words in order of their hashes with counts; a pointer sequence gives each word its range in level 2.
    Level 2 holds, range by range, the contexts by their rank among the trie's contexts; adding word number times number of contexts
    makes the whole level one monotone sequence, so a context is looked up relative to its word by one successor search. Each entry has a
    quantised value; `floor` is the quantised value of a pair that isn't there.
    """

    NAMES = ("words", "counts", "contexts", "floor", "floor_grid", "codes", "grid", "pointer_low", "pointer_high", "pointer_ones", "child_low", "child_high", "child_ones", "shape")

    def __init__(self, parts: dict[str, np.ndarray]):
        self.parts = parts
        pairs, pointer_width, child_width = (int(x) for x in parts["shape"])
        self.words, self.counts, self.contexts = parts["words"], parts["counts"], parts["contexts"]
        self.pointers = EliasFano(len(self.words) + 1, pointer_width, parts["pointer_low"], parts["pointer_high"], parts["pointer_ones"])
        self.children = EliasFano(pairs, child_width, parts["child_low"], parts["child_high"], parts["child_ones"])

    @staticmethod
    def build(words: np.ndarray, counts: np.ndarray, pair_word: np.ndarray, pair_context: np.ndarray, pair_value: np.ndarray, floor: np.ndarray) -> "Trie":
        """words: sorted hashes. pair_word: word number of each pair, pairs sorted by (word, context). pair_context: context hashes."""
        contexts, rank = np.unique(pair_context, return_inverse=True)
        span = max(1, len(contexts))
        ends = np.append(0, np.cumsum(np.bincount(pair_word, minlength=len(words))))
        pointers = EliasFano.build(ends, len(pair_word) + 1)
        children = EliasFano.build(pair_word.astype(np.int64) * span + rank, max(1, len(words) * span))
        codes, grid = quantise(pair_value)
        floor_codes, floor_grid = quantise(floor)
        low = dict(zip(("pointer_low", "pointer_high", "pointer_ones"), pointers.arrays())) | dict(zip(("child_low", "child_high", "child_ones"), children.arrays()))
        return Trie(low | {"words": words, "counts": counts, "contexts": contexts, "floor": floor_codes, "floor_grid": floor_grid, "codes": codes, "grid": grid,
                           "shape": np.array([len(pair_word), pointers.width, children.width], np.int64)})

    def image(self) -> bytes:
        """The levels one after the other, behind a directory of their types and sizes."""
        arrays = [np.ascontiguousarray(self.parts[n]) for n in self.NAMES]
        head = np.array([[ord(a.dtype.kind), a.dtype.itemsize, len(a)] for a in arrays], np.int64).tobytes()
        return head + b"".join(a.tobytes() + bytes(-a.nbytes % 8) for a in arrays)

    @staticmethod
    def view(buffer) -> "Trie":
        """A trie over bytes or a memory map; nothing is copied."""
        head = np.frombuffer(buffer, np.int64, 3 * len(Trie.NAMES)).reshape(-1, 3)
        at, parts = head.nbytes, {}
        for name, (kind, size, n) in zip(Trie.NAMES, head.tolist()):
            parts[name] = np.frombuffer(buffer, f"{chr(kind)}{size}", n, at)
            at += n * size + -(n * size) % 8
        return Trie(parts)

    def mapped(self) -> "Trie":
        """The same trie in anonymous mapped memory, which the system may page out."""
        image = self.image()
        area = mmap.mmap(-1, len(image))
        area.write(image)
        return Trie.view(area)

    def number(self, words: np.ndarray) -> np.ndarray:
        """Word numbers; -1 for unknown words."""
        if not len(self.words):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, at, -1)

    def lookup(self, number: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Value of each (word number, context hash); the word's floor where the pair isn't there."""
        lo, step = self.parts["floor_grid"]
        out = lo + step * self.parts["floor"][number].astype(float)
        if not self.children.n:
            return out
        rank = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
        known = np.flatnonzero(self.contexts[rank] == context)
        word = number[known].astype(np.int64)
        begin, end = self.pointers.access(word), self.pointers.access(word + 1)
        want = word * len(self.contexts) + rank[known]
        at = self.children.successor(want)
        there = (at >= begin) & (at < end)
        there[there] = self.children.access(at[there]) == want[there]
        lo, step = self.parts["grid"]
        out[known[there]] = lo + step * self.parts["codes"][at[there]].astype(float)
        return out
