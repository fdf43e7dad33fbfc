"""FM-index of word numbers: a wavelet matrix over the Burrows-Wheeler transform, searched backward for many patterns at once."""

from __future__ import annotations

import numpy as np

DEPTH = 32


class WaveletMatrix:
    """Symbols as one bit vector per bit of the alphabet, packed to words of 64 bits with a running count each."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        now = symbols
        for shift in range(bits - 1, -1, -1):
            one = ((now >> shift) & 1).astype(bool)
            packed = np.packbits(one, bitorder="little")
            packed = np.append(packed, np.zeros(16 - len(packed) % 8, np.uint8)).view(np.uint64)
            before = np.append(0, np.cumsum(np.bitwise_count(packed), dtype=np.int64))[:-1].astype(np.int32)
            zeros = len(now) - int(one.sum())
            self.levels.append((packed, before, zeros))
            now = np.concatenate([now[~one], now[one]])
        self.bits = bits

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        low = np.zeros(len(at), np.int64)
        for (packed, before, zeros), shift in zip(self.levels, range(self.bits - 1, -1, -1)):
            both = np.concatenate([low, at])
            word = both >> 6
            ones = before[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (both & 63).astype(np.uint64)) - np.uint64(1)))
            up = ((symbols >> shift) & 1).astype(bool)
            both = np.where(np.concatenate([up, up]), zeros + ones, both - ones)
            low, at = both[:len(low)], both[len(low):]
        return at - low


class FMIndex:
    """Index of a text of numbers from 1 on; 0 separates its documents.

    Suffixes are sorted by their first DEPTH symbols, which is all that patterns shorter than that can tell apart. For
    patterns of `window` symbols the index knows the interval of their suffixes and the least `value` of a place there.
    """

    def __init__(self, text: np.ndarray, window: int, value: np.ndarray):
        assert 1 < window < DEPTH
        n = len(text)
        ranks = {1: text.astype(np.int64)}
        size = 1
        while size < DEPTH:
            ranks[2 * size] = _pair(ranks[size], ranks[size], size)
            size *= 2
        suffixes = np.argsort(ranks[DEPTH], kind="stable")
        prefix, have = None, 0
        for size in sorted(ranks, reverse=True):
            if have + size <= window:
                prefix = ranks[size] if prefix is None else _pair(prefix, ranks[size], have)
                have += size
        del ranks
        self.symbols = int(text.max(initial=0)) + 1
        self.before = np.searchsorted(text[suffixes], np.arange(self.symbols + 1))
        self.bwt = WaveletMatrix(text[suffixes - 1], max(1, int(self.symbols - 1).bit_length()))
        new = np.concatenate([[True], prefix[suffixes[1:]] != prefix[suffixes[:-1]]]) if n else np.zeros(0, bool)
        self.group = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        self.group_start, self.group_end = starts, np.append(starts[1:], n)
        self.least = np.minimum.reduceat(value[suffixes], starts) if n else value
        self.n, self.window = n, window

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals after putting a symbol before each pattern."""
        base = self.before[symbols]
        ranks = self.bwt.rank(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
        return base + ranks[:len(low)], base + ranks[len(low):]

    def least_of_windows(self, text: np.ndarray, first: np.ndarray, last: np.ndarray, absent: int) -> np.ndarray:
        """For documents text[first:last], read from the right: at each place, the least value of a place where the same `window` symbols begin.

        `absent` where the window occurs nowhere in the index or doesn't fit. Symbols unknown to the index are 0. All
        documents advance together. Once `window` symbols match, each further symbol extends the match to the left and the interval is
        widened again to the first `window` symbols. Where nothing matches, the search starts again one place further left than its
        last end, so no window is missed.
        """
        out = np.full(len(text), absent, np.int64)
        live = np.flatnonzero(last - first >= self.window)
        end = last[live].copy()  # right end of the current match
        at = end.copy()
        stop = first[live]
        low, high = np.zeros(len(live), np.int64), np.full(len(live), self.n)
        while len(live):
            symbol = text[at - 1]
            known = (symbol > 0) & (symbol < self.symbols)
            lo, hi = self.extend(np.where(known, symbol, 0), low, high)
            good = known & (lo < hi)
            at = np.where(good, at - 1, at)
            size = end - at
            full = good & (size >= self.window)
            if full.any():
                group = self.group[lo[full]]
                lo[full], hi[full] = self.group_start[group], self.group_end[group]
                out[at[full]] = self.least[group]
                end = np.where(full, at + self.window, end)
            # an unknown symbol ends every window over it; a failed step ends those that begin left of it and reach this end
            end = np.where(good, end, np.where(known, end - 1, at - 1))
            at = np.where(good, at, end)
            low, high = np.where(good, lo, 0), np.where(good, hi, self.n)
            go = end - stop >= self.window
            go &= at > stop
            live, end, at, stop, low, high = live[go], end[go], at[go], stop[go], low[go], high[go]
        return out


def _pair(a: np.ndarray, b: np.ndarray, shift: int) -> np.ndarray:
    """Dense ranks of (a[i], b[i + shift]); nothing after the end."""
    after = np.zeros(len(a), np.int64)
    after[:max(0, len(a) - shift)] = b[shift:] + 1
    return np.unique(a * (int(b.max(initial=0)) + 2) + after, return_inverse=True)[1]
