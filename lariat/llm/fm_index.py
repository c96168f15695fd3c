"""An FM-index over word ids in NumPy: suffix sorting by prefix doubling, a wavelet matrix with popcount ranks, backward search, and location by sampled suffix positions. All searches run for many patterns at once."""

from __future__ import annotations

import numpy as np

SAMPLE = 16
_ONE = np.uint64(1)


def suffix_array(x: np.ndarray) -> np.ndarray:
    """Sorted suffixes of x, whose last symbol must be unique; equal prefixes must differ before the end (unique separators see to that)."""
    n = len(x)
    bits = max(1, int(x.max()).bit_length())
    h = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for j in range(h):
        key <<= bits
        key[: n - j] |= x[j:]
    sa = np.argsort(key)
    rank = np.empty(n, np.int64)
    s = key[sa]
    new = np.concatenate(([True], s[1:] != s[:-1]))
    del key, s
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, n))
    rank[sa] = np.repeat(starts, sizes)
    todo = np.flatnonzero(np.repeat(sizes > 1, sizes))
    while len(todo):
        p = sa[todo]
        key = (rank[p] << 32) | rank[np.minimum(p + h, n - 1)]
        o = np.argsort(key)
        p, key = p[o], key[o]
        sa[todo] = p
        new = np.concatenate(([True], key[1:] != key[:-1]))
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(todo)))
        rank[p] = np.repeat(todo[starts], sizes)
        todo = todo[np.repeat(sizes > 1, sizes)]
        h *= 2
    return sa


class Bits:
    """A bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(np.concatenate((bits.astype(np.uint8), np.zeros(64 - n % 64, np.uint8))), bitorder="little")
        self.words = packed.view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int32)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])
        self.ones = int(self.before[-1])
        self.n = n

    def rank1(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        return self.before[w] + np.bitwise_count(self.words[w] & ((_ONE << (i & 63).astype(np.uint64)) - _ONE)).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & _ONE != 0


class WaveletMatrix:
    """rank(symbol, i) over a sequence of small integers, one bit vector a level."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits: list[Bits] = []
        self.zeros: list[int] = []
        for level in range(self.levels - 1, -1, -1):
            b = (seq >> level) & 1 != 0
            self.bits.append(Bits(b))
            self.zeros.append(len(seq) - self.bits[-1].ones)
            seq = np.concatenate((seq[~b], seq[b]))

    def descend(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Place of prefix length i after following each symbol's bits; descend(c, i) - descend(c, 0) is the rank."""
        for level, (bits, zeros) in enumerate(zip(self.bits, self.zeros, strict=True)):
            one = (symbols >> (self.levels - 1 - level)) & 1 != 0
            r = bits.rank1(i)
            i = np.where(one, zeros + r, i - r)
        return i

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol at i, place of i after following it)."""
        symbols = np.zeros(len(i), np.int64)
        for bits, zeros in zip(self.bits, self.zeros, strict=True):
            one, r = bits.get(i), bits.rank1(i)
            symbols = symbols * 2 + one
            i = np.where(one, zeros + r, i - r)
        return symbols, i


class FMIndex:
    """Over documents of 64-bit word hashes; each document ends in a separator of its own, so no match crosses documents."""

    def __init__(self, docs: list[np.ndarray], sample: int = SAMPLE):
        lengths = np.array([len(d) for d in docs], np.int64)
        ends = np.cumsum(lengths + 1) - 1  # the separators' places
        self.starts = ends - lengths
        n = int(ends[-1]) + 1 if len(docs) else 0
        self.n, k = n, len(docs)
        words = np.concatenate(docs) if len(docs) else np.empty(0, np.int64)
        self.vocabulary, ids = np.unique(words, return_inverse=True)
        x = np.empty(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends] = False
        x[inside] = ids + k
        x[ends] = np.arange(k)
        del words, ids
        sa = suffix_array(x)
        symbols = np.where(inside, x - k + 1, 0)  # 0: any separator
        counts = np.bincount(symbols, minlength=len(self.vocabulary) + 1)
        self.first = np.concatenate(([0], np.cumsum(counts)))
        self.wavelet = WaveletMatrix(symbols[sa - 1], len(self.vocabulary) + 1)
        self.zero = self.wavelet.descend(np.arange(len(self.vocabulary) + 1), np.zeros(len(self.vocabulary) + 1, np.int64))
        # Every sample-th position of the text, and each document's start: walking back never meets a separator.
        kept = sa % sample == 0
        start = np.zeros(n, bool)
        start[self.starts] = True
        kept |= start[sa]
        self.marked = Bits(kept)
        self.positions = sa[kept]

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Symbols of word hashes; 0 if the word isn't in the index."""
        if not len(self.vocabulary):
            return np.zeros(hashes.shape, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def extend(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward step: intervals of symbol + pattern."""
        base = self.first[symbols] - self.zero[symbols]
        return base + self.wavelet.descend(symbols, lo), base + self.wavelet.descend(symbols, hi)

    def search(self, patterns: np.ndarray, lengths: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of each pattern (rows of symbols, padded on the right); empty where it doesn't occur ``least`` times: such a search ends at the step that shows it."""
        return self.matching(patterns, lengths, least)[1:]

    def matching(self, patterns: np.ndarray, lengths: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(matching statistic, lo, hi): how many of each pattern's last words occur together ``least`` times, by steps of backward search; and the suffix interval of those that match whole, else an empty one."""
        m = len(patterns)
        matched = np.zeros(m, np.int64)
        lo, hi = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        for step in range(int(lengths.max(initial=0))):
            live = np.flatnonzero((lengths > step) & (hi > lo))
            if not len(live):
                break
            s = patterns[live, lengths[live] - 1 - step]
            a, b = self.extend(s, lo[live], hi[live])
            gone = s == 0
            gone |= b - a < least
            lo[live], hi[live] = np.where(gone, 0, a), np.where(gone, 0, b)
            matched[live] += ~gone
        return matched, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk back to a sampled one."""
        rows = rows.copy()
        out = np.zeros(len(rows), np.int64)
        todo = np.arange(len(rows))
        steps = 0
        while len(todo):
            r = rows[todo]
            done = self.marked.get(r)
            out[todo[done]] = self.positions[self.marked.rank1(r[done])] + steps
            todo = todo[~done]
            if len(todo):
                s, at = self.wavelet.access(rows[todo])
                rows[todo] = self.first[s] + at - self.zero[s]
            steps += 1
        return out

    def occurrences(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern number, text position) of every occurrence."""
        sizes = np.maximum(hi - lo, 0)
        which = np.repeat(np.arange(len(lo)), sizes)
        rows = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(lo, sizes)
        return which, self.locate(rows)
