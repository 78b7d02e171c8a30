"""Suffix arrays by induced sorting over ranked prefixes, and permuted common prefixes, on NumPy arrays."""

from __future__ import annotations

import numpy as np


def types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the one after it (the last counts as such)."""
    n = len(t)
    step = np.ones(n, np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int64) - t[:-1])
    where = np.where(step != 0, np.arange(n), n - 1)
    return step[np.minimum.accumulate(where[::-1])[::-1]] > 0


def leftmost(small: np.ndarray) -> np.ndarray:
    """Smaller suffixes whose left neighbour is larger."""
    return np.flatnonzero(small[1:] & ~small[:-1]) + 1


class Buckets:
    """Places filled in the order of arrival, one run of places for each symbol."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.first = np.zeros(sigma + 1, np.int64)
        np.cumsum(np.bincount(symbols, minlength=sigma), out=self.first[1:])
        self.head = self.first[:-1].copy()
        self.at = np.empty(len(symbols), np.int64)

    def put(self, suffixes: np.ndarray, symbols: np.ndarray) -> None:
        if len(suffixes) == 0:
            return
        order = np.argsort(symbols, kind="stable")
        s = symbols[order]
        new = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        count = np.diff(np.append(new, len(s)))
        within = np.arange(len(s)) - np.repeat(new, count)
        self.at[self.head[s] + within] = suffixes[order]
        self.head[s[new]] += count

    def induce(self, suffixes: np.ndarray, t: np.ndarray, mine: np.ndarray) -> None:
        before = suffixes[suffixes > 0] - 1
        before = before[mine[before]]
        self.put(before, t[before])

    def own(self, c: int, t: np.ndarray, mine: np.ndarray) -> None:
        """Induces from the suffixes of symbol ``c``, those it induces into itself included."""
        lo = self.first[c]
        while (hi := self.head[c]) > lo:
            self.induce(self.at[lo:hi], t, mine)
            lo = hi

    def full(self, lo: int, hi: int) -> np.ndarray:
        return self.head[lo:hi] == self.first[lo + 1 : hi + 1]


#: Symbols looked at together in a sweep.
AHEAD = 512
#: Bits of a key of ranks.
KEY = 63


def in_order(symbols: np.ndarray, *parts: np.ndarray) -> np.ndarray:
    both = np.concatenate(parts)
    return both[np.argsort(symbols[both], kind="stable")]


def induced(t: np.ndarray, sigma: int, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes, in the order that the given order of the leftmost-smaller ones implies.

    One sweep up over the symbols places the larger suffixes, one sweep down the smaller.  A
    symbol whose places are all taken can induce no more into itself, so a run of
    such symbols is one array step; only a symbol with places left is swept by itself."""
    start = np.concatenate(([0], np.cumsum(np.bincount(t[lms], minlength=sigma))))
    seeds = lms[np.argsort(t[lms], kind="stable")]
    large = ~small
    larger = Buckets(t[large], sigma)
    c = 0
    while c < sigma:
        full = larger.full(c, min(c + AHEAD, sigma))
        hi = c + (len(full) if full.all() else int(np.argmin(full)))
        if hi == c:
            larger.own(c, t, large)
            larger.induce(seeds[start[c] : start[c + 1]], t, large)
            c += 1
        else:
            larger.induce(in_order(t, larger.at[larger.first[c] : larger.first[hi]], seeds[start[c] : start[hi]]), t, large)
            c = hi
    smaller = Buckets(t[small], sigma)
    smaller.put(np.array([len(t) - 1]), t[-1:])  # the closing symbol, the only one of its kind
    down, c = -t, sigma
    while c > 0:
        full = smaller.full(max(0, c - AHEAD), c)[::-1]
        lo = c - (len(full) if full.all() else int(np.argmin(full)))
        if lo == c:
            lo = c - 1
            smaller.own(lo, t, small)
            smaller.induce(larger.at[larger.first[lo] : larger.first[c]][::-1], t, small)
        else:
            smaller.induce(in_order(down, smaller.at[smaller.first[lo] : smaller.first[c]], larger.at[larger.first[lo] : larger.first[c]][::-1]), t, small)
        c = lo
    out = np.empty(len(t), np.int64)
    size_l, size_s = np.diff(larger.first), np.diff(smaller.first)
    begin = np.concatenate(([0], np.cumsum(size_l + size_s)[:-1]))
    out[np.repeat(begin - larger.first[:-1], size_l) + np.arange(len(larger.at))] = larger.at
    # the smaller ones came from the right end of their symbol's run
    out[np.repeat(begin + size_l + size_s - 1 + smaller.first[:-1], size_s) - np.arange(len(smaller.at))] = smaller.at
    return out


def ranked(t: np.ndarray) -> np.ndarray:
    """Suffix array of ``t``, whose last symbol is 0 and occurs only there, by ranks of prefixes.

    Names of substrings are far too many symbols for sweeps.  A round sorts the suffixes that are
    still level by the ranks of their first three runs of ``h`` symbols (two, where three ranks exceed
    ``KEY`` bits).  A suffix with the last symbol in its first run is level with no other."""
    n, h = len(t), 1
    bits = n.bit_length()
    times = 3 if 3 * bits <= KEY else 2
    rank, sa, live = t.astype(np.int64), np.arange(n), np.arange(n)
    while len(live):
        at = sa[live]
        key = rank[at]
        for k in range(1, times):
            key = key << bits | rank[np.minimum(at + k * h, n - 1)]
        order = np.argsort(key)
        at, key = at[order], key[order]
        lead = np.concatenate(([True], key[1:] != key[:-1]))
        sa[live] = at
        rank[at] = live[np.maximum.accumulate(np.where(lead, np.arange(len(live)), 0))]
        live = live[~(lead & np.append(lead[1:], True))]
        h *= times
    return sa


def build(t: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix array of ``t``, whose last symbol is 0 and occurs only there."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    t = t.astype(np.int16 if sigma < 1 << 15 else np.int64, copy=False)  # short symbols are sorted by radix
    small = types(t)
    lms = leftmost(small)
    if len(lms) > 1:
        # sorts the leftmost-smaller substrings, then names them in that order
        sa = induced(t, sigma, small, lms)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        order = sa[is_lms[sa]]
        length = np.zeros(n, np.int64)
        length[lms[:-1]] = np.diff(lms) + 1
        length[lms[-1]] = 1
        a, b = order[:-1], order[1:]
        same = length[a] == length[b]
        live, k = np.flatnonzero(same), 0
        while len(live):
            live = live[length[a[live]] > k]
            differ = t[a[live] + k] != t[b[live] + k]
            same[live[differ]] = False
            live = live[~differ]
            k += 1
        name = np.empty(n, np.int64)
        name[order] = np.concatenate(([0], np.cumsum(~same)))
        reduced = name[lms]
        lms = order if name[order[-1]] == len(lms) - 1 else lms[ranked(reduced)]
    return induced(t, sigma, small, lms)


def permuted_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position, the common prefix of its suffix and the one before it in the array.

    Where both are preceded by the same symbol the value is that of the position before, less one;
    only the others are compared, four symbols (of at most 16 bits) at a time.  No comparison passes the
    last symbol, which occurs only there."""
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    fresh = np.ones(n, bool)
    fresh[1:] = (phi[1:] < 1) | (phi[1:] - 1 != phi[:-1])
    same = np.flatnonzero(~fresh)
    fresh[same] = t[same - 1] != t[phi[same] - 1]
    four = np.zeros(n + 3, np.uint64)
    four[:n] = t
    four = four[:n] | four[1 : n + 1] << np.uint64(16) | four[2 : n + 2] << np.uint64(32) | four[3:] << np.uint64(48)
    out = np.zeros(n, np.int64)
    live = np.flatnonzero(fresh & (phi >= 0))
    a, b = live.copy(), phi[live]
    while len(live):
        differ = four[a] ^ four[b]
        last = differ != 0
        end = differ[last]
        out[live[last]] = a[last] - live[last] + sum(((end & np.uint64((1 << 16 * k) - 1)) == 0).astype(np.int64) for k in (1, 2, 3))
        live, a, b = live[~last], a[~last] + 4, b[~last] + 4
    i = np.arange(n)
    lead = np.maximum.accumulate(np.where(fresh, i, 0))
    return np.maximum(out[lead] - (i - lead), 0)
