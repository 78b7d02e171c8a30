"""Words, hashes and blocks of text as NumPy arrays, for use inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text whose arrays are in memory at once (one longer document still is one block).
BLOCK = 2 << 20
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_TABLE = np.random.Generator(np.random.PCG64(7)).integers(0, 2**64, size=(2, 64 * 256), dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def blocks(batches: Iterator[pa.RecordBatch], text: str = "_text", size: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of runs of documents with about ``size`` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        buf, off = utf8(batch.column(text))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1)
            yield batch.slice(lo, hi - lo), buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            lo = hi


def words(buf: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each maximal run of bytes that are not ``space``, and the first word
    of each document (one more entry than documents)."""
    solid = ~space[buf]
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    b = off[:-1][off[:-1] < len(buf)]
    start[b] |= solid[b]
    b = off[1:][off[1:] > 0] - 1
    end[b] |= solid[b]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(s, off)


def word_array(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.LargeBinaryArray:
    """The words themselves."""
    n = e - s
    ends = np.concatenate(([0], np.cumsum(n)))
    at = np.arange(int(ends[-1]), dtype=np.int64) + np.repeat(s - ends[:-1], n)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(buf[at])])


def word_ids(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(number of each word, the distinct words): equal numbers if and only if equal bytes."""
    found = word_array(buf, s, e).dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def joined(buf: np.ndarray, s: np.ndarray, e: np.ndarray, pick: np.ndarray, edges: np.ndarray) -> pa.StringArray:
    """The words ``pick`` joined by one space, in groups between ``edges`` (places in ``pick``)."""
    full = edges[1:][edges[1:] > edges[:-1]] - 1
    n = e[pick] - s[pick] + 1
    n[full] -= 1  # no space after the last word of a group
    ends = np.cumsum(n)
    at = np.arange(int(ends[-1]) if len(n) else 0, dtype=np.int64) + np.repeat(s[pick] - (ends - n), n)
    out = buf[np.minimum(at, len(buf) - 1)] if len(at) else np.zeros(0, np.uint8)
    spaced = np.ones(len(n), bool)
    spaced[full] = False
    out[ends[spaced] - 1] = 32
    offsets = np.concatenate(([0], ends)).astype(np.int64)[edges]
    return pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(offsets), pa.py_buffer(out)).cast(pa.string())


def ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every place of the ranges, one after another, and where each range begins in that (one more)."""
    n = np.maximum(stop - start, 0)
    edges = np.concatenate(([0], np.cumsum(n)))
    return np.arange(int(edges[-1]), dtype=np.int64) + np.repeat(start - edges[:-1], n), edges


def word_hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit tabulation hash of each word's bytes."""
    if not len(s):
        return np.zeros(0, np.uint64)
    n = e - s
    first = np.cumsum(n) - n
    pos = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(first, n)
    value = _TABLE[which][((pos & 63) << 8) | buf[pos + np.repeat(s, n)]]
    if n.max() > 64:
        power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(int(n.max() >> 6), _ODD))))  # the same whatever the longest word
        value = value * power[pos >> 6]
    return mix(np.add.reduceat(value, first))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive values."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        out = out * _ODD + h[j : j + len(out)]
    return mix(out)


def inside(first: np.ndarray, n: int) -> np.ndarray:
    """Positions at which a run of ``n`` items starts and ends in one document."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    total = int(counts.sum())
    at = np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts)
    return at + np.arange(total)


def minimum_at(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the least value in each run of ``width`` (the first of those whose
    leading bits are equal): the lesser of a block's running minimum from the right and the next
    block's from the left, the position in the low bits."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    bits = np.uint64(max(1, int(len(values)).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    padded = np.full(-(-len(values) // width) * width, np.uint64(2**64 - 1))
    padded[: len(values)] = (values & ~low) | np.arange(len(values), dtype=np.uint64)
    table = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(table, axis=1).ravel()
    return (np.minimum(ahead[:n], behind[width - 1 : width - 1 + n]) & low).astype(np.int64)


def byte_grams(buf: np.ndarray, power: int, which: int = 0) -> np.ndarray:
    """Hash of every run of ``2**power`` bytes, by doubling."""
    h = _TABLE[which][buf]
    odd = _ODD
    for k in range(power):
        span = 1 << k
        if len(h) <= span:
            return np.zeros(0, np.uint64)
        h = h[:-span] * odd + h[span:]
        odd = np.uint64(int(odd) * int(odd) % 2**64)
    return mix(h)


def ids(batch: pa.RecordBatch, name: str = "_id") -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)


def as_i64(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint64, copy=False).view(np.int64)


class Memory(dict):
    """Remembers what ``make`` gives for a key.  After ``most`` keys those not asked for since
    the last turn are forgotten, so frequent keys stay and memory is bounded."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self.turn()
        self[key] = value
        return value

    def turn(self) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
