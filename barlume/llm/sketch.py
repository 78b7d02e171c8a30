"""Count-min sketches of 64-bit hashes, built per partition and merged by shard.

A sketch has two rows of ``2**bits`` counters.  Every task keeps its own sketch, whole if
that is small or as a sorted list of (cell, count), and cuts it by shard; the merge adds them shard by shard.  The merged
sketch has a fixed size whatever the input, so it may be broadcast.  An estimate, the
smaller of an item's two counters, is never below the item's count.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARD_BITS = 18
_FLUSH = 2_000_000
#: Sketches of up to two rows of 2**23 counters are kept whole by a task.
DENSE_BITS = 23
SCHEMA = "_shard int, _cells binary, _counts binary"
_ARROW = pa.schema([("_shard", pa.int32()), ("_cells", pa.binary()), ("_counts", pa.binary())])


def cells(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Cell of each hash in both rows; those of the second row follow the first row's."""
    mask = np.uint64((1 << bits) - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64) + (1 << bits)


class Dense:
    """A partition's own sketch as an array of counters, for sketches that are small beside
    a partition's input.  Its shards travel compressed, most counters being very small."""

    def __init__(self, bits: int, most: int):
        self.bits, self.most, self.at, self.n = bits, min(most, 255), np.zeros(2 << bits, np.uint8), 0

    def add(self, h: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.n += len(h)
        cell, count = np.unique(np.concatenate(cells(h, self.bits)), return_counts=True)
        self.at[cell] = np.minimum(self.at[cell] + count, self.most)
        yield from ()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            for shard, x in enumerate(self.at.reshape(-1, min(len(self.at), 1 << SHARD_BITS))):
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((shard, None, zlib.compress(x.tobytes(), 1)), _ARROW.types, strict=True)], schema=_ARROW)


class Partial:
    """A partition's own sketch as a list of updates, for sketches larger than a task's share."""

    def __init__(self, bits: int, most: int):
        self.bits, self.most, self.parts, self.n = bits, min(most, 255), [], 0

    def add(self, h: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(h)
        self.n += len(h)
        if self.n >= _FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        cell = np.concatenate(cells(np.concatenate(self.parts), self.bits)).astype(np.uint32)
        self.parts, self.n = [], 0
        cell, count = np.unique(cell, return_counts=True)
        count = np.minimum(count, self.most).astype(np.uint8)
        shard = cell >> np.uint32(SHARD_BITS)
        cut = np.flatnonzero(np.diff(shard)) + 1
        low = (cell & np.uint32((1 << SHARD_BITS) - 1)).astype(np.uint32)
        rows = [(int(shard[i]), low[i:j].tobytes(), count[i:j].tobytes()) for i, j in zip([0, *cut], [*cut, len(cell)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


def partials(docs: DataFrame, hashes: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], bits: int, most: int) -> DataFrame:
    def run(batches):
        part = (Dense if bits <= DENSE_BITS else Partial)(bits, most)
        for h in hashes(batches):
            yield from part.add(h)
        yield from part.flush()

    return docs.mapInArrow(run, SCHEMA)


def merge(parts: DataFrame, bits: int, most: int, keep: Callable[[np.ndarray], bytes]) -> list[tuple[int, bytes]]:
    """Adds the updates of all partitions, shard by shard as a stream; ``keep`` turns a
    shard's counters (saturated at ``most``) into what the lookup needs.  A task's own counters are bytes, so
    beyond 255 a sum tells how many tasks met a cell often, which still orders cells."""
    shards = max(1, 2 << max(0, bits - SHARD_BITS))
    width = 1 << min(bits + 1, SHARD_BITS)
    kind = np.uint8 if most <= 255 else np.uint32

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for shard, c, n in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                at = held.setdefault(shard, np.zeros(width, kind))
                if not c.is_valid:
                    n = np.frombuffer(zlib.decompress(n.as_buffer()), np.uint8)
                    np.minimum(at.astype(np.int64) + n, most, out=at, casting="unsafe")
                    continue
                c, n = np.frombuffer(c.as_buffer(), np.uint32), np.frombuffer(n.as_buffer(), np.uint8)
                at[c] = np.minimum(at[c].astype(np.int64) + n, most).astype(kind)
        for shard, at in held.items():
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "kept": pa.array([keep(at)], pa.binary())})

    n = min(shards, 64)
    return [(r.shard, bytes(r.kept)) for r in parts.repartition(n, "_shard").mapInArrow(run, "shard int, kept binary").collect()]


def bitmap(docs: DataFrame, hashes: Callable, bits: int, least: int) -> Broadcast:
    """Bitmaps (``2**(bits + 1)`` bits in all) of the cells that were hit ``least`` times or more."""
    found = merge(partials(docs, hashes, bits, least), bits, least, lambda at: np.packbits(at >= least).tobytes())
    whole = np.zeros((2 << bits) >> 3, np.uint8)
    size = (1 << min(bits + 1, SHARD_BITS)) >> 3
    for shard, kept in found:
        whole[shard * size : (shard + 1) * size] = np.frombuffer(kept, np.uint8)
    return docs.sparkSession.sparkContext.broadcast(whole)


def repeated(docs: DataFrame, hashes: Callable, bits: int) -> Broadcast:
    """For ``is_hit``: hashes whose estimate is two or more."""
    return bitmap(docs, hashes, bits, 2)


def among(wanted: DataFrame, bits: int = 24) -> Callable[[Column], Column]:
    """For a column of ids: whether each is in ``wanted`` (one long column), true for few others: a bitmap of fixed
    size, so that a join moves few texts besides those it is for.  Only the ids go to Python."""

    def hashes(batches):
        for b in batches:
            if b.num_rows:
                yield _spread(b.column(0))

    found = bitmap(wanted, hashes, bits, 1)

    @F.pandas_udf("boolean")
    def hit(ids: pd.Series) -> pd.Series:
        return pd.Series(is_hit(found.value, _spread(pa.Array.from_pandas(ids)), bits))

    return hit


def only(docs: DataFrame, wanted: DataFrame, bits: int = 24) -> DataFrame:
    """The rows of ``docs`` whose _id is in ``wanted``, and few others."""
    return docs.where(among(wanted, bits)(F.col("_id")))


def _spread(ids: pa.Array) -> np.ndarray:
    h = ids.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(31))


def is_hit(found: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    """Whether both cells of each hash are in the bitmap."""
    a, b = cells(h, bits)
    hit = lambda c: (found[c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1
    return (hit(a) & hit(b)).astype(bool)
