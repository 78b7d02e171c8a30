"""Substring dedup by a count-min prefilter and exact grouping of what may repeat."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlume.llm import common, sketch, text

_RUNS = pa.schema([("_k1", pa.int64()), ("_k2", pa.int64()), ("_id", pa.int64()), ("_start", pa.int32())])


def runs(where: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs [lo, hi) of true entries."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], where, [False])).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` items lie in a window of ``width`` that begins at one of ``starts``."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, np.minimum(starts, n), 1)
    np.add.at(step, np.minimum(starts + width, n), -1)
    return np.cumsum(step[:n]) > 0


class Windows:
    """Hashes of a block's windows and of the shorter runs of words that stand for them.

    Each window is represented by the run of ``seed`` words in it whose hash is least.  Equal
    windows have equal seeds, at different places; so a window found twice has
    a seed found twice, and only about one seed in seven words has to be counted.
    """

    def __init__(self, window: int, seed: int):
        self.window, self.seed = window, seed

    def of(self, buf, off):
        s, e, first = text.words(buf, off)
        h = text.word_hashes(buf, s, e)
        at = text.inside(first, self.window)
        if not len(at):
            return first, h, (s, e), at, at, np.zeros(0, np.uint64)
        g = text.grams(h, self.seed)
        return first, h, (s, e), at, text.minimum_at(g, self.window - self.seed + 1)[at], g

    def seeds(self, batches):
        for _, buf, off in text.blocks(batches):
            *_, seed, g = self.of(buf, off)
            yield g[np.unique(seed)]


def repeated_windows(docs: DataFrame, window: int, seed: int, bits: int) -> DataFrame:
    """(_id, _start): word positions at which a window begins that also began earlier."""
    w = Windows(window, seed)
    bitmap = sketch.repeated(docs, w.seeds, bits)

    def candidates(batches):
        for rows, buf, off in text.blocks(batches):
            first, h, (s, e), at, seeds, g = w.of(buf, off)
            maybe = sketch.is_hit(bitmap.value, g, bits)[seeds] if len(at) else np.zeros(0, bool)
            at = at[maybe]
            if not len(at):
                continue
            k1 = text.as_i64(text.grams(h, window)[at])
            k2 = text.as_i64(text.grams(text.word_hashes(buf, s, e, 1), window)[at])
            doc = np.searchsorted(first, at, "right") - 1
            _id, start = text.ids(rows)[doc], (at - first[doc]).astype(np.int32)
            # of equal windows in a block only the first meets those of other blocks
            order = np.lexsort((start, _id, k2, k1))
            k1, k2, _id, start = k1[order], k2[order], _id[order], start[order]
            lead = np.ones(len(k1), bool)
            lead[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
            head = np.flatnonzero(lead)[np.cumsum(lead) - 1]
            later = ~lead & ((_id != _id[head]) | (start != start[head]))
            yield pa.RecordBatch.from_arrays([pa.array(x[lead]) for x in (k1, k2, _id, start)], schema=_RUNS)
            if later.any():  # settled already: under a key that nothing shares, straight to the output
                i, st = _id[later], start[later]
                none = pa.nulls(len(i), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(text.as_i64(text.mix(i.view(np.uint64)))), none, pa.array(i), pa.array(st)], schema=_RUNS)

    def judge(batches):
        last, held, n = None, [], 0

        def out():
            i, st = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            order = np.lexsort((st, i))
            return pa.RecordBatch.from_pydict({"_id": pa.array(i[order]), "_start": pa.array(st[order].astype(np.int32))})

        for b in batches:
            if not b.num_rows:
                continue
            settled = np.asarray(b.column("_k2").is_null())
            k1, _id, start = (b.column(c).to_numpy(zero_copy_only=False) for c in ("_k1", "_id", "_start"))
            k2 = b.column("_k2").fill_null(0).to_numpy(zero_copy_only=False)
            if settled.any():
                held.append((_id[settled], start[settled]))
            k1, k2, _id, start = (x[~settled] for x in (k1, k2, _id, start))
            if len(k1):
                lead = np.ones(len(k1), bool)
                lead[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
                # the first of the key that began in the batch before goes on
                go_on = last is not None and last[:2] == (k1[0], k2[0])
                head = np.flatnonzero(lead)[np.cumsum(lead) - 1]
                hi, hs = _id[head], start[head]
                if go_on:
                    same = np.cumsum(lead) == 1
                    hi[same], hs[same] = last[2], last[3]
                later = (_id != hi) | (start != hs)
                held.append((_id[later], start[later]))
                last = (k1[-1], k2[-1], hi[-1], hs[-1])
            n = sum(len(x[0]) for x in held)
            if n >= 1_000_000:
                yield out()
                held = []
        if sum(len(x[0]) for x in held):
            yield out()

    rows = docs.mapInArrow(candidates, "_k1 long, _k2 long, _id long, _start int")
    return rows.repartition("_k1", "_k2").sortWithinPartitions("_k1", "_k2", "_id", "_start").mapInArrow(judge, "_id long, _start int")


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, seed: int = 8, bits: int = 26) -> DataFrame:
    """Cuts every word covered by a run of ``window`` words that began earlier in the corpus
    (smaller id, or same document and earlier word), judged on the input.

    Returns (id_col, n_words, n_removed, spans, kept): removed word ranges [from, to)
    and the words left, joined by one space.  A first pass counts, in a
    count-min sketch of fixed size (two rows of ``2**bits`` cells), one short seed per
    window; the second pass sends only windows whose seed may repeat, each
    under a 128-bit hash of its words, once per block of text, to be grouped exactly.  The
    sketch only overestimates, so nothing is lost; in a corpus far beyond
    its size more windows are grouped.

    Null or wordless text has no words and keeps an empty text.  Rows with equal
    id count as one document given more than once: equal places do not remove each other.
    A row without id is returned whole and does not count.  Other columns are ignored.
    """
    docs = common.documents(df, id_col, text_col)
    found = repeated_windows(docs.where(F.col("_id") != common.NO_ID), window, seed, bits).groupBy("_id").agg(F.collect_list("_start").alias("_starts"))

    def cut(batches):
        for b in batches:
            out = []
            for t, starts in zip(b.column("_text").to_pylist(), b.column("_starts").to_pylist(), strict=True):
                w = (t or "").encode().split()
                if starts:
                    gone = covered(np.array(starts, np.int64), window, len(w))
                    spans = runs(gone)
                    kept = b" ".join([x for x, g in zip(w, gone.tolist(), strict=True) if not g])
                    out.append((len(w), int(gone.sum()), [{"from": x, "to": y} for x, y in spans], kept.decode()))
                else:
                    out.append((len(w), 0, [], b" ".join(w).decode()))
            if out:
                n, gone, spans, kept = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [b.column("_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), pa.array(kept, pa.string())],
                    names=["_id", "n_words", "n_removed", "spans", "kept"],
                )

    joined = docs.join(found, "_id", "left")
    out = joined.mapInArrow(cut, "_id long, n_words long, n_removed long, spans array<struct<from: long, to: long>>, kept string")
    return out.select(common.real_id().alias(id_col), "n_words", "n_removed", "spans", "kept")

