"""Periodic runs of words: harmonic grids of candidates, extended by a recompressed grammar."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlume.llm import common, text
from barlume.llm.recompression import Extender, grammar

#: Candidates extended together.
MANY = 1 << 18
_SPAN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def candidates(w: np.ndarray, first: np.ndarray, least: int):
    """(place, period) pairs on the harmonic grid of each document, in portions.

    A run of period p and length >= max(least, 2p) holds, together with the place p
    further, every place of a stretch of max(least - p, p), so one place of a grid of that step.  The
    word p further is equal, and so is the next pair of words or the pair before.
    """
    size = np.diff(first)
    by_size = np.argsort(-size, kind="stable")
    size, begin = size[by_size], first[:-1][by_size]
    parts, held = [], 0
    for p in range(1, int(size.max(initial=0)) // 2 + 1):
        docs = int(np.searchsorted(-size, -max(least, 2 * p), "right"))
        if not docs:
            break
        step = max(least - p, p)
        n = (size[:docs] - p - 1) // step + 1
        total = int(n.sum())
        i = np.repeat(begin[:docs] - step * (np.cumsum(n) - n), n) + step * np.arange(total)
        i = i[w[i] == w[i + p]]
        if len(i):
            # documents end in a symbol of their own and the sequence begins with one, so neighbours exist
            i = i[(w[i + 1] == w[i + p + 1]) | (w[i - 1] == w[i + p - 1])]
            parts.append((i, np.full(len(i), p)))
            held += len(i)
        if held >= MANY:
            yield tuple(np.concatenate(x) for x in zip(*parts, strict=True))
            parts, held = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def find(w: np.ndarray, first: np.ndarray, least: int) -> np.ndarray:
    """Rows (start, end, period) of all runs of at least ``least`` words and two periods.

    ``w``: word numbers with a number of its own before the first document and after each;
    ``first``: place of each document's first word, and one beyond the last closing number."""
    none = np.zeros((0, 3), np.int64)
    bounds = np.stack([first[:-1], first[1:] - 1], axis=1)
    found, grown = [], None
    for i, p in candidates(w, np.append(bounds[:, 0], first[-1]), least):
        if grown is None:
            distinct, w = np.unique(w, return_inverse=True)
            grown = Extender(grammar(w, len(distinct)), len(w))
        s = i - grown.extend(i - 1, i + p - 1, ahead=False)
        e = i + p + grown.extend(i, i + p, ahead=True)
        long = e - s >= np.maximum(least, 2 * p)
        found.append(np.unique(np.stack([s[long], e[long], p[long]], axis=1), axis=0))
    if not found:
        return none
    rows = np.unique(np.concatenate(found), axis=0)  # by start, end, period
    if not len(rows):
        return none
    smallest = np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)))
    return rows[smallest]


def numbered(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Word starts and ends, first word of each document, and the numbers ``find`` reads with their document bounds."""
    s, e, first = text.words(buf, off)
    ids, distinct = text.word_ids(buf, s, e)
    n_docs = len(off) - 1
    w = np.empty(len(ids) + n_docs + 1, np.int64)
    place = np.arange(len(ids)) + np.repeat(np.arange(n_docs), np.diff(first)) + 1
    w[place] = ids
    marks = np.append(first + np.arange(n_docs + 1), 0)[: n_docs + 1]
    w[marks] = len(distinct) + np.arange(n_docs + 1)
    return s, e, first, w, marks + 1


def runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 12, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, n_words, runs, collapsed) and the ``carry`` columns of each document, over its whole text.

    ``runs``: (start, length, period) in words, from 0, by start and then period, of every stretch with smallest
    period ``period`` that is at least ``least`` words and two periods long and that no neighbouring
    word extends.  ``collapsed``: the words outside the repetitions, joined by one space: a run leaves its first period.

    One pass, no shuffle; memory follows a block of texts, or the longest text.  Null, empty and blank texts
    have no words, no runs and an empty ``collapsed``.  Overlapping runs each count.  Equal rows
    each give their row; null ids stay null; other columns are ignored, whatever their names.
    """

    def work(batches):
        for rows, buf, off in text.blocks(batches):
            s, e, first, w, begin = numbered(buf, off)
            n_docs = len(off) - 1
            found = find(w, begin, least)
            doc = np.searchsorted(begin, found[:, 0], "right") - 1
            start = found[:, 0] - begin[doc]
            length, period = found[:, 1] - found[:, 0], found[:, 2]
            order = np.lexsort((period, start, doc))
            doc, start, length, period = doc[order], start[order], length[order], period[order]
            change = np.zeros(len(s) + 1, np.int64)
            np.add.at(change, first[doc] + start + period, 1)
            np.add.at(change, first[doc] + start + length, -1)
            keep = np.flatnonzero(np.cumsum(change[:-1]) == 0)
            collapsed = text.joined(buf, s, e, keep, np.searchsorted(keep, first))
            spans = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], fields=list(_SPAN))
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n_docs + 1)), pa.int32()), spans)
            carried = [rows.column(c) for c in rows.schema.names if c.startswith("_x")]
            yield pa.RecordBatch.from_arrays(
                [*carried, rows.column("_id"), pa.array(np.diff(first), pa.int64()), lists, collapsed],
                names=[*(f"_x{k}" for k in range(len(carried))), "_id", "n_words", "runs", "collapsed"])

    docs = common.documents(df, id_col, text_col, carry)
    types = [f"_x{k} {df.schema[c].dataType.simpleString()}" for k, c in enumerate(carry)]
    out = docs.mapInArrow(work, ", ".join([*types, "_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"]))
    return out.select(*[F.col(f"_x{k}").alias(c) for k, c in enumerate(carry)], common.real_id().alias(id_col), "n_words", "runs", "collapsed")
