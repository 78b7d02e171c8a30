"""Quality rules on repetition: suffix arrays and longest-common-prefix intervals."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlume.llm import common, text
from barlume.llm.substring_dedup import covered

SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_BLANK = b" \t\n\x0b\x0c\r"
_OUT = [("_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat"))]


def repeated(key: np.ndarray) -> np.ndarray:
    """Which values occur more than once."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def longest_intervals(h: np.ndarray, doc: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest string that begins there and begins at
    another place of its document too.

    ``h``: word hashes, ``doc``: document of each, rising, ``last``: end of its document.  The suffixes of
    every document are sorted by doubling; the common prefixes of neighbours, read off the ranks of all
    doublings, bound the intervals of the array; a suffix's deepest interval is the longer of its two
    neighbouring prefixes, and the strings of those intervals are the maximal repeats.
    """
    n = len(h)
    order = np.lexsort((h, doc))
    new = np.ones(n, bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(new) - 1
    ranks, k, at = [rank], 1, np.arange(n)
    while rank.max(initial=-1) < n - 1:
        beyond = at + k
        next_rank = np.where(beyond < last, rank[np.minimum(beyond, n - 1)] + 1, 0)
        _, rank = np.unique(rank * (n + 1) + next_rank, return_inverse=True)
        ranks.append(rank)
        k *= 2
    sa = np.empty(n, np.int64)
    sa[rank] = at
    i, j = sa[:-1].copy(), sa[1:].copy()
    lcp = np.zeros(max(n - 1, 0), np.int64)
    end_i, end_j = last[i], last[j]
    live = doc[i] == doc[j]
    for level in range(len(ranks) - 1, -1, -1):
        r = ranks[level]
        a, b = i + lcp, j + lcp
        same = live & (a < end_i) & (b < end_j)
        same &= r[np.minimum(a, n - 1)] == r[np.minimum(b, n - 1)]
        lcp += np.where(same, 1 << level, 0)
    deep = np.zeros(n, np.int64)
    if n > 1:
        np.maximum.at(deep, sa[:-1], lcp)
        np.maximum.at(deep, sa[1:], lcp)
    return deep


def measures(rows: pa.RecordBatch, buf: np.ndarray, off: np.ndarray, shortest: int) -> dict[str, np.ndarray]:
    s, e, first = text.words(buf, off)
    h = text.word_hashes(buf, s, e)
    n_docs, n_words = len(off) - 1, np.diff(first)
    total = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[off])
    out = {"n_words": n_words, "word_chars": total(((buf & 0xC0) != 0x80) & ~text.SPACE[buf]), "n_symbols": total(SYMBOL[buf])}
    lines = np.zeros(n_docs, np.int64)
    raw = buf.tobytes()
    for d in range(n_docs):
        own = [x for x in raw[off[d] : off[d + 1]].split(b"\n") if x.strip(_BLANK)]
        lines[d] = len(own) - len(set(own))
    out["n_dup_lines"] = lines
    at = text.inside(first, 5)
    doc = np.repeat(np.arange(n_docs), n_words)
    twice = at[repeated(text.mix(text.grams(h, 5)[at] + text.mix(doc[at].astype(np.uint64) + np.uint64(1))))] if len(at) else at
    per_doc = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[first])
    out["n_repeat_words"] = per_doc(covered(twice, 5, len(h)))
    # only documents in which some five words occur twice have repeats of ``shortest`` words
    in_cover, longest = np.zeros(len(h), bool), np.zeros(n_docs, np.int64)
    some = np.zeros(n_docs, bool)
    some[doc[twice]] = True
    pick = np.flatnonzero(some[doc])
    if len(pick):
        own = doc[pick]
        end = np.searchsorted(own, own, "right")
        deep = longest_intervals(h[pick], own, end)
        np.maximum.at(longest, own, deep)
        deep = np.where(deep >= shortest, deep, 0)
        step = np.zeros(len(pick) + 1, np.int64)
        np.add.at(step, np.flatnonzero(deep), 1)
        np.add.at(step, (np.arange(len(pick)) + deep)[deep > 0], -1)
        in_cover[pick] = np.cumsum(step[:-1]) > 0
    out["covered_words"] = per_doc(in_cover)
    out["longest_repeat"] = np.where(longest >= shortest, longest, 0)
    return out


def rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 10, most_covered: float = 0.15, longest: int = 100) -> DataFrame:
    """(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words,
    longest_repeat, base_failed, kept) of each document, over its whole text.

    ``covered_words`` is the union of the places of all maximal repeats of ``shortest``
    words or more, ``longest_repeat`` the longest of them (0: none).  The base rule fails texts of fewer than ten
    words and those with over 20 % of words in five-word windows found twice; ``kept``
    further limits the covered share to ``most_covered`` and the longest repeat to ``longest``.

    One pass, no shuffle.  Null, empty and blank texts have no words and fail the base rule.
    Equal rows each give their row; null ids stay null; other columns are ignored.
    """

    def run(batches):
        for rows, buf, off in text.blocks(batches):
            out = measures(rows, buf, off, shortest)
            yield pa.RecordBatch.from_arrays([rows.column("_id"), *(pa.array(out[c], t) for c, t in _OUT[1:])], names=[c for c, _ in _OUT])

    out = common.documents(df, id_col, text_col).mapInArrow(run, ", ".join(f"{c} long" for c, _ in _OUT))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    fine = (F.col("covered_words") <= most_covered * F.col("n_words")) & (F.col("longest_repeat") <= longest)
    return out.select(common.real_id().alias(id_col), *(c for c, _ in _OUT[1:]), failed.alias("base_failed"), (~failed & fine).alias("kept"))
