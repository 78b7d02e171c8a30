"""Benchmark passages in documents: a set join on the rarest shingle of each window, checked word by word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlume.llm import common, sketch, text

#: Words of a shingle (windows of fewer words are one shingle).
SHINGLE = 3
#: Occurrences handed on at a time.
MANY = 1 << 14
#: Everything but 0-9, a-z (after lower-casing) and bytes of characters beyond ASCII.
APART = np.ones(256, dtype=bool)
APART[ord("0") : ord("9") + 1] = False
APART[ord("a") : ord("z") + 1] = False
APART[128:] = False


def _words(buf: np.ndarray, off: np.ndarray):
    low = text.LOWER[buf]
    return low, *text.words(low, off, APART)


def item_windows(items: DataFrame, width: int) -> DataFrame:
    """(window, k, item): the distinct windows of ``width`` consecutive words of each item, words joined by one
    space; an item of fewer words, but not none, is one window."""

    def run(batches):
        for rows, buf, off in text.blocks(batches):
            low, s, e, first = _words(buf, off)
            n = np.diff(first)
            size = np.minimum(n, width)
            at, edges = text.ranges(first[:-1], np.where(n > 0, first[1:] - size + 1, first[:-1]))
            row = np.repeat(np.arange(len(n)), np.diff(edges))
            pick, ends = text.ranges(at, at + size[row])
            yield pa.RecordBatch.from_arrays([text.joined(low, s, e, pick, ends), pa.array(size[row], pa.int32()), rows.column("item").take(pa.array(row))], names=["window", "k", "item"])

    return items.mapInArrow(run, "window string, k int, item string").distinct()


def _shingle_hashes(h: np.ndarray, size: int) -> np.ndarray:
    return text.mix(text.grams(h, size) + np.uint64(size))


def _members(tokens: DataFrame, bits: int):
    """Bitmap of fixed size of shingles (token, size)."""

    def hashes(batches):
        for rows, buf, off in text.blocks(batches, "token"):
            s, e, first = text.words(buf, off)
            h = text.word_hashes(buf, s, e)
            for size in range(1, SHINGLE + 1):
                at = first[:-1][np.diff(first) == size]
                if len(at):
                    yield _shingle_hashes(h, size)[at]

    return sketch.bitmap(tokens, hashes, bits, 1)


def _found(first: np.ndarray, h: np.ndarray, sizes: list[int], members, bits: int):
    """(size, places) of the shingles that the bitmap holds."""
    for size in sizes:
        at = text.inside(first, size)
        if len(at):
            yield size, at[sketch.is_hit(members.value, _shingle_hashes(h, size)[at], bits)]


def shingle_counts(docs: DataFrame, sizes: list[int], members, bits: int) -> DataFrame:
    """(token, count): occurrences in the documents of the shingles in the bitmap, folded block by block first."""

    def run(batches):
        for _, buf, off in text.blocks(batches):
            low, s, e, first = _words(buf, off)
            h = text.word_hashes(low, s, e)
            for size, at in _found(first, h, sizes, members, bits):
                if len(at):
                    tokens = text.joined(low, s, e, (at[:, None] + np.arange(size)).ravel(), size * np.arange(len(at) + 1)).value_counts()
                    yield pa.RecordBatch.from_arrays([tokens.field(0), tokens.field(1)], names=["token", "count"])

    return docs.mapInArrow(run, "token string, count long").groupBy("token").agg(F.sum("count").alias("count"))


def occurrences(docs: DataFrame, width: int, sizes: list[int], members, bits: int) -> DataFrame:
    """Two kinds of rows: (_id, _h, n_words) of each document, and (_id, _h, token, at, lead, around) of each shingle in
    the bitmap: its place, and up to ``width`` less its size words on both sides of it, ``lead`` of them before it."""

    def run(batches):
        for rows, buf, off in text.blocks(batches):
            low, s, e, first = _words(buf, off)
            n_docs = len(off) - 1
            none = pa.nulls(n_docs, pa.string()), pa.nulls(n_docs, pa.int64()), pa.nulls(n_docs, pa.int32()), pa.nulls(n_docs, pa.list_(pa.string()))
            names = ["_id", "_h", "n_words", "token", "at", "lead", "around"]
            yield pa.RecordBatch.from_arrays([rows.column("_id"), rows.column("_h"), pa.array(np.diff(first), pa.int64()), *none], names=names)
            h = text.word_hashes(low, s, e)
            for size, every in _found(first, h, sizes, members, bits):
                for lo in range(0, len(every), MANY):
                    at = every[lo : lo + MANY]
                    doc = np.searchsorted(first, at, "right") - 1
                    start, stop = np.maximum(at - (width - size), first[doc]), np.minimum(at + width, first[doc + 1])
                    pick, edges = text.ranges(start, stop)
                    around = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), text.joined(low, s, e, pick, np.arange(len(pick) + 1)))
                    token = text.joined(low, s, e, (at[:, None] + np.arange(size)).ravel(), size * np.arange(len(at) + 1))
                    row = pa.array(doc)
                    yield pa.RecordBatch.from_arrays(
                        [rows.column("_id").take(row), rows.column("_h").take(row), pa.nulls(len(at), pa.int64()), token, pa.array(at - first[doc]), pa.array(at - start, pa.int32()), around], names=names)

    return docs.mapInArrow(run, "_id long, _h long, n_words long, token string, at long, lead int, around array<string>")


def contamination(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = 10, bits: int = 25) -> DataFrame:
    """(id_col, n_words, n_hit, items, spans) of every document, over whole texts.

    Words are runs of letters, digits and characters beyond ASCII (A-Z as a-z).  A window is ``width`` consecutive words of an
    item, or all words of a shorter one.  ``n_hit``: words of the document inside occurrences of windows; ``spans``: (start, end) of the
    maximal stretches of such words; ``items``: the items with a window that occurs, as strings, sorted.

    A window occurs only where all its shingles of three words do, so one of them is enough to find it: the
    one that is rarest in the documents.  Those are joined with the places in the documents that a bitmap of fixed size lets through; bounds
    on position and length come first, then the words around are compared with the window's.  Windows with a shingle that no document has go at once.

    Null, empty and blank texts have no words.  Equal rows each give their row, rows of one id with different texts each by
    their own text, null ids stay null.  Items without id count in ``n_hit`` but are not named; items of one id count as
    one.  Neither table is broadcast or collected.  Other columns are ignored.
    """
    docs = common.documents(df, id_col, text_col).withColumn("_h", F.xxhash64("_text"))
    named = items.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).cast("string").alias("_text"))
    named = common.saved(item_windows(named, width))
    words = F.split("window", " ")
    size = F.least("k", F.lit(SHINGLE))
    tokens = named.select("window", "k").distinct().withColumn("_w", words).withColumn("_s", size)
    tokens = tokens.select("window", "k", "_w", "_s", F.explode(F.sequence(F.lit(0), F.col("k") - F.col("_s"))).alias("o"))
    tokens = common.saved(tokens.select("window", "k", "o", F.array_join(F.slice("_w", F.col("o") + 1, F.col("_s")), " ").alias("token"), "_s"))
    sizes = sorted(r._s for r in tokens.select("_s").distinct().collect())  # 1, 2 and 3 at most
    members = _members(tokens.select("token").distinct(), bits)
    counts = common.saved(shingle_counts(docs, sizes, members, bits))
    ranked = tokens.join(counts, "token").withColumn("_order", F.col("count") * width + F.col("o"))
    rarest = ranked.groupBy("window", "k").agg(F.count("*").alias("_n"), F.min_by("token", "_order").alias("token"), F.min_by("o", "_order").alias("o"))
    rarest = common.saved(rarest.where(F.col("_n") == F.col("k") - F.least("k", F.lit(SHINGLE)) + 1).select("window", "k", "o", "token"))
    found = common.saved(occurrences(docs, width, sizes, _members(rarest.select("token").distinct(), bits), bits))

    near = found.where("token is not null").join(rarest, "token")
    fits = (F.col("lead") >= F.col("o")) & (F.size("around") - F.col("lead") + F.col("o") >= F.col("k"))
    equal = F.when(fits, F.slice("around", F.col("lead") - F.col("o") + 1, F.col("k")) == words)
    hits = common.saved(near.where(equal).select("_id", "_h", (F.col("at") - F.col("o")).alias("start"), (F.col("at") - F.col("o") + F.col("k")).alias("end"), "window"))

    key = ["_id", "_h"]
    by_start = Window.partitionBy(*key).orderBy("start")
    ends = hits.groupBy(*key, "start").agg(F.max("end").alias("end"))
    ends = ends.withColumn("_before", F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1)))
    runs = ends.withColumn("_run", F.sum(F.when(F.col("_before") >= F.col("start"), 0).otherwise(1)).over(by_start))
    runs = runs.groupBy(*key, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = runs.groupBy(*key).agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    who = hits.select(*key, "window").distinct().join(named.select("window", "item"), "window").where("item is not null").select(*key, "item").distinct()
    who = who.groupBy(*key).agg(F.sort_array(F.collect_list("item")).alias("items"))
    out = found.where("n_words is not null").select(*key, "n_words").join(spans, key, "left").join(who, key, "left")
    return out.select(
        common.real_id().alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start: bigint, end: bigint>>")).alias("spans"))
