"""Phrases whose words occur together: n-grams counted on a dictionary of content-cut chunks."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlume.llm import common, sketch, text

#: One word in so many starts a chunk, as its trigger window's hash says.
TRIGGER = 16
#: Parts in which the best phrases of a language are looked for first.
PARTS = 64
BREAK = np.zeros(256, dtype=bool)
BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
APART = BREAK.copy()
APART[[9, 32]] = True


def chunks(buf: np.ndarray, off: np.ndarray, longest: int) -> tuple[np.ndarray, ...]:
    """Word starts and ends of a block (lower-cased), and for each chunk its document, first word, the word after its last own
    one and the word after its last.

    A piece (a stretch without punctuation) is cut before every word whose window of ``longest - 1`` words
    triggers, and each chunk reaches over the window of the next: so an n-gram belongs to the one chunk that owns
    its first word, and lies in it whole.  Cuts depend on the words alone: equal passages give equal chunks."""
    s, e, first = text.words(buf, off, APART)
    none = np.zeros(0, np.int64)
    if not len(s):
        return s, e, none, none, none, none
    broken = np.cumsum(BREAK[buf])[s]
    piece = np.concatenate(([True], broken[1:] != broken[:-1]))
    piece[first[:-1][first[:-1] < len(s)]] = True
    begin = np.flatnonzero(piece)
    end = np.append(begin[1:], len(s))[np.cumsum(piece) - 1]  # of each word's piece
    width = longest - 1
    window = text.grams(text.word_hashes(buf, s, e), width)
    cut = piece.copy()
    at = np.flatnonzero(window % np.uint64(TRIGGER) == 0)
    cut[at[at + width <= end[at]]] = True
    start = np.flatnonzero(cut)
    own = np.append(start[1:], len(s))
    return s, e, np.searchsorted(first, start, "right") - 1, start, own, np.minimum(own + width, end[start])


def dictionary(docs: DataFrame, longest: int) -> DataFrame:
    """(lang, chunk, own, times): distinct chunks, words joined by one space, how many words each owns and how often it occurs."""

    def parse(batches):
        for rows, buf, off in text.blocks(batches):
            buf = text.LOWER[buf]
            s, e, doc, start, own, stop = chunks(buf, off, longest)
            pick, edges = text.ranges(start, stop)
            yield pa.RecordBatch.from_arrays([rows.column("lang").take(pa.array(doc)), text.joined(buf, s, e, pick, edges), pa.array(own - start)], names=["lang", "chunk", "own"])

    return docs.mapInArrow(parse, "lang string, chunk string, own long").groupBy("lang", "chunk", "own").agg(F.count("*").alias("times"))


def _lang_hash(column: pa.Array) -> np.ndarray:
    found = column.dictionary_encode()
    own = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in found.dictionary.to_pylist()]
    return np.array(own, np.uint64)[found.indices.to_numpy(zero_copy_only=False)]


def _members(found: DataFrame, n: int, bits: int):
    """Bitmap of fixed size of the phrases found, all of ``n`` words."""

    def hashes(batches):
        for rows, buf, off in text.blocks(batches, "phrase"):
            s, e, _ = text.words(buf, off)
            yield text.mix(text.grams(text.word_hashes(buf, s, e), n)[::n] + _lang_hash(rows.column("lang")))

    return sketch.bitmap(found, hashes, bits, 1)


def counted(book: DataFrame, n: int, known, bits: int) -> DataFrame:
    """(lang, phrase, f): occurrences of the phrases of ``n`` words whose two parts of ``n - 1`` words are ``known``."""

    def count(batches):
        for rows, buf, off in text.blocks(batches, "chunk"):
            s, e, first = text.words(buf, off)
            own, times = (rows.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("own", "times"))
            at, edges = text.ranges(first[:-1], np.minimum(first[:-1] + own, first[1:] - n + 1))
            row = np.repeat(np.arange(len(own)), np.diff(edges))
            langs = rows.column("lang").dictionary_encode()
            if known is not None:
                parts = text.grams(text.word_hashes(buf, s, e), n - 1)
                salt = _lang_hash(rows.column("lang"))[row]
                fine = sketch.is_hit(known.value, text.mix(parts[at] + salt), bits)
                fine[fine] = sketch.is_hit(known.value, text.mix(parts[at[fine] + 1] + salt[fine]), bits)
                at, row = at[fine], row[fine]
            if not len(at):
                continue
            ids, distinct = text.word_ids(buf, s, e)
            key, room = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row], len(langs.dictionary)
            for k in range(n):
                if room * len(distinct) >= 2**62:
                    names, key = np.unique(key, return_inverse=True)
                    room = len(names)
                key, room = key * len(distinct) + ids[at + k], room * len(distinct)
            order = np.argsort(key, kind="stable")
            starts = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
            one = order[starts]
            phrase = text.joined(buf, s, e, (at[one][:, None] + np.arange(n)).ravel(), n * np.arange(len(one) + 1))
            yield pa.RecordBatch.from_arrays([rows.column("lang").take(pa.array(row[one])), phrase, pa.array(np.add.reduceat(times[row[order]], starts))], names=["lang", "phrase", "f"])

    return book.mapInArrow(count, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _part(words: str, start, length):
    return F.array_join(F.slice(words, start, length), " ")


def phrases(df: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = 4, least: int = 30, percent: int = 80, bits: int = 25) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of every collocation of 2 to ``longest`` words, over whole texts.

    Texts (A-Z as a-z) are cut at . , ; : ! ? and line ends into pieces, pieces at blanks and tabs into words.  ``a`` is
    the number of a phrase's occurrences in pieces of its language, at least ``least``, overlapping ones included; ``l`` and ``r`` those of
    its two parts at the cut with the smallest score, floor(2000000 * a / (l + r)) (ties: the first cut); ``n`` the words of the language.
    Phrases inside a longer one with at least ``percent`` % of their occurrences are left out.

    The texts are parsed once into chunks that overlap by a trigger window, which fold to a dictionary with
    frequencies; n-grams are counted in distinct chunks, times their frequency.  Counting goes up by length: only n-grams whose
    two shorter parts are frequent enough are counted, as bitmaps of a fixed size tell, which may let a rarer one pass but stop none.
    All folds combine within tasks first, so neither a frequent phrase nor a frequent language loads one task.

    Null languages count as ``und``, null and empty texts have no words, equal rows each count; languages without such phrases have no row;
    other columns are ignored, whatever their names.
    """
    docs = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("_text"))
    book = common.saved(dictionary(docs, longest))
    total = common.saved(book.groupBy("lang").agg(F.sum(F.col("own") * F.col("times")).alias("n")))
    levels, known = [], None
    for size in range(1, longest + 1):
        levels.append(common.saved(counted(book, size, known, bits).where(F.col("f") >= least)))
        known = _members(levels[-1], size, bits) if size < longest else None
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    found = levels[1]
    for level in levels[2:]:
        found = found.unionByName(level)
    found = found.withColumnRenamed("f", "a").withColumn("_w", F.split("phrase", " ")).withColumn("_n", F.size("_w"))

    cuts = found.select("lang", "phrase", "a", "_w", "_n", F.explode(F.sequence(F.lit(1), F.col("_n") - 1)).alias("_k"))
    cuts = cuts.select("lang", "phrase", "a", "_k", _part("_w", 1, F.col("_k")).alias("_l"), _part("_w", F.col("_k") + 1, F.col("_n") - F.col("_k")).alias("_r"))
    cuts = cuts.join(every.select("lang", F.col("phrase").alias("_l"), F.col("f").alias("l")), ["lang", "_l"]).join(every.select("lang", F.col("phrase").alias("_r"), F.col("f").alias("r")), ["lang", "_r"])
    # decimals: the product may pass 64 bits
    cuts = cuts.withColumn("score", F.expr("cast((cast(a as decimal(20, 0)) * 2000000) div (cast(l as decimal(20, 0)) + r) as long)"))
    cuts = cuts.withColumn("_order", F.col("score") * longest + F.col("_k"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min("_order").alias("_order"), F.min_by("l", "_order").alias("l"), F.min_by("r", "_order").alias("r"))

    longer = found.where("_n > 2").select("lang", "a", "_w", "_n", F.explode(F.sequence(F.lit(2), F.col("_n") - 1)).alias("_m"))
    longer = longer.select("lang", "a", "_w", "_m", F.explode(F.sequence(F.lit(1), F.col("_n") - F.col("_m") + 1)).alias("_i"))
    longer = longer.groupBy("lang", _part("_w", F.col("_i"), F.col("_m")).alias("phrase")).agg(F.max("a").alias("_longer"))
    inside = F.col("_longer").cast("decimal(20, 0)") * 100 >= F.col("a").cast("decimal(20, 0)") * percent
    kept = scored.join(longer, ["lang", "phrase"], "left").where(~F.coalesce(inside, F.lit(False)))
    return kept.join(total, "lang").select("lang", "phrase", "a", "l", "r", "n", F.expr(f"(_order - 1) div {longest}").alias("score"))


def best(found: DataFrame, most: int) -> DataFrame:
    """The first ``most`` phrases of each language, with their ``rank``: by score and ``a``, highest first, then phrase.

    The best of each of ``PARTS`` parts of a language first, so no task sees all phrases of one."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ahead = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order)
    found = found.withColumn("rank", F.row_number().over(ahead)).where(F.col("rank") <= most)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
