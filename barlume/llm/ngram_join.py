"""Jaccard self-join on word shingles: size-banded tiles, bitmap bounds, exact intersection."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlume.llm import common, sketch, text

#: Minimum hashes of one document and how many make a key, for first links between close copies.
MINIMA, EACH = 24, 3
_ORDERS = np.random.Generator(np.random.PCG64(3)).integers(0, 2**64, size=(MINIMA, 1), dtype=np.uint64)
#: Rows of a tile compared with the rows before them at a time.
ROWS = 2048
#: 64-bit words of a bitmap signature.
WORDS = 16


def shingles(buf: np.ndarray, off: np.ndarray, n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of a block's documents (A-Z as a-z) and the first of each document.
    With fewer than ``n`` words the whole sequence is one shingle."""
    low = text.LOWER[buf]
    s, e, first = text.words(low, off)
    h = text.word_hashes(low, s, e, which)
    at = text.inside(first, n)
    counts = np.maximum(np.diff(first) - n + 1, 0)
    g = text.grams(h, n)[at]
    short = np.flatnonzero((np.diff(first) > 0) & (counts == 0))
    if len(short):
        where = np.cumsum(counts)[short]
        own = np.array([text.grams(h[first[d] : first[d + 1]], int(first[d + 1] - first[d]))[0] for d in short.tolist()], np.uint64)
        g = np.insert(g, where, text.mix(own + np.uint64(1)))
        counts[short] = 1
    return g, np.concatenate(([0], np.cumsum(counts)))


def sets(buf: np.ndarray, off: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document."""
    g, first = shingles(buf, off, n)
    return [np.unique(g[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]


def minima(s: np.ndarray) -> list[int]:
    """Keys from the least hashes of the set under several orders: close sets share most."""
    if len(s) < 8:
        return []
    least = text.mix(s ^ _ORDERS).min(axis=1)
    return text.as_i64(text.mix(least.reshape(-1, EACH) @ np.array([3, 5, 7], np.uint64) + np.arange(MINIMA // EACH, dtype=np.uint64))).tolist()


def bitmaps(s: list[np.ndarray]) -> np.ndarray:
    """Signature of each set: the bits that its hashes name."""
    out = np.zeros((len(s), WORDS * 64), bool)
    for row, x in zip(out, s, strict=True):
        row[(x & np.uint64(WORDS * 64 - 1)).astype(np.int64)] = True
    return np.packbits(out, axis=1).view(np.uint64).reshape(len(s), WORDS)


def most_common(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Upper bound of the overlap: every differing bit is an element of one set only."""
    return (na + nb - np.bitwise_count(a ^ b).sum(axis=1)) // 2


def least_overlap(na, nb, percent: int):
    """Smallest overlap of sets of these sizes with 100 * overlap >= percent * union."""
    return -(-percent * (na + nb) // (100 + percent))


def verified(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Of the candidate pairs (a, b) those that are similar enough: bitmaps bound the overlap, then the sorted
    sets are intersected.  Pairs grow with the documents, so both joins merge at every size."""
    docs = sketch.only(docs.select("_id", "_text"), pairs.select("a").union(pairs.select("b")).distinct()).hint("merge")
    pairs = pairs.join(docs.select(F.col("_id").alias("a"), F.col("_text").alias("_ta")), "a").join(docs.select(F.col("_id").alias("b"), F.col("_text").alias("_tb")), "b")

    def run(batches):
        for rows, buf, off in text.blocks(batches, "_ta", text.BLOCK // 2):
            sa, last, sb = sets(buf, off, n), {}, []
            for t in rows.column("_tb"):  # many pairs in a row share their second text
                t = t.as_py() or ""
                if t not in last:
                    last = {t: sets(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), n)[0]}
                sb.append(last[t])
            na, nb = np.array([len(x) for x in sa]), np.array([len(x) for x in sb])
            need = least_overlap(na, nb, percent)
            keep = (most_common(bitmaps(sa), bitmaps(sb), na, nb) >= need) & (na > 0) & (nb > 0)
            for i in np.flatnonzero(keep).tolist():
                keep[i] = len(np.intersect1d(sa[i], sb[i], assume_unique=True)) >= need[i]
            yield pa.RecordBatch.from_arrays([rows.column("a").filter(pa.array(keep)), rows.column("b").filter(pa.array(keep))], names=["a", "b"])

    return pairs.select("a", "b", "_ta", "_tb").mapInArrow(run, "a long, b long")


def tiles(docs: DataFrame, heads: DataFrame, n: int, percent: int, bits: int) -> DataFrame:
    """Candidate pairs (a, b) among ``heads`` (_id, _group), of different groups.

    Two sets with the overlap asked for share one of the first ``size - overlap + 1``
    elements of each, whatever the common order of elements.  The order puts the rarer ones
    first, as a count-min sketch of all shingles tells, so a passage that very many documents share
    brings none of them together.  A tile holds the documents with an element, by size; partners lie
    in the band of sizes down to ``percent`` of a document's own, and their positions of
    the element must leave room for the overlap."""

    def hashes(batches):
        for _, buf, off in text.blocks(batches):
            yield np.concatenate(sets(buf, off, n))

    # counters are kept on a scale of powers of the square root of two
    most = 2**31
    found = sketch.merge(sketch.partials(docs, hashes, bits, most), bits, most, lambda at: np.round(np.log2(np.maximum(at, 1)) * 2).astype(np.uint8).tobytes())
    width = 1 << min(bits + 1, sketch.SHARD_BITS)
    level = np.zeros(2 << bits, np.uint8)
    for shard, kept in found:
        level[shard * width : (shard + 1) * width] = np.frombuffer(kept, np.uint8)
    level = docs.sparkSession.sparkContext.broadcast(level)

    def first_elements(batches):
        """One row a document, so that its first elements and not its text move to meet ``heads``."""
        for rows, buf, off in text.blocks(batches):
            out = []
            for i, s in zip(rows.column("_id").to_pylist(), sets(buf, off, n), strict=True):
                size = len(s)
                if size:
                    a, b = sketch.cells(s, bits)
                    order = np.lexsort((s, np.minimum(level.value[a], level.value[b])))
                    # a partner can be as small as ``percent`` of this document
                    out.append((i, size, s[order[: size - -(-percent * size // 100) + 1]].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["_id", "_size", "_keys"])

    def one_by_one(batches):
        for b in batches:
            if not b.num_rows:
                continue
            keys = [np.frombuffer(x.as_buffer(), np.int64) for x in b.column("_keys")]
            count = np.array([len(x) for x in keys])
            row = pa.array(np.repeat(np.arange(len(keys)), count))
            at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), b.column("_id").take(row), b.column("_size").take(row), pa.array(at, pa.int32()), b.column("_group").take(row)], names=["_key", "_id", "_size", "_at", "_group"])

    def pairs(key, _id, size, at, group, fresh):
        """Pairs within each key of these rows (sorted by key and size), the later row among those from ``fresh`` on."""
        out = []
        begin = np.searchsorted(key, key, "left")
        new = np.concatenate(([True], key[1:] != key[:-1]))
        at_new = np.flatnonzero(new)
        mixed = np.minimum.reduceat(group, at_new) != np.maximum.reduceat(group, at_new)
        j = np.arange(max(1, fresh), len(key))
        j = j[mixed[(np.cumsum(new) - 1)[j]]]  # a tile of one group has nothing to compare
        for back in range(1, len(key)):
            j = j[j - back >= begin[j]]
            j = j[100 * size[j - back] >= percent * size[j]]  # sizes rise, so none beyond is in the band
            if not len(j):
                break
            i = j - back
            need = least_overlap(size[i], size[j], percent)
            ok = (at[i] <= size[i] - need) & (at[j] <= size[j] - need) & (np.minimum(size[i] - at[i], size[j] - at[j]) >= need - np.minimum(at[i], at[j])) & (group[i] != group[j])
            out.append(np.stack([np.minimum(_id[i[ok]], _id[j[ok]]), np.maximum(_id[i[ok]], _id[j[ok]])]))
        return np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)

    def tile(batches):
        held = None  # rows of the key at hand that are still in the band
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = [x.to_numpy(zero_copy_only=False).astype(np.int64) for x in b.slice(lo, ROWS).columns]
                fresh = 0
                if held is not None and held[0][-1] == part[0][0]:
                    own = 100 * held[2] >= percent * part[2][0]
                    same = own & (held[0] == part[0][0])
                    fresh = int(same.sum())
                    part = [np.concatenate([h[same], x]) for h, x in zip(held, part, strict=True)]
                found = np.unique(pairs(*part, fresh), axis=1)
                if found.shape[1]:
                    yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["a", "b"])
                held = [x[part[0] == part[0][-1]] for x in part]

    firsts = docs.mapInArrow(first_elements, "_id long, _size int, _keys binary")
    # merged at every size: ``heads`` grows with the documents
    rows = firsts.join(heads.hint("merge"), "_id").mapInArrow(one_by_one, "_key long, _id long, _size int, _at int, _group long")
    return rows.repartition("_key").sortWithinPartitions("_key", "_size", "_id").mapInArrow(tile, "a long, b long").distinct()


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, bits: int = 23) -> DataFrame:
    """(id_col, n_shingles, class_id, component_id) for every document.

    A document's set holds its distinct ``n``-word shingles (A-Z as a-z; with fewer words the whole
    sequence).  Documents with 100 * intersection >= ``percent`` * union are linked; the
    component is the smallest id reachable by links.  Documents of one set form a class, named by its
    smallest id, and only class members with that id are compared.

    Groups of close copies come together first: documents that share a key of minimum hashes with
    a smaller id are compared with the smallest one.  The tiles then look for links between
    different groups only, and find all of them, so no group is expanded into its pairs.

    Null, empty and blank texts have no shingles and are linked with nothing, whatever they
    equal.  Rows with equal id give a row each; where their texts differ they count as one document with the links of
    all its texts, and the smallest class and component are told.  A row without id is linked with
    nothing.  Other columns are ignored.
    """
    every = common.documents(df, id_col, text_col)
    docs = every.where(F.col("_id") != common.NO_ID)

    def describe(batches):
        for rows, buf, off in text.blocks(batches):
            own = sets(buf, off, n)
            second, first = shingles(buf, off, n, 1)
            k1 = [int(text.as_i64(text.mix(x).sum(keepdims=True) + np.uint64(len(x)))[0]) if len(x) else None for x in own]
            k2 = [int(text.as_i64(text.mix(np.unique(second[a:b])).sum(keepdims=True))[0]) if a < b else None for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column("_id"), pa.array([len(x) for x in own], pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array([minima(x) for x in own], pa.list_(pa.int64()))], names=["_id", "n", "_k1", "_k2", "_keys"])

    about = common.saved(every.mapInArrow(describe, "_id long, n long, _k1 long, _k2 long, _keys array<long>"))
    known = (F.col("n") > 0) & (F.col("_id") != common.NO_ID)
    classes = common.saved(about.where(known).groupBy("n", "_k1", "_k2").agg(F.min("_id").alias("class")))
    member = common.saved(about.where(known).join(classes, ["n", "_k1", "_k2"]).select("_id", "n", "class", "_keys"))
    keys = common.saved(member.where("_id = class").select("_id", F.explode("_keys").alias("_key")).distinct())
    least = common.saved(keys.groupBy("_key").agg(F.min("_id").alias("a"), F.count("*").alias("_n")).where("_n > 1"))
    close = common.saved(keys.join(least, "_key").where("_id <> a").select("a", F.col("_id").alias("b")).distinct())
    links = common.saved(verified(close, docs, n, percent))
    groups = common.components(links)
    heads = classes.select(F.col("class").alias("_id")).join(groups.withColumnRenamed("id", "_id"), "_id", "left")
    heads = common.saved(heads.select("_id", F.coalesce("component", "_id").alias("_group")))
    more = common.saved(verified(common.saved(tiles(docs, heads, n, percent, bits)), docs, n, percent))
    component = common.components(links.union(more)).select(F.col("id").alias("class"), "component")
    placed = member.join(component, "class", "left").select("_id", "class", F.coalesce("component", "class").alias("component")).groupBy("_id").agg(F.min("class").alias("class"), F.min("component").alias("component"))
    out = about.select("_id", "n").join(placed, "_id", "left")

    def named(c: str):
        return F.when(F.col(c).isNull(), common.real_id()).otherwise(common.real_id(c))

    return out.select(common.real_id().alias(id_col), F.col("n").alias("n_shingles"), named("class").alias("class_id"), named("component").alias("component_id"))
