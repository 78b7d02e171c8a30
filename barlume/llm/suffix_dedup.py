"""Removal of long repeated byte strings: suffix arrays by induced sorting, shard by shard."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlume.llm import common, sketch, suffix_array, text
from barlume.llm.substring_dedup import runs

#: The seed of a string is a run of 2**5 bytes.
POWER = 5
#: Bytes sorted together in one suffix array.
SHARD = 2 << 20
#: Different segments of one seed beyond which they are told apart window by window.
CROWD = 64
_ROW = pa.schema([("_k1", pa.int64()), ("_k2", pa.int64()), ("_seed", pa.int64()), ("_id", pa.int64()), ("_start", pa.int32()), ("_n", pa.int32()), ("_many", pa.bool_()), ("_bytes", pa.binary())])
_ROW_SQL = "_k1 long, _k2 long, _seed long, _id long, _start int, _n int, _many boolean, _bytes binary"
_GONE = pa.schema([("_id", pa.int64()), ("_start", pa.int32()), ("_n", pa.int32())])
_GONE_SQL = "_id long, _start int, _n int"


class Segments:
    """Runs of consecutive windows that share a seed, the run of bytes with the least hash in each."""

    def __init__(self, width: int):
        self.width = width

    def of(self, buf, off):
        at = text.inside(off, self.width)
        g = text.byte_grams(buf, POWER)
        if not len(at):
            return at, at, at, g
        seed = text.minimum_at(g, self.width - (1 << POWER) + 1)[at]
        new = np.flatnonzero(np.concatenate(([True], (seed[1:] != seed[:-1]) | (at[1:] != at[:-1] + 1))))
        return at[new], np.diff(np.append(new, len(at))), seed[new], g

    def seeds(self, batches):
        for _, buf, off in text.blocks(batches):
            *_, seed, g = self.of(buf, off)
            yield g[np.unique(seed)]


def keyed(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hash of each string as two longs."""
    both = np.frombuffer(b"".join([blake2b(x, digest_size=16).digest() for x in strings]), np.int64)
    return both[::2], both[1::2]


def folded(k1, k2, seed, _id, start, n, many, strings) -> list[pa.RecordBatch]:
    """Rows of equal strings folded: the first keeps the bytes and notes that there were
    others; those are settled already and travel without bytes, as rows with no second key."""
    order = np.lexsort((k2, k1))
    lead = np.ones(len(k1), bool)
    lead[1:] = (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])
    group = np.cumsum(lead) - 1
    many = np.bincount(group, weights=many[order])[group] + np.bincount(group)[group] > 1
    keep, rest = order[lead], order[~lead]
    out = [pa.RecordBatch.from_arrays([*(pa.array(x[keep]) for x in (k1, k2, seed, _id, start, n)), pa.array(many[lead]), pa.array([strings[i] for i in keep.tolist()], pa.binary())], schema=_ROW)]
    if len(rest):
        none = pa.nulls(len(rest), pa.int64())
        spread = text.as_i64(text.mix((_id[rest] * 31 + start[rest]).view(np.uint64)))
        out.append(pa.RecordBatch.from_arrays([pa.array(spread), none, none, *(pa.array(x[rest]) for x in (_id, start, n)), pa.array(np.ones(len(rest), bool)), pa.nulls(len(rest), pa.binary())], schema=_ROW))
    return out


def grouped(rows: DataFrame) -> DataFrame:
    """One row per different string, ``_many`` true where it occurs more than once, and a row without
    second key for every occurrence (_id, _start, _n) that is thereby known to be repeated."""

    def judge(batches):
        held: list = []  # the string at hand, until its last row is known
        for b in batches:
            settled = np.asarray(b.column("_k2").is_null())
            if settled.any():
                yield b.filter(pa.array(settled))
            out = []
            for r in b.filter(pa.array(~settled)).to_pylist():
                if held and (r["_k1"], r["_k2"]) == (held[0]["_k1"], held[0]["_k2"]):
                    if not held[0]["_many"] or not held[1]:
                        out.append(gone(held[0]))
                        held[0]["_many"], held[1] = True, True
                    out.append(gone(r))
                else:
                    if held:
                        out += last(held)
                    held = [r, False]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_ROW)
        if held:
            yield pa.RecordBatch.from_pylist(last(held), schema=_ROW)

    def gone(r):
        return {"_k1": r["_k1"], "_id": r["_id"], "_start": r["_start"], "_n": r["_n"], "_many": True}

    def last(held):
        r, told = held
        return [r, gone(r)] if r["_many"] and not told else [r]

    return rows.repartition("_k1", "_k2").sortWithinPartitions("_k1", "_k2").mapInArrow(judge, _ROW_SQL)


def repeats_in(segments: list[tuple[int, int, int, bool, bytes]], width: int) -> list[tuple[int, int, int]]:
    """(_id, _start, _n) of the windows that occur twice among these segments, by their suffix array."""
    size = [len(x[4]) + 1 for x in segments]
    t = np.zeros(sum(size) + 1, np.int64)
    t[:-1] = np.frombuffer(b"\0".join([x[4] for x in segments]) + b"\0", np.uint8)
    t[:-1] += 2
    begin = np.concatenate(([0], np.cumsum(size)))
    t[begin[1:] - 1] = 1  # between segments; no window reaches over it
    sa = suffix_array.build(t, 258)
    prefix = suffix_array.permuted_prefixes(t, sa)
    long = np.zeros(len(t), bool)
    hit = np.flatnonzero(prefix[sa[1:]] >= width)
    long[sa[1:][hit]] = True
    long[sa[:-1][hit]] = True
    _id, start, n, many = (np.array(x) for x in zip(*[x[:4] for x in segments], strict=True))
    open_ = np.flatnonzero(~many)  # the others are known to be repeated
    step = np.zeros(len(t), np.int8)
    step[begin[open_]] = 1
    step[begin[open_] + n[open_]] = -1
    lo, hi = np.array(runs(long & (np.cumsum(step, dtype=np.int8) > 0)), np.int64).reshape(-1, 2).T
    of = np.searchsorted(begin, lo, "right") - 1
    return list(zip(_id[of].tolist(), (start[of] + lo - begin[of]).tolist(), (hi - lo).tolist(), strict=True))


def repeated_windows(docs: DataFrame, width: int, bits: int) -> DataFrame:
    """(_id, _start, _n): runs of ``_n`` byte positions at each of which a string of
    ``width`` bytes begins that begins elsewhere too."""
    s = Segments(width)
    bitmap = sketch.repeated(docs, s.seeds, bits)

    def cut(batches):
        for rows, buf, off in text.blocks(batches):
            at, n, seed, g = s.of(buf, off)
            if not len(at):
                continue
            maybe = sketch.is_hit(bitmap.value, g[seed], bits)
            at, n, seed = at[maybe], n[maybe], seed[maybe]
            if not len(at):
                continue
            doc = np.searchsorted(off, at, "right") - 1
            raw = buf.tobytes()
            strings = [raw[a : a + k + width - 1] for a, k in zip(at.tolist(), n.tolist(), strict=True)]
            yield from folded(*keyed(strings), text.as_i64(g[seed]), text.ids(rows)[doc], (at - off[doc]).astype(np.int32), n.astype(np.int32), np.zeros(len(at), bool), strings)

    found = common.saved(grouped(docs.mapInArrow(cut, _ROW_SQL)))
    distinct = found.where("_k2 is not null").select("_seed", "_id", "_start", "_n", "_many", "_bytes")
    per_seed = found.where("_k2 is not null").groupBy("_seed").agg(F.count("*").alias("n"), F.min("_many").alias("_all"))
    per_seed = common.saved(per_seed.where("n > 1 and not _all"))
    few, crowd = per_seed.where(F.col("n") <= CROWD).select("_seed"), per_seed.where(F.col("n") > CROWD).select("_seed")

    def sort(batches):
        held, size, last, group = [], 0, None, []

        def out():
            found = repeats_in(held, width)
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), _GONE.types, strict=True)], schema=_GONE) if found else None

        for b in batches:
            for seed, *segment in zip(*(b.column(c).to_pylist() for c in ("_seed", "_id", "_start", "_n", "_many", "_bytes")), strict=True):
                if seed != last:
                    held += group
                    group, last = [], seed
                    if size >= SHARD:
                        if (x := out()) is not None:
                            yield x
                        held, size = [], 0
                group.append(tuple(segment))
                size += len(segment[-1]) + 1
        held += group
        if held and (x := out()) is not None:
            yield x

    def windows(batches):
        for b in batches:
            strings, place = [], []
            for seed, _id, start, n, many, x in zip(*(b.column(c).to_pylist() for c in ("_seed", "_id", "_start", "_n", "_many", "_bytes")), strict=True):
                strings += [x[i : i + width] for i in range(n)]
                place += [(seed, _id, start + i, 1, many) for i in range(n)]
            if strings:
                seed, _id, start, n, many = (np.array(x) for x in zip(*place, strict=True))
                for x in folded(*keyed(strings), seed, _id, start.astype(np.int32), n.astype(np.int32), many.astype(bool), strings):
                    yield x.set_column(7, _ROW.field(7), pa.nulls(x.num_rows, pa.binary()))

    sorted_out = distinct.join(few, "_seed").repartition("_seed").sortWithinPartitions("_seed").mapInArrow(sort, _GONE_SQL)
    told_apart = grouped(distinct.join(crowd, "_seed").select("_seed", "_id", "_start", "_n", "_many", "_bytes").mapInArrow(windows, _ROW_SQL))
    place = ["_id", "_start", "_n"]
    return found.where("_k2 is null").select(place).union(sorted_out).union(told_apart.where("_k2 is null").select(place))


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 200, bits: int = 26, carry: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """Cuts every byte covered by a string of ``width`` bytes that begins anywhere else in the
    corpus too, its own document included, judged on the input as UTF-8 bytes.

    Returns (id_col, n_bytes, n_removed, spans, kept): removed byte ranges [from, to) and
    the bytes left, which may begin or end within a character; with ``as_text`` they are
    a string without such halves.  The columns ``carry`` are handed on.

    Each window of ``width`` bytes has a seed, so equal windows meet under one seed.  Runs of
    windows with a common seed are segments; only those whose seed may occur twice
    (count-min sketch of fixed size) leave their document, and equal segments fold before they
    are moved on.  Seeds with several different segments go to shards of a bounded number of bytes, whose suffix arrays are
    built by induced sorting; a window is repeated where the permuted common prefix
    with a neighbour is ``width`` or longer.  The few seeds with more than ``CROWD`` different
    segments, such as those at the edge of a passage found in very many documents, are told apart by
    hashes of their single windows instead, so that no shard grows with a group.

    Null text counts as empty.  Two rows with one id and one text are two documents, each a
    copy of the other; rows with one id and different texts lose the places found in any of them, as far as their text
    reaches.  A row without id is
    returned whole and does not count.  Other columns are ignored.
    """
    docs = common.documents(df, id_col, text_col, carry)
    found = repeated_windows(docs.select("_id", "_text").where(F.col("_id") != common.NO_ID), width, bits).groupBy("_id").agg(F.collect_list(F.struct("_start", "_n")).alias("_gone"))
    found = common.saved(found)
    maybe = sketch.among(found.select("_id"))

    carried = [f"_x{k}" for k in range(len(carry))]

    def cut(batches):
        for b in batches:
            out = []
            for t, gone in zip(b.column("_text").to_pylist(), b.column("_gone").to_pylist(), strict=True):
                raw = (t or "").encode()
                if not gone:
                    out.append((len(raw), 0, [], raw))
                    continue
                step = np.zeros(len(raw) + 1, np.int64)
                np.add.at(step, [min(x["_start"], len(raw)) for x in gone], 1)
                np.add.at(step, [min(x["_start"] + x["_n"] - 1 + width, len(raw)) for x in gone], -1)
                mask = np.cumsum(step[:-1]) > 0
                spans = runs(mask)
                out.append((len(raw), int(mask.sum()), [{"from": x, "to": y} for x, y in spans], np.frombuffer(raw, np.uint8)[~mask].tobytes()))
            if out:
                n, gone, spans, kept = zip(*out, strict=True)
                if as_text:
                    kept = [x.decode("utf-8", "ignore") for x in kept]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c) for c in carried), b.column("_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), pa.array(kept, pa.string() if as_text else pa.binary())],
                    names=[*carried, "_id", "n_bytes", "n_removed", "spans", "kept"],
                )

    own = T.StructType.fromDDL(f"n_bytes long, n_removed long, spans array<struct<from: long, to: long>>, kept {'string' if as_text else 'binary'}")
    schema = T.StructType([*docs.select(*carried, "_id").schema, *own])
    # only texts that lose something move to meet their places; merged at every size, as both sides grow
    lose = docs.where(maybe("_id")).join(found.hint("merge"), "_id", "left").mapInArrow(cut, schema)
    whole = F.coalesce("_text", F.lit(""))
    kept = {"n_bytes": F.octet_length(whole).cast("long"), "n_removed": F.lit(0).cast("long"), "spans": F.array().cast(own["spans"].dataType), "kept": whole if as_text else whole.cast("binary")}
    out = lose.unionByName(docs.where(~maybe("_id")).select(*carried, "_id", *[c.alias(k) for k, c in kept.items()]))
    return out.select(common.real_id().alias(id_col), *[F.col(x).alias(c) for x, c in zip(carried, carry, strict=True)], "n_bytes", "n_removed", "spans", "kept")
