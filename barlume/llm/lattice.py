"""Near-duplicate vectors: random projections decoded to the E8 lattice, cosine verified."""

from __future__ import annotations

from functools import cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlume.llm import common, text

#: Rows of a cell compared with each other in one task; larger cells are cut into blocks of
#: that many and every two blocks meet.
ROWS = 2048


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest point with whole coordinates of even sum: rounding, where the sum is odd the
    coordinate rounded worst goes the other way."""
    r = np.rint(x)
    off = x - r
    worst = np.argmax(np.abs(off), axis=1)
    odd = np.flatnonzero(r.sum(axis=1) % 2 != 0)
    r[odd, worst[odd]] += np.where(off[odd, worst[odd]] >= 0, 1.0, -1.0)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest point of E8, the even whole points and those moved by one half."""
    a, b = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(closer[:, None], a, b)


@cache
def shortest() -> np.ndarray:
    """The shortest vectors of E8: from a cell to those that touch it most."""
    whole = [np.bincount([i, j], [a, b], 8) for i, j in combinations(range(8), 2) for a, b in product((-1, 1), repeat=2)]
    half = [np.array(s) / 2 for s in product((-1, 1), repeat=8) if np.prod(s) > 0]
    return np.array(whole + half)


@cache
def projection(dim: int, tables: int, blocks: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(11))
    return rng.normal(size=(tables * blocks * 8, dim)) * scale, rng.random(tables * blocks * 8)


def cells(v: np.ndarray, tables: int, blocks: int, scale: float) -> np.ndarray:
    """Keys (vectors x tables x 2**blocks) of the cells that unit vectors visit.  The first of a
    table is its own; the others replace the lattice point of some blocks by the neighbour next closest."""
    p, shift = projection(v.shape[1], tables, blocks, scale)
    x = (v @ p.T + shift).reshape(-1, 8)
    own = nearest_e8(x)
    away = x - own
    s = shortest()
    beside = own + s[np.argmin(2.0 - 2.0 * away @ s.T, axis=1)]
    weight = text.mix(np.arange(1, 9, dtype=np.uint64))
    key = [text.mix(((2 * c).astype(np.int64).view(np.uint64) * weight).sum(axis=1)).reshape(len(v), tables, blocks) for c in (own, beside)]
    out = np.zeros((len(v), tables, 1 << blocks), np.uint64)
    for visit in range(1 << blocks):
        h = np.broadcast_to(np.arange(tables, dtype=np.uint64) + np.uint64(v.shape[1] << 16), (len(v), tables))
        for b in range(blocks):
            h = text.mix(h * np.uint64(3) + key[visit >> b & 1][:, :, b])
        out[:, :, visit] = h
    return out.view(np.int64)


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def packed(v: np.ndarray) -> bytes:
    """The vector in single precision where that holds it exactly."""
    single = v.astype(np.float32)
    return b"s" + single.tobytes() if (single == v).all() else b"d" + v.tobytes()


def unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.float32 if b[:1] == b"s" else np.float64, offset=1).astype(np.float64)


def links(v: np.ndarray, visits: np.ndarray, here: int, least: float, block: np.ndarray, pair: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(similar, counted): which rows are similar, and which of these links are this group's to
    count.  A link belongs to the first cell in which its vectors meet, one of them at home."""
    similar = v @ v.T >= least
    np.fill_diagonal(similar, False)
    if pair[0] != pair[1]:
        similar &= block[:, None] != block[None, :]
    counted = similar.copy()
    if not similar.any():
        return similar, counted
    tables, n_visits = visits.shape[1:]
    # the cells of a pair in order: table by table, its cells by key
    for table in range(tables):
        own = visits[:, table, :]
        is_here = bool((own == here).any())
        for a in range(n_visits):
            for b in (range(n_visits) if a == 0 else (0,)):
                met = own[:, a][:, None] == own[:, b][None, :]
                if is_here:
                    met &= own[:, a][:, None] < here
                counted &= ~met
                if a != b:
                    counted &= ~met.T
        if is_here:
            home = own[:, 0] == here
            counted &= home[:, None] | home[None, :]
            similar &= home[:, None] | home[None, :]
            break
    return similar, counted


def smallest_reached(similar: np.ndarray, ids: np.ndarray) -> np.ndarray:
    label = ids.copy()
    while True:
        near = np.where(similar, label[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
        after = np.minimum(label, near)
        if (after == label).all():
            return label
        label = after


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, tables: int = 8, blocks: int = 2, scale: float = 0.5) -> DataFrame:
    """(id_col, n_links, component_id, kept) for every row: how many other vectors have a cosine
    of ``least`` or more with it, the smallest id reachable by such links, and whether that is its own.

    Equal vectors are one class with a count.  A table projects the unit vectors at random to ``blocks`` times eight
    dimensions and decodes each eight to the nearest point of E8; a vector visits its own cell and
    those where some points are replaced by the next closest.  Vectors that meet, one at home, are
    compared in double precision; a link is counted in the first cell only, so no list of pairs is made, and a
    group hands on one edge per vector to the smallest id it reaches there.  Cells with more than ``ROWS``
    rows are cut into blocks, and every two blocks meet in a group of their own.
    Pairs are missed with a probability that falls with ``tables``; none below ``least`` are linked.

    Null vectors, zero vectors and those with null or non-finite components have no links, nor has a row
    without id; vectors of different length are never linked.  Rows with equal id count as several vectors
    and share one class.  Other columns are ignored.
    """
    every = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(common.NO_ID)).alias("_id"), F.col(vector_col).cast("array<double>").alias("_v"))
    finite = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fit = F.coalesce(finite & F.exists("_v", lambda x: x != 0) & (F.col("_id") != common.NO_ID), F.lit(False))
    fine = every.where(fit)
    classes = common.saved(fine.groupBy("_v").agg(F.min("_id").alias("_class"), F.count("*").alias("_m")))

    def visit(batches):
        for b in batches:
            by_dim: dict[int, list[int]] = {}
            vectors = b.column("_v").to_pylist()
            for i, x in enumerate(vectors):
                by_dim.setdefault(len(x), []).append(i)
            for at in by_dim.values():
                for lo in range(0, len(at), 512):
                    part = at[lo : lo + 512]
                    raw = np.array([vectors[i] for i in part])
                    c = cells(unit(raw), tables, blocks, scale)
                    pick = pa.array(part)
                    yield pa.RecordBatch.from_arrays(
                        [b.column("_class").take(pick), b.column("_m").take(pick), pa.array([packed(x) for x in raw], pa.binary()), pa.array([x.tobytes() for x in c], pa.binary()), pa.array([np.unique(x).tolist() for x in c], pa.list_(pa.int64()))],
                        names=["_class", "_m", "_u", "_visits", "_cells"],
                    )

    rows = common.saved(classes.mapInArrow(visit, "_class long, _m long, _u binary, _visits binary, _cells array<long>"))
    size = rows.select(F.explode("_cells").alias("_cell")).groupBy("_cell").agg(F.count("*").alias("_n"))
    size = common.saved(size.where("_n > 1").select("_cell", F.ceil(F.col("_n") / ROWS).cast("int").alias("_parts")))
    part = F.pmod(F.xxhash64("_class"), F.col("_parts")).cast("int")
    seats = rows.select("_class", "_m", "_u", "_visits", F.explode("_cells").alias("_cell")).join(size, "_cell").withColumn("_part", part)
    seats = seats.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    seats = seats.select("_cell", F.least("_part", "_with").alias("_one"), F.greatest("_part", "_with").alias("_two"), "_part", "_class", "_m", "_u", "_visits")

    def compare(batches):
        def judge(key, group):
            ids, m = np.array([g[1] for g in group]), np.array([g[2] for g in group])
            u = unit(np.array([unpacked(g[3]) for g in group]))
            visits = np.array([np.frombuffer(g[4], np.int64) for g in group]).reshape(len(group), tables, 1 << blocks)
            similar, counted = links(u, visits, key[0], least, np.array([g[0] for g in group]), key[1:])
            some = np.flatnonzero(similar.any(axis=1))
            if len(some):
                reached = smallest_reached(similar[np.ix_(some, some)], ids[some])
                return ids[some], (counted[some] * m).sum(axis=1), reached

        last, group = None, []
        for b in batches:
            for cell, one, two, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (cell, one, two) != last:
                    if len(group) > 1 and (x := judge(last, group)):
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in x], names=["a", "n", "b"])
                    last, group = (cell, one, two), []
                group.append(row)
        if len(group) > 1 and (x := judge(last, group)):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in x], names=["a", "n", "b"])

    sorted_seats = seats.repartition("_cell", "_one", "_two").sortWithinPartitions("_cell", "_one", "_two")
    found = common.saved(sorted_seats.mapInArrow(compare, "a long, n long, b long").groupBy("a", "b").agg(F.sum("n").alias("n")))
    counts = found.groupBy(F.col("a").alias("_class")).agg(F.sum("n").alias("_links"))
    reach = common.components(found.select("a", "b")).select(F.col("id").alias("_class"), "component")
    about = common.saved(classes.join(counts, "_class", "left").join(reach, "_class", "left").select(
        "_v", "_class", (F.coalesce("_links", F.lit(0)) + F.col("_m") - 1).alias("_links"), F.coalesce("component", "_class").alias("_component")))
    placed = fine.select("_id", "_v").join(about.withColumnRenamed("_links", "n_links").select("_v", "n_links", "_component"), "_v").select("_id", "n_links", F.col("_component").alias("component_id"))
    alone = every.where(~fit).select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"))
    out = placed.union(alone)
    return out.select(common.real_id().alias(id_col), "n_links", common.real_id("component_id").alias("component_id"), (F.col("_id") == F.col("component_id")).alias("kept"))
