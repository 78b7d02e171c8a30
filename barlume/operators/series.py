"""Skew-proof building blocks for ordered data.

A window partitioned by instrument alone puts one whole series into one task,
and one instrument may hold a third of all rows.  Everything ordered in this
package is therefore built on *chunks*: a series is cut into consecutive pieces
of roughly ``chunk_rows`` rows, and the neighbouring rows a bounded frame needs
(the halo) are copied into each piece.  Cutting uses only per-slice row counts, a
table with one row per (key, slice), so no global sort is ever needed; a slice with too many rows is cut further.

* ``windowed``  bounded look-back / look-ahead frames
* ``running``   frames that start at the beginning of the series (two-level scan)
* ``ewm``       exponential recurrences, as weighted running sums inside blocks
* ``asof``      latest right row at or before each left row
* ``quantiles`` exact percentiles without collecting a group in one place
* ``average_rank`` tie-averaged ranks
"""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from decimal import Decimal

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F


def epoch_seconds(ts: str | Column) -> Column:
    """Whole seconds since 1970, independent of the session time zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    day = F.unix_date(c.cast("date")).cast("bigint")
    return day * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


def epoch_micros(ts: str | Column) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    frac = F.extract(F.lit("SECOND"), c) * 1_000_000
    return (epoch_seconds(c) - F.second(c)) * 1_000_000 + frac.cast("bigint")


def as_instant(ts: str | Column) -> Column:
    """UTC time without zone as an instant (watermarks need one)."""
    return F.timestamp_micros(epoch_micros(ts))


def as_utc(instant: Column) -> Column:
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz"))


_WHOLE = ("byte", "short", "integer", "long")
#: Stand for a null time and a null tie: below every real one.
_NO_TIME, _NO_TIE = -(10**18 - 1), -(2**63) - 1


def micros_of(df: DataFrame, c: str) -> Column:
    return epoch_micros(c) if df.schema[c].dataType.typeName() == "timestamp_ntz" else F.unix_micros(c)


def share_of(n: Column, ratio: float) -> Column:
    """Whole part of ``n * ratio`` with the ratio as it is written: 0.7 of 720 is 504, not the 503 that doubles give."""
    return F.floor(n.cast("decimal(19,0)") * F.lit(Decimal(str(ratio)))).cast("bigint")


def order_key(df: DataFrame, order: Sequence[str]) -> Column:
    """One number in the order of (time, whole number), or of one of them: aggregates that
    pick a row by it need no sort.  Any other order is a struct.  Null comes first, as in a sort, and never
    hides a row from ``min_by`` or ``max_by``."""
    kinds = [df.schema[c].dataType.typeName() for c in order]
    times = [k.startswith("timestamp") for k in kinds]
    wholes = [k in _WHOLE for k in kinds]
    time = lambda c: F.coalesce(micros_of(df, c).cast("decimal(18,0)"), F.lit(Decimal(_NO_TIME)))
    whole = lambda c: F.coalesce(F.col(c).cast("decimal(20,0)"), F.lit(Decimal(_NO_TIE)))
    if len(order) == 1 and (times[0] or wholes[0]):
        return time(order[0]) if times[0] else whole(order[0])
    if len(order) == 2 and times[0] and wholes[1]:
        return (time(order[0]) * F.lit(Decimal(2 * 10**19)) + whole(order[1])).cast("decimal(38,0)")
    return F.struct(*order)


@dataclass(frozen=True)
class Series:
    """How rows form ordered series and how long series are cut.

    ``slice_seconds`` is the first unit of cutting; slices of over ``chunk_rows`` rows are cut again, as
    ``slices`` says.  ``slice_by`` replaces it when the order is not by time.
    """

    keys: tuple[str, ...] = ("instrument",)
    ts: str = "ts"
    order: tuple[str, ...] = ("ts",)
    slice_seconds: int = 28 * 86400
    chunk_rows: int = 20_000
    slice_by: Column | str | None = None

    def slice_id(self) -> Column:
        if self.slice_by is not None:
            by = F.expr(self.slice_by) if isinstance(self.slice_by, str) else self.slice_by
            return by.cast("bigint")
        if self.slice_seconds % 86400 == 0:
            return F.floor(F.unix_date(F.col(self.ts).cast("date")) / F.lit(self.slice_seconds // 86400)).cast("bigint")
        return F.floor(epoch_seconds(self.ts) / F.lit(self.slice_seconds)).cast("bigint")

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, "_chunk").orderBy(*self.order)

    def tied(self, rows: DataFrame) -> "Series":
        """The same with the order that crowded ties were cut by, if any were."""
        return self.with_(order=(*self.order, "_tie")) if "_tie" in rows.columns and "_tie" not in self.order else self

    def with_(self, **kw) -> "Series":
        return replace(self, **kw)


BARS = Series()
TICKS = Series(order=("ts", "event_id"), slice_seconds=86400)


#: Parts into which a crowded slice is cut at a time.
_FAN = 64
_MOST = 1e308
_NUMBERS = (*_WHOLE, "float", "double", "decimal")


def _steps(df: DataFrame, s: Series) -> list[tuple[Column, bool]]:
    """What a crowded slice can be cut by, coarse to fine: (column, whether it is a number that can be cut into ranges)."""
    out = []
    for c in s.order:
        kind = df.schema[c].dataType.typeName()
        if kind in ("timestamp", "timestamp_ntz"):
            out.append((micros_of(df, c), True))
        elif kind == "date":
            out.append((F.unix_date(c).cast("bigint"), True))
        else:
            out.append((F.col(c).cast("bigint") if kind in _WHOLE else F.col(c).cast("double") if kind in _NUMBERS else F.col(c), kind in _NUMBERS))
    return out


def slices(df: DataFrame, s: Series) -> tuple[DataFrame, DataFrame, list[str]]:
    """(rows, counts, names): rows tagged with the columns ``names`` of their slice, and the rows per key and slice.

    A slice is a span of the clock (or of ``slice_by``) as long as it has ``chunk_rows`` rows at most.  A larger one is cut
    into ranges of time between its first and last row, ranges that are still too large again, and so on down to one instant; an instant
    is cut by the further order columns in the same way, and rows that are equal in all of them by a hash of the row, which
    then is the last order column (``_tie``).  Each cut counts only the rows of crowded slices; where none is crowded, one count is all.
    Only rows that are equal in every column stay together whatever their number.
    """
    k = list(s.keys)
    rows, names = df.withColumn("_slice", s.slice_id()), ["_slice"]
    counts = materialise(rows.groupBy(*k, *names).agg(F.count(F.lit(1)).alias("_n")))
    crowded = F.col("_n") > s.chunk_rows
    if not counts.where(crowded).limit(1).count():
        return rows, counts, names
    steps = _steps(df, s)
    hashed = [c for c in df.columns if df.schema[c].dataType.typeName() not in ("map", "variant")]
    steps.append((F.xxhash64(*hashed), True))
    # NaN and the infinities stand at the ends of the finite numbers, so that every range can be divided
    finite = lambda x: F.when(F.isnan(x), _MOST).otherwise(F.greatest(F.least(x, F.lit(_MOST)), F.lit(-_MOST)))
    rows = rows.withColumns({f"_by{i}": F.when(value.isNotNull(), finite(value.cast("double"))) if ranged else value for i, (value, ranged) in enumerate(steps)}).withColumn("_tie", steps[-1][0])
    limits = [f(f"_by{i}").alias(f"_{n}{i}") for i, (_, ranged) in enumerate(steps) if ranged for f, n in ((F.min, "lo"), (F.max, "hi"))]
    tie_used = False
    counts = materialise(rows.groupBy(*k, *names).agg(F.count(F.lit(1)).alias("_n"), *limits))
    for i, (_, ranged) in enumerate(steps):
        lo, hi, by = F.col("_lo"), F.col("_hi"), F.col(f"_by{i}")
        part = F.least(F.floor((by / 4 - lo / 4) / (hi / 4 - lo / 4) * _FAN), F.lit(_FAN - 1)).cast("bigint")
        for _ in range(_FAN):  # a cut parts the least from the greatest, so a few do
            big = counts.where(crowded)
            if ranged:
                big = big.where(F.col(f"_lo{i}") < F.col(f"_hi{i}")).withColumnsRenamed({f"_lo{i}": "_lo", f"_hi{i}": "_hi"})
            big = big.select(*k, *names, F.lit(True).alias("_cut"), *(("_lo", "_hi") if ranged else ()))
            if not big.limit(1).count():
                break
            name = f"_slice{len(names)}"
            value = F.when(F.col("_cut") & by.isNotNull(), part) if ranged else F.when(F.col("_cut"), by)  # least() passes over nulls
            # a structure is never null, so uncut slices and null values join as well; written, as every cut reads the rows again
            rows = materialise(attach(rows, big, [*k, *names], "left").withColumn(name, F.struct(value.alias("v"))).drop("_cut", "_lo", "_hi"))
            names = [*names, name]
            counts = materialise(rows.groupBy(*k, *names).agg(F.count(F.lit(1)).alias("_n"), *limits))
            tie_used = i == len(steps) - 1
            if not ranged:
                break
    rows = rows.drop(*(f"_by{i}" for i in range(len(steps))), *(() if tie_used else ("_tie",)))
    return rows, counts.select(*k, *names, "_n"), names


def chunk_map(counts: DataFrame, names: Sequence[str], s: Series, back: int = 0, ahead: int = 0) -> DataFrame:
    """(key, slice) -> chunks that need the slice; `_own` marks its home chunk.

    The windows here run over slice counts (one row per key and slice), never
    over the data rows.
    """
    k = list(s.keys)
    by_slice = Window.partitionBy(*k).orderBy(*names)
    counts = counts.withColumn("_end", F.sum("_n").over(by_slice.rowsBetween(Window.unboundedPreceding, 0)))
    counts = counts.withColumn("_begin", F.col("_end") - F.col("_n"))
    raw = F.floor(F.col("_begin") / F.lit(s.chunk_rows))
    counts = counts.withColumn("_raw", raw)
    home = F.dense_rank().over(Window.partitionBy(*k).orderBy("_raw")).cast("bigint")
    counts = counts.withColumn("_home", home)
    if back == 0 and ahead == 0:
        out = counts.withColumn("_chunk", F.col("_home"))
    else:
        nxt = F.lead("_home").over(by_slice)
        counts = counts.withColumn("_next", nxt)
        lo = F.col("_home")
        hi = F.col("_home")
        if ahead:
            frame = Window.partitionBy(*k).orderBy("_begin").rangeBetween(Window.unboundedPreceding, -ahead)
            lo = F.coalesce(F.max("_home").over(frame), F.lit(1))
        if back:
            frame = Window.partitionBy(*k).orderBy("_end").rangeBetween(Window.unboundedPreceding, back - 1)
            hi = F.greatest(F.col("_home"), F.coalesce(F.max("_next").over(frame), F.col("_home")))
        out = counts.withColumn("_lo", lo).withColumn("_hi", hi)
        out = out.withColumn("_chunk", F.explode(F.sequence("_lo", "_hi")))
    out = out.withColumn("_base", F.min("_begin").over(Window.partitionBy(*k, "_chunk")))
    return out.select(*k, *names, "_chunk", (F.col("_chunk") == F.col("_home")).alias("_own"), "_base")


def chunked(df: DataFrame, s: Series, back: int = 0, ahead: int = 0) -> DataFrame:
    """Rows tagged with `_chunk`, `_own` (false for halo copies) and `_base`, and with `_tie`
    where ties had to be cut."""
    rows, counts, names = slices(df, s)
    mapping = chunk_map(counts, names, s, back, ahead)
    return rows.join(mapping, [*s.keys, *names]).drop(*names)


def position(w: WindowSpec) -> Column:
    """Zero-based row position in the whole series (inside ``windowed``, over its window)."""
    return F.col("_base") + F.row_number().over(w) - 1


def windowed(
    df: DataFrame,
    s: Series,
    build: Callable[[DataFrame, WindowSpec], DataFrame],
    back: int = 0,
    ahead: int = 0,
) -> DataFrame:
    """Apply ``build(rows, window)`` chunk by chunk; frames may reach ``back``
    rows backwards and ``ahead`` rows forwards."""
    rows = chunked(df, s, back, ahead)
    return build(rows, s.tied(rows).window()).where("_own").drop("_chunk", "_own", "_base", "_tie")


def running(
    df: DataFrame,
    s: Series,
    sums: dict[str, Column] | None = None,
    maxs: dict[str, Column] | None = None,
    mins: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    prevs: dict[str, Column] | None = None,
    peaks: dict[str, str] | None = None,
    row_no: str | None = None,
    prepare: Callable[[DataFrame, WindowSpec], DataFrame] | None = None,
    back: int = 0,
) -> DataFrame:
    """Inclusive running aggregates over the whole series (``prevs``: the last
    non-null value strictly before the row).

    Each chunk is scanned on its own; the totals of the chunks before it (one row
    per chunk) are then added, so no task sees more than one chunk.  ``prepare``
    may first add columns that look back ``back`` rows, on the same chunks.
    ``peaks`` maps an output to a name in ``sums`` and gives the running maximum
    of that running sum in the same scan.
    """
    peaks = peaks or {}
    specs = [
        (kind, name, col)
        for kind, group in (("sum", sums), ("max", maxs), ("min", mins), ("last", lasts), ("prev", prevs))
        for name, col in (group or {}).items()
    ]
    k = list(s.keys)
    rows = chunked(df, s, back)
    s = s.tied(rows)
    if prepare is not None:
        rows = prepare(rows, s.window()).where("_own")
    keep = [c for c in rows.columns if c not in ("_chunk", "_own", "_base", "_tie")]
    rows = rows.select("*", *[c.alias(f"_in_{n}") for _, n, c in specs])
    if prepare is None:
        rows = rows.repartition(*k, "_chunk")
    upto = s.window().rowsBetween(Window.unboundedPreceding, 0)
    local, total = [], []
    for kind, name, _ in specs:
        c = F.col(f"_in_{name}")
        if kind in ("last", "prev"):
            frame = upto if kind == "last" else s.window().rowsBetween(Window.unboundedPreceding, -1)
            local.append(F.last(c, ignorenulls=True).over(frame).alias(f"_lo_{name}"))
            key = F.when(c.isNotNull(), F.struct(*s.order))
            total.append(F.max_by(c, key).alias(f"_to_{name}"))
        else:
            agg = {"sum": F.sum, "max": F.max, "min": F.min}[kind]
            local.append(agg(c).over(upto).alias(f"_lo_{name}"))
            total.append(agg(c).alias(f"_to_{name}"))
    top = {}
    for name, of in peaks.items():
        # highest local running sum inside the chunk, so far and in total
        top[f"_lo_{name}"] = F.max(f"_lo_{of}").over(upto)
    if specs:
        before = Window.partitionBy(*k).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        if peaks:
            rows = rows.withColumns({f"_lo_{of}": F.sum(f"_in_{of}").over(upto) for of in peaks.values()})
            total += [F.max(f"_lo_{of}").alias(f"_to_{name}") for name, of in peaks.items()]
            local = [c for (kind, n, _), c in zip(specs, local) if n not in peaks.values()] + [F.col(f"_lo_{of}") for of in set(peaks.values())]
        carry = rows.groupBy(*k, "_chunk").agg(*total)
        carry_cols = []
        for kind, name, _ in specs:
            c = F.col(f"_to_{name}")
            if kind in ("last", "prev"):
                carry_cols.append(F.last(c, ignorenulls=True).over(before).alias(f"_ca_{name}"))
            else:
                agg = {"sum": F.sum, "max": F.max, "min": F.min}[kind]
                carry_cols.append(agg(c).over(before).alias(f"_ca_{name}"))
        if peaks:
            sofar = {of: F.coalesce(F.sum(f"_to_{of}").over(before), F.lit(0)) for of in peaks.values()}
            carry = carry.withColumns({f"_ab_{name}": sofar[of] + F.col(f"_to_{name}") for name, of in peaks.items()})
            carry_cols += [F.max(f"_ab_{name}").over(before).alias(f"_ca_{name}") for name in peaks]
        carry = carry.select(*k, "_chunk", *carry_cols)
    if row_no and prepare is not None:
        raise ValueError("row numbers need rows without halo")
    extra = [(position(s.window()) + 1).alias("_rn")] if row_no else []
    out = rows.select(*keep, "_chunk", *(c for c in s.order if c not in keep), *local, *extra)
    if top:
        out = out.withColumns(top)
    if specs:
        out = out.join(carry, [*k, "_chunk"], "left")
    final = []
    for kind, name, _ in specs:
        lo, ca = F.col(f"_lo_{name}"), F.col(f"_ca_{name}")
        if kind == "sum":
            both = F.when(lo.isNull(), ca).when(ca.isNull(), lo).otherwise(lo + ca)
        elif kind == "max":
            both = F.greatest(lo, ca)
        elif kind == "min":
            both = F.least(lo, ca)
        else:
            both = F.coalesce(lo, ca)
        final.append(both.alias(name))
    for name, of in peaks.items():
        final.append(F.greatest(F.col(f"_ca_{name}"), F.coalesce(f"_ca_{of}", F.lit(0)) + F.col(f"_lo_{name}")).alias(name))
    if row_no:
        final.append(F.col("_rn").alias(row_no))
    return out.select(*keep, *final)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir, and in it one for this
    application.  Without the setting a run on one machine gets a temporary folder; on several
    machines there is no folder to guess, so it fails."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/barlume-{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Deletes what this application wrote into the shared folder; its tables cannot be read any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


#: Whether a query's shuffle files go when it ends, not when the driver next collects its garbage.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, folder: str | None = None, tidy: bool = False) -> DataFrame:
    """Writes an intermediate once as Parquet in the shared folder and reads it
    back: later steps start from a pruned columnar scan of known size instead of
    repeating everything before, and a lost executor costs no recomputation.  With a ``folder`` the rows
    join those written there before.  ``tidy`` removes the shuffle files of the writing."""
    spark = df.sparkSession
    path = folder or new_folder(spark)
    before = spark.conf.get(_TIDY, None)
    if tidy:
        spark.conf.set(_TIDY, "true")
    try:
        df.write.mode("append").parquet(path)
    finally:
        if tidy:
            spark.conf.unset(_TIDY) if before is None else spark.conf.set(_TIDY, before)
    return spark.read.schema(df.schema).parquet(path)


def attach(rows: DataFrame, params: DataFrame, keys: Sequence[str], how: str = "inner", most: int = 10_000, salts: int = 32) -> DataFrame:
    """Joins a table of few rows per key to rows of which one key may hold most.

    The table is written and counted: up to ``most`` rows it is broadcast and the rows are not moved; a larger one is
    repeated under ``salts`` numbers, and each row takes one of them, so a frequent key spreads over as many tasks."""
    p, keys = materialise(params), list(keys)
    if p.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(p), keys, how)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    return salted.join(p.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [*keys, "_salt"], how).drop("_salt")


def ewm_memory(alpha: float) -> int:
    """Rows after which an exponential weight falls below double precision."""
    return max(1, math.ceil(math.log(1e-17) / math.log(1.0 - alpha)))


def ewm_columns(df: DataFrame, s: Series, specs: dict[str, tuple[Column, float, int]]) -> DataFrame:
    """Recurrence y_t = a*x_t + (1-a)*y_(t-1) on already chunked rows.

    ``specs`` maps an output name to (input, alpha, minimum count).  The first
    non-null input starts the series.  A chunk is cut further into blocks of
    4*memory rows (plus one memory of halo) so that the scaled running sum
    ``(1-a)^t * sum(x_j * (1-a)^-j)`` stays far from overflow; a block's older
    history weighs less than 1e-17 and drops out of double precision.
    """
    by_memory: dict[int, list[str]] = {}
    for name, (_, a, _) in specs.items():
        by_memory.setdefault(ewm_memory(a), []).append(name)
    s = s.tied(df)
    keep = list(df.columns)
    out = df.select("*", *[c.alias(f"_x_{n}") for n, (c, _, _) in specs.items()])
    done: list[str] = []
    for mem, names in by_memory.items():
        size = 4 * mem
        out = out.withColumn("_p", F.row_number().over(s.window()) - 1)
        block = F.floor(F.col("_p") / size).cast("bigint")
        twice = (F.col("_p") % size >= size - mem)
        out = out.withColumn("_b", F.explode(F.when(twice, F.array(block, block + 1)).otherwise(F.array(block))))
        out = out.withColumn("_home_b", F.col("_b") == block)
        w = Window.partitionBy(*s.keys, "_chunk", "_b").orderBy(*s.order)
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        rel = (F.col("_p") - (F.col("_b") * size - mem)).cast("double")
        cols = []
        for n in names:
            _, a, least = specs[n]
            x = F.col(f"_x_{n}")
            r = F.lit(1.0 - a)
            seen = F.count(x).over(upto)
            weight = F.when(F.col(f"_s_{n}") == 1, F.lit(1.0)).otherwise(F.lit(a))
            out = out.withColumn(f"_s_{n}", F.when(x.isNotNull(), seen))
            y = F.sum(x * weight * F.pow(r, -rel)).over(upto) * F.pow(r, rel)
            cols.append(F.when(seen >= max(least, 1), y).alias(n))
        flags = ["_home_b"]
        passed = [f"_x_{n}" for n in specs if n not in names and n not in done]
        out = out.select(*keep, *done, *passed, *flags, *cols).where("_home_b").drop("_home_b")
        done += names
    return out


def ewm(df: DataFrame, s: Series, specs: dict[str, tuple[Column, float, int]], back: int = 0) -> DataFrame:
    """``ewm_columns`` with its own chunking; inputs may look back ``back`` rows
    through plain window columns added beforehand by the caller."""
    reach = max(ewm_memory(a) for _, a, _ in specs.values())
    return windowed(df, s, lambda d, w: ewm_columns(d, s, specs), back=reach + back)


def asof(
    left: DataFrame,
    right: DataFrame,
    payload: Sequence[str],
    s: Series,
    right_ts: str = "ts",
    tie: Sequence[str] = (),
    strict: bool = False,
) -> DataFrame:
    """Add to each left row the payload of the latest right row with
    ``right_ts <= ts`` (``<`` when ``strict``)."""
    return asof_many(left, [(right, right_ts, payload)], s, tie, strict)


def asof_many(
    left: DataFrame,
    rights: Sequence[tuple[DataFrame, str, Sequence[str]]],
    s: Series,
    tie: Sequence[str] = (),
    strict: bool = False,
) -> DataFrame:
    """As-of join with several right sides at once.

    All rows are united, tagged and scanned once with a running "last value" per
    right side: no non-equi join, and one shuffle however many sides there are.
    Right rows of equal time are ordered by their payload.
    """
    k = list(s.keys)
    before, after = (1, 0) if strict else (0, 1)
    lcols = [c for c in left.columns if c not in k and c != s.ts]
    ties = [f"_t{i}" for i in range(len(tie))]
    both = left.select(
        *k, s.ts, F.lit(after).alias("_tag"), *[F.col(c).alias(n) for c, n in zip(tie, ties)],
        (F.struct(*lcols) if lcols else F.lit(1)).alias("_l"),
    )
    for i, (right, right_ts, payload) in enumerate(rights):
        r = right.select(
            *k, F.col(right_ts).alias(s.ts), F.lit(before).alias("_tag"),
            *[F.lit(None).cast(left.schema[c].dataType).alias(n) for c, n in zip(tie, ties)],
            F.struct(*payload).alias(f"_r{i}"),
        )
        both = both.unionByName(r, allowMissingColumns=True)
    order = (s.ts, "_tag", *ties, *[f"_r{i}" for i in range(len(rights))])
    res = running(both, s.with_(order=order), lasts={f"_hit{i}": F.col(f"_r{i}") for i in range(len(rights))})
    res = res.where(F.col("_tag") == after)
    got = [F.col(f"_hit{i}.{c}").alias(c) for i, (_, _, payload) in enumerate(rights) for c in payload]
    return res.select(*k, s.ts, *[F.col(f"_l.{c}").alias(c) for c in lcols], *got)


#: Chunks, or blocks of them, whose state maps are composed together, and how often blocks are formed.
_FAN, _LEVELS = 256, 2


def state_scan(moves: np.ndarray, start: int | None = None) -> np.ndarray:
    """Walk of a finite-state rule over rows, ``moves[i, state]`` being the state after row ``i``.

    Without ``start`` the end state of every start state, else the state before each row.  Rows are laid out in
    blocks, one step moves all blocks and all states at once, and only the blocks are chained one by one."""
    n, n_states = moves.shape
    size = max(1, math.isqrt(n))
    own = np.arange(n_states, dtype=moves.dtype)
    moves = np.concatenate([moves, np.tile(own, (-n % size, 1))]).reshape(-1, size, n_states)
    ends = np.tile(own, (len(moves), 1))
    for i in range(size):
        ends = np.take_along_axis(moves[:, i], ends, axis=1)
    if start is None:
        for m in ends:
            own = m[own]
        return own
    states = np.empty((len(moves), size), moves.dtype)
    at = np.empty(len(moves), moves.dtype)
    for j, m in enumerate(ends):
        at[j], start = start, m[start]
    for i in range(size):
        states[:, i] = at
        at = moves[np.arange(len(moves)), i, at]
    return states.reshape(-1)[:n]


def chunk_starts(maps: DataFrame, keys: Sequence[str], chunk: str, start: int) -> DataFrame:
    """(keys, chunk, state): the state in which each chunk starts, from the ``ends`` of all start states per chunk.

    Maps compose in any grouping, so blocks of chunks are composed first, then blocks of blocks; a key's last step reads
    one row per ``_FAN ** _LEVELS`` chunks, and the start states go down the same way."""
    k = list(keys)
    flat = maps.select(F.struct(F.lit(0).alias("_"), *k).alias("_k"), F.col(chunk).cast("bigint").alias("_c"), "ends")
    in_order = F.array_sort(F.collect_list(F.struct("_c", "ends"))).alias("_maps")
    ups = []
    for _ in range(_LEVELS):
        block = flat.groupBy("_k", F.floor(F.col("_c") / F.lit(_FAN)).cast("bigint").alias("_b")).agg(in_order)
        own = F.sequence(F.lit(0), F.size(F.col("_maps")[0]["ends"]) - 1)
        ups.append(block)
        flat = block.select("_k", F.col("_b").alias("_c"), F.aggregate("_maps", own, lambda acc, m: F.transform(acc, lambda st: F.get(m["ends"], st))).alias("ends"))

    def down(lists: DataFrame, first: Column) -> DataFrame:
        states = F.aggregate("_maps", F.array(first), lambda acc, m: F.concat(acc, F.array(F.get(m["ends"], F.element_at(acc, -1)))))
        each = lists.select("_k", "_maps", states.alias("_states")).select("_k", F.explode(F.transform("_maps", lambda m, i: F.struct(m["_c"].alias("_c"), F.get("_states", i).alias("state")))).alias("_z"))
        return each.select("_k", "_z._c", "_z.state")

    states = down(flat.groupBy("_k").agg(in_order), F.lit(start))
    for block in reversed(ups):
        states = down(block.join(states.withColumnRenamed("_c", "_b"), ["_k", "_b"]), F.col("state"))
    return states.select(*[F.col("_k")[c].alias(c) for c in k], F.col("_c").cast(maps.schema[chunk].dataType).alias(chunk), "state")


def _folded(rows: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str], start: int, ends_of: Callable, replay_from: Callable, schema: str) -> DataFrame:
    k = list(keys)
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*k, chunk).schema)
    by = [*order, *(["_tie"] if "_tie" in rows.columns else [])]

    def ends(pdf):
        out = pdf[[*k, chunk]].head(1).copy()
        out["ends"] = [[int(x) for x in ends_of(pdf.sort_values(by, kind="stable"))]]
        return out

    def replay(left, right):
        state = start if left.empty else int(right["state"].iloc[0])
        return replay_from(left.sort_values(by, kind="stable"), state)

    maps = materialise(rows.groupBy(*k, chunk).applyInPandas(ends, f"{key_schema}, ends array<int>"))
    starts = chunk_starts(maps, k, chunk, start)
    return rows.groupBy(*k, chunk).cogroup(starts.groupBy(*k, chunk)).applyInPandas(replay, schema)


def fold(
    rows: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str], n_states: int, start: int,
    run: Callable, schema: str,
) -> DataFrame:
    """Sequential rule with a small state over long series, chunk by chunk.

    ``run(pdf, state) -> (out_pdf, state)`` walks one sorted chunk.  Pass one asks
    every chunk where each of the ``n_states`` start states would end; these maps
    are composed (``chunk_starts``); pass two replays each chunk
    from its now known start state.  No task holds more than one chunk.  For rules whose state also
    tells what a row does, ``fold_moves`` reads each row once a pass.
    """
    return _folded(rows, keys, chunk, order, start, lambda pdf: [run(pdf, st)[1] for st in range(n_states)], lambda pdf, st: run(pdf, st)[0], schema)


def fold_moves(
    rows: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str], start: int,
    moves: Callable, emit: Callable, schema: str,
) -> DataFrame:
    """``fold`` for rules given as moves: ``moves(pdf)`` is an integer array (rows, states) of the state after each row,
    for every state before it, and ``emit(pdf, before, after)`` makes the output from the states met.  All start
    states are followed in one pass of array steps (``state_scan``)."""

    def replay(pdf, state):
        m = moves(pdf)
        before = state_scan(m, state)
        return emit(pdf, before, m[np.arange(len(m)), before])

    return _folded(rows, keys, chunk, order, start, lambda pdf: state_scan(moves(pdf)), replay, schema)


# ---------------------------------------------------------------- order statistics

_BINS = 4096


def _bin(v: Column, lo: Column, hi: Column) -> Column:
    width = (hi - lo) / F.lit(float(_BINS))
    return F.when(width > 0, F.least(F.floor((v - lo) / width), F.lit(_BINS - 1))).otherwise(F.lit(0)).cast("bigint")


def _join_keys(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    return a.join(b, list(keys), how) if keys else a.crossJoin(b)


def quantiles(df: DataFrame, keys: Sequence[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated quantiles per key, one row per key.

    Rows are first folded to (value, count) and written once.  Two rounds of 4096 bins
    narrow each wanted rank down to one sliver of the value range, and only the distinct
    values in those slivers are ordered.
    """
    k = list(keys)
    vals = materialise(df.where(F.col(value).isNotNull()).groupBy(*k, F.col(value).cast("double").alias("_v")).agg(
        F.count(F.lit(1)).alias("_m")
    ))
    stats = vals.groupBy(*k).agg(F.min("_v").alias("_mn"), F.max("_v").alias("_mx"), F.sum("_m").alias("_cnt"))
    vals = _join_keys(vals, stats, k)
    vals = vals.withColumn("_b1", _bin(F.col("_v"), F.col("_mn"), F.col("_mx")))
    width = (F.col("_mx") - F.col("_mn")) / F.lit(float(_BINS))
    lo1 = F.col("_mn") + F.col("_b1") * width
    vals = vals.withColumn("_b2", F.greatest(_bin(F.col("_v"), lo1, lo1 + width), F.lit(0)))
    ranks = F.array_distinct(
        F.flatten(F.array(*[F.array(F.floor(F.lit(q) * (F.col("_cnt") - 1)), F.ceil(F.lit(q) * (F.col("_cnt") - 1))) for q in qs.values()]))
    )

    def cut(data: DataFrame, by: list[str], bin_col: str, wanted: str) -> DataFrame:
        """Keep bins that hold a wanted rank; `_off` is the rank at bin start."""
        bins = data.groupBy(*k, *by, bin_col).agg(F.sum("_m").alias("_bm"), F.first(wanted).alias("_want"), *([F.first("_off").alias("_o")] if by else []))
        w = Window.partitionBy(*k, *by).orderBy(bin_col).rowsBetween(Window.unboundedPreceding, -1)
        base = F.coalesce(F.sum("_bm").over(w), F.lit(0))
        start = (base + F.col("_o")) if by else base
        bins = bins.withColumn("_st", start)
        hit = F.exists("_want", lambda r: (r >= F.col("_st")) & (r < F.col("_st") + F.col("_bm")))
        bins = bins.where(hit).select(*k, *by, bin_col, F.col("_st").alias("_off"))
        return data.drop("_off").join(bins, [*k, *by, bin_col])

    vals = vals.withColumn("_want", ranks)
    vals = cut(vals, [], "_b1", "_want")
    vals = cut(vals, ["_b1"], "_b2", "_want")
    w = Window.partitionBy(*k, "_b1", "_b2").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    vals = vals.withColumn("_end", F.sum("_m").over(w) + F.col("_off"))
    vals = vals.withColumn("_beg", F.col("_end") - F.col("_m"))

    picks = []
    for name, q in qs.items():
        pos = F.lit(q) * (F.col("_cnt") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        picks.append(F.max(F.when((lo >= F.col("_beg")) & (lo < F.col("_end")), F.col("_v"))).alias(f"_l_{name}"))
        picks.append(F.max(F.when((hi >= F.col("_beg")) & (hi < F.col("_end")), F.col("_v"))).alias(f"_h_{name}"))
    got = vals.groupBy(*k).agg(F.first("_cnt").alias("_cnt"), *picks)
    outs = []
    for name, q in qs.items():
        pos = F.lit(q) * (F.col("_cnt") - 1)
        lo, hi = F.col(f"_l_{name}"), F.col(f"_h_{name}")
        outs.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return got.where("_cnt is not null").select(*k, *outs)


def value_ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per (key, distinct value): count `_m`, average rank `_rank`
    (1-based, ties averaged), rows before `_below` and rows per key `_cnt`."""
    k = list(keys)
    vals = materialise(df.where(F.col(value).isNotNull()).groupBy(*k, F.col(value)).agg(F.count(F.lit(1)).alias("_m")))
    stats = vals.groupBy(*k).agg(
        F.min(value).alias("_mn"), F.max(value).alias("_mx"), F.sum("_m").alias("_cnt")
    )
    vals = _join_keys(vals, stats, k)
    v, lo, hi = (F.col(c).cast("double") for c in (value, "_mn", "_mx"))
    width = (hi - lo) / F.lit(float(_BINS))
    b1 = _bin(v, lo, hi)
    b2 = F.greatest(_bin(v, lo + b1 * width, lo + (b1 + 1) * width), F.lit(0))
    vals = vals.withColumn("_sl", b1 * _BINS + b2)  # fine cells; sparse ones share a chunk
    s = Series(keys=tuple(k), order=(value,), slice_by=F.col("_sl"))
    out = running(vals, s, sums={"_upto": F.col("_m")})
    below = F.col("_upto") - F.col("_m")
    return out.select(*k, value, "_m", "_cnt", below.alias("_below"), (below + (F.col("_m") + 1) / 2).alias("_rank"))


def average_rank(df: DataFrame, keys: Sequence[str], value: str, out: str, pct: bool = False) -> DataFrame:
    """Average rank of each row's value inside its key (NULL stays NULL)."""
    r = value_ranks(df, keys, value)
    rank = F.col("_rank") / F.col("_cnt") if pct else F.col("_rank")
    return df.join(r.select(*keys, value, rank.alias(out)), [*keys, value], "left")
