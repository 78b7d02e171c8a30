"""Joins over time: as-of, interval, first crossing, folds."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from barlume.operators.series import BARS, Series, as_utc, asof, asof_many, attach, chunked, epoch_seconds, materialise, micros_of, windowed


def plus_seconds(ts: Column, seconds: Column | int) -> Column:
    c = F.lit(seconds) if isinstance(seconds, int) else seconds
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), c.cast("decimal(18,6)"))


def modal_gap(bars: DataFrame, s: Series = BARS, out: str = "gap_seconds") -> DataFrame:
    """Most frequent distance between bars; the smaller one on ties."""
    gaps = windowed(
        bars, s, lambda d, w: d.withColumn("_g", epoch_seconds(s.ts) - F.lag(epoch_seconds(s.ts)).over(w)), back=1
    ).where("_g IS NOT NULL")
    counts = gaps.groupBy(*s.keys, "_g").agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*s.keys).agg(F.max_by("_g", F.struct("_n", -F.col("_g"))).alias(out))


def completed(slower: DataFrame, columns: Sequence[str], s: Series = BARS, step_seconds: int | None = None) -> DataFrame:
    """Slower bars stamped with the time from which they may be used: a bar
    starting at t with width d is complete at t + d."""
    if step_seconds is None:
        slower = slower.join(modal_gap(slower, s, "_step"), list(s.keys))
    else:
        slower = slower.withColumn("_step", F.lit(step_seconds))
    return slower.select(*s.keys, plus_seconds(F.col(s.ts), F.col("_step")).alias("_done"), *columns)


def align_completed(
    base: DataFrame, slower: DataFrame, columns: Sequence[str], s: Series = BARS, step_seconds: int | None = None
) -> DataFrame:
    """Values of the latest slower bar that was complete at each base bar."""
    return asof(base, completed(slower, columns, s, step_seconds), columns, s, right_ts="_done")


def align_many(base: DataFrame, slower: Sequence[tuple[DataFrame, Sequence[str], int]], s: Series = BARS) -> DataFrame:
    """Several slower timeframes (bars, columns, width in seconds) in one scan."""
    return asof_many(base, [(completed(d, cols, s, sec), "_done", cols) for d, cols, sec in slower], s)


def asof_strict(left: DataFrame, right: DataFrame, payload: Sequence[str], s: Series = BARS, tie: Sequence[str] = ()) -> DataFrame:
    """Latest right row strictly before each left row."""
    return asof(left, right, payload, s, tie=tie, strict=True)


def event_window(bars: DataFrame, events: DataFrame, pre_seconds: int, post_seconds: int, out: str = "event_window_flag", s: Series = BARS) -> DataFrame:
    """Flags bars within [event - pre, event + post].

    The latest event at or before ts + pre decides, so this is one as-of scan on
    shifted times; the calendar may be of any size and nothing is broadcast.
    """
    shifted = bars.withColumnRenamed("ts", "_at").withColumn("ts", plus_seconds(F.col("_at"), pre_seconds))
    flat = Series(keys=(), order=("ts",), slice_seconds=86400)
    ev = events.select("event_ts", F.col("event_ts").alias("_ev"))
    j = asof(shifted, ev, ["_ev"], flat, right_ts="event_ts", tie=("instrument",))
    hit = F.col("_ev") >= plus_seconds(F.col("_at"), -post_seconds)
    return j.withColumn(out, F.coalesce(hit, F.lit(False)).cast("int")).drop("ts", "_ev").withColumnRenamed("_at", "ts")


def first_touch(low: np.ndarray, high: np.ndarray, start: np.ndarray, down: np.ndarray, up: np.ndarray) -> np.ndarray:
    """Per query the first row from ``start`` on with ``low <= down`` or ``high >= up``, or -1; missing values touch nothing.

    Extremes of pairs, of pairs of pairs and so on lead every query up to the first block that holds a touch and down again."""
    n, found = len(low), np.full(len(start), -1)
    if n == 0:
        return found
    depth = (n - 1).bit_length()
    pad = np.full((1 << depth) - n, np.nan)
    lows, highs = [np.concatenate([low, pad])], [np.concatenate([high, pad])]
    for _ in range(depth):
        lows.append(np.fmin(lows[-1][::2], lows[-1][1::2]))
        highs.append(np.fmax(highs[-1][::2], highs[-1][1::2]))
    touched = lambda k, node, q: (lows[k][node] <= down[q]) | (highs[k][node] >= up[q])
    level = np.full(len(start), -1)
    q = np.flatnonzero(start < n)
    node = start[q]
    for k in range(depth + 1):  # a left child waits for its parent, a right child is looked at alone
        look = (node & 1 == 1) | (k == depth)
        hit = np.zeros(len(q), dtype=bool)
        hit[look] = touched(k, node[look], q[look])
        level[q[hit]], found[q[hit]] = k, node[hit]
        node, q = (node + look)[~hit] >> 1, q[~hit]
        inside = node < 1 << max(depth - k - 1, 0)
        node, q = node[inside], q[inside]
    for k in range(depth, 0, -1):
        q = np.flatnonzero(level == k)
        left = found[q] * 2
        found[q], level[q] = left + ~touched(k - 1, left, q), k - 1
    return found


def _first_touches(buy: np.ndarray, start: np.ndarray, down: np.ndarray, up: np.ndarray, path: Sequence[np.ndarray]) -> np.ndarray:
    """``first_touch`` on the prices of each side; path: buy_lo, buy_hi, sell_lo, sell_hi."""
    found = np.full(len(buy), -1)
    for side, low, high in ((buy, path[0], path[1]), (~buy, path[2], path[3])):
        found[side] = first_touch(low, high, start[side], down[side], up[side])
    return found


def first_crossing(
    positions: DataFrame, path: DataFrame, strict: bool = True, tie: str = "event_id", levels: Sequence[int] = (3600,), chunk_rows: int = 100_000,
) -> DataFrame:
    """First path row after the start at which a position's exit level is touched.

    positions: position_id, instrument, side, start_ts, stop, target.
    path: instrument, ts, ``tie``, and low/high seen by long (buy_lo, buy_hi) and
    by short positions (sell_lo, sell_hi).  NaN counts as infinite.

    Positions stand in the series of their instrument's path rows, which is cut into chunks of about ``chunk_rows`` rows
    (``levels[0]`` seconds are the first unit of cutting).  Each chunk finds the touches inside it and, for the positions left
    open, the first later chunk whose extremes touch; only these positions move, once, to that chunk,
    parted where a chunk ends very many of them.  No pair of a position and a row is ever made, so
    the work follows the number of rows, however dense they are and however long positions are held.
    """
    long = F.coalesce(F.col("side") == "BUY", F.lit(False))
    at_path, at_start = (0, 1) if strict else (1, 0)
    kind, name_kind = path.schema["ts"].dataType, positions.schema["position_id"].dataType
    number = lambda c: F.when(F.isnan(c), float("inf")).otherwise(c)
    double = lambda c: number(F.col(c).cast("double"))
    tied = path.schema[tie].dataType.typeName()
    tie_value = F.coalesce(micros_of(path, tie), F.lit(0)) if tied.startswith("timestamp") else F.coalesce(F.col(tie).cast("bigint"), F.lit(0)) if tied in ("byte", "short", "integer", "long") else F.coalesce(F.col(tie).cast("string"), F.lit(""))
    row = path.select("instrument", F.col("ts").alias("_at"), F.lit(at_path).alias("_tag"), tie_value.alias("_id"), *[double(c).alias(n) for c, n in (("buy_lo", "_a"), ("buy_hi", "_b"), ("sell_lo", "_c"), ("sell_hi", "_d"))])
    id_kind = row.schema["_id"].dataType
    down, up = F.when(long, double("stop")).otherwise(double("target")), F.when(long, double("target")).otherwise(double("stop"))
    start = positions.where("position_id IS NOT NULL").select(
        "instrument", F.col("start_ts").cast(kind).alias("_at"), F.lit(at_start).alias("_tag"), F.lit(0).cast(id_kind).alias("_id"), down.alias("_a"), up.alias("_b"), "position_id", long.alias("_buy"),
    )
    # no nulls in the columns of the other kind: they would turn whole numbers into doubles
    row = row.withColumns({"position_id": F.lit(0).cast(name_kind), "_buy": F.lit(False)})
    both = row.unionByName(start, allowMissingColumns=True).where(F.col("_at").isNotNull() & F.col("instrument").isNotNull())
    rows = chunked(both, Series(ts="_at", order=("_at", "_tag", "_id"), slice_seconds=levels[0], chunk_rows=chunk_rows))
    rows = rows.select("instrument", "_chunk", micros_of(rows, "_at").alias("_us"), "_tag", "_id", "_a", "_b", "_c", "_d", "position_id", "_buy")
    is_path = F.col("_tag") == at_path
    only = lambda c: F.when(is_path, F.col(c))
    ext = materialise(rows.groupBy("instrument", "_chunk").agg(F.min(only("_a")).alias("_a"), F.max(only("_b")).alias("_b"), F.min(only("_c")).alias("_c"), F.max(only("_d")).alias("_d")))
    lists = ext.groupBy("instrument").agg(F.sort_array(F.collect_list(F.struct("_chunk", "_a", "_b", "_c", "_d"))).alias("_l"))  # one entry per chunk
    heads = ext.select("instrument", "_chunk").join(lists, "instrument").select("instrument", "_chunk", *[F.col(f"_l.{c}").alias(f"_l{c}") for c in ("_chunk", "_a", "_b", "_c", "_d")])
    prices = ["_a", "_b", "_c", "_d"]

    def in_order(pdf):
        return pdf.iloc[np.lexsort([pdf[c].to_numpy() for c in ("_d", "_c", "_b", "_a", "_id", "_tag", "_us")])]

    def ended(pos, found, walked):
        """Positions with the row that closes them."""
        hit = np.flatnonzero(found >= 0)
        out, x = pos.iloc[hit][["instrument", "position_id", "_buy", "_a", "_b"]].copy(), walked.iloc[found[hit]]
        out["_next"], out["_us"], out["_id"] = 0, x["_us"].to_numpy(), x["_id"].to_numpy()
        out["_quote"] = np.where(out["_buy"].to_numpy(dtype=bool), x["_a"].to_numpy(), x["_d"].to_numpy())
        return out

    def own_chunk(left, right):
        left = in_order(left)
        starts = (left["_tag"] == at_start).to_numpy()
        pos, walked = left[starts], left[~starts]
        limits = pos["_buy"].to_numpy(dtype=bool), pos["_a"].to_numpy(), pos["_b"].to_numpy()
        found = _first_touches(limits[0], np.cumsum(~starts)[starts], *limits[1:], [walked[c].to_numpy() for c in prices])
        chunks, *extremes = (np.asarray(right[f"_l{c}"].iloc[0], dtype=float) for c in ("_chunk", *prices))
        open_ = pos[found < 0]
        first = np.full(len(open_), np.searchsorted(chunks, left["_chunk"].iloc[0], "right"))
        later = _first_touches(limits[0][found < 0], first, *(x[found < 0] for x in limits[1:]), extremes)
        moved = open_[later >= 0].assign(_next=chunks[later[later >= 0]].astype(np.int64), _us=0, _quote=np.nan)
        names = ["instrument", "position_id", "_buy", "_a", "_b", "_next", "_us", "_id", "_quote"]
        return pd.concat([ended(pos, found, walked)[names], moved[names]]).astype({"_buy": bool, "_next": "int64", "_us": "int64"})

    def next_chunk(left, right):
        walked = in_order(right)
        found = _first_touches(left["_buy"].to_numpy(dtype=bool), np.zeros(len(left), dtype=np.int64), left["_a"].to_numpy(), left["_b"].to_numpy(), [walked[c].to_numpy() for c in prices])
        return ended(left, found, walked)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in both.select("instrument", "position_id", "_buy", "_a", "_b").schema) + f", _next bigint, _us bigint, _id {id_kind.simpleString()}, _quote double"
    first = materialise(rows.groupBy("instrument", "_chunk").cogroup(heads.groupBy("instrument", "_chunk")).applyInPandas(own_chunk, schema))
    moved = first.where("_next > 0")
    parts = materialise(moved.groupBy("instrument", F.col("_next").alias("_chunk")).agg(F.ceil(F.count(F.lit(1)) / chunk_rows).cast("int").alias("_parts")))
    walked = attach(rows.where(is_path).select("instrument", "_chunk", "_us", "_tag", "_id", *prices), parts, ["instrument", "_chunk"]).withColumn("_part", F.explode(F.sequence(F.lit(1), F.col("_parts")))).drop("_parts")
    moved = attach(moved.withColumn("_chunk", F.col("_next")), parts, ["instrument", "_chunk"]).withColumn("_part", F.pmod(F.xxhash64("position_id"), F.col("_parts")).cast("int") + 1).drop("_parts")
    by = ("instrument", "_chunk", "_part")
    second = moved.groupBy(*by).cogroup(walked.groupBy(*by)).applyInPandas(next_chunk, schema)
    hits = first.where("_next = 0").unionByName(second).groupBy("position_id").agg(F.min(F.struct("_us", "_id", "_quote")).alias("_x"))
    out = positions.join(hits, "position_id", "left")
    when = F.timestamp_micros(F.col("_x._us"))
    stop_hit = F.when(long, F.col("_x._quote") <= double("stop")).otherwise(F.col("_x._quote") >= double("stop"))
    return out.select(
        *positions.columns, (as_utc(when) if kind.typeName() == "timestamp_ntz" else when.cast(kind)).alias("exit_ts"),
        F.when(F.col("_x").isNotNull(), F.when(stop_hit, "stop_loss").otherwise("take_profit")).alias("exit_reason"),
        F.col("_x._quote").alias("exit_quote"),
    )


def latest_tick(ticks: DataFrame, asof_ts: Column | None = None, within_seconds: int = 3600) -> DataFrame:
    """Latest tick per instrument in the last hour before ``asof_ts``
    (default: the newest tick of all)."""
    if asof_ts is None:
        now = ticks.agg(F.max("ts").alias("_now"))
        ticks = ticks.crossJoin(F.broadcast(now))
    else:
        ticks = ticks.withColumn("_now", asof_ts)
    recent = ticks.where((F.col("ts") >= plus_seconds(F.col("_now"), -within_seconds)) & (F.col("ts") <= F.col("_now")))
    row = F.max_by(F.struct("ts", "event_id", "bid", "ask", "price"), F.struct("ts", "event_id"))
    return recent.groupBy("instrument").agg(row.alias("_r")).select("instrument", "_r.*")


def unrealised_pnl(positions: DataFrame, quotes: DataFrame) -> DataFrame:
    """PnL at the closing quote: bid for longs, ask for shorts."""
    j = positions.join(quotes.select("instrument", "bid", "ask"), "instrument", "left")
    pnl = F.when(F.col("side") == "BUY", F.col("bid") - F.col("entry")).otherwise(F.col("entry") - F.col("ask"))
    return j.withColumn("unrealised", pnl * F.col("quantity"))


def position_summary(pnl: DataFrame) -> DataFrame:
    return pnl.groupBy("instrument").agg(
        F.count(F.lit(1)).alias("positions"),
        F.count(F.when(F.col("side") == "BUY", 1)).alias("long_positions"),
        F.count(F.when(F.col("side") == "SELL", 1)).alias("short_positions"),
        F.sum("unrealised").alias("unrealised"),
    )


def returns(bars: DataFrame, s: Series = BARS) -> DataFrame:
    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        return d.withColumn("ret", F.col("close") / F.nullif(F.lag("close").over(w), F.lit(0.0)) - 1)

    return windowed(bars, s, build, back=1)


def wide_by_instrument(rows: DataFrame, value: str, instruments: Sequence[str]) -> DataFrame:
    """One row per time, one column per configured instrument."""
    aggs = [F.max(F.when(F.col("instrument") == i, F.col(value))).alias(f"v{n}") for n, i in enumerate(instruments)]
    return rows.groupBy("ts").agg(*aggs)


def pairwise_aligned(wide: DataFrame, instruments: Sequence[str]) -> DataFrame:
    """Rows (ts, a, b, ra, rb) where both sides are present; one scan, no self-join."""
    pairs = [
        F.when(F.col(f"v{i}").isNotNull() & F.col(f"v{j}").isNotNull(),
               F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"v{i}").alias("ra"), F.col(f"v{j}").alias("rb")))
        for i, a in enumerate(instruments) for j, b in enumerate(instruments) if i < j
    ]
    return wide.select("ts", F.explode(F.array_compact(F.array(*pairs))).alias("_p")).select("ts", "_p.*")


def pair_correlations(wide: DataFrame, names: Sequence, cols: Sequence[str] | None = None) -> DataFrame:
    """Correlation of every column pair in one aggregation pass."""
    cols = cols or [f"v{i}" for i in range(len(names))]
    aggs, items = [], []
    for i in range(len(names)):
        for j in range(i + 1, len(names)):
            aggs.append(F.corr(cols[i], cols[j]).alias(f"_{i}_{j}"))
            items.append(F.struct(F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"), F.col(f"_{i}_{j}").alias("corr")))
    return wide.agg(*aggs).select(F.explode(F.array(*items)).alias("_p")).select("_p.*")


def align_outcomes(predictions: DataFrame, labels: DataFrame, pnl: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key has a prediction, a label and a PnL, without those that lack any value."""
    return predictions.join(labels, list(on)).join(pnl, list(on)).dropna()


def merge_timeframes(frames: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """All timeframes as one event sequence: by time, instrument, then bar width."""
    out = None
    for name, (df, seconds) in frames.items():
        part = df.withColumns({"timeframe": F.lit(name), "tf_seconds": F.lit(seconds)})
        out = part if out is None else out.unionByName(part)
    return out.orderBy("ts", "instrument", "tf_seconds")
