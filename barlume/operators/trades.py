"""Set form of trade accounting: fills, FIFO trades, equity, financing."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barlume.operators.align import asof_strict, first_crossing
from barlume.operators.series import BARS, Series, materialise, new_folder, running, windowed

FILLS = Series(order=("seq",), slice_by="floor(seq / 4096)")


def next_open_fill(signals: DataFrame, bars: DataFrame, s: Series = BARS) -> DataFrame:
    """Fill at the open of the bar after the signal bar."""

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        return d.withColumns({"fill_ts": F.lead(s.ts).over(w), "fill_mid": F.lead("open").over(w)})

    nxt = windowed(bars.select(*s.keys, s.ts, "open"), s, build, ahead=1).drop("open")
    return signals.join(nxt, [*s.keys, s.ts]).where("fill_ts IS NOT NULL")


def bar_path(bars: DataFrame) -> DataFrame:
    """Bars as a price path for ``first_crossing``: both sides see low and high."""
    return bars.select(
        "instrument", "ts", F.col("low").alias("buy_lo"), F.col("high").alias("buy_hi"), F.col("low").alias("sell_lo"), F.col("high").alias("sell_hi")
    )


def touch_fill(signals: DataFrame, bars: DataFrame) -> DataFrame:
    """First bar from the signal bar on that reaches the entry price: low at or
    below it for longs, high at or above it for shorts."""
    want = signals.select("position_id", "instrument", "side", F.col("ts").alias("start_ts"), F.col("entry_price").alias("stop"), F.lit(None).cast("double").alias("target"))
    hit = first_crossing(want, bar_path(bars), strict=False, tie="ts")
    return hit.select("position_id", "instrument", "side", F.col("start_ts").alias("ts"), F.col("stop").alias("entry_price"), F.col("exit_ts").alias("fill_ts"))


def resolve_exits(positions: DataFrame, bars: DataFrame) -> DataFrame:
    """Stop or target exit from the fill bar on; the stop wins on the same bar.
    The exit price is the touched level."""
    out = first_crossing(positions, bar_path(bars), strict=False, tie="ts")
    price = F.when(F.col("exit_reason") == "stop_loss", F.col("stop")).when(F.col("exit_reason") == "take_profit", F.col("target"))
    return out.withColumn("exit_price", price).drop("exit_quote")


def _unit_intervals(fills: DataFrame) -> DataFrame:
    """Each fill as the interval [lo, hi) of units on its side of the book."""
    s = FILLS.with_(keys=("instrument", "side"))
    d = running(fills, s, sums={"_hi": F.col("quantity")})
    return d.withColumn("_lo", F.col("_hi") - F.col("quantity"))


def fifo_trades(fills: DataFrame, bucket_units: int = 500) -> DataFrame:
    """Realised trades by first-in-first-out matching.

    The k-th unit bought closes against the k-th unit sold, so trades are the
    overlaps of the two sides' unit intervals and the earlier fill is the entry.
    Intervals are cut into unit buckets: the join has an equality key (instrument,
    bucket), a hot instrument spreads over its buckets, and a pair counts only in
    the bucket where the overlap starts.
    """
    u = _unit_intervals(fills)
    u = u.withColumn("_unit_cost", F.col("commission") / F.greatest(F.col("quantity"), F.lit(1)))
    first, last = F.floor(F.col("_lo") / bucket_units), F.floor((F.col("_hi") - 1) / bucket_units)
    u = u.where("quantity > 0").withColumn("_b", F.explode(F.sequence(first, last)))
    side = lambda name, p: u.where(F.col("side") == name).select(
        "instrument", "_b", *[F.col(c).alias(f"{p}_{c.strip('_')}") for c in ("seq", "ts", "price", "_lo", "_hi", "_unit_cost")]
    )
    j = side("BUY", "b").join(side("SELL", "s"), ["instrument", "_b"])
    lo, hi = F.greatest("b_lo", "s_lo"), F.least("b_hi", "s_hi")
    j = j.where((lo < hi) & (F.floor(lo / bucket_units) == F.col("_b")))
    long = F.col("b_seq") < F.col("s_seq")
    qty = hi - lo
    pick = lambda c, entry: F.when(long == F.lit(entry), F.col(f"b_{c}")).otherwise(F.col(f"s_{c}"))
    d = j.select(
        "instrument", pick("ts", False).alias("ts"), pick("seq", False).alias("exit_seq"), pick("seq", True).alias("entry_seq"),
        F.when(long, "BUY").otherwise("SELL").alias("entry_side"), F.when(long, "SELL").otherwise("BUY").alias("exit_side"),
        qty.alias("quantity"), pick("price", True).alias("entry_price"), pick("price", False).alias("exit_price"),
        ((F.col("b_unit_cost") + F.col("s_unit_cost")) * qty).alias("commission"), pick("ts", True).alias("entry_ts"),
    )
    gross = (F.col("exit_price") - F.col("entry_price")) * F.col("quantity") * F.when(F.col("entry_side") == "BUY", 1).otherwise(-1)
    return d.withColumn("pnl", gross - F.col("commission"))


def open_lots(fills: DataFrame) -> DataFrame:
    """Units left open: what one side holds beyond the other side's total."""
    u = _unit_intervals(fills)
    tot = fills.groupBy("instrument").agg(
        F.sum(F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(0)).alias("_tb"), F.sum(F.when(F.col("side") == "SELL", F.col("quantity")).otherwise(0)).alias("_ts")
    )
    matched = F.least("_tb", "_ts")
    left = F.col("_hi") - F.greatest(F.col("_lo"), matched)
    d = u.join(tot, "instrument").withColumn("open_quantity", left).where(F.col("open_quantity") > 0)
    return d.withColumn("_unit_cost", F.col("commission") / F.col("quantity")).select("instrument", "seq", "side", "open_quantity", "price", "_unit_cost")


def mark_to_market(fills: DataFrame, trades: DataFrame, initial: float) -> DataFrame:
    """Per instrument: realised, unrealised at the last price, reserved entry commission."""
    lots = open_lots(fills)
    last = fills.groupBy("instrument").agg(F.max_by("price", "seq").alias("_px"))
    sign = F.when(F.col("side") == "BUY", 1).otherwise(-1)
    un = lots.join(last, "instrument").groupBy("instrument").agg(
        F.sum((F.col("_px") - F.col("price")) * F.col("open_quantity") * sign).alias("unrealised"),
        F.sum(F.col("open_quantity") * F.col("_unit_cost")).alias("reserved"), F.sum(F.col("open_quantity") * sign).alias("net_quantity"),
    )
    re = trades.groupBy("instrument").agg(F.sum("pnl").alias("realised"))
    d = re.join(un, "instrument", "full_outer")
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return d.select(
        "instrument", z(F.col("realised")).alias("realised"), z(F.col("unrealised")).alias("unrealised"), z(F.col("reserved")).alias("reserved"),
        F.coalesce("net_quantity", F.lit(0)).alias("net_quantity"), (initial + z(F.col("realised")) + z(F.col("unrealised")) - z(F.col("reserved"))).alias("equity"),
    )


def net_positions(fills: DataFrame) -> DataFrame:
    """Signed cumulative quantity after each fill."""
    signed = F.col("quantity") * F.when(F.col("side") == "BUY", 1).otherwise(-1)
    return running(fills, FILLS, sums={"net_quantity": signed})


def exposure_screen(orders: DataFrame, cap: float, s: Series) -> DataFrame:
    """Marks orders whose running notional would exceed the cap."""
    d = running(orders, s, sums={"exposure": F.col("notional")})
    return d.withColumn("breach", F.col("exposure") > cap)


def equity_curve(trades: DataFrame, initial: float, s: Series) -> DataFrame:
    """Equity after each trade, its running peak and drawdown share."""
    d = running(trades, s, sums={"_cum": F.col("pnl")}, peaks={"_top": "_cum"})
    d = d.withColumns({"equity": initial + F.col("_cum"), "_peak": initial + F.col("_top")}).drop("_cum", "_top")
    peak = F.greatest(F.col("_peak"), F.lit(initial))
    return d.withColumn("peak", peak).withColumn(
        "drawdown", F.when(F.col("peak") > 0, (F.col("peak") - F.col("equity")) / F.col("peak")).otherwise(0.0)
    ).drop("_peak")


def trade_stats(trades: DataFrame, keys: Sequence[str], initial: float) -> DataFrame:
    """Count, win rate, expectancy, profit factor and Sharpe.  An unbounded profit
    factor is NULL with a flag."""
    p = F.col("pnl")
    g = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"), F.avg((p > 0).cast("double")).alias("win_rate"), F.avg(p).alias("expectancy"),
        F.sum(F.greatest(p, F.lit(0.0))).alias("_win"), F.sum(F.greatest(-p, F.lit(0.0))).alias("_loss"),
        F.sum(p).alias("net_pnl"), F.stddev_samp(p).alias("_sd"),
    )
    raw = F.when((F.col("trades") >= 2) & (F.col("_sd") > 0), F.col("expectancy") / F.col("_sd")).otherwise(0.0)
    return g.select(
        *keys, "trades", "win_rate", "expectancy", "net_pnl",
        F.when(F.col("_loss") > 0, F.col("_win") / F.col("_loss")).when(F.col("_win") > 0, F.lit(None)).otherwise(0.0).alias("profit_factor"),
        ((F.col("_loss") == 0) & (F.col("_win") > 0)).alias("profit_factor_infinite"),
        raw.alias("sharpe_raw"), (raw * F.sqrt(F.col("trades").cast("double"))).alias("sharpe"),
    )


def financing(positions: DataFrame, bars: DataFrame, long_rate: float, short_rate: float, hour: int = 22, s: Series = BARS) -> DataFrame:
    """Overnight cost per position and rollover: notional * rate / 365, threefold on
    Wednesdays, marked at the last close before the rollover.

    The explosion is one row per night held.
    """
    key = lambda ts: F.date_sub((ts + F.make_dt_interval(F.lit(0), F.lit(24 - hour))).cast("date"), 1)
    first, last = F.date_add(key(F.col("open_ts")), 1), key(F.col("close_ts"))
    d = positions.where(last >= first).withColumn("roll_day", F.explode(F.sequence(first, last)))
    d = d.withColumn("ts", F.col("roll_day").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(hour)))
    d = asof_strict(d, bars.select("instrument", "ts", F.col("close").alias("_mark")), ["_mark"], s, tie=("position_id",))
    rate = F.when(F.col("side") == "BUY", long_rate).otherwise(short_rate)
    days = F.when(F.weekday("roll_day") == 2, 3).otherwise(1)
    cost = F.col("quantity") * F.coalesce("_mark", "entry_price") * rate / 365 * days
    return d.withColumn("financing", cost).select("position_id", "instrument", "side", "roll_day", "financing")


def order_fill_summary(orders: DataFrame, executions: DataFrame) -> DataFrame:
    """Filled quantity, fill share and volume-weighted price per order."""
    g = executions.groupBy("order_id").agg(F.sum("filled").alias("filled"), F.sum(F.col("filled") * F.col("price")).alias("_v"))
    d = orders.join(g, "order_id", "left")
    return d.select(
        "order_id", "ordered", F.coalesce("filled", F.lit(0)).alias("filled"),
        F.when(F.col("ordered") > 0, F.coalesce("filled", F.lit(0)) / F.col("ordered")).otherwise(0.0).alias("fill_share"),
        F.when(F.col("filled") > 0, F.col("_v") / F.col("filled")).alias("vwap"),
    )


def journal(executions: DataFrame) -> DataFrame:
    """Totals per day and per month, overall, by instrument and by mode."""
    d = executions.withColumns({"day": F.date_format("ts", "yyyy-MM-dd"), "month": F.date_format("ts", "yyyy-MM"), "notional": F.col("quantity") * F.col("price")})
    c = F.col
    sets = [[c("day")], [c("month")], [c("day"), c("instrument")], [c("month"), c("instrument")], [c("day"), c("mode")], [c("month"), c("mode")]]
    return d.groupingSets(sets, c("day"), c("month"), c("instrument"), c("mode")).agg(
        F.count(F.lit(1)).alias("executions"), F.sum("quantity").alias("quantity"), F.sum("notional").alias("notional"), F.sum("commission").alias("commission")
    )


def sleeve_step(
    rows: DataFrame, equity: Column | float, spread_bps: Column | float, slippage_bps: Column | float, commission_bps: Column | float,
    keys: Sequence[str], leverage: float = 20.0, utilisation: float = 0.5, stop_out: float = 50.0,
) -> DataFrame:
    """One-bar leveraged PnL per sleeve at a constant base equity.

    rows: keys, sleeve, side, allocation, close, high, low, close_next.  Entry and
    exit are moved against the trader; if the worst price of the bar breaks the
    stop-out level, the worst result is booked.  ``keys`` name one bar, which
    holds a handful of sleeves.
    """
    lit = lambda x: F.lit(x) if not isinstance(x, Column) else x
    eq, half = lit(equity), 0.5 * (lit(spread_bps) + lit(slippage_bps)) * 1e-4
    d = rows.where((F.col("allocation") > 0) & (F.col("side") != 0))
    bar = Window.partitionBy(*keys)
    sign = F.signum("side")
    cap = F.greatest(F.lit(0.0), eq * leverage * utilisation)
    d = d.withColumn("notional", cap * F.col("allocation") / F.greatest(F.lit(1e-12), F.sum("allocation").over(bar)))
    entry = F.col("close") * (1 + sign * half)
    d = d.withColumns({"_entry": entry, "_fee": F.abs("notional") * lit(commission_bps) * 1e-4 * 2})
    units = F.col("notional") / F.greatest(F.abs("_entry"), F.lit(1e-12))
    result = lambda px: units * (px * (1 - sign * half) - F.col("_entry")) * sign - F.col("_fee")
    worst = F.when(sign > 0, F.col("low")).otherwise(F.col("high"))
    d = d.withColumns({"_net": result(F.col("close_next")), "_worst": result(worst)})
    used = F.sum(F.col("notional") / leverage).over(bar)
    level = (eq + F.sum("_worst").over(bar)) / F.nullif(used, F.lit(0.0)) * 100
    d = d.withColumn("margin_level", level)
    d = d.withColumn("stopped_out", F.coalesce(F.col("margin_level") < stop_out, F.lit(False)))
    return d.withColumn("pnl", F.when(F.col("stopped_out"), F.col("_worst")).otherwise(F.col("_net"))).drop("_entry", "_fee", "_net", "_worst")


# Cost layers as (name, spread, slippage, commission, thresholds, tradability).
LAYERS = (
    ("gross_pre_cost", 0, 0, 0, 0, 0),
    ("after_spread", 1, 0, 0, 0, 0),
    ("after_spread_slippage", 1, 1, 0, 0, 0),
    ("full_broker_pre_threshold", 1, 1, 1, 0, 0),
    ("after_threshold_gating", 1, 1, 1, 1, 0),
    ("after_tradability_filter", 1, 1, 1, 1, 1),
)


def cost_layers(rows: DataFrame, equity: float, spread_bps: float, slippage_bps: float, commission_bps: float, bar_keys: Sequence[str]) -> DataFrame:
    """PnL and trade bars per cost layer and session; ``passed`` and ``tradable``
    gate the last two layers."""
    layers = rows.sparkSession.createDataFrame(list(LAYERS), "layer string, _sp int, _sl int, _co int, _th int, _tr int")
    d = rows.crossJoin(F.broadcast(layers)).where(((F.col("_th") == 0) | F.col("passed")) & ((F.col("_tr") == 0) | F.col("tradable")))
    d = sleeve_step(d, equity, F.col("_sp") * spread_bps, F.col("_sl") * slippage_bps, F.col("_co") * commission_bps, ["layer", *bar_keys])
    per_bar = d.groupBy("layer", "session_bucket", *bar_keys).agg(F.sum("pnl").alias("pnl"))
    return per_bar.groupBy("layer", "session_bucket").agg(F.sum("pnl").alias("pnl_sum"), F.count(F.lit(1)).alias("trade_bars"))


#: Prime and constants of the trade orders: small enough that products stay within 63 bits.
_PRIME, _STEP, _MIX = 2**31 - 1, 1_103_515_245, (69_069, 12_345)
#: Places that one job sends to their ranges, 12 bytes each; its shuffle files go before the next job starts.
_PLACES_A_JOB = 2**25


def _place(h, sim, seed: int):
    """Sort key of a trade (hash ``h`` under the prime) in a simulation, for columns and arrays alike."""
    z = (h + (sim + 1) * _STEP + seed * _MIX[0]) % _PRIME
    for _ in range(3):
        z = (z * z % _PRIME + z * _MIX[0] + _MIX[1]) % _PRIME
    return z


def _places(h: np.ndarray, sim: int, seed: int) -> np.ndarray:
    """``_place`` of an array.  2**31 leaves 1 under the prime, so upper bits are added to the lower ones in place
    of divisions; pieces stay in the cache."""
    start, out = ((sim + 1) * _STEP + seed * _MIX[0]) % _PRIME, np.empty(len(h), np.int64)
    for lo in range(0, len(h), 16_384):
        z = h[lo : lo + 16_384].astype(np.int64) + start
        z -= _PRIME * (z >= _PRIME)
        for _ in range(3):
            y = z * z
            y = (y & _PRIME) + (y >> 31)
            z *= _MIX[0]
            z += _MIX[1]
            z += y
            z = (z & _PRIME) + (z >> 31)
            z -= _PRIME * (z >= _PRIME)
        out[lo : lo + 16_384] = z
    return out


def walk_order(pnl: np.ndarray, h: np.ndarray, sim: int, initial: float, seed: int) -> tuple[float, float]:
    """Deepest drawdown and final equity of one order.  Place and number of a trade sort as one
    integer, which is as good as a stable sort by place and several times as fast."""
    key = _places(h, sim, seed)
    key <<= 32
    key |= np.arange(len(key))
    key.sort()
    key &= 0xFFFFFFFF
    equity = np.cumsum(pnl[key])
    equity += initial
    last, peak = float(equity[-1]), np.maximum.accumulate(equity)
    np.maximum(peak, initial, out=peak)
    fall = np.subtract(peak, equity, out=equity)
    fall = np.divide(fall, peak, out=fall) if initial > 0 else np.divide(fall, peak, out=np.zeros_like(peak), where=peak > 0)
    return float(fall.max()), last


def _hashed(trades: DataFrame, trade_key: Column) -> DataFrame:
    """pnl, the order in which ties stand (_k) and the hash that the orders start from (_h)."""
    d = trades.select(F.coalesce(F.col("pnl").cast("double"), F.lit(0.0)).alias("pnl"), F.md5(trade_key.cast("binary")).alias("_k"))
    return d.withColumn("_h", F.conv(F.substring("_k", 1, 12), 16, 10).cast("bigint") % _PRIME)


def _counted(d: DataFrame, rows: int) -> tuple[int, int]:
    """Trades, and the most that share a hash; where no 2**19 neighbouring hashes have over ``rows`` trades, their most."""
    n, most = d.groupBy(F.shiftright("_h", 19)).count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    return n, most if most <= rows else d.groupBy("_h").count().agg(F.max("count")).first()[0]


def _listed(d: DataFrame, n: int, rows: int) -> DataFrame:
    """Trades in the order of their keys, written once, packed by some 10,000: rows into Python are dear. ``_no`` is that of the first one; it
    counts on from part * 2**33."""
    d = d.withColumn("_k", F.unhex("_k")).repartitionByRange(max(1, -(-n // rows)), "_k").sortWithinPartitions("_k", "pnl")

    def pack(batches):
        for b in batches:
            h, pnl = b["_h"].to_numpy().astype(np.int32), b["pnl"].to_numpy()
            yield pa.RecordBatch.from_pydict({"_no": b["_no"][:1], "_h": [h.tobytes()], "pnl": [pnl.tobytes()]})

    numbered = d.select(F.monotonically_increasing_id().alias("_no"), "_h", "pnl")
    return materialise(numbered.mapInArrow(pack, "_no bigint, _h binary, pnl binary"), tidy=True)


def _unpacked(batch):
    for no, h, pnl in zip(batch["_no"], batch["_h"], batch["pnl"], strict=True):
        yield no.as_py(), np.frombuffer(h.as_buffer(), np.int32), np.frombuffer(pnl.as_buffer(), np.float64)


def _permuted_series(d: DataFrame, initial: float, n_sims: int, seed: int) -> DataFrame:
    """Each simulation as a series of rows ordered by ``_place``: several times dearer, but its chunks
    also cut places that many trades share."""
    d = d.crossJoin(F.broadcast(d.sparkSession.range(n_sims).withColumnRenamed("id", "sim")))
    d = d.withColumn("_o", _place(F.col("_h"), F.col("sim"), seed))
    s = Series(keys=("sim",), order=("_o", "_k", "pnl"), slice_by=F.shiftright("_o", 23).cast("bigint"))
    curve = equity_curve(d.select("sim", "pnl", "_o", "_k"), initial, s)
    return curve.groupBy("sim").agg(F.max("drawdown").alias("max_drawdown"), F.max_by("equity", F.struct("_o", "_k", "pnl")).alias("final_equity"))


def _scattered(sims: Sequence[int], seed: int, bits: int, rows: int):
    """Sends listed trades to the ranges of places they take: per simulation, range and ``rows`` trades one row,
    places and pnl packed."""
    packed = lambda x, at: pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * x.itemsize).astype(np.int32)), pa.py_buffer(x)])

    def run(batches):
        held, n, first, due = [], 0, 0, 0
        for batch in batches:
            for no, h, pnl in _unpacked(batch):
                if n and (n >= rows or no != due):  # a task reads pieces of several files
                    yield from send(first, held)
                    held, n = [], 0
                first = no if not n else first
                held.append((h, pnl))
                n, due = n + len(h), no + len(h)
        if n:
            yield from send(first, held)

    def send(no, held):
        h, pnl = (np.concatenate(x) for x in zip(*held))
        for sim in sims:
            z = _places(h, sim, seed)
            to = (z >> (31 - bits)).astype(np.uint16)
            order = np.argsort(to, kind="stable")
            at = np.concatenate([[0], np.cumsum(np.bincount(to, minlength=1 << bits))])
            cols = [np.full(1 << bits, sim), np.arange(1 << bits), np.full(1 << bits, no)]
            out = [*map(pa.array, cols), packed(z[order].astype(np.int32), at), packed(pnl[order], at)]
            batch = pa.RecordBatch.from_arrays(out, names=["sim", "range", "no", "places", "pnl"])
            yield batch.filter(pa.array(np.diff(at) > 0))

    return run


def _walk_range(prune: bool):
    """One range of an order, from an equity of zero: its total, its highest equity, and for each new peak
    the lowest equity before the next.  Places and numbers sort as in ``walk_order``.  ``prune``: a peak is left out if a lower
    one has as deep a fall, which is the larger share of it whatever positive equity comes before."""

    def walk(key, found):
        found = found.sort_by("no")
        z = np.frombuffer(b"".join(found["places"].to_pylist()), np.int32).astype(np.int64)
        pnl = np.frombuffer(b"".join(found["pnl"].to_pylist()), np.float64)
        z <<= 32
        z |= np.arange(len(z))
        z.sort()
        z &= 0xFFFFFFFF
        equity = np.cumsum(pnl[z])
        peak = np.maximum(np.maximum.accumulate(equity), 0.0)
        start = np.concatenate([[0], np.flatnonzero(peak[1:] != peak[:-1]) + 1])
        at, low = peak[start], np.minimum.reduceat(equity, start)
        if prune:
            fall = at - low
            deeper = np.concatenate([[True], fall[1:] > np.maximum.accumulate(fall)[:-1]])
            at, low = at[deeper], low[deeper]
        falls = pa.StructArray.from_arrays([pa.array(at), pa.array(low)], ["peak", "low"])
        falls = pa.ListArray.from_arrays(pa.array([0, len(falls)], pa.int32()), falls)
        return pa.table({"sim": key[:1], "range": key[1:], "total": [equity[-1]], "top": [peak[-1]], "falls": falls})

    return walk


def permute_by_scans(trades: DataFrame, trade_key: Column, initial: float, n_sims: int = 10_000, seed: int = 42, rows: int = 1 << 19) -> DataFrame:
    """Max drawdown and final equity of ``n_sims`` random trade orders, for any number of trades.

    The places of an order are cut into ranges of ``rows`` trades at most on average.  Trades are listed in the order of their
    keys, sent to their ranges packed (12 bytes per trade and simulation), and each range is walked alone.  What it
    keeps are its total and its peaks with the lowest equity after each: with the equity and the peak before the range, known
    once all totals are, they give its drawdown exactly.  One job moves ``_PLACES_A_JOB`` places, or those of one order, and
    leaves no shuffle files, so the disk in use follows the trades and not the simulations.  ``trades`` is read three times: give a written table.
    Where one key stands for over ``rows`` trades, places cannot be cut into ranges, and the series engine walks them.
    """
    d = _hashed(trades, trade_key)
    n, most = _counted(d, rows)
    bits = max(0, math.ceil(math.log2(max(n, 1) / rows)))
    if most > rows or bits > 16:
        return _permuted_series(materialise(d), initial, n_sims, seed)
    listed, folder = _listed(d, n, rows), new_folder(trades.sparkSession)
    at_once = max(1, min(n_sims, _PLACES_A_JOB // max(n, 1)))
    for lo in range(0, n_sims, at_once):
        sims = range(lo, min(lo + at_once, n_sims))
        sent = listed.mapInArrow(_scattered(sims, seed, bits, rows), "sim bigint, range bigint, no bigint, places binary, pnl binary")
        ranges = sent.repartition(-(-len(sims) * 2**bits // 8), "sim", "range").groupBy("sim", "range")
        walked = ranges.applyInArrow(_walk_range(initial > 0), "sim bigint, range bigint, total double, top double, falls array<struct<peak: double, low: double>>")
        d = materialise(walked, folder, tidy=True)
    before = Window.partitionBy("sim").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    heads = d.select("sim", "range", "total", "top").withColumn("_from", initial + F.coalesce(F.sum("total").over(before), F.lit(0.0)))
    heads = heads.withColumn("_peak", F.greatest(F.lit(float(initial)), F.max(F.col("_from") + F.col("top")).over(before)))
    final = heads.groupBy("sim").agg(F.max_by(F.col("_from") + F.col("total"), "range").alias("final_equity"))
    falls = d.select("sim", "range", F.explode("falls").alias("_f")).join(heads.select("sim", "range", "_from", "_peak"), ["sim", "range"])
    peak = F.greatest(F.col("_peak"), F.col("_from") + F.col("_f.peak"))
    falls = falls.select("sim", peak.alias("peak"), (F.col("_from") + F.col("_f.low")).alias("low"))
    fall = F.when(F.col("peak") > 0, (F.col("peak") - F.col("low")) / F.col("peak")).otherwise(0.0)
    return falls.groupBy("sim").agg(F.max(fall).alias("max_drawdown")).join(final, "sim")


def permute_trades(trades: DataFrame, trade_key: Column, initial: float, n_sims: int = 10_000, seed: int = 42, most: int = 1 << 22, block: int = 50) -> DataFrame:
    """sim, max_drawdown and final_equity of ``n_sims`` random orders of the trades (``trade_key`` names a trade, pnl).

    A drawdown relative to its peak depends on the equity before it, so parts of an order do not merge to
    a fixed size.  Up to ``most`` counted trades are therefore listed and written once, and each task of ``block`` simulations reads
    the list (16 bytes a trade in memory): no place is shuffled, nothing is broadcast.  More trades go by ``permute_by_scans``.  Both
    use the same orders.  Null pnl counts as 0; no trades give no rows.
    """
    d = _hashed(trades, trade_key)
    n = d.count()
    if n > most:
        return permute_by_scans(trades, trade_key, initial, n_sims, seed)
    listed = _listed(d, n, 1 << 19)
    parts = sorted(listed.groupBy(F.shiftright("_no", 33)).agg(F.sum(F.octet_length("_h") / 4).cast("bigint")).collect())  # one row per 2**19 trades
    starts = np.zeros(parts[-1][0] + 1 if parts else 0, np.int64)
    starts[[p for p, _ in parts]] = np.cumsum([0, *(c for _, c in parts)])[:-1]
    blocks = -(-n_sims // block)
    work = trades.sparkSession.range(0, blocks, 1, blocks)

    def simulate(batches):
        h, pnl, no = np.empty(n, np.int64), np.empty(n), None
        for batch in batches:
            no = batch["id"][0].as_py()
            for first, hs, pnls in _unpacked(batch):
                at = starts[first >> 33] + (first & (2**33 - 1))
                h[at : at + len(hs)], pnl[at : at + len(hs)] = hs, pnls
        if no is not None:
            sims = range(no * block, min((no + 1) * block, n_sims))
            falls, ends = zip(*(walk_order(pnl, h, sim, initial, seed) for sim in sims))
            yield pa.RecordBatch.from_pydict({"sim": list(sims), "max_drawdown": falls, "final_equity": ends})

    every = listed.coalesce(1).hint("shuffle_replicate_nl").crossJoin(work)  # each task reads one block and all files
    return every.mapInArrow(simulate, "sim bigint, max_drawdown double, final_equity double")


def simulation_summary(sims: DataFrame) -> DataFrame:
    """Ruin share and intervals; one row per simulation comes in."""
    pct = lambda c, q: F.percentile(c, F.lit(q))
    return sims.agg(
        F.avg((F.col("final_equity") < 0).cast("double")).alias("risk_of_ruin"), F.avg("max_drawdown").alias("mean_max_drawdown"),
        pct("max_drawdown", 0.95).alias("max_drawdown_p95"), pct("final_equity", 0.025).alias("equity_lo95"), pct("final_equity", 0.975).alias("equity_hi95"),
        pct("final_equity", 0.005).alias("equity_lo99"), pct("final_equity", 0.995).alias("equity_hi99"),
    )
