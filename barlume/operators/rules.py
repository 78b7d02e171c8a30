"""Rule signals.

A rule is a column builder on chunked bars that yields ``direction`` 1, -1 or
NULL.  Rules emit on a change against the last emitted direction; as every equal
candidate is dropped, that is the last candidate's direction, so a plain
"previous value" scan does it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barlume.operators.align import align_many
from barlume.operators.indicators import adx_simple_columns, ema_bounded, rolling, rsi_simple_columns, true_range
from barlume.operators.series import BARS, TICKS, Series, asof, chunked, fold, fold_moves, materialise, running, windowed

Rule = Callable[[DataFrame, WindowSpec], DataFrame]


def _previous(agg: Callable, x: str, w: WindowSpec, n: int) -> Column:
    f = w.rowsBetween(-n, -1)
    return F.when(F.count(x).over(f) >= n, agg(x).over(f))


def _side(long: Column, short: Column) -> Column:
    return F.when(long, 1).when(short, -1)


def donchian(n: int = 20, pct: float = 0.0002) -> tuple[Rule, int]:
    def rule(d: DataFrame, w: WindowSpec) -> DataFrame:
        hi, lo = _previous(F.max, "high", w, n), _previous(F.min, "low", w, n)
        return d.withColumn("direction", _side(F.col("close") > hi * (1 + pct), F.col("close") < lo * (1 - pct)))

    return rule, n


def _strict_tr(w: WindowSpec) -> Column:
    """True range only where a previous close exists."""
    return F.when(F.lag("close").over(w).isNotNull(), true_range(w))


def atr_breakout(n: int = 30, atr: int = 14, mult: float = 1.2) -> tuple[Rule, int]:
    def rule(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = d.withColumn("_tr", _strict_tr(w))
        hi, lo, a = _previous(F.max, "high", w, n), _previous(F.min, "low", w, n), rolling(F.avg, "_tr", w, atr)
        return d.withColumn("direction", _side(F.col("close") > hi + mult * a, F.col("close") < lo - mult * a)).drop("_tr")

    return rule, max(n, atr + 1)


def ema_pullback(fast: int = 50, slow: int = 200, pct: float = 0.0008) -> tuple[Rule, int]:
    def rule(d: DataFrame, w: WindowSpec) -> DataFrame:
        rows = slow + 5
        enough = F.count("close").over(w.rowsBetween(-(slow - 1), 0)) >= slow
        d = d.withColumns({"_f": ema_bounded("close", fast, rows, w), "_s": ema_bounded("close", slow, rows, w), "_ok": enough})
        f, sl, c = F.col("_f"), F.col("_s"), F.col("close")
        out = F.when(F.col("_ok"), _side((f > sl) & (c <= f * (1 - pct)), (f < sl) & (c >= f * (1 + pct))))
        return d.withColumn("direction", out).drop("_f", "_s", "_ok")

    return rule, slow + 5


def sma_reversion(n: int = 30, pct: float = 0.0025) -> tuple[Rule, int]:
    def rule(d: DataFrame, w: WindowSpec) -> DataFrame:
        m = rolling(F.avg, "close", w, n)
        return d.withColumn("direction", _side(F.col("close") < m * (1 - pct), F.col("close") > m * (1 + pct)))

    return rule, n


def rsi_bollinger(n: int = 20, k: float = 2.0, period: int = 14, high: float = 70, low: float = 30) -> tuple[Rule, int]:
    def rule(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = rsi_simple_columns(d, w, period, "_rsi")
        need = max(n, period) + 1
        enough = F.count("close").over(w.rowsBetween(-(need - 1), 0)) >= need
        m, sd = rolling(F.avg, "close", w, n), rolling(F.stddev_pop, "close", w, n)
        d = d.withColumns({"_m": m, "_sd": sd, "_ok": enough})
        up, dn = F.col("_m") + k * F.col("_sd"), F.col("_m") - k * F.col("_sd")
        out = _side((F.col("close") <= dn) & (F.col("_rsi") <= low), (F.col("close") >= up) & (F.col("_rsi") >= high))
        return d.withColumn("direction", F.when(F.col("_ok"), out)).drop("_rsi", "_m", "_sd", "_ok")

    return rule, max(n, period) + 1


def compression_breakout(n: int = 20, atr: int = 14, window: int = 40, ratio: float = 0.75) -> tuple[Rule, int]:
    def rule(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = d.withColumn("_tr", _strict_tr(w))
        long = rolling(F.avg, "_tr", w, max(window, atr), window)
        d = d.withColumn("_tight", rolling(F.avg, "_tr", w, atr) <= ratio * long)
        hi, lo = _previous(F.max, "high", w, n), _previous(F.min, "low", w, n)
        out = F.when(F.col("_tight"), _side(F.col("close") > hi, F.col("close") < lo))
        return d.withColumn("direction", out).drop("_tr", "_tight")

    return rule, max(n, window + 1, atr + 1)


def exits_by_pct(direction: Column, price: Column, stop: float, target: float) -> tuple[Column, Column]:
    return price * (1 - direction * stop), price * (1 + direction * target)


def exits_by_pips(direction: Column, price: Column, stop: float, target: float, pip: float = 0.0001) -> tuple[Column, Column]:
    return price - direction * stop * pip, price + direction * target * pip


def exits_by_atr(direction: Column, price: Column, low: Column, high: Column, atr: Column, mult: float = 1.2, rr: float = 2.0) -> tuple[Column, Column]:
    """Stop beyond the candle or mult*ATR, whichever is farther; target at rr risks."""
    stop = F.when(direction > 0, F.least(low, price - mult * atr)).otherwise(F.greatest(high, price + mult * atr))
    risk = F.abs(price - stop)
    return stop, price + direction * risk * rr


def risk_quantity(equity: float, risk: float, per_unit: Column, least: int = 1, most: int = 100_000) -> Column:
    raw = F.floor(equity * risk / per_unit)
    return F.when(per_unit > 0, F.greatest(F.lit(least), F.least(raw, F.lit(most)))).otherwise(least).cast("bigint")


def signals(
    bars: DataFrame, name: str, rule: tuple[Rule, int], stop: float = 0.004, target: float = 0.008, confidence: float = 0.7,
    s: Series = BARS, changes_only: bool = True,
) -> DataFrame:
    """Signals of one rule with percentage exits, one scan."""
    build, back = rule

    def prepare(d: DataFrame, w: WindowSpec) -> DataFrame:
        return build(d, w).where(F.col("direction").isNotNull())

    if changes_only:
        d = running(bars, s, prevs={"_before": F.col("direction")}, prepare=prepare, back=back)
        d = d.where(F.col("_before").isNull() | (F.col("_before") != F.col("direction"))).drop("_before")
    else:
        d = windowed(bars, s, prepare, back=back)
    sl, tp = exits_by_pct(F.col("direction"), F.col("close"), stop, target)
    return d.select(
        *s.keys, s.ts, F.lit(name).alias("strategy"), "direction", F.col("close").alias("entry_price"),
        sl.alias("stop"), tp.alias("target"), F.lit(confidence).alias("confidence"),
    )


# Fixed values: (rule, stop, target, confidence) of the six component strategies.
def components() -> dict[str, tuple[tuple[Rule, int], float, float, float]]:
    return {
        "Breakout": (donchian(), 0.004, 0.008, 0.7),
        "ATRBreakout": (atr_breakout(), 0.0045, 0.009, 0.72),
        "EMAPullback": (ema_pullback(20, 50), 0.004, 0.008, 0.7),
        "MeanReversion": (sma_reversion(), 0.004, 0.003, 0.65),
        "RSIBollinger": (rsi_bollinger(), 0.004, 0.003, 0.68),
        "CompressionBreakout": (compression_breakout(), 0.004, 0.01, 0.74),
    }


def all_signals(bars: DataFrame, rules: dict | None = None, s: Series = BARS) -> DataFrame:
    out = None
    for name, (rule, sl, tp, conf) in (rules or components()).items():
        part = signals(bars, name, rule, sl, tp, conf, s)
        out = part if out is None else out.unionByName(part)
    return out


def trend_state(bars: DataFrame, fast: int, slow: int, rows: int, s: Series = BARS) -> DataFrame:
    """EMAs over a bounded buffer and the trend sign, from ``slow`` bars on."""

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        enough = F.count("close").over(w.rowsBetween(-(slow - 1), 0)) >= slow
        d = d.withColumns({"ema_fast": ema_bounded("close", fast, rows, w), "ema_slow": ema_bounded("close", slow, rows, w), "_ok": enough})
        return d.where(F.col("_ok") | ~F.col("_own"))

    d = windowed(bars, s, build, back=rows).where("_ok").drop("_ok")
    return d.withColumn("trend", F.signum(F.col("ema_fast") - F.col("ema_slow")).cast("int"))


def trend_alignment(base: DataFrame, slower: Sequence[tuple[DataFrame, int]], fast: int = 50, slow: int = 200, s: Series = BARS) -> DataFrame:
    """All timeframes bullish (or none) and the close beyond the fast EMA."""
    rows = slow + 50
    d = trend_state(base, fast, slow, rows, s)
    sides = []
    for i, (bars, seconds) in enumerate(slower):
        t = trend_state(bars, fast, slow, rows, s).select(*s.keys, s.ts, (F.col("ema_fast") > F.col("ema_slow")).alias(f"_bull{i}"))
        sides.append((t, [f"_bull{i}"], seconds))
    d = align_many(d, sides, s)
    bull, bear = F.col("ema_fast") > F.col("ema_slow"), F.col("ema_fast") <= F.col("ema_slow")
    for i in range(len(slower)):
        bull, bear = bull & F.col(f"_bull{i}"), bear & ~F.col(f"_bull{i}")
    out = _side(bull & (F.col("close") > F.col("ema_fast")), bear & (F.col("close") < F.col("ema_fast")))
    d = d.withColumn("direction", out).where(F.col("direction").isNotNull())
    return d.select(
        *s.keys, s.ts, "direction", F.col("close").alias("entry_price"),
        (F.col("ema_fast") * (1 - F.col("direction") * 0.002)).alias("stop"), (F.col("close") * (1 + F.col("direction") * 0.015)).alias("target"),
        F.lit(0.8).alias("confidence"),
    )


# ------------------------------------------------------------- sequential thinning


def cooldown(candidates: DataFrame, bars_apart: int, keys: Sequence[str] = ("instrument",), s: Series = BARS, skip_same: bool = True) -> DataFrame:
    """Keeps a candidate only ``bars_apart`` or more bars after the last kept one
    (and, with ``skip_same``, only in the other direction).

    candidates: keys, ts, bar_no, direction, …  State: last direction and bars
    since the last kept signal, capped; folded chunk by chunk.
    """
    k = s.with_(keys=tuple(keys), order=("bar_no",))
    candidates = materialise(candidates)  # sparse, and walked several times
    gap = windowed(candidates, k, lambda d, w: d.withColumn("_gap", F.col("bar_no") - F.lag("bar_no").over(w)), back=1)
    rows = chunked(gap, k).drop("_own", "_base")
    cap = bars_apart
    names = candidates.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.schema)

    last, since = np.divmod(np.arange(3 * (cap + 1)), cap + 1)

    def kept(pdf, last, since):
        """The code of each row's side, the bars since the last kept signal, and whether the row is kept."""
        gap = pdf["_gap"].to_numpy(dtype=float, na_value=np.nan)[:, None]
        code = np.where(pdf["direction"].to_numpy() > 0, 1, 2)[:, None]
        since = np.minimum(cap, since + np.where(np.isnan(gap), 1, np.minimum(gap, cap)).astype(np.int64))
        return code, since, (since >= cap) & ~((code == last) & skip_same)

    def moves(pdf):
        code, after, ok = kept(pdf, last, since)
        return np.where(ok, code * (cap + 1), last * (cap + 1) + after)

    def emit(pdf, before, _):
        return pdf[names][kept(pdf, last[before][:, None], since[before][:, None])[2][:, 0]]

    return fold_moves(rows, keys, "_chunk", ["bar_no"], cap, moves, emit, schema)


def bar_numbers(bars: DataFrame, s: Series = BARS) -> DataFrame:
    return running(bars, s, row_no="bar_no")


def ensemble_votes(votes: DataFrame, bars: DataFrame, n_components: int, min_votes: int = 2, keys=("instrument",)) -> DataFrame:
    """Majority of component signals per bar; confidence = votes / components."""
    g = votes.groupBy(*keys, "ts").agg(
        F.count(F.when(F.col("direction") == 1, 1)).alias("long_votes"), F.count(F.when(F.col("direction") == -1, 1)).alias("short_votes"),
    )
    lv, sv = F.col("long_votes"), F.col("short_votes")
    out = F.when((lv >= min_votes) & (lv > sv), 1).when((sv >= min_votes) & (sv > lv), -1)
    g = g.withColumn("direction", out).where(F.col("direction").isNotNull())
    g = g.withColumn("confidence", F.least(F.lit(1.0), F.greatest(lv, sv) / n_components))
    return g.join(bars.select(*keys, "ts", "bar_no", F.col("close").alias("entry_price")), [*keys, "ts"])


def style_of(strategy: Column) -> Column:
    return (
        F.when(strategy.rlike("MeanReversion|RSI"), "mean_reversion").when(strategy.rlike("Breakout|Compression"), "breakout")
        .when(strategy.rlike("EMA|Trend"), "trend").otherwise("generic")
    )


def style_weight(style: Column, regime_strategy: Column) -> Column:
    """Weight of a module style while a regime maps to ``regime_strategy``."""
    n = regime_strategy
    boost = (
        ((style == "mean_reversion") & n.rlike("MeanReversion|RSI")) | ((style == "breakout") & n.rlike("Breakout|Compression"))
        | ((style == "trend") & n.rlike("EMA|Trend"))
    )
    known = style.isin("trend", "mean_reversion", "breakout")
    return F.when(n.isNull(), 1.0).when(boost, 1.8).when(known, 0.7).when(style == "stat_arb", 0.4).otherwise(1.0)


def regime_decision(votes: DataFrame, regimes: DataFrame, threshold: float = 0.25, min_votes: int = 1) -> DataFrame:
    """Signed confidence times style weight, summed per bar; exits come from the
    most confident voter (first name on ties).

    regimes: instrument, ts, regime_strategy (the strategy mapped to the regime).
    """
    d = votes.join(regimes, ["instrument", "ts"], "left")
    w = style_weight(style_of(F.col("strategy")), F.col("regime_strategy"))
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence")))
    top = F.min_by(F.struct("entry_price", "stop", "target"), F.struct(-F.col("confidence"), F.col("strategy")))
    g = d.groupBy("instrument", "ts").agg(F.sum(F.col("direction") * conf * w).alias("score"), F.count(F.lit(1)).alias("votes"), top.alias("_top"))
    g = g.where((F.col("votes") >= min_votes) & (F.abs("score") >= threshold))
    return g.select(
        "instrument", "ts", F.when(F.col("score") > 0, 1).otherwise(-1).alias("direction"), "score", "votes",
        F.least(F.lit(1.0), F.abs("score")).alias("confidence"), "_top.*",
    )


def route_regime(rows: DataFrame, mapping: DataFrame, available: Sequence[str], default: str | None) -> DataFrame:
    """Strategy mapped to the active regime if available, else default, else first."""
    fallback = default if default in available else available[0]
    d = rows.join(F.broadcast(mapping), "regime", "left")
    chosen = F.when(F.col("mapped").isin(*available), F.col("mapped")).otherwise(fallback)
    return d.withColumn("strategy", chosen).drop("mapped")


def assign_regime(points: DataFrame, centroids: DataFrame, vector: str = "features", mean: str | None = None, std: str | None = None) -> DataFrame:
    """Nearest centroid by squared distance, and softmax(-distance) of the best.

    centroids: one row with ``centers`` array<struct<regime, center>> (a model
    artefact of a few rows), so scoring is a map over points.
    """
    d = points.crossJoin(F.broadcast(centroids))
    x = F.col(vector)
    if mean:
        x = F.zip_with(F.zip_with(x, F.col(mean), lambda a, m: a - m), F.col(std), lambda a, sd: a / F.when(sd == 0, 1.0).otherwise(sd))
    dist = lambda c: F.aggregate(F.zip_with(F.col("_x"), c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, v: acc + v)
    d = d.withColumn("_x", x)
    d = d.withColumn("_d", F.transform("centers", lambda c: F.struct(dist(c["center"]).alias("distance"), c["regime"].alias("regime"))))
    best = F.array_min("_d")
    d = d.withColumn("_best", best)
    soft = F.aggregate("_d", F.lit(0.0), lambda acc, e: acc + F.exp(F.col("_best.distance") - e["distance"]))
    return d.withColumns({"regime": F.col("_best.regime"), "distance": F.col("_best.distance"), "probability": 1 / soft}).drop("_x", "_d", "_best", "centers")


# ------------------------------------------------------------- tick models


def ma_crossover(ticks: DataFrame, fast: int = 10, slow: int = 30, threshold: float = 0.0, s: Series = TICKS) -> DataFrame:
    """Crossings of two tick averages, deduped before the confidence filter."""

    def prepare(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = d.withColumn("_mid", (F.col("bid") + F.col("ask")) / 2)
        d = d.withColumns({"fast_ma": rolling(F.avg, "_mid", w, fast), "slow_ma": rolling(F.avg, "_mid", w, slow)})
        d = d.withColumns({"_pf": F.lag("fast_ma").over(w), "_ps": F.lag("slow_ma").over(w)})
        f, sl = F.col("fast_ma"), F.col("slow_ma")
        out = _side((F.col("_pf") <= F.col("_ps")) & (f > sl), (F.col("_pf") >= F.col("_ps")) & (f < sl))
        return d.withColumn("direction", out).where(F.col("direction").isNotNull()).drop("_pf", "_ps", "_mid")

    d = running(ticks, s, prevs={"_before": F.col("direction")}, prepare=prepare, back=slow + 1)
    d = d.where(F.col("_before").isNull() | (F.col("_before") != F.col("direction")))
    gap = F.abs((F.col("fast_ma") - F.col("slow_ma")) / F.nullif(F.col("slow_ma"), F.lit(0.0)))
    d = d.withColumn("confidence", F.least(gap * 10, F.lit(1.0))).where(F.col("confidence") >= threshold)
    return d.drop("_before")


def rsi_crossing(ticks: DataFrame, n: int = 14, low: float = 30, high: float = 70, s: Series = TICKS) -> DataFrame:
    """RSI leaving the band; confidence grows with the distance, at least 0.5."""

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = d.withColumn("close", (F.col("bid") + F.col("ask")) / 2)
        d = rsi_simple_columns(d, w, n, "rsi")
        return d.withColumn("_p", F.lag("rsi").over(w)).drop("close")

    d = windowed(ticks, s, build, back=n + 1)
    r, p = F.col("rsi"), F.col("_p")
    d = d.withColumn("direction", _side((p >= low) & (r < low), (p <= high) & (r > high))).where(F.col("direction").isNotNull())
    dist = F.when(F.col("direction") > 0, low - r).otherwise(r - high)
    return d.withColumn("confidence", F.greatest(F.least(dist / 30, F.lit(1.0)), F.lit(0.5))).drop("_p")


def price_tick_signal(d: DataFrame, stop_pips: float, target_pips: float) -> DataFrame:
    """Entry at the ask (long) or bid (short) with exits in pips."""
    entry = F.when(F.col("direction") > 0, F.col("ask")).otherwise(F.col("bid"))
    sl, tp = exits_by_pips(F.col("direction"), F.col("entry_price"), stop_pips, target_pips)
    return d.withColumn("entry_price", entry).withColumns({"stop": sl, "target": tp})


# ------------------------------------------------------------- probability rules


def aggregator_score(d: DataFrame, gate: float = 0.5) -> DataFrame:
    """Directional score from trade, side, regime and specialist probabilities."""
    c = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col(x), F.lit(0.0))))
    wb = 0.6 * c("trend") + 0.6 * c("highvol")
    wm = 0.8 * c("range")
    raw = (1 - 0.7 * c("lowliq")) * c("p_trade") * (c("p_long") - c("p_short")) * (1 + 0.5 * wb * c("p_breakout") + 0.5 * wm * c("p_meanrev"))
    return d.withColumn("score", F.when(c("p_trade") >= gate, raw).otherwise(0.0))


def side_state(rows: DataFrame, enter=0.05, leave=0.02, flip=0.08, wait=3, s: Series = BARS) -> DataFrame:
    """Position side after hysteresis and cooldown, folded over each series: enter, hold, flatten or flip, with a
    wait after each change that only flattening may break.  Null scores change nothing but the wait."""
    chunks = chunked(rows, s).drop("_own", "_base")
    names = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", side int"
    side, since = np.divmod(np.arange(3 * (wait + 1)), wait + 1)
    side, since = side - 1, np.minimum(wait, since + 1)

    def moves(pdf):
        score = pdf["score"].to_numpy(dtype=float, na_value=np.nan)[:, None]
        size, sign = np.abs(score), np.nan_to_num(np.sign(score)).astype(np.int64)
        held = np.where(sign == side, side, np.where(size <= leave, 0, np.where((sign != 0) & (size >= flip), sign, side)))
        want = np.where(side == 0, np.where(size >= enter, sign, 0), held)
        want = np.where((want != 0) & (since < wait), side, want)
        return (want + 1) * (wait + 1) + np.where(want == side, since, 0)

    def emit(pdf, _, after):
        return pdf[names].assign(side=after // (wait + 1) - 1)

    return fold_moves(chunks, list(s.keys), "_chunk", list(s.order), 1 * (wait + 1) + wait, moves, emit, schema)


def gate_signal(p_trade: Column, p_long: Column, p_short: Column, gate: Column) -> Column:
    return F.when(p_trade > gate, F.when(p_long > p_short, 1).otherwise(-1)).otherwise(0)


def threshold_signal(prob: Column, long_thr: Column, short_thr: Column, long_on: Column, short_on: Column) -> Column:
    """Long, short or abstain; where both fire, the side farther past its limit wins."""
    up = F.coalesce(long_on & (prob >= long_thr), F.lit(False))
    dn = F.coalesce(short_on & (prob <= short_thr), F.lit(False))
    both = F.when((prob - long_thr) >= (short_thr - prob), 1).otherwise(-1)
    return F.when(up & dn, both).when(up, 1).when(dn, -1).otherwise(0)


# ------------------------------------------------------------- session breakout


def session_breakout_candidates(
    bars: DataFrame, slower: Sequence[tuple[DataFrame, int]], range_hours=(0, 6), trade_hours=(6, 21), n: int = 14, bb: int = 20,
    rising: int = 5, quantile: float = 0.30, adx_min: float = 25.0, warm: int = 120, s: Series = BARS,
) -> DataFrame:
    """Breaks of the early range with trend strength, expanding volatility, a big
    body, volume and a slower trend bias behind them."""
    c, o = F.col("close"), F.col("open")

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = adx_simple_columns(d, w, n, "adx")
        h0 = F.hour("ts")
        early = (h0 >= range_hours[0]) & (h0 < range_hours[1])
        d = d.withColumns({
            "_tr": true_range(w), "_day": F.col("ts").cast("date"), "_body": F.abs(c - o),
            "_eh": F.when(early, F.col("high")), "_el": F.when(early, F.col("low")),
            "_w": 4 * rolling(F.stddev_pop, "close", w, bb) / F.nullif(rolling(F.avg, "close", w, bb), F.lit(0.0)),
            "_rows": F.count(F.lit(1)).over(w.rowsBetween(-(warm - 1), 0)),
        })
        day = Window.partitionBy("instrument", "_chunk", "_day").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
        d = d.withColumns({"atr": rolling(F.avg, "_tr", w, n), "range_high": F.max("_eh").over(day), "range_low": F.min("_el").over(day)})
        d = d.withColumn("_up", (F.col("atr") > F.lag("atr").over(w)).cast("int"))
        last50 = w.rowsBetween(-49, 0)
        body, vol = F.avg("_body").over(w.rowsBetween(-5, -1)), F.avg("volume").over(w.rowsBetween(-5, -1))
        return d.withColumns({
            "_rise": (F.col("atr") > F.lag("atr", rising).over(w)) & (F.sum("_up").over(w.rowsBetween(-(rising - 1), 0)) >= max(2, rising - 2)),
            "_wide": F.col("_w") > F.lag("_w", 5).over(w),
            "_free": (F.count("atr").over(last50) >= 30) & (F.col("atr") > F.percentile("atr", F.lit(quantile)).over(last50)),
            "_strong": (F.col("_body") > body) & (F.col("volume") > vol),
        })

    d = windowed(bars, s, build, back=warm + 64)
    hour = F.hour("ts")
    ready = (F.col("_rows") >= warm) & (hour >= trade_hours[0]) & (hour < trade_hours[1]) & (F.col("adx") >= adx_min)
    d = d.where(ready & F.col("_rise") & F.col("_wide") & F.col("_free") & F.col("_strong"))
    d = materialise(d.select(*s.keys, s.ts, "open", "high", "low", "close", "adx", "atr", "range_high", "range_low"))
    sides = []
    for i, (slow, seconds) in enumerate(slower):
        t = trend_state(slow, 20, 50, 300, s)
        sides.append((t.select(*s.keys, s.ts, F.col("trend").alias(f"_t{i}b")), [f"_t{i}b"], seconds))
    d = align_many(d, sides, s)
    bias = sum((F.coalesce(F.col(f"_t{i}b"), F.lit(0)) for i in range(len(slower))), F.lit(0))
    d = d.withColumn("direction", _side((c > F.col("range_high")) & (bias > 0), (c < F.col("range_low")) & (bias < 0)))
    d = d.where(F.col("direction").isNotNull())
    stop, target = exits_by_atr(F.col("direction"), c, F.col("low"), F.col("high"), F.col("atr"))
    d = d.withColumns({"stop": stop, "target": target, "entry_price": c})
    return d.select(*s.keys, s.ts, "direction", "entry_price", "stop", "target", "adx", "atr")


def daily_limits(candidates: DataFrame, max_trades: int = 2, max_losses: int = 2) -> DataFrame:
    """Daily trade cap, one open trade at a time, stop after a loss streak.

    candidates: instrument, ts, exit_ts, exit_reason, ….  Everything but the loss
    streak resets each day, so a day is a chunk and the streak its only state.
    """
    candidates = materialise(candidates)
    rows = candidates.withColumn("_day", F.unix_date(F.col("ts").cast("date")))
    names = candidates.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.schema)

    def run(pdf, losses):
        keep, taken, open_exit, open_loss = [], 0, None, False
        for ts, exit_ts, reason in zip(pdf["ts"], pdf["exit_ts"], pdf["exit_reason"]):
            if open_exit is not None and open_exit <= ts:
                losses = min(max_losses, losses + 1) if open_loss else 0
                open_exit = None
            busy = open_exit is not None
            ok = taken < max_trades and losses < max_losses and not busy
            if ok:
                taken += 1
                same_day = exit_ts == exit_ts and exit_ts is not None and exit_ts.date() == ts.date()
                open_exit = exit_ts if same_day else ts.normalize().replace(hour=23, minute=59, second=59)
                open_loss = same_day and reason == "stop_loss"
                if not same_day:
                    open_loss = None
            keep.append(ok)
        if open_exit is not None and open_loss is not None:
            losses = min(max_losses, losses + 1) if open_loss else 0
        return pdf[names][keep], losses

    return fold(rows, ["instrument"], "_day", ["ts"], max_losses + 1, 0, run, schema)


def confluence(
    base: DataFrame, slower: Sequence[tuple[str, DataFrame, int]], primary: str, references: Sequence[str], fast: int = 50, slow: int = 200,
    min_align: float = 0.5, lookback: int = 12, min_strength: float = 0.0002, apart: int = 8, s: Series = BARS,
) -> DataFrame:
    """Own slower trends agree, enough references agree, and the primary moves
    more than the mean reference; thinned by a cooldown."""
    names = [primary, *references]

    def ret(d: DataFrame, w: WindowSpec) -> DataFrame:
        return d.withColumn("_ret", F.col("close") / F.nullif(F.lag("close", lookback).over(w), F.lit(0.0)) - 1)

    own = materialise(bar_numbers(base.where(F.col("instrument") == primary), s).select("ts", "bar_no", "close"))
    grid = own.select("ts", "bar_no", "close", F.explode(F.array(*[F.lit(n) for n in names])).alias("instrument"))
    rets = windowed(base.where(F.col("instrument").isin(*names)), s, ret, back=lookback).select("instrument", "ts", "_ret")
    states = []
    for i, (_, bars, seconds) in enumerate(slower):
        t = trend_state(bars.where(F.col("instrument").isin(*names)), fast, slow, slow + 10, s)
        states.append((t.select("instrument", "ts", F.col("trend").alias(f"_d{i}")), [f"_d{i}"], seconds))
    d = align_many(grid, [(rets, ["_ret"], 0), *states], s)
    votes = F.array_compact(F.array(*[F.col(f"_d{i}") for i in range(len(slower))]))
    d = d.withColumns({"_n": F.size(votes), "_sum": F.aggregate(votes, F.lit(0), lambda a, v: a + v)})
    me = F.col("instrument") == primary
    g = d.groupBy("ts", "bar_no", "close").agg(
        F.max(F.when(me, F.col("_sum"))).alias("_own"), F.max(F.when(me, F.col("_n"))).alias("_have"), F.max(F.when(me, F.col("_ret"))).alias("_pr"),
        F.avg(F.when(~me, F.col("_ret"))).alias("_rr"),
        F.count(F.when(~me & (F.col("_sum") > 0), 1)).alias("_up"), F.count(F.when(~me & (F.col("_sum") < 0), 1)).alias("_dn"),
    )
    m = len(slower)
    side = F.when((F.col("_have") == m) & (F.col("_own") == m), 1).when((F.col("_have") == m) & (F.col("_own") == -m), -1)
    g = g.withColumns({"direction": side, "_total": F.col("_up") + F.col("_dn"), "strength": F.col("_pr") - F.col("_rr")})
    agree = F.when(F.col("direction") > 0, F.col("_up")).otherwise(F.col("_dn")) / F.nullif(F.col("_total"), F.lit(0))
    g = g.withColumn("alignment", agree)
    g = g.where(F.col("direction").isNotNull() & (F.col("alignment") >= min_align) & (F.col("direction") * F.col("strength") >= min_strength))
    cand = g.select(F.lit(primary).alias("instrument"), "ts", "bar_no", "direction", F.col("close").alias("entry_price"), "alignment", "strength")
    return cooldown(cand, apart, ("instrument",), s)


def refine_entries(
    sig: DataFrame, bars: DataFrame, max_wait: int = 3, spread_mult: float = 0.25, chase: float = 0.5, offset: float = 0.25, look: int = 3, momentum: float = 0.15,
) -> DataFrame:
    """Order type per signal from the first fine bars after it.

    sig: signal_id, instrument, side, ts, entry_price; bars: instrument, ts,
    close, atr, spread, bar_no.  The signal's first bar number comes from an as-of
    step, its few following bars from an equality join on bar number.
    """
    first = asof(
        sig, bars.select("instrument", "ts", F.col("bar_no").alias("_b"), F.col("ts").alias("_bt")),
        ["_b", "_bt"], BARS.with_(order=("ts",)), tie=("signal_id",),
    )
    start = F.when(F.col("_bt") == F.col("ts"), F.col("_b")).otherwise(F.coalesce(F.col("_b"), F.lit(0)) + 1)
    span = first.withColumn("_start", start).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(max_wait))))
    span = span.withColumn("bar_no", F.col("_start") + F.col("_i"))
    j = span.join(bars.select("instrument", "bar_no", F.col("close").alias("_c"), F.col("atr").alias("_a"), F.col("spread").alias("_s")), ["instrument", "bar_no"])
    bar = F.sort_array(F.collect_list(F.struct(F.col("_i").alias("i"), F.col("_c").alias("c"), F.col("_a").alias("a"), F.col("_s").alias("s"))))
    keys = ["signal_id", "instrument", "side", "ts", "entry_price"]
    g = j.groupBy(*keys).agg(bar.alias("_bars"))  # max_wait + 1 bars at most
    zero = F.get("_bars", 0)
    g = g.withColumn("_a0", F.when(zero["a"] > 0, zero["a"]).otherwise(F.greatest(F.abs(zero["c"]) * 0.001, F.lit(1e-6))))
    g = g.withColumn("_sel", F.get(F.filter("_bars", lambda e: e["s"] <= spread_mult * F.col("_a0")), 0))
    g = g.withColumns({"_px": F.col("_sel.c"), "_as": F.coalesce(F.col("_sel.a"), F.col("_a0")), "_sp": F.coalesce(F.col("_sel.s"), F.lit(0.0))})
    g = g.withColumn("_from", F.get("_bars", F.greatest(F.lit(0), F.col("_sel.i") - look))["c"])
    buy = F.col("side") == "BUY"
    sign = F.when(buy, 1.0).otherwise(-1.0)
    against = (F.col("_px") - F.col("entry_price")) * sign
    strong = (F.col("_px") - F.col("_from")) * sign > momentum * F.col("_as")
    status = F.when(F.col("_sel").isNull(), "spread_too_wide").when(against > chase * F.col("_as"), "chase_guard").otherwise("ok")
    g = g.withColumn("status", status)
    ok = F.col("status") == "ok"
    return g.select(
        *keys, "status", F.when(ok, F.when(strong, "market").otherwise("limit")).alias("order_type"),
        F.when(ok & ~strong, F.col("_px") - sign * offset * F.col("_sp")).alias("price"), F.when(ok, F.col("_sel.i")).alias("selected_bar"),
    )
