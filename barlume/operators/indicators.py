"""Technical indicators.

Column helpers take the chunk window ``w`` given by ``series.windowed``; frames
are bounded, so a chunk with its halo is all a task needs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barlume.operators.series import BARS, Series, ewm_columns, ewm_memory, position, windowed

EPS = 1e-9


def rolling(agg: Callable, x: Column | str, w: WindowSpec, n: int, least: int | None = None) -> Column:
    """``agg`` of the last n rows, NULL until ``least`` (default n) values are present."""
    c = F.col(x) if isinstance(x, str) else x
    f = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(c).over(f) >= (n if least is None else least), agg(c).over(f))


def rolling_rank(x: str, w: WindowSpec, n: int, least: int) -> Column:
    """Share of the last n rows whose value is <= the current one."""
    f = w.rowsBetween(-(n - 1), 0)
    below = F.filter(F.collect_list(x).over(f), lambda e: e <= F.col(x))
    return F.when(F.count(x).over(f) >= least, F.size(below) / F.count(F.lit(1)).over(f))


def true_range(w: WindowSpec) -> Column:
    prev = F.lag("close").over(w)
    h, l = F.col("high"), F.col("low")
    return F.greatest(h - l, F.abs(h - prev), F.abs(l - prev))


def pct_change(x: str, n: int, w: WindowSpec) -> Column:
    prev = F.lag(x, n).over(w)
    return F.col(x) / F.nullif(prev, F.lit(0.0)) - 1


def sma(bars: DataFrame, n: int, out: str = "sma", s: Series = BARS) -> DataFrame:
    return windowed(bars, s, lambda d, w: d.withColumn(out, rolling(F.avg, "close", w, n)), back=n - 1)


def ema(bars: DataFrame, spans: dict[str, int], s: Series = BARS, x: str = "close") -> DataFrame:
    """EMA seeded with the first value."""
    specs = {name: (F.col(x), 2.0 / (n + 1), 1) for name, n in spans.items()}
    reach = max(ewm_memory(a) for _, a, _ in specs.values())
    return windowed(bars, s, lambda d, w: ewm_columns(d, s, specs), back=reach)


def ema_sma_seed(bars: DataFrame, n: int, out: str = "ema", s: Series = BARS) -> DataFrame:
    """EMA whose first value is the mean of the first n closes."""
    alpha = 2.0 / (n + 1)

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = d.withColumn("_pos", position(w)).withColumn("_m", F.avg("close").over(w.rowsBetween(-(n - 1), 0)))
        x = F.when(F.col("_pos") == n - 1, F.col("_m")).when(F.col("_pos") >= n, F.col("close"))
        return ewm_columns(d.withColumn("_x", x), s, {out: (F.col("_x"), alpha, 1)}).drop("_x", "_m", "_pos")

    return windowed(bars, s, build, back=ewm_memory(alpha) + n)


def ema_bounded(x: str, span: int, rows: int, w: WindowSpec) -> Column:
    """EMA over a buffer of the last ``rows`` values, seeded by the oldest one."""
    a = F.lit(2.0 / (span + 1))
    buf = F.collect_list(x).over(w.rowsBetween(-(rows - 1), 0))
    return F.aggregate(F.slice(buf, 2, rows), F.get(buf, 0), lambda acc, v: a * v + (1 - a) * acc)


def atr_wilder(bars: DataFrame, n: int = 14, out: str = "atr", s: Series = BARS) -> DataFrame:
    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = d.withColumn("_tr", true_range(w))
        return ewm_columns(d, s, {out: (F.col("_tr"), 1.0 / n, n)}).drop("_tr")

    return windowed(bars, s, build, back=ewm_memory(1.0 / n) + 1)


def atr_simple(bars: DataFrame, n: int = 14, out: str = "atr", s: Series = BARS) -> DataFrame:
    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        return d.withColumn("_tr", true_range(w)).withColumn(out, rolling(F.avg, "_tr", w, n)).drop("_tr")

    return windowed(bars, s, build, back=n)


def wilder_columns(d: DataFrame, w: WindowSpec, n: int, s: Series) -> DataFrame:
    """Adds atr, rsi and adx (Wilder smoothing) to chunked bars."""
    a = 1.0 / n
    delta = F.col("close") - F.lag("close").over(w)
    up = F.col("high") - F.lag("high").over(w)
    down = F.lag("low").over(w) - F.col("low")
    d = d.withColumns({"_tr": true_range(w), "_d": delta, "_up": up, "_dn": down})
    pdm = F.when((F.col("_up") > F.col("_dn")) & (F.col("_up") > 0), F.col("_up")).otherwise(0.0)
    mdm = F.when((F.col("_dn") > F.col("_up")) & (F.col("_dn") > 0), F.col("_dn")).otherwise(0.0)
    zero = F.lit(0.0)
    gain = F.when(F.col("_d").isNotNull(), F.greatest(F.col("_d"), zero))
    loss = F.when(F.col("_d").isNotNull(), F.greatest(-F.col("_d"), zero))
    d = d.withColumns({"_pdm": pdm, "_mdm": mdm, "_g": gain, "_ls": loss})
    specs = {"atr": "_tr", "_ag": "_g", "_al": "_ls", "_ap": "_pdm", "_am": "_mdm"}
    d = ewm_columns(d, s, {k: (F.col(v), a, n) for k, v in specs.items()})
    rs = F.col("_ag") / (F.col("_al") + EPS)
    pdi = 100 * F.col("_ap") / (F.col("atr") + EPS)
    mdi = 100 * F.col("_am") / (F.col("atr") + EPS)
    d = d.withColumns({"rsi": 100 - 100 / (1 + rs), "_dx": 100 * F.abs(pdi - mdi) / (pdi + mdi + EPS)})
    d = ewm_columns(d, s, {"adx": (F.col("_dx"), a, n)})
    return d.drop("_tr", "_d", "_up", "_dn", "_pdm", "_mdm", "_g", "_ls", "_ag", "_al", "_ap", "_am", "_dx")


def wilder_back(n: int) -> int:
    return 2 * ewm_memory(1.0 / n) + 2


def wilder(bars: DataFrame, n: int = 14, s: Series = BARS) -> DataFrame:
    """Wilder ATR, RSI and ADX in one pass."""
    return windowed(bars, s, lambda d, w: wilder_columns(d, w, n, s), back=wilder_back(n))


def rsi_simple_columns(d: DataFrame, w: WindowSpec, n: int, out: str = "rsi") -> DataFrame:
    """RSI from plain means; 100 when there is no loss in the window."""
    d = d.withColumn("_d", F.col("close") - F.lag("close").over(w))
    zero = F.lit(0.0)
    gain = rolling(F.avg, F.when(F.col("_d").isNotNull(), F.greatest(F.col("_d"), zero)), w, n)
    loss = rolling(F.avg, F.when(F.col("_d").isNotNull(), F.greatest(-F.col("_d"), zero)), w, n)
    d = d.withColumns({"_g": gain, "_l": loss})
    rsi = F.when(F.col("_l") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("_g") / F.col("_l")))
    return d.withColumn(out, F.when(F.col("_l").isNotNull(), rsi)).drop("_d", "_g", "_l")


def rsi_simple(bars: DataFrame, n: int = 14, s: Series = BARS) -> DataFrame:
    return windowed(bars, s, lambda d, w: rsi_simple_columns(d, w, n), back=n)


def adx_simple_columns(d: DataFrame, w: WindowSpec, n: int, out: str = "adx") -> DataFrame:
    """ADX from rolling sums of directional moves over the rolling mean true
    range; DX counts as 0 where undefined."""
    d = d.withColumns({
        "_tr": true_range(w),
        "_up": F.col("high") - F.lag("high").over(w),
        "_dn": F.lag("low").over(w) - F.col("low"),
    })
    pdm = F.when((F.col("_up") > F.col("_dn")) & (F.col("_up") > 0), F.col("_up")).otherwise(0.0)
    mdm = F.when((F.col("_dn") > F.col("_up")) & (F.col("_dn") > 0), F.col("_dn")).otherwise(0.0)
    d = d.withColumns({"_pdm": pdm, "_mdm": mdm})
    atr = rolling(F.avg, "_tr", w, n)
    d = d.withColumns({
        "_pdi": 100 * rolling(F.sum, "_pdm", w, n) / F.nullif(atr, F.lit(0.0)),
        "_mdi": 100 * rolling(F.sum, "_mdm", w, n) / F.nullif(atr, F.lit(0.0)),
    })
    dx = 100 * F.abs(F.col("_pdi") - F.col("_mdi")) / F.nullif(F.col("_pdi") + F.col("_mdi"), F.lit(0.0))
    d = d.withColumn("_dx", F.coalesce(dx, F.lit(0.0)))
    d = d.withColumn(out, rolling(F.avg, "_dx", w, n))
    return d.drop("_tr", "_up", "_dn", "_pdm", "_mdm", "_pdi", "_mdi", "_dx")


def adx_simple(bars: DataFrame, n: int = 14, s: Series = BARS) -> DataFrame:
    return windowed(bars, s, lambda d, w: adx_simple_columns(d, w, n), back=2 * n)


def bollinger(bars: DataFrame, n: int = 20, k: float = 2.0, s: Series = BARS) -> DataFrame:
    """Bands from the population deviation, and width = 2k*std/|mean|."""

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = d.withColumns({"bb_mid": rolling(F.avg, "close", w, n), "_sd": rolling(F.stddev_pop, "close", w, n)})
        return d.withColumns({
            "bb_upper": F.col("bb_mid") + k * F.col("_sd"),
            "bb_lower": F.col("bb_mid") - k * F.col("_sd"),
            "bb_width": 2 * k * F.col("_sd") / (F.abs("bb_mid") + EPS),
        }).drop("_sd")

    return windowed(bars, s, build, back=n - 1)


def percentile_rank(bars: DataFrame, x: str, n: int = 252, least: int = 30, out: str = "pct_rank", s: Series = BARS) -> DataFrame:
    return windowed(bars, s, lambda d, w: d.withColumn(out, rolling_rank(x, w, n, least)), back=n - 1)


def zscore(bars: DataFrame, n: int = 20, out: str = "price_zscore", s: Series = BARS) -> DataFrame:
    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        mu, sd = rolling(F.avg, "close", w, n), rolling(F.stddev_pop, "close", w, n)
        return d.withColumn(out, (F.col("close") - mu) / (sd + EPS))

    return windowed(bars, s, build, back=n - 1)


def swing_levels(bars: DataFrame, lookback: int = 100, order: int = 5, proximity: float = 0.001, s: Series = BARS) -> DataFrame:
    """Support and resistance: strict local extremes among the last ``lookback``
    bars, neighbours closer than ``proximity`` averaged into one level."""
    total = bars.groupBy("instrument").agg(F.count(F.lit(1)).alias("_n"))
    rows = windowed(bars, s, lambda d, w: d.withColumn("_pos", position(w))).join(total, "instrument")
    first = F.greatest(F.col("_n") - lookback, F.lit(0))
    rows = rows.where(F.col("_pos") >= first).withColumn("_first", first)
    # at most `lookback` rows per instrument are left, so this window stays small
    tail = Window.partitionBy("instrument").orderBy(*s.order)
    before, after = tail.rowsBetween(-order, -1), tail.rowsBetween(1, order)
    rows = rows.withColumns({
        "_hip": F.max("high").over(before), "_hin": F.max("high").over(after),
        "_lop": F.min("low").over(before), "_lon": F.min("low").over(after),
    })
    # the two end points have no neighbour on one side and never qualify
    hits = rows.select(
        "instrument",
        F.explode(F.array_compact(F.array(
            F.when((F.col("high") > F.col("_hip")) & (F.col("high") > F.col("_hin")), F.struct(F.lit("resistance").alias("kind"), F.col("high").alias("price"))),
            F.when((F.col("low") < F.col("_lop")) & (F.col("low") < F.col("_lon")), F.struct(F.lit("support").alias("kind"), F.col("low").alias("price"))),
        ))).alias("_h"),
    ).select("instrument", "_h.kind", "_h.price")
    wp = Window.partitionBy("instrument", "kind").orderBy("price")
    prev = F.lag("price").over(wp)
    # nothing is near a price of zero: a share of it is infinite or undefined
    near = F.coalesce((F.col("price") - prev) / F.nullif(prev, F.lit(0.0)) < proximity, F.lit(False))
    fresh = F.when(near, 0).otherwise(1)
    hits = hits.withColumn("_f", fresh)
    hits = hits.withColumn("level_no", F.sum("_f").over(wp.rowsBetween(Window.unboundedPreceding, 0)))
    return hits.groupBy("instrument", "kind", "level_no").agg(F.avg("price").alias("level"), F.count(F.lit(1)).alias("touches"))
