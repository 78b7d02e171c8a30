"""Evaluation of scores, folds, strategies and scorecards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlume.operators.series import Series, attach, materialise, quantiles, running, value_ranks, windowed


def probability_losses(rows: DataFrame, keys: Sequence[str], y: str = "y_true", p: str = "prob") -> DataFrame:
    """Brier score and log loss (probabilities limited to [1e-6, 1-1e-6])."""
    q = F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1 - 1e-6))
    t = F.col(y)
    return rows.groupBy(*keys).agg(
        F.avg((F.col(p) - t) * (F.col(p) - t)).alias("brier"), (-F.avg(t * F.log(q) + (1 - t) * F.log(1 - q))).alias("log_loss")
    )


def calibration_error(rows: DataFrame, keys: Sequence[str], y: str = "y_true", p: str = "prob", bins: int = 10) -> DataFrame:
    """Expected calibration error over right-closed equal bins."""
    edges = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    b = F.size(F.filter(edges, lambda e: e < F.col(p)))
    g = rows.withColumn("_b", b).groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"), F.avg(y).alias("_y"), F.avg(p).alias("_p"))
    return g.groupBy(*keys).agg((F.sum(F.col("_n") * F.abs(F.col("_y") - F.col("_p"))) / F.sum("_n")).alias("ece"))


def reliability_line(rows: DataFrame, keys: Sequence[str], y: str = "y_true", p: str = "prob") -> DataFrame:
    """Slope and intercept of outcome on probability; flat scores give (0, mean)."""
    yd = F.col(y).cast("double")
    flat = F.coalesce(F.stddev_pop(p) == 0, F.lit(True))
    return rows.groupBy(*keys).agg(
        F.when(flat, 0.0).otherwise(F.regr_slope(yd, F.col(p))).alias("slope"), F.when(flat, F.avg(yd)).otherwise(F.regr_intercept(yd, F.col(p))).alias("intercept")
    )


def trigger_rates(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    on = (F.col("signal") != 0).cast("double")
    return rows.groupBy(*keys).agg(F.avg(on).alias("trigger_rate"), (1 - F.avg(on)).alias("abstain_rate"), F.avg("pnl").alias("expectancy"))


def decile_ev(rows: DataFrame, keys: Sequence[str], p: str = "prob", ev: str = "pnl", bins: int = 10) -> DataFrame:
    """Mean EV by probability decile: right-closed quantile bins, equal edges merged."""
    k = list(keys)
    qs = {f"_q{i}": i / bins for i in range(bins + 1)}
    q = quantiles(rows, k, p, qs)
    e = F.array_sort(F.array_distinct(F.array(*[F.col(n) for n in qs])))
    q = q.select(*k, F.slice(e, 2, F.greatest(F.size(e) - 2, F.lit(0))).alias("_edges"), (F.size(e) >= 2).alias("_ok"))
    d = (attach(rows, q, k) if k else rows.crossJoin(F.broadcast(q))).where(F.col("_ok") & F.col(p).isNotNull())
    d = d.withColumn("decile", F.size(F.filter("_edges", lambda x: x < F.col(p))))
    return d.groupBy(*k, "decile").agg(F.avg(p).alias("mean_prob"), F.avg(ev).alias("mean_ev"), F.count(ev).alias("count"))


def stability(rows: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    m, sd = F.avg(x), F.stddev_pop(x)
    return rows.groupBy(*keys).agg(m.alias("mean"), sd.alias("std"), (F.max(x) - F.min(x)).alias("range"), (sd / (F.abs(m) + 1e-9)).alias("cv"))


def auc(rows: DataFrame, keys: Sequence[str], y: str, score: str) -> DataFrame:
    """Area under the ROC curve from tie-averaged ranks.

    Ranks live on distinct scores; positives per score meet them there, so no row
    is ranked on its own.
    """
    k = list(keys)
    r = value_ranks(rows, k, score)
    pos = rows.where(F.col(score).isNotNull()).groupBy(*k, score).agg(F.sum((F.col(y) == 1).cast("bigint")).alias("_p"))
    g = r.join(pos, [*k, score]).groupBy(*k).agg(F.sum(F.col("_rank") * F.col("_p")).alias("_rs"), F.sum("_p").alias("_np"), F.max("_cnt").alias("_n"))
    n0 = F.col("_n") - F.col("_np")
    area = (F.col("_rs") - F.col("_np") * (F.col("_np") + 1) / 2) / (F.col("_np") * n0)
    return g.select(*k, F.when((F.col("_np") > 0) & (n0 > 0), area).alias("auc"))


def slice_metrics(rows: DataFrame, keys: Sequence[str], gate: float) -> DataFrame:
    """Trade rate, direction balance, gated accuracy and AUC per test slice."""
    on = F.col("p_trade") > gate
    pred = F.when(F.col("p_long") > F.col("p_short"), 1).otherwise(0)
    g = rows.groupBy(*keys).agg(
        F.avg("p_trade").alias("mean_p_trade"), F.avg(on.cast("double")).alias("trade_rate"), F.avg(F.when(on, pred)).alias("direction_balance"),
        F.avg(F.when(on & (F.col("y_dir") != -1), (pred == F.col("y_dir")).cast("double"))).alias("direction_accuracy"),
    )
    return g.join(auc(rows, keys, "y_opp", "p_trade"), list(keys))


def probability_summary(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("p_trade") >= 0.5).cast("double")).alias("trade_rate"),
        F.avg((F.col("p_long") > F.col("p_short")).cast("double")).alias("long_rate"), F.avg(F.greatest("p_long", "p_short")).alias("avg_conf"),
    )


def drawdown_series(rows: DataFrame, s: Series, pnl: str = "pnl") -> DataFrame:
    """Cumulative PnL minus its running peak."""
    d = running(rows, s, sums={"equity": F.coalesce(F.col(pnl), F.lit(0.0))}, peaks={"_peak": "equity"})
    return d.withColumn("drawdown", F.col("equity") - F.col("_peak")).drop("_peak")


def portfolio_metrics(portfolio: DataFrame, ts: str = "ts") -> DataFrame:
    """Expectancy, volatility and daily volatility."""
    day = portfolio.groupBy(F.col(ts).cast("date").alias("_d")).agg(F.sum("pnl").alias("_x"))
    return portfolio.agg(F.avg("pnl").alias("expectancy"), F.stddev_pop("pnl").alias("volatility")).crossJoin(day.agg(F.stddev_pop("_x").alias("daily_volatility")))


def leave_one_out(sleeves: DataFrame, at: str, sleeve: str, aversion: float = 0.5) -> DataFrame:
    """Utility (mean - aversion * deviation) with and without each sleeve."""
    tot = sleeves.groupBy(at).agg(F.sum("pnl").alias("_all"))
    u = lambda x: F.avg(x) - aversion * F.stddev_pop(x)
    full = tot.agg(u("_all").alias("_full"))
    g = sleeves.join(tot, at).withColumn("_wo", F.col("_all") - F.col("pnl")).groupBy(sleeve).agg(u("_wo").alias("_u"), F.avg("pnl").alias("mean_contribution"))
    return g.crossJoin(F.broadcast(full)).select(sleeve, "mean_contribution", (F.col("_full") - F.col("_u")).alias("leave_one_out"))


def co_drawdown(sleeves: DataFrame, at: str, sleeve: str, s: Series) -> DataFrame:
    """Each sleeve's PnL summed over the times the portfolio is under water."""
    tot = sleeves.groupBy(at).agg(F.sum("pnl").alias("pnl"))
    wet = drawdown_series(tot, s).where("drawdown < 0").select(at)
    return sleeves.join(wet, at, "left_semi").groupBy(sleeve).agg(F.sum("pnl").alias("co_drawdown"))


def correlation_stability(wide: DataFrame, cols: Sequence[str], chunks: Column) -> DataFrame:
    """Mean deviation of pairwise correlations over consecutive chunks, over all
    ordered pairs and the diagonal, as of a full matrix."""
    n = len(cols)
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n)]
    g = wide.withColumn("_c", chunks).groupBy("_c").agg(F.count(F.lit(1)).alias("_n"), *[F.corr(cols[i], cols[j]).alias(f"_{i}_{j}") for i, j in pairs])
    g = g.where("_n >= 5")
    dev = g.agg(*[F.stddev_pop(f"_{i}_{j}").alias(f"d_{i}_{j}") for i, j in pairs])
    total = sum((2 * F.col(f"d_{i}_{j}") for i, j in pairs), F.lit(0.0))
    return dev.select((total / (n * n)).alias("corr_std_mean"))


def psi(rows: DataFrame, keys: Sequence[str], value: str, is_ref: Column, bins: int = 10) -> DataFrame:
    """Population stability index per key: reference-quantile bins (the last one
    closed, values outside dropped) and shares limited below by 1e-6."""
    k = list(keys)
    d = rows.where(F.col(value).isNotNull()).withColumn("_ref", is_ref)
    qs = {f"_q{i}": i / bins for i in range(bins + 1)}
    e = F.array_sort(F.array_distinct(F.array(*[F.col(n) for n in qs])))
    q = materialise(quantiles(d.where("_ref"), k, value, qs).select(*k, e.alias("_e")))
    d = attach(d, q, k) if k else d.crossJoin(F.broadcast(q))
    v, size = F.col(value), F.size("_e")
    b = F.when(v == F.get("_e", size - 1), size - 2).otherwise(F.size(F.filter("_e", lambda x: x <= v)) - 1)
    d = d.withColumn("_b", b).where((F.col("_b") >= 0) & (F.col("_b") < size - 1))
    g = d.groupBy(*k, "_b").agg(F.count(F.when(F.col("_ref"), 1)).alias("_r"), F.count(F.when(~F.col("_ref"), 1)).alias("_c"))
    every = q.select(*k, F.size("_e").alias("_s"), F.explode(F.sequence(F.lit(0), F.greatest(F.size("_e") - 2, F.lit(0)))).alias("_b"))
    g = every.join(g, [*k, "_b"], "left").na.fill(0, ["_r", "_c"])
    w = Window.partitionBy(*k)  # at most `bins` rows
    rp = F.greatest(F.col("_r") / F.greatest(F.lit(1), F.sum("_r").over(w)), F.lit(1e-6))
    cp = F.greatest(F.col("_c") / F.greatest(F.lit(1), F.sum("_c").over(w)), F.lit(1e-6))
    g = g.withColumns({"_rp": rp, "_cp": cp})
    return g.groupBy(*k).agg(F.when(F.max("_s") < 3, 0.0).otherwise(F.sum((F.col("_cp") - F.col("_rp")) * F.log(F.col("_cp") / F.col("_rp")))).alias("psi"))


def mean_drift(rows: DataFrame, keys: Sequence[str], value: Column, is_ref: Column, name: str) -> DataFrame:
    """Reference mean, current mean and their difference; keys missing on one side drop out."""
    g = rows.withColumn("_v", value).groupBy(*keys).agg(F.avg(F.when(is_ref, F.col("_v"))).alias(f"{name}_ref"), F.avg(F.when(~is_ref, F.col("_v"))).alias(f"{name}_cur"))
    return g.where(F.col(f"{name}_ref").isNotNull() & F.col(f"{name}_cur").isNotNull()).withColumn("delta", F.col(f"{name}_cur") - F.col(f"{name}_ref"))


def session_validation(rows: DataFrame, s: Series, digits: int = 9) -> DataFrame:
    """Bars, trades, abstain rate, expectancy and drawdown share per session; drawdowns
    count from ``digits`` decimals on."""
    d = drawdown_series(rows, s).withColumn("drawdown", F.round("drawdown", digits))
    on = (F.col("signal") != 0)
    return d.groupBy("session").agg(
        F.count(F.lit(1)).alias("bars"), F.count(F.when(on, 1)).alias("trade_count"), F.avg((~on).cast("double")).alias("abstain_rate"),
        F.avg("pnl").alias("expectancy"), F.sum("pnl").alias("pnl_sum"), F.coalesce(F.sum(F.when(F.col("drawdown") < 0, F.col("pnl"))), F.lit(0.0)).alias("drawdown_contribution"),
    )


def threshold_usage(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many bars of each key carry a signal, and their share."""
    g = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("bars"), F.count(F.when(F.col("signal") != 0, 1)).alias("trade_bars"))
    return g.withColumn("trade_freq", F.col("trade_bars") / F.col("bars"))


def retained_pnl(rows: DataFrame, kept: Column, resolution: str, edges: Sequence[int]) -> DataFrame:
    """Mean PnL of kept and excluded rows by time to resolution, in right-closed buckets."""
    r = F.col(resolution)
    bucket = F.lit(f"> {edges[-1]}")
    for e in sorted(edges, reverse=True):
        bucket = F.when(r <= e, f"<= {e}").otherwise(bucket)
    return rows.groupBy(kept.alias("kept"), bucket.alias("resolution")).agg(F.count(F.lit(1)).alias("n"), F.avg("pnl").alias("mean_pnl"))


def retained_share(rows: DataFrame, by: str, mask: str) -> DataFrame:
    """Rows that pass the mask, overall (ALL) and per value of ``by``."""
    g = rows.groupingSets([[F.col(by)], []], F.col(by)).agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col(mask), 1)).alias("retained"))
    return g.select(F.coalesce(by, F.lit("ALL")).alias(by), "total", "retained", (F.col("total") - F.col("retained")).alias("excluded"), (F.col("retained") / F.col("total")).alias("retained_share"))


def stability_score(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Walk-forward summary and stability per key from rows of window results
    (net_pnl, profit_factor with NULL for infinite, trades, max_drawdown)."""
    p = F.col("net_pnl")
    m, sd = F.avg(p), F.stddev_pop(p)
    pos = F.avg((p > 0).cast("double"))
    cons = F.when(m != 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - sd / (F.abs(m) + 1e-9)))).otherwise(0.0)
    pf = F.coalesce(F.avg("profit_factor"), F.lit(0.0))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("windows_run"), pos.alias("positive_window_ratio"), m.alias("test_net_pnl_mean"), sd.alias("test_net_pnl_std"),
        F.avg("trades").alias("test_trades_mean"), pf.alias("test_profit_factor_mean"), F.avg("max_drawdown").alias("test_max_drawdown_mean"),
        (0.5 * pos + 0.25 * cons + 0.25 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), pf / 2))).alias("stability_score"),
    )


RANK = ("stability_score", "test_net_pnl_mean", "test_profit_factor_mean")


def ranked(rows: DataFrame, k: int, tie: Sequence[str]) -> DataFrame:
    """Top-k by stability, PnL, profit factor and smaller drawdown."""
    order = [F.col(c).desc() for c in RANK] + [F.col("test_max_drawdown_mean").asc()] + [F.col(c) for c in tie]
    return rows.orderBy(*order).limit(k)


def shortlist(rows: DataFrame, corr: DataFrame, min_stability: float, min_trades: float, max_corr: float) -> DataFrame:
    """Greedy, correlation-aware shortlist in rank order.

    An instrument correlates fully with itself, so only its best row can survive;
    the greedy pass runs over that one-row-per-instrument list inside one
    expression.  corr: pairs (a, b, corr).
    """
    ok = rows.where((F.col("stability_score") >= min_stability) & (F.col("test_trades_mean") >= min_trades))
    key = F.struct(*[(-F.col(c)).alias(f"k{i}") for i, c in enumerate(RANK)], F.col("test_max_drawdown_mean").alias("k3"), F.col("strategy").alias("k4"))
    best = ok.groupBy("instrument").agg(F.min_by(F.struct(*rows.columns), key).alias("r"), F.min(key).alias("k"))
    listed = best.agg(F.sort_array(F.collect_list(F.struct("k", "instrument"))).alias("list"))
    close = corr.where(F.abs("corr") > max_corr).select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p"))
    close = close.agg(F.collect_set(F.concat_ws("|", "p.a", "p.b")).alias("close"))
    one = listed.crossJoin(close)
    clash = lambda acc, n: F.exists(acc, lambda m: F.array_contains(F.col("close"), F.concat_ws("|", n, m)))
    picked = F.aggregate(
        F.transform("list", lambda e: e["instrument"]), F.array().cast("array<string>"), lambda acc, n: F.when(clash(acc, n), acc).otherwise(F.concat(acc, F.array(n)))
    )
    chosen = one.select(F.posexplode(picked).alias("rank", "instrument"))
    return best.join(chosen, "instrument").select((F.col("rank") + 1).alias("rank"), "r.*")


def promotion_gate(stats: DataFrame, max_dd: float = 0.20, least_trades: int = 50) -> DataFrame:
    ok = (F.col("net_pnl") > 0) & (F.col("max_drawdown") <= max_dd) & (F.col("trades") >= least_trades) & (F.col("sharpe") > 0)
    return stats.withColumn("status", F.when(ok, "PASS").otherwise("REJECT"))


def yearly_gate(years: DataFrame, limits: DataFrame) -> DataFrame:
    """Per symbol: years tested and profitable, median expectancy and worst
    drawdown against its limits; a symbol without limits does not pass and says so.  years: symbol, year, net_pnl, expectancy,
    max_drawdown (one row per year, so the exact median is over a few values)."""
    g = years.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("tested_years"), F.count(F.when(F.col("net_pnl") > 0, 1)).alias("profitable_years"),
        F.percentile("expectancy", F.lit(0.5)).alias("median_expectancy"), F.max("max_drawdown").alias("worst_drawdown"),
    )
    d = g.join(limits, "symbol", "left").withColumn("profit_ratio", F.col("profitable_years") / F.col("tested_years"))
    ok = (
        (F.col("tested_years") >= F.col("min_tested")) & (F.col("profitable_years") >= F.col("min_profitable")) & (F.col("profit_ratio") >= F.col("min_ratio"))
        & (F.col("median_expectancy") >= F.col("min_median")) & (F.col("worst_drawdown") <= F.col("max_worst_dd"))
    )
    status = F.when(F.col("min_tested").isNull(), "no limits").when(ok, "passed").otherwise("failed")
    return d.withColumn("passed", F.coalesce(ok, F.lit(False))).withColumn("status", status)


def pick_by_role(rows: DataFrame, roles=("champion", "challenger")) -> DataFrame:
    """First row per symbol and role."""
    r = rows.where(F.col("role").isin(*roles))
    return r.groupBy("symbol", "role").agg(F.min_by(F.struct(*[c for c in rows.columns if c not in ("symbol", "role")]), "row_no").alias("_r")).select("symbol", "role", "_r.*")


def weekly_scorecard(rows: DataFrame) -> DataFrame:
    """Weekly totals with trade-weighted rates; missing numbers count as 0."""
    z = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
    d = rows.select(
        "review_week", "strategy_name", F.greatest(z("trades"), F.lit(0.0)).alias("t"), z("net_pnl").alias("p"), z("win_rate").alias("w"),
        z("avg_slippage_pips").alias("s"), z("order_rejection_rate_pct").alias("r"), z("max_drawdown_pct").alias("d"),
    )
    # strategies per week in two steps, so no distinct set grows in one place
    per = d.groupBy("review_week", "strategy_name").agg(
        F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum(F.col("w") * F.col("t")).alias("w"), F.sum(F.col("s") * F.col("t")).alias("s"), F.sum(F.col("r") * F.col("t")).alias("r"), F.max("d").alias("d")
    )
    g = per.groupBy("review_week").agg(F.count(F.lit(1)).alias("strategy_count"), *[F.sum(c).alias(c) for c in "tpwsr"], F.max("d").alias("d"))
    by = lambda c: F.when(F.col("t") > 0, F.col(c) / F.col("t")).otherwise(0.0)
    return g.select(
        "review_week", "strategy_count", F.col("t").cast("bigint").alias("total_trades"), F.col("p").alias("total_net_pnl"), by("p").alias("expectancy_per_trade"),
        by("w").alias("weighted_win_rate"), by("s").alias("weighted_slippage_pips"), by("r").alias("weighted_rejection_rate_pct"), F.greatest(F.col("d"), F.lit(0.0)).alias("max_drawdown_pct"),
    )


def latest_by_strategy(rows: DataFrame, tie: str) -> DataFrame:
    """Row of the latest week per strategy; the first in file order on ties."""
    key = F.struct(F.col("review_week"), -F.col(tie))
    return rows.groupBy("strategy_name").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "strategy_name"]), key).alias("_r")).select("strategy_name", "_r.*")


def decision_mix(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.when(F.trim("decision") == "", "unknown").otherwise(F.coalesce(F.trim("decision"), F.lit("unknown"))).alias("decision")).agg(F.count(F.lit(1)).alias("n"))


def shadow_snapshot(rows: DataFrame) -> DataFrame:
    """Status at the newest time: rows ok, profitable rows, weighted expectancy,
    worst drawdown."""
    now = rows.agg(F.max("ts").alias("_now"))
    d = rows.crossJoin(F.broadcast(now)).where((F.col("ts") == F.col("_now")) & (F.col("status") == "ok"))
    w = F.greatest(F.coalesce("trades", F.lit(0.0)), F.lit(0.0))
    good = (F.col("expectancy") > 0) & (F.col("profit_factor") > 1)
    return d.agg(
        F.max("_now").alias("last_ts"), F.count(F.lit(1)).alias("rows_ok"), F.count(F.when(good, 1)).alias("rows_profitable"),
        (F.sum(F.coalesce("expectancy", F.lit(0.0)) * w) / F.greatest(F.lit(1.0), F.sum(w))).alias("weighted_expectancy"), F.max(F.coalesce("max_dd", F.lit(0.0))).alias("worst_max_dd"),
    )


def execution_event_class(payload: Column) -> Column:
    """ORDER PLACED / CLOSED / both / FILLED from the raw fill record."""
    has = lambda p: F.coalesce(F.get_json_object(payload, p), F.lit("")).isin("", "null", "{}", "[]", "false")
    opened = ~has("$.tradeOpened")
    closed = ~has("$.tradeReduced") | ~has("$.tradesClosed")
    return F.when(opened & closed, "ORDER PLACED + ORDER CLOSED").when(opened, "ORDER PLACED").when(closed, "ORDER CLOSED").otherwise("ORDER FILLED")


def grid_evaluation(bars: DataFrame, lookbacks: Sequence[int], moves: Sequence[float], hold: int, split: Column, s: Series) -> DataFrame:
    """Breakout parameter grid times split: trades, mean and win share of the
    forward move.  All look-backs are columns of one chunk pass; rows multiply only
    where a parameter set trades."""

    def build(d, w):
        cols = {"_fwd": F.lead("close", hold).over(w) / F.nullif(F.col("close"), F.lit(0.0)) - 1}
        for n in lookbacks:
            f = w.rowsBetween(-n, -1)
            full = F.count("high").over(f) >= n
            cols[f"_h{n}"], cols[f"_l{n}"] = F.when(full, F.max("high").over(f)), F.when(full, F.min("low").over(f))
        return d.withColumns(cols)

    d = windowed(bars, s, build, back=max(lookbacks), ahead=hold).withColumn("split", split)
    c = F.col("close")
    items = [
        F.when(side.isNotNull() & F.col("_fwd").isNotNull(), F.struct(F.lit(n).alias("lookback"), F.lit(m).alias("min_move"), (F.col("_fwd") * side).alias("ret")))
        for n in lookbacks for m in moves
        for side in [F.when(c > F.col(f"_h{n}") * (1 + m), 1).when(c < F.col(f"_l{n}") * (1 - m), -1)]
    ]
    e = d.select("split", F.explode(F.array_compact(F.array(*items))).alias("_t")).select("split", "_t.*")
    return e.groupBy("lookback", "min_move", "split").agg(F.count(F.lit(1)).alias("trades"), F.avg("ret").alias("mean_ret"), F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"))
