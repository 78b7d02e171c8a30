"""Evaluation queries: scores, folds, rankings, scorecards."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlume.operators import align, evaluate as ev, series as sr, trades as tr
from barlume.plans import sqltext as q
from barlume.plans.q_quality import INSTRUMENTS, RETURNS
from barlume.plans.registry import query, view

OVER = q.OVER


@query("e01_brier_log_loss", "session brier:r log_loss:r", """SELECT session, avg((prob - y_true) ** 2) AS brier, -avg(y_true * ln(least(greatest(prob, 1e-6), 1 - 1e-6)) + (1 - y_true) * ln(1 - least(greatest(prob, 1e-6), 1 - 1e-6))) AS log_loss FROM scores GROUP BY 1""")
def _(t):
    return ev.probability_losses(t.scores, ["session"])


@query("e02_calibration_error", "session ece:r", """SELECT session, sum(n * abs(y - p)) / sum(n) AS ece FROM (SELECT session, b, count(*) AS n, avg(y_true) AS y, avg(prob) AS p FROM (SELECT *, len(list_filter([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9], lambda e: CAST(e AS DOUBLE) < prob)) AS b FROM scores) GROUP BY 1, 2) GROUP BY 1""")
def _(t):
    return ev.calibration_error(t.scores, ["session"])


@query("e03_reliability_line", "session slope:r intercept:r", "SELECT session, regr_slope(y_true, prob) AS slope, regr_intercept(y_true, prob) AS intercept FROM scores GROUP BY 1")
def _(t):
    return ev.reliability_line(t.scores, ["session"])


_SIG = "CASE WHEN prob >= 0.6 THEN 1 WHEN prob <= 0.4 THEN -1 ELSE 0 END"


def signalled(t):
    p = F.col("prob")
    return t.scores.withColumn("signal", F.when(p >= 0.6, 1).when(p <= 0.4, -1).otherwise(0))


@query("e04_trigger_rates", "session fold:i trigger_rate:r abstain_rate:r expectancy:r", f"""SELECT session, fold, avg(CASE WHEN s <> 0 THEN 1.0 ELSE 0 END) AS trigger_rate, 1 - avg(CASE WHEN s <> 0 THEN 1.0 ELSE 0 END) AS abstain_rate, avg(pnl) AS expectancy FROM (SELECT *, {_SIG} AS s FROM scores) GROUP BY 1, 2""")
def _(t):
    return ev.trigger_rates(signalled(t), ["session", "fold"])


@query("e05_ev_by_decile", "session decile:i mean_prob:r mean_ev:r count:i", """SELECT session, len(list_filter(e, lambda x: x < prob)) AS decile, avg(prob) AS mean_prob, avg(pnl) AS mean_ev, count(*) AS count FROM scores JOIN (
   SELECT session, list_filter(list_distinct(l), lambda x: x > lo AND x < hi) AS e FROM (SELECT session, quantile_cont(prob, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS l, min(prob) AS lo, max(prob) AS hi FROM scores GROUP BY 1)) USING (session) GROUP BY 1, 2""")
def _(t):
    return ev.decile_ev(t.score_rows, ["session"])


@query("e06_threshold_stability", "session mean:r std:r range:r cv:r", "SELECT session, avg(g) AS mean, stddev_pop(g) AS std, max(g) - min(g) AS range, stddev_pop(g) / (abs(avg(g)) + 1e-9) AS cv FROM (SELECT session, fold, avg(prob) AS g FROM scores GROUP BY 1, 2) GROUP BY 1")
def _(t):
    return ev.stability(t.scores.groupBy("session", "fold").agg(F.avg("prob").alias("g")), ["session"], "g")


_SL = "SELECT fold, prob AS p_trade, spread_proxy * 10 AS p_long, 0.5 AS p_short, y_true AS y_opp, CASE WHEN quantity > 25 THEN 1 WHEN quantity > 10 THEN 0 ELSE -1 END AS y_dir FROM scores"


def slices(t):
    qn = F.col("quantity")
    return t.score_rows.select("fold", F.col("prob").alias("p_trade"), (F.col("spread_proxy") * 10).alias("p_long"), F.lit(0.5).alias("p_short"), F.col("y_true").alias("y_opp"), F.when(qn > 25, 1).when(qn > 10, 0).otherwise(-1).alias("y_dir"))


@query("e07_slice_metrics", "fold:i mean_p_trade:r trade_rate:r direction_balance:r direction_accuracy:r auc:r", """SELECT fold, avg(p_trade) AS mean_p_trade, avg(CASE WHEN p_trade > 0.6 THEN 1.0 ELSE 0 END) AS trade_rate, avg(CASE WHEN p_trade > 0.6 THEN d END) AS direction_balance,
   avg(CASE WHEN p_trade > 0.6 AND y_dir <> -1 THEN CASE WHEN d = y_dir THEN 1.0 ELSE 0 END END) AS direction_accuracy, (sum(rk) FILTER (y_opp = 1) - sum(y_opp) * (sum(y_opp) + 1) / 2) / (sum(y_opp) * (count(*) - sum(y_opp))) AS auc FROM (
   SELECT *, CASE WHEN p_long > p_short THEN 1 ELSE 0 END AS d, rank() OVER (PARTITION BY fold ORDER BY p_trade) + (count(*) OVER (PARTITION BY fold, p_trade) - 1) / 2 AS rk FROM sl) GROUP BY fold""", sl=_SL)
def _(t):
    return ev.slice_metrics(slices(t), ["fold"], 0.6)


@query("e08_probability_summary", "fold:i n:i trade_rate:r long_rate:r avg_conf:r", "SELECT fold, count(*) AS n, avg(CASE WHEN p_trade >= 0.5 THEN 1.0 ELSE 0 END) AS trade_rate, avg(CASE WHEN p_long > p_short THEN 1.0 ELSE 0 END) AS long_rate, avg(greatest(p_long, p_short)) AS avg_conf FROM sl GROUP BY fold", sl=_SL)
def _(t):
    return ev.probability_summary(slices(t), ["fold"])


DAYS = sr.Series(keys=(), ts="day", order=("day",), slice_seconds=364 * 86400)
_TOT = "SELECT day, sum(pnl) AS pnl FROM sleeve_pnl GROUP BY day"
_DD = "SELECT *, equity - max(equity) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS drawdown FROM (SELECT *, sum(pnl) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS equity FROM tot)"


@view("sleeve_table", "SELECT * FROM sleeve_pnl")
def sleeve_table(t):
    return sr.materialise(t.sleeve_pnl)


def portfolio(t):
    return t.sleeve_table.groupBy("day").agg(F.sum("pnl").alias("pnl"))


@query("e09_drawdown", "day equity:r2 drawdown:r2", "SELECT * FROM dd", tot=_TOT, dd=_DD)
def _(t):
    return ev.drawdown_series(portfolio(t), DAYS)


@query("e10_portfolio_metrics", "expectancy:r3 volatility:r3 daily_volatility:r3", "SELECT avg(pnl) AS expectancy, stddev_pop(pnl) AS volatility, (SELECT stddev_pop(x) FROM (SELECT CAST(day AS DATE) AS d, sum(pnl) AS x FROM sleeve_pnl GROUP BY 1)) AS daily_volatility FROM sleeve_pnl")
def _(t):
    return ev.portfolio_metrics(t.sleeve_table, "day")


@query("e11_leave_one_out", "sleeve:i mean_contribution:r3 leave_one_out:r3", """SELECT sleeve, avg(s.pnl) AS mean_contribution, any_value(f.u) - (avg(t.pnl - s.pnl) - 0.5 * stddev_pop(t.pnl - s.pnl)) AS leave_one_out FROM sleeve_pnl s JOIN tot t USING (day) CROSS JOIN (SELECT avg(pnl) - 0.5 * stddev_pop(pnl) AS u FROM tot) f GROUP BY sleeve""", tot=_TOT)
def _(t):
    return ev.leave_one_out(t.sleeve_table, "day", "sleeve")


@query("e12_co_drawdown", "sleeve:i co_drawdown:r2", "SELECT sleeve, sum(s.pnl) AS co_drawdown FROM sleeve_pnl s JOIN dd USING (day) WHERE drawdown < 0 GROUP BY sleeve", tot=_TOT, dd=_DD)
def _(t):
    return ev.co_drawdown(t.sleeve_table, "day", "sleeve", DAYS)


_WIDE = "SELECT day, " + ", ".join(f"max(pnl) FILTER (sleeve = {i}) AS s{i}" for i in range(4)) + " FROM sleeve_pnl GROUP BY day"
SLEEVES = ["s0", "s1", "s2", "s3"]


def wide_pnl(t):
    return t.sleeve_table.groupBy("day").agg(*[F.max(F.when(F.col("sleeve") == i, F.col("pnl"))).alias(f"s{i}") for i in range(4)])


@query("e13_correlation_stability", "corr_std_mean:r", f"""SELECT ({' + '.join(f'2 * stddev_pop(c{i}{j})' for i in range(4) for j in range(i + 1, 4))}) / 16 AS corr_std_mean FROM (SELECT year(day) AS c, {', '.join(f'corr(s{i}, s{j}) AS c{i}{j}' for i in range(4) for j in range(i + 1, 4))} FROM wd GROUP BY 1 HAVING count(*) >= 5)""", wd=_WIDE)
def _(t):
    return ev.correlation_stability(wide_pnl(t), SLEEVES, F.year("day"))


_PSI = """SELECT session, CASE WHEN ne < 3 THEN 0 ELSE sum((cp - rp) * ln(cp / rp)) END AS psi FROM (SELECT session, ne, greatest(r / greatest(1, sum(r) OVER (PARTITION BY session)), 1e-6) AS rp, greatest(c / greatest(1, sum(c) OVER (PARTITION BY session)), 1e-6) AS cp FROM (
   SELECT e.session, e.ne, b.b, count(*) FILTER (x.ref AND x.bin = b.b) AS r, count(*) FILTER (NOT x.ref AND x.bin = b.b) AS c FROM ed e CROSS JOIN LATERAL (SELECT unnest(range(0, e.ne - 1)) AS b) b JOIN binned x ON x.session = e.session GROUP BY 1, 2, 3)) GROUP BY session, ne"""
_PSI_CTES = {
    "pv": "SELECT {k} AS session, year(ts) < 2000 AS ref, notional AS v FROM scores",
    "ed": "SELECT session, list_sort(list_distinct(quantile_cont(v, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e, len(list_distinct(quantile_cont(v, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS ne FROM pv WHERE ref GROUP BY session",
    "binned": "SELECT pv.session, ref, CASE WHEN v = e[ne] THEN ne - 2 WHEN v > e[ne] THEN NULL ELSE len(list_filter(e, lambda x: x <= v)) - 1 END AS bin FROM pv JOIN ed USING (session)",
}


@query("e21_psi_by_session", "session psi:r", _PSI, **{k: v.replace("{k}", "session") for k, v in _PSI_CTES.items()})
def _(t):
    return ev.psi(sr.materialise(t.scores.select("session", "ts", "notional")), ["session"], "notional", F.year("ts") < 2000)


@query("e21_psi_global", "psi:r", f"SELECT psi FROM ({_PSI})", **{k: v.replace("{k}", "'all'") for k, v in _PSI_CTES.items()})
def _(t):
    return ev.psi(sr.materialise(t.scores.select("ts", "notional")), [], "notional", F.year("ts") < 2000)


@query("e22_calibration_threshold_drift", "session brier_ref:r brier_cur:r delta:r", "SELECT session, avg((prob - y_true) ** 2) FILTER (fold < 2000) AS brier_ref, avg((prob - y_true) ** 2) FILTER (fold >= 2000) AS brier_cur, avg((prob - y_true) ** 2) FILTER (fold >= 2000) - avg((prob - y_true) ** 2) FILTER (fold < 2000) AS delta FROM scores GROUP BY 1")
def _(t):
    e = F.col("prob") - F.col("y_true")
    return ev.mean_drift(t.scores, ["session"], e * e, F.col("fold") < 2000, "brier")


@query("e22_threshold_drift", "session thr_ref:r thr_cur:r delta:r", "SELECT session, avg(q) FILTER (fold < 2000) AS thr_ref, avg(q) FILTER (fold >= 2000) AS thr_cur, avg(q) FILTER (fold >= 2000) - avg(q) FILTER (fold < 2000) AS delta FROM (SELECT session, fold, quantile_cont(prob, 0.8) AS q FROM scores GROUP BY 1, 2) GROUP BY 1")
def _(t):
    thr = sr.quantiles(t.score_rows, ["session", "fold"], "prob", {"q": 0.8})
    return ev.mean_drift(thr, ["session"], F.col("q"), F.col("fold") < 2000, "thr")


SCORE_S = sr.Series(keys=(), order=("ts", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "quantity", "notional"), slice_seconds=86400)
_SCD = f"""SELECT *, eq - max(eq) OVER o AS dd FROM (SELECT *, {_SIG} AS sg, sum(pnl) OVER o AS eq FROM scores WINDOW o AS (ORDER BY ts, l_orderkey, l_linenumber, l_partkey, l_suppkey, quantity, notional ROWS UNBOUNDED PRECEDING)) WINDOW o AS (ORDER BY ts, l_orderkey, l_linenumber, l_partkey, l_suppkey, quantity, notional ROWS UNBOUNDED PRECEDING)"""


@query("e32_session_validation", "session bars:i trade_count:i abstain_rate:r expectancy:r pnl_sum:r4 drawdown_contribution:r4", "SELECT session, count(*) AS bars, count(*) FILTER (sg <> 0) AS trade_count, avg(CASE WHEN sg = 0 THEN 1.0 ELSE 0 END) AS abstain_rate, avg(pnl) AS expectancy, sum(pnl) AS pnl_sum, coalesce(sum(pnl) FILTER (round(dd, 6) < 0), 0) AS drawdown_contribution FROM scd GROUP BY 1", scd=_SCD)
def _(t):
    rows = sr.materialise(signalled(t).select(*SCORE_S.order, "session", "signal", "pnl"))  # the join runs once, not in every pass
    return ev.session_validation(rows, SCORE_S, digits=6)


@query("e31_threshold_usage", "session state:i bars:i trade_bars:i trade_freq:r", f"SELECT session, state, count(*) AS bars, count(*) FILTER (sg <> 0) AS trade_bars, count(*) FILTER (sg <> 0) / count(*) AS trade_freq FROM (SELECT session, CAST(floor(spread_proxy * 40) AS BIGINT) AS state, {_SIG} AS sg FROM scores) GROUP BY 1, 2")
def _(t):
    return ev.threshold_usage(signalled(t).withColumn("state", F.floor(F.col("spread_proxy") * 40)), ["session", "state"])


@query("e33_retained_vs_excluded", "kept resolution n:i mean_pnl:r", "SELECT quantity >= 10 AS kept, CASE WHEN quantity <= 4 THEN '<= 4' WHEN quantity <= 16 THEN '<= 16' ELSE '> 16' END AS resolution, count(*) AS n, avg(pnl) AS mean_pnl FROM scores GROUP BY 1, 2")
def _(t):
    return ev.retained_pnl(t.scores, F.col("quantity") >= 10, "quantity", (4, 16))


# window results: FIFO trades per (instrument, strategy = entry side, window = year)
_WR = """SELECT instrument, entry_side AS strategy, year(ts) AS win, sum(pnl) AS net_pnl, sum(greatest(pnl, 0)) / nullif(sum(greatest(-pnl, 0)), 0) AS profit_factor, count(*) AS trades, max(-pnl) / 1000000 AS max_drawdown FROM trades GROUP BY ALL"""
_SS = """SELECT instrument, strategy, count(*) AS windows_run, avg(CASE WHEN net_pnl > 0 THEN 1.0 ELSE 0 END) AS positive_window_ratio, avg(net_pnl) AS test_net_pnl_mean, stddev_pop(net_pnl) AS test_net_pnl_std, avg(trades) AS test_trades_mean, coalesce(avg(profit_factor), 0) AS test_profit_factor_mean,
   avg(max_drawdown) AS test_max_drawdown_mean, 0.5 * avg(CASE WHEN net_pnl > 0 THEN 1.0 ELSE 0 END) + 0.25 * coalesce(greatest(0, least(1, 1 - stddev_pop(net_pnl) / (abs(nullif(avg(net_pnl), 0)) + 1e-9))), 0) + 0.25 * greatest(0, least(1, coalesce(avg(profit_factor), 0) / 2)) AS stability_score FROM wr GROUP BY 1, 2"""
SUMMARY = "instrument:i strategy windows_run:i positive_window_ratio:r test_net_pnl_mean:r2 test_net_pnl_std:r2 test_trades_mean:r test_profit_factor_mean:r test_max_drawdown_mean:r stability_score:r"


def window_results(t):
    p = F.col("pnl")
    return t.trades.groupBy("instrument", F.col("entry_side").alias("strategy"), F.year("ts").alias("win")).agg(
        F.sum(p).alias("net_pnl"), (F.sum(F.greatest(p, F.lit(0.0))) / F.nullif(F.sum(F.greatest(-p, F.lit(0.0))), F.lit(0.0))).alias("profit_factor"), F.count(F.lit(1)).alias("trades"), (F.max(-p) / 1000000).alias("max_drawdown"))


def summaries(t):
    return ev.stability_score(window_results(t), ["instrument", "strategy"])


@query("e34_e35_walkforward_summary", SUMMARY, "SELECT * FROM ss", wr=_WR, ss=_SS)
def _(t):
    return summaries(t)


SUMMARIES = {"wr": _WR, "ss": _SS}
RANKING = "stability_score DESC, test_net_pnl_mean DESC, test_profit_factor_mean DESC, test_max_drawdown_mean, instrument, strategy"


@query("e36_ranking_top_k", SUMMARY, f"SELECT * FROM ss ORDER BY {RANKING} LIMIT 15", wr=_WR, ss=_SS)
def _(t):
    return ev.ranked(summaries(t), 15, ["instrument", "strategy"])


# the list is gone through in rank order, each entry joining those picked so far unless it is close to one
_LIST = {
    "sl_bars": f"""SELECT instrument, ts, lead(close, 8) OVER ({OVER}) / nullif(close, 0) - 1 AS fwd, CASE WHEN close > max(high) OVER ({OVER} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) THEN 1
      WHEN close < min(low) OVER ({OVER} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) THEN -1 END AS side FROM bars_h1""",
    "wr": """SELECT instrument, CASE WHEN side > 0 THEN 'long' ELSE 'short' END AS strategy, week(ts) AS win, sum(side * fwd) AS net_pnl, sum(greatest(side * fwd, 0)) / nullif(sum(greatest(-side * fwd, 0)), 0) AS profit_factor,
      count(*) AS trades, max(-side * fwd) AS max_drawdown FROM sl_bars WHERE side IS NOT NULL AND fwd IS NOT NULL GROUP BY 1, 2, 3""",
    "ss": _SS,
    "sl_best": f"SELECT * FROM ss WHERE stability_score >= 0 AND test_trades_mean >= 1 QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY {RANKING}, strategy) = 1",
    "sl_order": "SELECT *, row_number() OVER (ORDER BY stability_score DESC, test_net_pnl_mean DESC, test_profit_factor_mean DESC, test_max_drawdown_mean, strategy, instrument) AS k FROM sl_best",
    "sl_ret": RETURNS,
    "sl_close": "SELECT x.instrument AS a, y.instrument AS b FROM sl_ret x JOIN sl_ret y ON x.ts = y.ts AND x.instrument <> y.instrument GROUP BY 1, 2 HAVING abs(corr(x.ret, y.ret)) > 0.05",
    "sl_walk": """SELECT CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS picked UNION ALL
      SELECT o.k, CASE WHEN EXISTS (SELECT 1 FROM sl_close c WHERE c.a = o.instrument AND list_contains(picked, c.b)) THEN picked ELSE list_append(picked, o.instrument) END FROM sl_walk w JOIN sl_order o ON o.k = w.k + 1""",
}


@query("e37_correlation_shortlist", "rank:i instrument strategy stability_score:r", "SELECT list_position(picked, instrument) AS rank, instrument, strategy, stability_score FROM sl_best JOIN (SELECT picked FROM sl_walk ORDER BY k DESC LIMIT 1) ON list_contains(picked, instrument)", **_LIST)
def _(t):
    """Breakout windows per instrument and week, shortlisted by return correlation."""
    bars = t.bars_h1

    def build(d, w):
        f = w.rowsBetween(-10, -1)
        side = F.when(F.col("close") > F.max("high").over(f), 1).when(F.col("close") < F.min("low").over(f), -1)
        return d.withColumns({"side": side, "fwd": F.lead("close", 8).over(w) / F.nullif(F.col("close"), F.lit(0.0)) - 1})

    d = sr.windowed(bars, sr.BARS, build, back=10, ahead=8).where("side IS NOT NULL AND fwd IS NOT NULL")
    p = F.col("side") * F.col("fwd")
    win = d.groupBy("instrument", F.when(F.col("side") > 0, "long").otherwise("short").alias("strategy"), F.weekofyear("ts").alias("win")).agg(
        F.sum(p).alias("net_pnl"), (F.sum(F.greatest(p, F.lit(0.0))) / F.nullif(F.sum(F.greatest(-p, F.lit(0.0))), F.lit(0.0))).alias("profit_factor"), F.count(F.lit(1)).alias("trades"), F.max(-p).alias("max_drawdown"))
    corr = align.pair_correlations(align.wide_by_instrument(align.returns(bars), "ret", INSTRUMENTS), INSTRUMENTS)
    return ev.shortlist(ev.stability_score(win, ["instrument", "strategy"]), corr, 0.0, 1, 0.05)


@query("e38_parameter_grid", "lookback:i min_move:r split trades:i mean_ret:r win_rate:r", """SELECT lookback, min_move, split, count(*) AS trades, avg(ret) AS mean_ret, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END) AS win_rate FROM (SELECT n AS lookback, m AS min_move, CASE WHEN ts < TIMESTAMP '2024-01-21' THEN 'train' ELSE 'test' END AS split,
   fwd * CASE WHEN close > hi * (1 + m) THEN 1 WHEN close < lo * (1 - m) THEN -1 END AS ret FROM (SELECT b.instrument, b.ts, b.close, b.fwd, g.n, max(p.high) AS hi, min(p.low) AS lo FROM nb b CROSS JOIN (VALUES (10), (20), (40)) g(n) JOIN nb p ON p.instrument = b.instrument AND p.rn BETWEEN b.rn - g.n AND b.rn - 1 GROUP BY ALL HAVING count(*) = g.n)
   CROSS JOIN (VALUES (0.0), (0.05)) mm(m)) WHERE ret IS NOT NULL GROUP BY 1, 2, 3""", nb=f"SELECT *, row_number() OVER ({OVER}) AS rn, lead(close, 8) OVER ({OVER}) / nullif(close, 0) - 1 AS fwd FROM bars_h1")
def _(t):
    split = F.when(F.col("ts") < F.lit("2024-01-21 00:00:00").cast("timestamp_ntz"), "train").otherwise("test")
    return ev.grid_evaluation(t.bars_h1, (10, 20, 40), (0.0, 0.05), 8, split, sr.BARS)


_YC = {"yc0": "SELECT *, year(ts) AS y, 10000000.0 + sum(pnl) OVER (PARTITION BY instrument, year(ts) ORDER BY ts, exit_seq, entry_seq ROWS UNBOUNDED PRECEDING) AS eq FROM trades",
       "yc1": "SELECT *, greatest(10000000.0, max(eq) OVER (PARTITION BY instrument, y ORDER BY ts, exit_seq, entry_seq ROWS UNBOUNDED PRECEDING)) AS pk FROM yc0",
       "yc2": "SELECT instrument, y, count(*) AS trades, sum(pnl) AS net_pnl, avg(pnl) AS expectancy, max((pk - eq) / pk) AS max_drawdown, avg(pnl) / stddev_samp(pnl) * sqrt(count(*)) AS sharpe FROM yc1 GROUP BY 1, 2"}


def yearly(t):
    s = sr.Series(keys=("instrument", "y"), order=("ts", "exit_seq", "entry_seq"), slice_seconds=86400)
    c = tr.equity_curve(t.trades.withColumn("y", F.year("ts")), 10000000.0, s)
    return c.groupBy("instrument", "y").agg(F.count(F.lit(1)).alias("trades"), F.sum("pnl").alias("net_pnl"), F.avg("pnl").alias("expectancy"), F.max("drawdown").alias("max_drawdown"),
                                           (F.avg("pnl") / F.stddev_samp("pnl") * F.sqrt(F.count(F.lit(1)).cast("double"))).alias("sharpe"))


@query("e39_promotion_gate", "instrument:i y:i trades:i net_pnl:r2 max_drawdown:r status", "SELECT instrument, y, trades, net_pnl, max_drawdown, CASE WHEN net_pnl > 0 AND max_drawdown <= 0.2 AND trades >= 50 AND sharpe > 0 THEN 'PASS' ELSE 'REJECT' END AS status FROM yc2", **_YC)
def _(t):
    return ev.promotion_gate(yearly(t))


# Yearly limits (tested, profitable, ratio, median expectancy, worst drawdown).
LIMITS = {0: (3, 2, 0.45, 0.0, 0.10), 1: (5, 3, 0.55, 0.0, 0.10), 2: (3, 2, 0.45, 0.0, 0.18), 3: (5, 2, 0.25, -0.0007, 0.10)}
LIMITS |= {k: LIMITS[0] for k in range(4, 9)}  # the tenth instrument has none, and is told so
_LIM = ", ".join(f"({k}, {', '.join(map(str, v))})" for k, v in LIMITS.items())


@query("e40_yearly_gate", "symbol:i tested_years:i profitable_years:i profit_ratio:r median_expectancy:r3 worst_drawdown:r passed status", f"""SELECT symbol, ty AS tested_years, py AS profitable_years, py / ty AS profit_ratio, me AS median_expectancy, wd AS worst_drawdown, coalesce(ty >= a AND py >= b AND py / ty >= c AND me >= d AND wd <= e, false) AS passed, CASE WHEN a IS NULL THEN 'no limits' WHEN passed THEN 'passed' ELSE 'failed' END AS status FROM (
   SELECT instrument AS symbol, count(*) AS ty, count(*) FILTER (net_pnl > 0) AS py, quantile_cont(expectancy, 0.5) AS me, max(max_drawdown) AS wd FROM yc2 GROUP BY 1) LEFT JOIN (VALUES {_LIM}) l(symbol, a, b, c, d, e) USING (symbol)""", **_YC)
def _(t):
    lim = t.spark.createDataFrame([(k, *v) for k, v in LIMITS.items()], "symbol bigint, min_tested int, min_profitable int, min_ratio double, min_median double, max_worst_dd double")
    return ev.yearly_gate(yearly(t).withColumnRenamed("instrument", "symbol"), lim)


@query("e41_champion_challenger", "symbol role row_no:i price:r2", "SELECT o_orderpriority AS symbol, CASE o_orderstatus WHEN 'F' THEN 'champion' ELSE 'challenger' END AS role, min(o_orderkey) AS row_no, arg_min(o_totalprice, o_orderkey) AS price FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1, 2")
def _(t):
    role = F.when(F.col("o_orderstatus") == "F", "champion").when(F.col("o_orderstatus") == "O", "challenger").otherwise("retired")
    return ev.pick_by_role(t.orders.select(F.col("o_orderpriority").alias("symbol"), role.alias("role"), F.col("o_orderkey").alias("row_no"), F.col("o_totalprice").alias("price")))


@view("scorecard", """SELECT o_orderkey AS file_no, strftime(o_orderdate, '%Y-%m') AS review_week, o_orderpriority || '-' || (o_custkey % 7) AS strategy_name, o_orderkey % 50 AS trades, o_totalprice - 150000 AS net_pnl, (o_custkey % 100) / 100.0 AS win_rate,
   (o_custkey % 30) / 10.0 AS avg_slippage_pips, CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE (o_orderkey % 5) * 1.0 END AS order_rejection_rate_pct, (o_orderkey % 13) * 1.0 AS max_drawdown_pct, CASE WHEN o_orderstatus = 'P' THEN ' ' ELSE o_orderstatus END AS decision FROM orders""")
def scorecard(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return t.orders.select(
        k.alias("file_no"), F.date_format("o_orderdate", "yyyy-MM").alias("review_week"), F.concat("o_orderpriority", F.lit("-"), (c % 7).cast("string")).alias("strategy_name"), (k % 50).alias("trades"),
        (F.col("o_totalprice") - 150000).alias("net_pnl"), (c % 100 / 100).alias("win_rate"), (c % 30 / 10).alias("avg_slippage_pips"), F.when(c % 9 != 0, (k % 5).cast("double")).alias("order_rejection_rate_pct"),
        (k % 13).cast("double").alias("max_drawdown_pct"), F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.col("o_orderstatus")).alias("decision"))


@query("e42_weekly_scorecard", "review_week strategy_count:i total_trades:i total_net_pnl:r2 expectancy_per_trade:r weighted_win_rate:r weighted_slippage_pips:r weighted_rejection_rate_pct:r max_drawdown_pct:r", """SELECT review_week, count(DISTINCT strategy_name) AS strategy_count, sum(trades) AS total_trades, sum(net_pnl) AS total_net_pnl, coalesce(sum(net_pnl) / nullif(sum(trades), 0), 0) AS expectancy_per_trade,
   coalesce(sum(win_rate * trades) / nullif(sum(trades), 0), 0) AS weighted_win_rate, coalesce(sum(avg_slippage_pips * trades) / nullif(sum(trades), 0), 0) AS weighted_slippage_pips, coalesce(sum(coalesce(order_rejection_rate_pct, 0) * trades) / nullif(sum(trades), 0), 0) AS weighted_rejection_rate_pct, max(max_drawdown_pct) AS max_drawdown_pct FROM scorecard GROUP BY 1""")
def _(t):
    return ev.weekly_scorecard(t.scorecard)


@query("e43_latest_by_strategy", "strategy_name review_week file_no:i net_pnl:r2", "SELECT strategy_name, max(review_week) AS review_week, arg_max(file_no, (review_week, -file_no)) AS file_no, arg_max(net_pnl, (review_week, -file_no)) AS net_pnl FROM scorecard GROUP BY 1")
def _(t):
    return ev.latest_by_strategy(t.scorecard, "file_no")


@query("e43_decision_mix", "decision n:i", "SELECT CASE WHEN trim(decision) = '' THEN 'unknown' ELSE decision END AS decision, count(*) AS n FROM scorecard GROUP BY 1")
def _(t):
    return ev.decision_mix(t.scorecard)


@query("e44_shadow_snapshot", "last_ts rows_ok:i rows_profitable:i weighted_expectancy:r worst_max_dd:r", """SELECT max(l_shipdate) AS last_ts, count(*) AS rows_ok, count(*) FILTER (l_discount - 0.05 > 0 AND l_tax * 25 > 1) AS rows_profitable, sum((l_discount - 0.05) * l_quantity) / greatest(1, sum(l_quantity)) AS weighted_expectancy, max(l_tax) AS worst_max_dd
   FROM lineitem WHERE l_shipdate = (SELECT max(l_shipdate) FROM lineitem) AND l_linestatus = 'O'""")
def _(t):
    rows = t.lineitem.select(F.col("l_shipdate").alias("ts"), F.when(F.col("l_linestatus") == "O", "ok").otherwise("skip").alias("status"), F.col("l_quantity").alias("trades"), (F.col("l_discount") - 0.05).alias("expectancy"), (F.col("l_tax") * 25).alias("profit_factor"), F.col("l_tax").alias("max_dd"))
    return ev.shadow_snapshot(rows)


@query("e45_execution_event_class", "cls n:i", """SELECT CASE WHEN k % 4 = 0 THEN 'ORDER PLACED + ORDER CLOSED' WHEN k % 4 = 1 THEN 'ORDER PLACED' WHEN k % 4 = 2 THEN 'ORDER CLOSED' ELSE 'ORDER FILLED' END AS cls, count(*) AS n FROM (SELECT volume AS k FROM ticks) GROUP BY 1""")
def _(t):
    k = F.col("volume") % 4
    leg = F.struct(F.col("event_id").cast("string").alias("tradeID"))
    payload = F.to_json(F.struct(F.when(k <= 1, leg).alias("tradeOpened"), F.when(k % 2 == 0, F.array(leg)).alias("tradesClosed")))
    payload = F.when(k == 2, F.to_json(F.struct(leg.alias("tradeReduced")))).otherwise(payload)
    return t.ticks.select(ev.execution_event_class(payload).alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
