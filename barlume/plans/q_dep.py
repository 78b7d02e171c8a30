"""Dependence and portfolio-control queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlume.operators import dependence as dp, series as sr
from barlume.plans.q_eval import DAYS, SLEEVES, _WIDE, wide_pnl
from barlume.plans.registry import query, view

PAIRS = [(a, b) for i, a in enumerate(SLEEVES) for b in SLEEVES[i + 1:]]

_SW = "SELECT l_shipdate AS day, " + ", ".join(f"avg(score) FILTER (l_suppkey % 4 = {i}) AS s{i}" for i in range(4)) + ", avg(y_true) AS outcome FROM (SELECT *, ts AS l_shipdate FROM scores) GROUP BY 1"


@view("sleeve_scores", _SW)
def sleeve_scores(t):
    """Mean daily score per sleeve (NULL on days without one)."""
    d = t.scores.groupBy(F.col("ts").alias("day")).agg(*[F.avg(F.when(F.col("l_suppkey") % 4 == i, F.col("score"))).alias(f"s{i}") for i in range(4)], F.avg("y_true").alias("outcome"))
    return sr.materialise(d)


def rank_of(x: str, part: str) -> str:
    return f"rank() OVER (PARTITION BY {part} ORDER BY {x}) + (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0"


def pair_sql(src: str, names=SLEEVES) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {a} AS xa, {b} AS xb FROM {src} WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in PAIRS)


# averages of equal scores may differ in the last bit, so both sides round first
_RSC = "SELECT day, " + ", ".join(f"round({c}, 9) AS {c}" for c in SLEEVES) + ", round(outcome, 9) AS outcome FROM sleeve_scores"


def rounded_scores(t):
    return t.sleeve_scores.select("day", *[F.round(c, 9).alias(c) for c in (*SLEEVES, "outcome")])


@query("e14_signal_dependence", "a b pearson:r spearman:r high_conf_corr:r n:i n_high_conf:i", f"""SELECT p.a, p.b, corr(xa, xb) AS pearson, corr(ra, rb) AS spearman, corr(xa, xb) FILTER (xa >= qa OR xb >= qb) AS high_conf_corr, count(*) AS n, count(*) FILTER (xa >= qa OR xb >= qb) AS n_high_conf FROM (SELECT *, {rank_of('xa', 'a, b')} AS ra, {rank_of('xb', 'a, b')} AS rb FROM pr) p
   JOIN (SELECT a, b, quantile_cont(xa, 0.8) AS qa, quantile_cont(xb, 0.8) AS qb FROM pr GROUP BY 1, 2) c ON c.a = p.a AND c.b = p.b GROUP BY 1, 2""", rsc=_RSC, pr=pair_sql("rsc"))
def _(t):
    return dp.signal_dependence(rounded_scores(t), SLEEVES)


_TRG = "SELECT day, " + ", ".join(f"CASE WHEN {c} > 0.05 THEN 1 WHEN {c} < -0.05 THEN -1 WHEN {c} IS NOT NULL THEN 0 END AS {c}, CASE WHEN abs({c}) > 0.2 THEN 1 ELSE 0 END AS h{c}" for c in SLEEVES) + " FROM rsc"


def triggers(t):
    d = rounded_scores(t)
    return d.select("day", *[F.when(F.col(c) > 0.05, 1).when(F.col(c) < -0.05, -1).when(F.col(c).isNotNull(), 0).alias(c) for c in SLEEVES], *[F.when(F.abs(c) > 0.2, 1).otherwise(0).alias(f"h{c}") for c in SLEEVES])


@query("e15_trigger_overlap", "a b jaccard:r overlap_count:i union_count:i high_conf_jaccard:r high_conf_overlap_count:i", " UNION ALL ".join(
    f"""SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER (coalesce({a}, 0) <> 0 AND coalesce({b}, 0) <> 0) / count(*) FILTER (coalesce({a}, 0) <> 0 OR coalesce({b}, 0) <> 0) AS jaccard, count(*) FILTER (coalesce({a}, 0) <> 0 AND coalesce({b}, 0) <> 0) AS overlap_count, count(*) FILTER (coalesce({a}, 0) <> 0 OR coalesce({b}, 0) <> 0) AS union_count,
    count(*) FILTER (h{a} = 1 AND h{b} = 1) / nullif(count(*) FILTER (h{a} = 1 OR h{b} = 1), 0) AS high_conf_jaccard, count(*) FILTER (h{a} = 1 AND h{b} = 1) AS high_conf_overlap_count FROM trg""" for a, b in PAIRS), rsc=_RSC, trg=_TRG)
def _(t):
    return dp.trigger_overlap(triggers(t), SLEEVES, [f"h{c}" for c in SLEEVES])


_RES = "SELECT day, " + ", ".join(f"round(outcome - {c}, 9) AS {c}" for c in SLEEVES) + " FROM rsc"


@query("e16_residual_correlation", "a b pearson:r spearman:r", f"SELECT a, b, corr(xa, xb) AS pearson, corr(ra, rb) AS spearman FROM (SELECT *, {rank_of('xa', 'a, b')} AS ra, {rank_of('xb', 'a, b')} AS rb FROM pr) GROUP BY 1, 2", rsc=_RSC, res=_RES, pr=pair_sql("res"))
def _(t):
    d = rounded_scores(t)
    d = d.select("day", "outcome", *[(F.col("outcome") - F.round(F.col("outcome") - F.col(c), 9)).alias(c) for c in SLEEVES])
    return dp.residual_dependence(d, SLEEVES, "outcome")


_RW = "SELECT day, " + ", ".join(f"round(s{i}, 4) AS s{i}" for i in range(4)) + " FROM wd"
_ROLL = "SELECT day, " + ", ".join(f"CASE WHEN count({c}) OVER (ORDER BY day ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) >= {n} THEN sum({c}) OVER (ORDER BY day ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END AS {c}_{n}" for c in SLEEVES for n in (20, 60)) + " FROM rw"


@query("e17_pnl_dependence", "a b trade_pearson:r trade_spearman:r daily_pearson:r daily_spearman:r rolling_20:r rolling_60:r", f"""SELECT p.a, p.b, pe AS trade_pearson, sp AS trade_spearman, pe AS daily_pearson, sp AS daily_spearman, r20 AS rolling_20, r60 AS rolling_60 FROM (SELECT a, b, corr(xa, xb) AS pe, corr(ra, rb) AS sp FROM (SELECT *, {rank_of('xa', 'a, b')} AS ra, {rank_of('xb', 'a, b')} AS rb FROM pr) GROUP BY 1, 2) p JOIN (
   {' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}_20, {b}_20) AS r20, corr({a}_60, {b}_60) AS r60 FROM rl" for a, b in PAIRS)}) r ON r.a = p.a AND r.b = p.b""", wd=_WIDE, rw=_RW, rl=_ROLL, pr=pair_sql("rw"))
def _(t):
    wide = sr.materialise(wide_pnl(t).select("day", *[F.round(c, 4).alias(c) for c in SLEEVES]))
    return dp.pnl_dependence(wide, SLEEVES, DAYS)


_TL = {
    "lp": "SELECT day, sleeve, round(pnl, 4) AS pnl FROM sleeve_pnl",
    "t0": "SELECT *, sum(pnl) OVER (PARTITION BY sleeve ORDER BY day ROWS UNBOUNDED PRECEDING) AS eq FROM lp",
    "t1": "SELECT t0.*, round(eq - max(eq) OVER (PARTITION BY t0.sleeve ORDER BY day ROWS UNBOUNDED PRECEDING), 3) < 0 AS wet, pnl <= q AS tail FROM t0 JOIN (SELECT sleeve, quantile_cont(pnl, 0.1) AS q FROM lp GROUP BY 1) c ON c.sleeve = t0.sleeve",
    "t2": "SELECT *, wet AND NOT coalesce(lag(wet) OVER (PARTITION BY sleeve ORDER BY day), false) AS st, wet AND NOT coalesce(lead(wet) OVER (PARTITION BY sleeve ORDER BY day), false) AS en FROM t1",
}


@query("e18_tail_dependence", "a:i b:i worst_decile_freq:r drawdown_overlap:r start_coincidence:r end_coincidence:r", """SELECT x.sleeve AS a, y.sleeve AS b, count(*) FILTER (x.tail AND y.tail) / count(*) FILTER (x.tail OR y.tail) AS worst_decile_freq, count(*) FILTER (x.wet AND y.wet) / count(*) FILTER (x.wet OR y.wet) AS drawdown_overlap,
   count(*) FILTER (x.st AND y.st) / greatest(1, count(*) FILTER (x.st OR y.st)) AS start_coincidence, count(*) FILTER (x.en AND y.en) / greatest(1, count(*) FILTER (x.en OR y.en)) AS end_coincidence FROM t2 x JOIN t2 y ON x.day = y.day AND x.sleeve < y.sleeve GROUP BY 1, 2""", **_TL)
def _(t):
    return dp.tail_dependence(t.sleeve_table.withColumn("pnl", F.round("pnl", 4)), [0, 1, 2, 3], DAYS)


_AD = {
    "wd": _WIDE,
    "ad0": "SELECT day, s0 + s1 AS b, s0 + s1 + s2 - 10 * CASE WHEN abs(s2) > 1000 THEN 1 ELSE 0 END AS c, abs(s2) > 1000 AS onn, abs(s0) > 500 AS bon FROM wd",
    "ad1": "SELECT *, sum(b) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS eb, sum(c) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS ec FROM ad0",
    "ad2": "SELECT *, eb - max(eb) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS db, ec - max(ec) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS dc FROM ad1",
}


@query("e19_sleeve_additivity", "marginal_expectancy:r3 marginal_drawdown:r2 unique_trade_share:r marginal_utility:r3 improves_utility survives_frozen", """SELECT avg(c) - avg(b) AS marginal_expectancy, min(dc) - min(db) AS marginal_drawdown, count(*) FILTER (onn AND NOT bon) / greatest(1, count(*) FILTER (onn)) AS unique_trade_share,
   avg(c) - 0.5 * stddev_pop(c) - avg(b) + 0.5 * stddev_pop(b) AS marginal_utility, avg(c) - 0.5 * stddev_pop(c) > avg(b) - 0.5 * stddev_pop(b) AS improves_utility, avg(c) - 0.5 * stddev_pop(c) > avg(b) - 0.5 * stddev_pop(b) AS survives_frozen FROM ad2""", **_AD)
def _(t):
    d = wide_pnl(t).select("day", (F.col("s0") + F.col("s1")).alias("base_pnl"), (F.abs("s0") > 500).cast("int").alias("base_signal"), F.col("s2").alias("cand_pnl"), (F.abs("s2") > 1000).cast("int").alias("cand_signal"))
    return dp.additivity(d, DAYS, cost=10.0)


_MX = """SELECT a, b, abs(m) AS score_corr, abs(m) * 3 AS trigger_overlap, m AS pnl_corr, abs(m) * 2 AS coloss_freq FROM (SELECT a, b, round(corr(xa, xb), 6) AS m FROM pr GROUP BY 1, 2)"""


def metric_pairs(t):
    p = dp.pair_rows(rounded_scores(t), SLEEVES).groupBy("a", "b").agg(F.round(dp.safe_corr("xa", "xb"), 6).alias("m"))
    return p.select("a", "b", F.abs("m").alias("score_corr"), (F.abs("m") * 3).alias("trigger_overlap"), F.col("m").alias("pnl_corr"), (F.abs("m") * 2).alias("coloss_freq"))


@query("e20_redundancy_flags", "sleeve is_redundant reasons", """SELECT sleeve, len(r) > 0 AS is_redundant, array_to_string(list_sort(r), ';') AS reasons FROM (SELECT s.sleeve, list_filter(flatten(list([CASE WHEN score_corr >= 0.02 THEN 'high_score_corr_vs_' || o END, CASE WHEN trigger_overlap >= 0.05 THEN 'high_trigger_overlap_vs_' || o END,
   CASE WHEN abs(pnl_corr) >= 0.03 THEN 'high_pnl_corr_vs_' || o END, CASE WHEN coloss_freq >= 0.04 THEN 'high_coloss_vs_' || o END])) || [CASE WHEN any_value(u) <= 0 THEN 'non_positive_marginal_utility' END, CASE WHEN any_value(q) <= 0.05 THEN 'low_unique_trade_share' END], lambda e: e IS NOT NULL) AS r
   FROM (VALUES ('s0', 0.5, 0.2), ('s1', -0.1, 0.3), ('s2', 0.2, 0.01), ('s3', 0.1, 0.5)) s(sleeve, u, q) JOIN (SELECT a AS sleeve, b AS o, * FROM mx UNION ALL SELECT b, a, * FROM mx) x ON x.sleeve = s.sleeve GROUP BY 1)""", rsc=_RSC, pr=pair_sql("rsc"), mx=_MX)
def _(t):
    added = t.spark.createDataFrame([("s0", 0.5, 0.2), ("s1", -0.1, 0.3), ("s2", 0.2, 0.01), ("s3", 0.1, 0.5)], "sleeve string, marginal_utility double, unique_trade_share double")
    pairs = metric_pairs(t).select("a", "b", F.col("score_corr").alias("pearson"), F.col("trigger_overlap").alias("jaccard"), F.col("pnl_corr").alias("trade_pearson"), F.col("coloss_freq").alias("worst_decile_freq"))
    return dp.redundancy_flags(pairs, added, {"score_corr": 0.02, "overlap": 0.05, "pnl_corr": 0.03, "coloss": 0.04, "utility": 0.0, "unique": 0.05})


@query("e23_dependence_drift", "mean_abs_delta:r max_abs_delta:r", f"""SELECT sum(2 * abs(c - r)) / 16 AS mean_abs_delta, max(abs(c - r)) AS max_abs_delta FROM (
   {' UNION ALL '.join(f"SELECT corr({a}, {b}) FILTER (year(day) < 1999) AS r, corr({a}, {b}) FILTER (year(day) >= 1999) AS c FROM wd" for a, b in PAIRS)})""", wd=_WIDE)
def _(t):
    w = wide_pnl(t).withColumn("_ref", F.year("day") < 1999)
    p = dp.pair_rows(w, SLEEVES, ["_ref"])
    g = p.groupBy("a", "b").agg(F.corr(F.when(F.col("_ref"), F.col("xa")), F.when(F.col("_ref"), F.col("xb"))).alias("r"), F.corr(F.when(~F.col("_ref"), F.col("xa")), F.when(~F.col("_ref"), F.col("xb"))).alias("c"))
    d = F.abs(F.col("c") - F.col("r"))
    # full matrix: both triangles and a zero diagonal
    return g.agg((F.sum(2 * d) / (len(SLEEVES) ** 2)).alias("mean_abs_delta"), F.max(d).alias("max_abs_delta"))


@query("e24_redundancy_alerts", "a b score_corr:r", "SELECT a, b, score_corr FROM mx WHERE score_corr >= 0.02", rsc=_RSC, pr=pair_sql("rsc"), mx=_MX)
def _(t):
    return dp.redundancy_alerts(metric_pairs(t), 0.02)


_PEN = "SELECT sleeve, sum(p) AS penalty FROM (SELECT a AS sleeve, score_corr + trigger_overlap + abs(pnl_corr) + coloss_freq AS p FROM mx UNION ALL SELECT b, score_corr + trigger_overlap + abs(pnl_corr) + coloss_freq FROM mx) GROUP BY 1"


@query("e25_dependence_penalty", "sleeve penalty:r", _PEN, rsc=_RSC, pr=pair_sql("rsc"), mx=_MX)
def _(t):
    return dp.sleeve_penalty(metric_pairs(t))


_CAND = """SELECT day AS ts, sleeve, CASE WHEN x > 0.02 THEN 1 WHEN x < -0.02 THEN -1 ELSE 0 END AS signal, round(1 / (1 + exp(-x)) * 0.02 - 0.0095, 9) AS expected_utility, CASE sleeve WHEN 's0' THEN 0.24 WHEN 's1' THEN 0.25 WHEN 's2' THEN NULL ELSE 0.23 END AS recent_brier,
   CASE WHEN sleeve IN ('s0', 's1') THEN 'east' ELSE 'west' END AS cluster FROM rsc UNPIVOT (x FOR sleeve IN (s0, s1, s2, s3))"""


def candidates(t):
    d = rounded_scores(t).selectExpr("day AS ts", "stack(4, 's0', s0, 's1', s1, 's2', s2, 's3', s3) AS (sleeve, x)").where("x IS NOT NULL")
    x, s = F.col("x"), F.col("sleeve")
    u = dp.expected_utility(1 / (1 + F.exp(-x)), F.lit(0.02), F.lit(0.0095))
    return d.select("ts", "sleeve", F.when(x > 0.02, 1).when(x < -0.02, -1).otherwise(0).alias("signal"), F.round(u, 9).alias("expected_utility"),
                    F.when(s == "s0", 0.24).when(s == "s1", 0.25).when(s == "s3", 0.23).alias("recent_brier"), F.when(s.isin("s0", "s1"), "east").otherwise("west").alias("cluster"))


@query("e26_expected_utility", "ts sleeve expected_utility:r", "SELECT ts, sleeve, expected_utility FROM cand", rsc=_RSC, cand=_CAND)
def _(t):
    return candidates(t)


def suppressed(t):
    pairs = dp.pair_penalty(metric_pairs(t)).select("a", "b", "pair_penalty")
    return dp.suppress_redundant(candidates(t), pairs, limit=0.1)


# the pairs at or over the limit are gone through one by one, each time's list of live sleeves getting shorter
_SUP = {
    "rsc": _RSC, "cand": _CAND, "pr": pair_sql("rsc"), "mx": _MX,
    "sup_on": "SELECT ts, sleeve, expected_utility AS u, coalesce(recent_brier, 1e300) AS c FROM cand WHERE signal <> 0",
    "sup_pairs": "SELECT a, b, abs(score_corr) + trigger_overlap + abs(pnl_corr) + coloss_freq AS p FROM mx",
    "sup_pen": "SELECT o.ts, o.sleeve, any_value(o.u) AS u, any_value(o.c) AS c, coalesce(sum(p), 0) AS pen FROM sup_on o LEFT JOIN sup_on q ON q.ts = o.ts AND q.sleeve <> o.sleeve LEFT JOIN sup_pairs ON a = least(o.sleeve, q.sleeve) AND b = greatest(o.sleeve, q.sleeve) GROUP BY 1, 2",
    "sup_rank": "SELECT ts, sleeve, pen, row_number() OVER (PARTITION BY ts ORDER BY u DESC, c, pen, sleeve DESC) AS rk FROM sup_pen",
    "sup_steps": "SELECT row_number() OVER (ORDER BY a, b) AS k, a, b FROM sup_pairs WHERE p >= 0.1",
    "sup_walk": """SELECT ts, CAST(0 AS BIGINT) AS k, list(sleeve) AS live FROM sup_on GROUP BY ts
      UNION ALL SELECT w.ts, s.k, CASE WHEN list_contains(live, a) AND list_contains(live, b) THEN list_filter(live, lambda e: e <> CASE WHEN x.rk < y.rk THEN b ELSE a END) ELSE live END
      FROM sup_walk w JOIN sup_steps s ON s.k = w.k + 1 LEFT JOIN sup_rank x ON x.ts = w.ts AND x.sleeve = a LEFT JOIN sup_rank y ON y.ts = w.ts AND y.sleeve = b""",
}


@query("e27_redundancy_suppression", "ts sleeve signal:i suppressed dependence_penalty:r", """SELECT c.ts, c.sleeve, CASE WHEN off THEN 0 ELSE signal END AS signal, off AS suppressed, dependence_penalty FROM (SELECT d.ts, d.sleeve, signal, signal <> 0 AND NOT list_contains(live, d.sleeve) AS off, coalesce(pen, 0) AS dependence_penalty
   FROM cand d LEFT JOIN sup_rank r ON r.ts = d.ts AND r.sleeve = d.sleeve LEFT JOIN (SELECT * FROM sup_walk WHERE k = (SELECT count(*) FROM sup_steps)) f ON f.ts = d.ts) c""", **_SUP)
def _(t):
    return suppressed(t)


_AL = {
    "rsc": _RSC, "cand": _CAND,
    "al0": "SELECT *, signal <> 0 AS onn, CASE WHEN signal <> 0 THEN row_number() OVER (PARTITION BY ts, signal <> 0 ORDER BY expected_utility DESC, sleeve) END AS rk FROM cand",
    "al1": "SELECT *, coalesce(rk <= 3, false) AS inn, CASE WHEN coalesce(rk <= 3, false) THEN greatest(expected_utility, 0) ELSE 0 END AS u FROM al0",
    "al2": "SELECT *, CASE WHEN inn THEN least(0.3, CASE WHEN sum(u) OVER (PARTITION BY ts) > 0 THEN u / sum(u) OVER (PARTITION BY ts) ELSE 1 / count(*) FILTER (inn) OVER (PARTITION BY ts) END * (1 - (0.1 - 0.08) / (0.15 - 0.08))) ELSE 0 END AS r FROM al1",
    "al3": "SELECT *, CASE WHEN sum(r) OVER (PARTITION BY ts, cluster) > 0.5 THEN r * 0.5 / sum(r) OVER (PARTITION BY ts, cluster) ELSE r END AS risk_alloc FROM al2",
}


def allocations(t):
    return dp.allocate_risk(candidates(t).withColumn("suppressed", F.lit(False)), dd=0.1)


@query("e28_risk_allocation", "ts sleeve risk_alloc:r", "SELECT * FROM al3", **_AL)
def _(t):
    return allocations(t)


_FA = """SELECT ts, CASE WHEN net > 0 THEN 'LONG' WHEN net < 0 THEN 'SHORT' ELSE 'NO_TRADE' END AS action, CASE WHEN net <> 0 THEN sz ELSE 0 END AS size, selected FROM (SELECT ts, round(coalesce(sum(risk_alloc * signal) FILTER (signal <> 0 AND risk_alloc > 0), 0), 9) AS net, coalesce(sum(risk_alloc) FILTER (signal <> 0 AND risk_alloc > 0), 0) AS sz, count(*) FILTER (signal <> 0 AND risk_alloc > 0) AS selected FROM al3 GROUP BY ts)"""


def rounded_alloc(t):
    return allocations(t).withColumn("risk_alloc", F.round("risk_alloc", 12))


@query("e29_final_action", "ts action size:r selected:i", _FA.replace("FROM al3", "FROM (SELECT * REPLACE (round(risk_alloc, 12) AS risk_alloc) FROM al3)"), **_AL)
def _(t):
    return dp.final_action(rounded_alloc(t))


@query("e30_abstain_reason", "fold:i session abstain_reason", """SELECT fold, session, CASE WHEN max(act) = 'NO_TRADE' THEN CASE WHEN NOT bool_or(tr) THEN 'tradability_block' WHEN bool_or(cand AND mp < 0.55) THEN 'meta_edge_block' WHEN bool_or(side) THEN 'side_disabled' WHEN bool_or(cand AND mp >= 0.55 AND NOT side) THEN 'cost_threshold_block' ELSE 'no_candidate' END ELSE '' END AS abstain_reason FROM (
   SELECT fold, l_suppkey || session AS session, CASE WHEN l_suppkey % 3 = 0 THEN 'LONG' ELSE 'NO_TRADE' END AS act, l_suppkey % 7 <> 1 AS tr, quantity > 40 AND prob < 0.6 AS cand, 0.3 + quantity / 120 AS mp, quantity > 40 AND l_suppkey % 5 = 0 AS side FROM scores) GROUP BY 1, 2""")
def _(t):
    k, qn = F.col("l_suppkey"), F.col("quantity")
    d = t.scores.select(
        "fold", F.concat(k.cast("string"), F.col("session")).alias("session"), F.when(k % 3 == 0, "LONG").otherwise("NO_TRADE").alias("action"), (k % 7 != 1).alias("tradable"),
        F.when(qn > 40, 1).otherwise(0).alias("raw_signal"), F.when((qn > 40) & (F.col("prob") < 0.6), 0).when(qn > 40, 1).otherwise(0).alias("signal"), (0.3 + qn / 120).alias("meta_prob"), (k % 5 != 0).alias("long_enabled"), F.lit(True).alias("short_enabled"))
    return dp.abstain_reason(d, ["fold", "session"])
