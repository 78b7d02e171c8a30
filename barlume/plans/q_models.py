"""Split, scaler, model, calibration and threshold queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlume.operators import features as fe, labels as lb, models as md, rules as ru, series as sr, splits as sp
from barlume.plans import sqltext as q
from barlume.plans.q_labels import opportunity
from barlume.plans.registry import query, view

lag, OVER, roll = q.lag, q.OVER, q.roll


@view("score_rows", "SELECT *, spread_proxy * 10 + quantity / 100 AS spread_atr FROM scores")
def score_rows(t):
    """Scores joined once; later passes read the written table."""
    return sr.materialise(t.scores.withColumn("spread_atr", F.col("spread_proxy") * 10 + F.col("quantity") / 100))


_SPAN = "SELECT CAST(date_trunc('month', min(l_shipdate)) AS TIMESTAMP) AS s, max(l_shipdate) AS e FROM lineitem"
_WIN = """SELECT fold, s + to_months(CAST(fold AS INTEGER)) AS train_start, s + to_months(CAST(fold + 18 AS INTEGER)) AS val_start, s + to_months(CAST(fold + 20 AS INTEGER)) AS test_start, s + to_months(CAST(fold + 22 AS INTEGER)) AS test_end FROM span, range(0, 200) r(fold)
  WHERE s + to_months(CAST(fold + 22 AS INTEGER)) <= e"""


def month_bounds(t):
    return t.lineitem.agg(F.trunc(F.min("l_shipdate"), "month").cast("timestamp_ntz").alias("start"), F.max("l_shipdate").alias("end"))


@query("m01_month_windows", "fold:i step_id train_start val_start test_start test_end", "SELECT *, 'step_' || lpad(CAST(fold AS VARCHAR), 3, '0') || '_' || strftime(train_start, '%Y%m%d') AS step_id FROM win", span=_SPAN, win=_WIN)
def _(t):
    return sp.month_windows(t.spark, month_bounds(t))


@query("j13_fold_membership", "fold:i split n:i notional:r1", """SELECT fold, split, count(*) AS n, sum(l_extendedprice) AS notional FROM lineitem JOIN (SELECT fold, 'train' AS split, train_start AS lo, val_start - INTERVAL '2 hours' AS hi FROM win
   UNION ALL SELECT fold, 'val', val_start, test_start - INTERVAL '2 hours' FROM win UNION ALL SELECT fold, 'test', test_start, test_end - INTERVAL '2 hours' FROM win) p ON l_shipdate >= lo AND l_shipdate < hi GROUP BY 1, 2""", span=_SPAN, win=_WIN)
def _(t):
    w = sp.month_windows(t.spark, month_bounds(t))
    m = sp.fold_membership(t.lineitem.select("l_shipdate", "l_extendedprice"), w, 7200, ts="l_shipdate")
    return m.groupBy("fold", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("l_extendedprice").alias("notional"))


_EXP = """SELECT *, greatest(floor(n * 0.7), 200) AS b FROM (SELECT instrument, count(*) AS n FROM bars_h1 GROUP BY 1)"""


@query("m02_expanding_windows", "instrument fold:i train_to:i test_from:i test_to:i", """SELECT instrument, fold, b + fold * len - 1 AS train_to, b + fold * len AS test_from, least(n - 1, b + fold * len + len - 1) AS test_to FROM (SELECT *, greatest(50, floor((n - b) / 3)) AS len FROM ew WHERE n > b), range(0, 3) r(fold)
   WHERE least(n - 1, b + fold * len + len - 1) > b + fold * len AND (fold = 0 OR b + fold * len - 1 < n - 2)""", ew=_EXP)
def _(t):
    return sp.expanding_windows(t.bars_h1.groupBy("instrument").agg(F.count(F.lit(1)).alias("n")))


_PS = {
    "pn": f"SELECT instrument, ts, lead(ts, 6) OVER ({OVER}) AS le, row_number() OVER ({OVER}) - 1 AS pos, count(*) OVER (PARTITION BY instrument) AS n FROM bars_h1",
    "pw": "SELECT p.instrument, f.fold, n - (3 - f.fold + 1) * 40 AS vf, p.ts AS vts FROM pn p, range(1, 4) f(fold) WHERE pos = n - (3 - f.fold + 1) * 40 AND n - (3 - f.fold + 1) * 40 - 8 >= 50",
}


@query("m03_purged_splits", "instrument ts fold:i split", """SELECT p.instrument, p.ts, w.fold, CASE WHEN pos < vf - 8 THEN 'train' ELSE 'val' END AS split FROM pn p JOIN pw w ON w.instrument = p.instrument
   WHERE (pos < vf - 8 AND (le IS NULL OR le < vts)) OR pos BETWEEN vf AND vf + 39""", **_PS)
def _(t):
    return sp.purged_splits(lb.label_end(t.bars_h1, 6))[1]


@query("m03_purged_splits_yearly", "fold:i split n:i", """SELECT fold, split, count(*) AS n FROM (SELECT w.fold, CASE WHEN pos < vf - 8 THEN 'train' ELSE 'val' END AS split FROM od p JOIN yw w ON (pos < vf - 8) OR pos BETWEEN vf AND vt) GROUP BY 1, 2""",
       od="SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos FROM orders",
       yw="SELECT row_number() OVER (ORDER BY y) AS fold, vf, vt FROM (SELECT year(o_orderdate) AS y, min(pos) AS vf, max(pos) AS vt, row_number() OVER (ORDER BY year(o_orderdate)) AS r, count(*) OVER () AS c FROM od GROUP BY 1) WHERE r >= greatest(2, c - 2)")
def _(t):
    rows = t.orders.select(F.lit("book").alias("instrument"), F.col("o_orderdate").alias("ts"), "o_orderkey")
    _, member = sp.purged_splits(rows, mode="anchored_yearly", label_end=None, s=sr.Series(order=("ts", "o_orderkey")))
    return member.groupBy("fold", "split").agg(F.count(F.lit(1)).alias("n"))


@query("m04_fixed_split", "instrument ts split", f"""SELECT instrument, ts, split FROM (SELECT *, lead(split, 12) OVER ({OVER}) AS later FROM (SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-18' THEN 'train' WHEN ts < TIMESTAMP '2024-01-24' THEN 'val' WHEN ts < TIMESTAMP '2024-01-30' THEN 'test' END AS split FROM bars_h1 WHERE ts >= TIMESTAMP '2024-01-02') WHERE split IS NOT NULL)
   WHERE split = 'test' OR split = later""")
def _(t):
    return sp.fixed_split(t.bars_h1, ["2024-01-02 00:00:00", "2024-01-18 00:00:00", "2024-01-24 00:00:00", "2024-01-30 00:00:00"], 12)


_LONG = "SELECT session, feature, value FROM (SELECT session, quantity, notional FROM scores WHERE year(ts) < 2000) UNPIVOT (value FOR feature IN (quantity, notional))"
_SC = {"lf": _LONG, "lim": "SELECT session, feature, quantile_cont(value, 0.01) AS clip_lo, quantile_cont(value, 0.99) AS clip_hi FROM lf GROUP BY 1, 2",
       "scl": """SELECT session, feature, clip_lo, clip_hi, quantile_cont(v, 0.5) AS median, CASE WHEN quantile_cont(v, 0.75) = quantile_cont(v, 0.25) THEN 1 ELSE quantile_cont(v, 0.75) - quantile_cont(v, 0.25) END AS iqr
         FROM (SELECT *, least(greatest(value, clip_lo), clip_hi) AS v FROM lf JOIN lim USING (session, feature)) GROUP BY 1, 2, 3, 4"""}


def session_scaler(t):
    rows = t.score_rows.where(F.year("ts") < 2000)
    return sp.fit_scaler(rows.select("session", "quantity", "notional"), ["quantity", "notional"], ["session"])


@query("m05_robust_scaler_fit", "session feature clip_lo:r clip_hi:r median:r iqr:r", "SELECT * FROM scl", **_SC)
def _(t):
    return session_scaler(t)


@query("m06_robust_scaler_apply", "session l_orderkey quantity:r notional:r", """SELECT s.session, l_orderkey, (least(greatest(quantity, a.clip_lo), a.clip_hi) - a.median) / a.iqr AS quantity, (least(greatest(notional, b.clip_lo), b.clip_hi) - b.median) / b.iqr AS notional FROM scores s
   JOIN scl a ON a.session = s.session AND a.feature = 'quantity' JOIN scl b ON b.session = s.session AND b.feature = 'notional'""", **_SC)
def _(t):
    rows = t.score_rows.select("session", "l_orderkey", "quantity", "notional")
    return sp.apply_scaler(rows, session_scaler(t), ["quantity", "notional"], ["session"])


_RIDGE = ("score", "quantity", "notional")
_G = lambda i, j: f"g{min(i, j)}{max(i, j)}"


def _det(m) -> str:
    """Determinant of a 3 x 3 matrix of SQL names."""
    (a, b, c), (d, e, f), (g, h, k) = m
    return f"({a} * ({e} * {k} - {f} * {h}) - {b} * ({d} * {k} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


def _cramer(col: int | None) -> str:
    return _det([[f"b{i}" if j == col else _G(i, j) for j in range(3)] for i in range(3)])


@query("m08_ridge_fit", "feature:i mean:r std:r weight:r intercept:r",
       "SELECT f.feature, CASE f.feature WHEN 0 THEN m0 WHEN 1 THEN m1 ELSE m2 END AS mean, CASE f.feature WHEN 0 THEN s0 WHEN 1 THEN s1 ELSE s2 END AS std, CASE f.feature WHEN 0 THEN w0 WHEN 1 THEN w1 ELSE w2 END AS weight, intercept FROM rg_m CROSS JOIN rg_w CROSS JOIN rg_i CROSS JOIN range(3) f(feature)",
       rg_m="SELECT " + ", ".join(f"avg(CAST({c} AS DOUBLE)) AS m{i}, coalesce(nullif(stddev_pop(CAST({c} AS DOUBLE)), 0), 1) AS s{i}" for i, c in enumerate(_RIDGE)) + " FROM scores",
       rg_z="SELECT CASE WHEN coalesce(y_true, 0) > 0 THEN 1.0::DOUBLE ELSE 0 END AS y, " + ", ".join(f"({c} - m{i}) / s{i} AS z{i}" for i, c in enumerate(_RIDGE)) + " FROM scores CROSS JOIN rg_m",
       rg_g="SELECT " + ", ".join([f"sum(z{i} * z{j}){' + 0.001' if i == j else ''} AS g{i}{j}" for i in range(3) for j in range(i, 3)] + [f"sum(z{i} * y) AS b{i}" for i in range(3)]) + " FROM rg_z",
       rg_w="SELECT " + ", ".join(f"{_cramer(j)} / {_cramer(None)} AS w{j}" for j in range(3)) + " FROM rg_g",
       rg_i="SELECT avg(y - ln(p / (1 - p))) AS intercept FROM (SELECT y, least(greatest(1 / (1 + exp(-least(greatest(z0 * w0 + z1 * w1 + z2 * w2, -40), 40))), 1e-6), 1 - 1e-6) AS p FROM rg_z CROSS JOIN rg_w)")
def _(t):
    m = md.fit_ridge(t.score_rows, list(_RIDGE), "y_true")
    return t.spark.createDataFrame([(i, a, b, c, m["intercept"]) for i, (a, b, c) in enumerate(zip(m["mean"], m["std"], m["weights"]))], "feature int, mean double, std double, weight double, intercept double")


@query("m09_linear_score", "l_orderkey l_linenumber l_partkey raw_score:r prob_lin:r", "SELECT l_orderkey, l_linenumber, l_partkey, 0.1 + (quantity - 25) / 14 * 0.3 + (notional - 38000) / 23000 * (-0.2) AS raw_score, 1 / (1 + exp(-(0.1 + (quantity - 25) / 14 * 0.3 + (notional - 38000) / 23000 * (-0.2)))) AS prob_lin FROM scores")
def _(t):
    model = {"features": ["quantity", "notional"], "mean": [25.0, 38000.0], "std": [14.0, 23000.0], "weights": [0.3, -0.2], "intercept": 0.1}
    return md.linear_score(t.scores, model, prob="prob_lin")


_NEWTON = """SELECT session, step, a - sa AS a, b - sb AS b, sqrt(sa * sa + sb * sb) AS moved FROM (SELECT session, step, a, b, (bb * ga - ab * gb) / (aa * bb - ab * ab) AS sa, (aa * gb - ab * ga) / (aa * bb - ab * ab) AS sb
  FROM (SELECT session, step, a, b, sum(e * s) AS ga, sum(e) AS gb, sum(w * s * s) + 1e-6 AS aa, sum(w * s) AS ab, sum(w) + 1e-6 AS bb FROM (SELECT session, step, a, b, s, (p - y) * m AS e, greatest(p * (1 - p), 1e-6) * m AS w
    FROM (SELECT pl.session, pl.step + 1 AS step, pl.a, pl.b, pb.s, pb.y, pb.m, 1 / (1 + exp(-least(greatest(pl.a * pb.s + pl.b, -40), 40))) AS p FROM pl JOIN pb ON pb.session = pl.session WHERE pl.step < 50 AND pl.moved >= 1e-8)) GROUP BY session, step, a, b))"""


@query("m10_platt_calibration", "session a:r b:r", "SELECT session, arg_max(a, step) AS a, arg_max(b, step) AS b FROM pl GROUP BY session",
       pb="SELECT session, CAST(score AS DOUBLE) AS s, CASE WHEN y_true > 0 THEN 1.0::DOUBLE ELSE 0 END AS y, count(*) AS m FROM scores GROUP BY 1, 2, 3",
       pl=f"SELECT session, 0 AS step, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b, 1.0::DOUBLE AS moved FROM (SELECT DISTINCT session FROM pb) UNION ALL {_NEWTON}")
def _(t):
    return md.fit_platt(t.score_rows, "session")


GRID = md.threshold_grid(0.5, 0.9, 0.02)
SHORT = md.threshold_grid(1 - 0.9, 1 - 0.5, 0.02)


def _vals(g) -> str:
    return ", ".join(f"({i}, CAST({x!r} AS DOUBLE))" for i, x in enumerate(g))


def _curve_sql(src: str, keys: str, name: str) -> dict[str, str]:
    return {
        f"{name}_l": f"SELECT {keys}, g.i, g.t AS threshold, count(*) FILTER (prob >= g.t) AS cnt, CASE WHEN count(*) FILTER (prob >= g.t) >= 20 THEN avg(pnl) FILTER (prob >= g.t) END AS ev FROM {src} CROSS JOIN (VALUES {_vals(GRID)}) g(i, t) GROUP BY {keys}, g.i, g.t",
        f"{name}_s": f"SELECT {keys}, g.i, g.t AS threshold, count(*) FILTER (prob <= g.t) AS cnt, CASE WHEN count(*) FILTER (prob <= g.t) >= 20 THEN avg(-pnl) FILTER (prob <= g.t) END AS ev FROM {src} CROSS JOIN (VALUES {_vals(SHORT)}) g(i, t) GROUP BY {keys}, g.i, g.t",
        **{f"{name}_{x}b": f"""SELECT {keys}, arg_max(threshold, (score, -i)) FILTER (score IS NOT NULL) AS threshold FROM (SELECT *, CASE WHEN ev >= -0.1 THEN ev + 0.25 * avg(ev) OVER (PARTITION BY {keys} ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)
           - 0.25 * abs((coalesce(lag(ev) OVER (PARTITION BY {keys} ORDER BY i), ev) + coalesce(lead(ev) OVER (PARTITION BY {keys} ORDER BY i), ev)) / 2 - ev) END AS score FROM {name}_{x}) GROUP BY {keys}""" for x in "ls"},
    }


@query("m11_ev_curve", "session side i:i threshold:r count:i ev:r", "SELECT session, 'long' AS side, i, threshold, cnt AS count, ev FROM ec_l UNION ALL SELECT session, 'short', i, threshold, cnt, ev FROM ec_s", **_curve_sql("scores", "session", "ec"))
def _(t):
    a = md.ev_curve(t.score_rows, ["session"], GRID, "long").withColumn("side", F.lit("long"))
    b = md.ev_curve(t.score_rows, ["session"], SHORT, "short").withColumn("side", F.lit("short"))
    return a.unionByName(b)


FIT = {"lo": 0.5, "hi": 0.9, "step": 0.02, "min_ev": -0.1}


@query("m12_session_thresholds", "session threshold_long:r threshold_short:r long_enabled short_enabled", "SELECT session, a.threshold AS threshold_long, b.threshold AS threshold_short, a.threshold IS NOT NULL AS long_enabled, b.threshold IS NOT NULL AS short_enabled FROM ec_lb a JOIN ec_sb b USING (session)", **_curve_sql("scores", "session", "ec"))
def _(t):
    return md.fit_thresholds(t.score_rows, ["session"], **FIT)


_ST = {
    "q4": "SELECT session, " + ", ".join(f"quantile_cont({c}, {p}) AS {n}{i}" for c, n in (("spread_proxy", "a"), ("spread_atr", "b")) for i, p in enumerate(("0", "1/3.0", "2/3.0", "1"))) + " FROM score_rows GROUP BY session",
    "ed": """SELECT session, list_filter(list_distinct([a1, a2]), lambda e: e > a0 AND e < a3) AS ea, list_filter(list_distinct([b1, b2]), lambda e: e > b0 AND e < b3) AS eb FROM q4""",
    "keyed": """SELECT s.*, 's=' || session || '|sp=' || len(list_filter(ea, lambda e: e < spread_proxy)) || '|sa=' || len(list_filter(eb, lambda e: e < spread_atr)) || '|cd=0' AS state_key FROM score_rows s JOIN ed USING (session)""",
    **_curve_sql("scores", "session", "ec"), **_curve_sql("keyed", "session, state_key", "sk"),
    "st": """SELECT session, state_key, n, n < 80 AS fallback, CASE WHEN n < 80 OR false THEN bl.threshold WHEN bl.threshold IS NULL THEN l.threshold ELSE CASE WHEN l.threshold IS NOT NULL THEN least(greatest(l.threshold, bl.threshold - 0.06), bl.threshold + 0.06) END END AS threshold_long,
      CASE WHEN n < 80 THEN bs.threshold WHEN bs.threshold IS NULL THEN x.threshold ELSE CASE WHEN x.threshold IS NOT NULL THEN least(greatest(x.threshold, bs.threshold - 0.06), bs.threshold + 0.06) END END AS threshold_short
      FROM (SELECT session, state_key, count(*) AS n FROM keyed GROUP BY 1, 2) c JOIN sk_lb l USING (session, state_key) JOIN sk_sb x USING (session, state_key) JOIN ec_lb bl USING (session) JOIN ec_sb bs USING (session)""",
}
STATE_COLS = ("spread_proxy", "spread_atr")


def state_thresholds(t):
    rows = t.score_rows
    base = sr.materialise(md.fit_thresholds(rows, ["session"], **FIT))
    edges = sr.materialise(md.state_edges(rows, "session", STATE_COLS))
    return rows, base, edges, md.cost_state_thresholds(rows, "session", STATE_COLS, edges, base, **FIT)


@query("m13_cost_state_thresholds", "session state_key n:i fallback threshold_long:r threshold_short:r", "SELECT * FROM st", **_ST)
def _(t):
    return state_thresholds(t)[3]


@query("r21_threshold_signals", "session signal:i n:i", """SELECT session, signal, count(*) AS n FROM (SELECT k.session, CASE WHEN up AND dn THEN CASE WHEN prob - tl >= ts_ - prob THEN 1 ELSE -1 END WHEN up THEN 1 WHEN dn THEN -1 ELSE 0 END AS signal FROM (SELECT k.*, tl, ts_, coalesce(bl IS NOT NULL AND prob >= tl, false) AS up, coalesce(bs IS NOT NULL AND prob <= ts_, false) AS dn
   FROM (SELECT keyed.session, prob, coalesce(st.threshold_long, ec_lb.threshold) AS tl, coalesce(st.threshold_short, ec_sb.threshold) AS ts_, ec_lb.threshold AS bl, ec_sb.threshold AS bs FROM keyed JOIN st USING (session, state_key) JOIN ec_lb ON ec_lb.session = keyed.session JOIN ec_sb ON ec_sb.session = keyed.session) k) k) GROUP BY 1, 2""", **_ST)
def _(t):
    rows, base, edges, st = state_thresholds(t)
    st = sr.materialise(st).select("session", "state_key", F.col("threshold_long").alias("_sl"), F.col("threshold_short").alias("_ss"))
    d = rows.join(edges, "session").withColumn("state_key", md.state_key("session", STATE_COLS)).join(st, ["session", "state_key"], "left").join(base, "session")
    sig = ru.threshold_signal(F.col("prob"), F.coalesce("_sl", "threshold_long"), F.coalesce("_ss", "threshold_short"), F.col("long_enabled"), F.col("short_enabled"))
    return d.select("session", sig.alias("signal")).groupBy("session", "signal").agg(F.count(F.lit(1)).alias("n"))


@query("m14_validation_gate", "fold:i gate:r", "SELECT fold, quantile_cont(prob, 0.8) AS gate FROM scores GROUP BY fold")
def _(t):
    return md.validation_gate(t.score_rows, "fold", "prob", 0.2)


MODEL_FEATURES = ("ret_1", "ret_4", "body_pct", "close_pos_in_range", "bb_width_pct")


@query("m15_m17_direction_models", "instrument ts p_trade:r p_long:r p_short:r signal:i")
def _(t):
    """Train on the first folds, score the test rows, gate into signals."""
    feats = fe.base_frame(t.bars_h1).select("instrument", "ts", *MODEL_FEATURES)
    rows = sr.materialise(opportunity(t).select("instrument", "ts", "split", "y_opp", "y_dir").join(feats, ["instrument", "ts"]).dropna(subset=list(MODEL_FEATURES)))
    models = md.fit_direction_models(rows.where("split = 'train'"), MODEL_FEATURES)
    out = md.score_direction(rows.where("split = 'test'"), models, ["instrument", "ts"])
    return out.withColumn("signal", ru.gate_signal(F.col("p_trade"), F.col("p_long"), F.col("p_short"), F.lit(0.5)))


@query("m16_regime_clusters", "instrument ts regime:i probability:r")
def _(t):
    """Cluster regime features, export the model, assign through the export."""
    feats = sr.materialise(fe.regime_features(t.bars_h1))
    _, model = md.fit_regimes(feats, fe.REGIME_V1)
    pts = feats.select("instrument", "ts", F.array(*fe.REGIME_V1).alias("features"))
    return ru.assign_regime(pts, md.regime_table(t.spark, model), mean="mu", std="sd")


