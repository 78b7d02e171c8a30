"""Linear models, calibration, thresholds and gates."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlume.operators.series import attach, materialise, quantiles
from barlume.operators.splits import bucket_of, check_columns


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(x, F.lit(-40.0)), F.lit(40.0))))


def fit_ridge(rows: DataFrame, features: Sequence[str], label: str, weight: str | None = None, ridge: float = 1e-3) -> dict:
    """Weighted ridge model on standardised features with a residual-mean intercept.

    The moments and the d x d Gram matrix are sums over the cluster; only they
    reach the driver, where a d x d system is solved.  A second pass sums the
    intercept.
    """
    n = len(features)
    x = [F.col(f).cast("double") for f in features]
    m = rows.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(x)]).first()
    mean = [m[f"m{i}"] for i in range(n)]
    std = [m[f"s{i}"] if m[f"s{i}"] else 1.0 for i in range(n)]
    z = [(c - mean[i]) / std[i] for i, c in enumerate(x)]
    y = (F.coalesce(F.col(label), F.lit(0)) > 0).cast("double")
    w = F.lit(1.0)
    if weight:
        w = F.when(F.col(weight) > 0, F.col(weight)).otherwise(1.0)
    d = rows.select(*[c.alias(f"z{i}") for i, c in enumerate(z)], y.alias("y"), w.alias("w"))
    sums = [F.sum(F.col("w") * F.col(f"z{i}") * F.col(f"z{j}")).alias(f"g{i}_{j}") for i in range(n) for j in range(i, n)]
    sums += [F.sum(F.col("w") * F.col(f"z{i}") * F.col("y")).alias(f"b{i}") for i in range(n)]
    g = d.agg(*sums).first()
    a = np.zeros((n, n))
    for i in range(n):
        for j in range(i, n):
            a[i, j] = a[j, i] = g[f"g{i}_{j}"]
    beta = np.linalg.solve(a + ridge * np.eye(n), np.array([g[f"b{i}"] for i in range(n)]))
    raw = sum((F.col(f"z{i}") * float(beta[i]) for i in range(n)), F.lit(0.0))
    p = F.least(F.greatest(sigmoid(raw), F.lit(1e-6)), F.lit(1 - 1e-6))
    r = d.agg((F.sum(F.col("w") * (F.col("y") - F.log(p / (1 - p)))) / F.sum("w")).alias("i")).first()
    return {"features": list(features), "mean": mean, "std": std, "weights": [float(v) for v in beta], "intercept": float(r["i"])}


def linear_score(rows: DataFrame, model: dict, out: str = "raw_score", prob: str = "prob") -> DataFrame:
    check_columns([c for c in rows.columns if c in model["features"]], model["features"])
    raw = F.lit(model["intercept"])
    for f, m, s, b in zip(model["features"], model["mean"], model["std"], model["weights"]):
        raw = raw + (F.col(f) - m) / s * b
    return rows.withColumn(out, raw).withColumn(prob, sigmoid(F.col(out)))


def fit_platt(scores: DataFrame, session: str, score: str = "score", y: str = "y_true", steps: int = 50) -> DataFrame:
    """Platt calibration p = sigmoid(a*s + b) per session by Newton steps.

    Scores fold to (session, score, label) counts once; each step is one grouped
    sum over that table and a 2 x 2 solve in columns.  Only the parameter rows
    (one per session) live between steps.
    """
    base = materialise(scores.groupBy(session, F.col(score).cast("double").alias("_s"), (F.col(y) > 0).cast("double").alias("_y")).agg(F.count(F.lit(1)).alias("_m")))
    names = [r[0] for r in base.select(session).distinct().collect()]  # one row per session
    state = {n: (1.0, 0.0) for n in names}
    live = set(names)
    for _ in range(steps):
        rows = [(n, *state[n]) for n in names if n in live]
        p = scores.sparkSession.createDataFrame(rows, f"{session} {dict(base.dtypes)[session]}, _a double, _b double")
        d = base.join(F.broadcast(p), session)
        q = sigmoid(F.col("_a") * F.col("_s") + F.col("_b"))
        d = d.withColumn("_p", q)
        w = F.greatest(F.col("_p") * (1 - F.col("_p")), F.lit(1e-6)) * F.col("_m")
        e = (F.col("_p") - F.col("_y")) * F.col("_m")
        g = d.groupBy(session).agg(F.sum(e * F.col("_s")).alias("ga"), F.sum(e).alias("gb"), F.sum(w * F.col("_s") * F.col("_s")).alias("aa"), F.sum(w * F.col("_s")).alias("ab"), F.sum(w).alias("bb"))
        for r in g.collect():
            aa, bb, ab = r["aa"] + 1e-6, r["bb"] + 1e-6, r["ab"]
            det = aa * bb - ab * ab
            sa, sb = (bb * r["ga"] - ab * r["gb"]) / det, (aa * r["gb"] - ab * r["ga"]) / det
            a, b = state[r[session]]
            state[r[session]] = (a - sa, b - sb)
            if (sa * sa + sb * sb) ** 0.5 < 1e-8:
                live.discard(r[session])
        if not live:
            break
    rows = [(n, *state[n]) for n in names]
    return scores.sparkSession.createDataFrame(rows, f"{session} {dict(base.dtypes)[session]}, a double, b double")


def apply_platt(scores: DataFrame, params: DataFrame, session: str, score: str = "score", out: str = "prob_cal") -> DataFrame:
    return scores.join(F.broadcast(params), session, "left").withColumn(out, sigmoid(F.col("a") * F.col(score) + F.col("b"))).drop("a", "b")


def threshold_grid(lo: float = 0.5, hi: float = 0.9, step: float = 0.01) -> list[float]:
    return [float(x) for x in np.arange(lo, hi + 0.5 * step, step)]


def ev_curve(rows: DataFrame, keys: Sequence[str], grid: Sequence[float], side: str = "long", prob: str = "prob", ev: str = "pnl", least: int = 20) -> DataFrame:
    """Mean EV and count of rows at or beyond each grid threshold.

    Each row falls into one grid cell; running sums over the cells (a few dozen
    per key) give the curve, so rows are never multiplied by the grid.
    """
    k = list(keys)
    g = F.array(*[F.lit(x) for x in grid])
    p = F.col(prob)
    if side == "long":
        cell = F.size(F.filter(g, lambda t: t <= p)) - 1
    else:
        cell = F.size(F.filter(g, lambda t: t < p))
    n = len(grid)
    sums = rows.withColumn("i", cell).where((F.col("i") >= 0) & (F.col("i") < n)).groupBy(*k, "i").agg(
        F.sum(F.col(ev).cast("double")).alias("_s"), F.count(F.lit(1)).alias("_n")
    )
    every = rows.select(*k).distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    d = every.join(sums, [*k, "i"], "left")
    cells = Window.partitionBy(*k).orderBy("i")
    frame = cells.rowsBetween(0, Window.unboundedFollowing) if side == "long" else cells.rowsBetween(Window.unboundedPreceding, 0)
    tot, cnt = F.sum("_s").over(frame), F.coalesce(F.sum("_n").over(frame), F.lit(0))
    sign = 1.0 if side == "long" else -1.0
    d = d.select(*k, "i", F.get(g, F.col("i")).alias("threshold"), cnt.alias("count"), F.when(cnt >= least, sign * tot / cnt).alias("ev"))
    return d


def choose_threshold(curve: DataFrame, keys: Sequence[str], min_ev: float = 0.0, smooth: float = 0.25, spike: float = 0.25, reach: int = 2) -> DataFrame:
    """Best threshold by EV + smooth * neighbourhood mean - spike * local spike; the
    first one on ties, none (disabled) when no point qualifies."""
    k = list(keys)
    w = Window.partitionBy(*k).orderBy("i")
    near = F.avg("ev").over(w.rowsBetween(-reach, reach))
    left = F.coalesce(F.lag("ev").over(w), F.col("ev"))
    right = F.coalesce(F.lead("ev").over(w), F.col("ev"))
    score = F.col("ev") + smooth * near - spike * F.abs((left + right) / 2 - F.col("ev"))
    d = curve.withColumn("_score", score)
    d = d.withColumn("score", F.when(F.col("ev") >= min_ev, F.col("_score")))
    pick = F.when(F.col("score").isNotNull(), F.struct(F.col("score"), -F.col("i")))
    return d.groupBy(*k).agg(F.max_by("threshold", pick).alias("threshold"), F.max("score").alias("score")).withColumn("enabled", F.col("threshold").isNotNull())


def fit_thresholds(rows: DataFrame, keys: Sequence[str], least: int = 20, min_ev: float = 0.0, lo: float = 0.5, hi: float = 0.9, step: float = 0.01, prob: str = "prob", ev: str = "pnl") -> DataFrame:
    """Long and short thresholds per key."""
    k = list(keys)
    up = choose_threshold(ev_curve(rows, k, threshold_grid(lo, hi, step), "long", prob, ev, least), k, min_ev)
    dn = choose_threshold(ev_curve(rows, k, threshold_grid(max(0.0, 1 - hi), min(1.0, 1 - lo), step), "short", prob, ev, least), k, min_ev)
    return up.select(*k, F.col("threshold").alias("threshold_long"), F.col("enabled").alias("long_enabled")).join(
        dn.select(*k, F.col("threshold").alias("threshold_short"), F.col("enabled").alias("short_enabled")), k
    )


def state_edges(rows: DataFrame, session: str, columns: Sequence[str], bins: int = 3) -> DataFrame:
    """Interior quantile edges per session and column, duplicates dropped."""
    out = None
    for c in columns:
        qs = {f"_q{i}": i / bins for i in range(bins + 1)}
        q = quantiles(rows, [session], c, qs)
        e = F.array_sort(F.array_distinct(F.array(*[F.col(n) for n in qs])))
        q = q.select(session, F.when(F.size(e) > 2, F.slice(e, 2, F.size(e) - 2)).otherwise(F.array().cast("array<double>")).alias(f"{c}_edges"))
        out = q if out is None else out.join(q, session)
    return out


def state_key(session: str, columns: Sequence[str], drift: Column | None = None) -> Column:
    a, b = columns
    return F.format_string(
        "s=%s|sp=%d|sa=%d|cd=%d", F.col(session), bucket_of(F.coalesce(F.col(a), F.lit(0.0)), F.col(f"{a}_edges")),
        bucket_of(F.coalesce(F.col(b), F.lit(0.0)), F.col(f"{b}_edges")), (drift > 0).cast("int") if drift is not None else F.lit(0),
    )


def cost_state_thresholds(rows: DataFrame, session: str, columns: Sequence[str], edges: DataFrame, base: DataFrame, least_state: int = 80, max_adj: float = 0.06, **fit) -> DataFrame:
    """Thresholds per cost state, limited to the session's own +- ``max_adj``; small
    states fall back to the session."""
    keyed = attach(rows, edges, [session]).withColumn("state_key", state_key(session, columns))
    keyed = materialise(keyed.drop(*[f"{c}_edges" for c in columns]))
    n = keyed.groupBy(session, "state_key").agg(F.count(F.lit(1)).alias("n"))
    own = fit_thresholds(keyed, [session, "state_key"], **fit)
    b = base.select(session, F.col("threshold_long").alias("_bl"), F.col("threshold_short").alias("_bs"))
    d = n.join(own, [session, "state_key"]).join(b, session)
    small = F.col("n") < least_state
    lim = lambda x, c: F.when(c.isNull(), x).otherwise(F.when(x.isNotNull(), F.least(F.greatest(x, c - max_adj), c + max_adj)))
    return d.select(
        session, "state_key", "n", small.alias("fallback"),
        F.when(small, F.col("_bl")).otherwise(lim(F.col("threshold_long"), F.col("_bl"))).alias("threshold_long"),
        F.when(small, F.col("_bs")).otherwise(lim(F.col("threshold_short"), F.col("_bs"))).alias("threshold_short"),
    )


def validation_gate(rows: DataFrame, fold: str, prob: str, target_rate: float = 0.2) -> DataFrame:
    """Gate that lets the target share of validation rows through."""
    rate = min(0.99, max(0.01, target_rate))
    return quantiles(rows, [fold], prob, {"gate": 1 - rate})


def fit_direction_models(train: DataFrame, features: Sequence[str]):
    """Opportunity and direction classifiers (logistic) on windowed features."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    def fit(df: DataFrame, label: str, out: str):
        va = VectorAssembler(inputCols=list(features), outputCol=f"_v_{label}", handleInvalid="skip")
        lr = LogisticRegression(featuresCol=f"_v_{label}", labelCol=label, probabilityCol=out, rawPredictionCol=f"_r_{label}", predictionCol=f"_p_{label}", maxIter=20)
        return Pipeline(stages=[va, lr]).fit(df)

    return fit(train, "y_opp", "_p_opp"), fit(train.where("y_dir <> -1"), "y_dir", "_p_dir")


def score_direction(rows: DataFrame, models, keep: Sequence[str]) -> DataFrame:
    """Signals table: p_trade, p_long, p_short."""
    from pyspark.ml.functions import vector_to_array

    d = models[1].transform(models[0].transform(rows))
    return d.select(
        *keep, vector_to_array("_p_opp")[1].alias("p_trade"), vector_to_array("_p_dir")[1].alias("p_long"), vector_to_array("_p_dir")[0].alias("p_short")
    )


def fit_regimes(rows: DataFrame, features: Sequence[str], k: int = 4, seed: int = 42):
    """Standardised k-means; returns the fitted pipeline and the exported model
    (mean, std, centers) that regime assignment consumes."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    va = VectorAssembler(inputCols=list(features), outputCol="_raw", handleInvalid="skip")
    sc = StandardScaler(inputCol="_raw", outputCol="_std", withMean=True)
    m = Pipeline(stages=[va, sc, KMeans(k=k, seed=seed, featuresCol="_std", predictionCol="regime")]).fit(rows)
    s, km = m.stages[1], m.stages[2]
    return m, {"features": list(features), "mean": [float(x) for x in s.mean], "std": [float(x) for x in s.std], "centers": [[float(x) for x in c] for c in km.clusterCenters()]}


def regime_table(spark, model: dict) -> DataFrame:
    """The exported model as the one-row table used by regime assignment."""
    rows = [([(i, c) for i, c in enumerate(model["centers"])], model["mean"], model["std"])]
    return spark.createDataFrame(rows, "centers array<struct<regime:int,center:array<double>>>, mu array<double>, sd array<double>")
