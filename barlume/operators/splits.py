"""Walk-forward windows, fold membership and scalers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, WindowSpec
from pyspark.sql import functions as F

from barlume.operators.align import plus_seconds
from barlume.operators.series import BARS, Series, attach, materialise, position, quantiles, share_of, windowed


def month_windows(spark: SparkSession, bounds: DataFrame, train: int = 18, val: int = 2, test: int = 2, step: int = 1, open_end: bool = False) -> DataFrame:
    """Rolling month windows over ``bounds`` (one row: start, end; start is a month
    begin).  A window needs its whole test part unless ``open_end``, where the test
    start suffices."""
    m = lambda c, k: F.add_months(F.col(c).cast("date"), k).cast("timestamp_ntz")
    months = F.months_between(F.col("end"), F.col("start")).cast("int") + 1
    d = bounds.withColumn("fold", F.explode(F.sequence(F.lit(0), F.floor(months / step).cast("int"))))
    d = d.withColumn("train_start", F.add_months(F.col("start").cast("date"), F.col("fold") * step).cast("timestamp_ntz"))
    d = d.withColumns({"val_start": m("train_start", train), "test_start": m("train_start", train + val), "test_end": m("train_start", train + val + test)})
    keep = F.col("test_start") <= F.col("end") if open_end else F.col("test_end") <= F.col("end")
    d = d.where(keep)
    name = F.concat(F.lit("step_"), F.lpad(F.col("fold").cast("string"), 3, "0"), F.lit("_"), F.date_format("train_start", "yyyyMMdd"))
    return d.withColumn("step_id", name).select("fold", "step_id", "train_start", "val_start", "test_start", "test_end")


def fold_membership(rows: DataFrame, windows: DataFrame, purge_seconds: int, embargo: bool = False, ts: str = "ts") -> DataFrame:
    """Rows with every (fold, split) they belong to.

    Windows unfold to months and meet rows on the month, so this is an equality
    join with the exact bounds as residual; part ends are cut by the purge, and
    with ``embargo`` later parts start that much later.
    """
    p = purge_seconds
    e = p if embargo else 0
    part = lambda n, lo, hi, head, tail: F.struct(F.lit(n).alias("split"), plus_seconds(F.col(lo), head).alias("lo"), plus_seconds(F.col(hi), -tail).alias("hi"))
    parts = F.array(part("train", "train_start", "val_start", 0, p), part("val", "val_start", "test_start", e, p), part("test", "test_start", "test_end", e, 0 if embargo else p))
    w = windows.select("fold", F.explode(parts).alias("_p")).select("fold", "_p.*")
    month = lambda c: (F.year(c) * 12 + F.month(c)).cast("int")
    w = w.withColumn("_m", F.explode(F.sequence(month("lo"), month("hi"))))
    d = rows.withColumn("_m", month(ts)).join(w, "_m")
    return d.where((F.col(ts) >= F.col("lo")) & (F.col(ts) < F.col("hi"))).drop("_m", "lo", "hi")


def numbered(rows: DataFrame, s: Series = BARS, grouped: bool = True) -> DataFrame:
    """Zero-based position `pos` and series length `n`."""
    total = rows.groupBy(*s.keys).agg(F.count(F.lit(1)).alias("n"))
    d = windowed(rows, s, lambda d, w: d.withColumn("pos", position(w)))
    return attach(d, total, s.keys) if s.keys else d.crossJoin(F.broadcast(total))


def expanding_windows(counts: DataFrame, ratio: float = 0.7, k: int = 3, least_train: int = 200, least_test: int = 50) -> DataFrame:
    """First ``ratio`` of rows as the first train part, then k test parts in a row.
    counts: keys and n."""
    base = F.greatest(share_of(F.col("n"), ratio), F.lit(least_train)).cast("bigint")
    d = counts.withColumn("_b", base).where(F.col("n") > F.col("_b"))
    d = d.withColumn("_len", F.greatest(F.lit(least_test), F.floor((F.col("n") - F.col("_b")) / k)).cast("bigint"))
    d = d.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    d = d.withColumn("test_from", F.col("_b") + F.col("fold") * F.col("_len"))
    d = d.withColumn("test_to", F.least(F.col("n") - 1, F.col("test_from") + F.col("_len") - 1))
    # a window opens only if the one before ended ahead of the last two rows
    d = d.where((F.col("test_to") > F.col("test_from")) & ((F.col("fold") == 0) | (F.col("test_from") - 1 < F.col("n") - 2)))
    return d.withColumn("train_to", F.col("test_from") - 1).drop("_b", "_len")


def purged_splits(
    rows: DataFrame, val_size: int = 40, n_splits: int = 3, purge: int = 8, min_train: int = 50, mode: str = "tail",
    rolling_size: int | None = None, embargo: int = 0, label_end: str | None = "label_end_ts", s: Series = BARS,
) -> tuple[DataFrame, DataFrame]:
    """(windows, membership) of purged walk-forward splits by row position.

    Train rows whose label ends at or after the validation start drop out.
    """
    d = materialise(numbered(rows, s))
    k = list(s.keys)
    if mode == "anchored_yearly":
        y = d.groupBy(*k, F.year(s.ts).alias("_y")).agg(F.min("pos").alias("val_from"), F.max("pos").alias("val_to"), F.first("n").alias("n"))
        order = y.groupBy(*k).agg(F.sort_array(F.collect_list(F.struct("val_from", "val_to", "n"))).alias("_w"))  # one entry per year
        order = order.withColumn("_w", F.slice("_w", F.greatest(F.lit(2), F.size("_w") - n_splits + 1), n_splits))
        w = order.select(*k, F.posexplode("_w").alias("_i", "_v")).select(*k, (F.col("_i") + 1).alias("fold"), "_v.*")
    else:
        n = d.groupBy(*k).agg(F.max("n").alias("n"))
        w = n.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(n_splits))))
        w = w.withColumn("val_from", F.col("n") - (n_splits - F.col("fold") + 1) * val_size)
        w = w.withColumn("val_to", F.col("val_from") + val_size - 1).where("val_from >= 0")
    w = w.withColumn("train_to", F.greatest(F.lit(0), F.col("val_from") - purge))
    start = F.greatest(F.lit(0), F.col("train_to") - rolling_size) if mode == "rolling" and rolling_size else F.lit(0)
    w = w.withColumn("train_from", start).where(F.col("train_to") - F.col("train_from") >= min_train)
    w = w.withColumn("embargo_to", F.least(F.col("n"), F.col("val_to") + 1 + embargo))
    first = d.select(*k, F.col("pos").alias("val_from"), F.col(s.ts).alias("val_start_ts"))
    w = w.join(first, [*k, "val_from"])
    j = attach(d.drop("n"), w.drop("n"), k)
    train = (F.col("pos") >= F.col("train_from")) & (F.col("pos") < F.col("train_to"))
    if label_end:
        train = train & (F.col(label_end).isNull() | (F.col(label_end) < F.col("val_start_ts")))
    val = F.col("pos").between(F.col("val_from"), F.col("val_to"))
    member = j.withColumn("split", F.when(train, "train").when(val, "val")).where("split IS NOT NULL")
    return w, member.select(*k, s.ts, "fold", "split")


def fixed_split(rows: DataFrame, bounds: Sequence[str], horizon: int, s: Series = BARS) -> DataFrame:
    """train / val / test by three dates; the last ``horizon`` rows of train and
    val drop out."""
    a, b, c, e = [F.lit(x).cast("timestamp_ntz") for x in bounds]
    ts = F.col(s.ts)
    part = F.when((ts >= a) & (ts < b), "train").when((ts >= b) & (ts < c), "val").when((ts >= c) & (ts < e), "test")

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        return d.withColumn("_later", F.lead("split", horizon).over(w))

    d = windowed(rows.withColumn("split", part).where("split IS NOT NULL"), s, build, ahead=horizon)
    return d.where((F.col("split") == "test") | (F.col("split") == F.col("_later"))).drop("_later")


def long_form(rows: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    pairs = ", ".join(f"'{c}', CAST({c} AS DOUBLE)" for c in features)
    return rows.selectExpr(*keys, f"stack({len(features)}, {pairs}) AS (feature, value)")


def fit_scaler(rows: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Robust scaler per key and feature: limits q01 and q99, then median and IQR
    of the limited values (IQR 0 counts as 1)."""
    k = [*keys, "feature"]
    x = materialise(long_form(rows, keys, features))
    lim = materialise(quantiles(x, k, "value", {"clip_lo": 0.01, "clip_hi": 0.99}))
    c = attach(x.where(F.col("value").isNotNull()), lim, k).withColumn("value", F.least(F.greatest("value", "clip_lo"), "clip_hi"))
    q = quantiles(c, k, "value", {"median": 0.5, "_q1": 0.25, "_q3": 0.75})
    iqr = F.col("_q3") - F.col("_q1")
    return lim.join(q, k).select(*k, "clip_lo", "clip_hi", "median", F.when(iqr == 0, 1.0).otherwise(iqr).alias("iqr"))


def scaler_wide(scaler: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    one = F.struct("clip_lo", "clip_hi", "median", "iqr")
    aggs = [F.max(F.when(F.col("feature") == f, one)).alias(f"_s_{f}") for f in features]
    return scaler.groupBy(*keys).agg(*aggs)


def apply_scaler(rows: DataFrame, scaler: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Scaled features with frozen state; the state has one row per key and meets
    the rows in one join."""
    w = scaler_wide(scaler, features, keys)
    d = attach(rows, w, keys, "left") if keys else rows.crossJoin(F.broadcast(w))
    scaled = {f: (F.least(F.greatest(F.col(f), F.col(f"_s_{f}.clip_lo")), F.col(f"_s_{f}.clip_hi")) - F.col(f"_s_{f}.median")) / F.col(f"_s_{f}.iqr") for f in features}
    return d.withColumns(scaled).drop(*[f"_s_{f}" for f in features])


def check_columns(have: Sequence[str], want: Sequence[str]) -> None:
    """Scoring needs the training columns in the training order."""
    if list(have) != list(want):
        raise ValueError(f"feature columns differ: {list(have)} != {list(want)}")


def bucket_of(x: Column, edges: Column) -> Column:
    """Number of interior edges below x (right-closed buckets)."""
    return F.size(F.filter(edges, lambda e: e < x))
