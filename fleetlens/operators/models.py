"""Fitted models: boosted trees, logistic and linear fits, isotonic calibration, ridge forecasts, attributions.

Fits over rows use Spark's own learners; fits over series run one series per group, whose length is its number of days.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import store
from . import boosting, ranks
from .forecast import lag_matrix
from .metrics import average_precision, roc_auc

RIDGE_LAGS = (1, 2, 3, 7, 14, 28)


def class_weights(df: DataFrame, y: str) -> DataFrame:
    """weight = n / (2 n of the row's class); the counts are two numbers."""
    counts = df.groupBy(F.col(y).alias("_y")).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"))
    weights = counts.crossJoin(F.broadcast(total)).select("_y", (F.col("_all") / (2.0 * F.col("_n"))).alias("weight"))
    return df.join(F.broadcast(weights), F.col(y) == F.col("_y")).drop("_y")


#: Rows that one task of a fit takes at most, as far as there are partitions.
FIT_ROWS = 500_000


def fit_rows(df: DataFrame, cols: list[str], y: str) -> tuple[DataFrame, DataFrame, int]:
    """cols, y and weight (see class_weights()) of the rows with a y, the persisted table that they come from, which the
    caller unpersists, and the number of all rows.

    A fit goes over its rows many times: they are computed once, and in one wave of tasks if they are few. The weights are a
    number for each class.
    """
    kept = df.select(*cols, y).persist()
    counts = {r[0]: r[1] for r in kept.groupBy(y).agg(F.count("*")).collect()}
    n, known = sum(counts.values()), {k: c for k, c in counts.items() if k is not None}
    cores = df.sparkSession.sparkContext.defaultParallelism
    weight = F.coalesce(*[F.when(F.col(y) == k, F.lit(n / (2.0 * c))) for k, c in known.items()], F.lit(None).cast("double"))
    return kept.where(F.col(y).isNotNull()).withColumn("weight", weight).coalesce(cores * max(1, -(-n // (cores * FIT_ROWS)))), kept, n


def with_missing_flags(df: DataFrame, cols: list[str]) -> tuple[DataFrame, list[str]]:
    """Doubles with nulls kept apart by a flag per column."""
    flagged = df.withColumns({c: F.col(c).cast("double") for c in cols} | {f"{c}_missing": F.col(c).isNull().cast("double") for c in cols})
    return flagged, [f"{c}_missing" for c in cols]


def boosted_scores(train: DataFrame, rows: DataFrame, cols: list[str], y: str, iterations: int = 120, rate: float = 0.08) -> DataFrame:
    """rows with score: boosted trees fitted on train with balanced classes; nulls are imputed and flagged."""
    known, held, _ = fit_rows(train, cols, y)
    known, flags = with_missing_flags(known, cols)
    rows, _ = with_missing_flags(rows, cols)
    names = [f"{c}_filled" for c in cols]
    filler = Imputer(inputCols=cols, outputCols=names, strategy="median").fit(known)
    trees = boosting.fit(filler.transform(known), names + flags, y, "weight", iterations=iterations, rate=rate)
    held.unpersist()
    scored = filler.transform(rows).withColumn("_raw", boosting.raw_score(trees, [F.col(c) for c in names + flags]))
    return scored.withColumn("score", 1 / (1 + F.exp(-2 * F.col("_raw")))).drop("_raw", *names, *flags)


def logistic_fit(df: DataFrame, cols: list[str], y: str) -> tuple[Callable[[DataFrame], DataFrame], list[float]]:
    """A scorer and the coefficients on standardised columns, with the usual unit penalty."""
    n = df.count()
    vector = VectorAssembler(inputCols=cols, outputCol="_raw")
    scaler = StandardScaler(inputCol="_raw", outputCol="_features", withMean=True).fit(vector.transform(df))
    model = LogisticRegression(featuresCol="_features", labelCol=y, regParam=1.0 / max(n, 1), standardization=False, maxIter=100).fit(scaler.transform(vector.transform(df)))

    def score(rows: DataFrame) -> DataFrame:
        out = model.transform(scaler.transform(vector.transform(rows)))
        return out.withColumn("score", vector_to_array("probability")[1]).drop("_raw", "_features", "rawPrediction", "probability", "prediction")

    return score, [float(x) for x in model.coefficients]


def association(df: DataFrame, cols: list[str], y: str, least: int = 30) -> DataFrame:
    """feature, n, coefficient, auc, strength for each column alone; columns with few rows or one class are left out.

    The loop goes over the named columns, each fit over all rows.
    """
    out = []
    for c in cols:
        rows = df.select(F.col(c).cast("double").alias(c), y).where(F.col(c).isNotNull())
        n, classes = rows.agg(F.count("*"), F.count_distinct(y)).first()
        if n < least or classes < 2:
            continue
        score, weights = logistic_fit(rows, [c], y)
        auc = roc_auc(score(rows), [], y, "score")
        apart = F.abs(F.col("roc_auc") - 0.5)
        strength = F.when(apart >= 0.2, "strong").when(apart >= 0.1, "moderate").otherwise("weak")
        out.append(auc.select(F.lit(c).alias("feature"), F.lit(n).cast("long").alias("n"), F.lit(weights[0]).alias("coefficient"), F.col("roc_auc").alias("auc"), strength.alias("strength")))
    found = out[0] if out else df.sparkSession.createDataFrame([], "feature string, n long, coefficient double, auc double, strength string")
    for x in out[1:]:
        found = found.unionByName(x)
    return found


def joint_association(train: DataFrame, test: DataFrame, cols: list[str], y: str, least: int = 30, bins: int = 10) -> DataFrame | None:
    """One logistic fit on all columns together: section, name, value, in long form; None where either side has fewer than
    `least` rows or one class.

    coefficient: one for each standardised column; direction is its sign. measure: roc_auc, average_precision, brier and
    event_rate of the test rows; predicted and observed: mean score and rate of positives by quantile bin of the scores (bins
    that share their edges are one). Rows with a null in any column or in y take no part.
    """
    known = lambda df: df.select(*[F.col(c).cast("double").alias(c) for c in cols], F.col(y).cast("int").alias(y)).dropna()
    train, test = known(train), known(test)
    for rows in (train, test):
        n, classes = rows.agg(F.count("*"), F.count_distinct(y)).first()
        if n < least or classes < 2:
            return None
    score, weights = logistic_fit(train, cols, y)
    scored = score(test).select("score", y).persist()
    edges = sorted(set(ranks.quantiles(scored, "score", [i / bins for i in range(1, bins)])))
    binned = scored.withColumn("bin", F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col("score"))))
    table = binned.groupBy("bin").agg(F.avg("score").alias("predicted"), F.avg(F.col(y).cast("double")).alias("observed"))
    table = table.unpivot(["bin"], ["predicted", "observed"], "section", "value").select("section", F.concat(F.lit("bin_"), F.lpad(F.col("bin").cast("string"), 2, "0")).alias("name"), "value")
    one = scored.agg(F.avg(F.pow(F.col("score") - F.col(y), 2)).alias("brier"), F.avg(F.col(y).cast("double")).alias("event_rate"))
    one = one.crossJoin(roc_auc(scored, [], y, "score")).crossJoin(average_precision(scored, [], y, "score")).select("roc_auc", "average_precision", "brier", "event_rate")
    measures = one.unpivot([], one.columns, "name", "value").select(F.lit("measure").alias("section"), "name", "value")
    named = train.sparkSession.createDataFrame([("coefficient", c, w) for c, w in zip(cols, weights, strict=True)], "section string, name string, value double")
    return named.unionByName(measures).unionByName(table)


def linear_reproduction(df: DataFrame, by: list[str], x: str, score: str) -> DataFrame:
    """Slope, intercept and R2 of the score on one column, by group, in one pass."""
    return df.groupBy(*by).agg(F.regr_slope(score, x).alias("slope"), F.regr_intercept(score, x).alias("intercept"), F.regr_r2(score, x).alias("r2"))


def isotonic_scores(fit: DataFrame, rows: DataFrame, y: str, score: str, digits: int = 6) -> DataFrame:
    """rows with calibrated: a non-decreasing map from score to rate, fitted on means per rounded score.

    Rounding bounds the fit to 10^digits + 1 weighted points, whatever the number of rows.
    """
    points = fit.groupBy(F.round(score, digits).alias("s")).agg(F.avg(F.col(y).cast("double")).alias("rate"), F.count("*").cast("double").alias("n"))
    vector = lambda df, c: VectorAssembler(inputCols=[c], outputCol="_features").transform(df)
    model = IsotonicRegression(featuresCol="_features", labelCol="rate", weightCol="n").fit(vector(points, "s"))
    out = model.transform(vector(rows, score))
    return out.withColumn("calibrated", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("prediction")))).drop("_features", "prediction")


def calibration_decision(rows: DataFrame, y: str, raw: str, calibrated: str) -> DataFrame:
    """Brier scores before and after, skill against the prevalence, and how the score may be shown."""
    brier = lambda c: F.avg(F.pow(F.col(c) - F.col(y), 2))
    out = rows.agg(brier(raw).alias("brier_raw"), brier(calibrated).alias("brier_calibrated"), F.avg(F.col(y).cast("double")).alias("rate"))
    skill = 1 - F.col("brier_calibrated") / F.nullif(F.col("rate") * (1 - F.col("rate")), F.lit(0.0))
    good = (F.col("brier_calibrated") <= F.col("brier_raw")) & (skill > 0)
    return out.withColumn("skill", skill).withColumn("decision", F.when(good, "display_as_probability").otherwise("display_as_priority_score_only"))


def _lags(n: int) -> tuple[int, ...]:
    """Lags that a series of n values can learn from: at least as many rows as lags must be left."""
    return tuple(k for k in RIDGE_LAGS if n - k >= len(RIDGE_LAGS)) if n > max(RIDGE_LAGS) else tuple(k for k in RIDGE_LAGS if k <= max(1, n // 3))


def _design(history: np.ndarray, day: int, lags: tuple[int, ...]) -> np.ndarray:
    """Features of the value that follows history; day: that value's day since 1970 (a Thursday)."""
    week, year = 2 * np.pi * ((day + 3) % 7) / 7, 2 * np.pi * (day % 365.25) / 365.25
    stats = [x for n in (7, 28) if n <= max(lags) for x in (history[-n:].mean(), history[-n:].std())]
    return np.array([*(history[-k] for k in lags), *stats, np.sin(week), np.cos(week), np.sin(year), np.cos(year)])


def ridge_path(y: np.ndarray, horizon: int, alpha: float = 5.0, last_day: int = 0) -> tuple[np.ndarray, float]:
    """Forecasts by an autoregressive ridge that feeds on its own values, and the spread of its errors.

    Lags of 1, 2, 3, 7, 14 and 28 days, means and deviations of 7 and 28, and places in the week and year; short series
    use the shorter ones. Values are kept within the series' middle 99 % and a margin: a quarter of that range, or two
    spreads if that is more.
    """
    lags = _lags(len(y))
    first = max(lags)
    if len(y) < first + 3:
        return np.full(horizon, y[-1] if len(y) else 0.0), float(np.std(y)) if len(y) else 0.0
    start = last_day - len(y) + 1
    x = np.array([_design(y[:t], start + t, lags) for t in range(first, len(y))])
    t, mean, scale = y[first:], x.mean(0), x.std(0)
    scale[scale == 0] = 1
    z = (x - mean) / scale
    w = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (t - t.mean()))
    sigma = float(np.std(t - t.mean() - z @ w))
    path, (low, high) = list(y), np.quantile(y, (0.005, 0.995))
    margin = max((high - low) * 0.25, 2 * sigma)
    for step in range(1, horizon + 1):
        value = t.mean() + (_design(np.array(path[-28:]), last_day + step, lags) - mean) / scale @ w
        path.append(float(np.clip(value, low - margin, high + margin)))
    return np.array(path[len(y) :]), sigma


def _day_number(days: pd.Series) -> int:
    return int(pd.Timestamp(days.iloc[-1]).value // 86_400_000_000_000)


def ridge_forecast(df: DataFrame, key: str, day: str, y: str, horizon: int = 7, z: float = 1.645) -> DataFrame:
    """key, step, forecast, lower, upper: one series per group; the band widens with the step and is never negative."""
    kind = df.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(day)
        path, sigma = ridge_path(pdf[y].to_numpy(float), horizon, last_day=_day_number(pdf[day]))
        step = np.arange(1, horizon + 1)
        half = z * sigma * np.sqrt(1 + step / 7)
        return pd.DataFrame({key: pdf[key].iloc[0], "step": step, "forecast": np.maximum(path, 0), "lower": np.maximum(path - half, 0), "upper": np.maximum(path + half, 0)})

    return df.select(key, day, y).groupBy(key).applyInPandas(run, f"{key} {kind}, step int, forecast double, lower double, upper double")


def boosted_forecast(df: DataFrame, key: str, day: str, y: str, horizon: int = 7, iterations: int = 60) -> DataFrame:
    """key, step, forecast, never negative: one model over all series for the value `step` days ahead.

    Features are the lag matrix at the last known day, the step, and the series' own mean and deviation, so all series
    share one fit over all rows and none is fitted in one task. They are made once and stored.
    """
    rows = lag_matrix(df.select(key, day, y), key, day, y)
    w, whole = Window.partitionBy(key).orderBy(day), Window.partitionBy(key)
    rows = rows.withColumns({"_mean": F.avg(y).over(whole), "_std": F.stddev_pop(y).over(whole), "_last": F.max(day).over(whole)})
    cols = [c for c in rows.columns if c not in (key, day, "_last")]
    ahead = rows.withColumn("_future", F.array(*[F.struct(F.lit(k).alias("step"), F.lead(y, k).over(w).alias("target")) for k in range(1, horizon + 1)]))
    ahead = store.stored(ahead.select(key, day, "_last", *[F.coalesce(c, "_mean").cast("double").alias(f"f_{c}") for c in cols], "_future"))
    names = [f"f_{c}" for c in cols] + ["f_step"]
    long = ahead.select("*", F.explode("_future").alias("x")).select("*", F.col("x.step").cast("double").alias("f_step"), F.col("x.target").cast("double").alias("target")).drop("x", "_future").dropna(subset=names)
    trees = boosting.fit(long.where("target IS NOT NULL"), names, "target", logistic=False, iterations=iterations, rate=0.1)
    out = long.where(F.col(day) == F.col("_last")).withColumn("prediction", boosting.raw_score(trees, [F.col(c) for c in names]))
    return out.select(key, F.col("f_step").cast("int").alias("step"), F.greatest(F.lit(0.0), "prediction").alias("forecast"))


def rolling_backtest(df: DataFrame, key: str, day: str, y: str, folds: int = 3, horizon: int = 7) -> DataFrame:
    """key, method, fold, mae, wape_pct, bias of the ridge, the last value and the seasonal naive at rolling origins."""
    kind = df.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(day)
        values, last, out = pdf[y].to_numpy(float), _day_number(pdf[day]), []
        for fold in range(folds):
            end = len(values) - (folds - fold) * horizon
            if end < 7:
                continue
            past, real = values[:end], values[end : end + horizon]
            for method, guess in (("ridge", ridge_path(past, horizon, last_day=last - (len(values) - end))[0]), ("last_value", np.full(horizon, past[-1])), ("seasonal_naive", np.resize(past[-7:], horizon))):
                e = guess - real
                out.append((pdf[key].iloc[0], method, fold, np.abs(e).mean(), 100 * np.abs(e).sum() / max(np.abs(real).sum(), 1e-12), e.mean()))
        return pd.DataFrame(out, columns=[key, "method", "fold", "mae", "wape_pct", "bias"])

    return df.select(key, day, y).groupBy(key).applyInPandas(run, f"{key} {kind}, method string, fold int, mae double, wape_pct double, bias double")


def champion(backtest: DataFrame, key: str, baseline: str = "seasonal_naive", gain: float = 0.01, win_rate: float = 2 / 3) -> DataFrame:
    """The best method by series if it is at least `gain` better and wins often enough, else the baseline."""
    base = backtest.where(F.col("method") == baseline).select(key, "fold", F.col("mae").alias("base_mae"))
    other = backtest.where(F.col("method") != baseline).join(base, [key, "fold"])
    totals = other.groupBy(key, "method").agg(F.avg("mae").alias("mae"), F.avg("base_mae").alias("base_mae"), F.avg((F.col("mae") < F.col("base_mae")).cast("double")).alias("wins"))
    better = (F.col("mae") <= (1 - gain) * F.col("base_mae")) & (F.round("wins", 9) >= round(win_rate, 9))
    best = totals.groupBy(key).agg(F.min_by(F.struct("method", "mae", "wins"), F.when(better, F.struct(F.col("mae").alias("m"), "method"))).alias("b"), F.max("base_mae").alias("base_mae"))
    return best.select(key, F.coalesce("b.method", F.lit(baseline)).alias("method"), F.coalesce("b.mae", "base_mae").alias("mae"), "base_mae")


def risk_band(forecasts: DataFrame, key: str, threshold: float, draws: int = 150, seed: str = "band") -> DataFrame:
    """Share of simulated paths above the threshold at each step, and the 10 % and 90 % points of the paths.

    Draws are hash-seeded normals (one per series, draw and step), so reruns agree on any cluster.
    """
    uniform = lambda tag: (F.pmod(F.xxhash64(F.lit(seed + tag), key, "step", "draw"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    normal = F.sqrt(-2 * F.log(uniform("a"))) * F.cos(2 * np.pi * uniform("b"))
    rows = forecasts.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("value", F.col("forecast") + normal * (F.col("upper") - F.col("lower")) / 3.29)
    return rows.groupBy(key, "step").agg(F.avg((F.col("value") > threshold).cast("double")).alias("risk"), F.percentile("value", 0.1).alias("p10"), F.percentile("value", 0.9).alias("p90"))


def permutation_attribution(targets: DataFrame, key: str, cols: list[str], background: DataFrame, scorer: Callable[[Column], Column], draws: int = 24, most: int = 120, seed: str = "attribution") -> DataFrame:
    """key, feature, value, rank: mean change of the score as features go from a background row to the target in random order.

    background is a reference set of at most `most` rows, chosen by hash, as the method needs a bounded one. The values
    of a target add up to its score less the mean score of the background rows drawn.
    """
    n = len(cols)
    values = F.array(*[F.col(c).cast("double") for c in cols])
    order = Window.orderBy("_h", "b")
    pool = background.select(values.alias("b")).withColumn("_h", F.xxhash64(F.lit(seed), "b")).orderBy("_h", "b").limit(most)
    pool = pool.select((F.row_number().over(order) - 1).alias("slot"), "b")
    size = pool.agg(F.count("*").alias("_n"))
    rows = targets.select(key, values.alias("x"), F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).crossJoin(F.broadcast(size))
    rows = rows.withColumn("slot", F.pmod(F.xxhash64(F.lit(seed), key, "draw"), F.col("_n")).cast("int")).join(F.broadcast(pool), "slot")
    ranked = F.array_sort(F.array(*[F.struct(F.xxhash64(F.lit(f"{seed}{i}"), key, "draw").alias("h"), F.lit(i).alias("i")) for i in range(n)]))
    rows = rows.withColumn("path", F.transform(ranked, lambda s: s["i"]))
    state = lambda k: F.array(*[F.when(F.array_position("path", i) <= k, F.col("x")[i]).otherwise(F.col("b")[i]) for i in range(n)])
    rows = rows.withColumns({f"_s{k}": scorer(state(k)) for k in range(n + 1)})
    steps = F.array(*[F.struct(F.col("path")[k].alias("i"), (F.col(f"_s{k + 1}") - F.col(f"_s{k}")).alias("v")) for k in range(n)])
    names = F.array(*map(F.lit, cols))
    out = rows.select(key, F.explode(steps).alias("s")).groupBy(key, names[F.col("s.i")].alias("feature")).agg(F.avg("s.v").alias("value"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.abs(F.round("value", 9)).desc(), "feature")))
