"""Backtests whose origins are rows: a fold of a series is a group like any other, not a turn of a loop inside one."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import models

BASELINE = "seasonal_naive"
RETAINED, BEATEN = "weekly_baseline_retained_by_guardrail", "beats_weekly_baseline_and_passes_consistency_guardrail"


def rolling_origins(df: DataFrame, key: str, day: str, folds: int = 3, horizon: int = 30, least: int = 90) -> DataFrame:
    """key, fold, training_days, train_end, validation_end: the last `folds` stretches of `horizon` days of each series.

    df has every day of a series (see forecast.on_calendar()). Folds whose training is shorter than `least` are left out.
    """
    spans = df.groupBy(key).agg(F.min(day).alias("first"), F.count("*").alias("n"))
    rows = spans.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds))))
    rows = rows.withColumn("training_days", (F.col("n") - (folds - F.col("fold") + 1) * horizon).cast("int")).where(F.col("training_days") >= least)
    at = lambda n: F.date_add("first", (n - 1).cast("int"))
    return rows.select(key, "fold", "training_days", at(F.col("training_days")).alias("train_end"), at(F.col("training_days") + horizon).alias("validation_end"))


def _trained(df: DataFrame, origins: DataFrame, key: str, day: str, y: str) -> DataFrame:
    """The rows each fold may learn from."""
    return df.select(key, day, y).join(origins, key).where(F.col(day) <= F.col("train_end"))


def _copied(steps: DataFrame, df: DataFrame, key: str, day: str, y: str, back) -> DataFrame:
    """steps with forecast: the series' value on the day that `back` names."""
    source = df.select(F.col(key).alias("_k"), F.col(day).alias("_d"), F.col(y).alias("forecast"))
    return steps.withColumn("_from", back).join(source, (F.col(key) == F.col("_k")) & (F.col("_from") == F.col("_d"))).drop("_k", "_d", "_from")


def backtest(df: DataFrame, key: str, day: str, y: str, methods: tuple[str, ...] = (BASELINE, "last_value", "ridge"), folds: int = 3, horizon: int = 30, least: int = 90, season: int = 7, iterations: int = 60) -> DataFrame:
    """key, fold, method, step, day, actual, forecast, training_days, train_end: what each method said from each origin.

    seasonal_naive repeats the last season and last_value the last day, by joins; ridge is fitted in a group for each series
    and fold, boosting once a fold over all series. Forecasts know nothing after train_end.
    """
    origins = rolling_origins(df, key, day, folds, horizon, least).persist()
    steps = origins.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    known = {
        BASELINE: F.date_add("train_end", F.pmod(F.col("step") - 1, F.lit(season)) + 1 - season),
        "last_value": F.col("train_end"),
    }
    kind, parts = df.schema[key].dataType.simpleString(), []
    for method in methods:
        if method in known:
            said = _copied(steps, df, key, day, y, known[method]).select(key, "fold", "step", "forecast")
        elif method == "ridge":

            def run(pdf: pd.DataFrame) -> pd.DataFrame:
                pdf = pdf.sort_values(day)
                path, _ = models.ridge_path(pdf[y].to_numpy(float), horizon, last_day=int(pd.Timestamp(pdf[day].iloc[-1]).value // 86_400_000_000_000))
                return pd.DataFrame({key: pdf[key].iloc[0], "fold": pdf["fold"].iloc[0], "step": np.arange(1, horizon + 1), "forecast": np.maximum(path, 0)})

            said = _trained(df, origins, key, day, y).select(key, "fold", day, y).groupBy(key, "fold").applyInPandas(run, f"{key} {kind}, fold int, step int, forecast double")
        elif method == "boosting":
            each = [models.boosted_forecast(_trained(df, origins.where(F.col("fold") == f), key, day, y), key, day, y, horizon, iterations).withColumn("fold", F.lit(f)) for f in range(1, folds + 1)]
            said = each[0]
            for e in each[1:]:
                said = said.unionByName(e)
            said = said.select(key, "fold", "step", "forecast")
        else:
            raise ValueError(f"method: {method}")
        parts.append(said.withColumn("method", F.lit(method)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.join(origins, [key, "fold"]).withColumn(day, F.date_add("train_end", F.col("step")))
    return out.join(df.select(key, day, F.col(y).alias("actual")), [key, day]).select(key, "fold", "method", "step", day, "actual", "forecast", "training_days", "train_end")


def errors(said: DataFrame, key: str) -> DataFrame:
    """key, method, fold, days, mae, wape_pct (null where all is zero), bias of backtest()."""
    e = F.col("forecast") - F.col("actual")
    wape = 100 * F.sum(F.abs(e)) / F.when(F.sum(F.abs("actual")) > 1e-12, F.sum(F.abs("actual")))
    return said.groupBy(key, "method", "fold").agg(F.count("*").alias("days"), F.avg(F.abs(e)).alias("mae"), wape.alias("wape_pct"), F.avg(e).alias("bias"))


def choose(found: DataFrame, key: str, baseline: str = BASELINE, gain_pct: float = 1.0, win_rate: float = 2 / 3) -> DataFrame:
    """By series of errors(): the method with the least mean WAPE among those that beat the baseline by gain_pct on the mean
    and in win_rate of the folds, else the baseline; ties by name. With both WAPEs, the gain, the share won and the reason."""
    base = found.where(F.col("method") == baseline).select(key, "fold", F.col("wape_pct").alias("base_fold"))
    means = found.groupBy(key, "method").agg(F.avg("mae").alias("mae"), F.avg("wape_pct").alias("wape"), F.avg("bias").alias("bias"))
    wins = found.where(F.col("method") != baseline).join(base, [key, "fold"]).groupBy(key, "method").agg(F.avg(F.coalesce(F.col("wape_pct") < F.col("base_fold"), F.lit(False)).cast("double")).alias("won"))
    of_base = means.where(F.col("method") == baseline).select(key, F.col("wape").alias("baseline_wape"), F.struct("method", "mae", "wape", "bias", F.lit(1.0).alias("won")).alias("b"))
    gain = F.when(F.col("baseline_wape") > 0, 100 * (F.col("baseline_wape") - F.col("wape")) / F.col("baseline_wape")).otherwise(0.0)
    fit = means.join(wins, [key, "method"]).join(of_base.select(key, "baseline_wape"), key).where((F.round(gain, 9) >= gain_pct) & (F.round("won", 9) >= round(win_rate, 9)))
    best = fit.groupBy(key).agg(F.min_by(F.struct("method", "mae", "wape", "bias", "won"), F.struct(F.round("wape", 9), "method")).alias("f"))
    out = of_base.join(best, key, "left").withColumn("c", F.coalesce("f", "b"))
    improved = F.when(F.col("baseline_wape") > 0, 100 * (F.col("baseline_wape") - F.col("c.wape")) / F.col("baseline_wape")).otherwise(0.0)
    reason = F.when(F.col("f").isNull(), RETAINED).otherwise(BEATEN)
    return out.select(key, F.col("c.method").alias("method"), reason.alias("reason"), F.col("c.mae").alias("mae"), F.col("c.wape").alias("wape_pct"), F.col("c.bias").alias("bias"), "baseline_wape", improved.alias("gain_pct"), F.col("c.won").alias("won"))


@dataclass
class Artefacts:
    history: DataFrame
    prediction: DataFrame
    metrics: DataFrame
    backtest: DataFrame


def artefacts(df: DataFrame, key: str, day: str, y: str, horizon: int = 7, history_days: int = 30, z: float = 1.645, season: int = 7, **options) -> Artefacts:
    """What a forecast is published with, in long form: the last days, the champion's forecast with its band, the
    champion and its figures, and all that was said from each origin.

    The band is z times the spread of the champion's own backtest errors, wider with the step, and never below zero.
    options: as backtest() takes them.
    """
    said = backtest(df, key, day, y, season=season, **options).persist()
    chosen = choose(errors(said, key), key).persist()
    last = Window.partitionBy(key).orderBy(F.col(day).desc())
    history = df.select(key, day, y).withColumn("_i", F.row_number().over(last)).where(F.col("_i") <= history_days).drop("_i")
    # The origin of the forecast itself is the series' end: one more fold without a validation.
    ends = df.groupBy(key).agg(F.max(day).alias("train_end"), F.count("*").cast("int").alias("training_days")).withColumn("fold", F.lit(0))
    steps = ends.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).join(chosen.select(key, "method"), key)
    naive = F.date_add("train_end", F.pmod(F.col("step") - 1, F.lit(season)) + 1 - season)
    copied = _copied(steps.where(F.col("method") == BASELINE), df, key, day, y, naive)
    flat = _copied(steps.where(F.col("method") == "last_value"), df, key, day, y, F.col("train_end"))
    out = copied.unionByName(flat).select(key, "step", "method", "forecast")
    for method, fit in (("ridge", models.ridge_forecast), ("boosting", models.boosted_forecast)):
        mine = df.join(chosen.where(F.col("method") == method).select(key), key, "left_semi")
        if method in options.get("methods", ("ridge",)):
            out = out.unionByName(fit(mine, key, day, y, horizon).select(key, "step", F.lit(method).alias("method"), "forecast"))
    spread = said.join(chosen.select(key, "method"), [key, "method"]).groupBy(key).agg(F.stddev_pop(F.col("forecast") - F.col("actual")).alias("_s"))
    half = z * F.col("_s") * F.sqrt(1 + F.col("step") / season)
    banded = out.join(spread, key).join(ends.select(key, "train_end"), key)
    zero = F.lit(0.0)
    prediction = banded.select(
        key, "step", F.date_add("train_end", F.col("step")).alias(day), "method", F.greatest(zero, "forecast").alias("forecast"), F.greatest(zero, F.col("forecast") - half).alias("lower"), F.greatest(zero, F.col("forecast") + half).alias("upper")
    )
    return Artefacts(history, prediction, chosen, said)
