"""Queries of fitted models, exact intervals, attributions and of aggregates that the engines spell differently."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import clopper_pearson, poisson_interval
from ..operators import forecast, labels, metrics, models, ranks, timeseries
from ..sources import store
from . import adapters
from .adapters import rounded

T = adapters.frame
SIGNALS = ["feed_rate", "hour_of_day", "lag_1", "mean_4"]


def _features(spark, sf_dir) -> DataFrame:
    """Readings with their label (does the entity fail within a day) and causal features only."""
    w = Window.partitionBy("tag").orderBy("ts", "event_id")
    rows = T(spark, sf_dir, "readings").select("event_id", "tag", "ts", "feed_rate")
    rows = timeseries.asof_join(rows, T(spark, sf_dir, "incidents").select("tag", "failure_date"), "tag", "ts", "failure_date", "forward", False, [])
    soon = F.coalesce(timeseries.seconds("asof_ts") - timeseries.seconds("ts") <= 86400, F.lit(False))
    return rows.select("event_id", "tag", "ts", "feed_rate", F.hour("ts").cast("double").alias("hour_of_day"), F.lag("feed_rate").over(w).alias("lag_1"), F.avg("feed_rate").over(w.rowsBetween(-4, -1)).alias("mean_4"), soon.cast("int").alias("y"))


def _boosted(spark, sf_dir):
    rows = store.stored(_features(spark, sf_dir))
    cut = F.lit(labels.split_boundaries(rows, "ts").first().test_start).cast("timestamp_ntz")
    return models.boosted_scores(rows.where(F.col("ts") < cut), rows.where(F.col("ts") >= cut), SIGNALS, "y").select("event_id", "y", "score")


def _risk_model(spark, sf_dir):
    """Fitted on the first 80 % of days, judged on the others."""
    rows = store.stored(_features(spark, sf_dir).na.drop(subset=SIGNALS).select(*SIGNALS, "ts", "y"))
    day = rows.select(F.unix_date(F.to_date("ts")).alias("d")).agg(F.percentile("d", 0.8).alias("cut"))
    rows = rows.crossJoin(F.broadcast(day)).withColumn("fit", F.unix_date(F.to_date("ts")) <= F.col("cut"))
    score, _ = models.logistic_fit(rows.where("fit"), SIGNALS, "y")
    valid = score(rows.where("NOT fit"))
    return metrics.roc_auc(valid, [], "y", "score")


def _isotonic(spark, sf_dir):
    s = T(spark, sf_dir, "scored")
    return models.isotonic_scores(s.where("split = 'validation'"), s.where("split = 'test'"), "y", "score")


def _daily(spark, sf_dir):
    return T(spark, sf_dir, "readings").groupBy("tag", F.to_date("ts").alias("day")).agg(F.avg("feed_rate").alias("rate"))


def _plant_days(spark, sf_dir):
    """Energy of each plant by day, without gaps."""
    days = T(spark, sf_dir, "environment").groupBy("plant", F.to_date("ts").alias("day")).agg(F.sum("energy_kwh").alias("y"))
    return forecast.on_calendar(days, "plant", "day", "y").drop("filled")


def _last_value_or_ridge(spark, sf_dir):
    return models.rolling_backtest(_plant_days(spark, sf_dir), "plant", "day", "y", folds=1, horizon=30).where("method IN ('ridge', 'last_value')").select("plant", "method", "mae")


def _champion(spark, sf_dir):
    """Candidates whose errors need no fit: the last value, and the mean of seven days against the value of a week ago."""
    w = Window.partitionBy("tag").orderBy("day")
    f = _daily(spark, sf_dir).withColumns({"last_value": F.lag("rate").over(w), "mean_7": F.avg("rate").over(w.rowsBetween(-7, -1)), "seasonal_naive": F.lag("rate", 7).over(w), "fold": F.date_trunc("week", "day").cast("date")})
    long = f.where("seasonal_naive IS NOT NULL").unpivot(["tag", "fold", "rate"], ["last_value", "mean_7", "seasonal_naive"], "method", "guess")
    back = long.groupBy("tag", "method", "fold").agg(F.round(F.avg(F.abs(F.col("guess") - F.col("rate"))), 9).alias("mae"))
    return rounded(models.champion(back, "tag"))


CHAMPION_SQL = """WITH d AS (SELECT tag, CAST(ts AS DATE) AS day, avg(feed_rate) AS rate FROM {readings} GROUP BY 1, 2), f AS (SELECT tag, day, rate, date_trunc('week', day) AS fold, lag(rate) OVER w AS a, avg(rate) OVER (PARTITION BY tag ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS m, lag(rate, 7) OVER w AS s FROM d WINDOW w AS (PARTITION BY tag ORDER BY day)),
e AS (SELECT tag, fold, round(avg(abs(a - rate)), 9) AS ea, round(avg(abs(m - rate)), 9) AS em, round(avg(abs(s - rate)), 9) AS es FROM f WHERE s IS NOT NULL GROUP BY tag, fold),
t AS (SELECT tag, 'last_value' AS method, avg(ea) AS mae, avg(es) AS base_mae, avg((ea < es)::INT) AS wins FROM e GROUP BY tag UNION ALL SELECT tag, 'mean_7', avg(em), avg(es), avg((em < es)::INT) FROM e GROUP BY tag),
b AS (SELECT *, mae <= 0.99 * base_mae AND round(wins, 9) >= round(2 / 3, 9) AS better FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY better DESC, mae, method) AS i FROM b)
SELECT tag, CASE WHEN better THEN method ELSE 'seasonal_naive' END AS method, round(CASE WHEN better THEN mae ELSE base_mae END, 6) AS mae, round(base_mae, 6) AS base_mae FROM r WHERE i = 1"""


def _band(spark, sf_dir):
    return models.risk_band(models.ridge_forecast(_plant_days(spark, sf_dir), "plant", "day", "y"), "plant", 60_000.0)


def _intervals(spark, sf_dir):
    c = T(spark, sf_dir, "scored").groupBy("split").agg(F.count_if((F.col("score") >= 0.5) & (F.col("y") == 1)).alias("k"), F.count_if(F.col("y") == 1).alias("n"))
    return c.withColumn("i", clopper_pearson("k", "n")).select("split", "k", "n", "i.lower", "i.upper")


def _rates(spark, sf_dir):
    c = T(spark, sf_dir, "incidents").groupBy("tag").agg(F.count("*").alias("failures")).withColumn("months", F.lit(1.0))
    return c.withColumn("i", poisson_interval("failures", "months")).select("tag", "failures", "i.lower", "i.upper")


def with_schedule(spark, sf_dir) -> DataFrame:
    """Scored rows with days, the time since the entity's last incident."""
    rows = timeseries.asof_join(T(spark, sf_dir, "scored"), T(spark, sf_dir, "incidents").select("tag", "failure_date"), "tag", "ts", "failure_date", "backward", False, [])
    start = F.coalesce("asof_ts", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    return rows.withColumn("days", F.round((timeseries.seconds("ts") - timeseries.seconds(start)) / 86400, 6))


def _schedule_baseline(spark, sf_dir):
    rows, each = with_schedule(spark, sf_dir).persist(), []
    for m, c in (("model", "score"), ("schedule", "days")):
        auc, ap = metrics.roc_auc(rows, ["split"], "y", c), metrics.average_precision(rows, ["split"], "y", c)
        each.append(auc.join(ap, "split").select("split", F.lit(m).alias("method"), "roc_auc", "average_precision"))
    return rounded(each[0].unionByName(each[1]))


def _auc_sql(method: str, c: str) -> str:
    return f"""SELECT split, '{method}' AS method, round((sum(CASE WHEN y = 1 THEN k END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS roc_auc, round(sum(CASE WHEN y = 1 THEN above / n END) / sum(y), 6) AS average_precision
 FROM (SELECT split, y, rank() OVER (PARTITION BY split ORDER BY {c}) + (count(*) OVER (PARTITION BY split, {c}) - 1) / 2.0 AS k, sum(y) OVER (PARTITION BY split ORDER BY {c} DESC) AS above, count(*) OVER (PARTITION BY split ORDER BY {c} DESC) AS n FROM s) x GROUP BY split"""


SCHEDULE_CTE = "s AS (SELECT o.*, round((epoch_us(o.ts) - epoch_us(coalesce(i.failure_date, TIMESTAMP '2024-01-01'))) / 8.64e10, 6) AS days FROM {scored} o ASOF LEFT JOIN {incidents} i ON o.tag = i.tag AND o.ts > i.failure_date)"
SCHEDULE_SQL = f"WITH {SCHEDULE_CTE} {_auc_sql('model', 'score')} UNION ALL {_auc_sql('schedule', 'days')}"


def _binned(spark, sf_dir):
    """Deciles of a signal: edges from exact quantiles, then one pass over the rows."""
    s = T(spark, sf_dir, "readings").join(T(spark, sf_dir, "scored").select("event_id", "y"), "event_id").select("feed_rate", "y")
    edges = ranks.quantiles(s, "feed_rate", [i / 10 for i in range(1, 10)])
    rows = s.withColumn("bin", F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col("feed_rate"))).cast("long"))
    return rounded(rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg("feed_rate").alias("mean_value"), F.avg(F.col("y").cast("double")).alias("event_rate"), F.sum(F.col("y").cast("long")).alias("events")))


BINNED_SQL = """WITH s AS (SELECT r.feed_rate, o.y FROM {readings} r JOIN {scored} o USING (event_id)), e AS (SELECT quantile_cont(feed_rate, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM s)
SELECT len(list_filter(q, lambda x: x < feed_rate))::BIGINT AS bin, count(*) AS n, round(avg(feed_rate), 6) AS mean_value, round(avg(y), 6) AS event_rate, sum(y)::BIGINT AS events FROM s CROSS JOIN e GROUP BY 1"""


def _cases(spark, sf_dir):
    """One text per case: its turns in order."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))))
    c = T(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("t"))
    return c.select("conv_id", F.size("t").cast("long").alias("turns"), F.md5(F.array_join(F.transform("t", lambda x: x["text"]), " | ")).alias("text_md5"))


CASES_SQL = "SELECT conv_id, count(*) AS turns, md5(string_agg(coalesce(text, ''), ' | ' ORDER BY turn, role, coalesce(text, ''))) AS text_md5 FROM {conversations} GROUP BY conv_id"


def _pm_period(spark, sf_dir):
    w = Window.partitionBy("tag").orderBy("scheduled_date", "pm_id")
    rows = T(spark, sf_dir, "pm_schedule").withColumn("gap", F.date_diff("scheduled_date", F.lag("scheduled_date").over(w)) / 30.4375)
    return rounded(rows.groupBy("tag").agg(F.percentile("gap", 0.5).alias("period_months"), F.avg((F.col("status") == "Missed").cast("double")).alias("miss_rate")))


PERIOD_SQL = """WITH g AS (SELECT tag, status, (scheduled_date - lag(scheduled_date) OVER (PARTITION BY tag ORDER BY scheduled_date, pm_id)) / 30.4375 AS gap FROM {pm_schedule})
SELECT tag, round(quantile_cont(gap, 0.5)::DOUBLE, 6) AS period_months, round(avg((status = 'Missed')::INT), 6) AS miss_rate FROM g GROUP BY tag"""

def _episode_intervals(spark, sf_dir):
    """Exact intervals on what operational metrics count: found events, true episodes, false episodes a month."""
    from . import catalog

    m = metrics.operational_metrics(catalog._operational(spark, sf_dir), 0.6)
    m = m.withColumns({"event": clopper_pearson("detected", "events"), "episode": clopper_pearson("true_episodes", "episodes"), "rate": poisson_interval("false_episodes", "exposure_months")})
    names = [F.col(f"{k}.{b}").alias(f"{k}_{b}") for k in ("event", "episode", "rate") for b in ("lower", "upper")]
    return m.select("threshold", "events", "detected", "episodes", "true_episodes", "false_episodes", "exposure_months", *names)


OPERATORS = {
    "agg27_case_text": (_cases, CASES_SQL),
    "agg32_binned_outcome": (_binned, BINNED_SQL),
    "agg38_pm_period": (_pm_period, PERIOD_SQL),
    "sta6_schedule_baseline": (_schedule_baseline, SCHEDULE_SQL),
    "fc6_champion": (_champion, CHAMPION_SQL),
    "ml5_linear_reproduction": (lambda s, d: rounded(models.linear_reproduction(T(s, d, "scored").join(T(s, d, "readings").select("event_id", "feed_rate"), "event_id"), ["split"], "feed_rate", "score")), "SELECT split, round(regr_slope(score, feed_rate), 6) AS slope, round(regr_intercept(score, feed_rate), 6) AS intercept, round(regr_r2(score, feed_rate), 6) AS r2 FROM {scored} s JOIN {readings} r USING (event_id) GROUP BY split"),
    "ml1_class_weights": (lambda s, d: rounded(models.class_weights(T(s, d, "scored"), "y").groupBy("y").agg(F.count("*").alias("n"), F.max("weight").alias("weight"))), "SELECT y, count(*) AS n, round((SELECT count(*) FROM {scored}) / (2.0 * count(*)), 6) AS weight FROM {scored} GROUP BY y"),
    "ml2_boosted_trees": (_boosted, None),
    "ml4_association": (lambda s, d: models.association(_features(s, d), SIGNALS, "y"), None),
    "ml6_risk_model": (_risk_model, None),
    "sta1_exact_share": (_intervals, None),
    "sta3_exact_rate": (_rates, None),
    "sta4_episode_intervals": (_episode_intervals, None),
    "fc3_boosted_forecast": (lambda s, d: models.boosted_forecast(_daily(s, d), "tag", "day", "rate"), None),
    "sta7_isotonic": (lambda s, d: _isotonic(s, d).select("event_id", "calibrated"), None),
    "sta9_calibration_decision": (lambda s, d: models.calibration_decision(_isotonic(s, d), "y", "score", "calibrated"), None),
    "fc2_ridge_forecast": (lambda s, d: models.ridge_forecast(_plant_days(s, d), "plant", "day", "y", 30), None),
    "fc4_holdout": (_last_value_or_ridge, None),
    "fc7_rolling_backtest": (lambda s, d: models.rolling_backtest(_plant_days(s, d), "plant", "day", "y", horizon=30), None),
    "fc8_risk_band": (_band, None),
}
