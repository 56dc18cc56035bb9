"""Queries of fitted failure models: scores out of fold, the choice of a split, thresholds from rolling validation, saved
models, stress tests and attributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import hardening, labels, quality, ranks, stress
from ..sources import store
from . import adapters, catalog
from .adapters import rounded

T = adapters.frame
FEATURES, SIGNALS = catalog.FEATURES, ("feed_rate", "hour_of_day")
#: Days ahead of the nearer and the farther label; days of recovery hours as in the other queries.
NEAR, FAR, RECOVERY = 1, 3, 6
ACTION = {"min_event_recall": 0.8, "min_lead_days": 3.0, "max_false_days": 1.0}
WARNING = {"min_event_recall": 0.9, "min_lead_days": 3.0, "max_false_days": 3.0}


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Causal features of every reading with the labels of both horizons."""
    rows = labels.failure_labels(catalog._signal_rows(spark, sf_dir), T(spark, sf_dir, "incidents"), (NEAR, FAR), RECOVERY)
    named = {f"y_{h}d": F.col(f"failure_within_{h}d").cast("int") for h in (NEAR, FAR)}
    return rows.withColumns(named).select("event_id", "tag", "ts", *FEATURES, *named, "next_failure_date", "days_to_next_failure")


def held_out() -> Column:
    """Entities that no model is trained on."""
    return F.col("tag") % 10 == 0


def _test_start(rows: DataFrame):
    return F.lit(labels.split_boundaries(rows, "ts").first().test_start).cast("timestamp_ntz")


def _logistic(horizon: int, y: str = "y"):
    return lambda train: hardening.logistic(train, FEATURES, y, horizon).score


def _rolling_scores(spark, sf_dir) -> DataFrame:
    rows = store.stored(_rows(spark, sf_dir).withColumn("y", F.col(f"y_{NEAR}d")))
    return hardening.out_of_fold(rows, _logistic(NEAR), _test_start(rows), NEAR, held_out=held_out())


def _rolling(spark, sf_dir):
    return rounded(_rolling_scores(spark, sf_dir).select("event_id", "tag", "ts", "split", "fold", "trained_before", "y", "score"))


def _rolling_hardening(spark, sf_dir):
    """Thresholds of the model's own rolling validation, and what they give on it and on the test."""
    scored = store.stored(_rolling_scores(spark, sf_dir))
    return rounded(hardening.hardening_report(hardening.harden(scored, ACTION, WARNING, strict=True)))


def _hardening(spark, sf_dir):
    """The given scores, of which the split `validation` is the rolling one."""
    split = T(spark, sf_dir, "scored").select("event_id", "split")
    scored = catalog._operational(spark, sf_dir).join(split, "event_id")
    return rounded(hardening.hardening_report(hardening.harden(scored, ACTION, WARNING, strict=True, rolling="validation")))


def _choice_sql(name: str, limits: dict, cap: str = "TRUE") -> str:
    """{name}: the threshold of the curve `cu` that the limits choose, and whether it keeps them all."""
    recall, lead, days = limits["min_event_recall"], limits["min_lead_days"], limits["max_false_days"]
    return f"""{name}t AS (SELECT *, coalesce(event_recall, 0) >= {recall} AND coalesce(median_lead_days, 0) >= {lead} AS safe, false_days_per_month <= {days} AS quiet FROM cu WHERE {cap}),
{name}k AS (SELECT *, CASE WHEN safe AND quiet THEN 0 WHEN safe THEN 1 ELSE 2 END AS tier, CASE WHEN safe AND quiet THEN 0 WHEN safe THEN greatest(0, false_days_per_month - {days}) / {days}
  ELSE greatest(0, {recall} - coalesce(event_recall, 0)) / {recall} + greatest(0, {lead} - coalesce(median_lead_days, 0)) / {lead} END AS short FROM {name}t),
{name} AS (SELECT threshold, tier = 0 AS kept FROM {name}k ORDER BY tier, round(short, 9), CASE WHEN tier = 2 THEN round(-event_recall, 9) END, round(false_days_per_month, 9), round(false_episodes_per_month, 9),
  round(-precision, 9), round(-event_recall, 9), CASE WHEN tier = 0 THEN round(-median_lead_days, 9) END, threshold DESC LIMIT 1)"""


HARDENING_SQL = f"""WITH {catalog.OPERATIONAL_CTE.replace("l AS (SELECT event_id", "l0 AS (SELECT event_id")}, l1 AS (SELECT l0.*, s.split FROM l0 JOIN {{scored}} s USING (event_id)), l AS (SELECT * EXCLUDE (split) FROM l1 WHERE split = 'validation'),
{catalog.GRID_CTE}, {catalog.CURVE_CTE}, {_choice_sql("ac", ACTION)}, {_choice_sql("wa", WARNING, "threshold <= (SELECT threshold FROM ac) + 1e-12")},
hh AS (SELECT l1.*, (score >= ac.threshold)::INT AS ha, (score >= wa.threshold)::INT AS hw, ac.threshold AS ta, wa.threshold AS tw, ac.kept FROM l1 CROSS JOIN ac CROSS JOIN wa),
pp AS (SELECT *, ha = 1 AND sum(ha) OVER w >= 3 AS al2, hw = 1 AND sum(hw) OVER w >= 3 AS wl FROM hh WINDOW w AS (PARTITION BY split, tag ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))
SELECT split, round(ta, 6) AS action_threshold, round(tw, 6) AS warning_threshold, count(*) AS n, count(*) FILTER (al2) AS action_rows, count(*) FILTER (wl) AS warning_rows, count(*) FILTER (al2 AND y = 1) AS tp,
 count(*) FILTER (al2 AND y = 0) AS fp, count(*) FILTER (NOT al2 AND y = 1) AS fn, CASE WHEN bool_and(kept) THEN 'INSPECTION_PRIORITY_BASELINE' ELSE 'EXPERIMENTAL' END AS release FROM pp GROUP BY split, ta, tw"""


def _split_choice(spark, sf_dir):
    """All eight candidates, both horizons; a horizon's label is y_<h>d."""
    rows = store.stored(_rows(spark, sf_dir))
    return rounded(hardening.search_splits(rows, {h: _logistic(h) for h in (NEAR, FAR)}, held_out=held_out()))


_saved: dict[tuple[str, str], str] = {}


def models_of(spark: SparkSession, sf_dir: str) -> tuple[dict[int, hardening.FailureModel], DataFrame, DataFrame]:
    """The models of both horizons, the rows they were made from and the profile of their training rows. The fits are made
    once a session and table (again once store.drop_stored() has dropped them), with the 98 % and 90 % points of the training
    scores as thresholds of action and warning, saved and loaded from there: boosted trees for the nearer horizon, a logistic fit for the
    farther one."""
    key = spark.sparkContext.applicationId, sf_dir
    if not store.held(spark, _saved.get(key)):
        rows, path = store.stored(_rows(spark, sf_dir)), store.scratch(spark)
        start = _test_start(rows)
        for h, kind in ((NEAR, hardening.boosted), (FAR, hardening.logistic)):
            y = f"y_{h}d"
            train = rows.where(F.col(y).isNotNull() & (F.col("ts") < start - F.make_dt_interval(days=F.lit(h))) & ~held_out())
            model = kind(train, FEATURES, y, h)
            model.action, model.warning = ranks.quantiles(model.score(train), "score", [0.98, 0.9])
            model.save(f"{path}/{h}d")
        rows = rows.withColumn("before_test", F.col("ts") < start)
        rows.write.parquet(f"{path}/rows")
        quality.feature_profile(rows.where("before_test"), FEATURES).coalesce(1).write.parquet(f"{path}/profile")
        _saved[key] = path
    path = _saved[key]
    return {h: hardening.FailureModel.load(spark, f"{path}/{h}d") for h in (NEAR, FAR)}, spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/profile")


def _saved_model(spark, sf_dir):
    """Every row after training, scored by the models as loaded; a score that is no probability fails the query."""
    found, rows, _ = models_of(spark, sf_dir)
    out = rows.where("NOT before_test").select("event_id", *FEATURES)
    for h, m in found.items():
        out = m.score(out, f"score_{h}d", "event_id")
    return out.select("event_id", *[f"score_{h}d" for h in found])


def _stressed(spark, sf_dir):
    found, rows, profile = models_of(spark, sf_dir)
    limits = {h: (m.action, m.warning) for h, m in found.items()}
    last = last_rows(rows, 12)

    def score(df: DataFrame) -> DataFrame:
        for h, m in found.items():
            df = m.score(df, f"score_{h}d", "event_id")
        return df

    return stress.stressed_risk(last, score, limits, profile, FEATURES, SIGNALS, now=catalog.at("2024-02-01 00:00:00"), short=4, long=12), limits


def last_rows(rows: DataFrame, n: int) -> DataFrame:
    """The last n rows of each entity."""
    w = Window.partitionBy("tag").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return rows.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= n).select("tag", "ts", "event_id", *FEATURES)


def _stability(spark, sf_dir):
    rows, limits = _stressed(spark, sf_dir)
    return rounded(stress.stability(store.stored(rows), limits))


GROUPS = {"feed_rate": "flow", "hour_of_day": "calendar"}


def _attributed(spark, sf_dir):
    """The boosted model's log odds on each entity's latest row, against rows it was trained on."""
    found, rows, _ = models_of(spark, sf_dir)
    model, latest, background = found[NEAR], last_rows(rows, 1).select("tag", *FEATURES), rows.where("before_test").select(*FEATURES)
    score = lambda df: model.score(df).withColumn("score", stress.log_odds(F.col("score")))
    return stress.attribution(latest, "tag", FEATURES, background, score), latest, background


def _attribution_table(spark, sf_dir):
    values, latest, background = _attributed(spark, sf_dir)
    return rounded(stress.attribution_table(values, "tag", latest, background, FEATURES, GROUPS, 5))


#: name: (query, SQL or None)
OPERATORS = {
    "met10_hardening": (_hardening, HARDENING_SQL),
    "met10_rolling_scores": (_rolling, None),
    "met10_rolling_hardening": (_rolling_hardening, None),
    "spl3_split_choice": (_split_choice, None),
    "ml3_saved_models": (_saved_model, None),
    "rob1_scenarios": (lambda s, d: rounded(_stressed(s, d)[0], 9), None),
    "rob2_stability": (_stability, None),
    "exp1_attribution": (lambda s, d: rounded(_attributed(s, d)[0], 9), None),
    "exp2_attribution_table": (_attribution_table, None),
}
