"""All registered queries: operators applied to the logical tables, each with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features, forecast, labels, metrics, quality, retrieval, risk, timeseries
from ..sources import documents as docs_source
from ..sources import store, tables
from ..streaming import flows
from . import adapters, fitted, reports, rollups
from .adapters import rounded

SQL_QUERIES = rollups.QUERIES | reports.QUERIES

T = adapters.frame
END = "2024-01-20 00:00:00"


def at(time: str) -> Column:
    return F.lit(time).cast("timestamp_ntz")


def _kpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = adapters.frames(spark, sf_dir, {"readings", "incidents", "condition_weekly", "pm_schedule", "equipment"})
    start, end = at("2024-01-05 00:00:00"), at(END)
    return rounded(risk.kpi_bundle(t["readings"], t["incidents"], t["condition_weekly"], t["pm_schedule"], t["equipment"], start, end), 4)


KPI_SQL = """WITH i AS (SELECT * FROM {incidents} WHERE failure_date >= TIMESTAMP '2024-01-05' AND failure_date < TIMESTAMP '2024-01-20'),
r AS (SELECT * FROM {readings} WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'),
w AS (SELECT * FROM {condition_weekly} WHERE week_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-19'),
l AS (SELECT coalesce(sum(rate * down), 0) AS ton, coalesce(sum(rate * down * price) / 1000, 0) AS kusd FROM (SELECT tag, sum(downtime_hours) AS down FROM i GROUP BY tag) d
  JOIN (SELECT tag, avg(feed_rate) AS rate FROM r WHERE run_status = 'ON' GROUP BY tag) a USING (tag) JOIN {equipment} USING (tag))
SELECT (SELECT count(*) FROM i) AS no_failures, round((SELECT coalesce(sum(downtime_hours), 0) FROM i), 4) AS total_downtime, round((SELECT coalesce(avg(downtime_hours), 0) FROM i), 4) AS mttr,
  (SELECT count(*) FROM r) AS period_hours, (SELECT count(DISTINCT week_date) FROM w) AS monitoring_weeks, (SELECT count(*) FILTER (health_status = 'ALARM') FROM w) AS alarm,
  (SELECT count(*) FILTER (health_status = 'TRIP') FROM w) AS trip, (SELECT count(*) FILTER (health_status = 'NORMAL') FROM w) AS normal,
  round((SELECT 100.0 * count(*) FILTER (status = 'Completed') / count(*) FROM {pm_schedule}), 4) AS pm_compliance_pct, round(ton, 4) AS production_loss_ton, round(kusd, 4) AS estimated_loss_kusd,
  round(100 * ((SELECT count(*) FROM r) - (SELECT coalesce(sum(downtime_hours), 0) FROM i)) / (SELECT count(*) FROM r), 4) AS availability_pct, round((SELECT count(*) FROM r) / (SELECT count(*) FROM i), 4) AS mtbf FROM l"""


def _rolling(spark, sf_dir):
    out = timeseries.causal_rolling(T(spark, sf_dir, "readings").select("event_id", "tag", "ts", "feed_rate"), "tag", ["ts", "event_id"], ["feed_rate"], 4, 12)
    return rounded(out.select("event_id", *[c for c in out.columns if c.startswith("feed_rate_")]))


def _windows_sql(n: int) -> str:
    w = f"OVER (PARTITION BY tag ORDER BY ts, event_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count(feed_rate) {w} >= {max(2, n // 4)} THEN avg(feed_rate) {w} END AS m{n}, CASE WHEN count(feed_rate) {w} >= {max(2, n // 4)} THEN stddev_samp(feed_rate) {w} END AS s{n}"


ROLLING_SQL = f"""SELECT event_id, round(l1, 6) AS feed_rate_lag_1h, round(l4, 6) AS feed_rate_lag_4h, round(m4, 6) AS feed_rate_mean_4h, round(s4, 6) AS feed_rate_std_4h, round(m12, 6) AS feed_rate_mean_12h,
 round(s12, 6) AS feed_rate_std_12h, round((feed_rate - m12) / nullif(s12, 0), 6) AS feed_rate_zscore_12h, round(feed_rate - l1, 6) AS feed_rate_delta_1h FROM
 (SELECT *, lag(feed_rate, 1) OVER (PARTITION BY tag ORDER BY ts, event_id) AS l1, lag(feed_rate, 4) OVER (PARTITION BY tag ORDER BY ts, event_id) AS l4, {_windows_sql(4)}, {_windows_sql(12)} FROM {{readings}}) r"""


def _asof(direction: str, exact: bool):
    def q(spark, sf_dir):
        ev = labels.canonical_events(T(spark, sf_dir, "incidents"))
        out = timeseries.asof_join(T(spark, sf_dir, "readings").select("event_id", "tag", "ts"), ev, "tag", "ts", "failure_date", direction, exact, ["incident_seq"])
        return out.select("event_id", "asof_ts", "asof_incident_seq")

    return q


def _asof_sql(op: str) -> str:
    return f"SELECT r.event_id, i.failure_date AS asof_ts, i.incident_seq AS asof_incident_seq FROM {{readings}} r ASOF LEFT JOIN {{incidents}} i ON r.tag = i.tag AND r.ts {op} i.failure_date"


def _days_since(spark, sf_dir):
    out = timeseries.asof_join(T(spark, sf_dir, "readings").select("event_id", "tag", "ts"), T(spark, sf_dir, "incidents"), "tag", "ts", "failure_date", "backward", False, [])
    start = F.coalesce("asof_ts", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    return out.select("event_id", F.round((timeseries.seconds("ts") - timeseries.seconds(start)) / 86400, 6).alias("days"))


def _labels(spark, sf_dir):
    out = labels.failure_labels(T(spark, sf_dir, "readings").select("event_id", "tag", "ts"), T(spark, sf_dir, "incidents"), (1, 7), 6)
    return rounded(out.select("event_id", "next_failure_date", "days_to_next_failure", "hours_since_previous", "is_recovery_window", F.col("failure_within_1d").cast("long").alias("failure_within_1d"), F.col("failure_within_7d").cast("long").alias("failure_within_7d"), "label_source"), 3)


LABELS_CTE = """o AS (SELECT event_id, tag, ts, max(ts) OVER (PARTITION BY tag) AS e FROM {readings}),
n AS (SELECT o.*, i.failure_date AS nxt, i.is_source_rca AS rca FROM o ASOF LEFT JOIN {incidents} i ON o.tag = i.tag AND o.ts < i.failure_date),
p AS (SELECT n.*, i.failure_date AS prv FROM n ASOF LEFT JOIN {incidents} i ON n.tag = i.tag AND n.ts >= i.failure_date),
d AS (SELECT *, (epoch_us(nxt) - epoch_us(ts)) / 1e6 / 86400 AS days, (epoch_us(ts) - epoch_us(prv)) / 1e6 / 3600 AS since FROM p),
f AS (SELECT *, coalesce(since BETWEEN 0 AND 6, FALSE) AS rec FROM d)"""
LABELS_SQL = f"""WITH {LABELS_CTE} SELECT event_id, nxt AS next_failure_date, round(days, 3) AS days_to_next_failure, round(since, 3) AS hours_since_previous, rec AS is_recovery_window,
 CASE WHEN rec THEN NULL WHEN days > 0 AND days <= 1 THEN 1 WHEN ts + INTERVAL 1 DAY <= e THEN 0 END::BIGINT AS failure_within_1d,
 CASE WHEN rec THEN NULL WHEN days > 0 AND days <= 7 THEN 1 WHEN ts + INTERVAL 7 DAY <= e THEN 0 END::BIGINT AS failure_within_7d,
 CASE WHEN nxt IS NULL THEN 'no_observed_future_event' WHEN rca THEN 'rca_document' ELSE 'incident_history' END AS label_source FROM f"""


def _audit(spark, sf_dir):
    rows = labels.failure_labels(T(spark, sf_dir, "readings").select("event_id", "tag", "ts"), T(spark, sf_dir, "incidents"), (1, 7), 6)
    return labels.audit_labels(rows, at(END), "failure_within_1d", "failure_within_7d")


AUDIT_SQL = f"""WITH {LABELS_CTE}, lb AS (SELECT *, CASE WHEN rec THEN NULL WHEN days > 0 AND days <= 1 THEN 1 WHEN ts + INTERVAL 1 DAY <= e THEN 0 END AS y1,
  CASE WHEN rec THEN NULL WHEN days > 0 AND days <= 7 THEN 1 WHEN ts + INTERVAL 7 DAY <= e THEN 0 END AS y7 FROM f),
g AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY tag ORDER BY ts, event_id)) > 86400000000 AS gap, count(*) OVER (PARTITION BY tag, ts) AS c FROM lb),
k AS (SELECT count(*) AS n, count(*) FILTER (c > 1) AS duplicates, count(*) FILTER (tag IS NULL OR ts IS NULL) AS missing_keys, count(*) FILTER (y1 = 1 AND y7 = 0) AS order_errors,
  count(*) FILTER (abs(date_diff('microsecond', ts, nxt) / 8.64e10 - days) > 0.001) AS day_errors, count(*) FILTER (gap) AS gaps, count(*) FILTER (ts > TIMESTAMP '2024-01-20') AS future_rows,
  count(*) FILTER (rec) AS recovery, count(*) FILTER (y1 IS NULL AND NOT rec) AS censored FROM g)
SELECT *, CASE WHEN missing_keys + order_errors + day_errors > 0 THEN 'FAIL' WHEN future_rows + duplicates > 0 THEN 'WARN' ELSE 'PASS' END AS status FROM k"""


def _persistence(spark, sf_dir):
    return timeseries.persistence(T(spark, sf_dir, "scored"), ["tag"], ["ts", "event_id"], F.col("score") >= 0.5).select("event_id", "hits", "persistent")


def _episodes(spark, sf_dir):
    alerts = T(spark, sf_dir, "scored").where("score >= 0.6")
    e = timeseries.alert_episodes(alerts, ["tag"], "ts", ["ts", "event_id"], "y")
    return rounded(e.withColumn("episode", F.col("episode").cast("long")))


EPISODES_CTE = """a AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY tag ORDER BY ts, event_id)) > 86400000000 THEN 1 ELSE 0 END AS g FROM {scored} WHERE score >= 0.6),
b AS (SELECT *, sum(g) OVER (PARTITION BY tag ORDER BY ts, event_id)::BIGINT AS episode FROM a),
ep AS (SELECT tag, episode, min(ts) AS "start", max(ts) AS "end", count(*) AS alerts, bool_or(y = 1) AS true_episode FROM b GROUP BY tag, episode)"""
EPISODES_SQL = f"""WITH {EPISODES_CTE} SELECT *, round((epoch_us("end") - epoch_us("start")) / 3.6e9 + 1, 6) AS span_hours FROM ep"""


def _cooldown(spark, sf_dir):
    e = timeseries.alert_episodes(T(spark, sf_dir, "scored").where("score >= 0.6"), ["tag"], "ts", ["ts", "event_id"], "y")
    return timeseries.notifications(e, ["tag"]).select("tag", "start", "sent")


COOLDOWN_SQL = f"""WITH RECURSIVE {EPISODES_CTE}, k AS (SELECT tag, "start", row_number() OVER (PARTITION BY tag ORDER BY "start") AS i FROM ep),
s AS (SELECT tag, "start", i, TRUE AS sent, "start" AS last FROM k WHERE i = 1 UNION ALL
 SELECT k.tag, k."start", k.i, k."start" - s.last >= INTERVAL 72 HOUR, CASE WHEN k."start" - s.last >= INTERVAL 72 HOUR THEN k."start" ELSE s.last END FROM s JOIN k ON k.tag = s.tag AND k.i = s.i + 1)
SELECT tag, "start", sent FROM s"""

_S = "score"


def _confusion(spark, sf_dir):
    return rounded(metrics.confusion(T(spark, sf_dir, "scored"), ["split"], "y", F.col(_S) >= 0.6, _S))


CONFUSION_SQL = """WITH c AS (SELECT split, count(*) FILTER (score >= 0.6 AND y = 1) AS tp, count(*) FILTER (score >= 0.6 AND y = 0) AS fp, count(*) FILTER (score < 0.6 AND y = 1) AS fn, count(*) FILTER (score < 0.6 AND y = 0) AS tn, avg((score - y) * (score - y)) AS brier, avg(y) AS positive_rate FROM {scored} GROUP BY split)
SELECT split, tp, fp, fn, tn, round(brier, 6) AS brier, round(positive_rate, 6) AS positive_rate, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy FROM c"""
COUNTS_CTE = """c AS (SELECT split, score, count(*) AS n, sum(y) AS p FROM {scored} GROUP BY split, score),
s AS (SELECT *, sum(n) OVER w AS cn, sum(p) OVER w AS cp, sum(p) OVER (PARTITION BY split) AS ap, sum(n) OVER (PARTITION BY split) AS an FROM c WINDOW w AS (PARTITION BY split ORDER BY score DESC))"""
AP_SQL = f"WITH {COUNTS_CTE} SELECT split, round(sum(p * cp / cn) / max(ap), 6) AS average_precision FROM s GROUP BY split"
AUC_SQL = f"WITH {COUNTS_CTE} SELECT split, round(sum(p * (an - ap - (cn - cp) + (n - p) / 2.0)) / max(ap * (an - ap)), 6) AS roc_auc FROM s GROUP BY split"
FBETA_SQL = f"WITH {COUNTS_CTE}, f AS (SELECT split, score, round(2.0 * cp / (ap + cn), 12) AS f FROM s), m AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY f DESC, score) AS i FROM f) SELECT split, round(score, 6) AS threshold, round(f, 6) AS f_beta FROM m WHERE i = 1"



def _operational(spark, sf_dir):
    """Scored rows with the label of the next seven days, known ones only."""
    rows = labels.failure_labels(T(spark, sf_dir, "scored").drop("y"), T(spark, sf_dir, "incidents"), (7,), 6)
    rows = rows.withColumnRenamed("failure_within_7d", "y").where("y IS NOT NULL")
    return rows.select("event_id", "tag", "ts", "score", "y", "next_failure_date", "days_to_next_failure").persist()


def _curve(spark, sf_dir):
    rows = _operational(spark, sf_dir)
    return metrics.threshold_curve(rows, metrics.threshold_grid(rows, _S))


OPERATIONAL_CTE = """o AS (SELECT event_id, tag, ts, score, max(ts) OVER (PARTITION BY tag) AS e FROM {scored}),
n AS (SELECT o.*, i.failure_date AS nxt FROM o ASOF LEFT JOIN {incidents} i ON o.tag = i.tag AND o.ts < i.failure_date),
p AS (SELECT n.*, i.failure_date AS prv FROM n ASOF LEFT JOIN {incidents} i ON n.tag = i.tag AND n.ts >= i.failure_date),
f AS (SELECT *, (epoch_us(nxt) - epoch_us(ts)) / 8.64e10 AS days, (epoch_us(ts) - epoch_us(prv)) / 3.6e9 AS since FROM p),
l AS (SELECT event_id, tag, ts, score, nxt, days, CASE WHEN days > 0 AND days <= 7 THEN 1 ELSE 0 END AS y FROM f
  WHERE NOT coalesce(since BETWEEN 0 AND 6, FALSE) AND (coalesce(days > 0 AND days <= 7, FALSE) OR ts + INTERVAL 7 DAY <= e))"""
GRID_CTE = "q(p) AS (VALUES " + ", ".join(f"({x!r}::DOUBLE)" for x in metrics.grid_points()) + """),
s AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS i, count(*) OVER () - 1 AS m FROM l),
g AS (SELECT DISTINCT least(1.0, greatest(1e-9, a.score + (b.score - a.score) * (q.p * a.m - a.i))) AS t FROM q JOIN s a ON a.i = floor(q.p * a.m) JOIN s b ON b.i = ceil(q.p * b.m))"""
CURVE_CTE = """x AS (SELECT t, l.*, CASE WHEN score >= t THEN 1 ELSE 0 END AS h FROM l CROSS JOIN g),
a AS (SELECT *, h = 1 AND sum(h) OVER (PARTITION BY t, tag ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) >= 3 AS al FROM x),
r AS (SELECT t, count(*) FILTER (al) AS predicted, count(*) FILTER (al AND y = 1) AS tp, count(*) FILTER (y = 1) AS ap, count(DISTINCT (tag, ts::DATE)) FILTER (al AND y = 0) AS fd,
  count(DISTINCT (tag, ts::DATE)) / 30.4375 AS months FROM a GROUP BY t),
ev AS (SELECT t, tag, nxt, bool_or(al) AS hit, max(days) FILTER (al) AS lead FROM a WHERE nxt IS NOT NULL GROUP BY 1, 2, 3),
e2 AS (SELECT t, count(*) AS events, count(*) FILTER (hit) AS detected, quantile_cont(lead, 0.5) AS lead FROM ev GROUP BY t),
k AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY t, tag ORDER BY ts, event_id)) > 86400000000 THEN 1 ELSE 0 END AS b FROM a WHERE al),
k2 AS (SELECT *, sum(b) OVER (PARTITION BY t, tag ORDER BY ts, event_id) AS ep FROM k),
ep AS (SELECT t, tag, ep, max(y) AS y, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9 + 1 AS span FROM k2 GROUP BY 1, 2, 3),
e3 AS (SELECT t, count(*) AS episodes, sum(y)::BIGINT AS true_episodes, quantile_cont(span, 0.5) AS span FROM ep GROUP BY t),
cu AS (SELECT t AS threshold, predicted, tp, coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(ap, 0), 0) AS recall, coalesce(2 * tp / nullif(predicted + ap, 0), 0) AS f1,
  predicted - tp AS false_rows, fd AS false_days, months AS exposure_months, fd / months AS false_days_per_month, coalesce(events, 0) AS events, coalesce(detected, 0) AS detected,
  coalesce(detected / events, 0) AS event_recall, lead AS median_lead_days, coalesce(episodes, 0) AS episodes, coalesce(true_episodes, 0) AS true_episodes,
  coalesce(episodes - true_episodes, 0) AS false_episodes, coalesce(episodes - true_episodes, 0) / months AS false_episodes_per_month, coalesce(true_episodes / episodes, 0) AS episode_precision,
  span AS median_span_hours FROM r LEFT JOIN e2 USING (t) LEFT JOIN e3 USING (t))"""
CURVE_COLUMNS = """predicted, tp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, false_rows, false_days, round(exposure_months, 6) AS exposure_months,
round(false_days_per_month, 6) AS false_days_per_month, events, detected, round(event_recall, 6) AS event_recall, round(median_lead_days, 6) AS median_lead_days, episodes, true_episodes, false_episodes,
round(false_episodes_per_month, 6) AS false_episodes_per_month, round(episode_precision, 6) AS episode_precision, round(median_span_hours, 6) AS median_span_hours"""
CURVE_SQL = f"WITH {OPERATIONAL_CTE}, {GRID_CTE}, {CURVE_CTE} SELECT round(threshold, 6) AS threshold, {CURVE_COLUMNS} FROM cu"
OPERATIONAL_SQL = f"WITH {OPERATIONAL_CTE}, g(t) AS (VALUES (0.6::DOUBLE)), {CURVE_CTE} SELECT threshold, {CURVE_COLUMNS} FROM cu"
_KEPT = "coalesce(event_recall, 0) >= 0.8 AND coalesce(median_lead_days, 0) >= 3"
SELECT_SQL = f"""WITH {OPERATIONAL_CTE}, {GRID_CTE}, {CURVE_CTE}, ti AS (SELECT *, {_KEPT} AS safe, false_days_per_month <= 1 AS quiet FROM cu),
ke AS (SELECT *, CASE WHEN safe AND quiet THEN 0 WHEN safe THEN 1 ELSE 2 END AS tier, CASE WHEN safe AND quiet THEN 0 WHEN safe THEN greatest(0, false_days_per_month - 1)
  ELSE greatest(0, 0.8 - coalesce(event_recall, 0)) / 0.8 + greatest(0, 3 - coalesce(median_lead_days, 0)) / 3 END AS short FROM ti)
SELECT round(threshold, 6) AS threshold, {CURVE_COLUMNS}, CASE tier WHEN 0 THEN 'all_limits_met' WHEN 1 THEN 'false_alert_limit_relaxed' ELSE 'least_event_and_lead_shortfall' END AS selection_basis,
  safe AND quiet AS limits_met, safe AS events_and_lead_met, quiet AS false_alert_limit_met
FROM ke ORDER BY tier, round(short, 9), CASE WHEN tier = 2 THEN round(-event_recall, 9) END, round(false_days_per_month, 9), round(false_episodes_per_month, 9), round(-precision, 9), round(-event_recall, 9),
  CASE WHEN tier = 0 THEN round(-median_lead_days, 9) END, threshold DESC LIMIT 1"""


def _episode_report(spark, sf_dir):
    rows = timeseries.persistence(T(spark, sf_dir, "scored"), ["split", "tag"], ["ts", "event_id"], F.col(_S) >= 0.6)
    return metrics.episode_report(rows, ["split"], F.col("persistent"))


REPORT_SQL = """WITH RECURSIVE h AS (SELECT *, CASE WHEN score >= 0.6 THEN 1 ELSE 0 END AS h FROM {scored}),
a AS (SELECT *, h = 1 AND sum(h) OVER (PARTITION BY split, tag ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) >= 3 AS al FROM h),
g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY split, tag ORDER BY ts, event_id)) > 86400000000 THEN 1 ELSE 0 END AS g FROM a WHERE al),
n AS (SELECT *, sum(g) OVER (PARTITION BY split, tag ORDER BY ts, event_id) AS e FROM g),
ep AS (SELECT split, tag, e, min(ts) AS s, max(ts) AS t, count(*) AS alerts, max(y) AS y FROM n GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY split, tag ORDER BY s) AS i FROM ep),
r AS (SELECT split, tag, i, TRUE AS sent, s AS last FROM k WHERE i = 1 UNION ALL
  SELECT k.split, k.tag, k.i, k.s - r.last >= INTERVAL 72 HOUR, CASE WHEN k.s - r.last >= INTERVAL 72 HOUR THEN k.s ELSE r.last END FROM r JOIN k ON k.split = r.split AND k.tag = r.tag AND k.i = r.i + 1),
c AS (SELECT split, count(*) AS episodes, count(*) FILTER (y = 1) AS true_episodes, count(*) FILTER (sent) AS notifications, count(*) FILTER (sent AND y = 0) AS false_notifications, sum(alerts)::BIGINT AS alerts,
  quantile_cont((epoch_us(t) - epoch_us(s)) / 3.6e9 + 1, 0.5) AS median_span_hours, max((epoch_us(t) - epoch_us(s)) / 3.6e9 + 1) AS longest_hours FROM k JOIN r USING (split, tag, i) GROUP BY split),
m AS (SELECT split, count(DISTINCT (tag, ts::DATE)) / 30.4375 AS x FROM h GROUP BY split)
SELECT split, round(x, 6) AS exposure_months, coalesce(episodes, 0) AS episodes, coalesce(true_episodes, 0) AS true_episodes, coalesce(notifications, 0) AS notifications, coalesce(false_notifications, 0) AS false_notifications,
 coalesce(alerts, 0) AS alerts, round(median_span_hours, 6) AS median_span_hours, round(longest_hours, 6) AS longest_hours, coalesce(episodes - true_episodes, 0) AS false_episodes, round(coalesce(true_episodes / episodes, 0), 6) AS episode_precision,
 round(coalesce(episodes - true_episodes, 0) / x, 6) AS false_episodes_per_month, round(coalesce(false_notifications, 0) / x, 6) AS false_notifications_per_month FROM m LEFT JOIN c USING (split)"""


def _event_metrics(spark, sf_dir):
    rows = labels.failure_labels(T(spark, sf_dir, "scored"), T(spark, sf_dir, "incidents"), (7,), 6)
    return rounded(metrics.event_metrics(rows, "next_failure_date", F.col(_S) >= 0.6, "days_to_next_failure"))


EVENTS_SQL = """WITH n AS (SELECT o.*, i.failure_date AS nxt FROM {scored} o ASOF JOIN {incidents} i ON o.tag = i.tag AND o.ts < i.failure_date),
e AS (SELECT tag, nxt, bool_or(score >= 0.6) AS hit, max(CASE WHEN score >= 0.6 THEN (epoch_us(nxt) - epoch_us(ts)) / 8.64e10 END) AS lead FROM n GROUP BY tag, nxt)
SELECT count(*) AS events, count(*) FILTER (hit) AS detected, round(avg(hit::INT), 6) AS event_recall, round(quantile_cont(lead, 0.5), 6) AS median_lead_days FROM e"""


def _rules(spark, sf_dir):
    return metrics.compare_persistence(T(spark, sf_dir, "scored"), ["tag"], ["ts", "event_id"], _S, "y", 0.5, [(1, 1), (2, 3), (3, 6)])


RULES_SQL = "WITH h AS (SELECT *, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS h FROM {scored})" + " UNION ALL ".join(
    f" SELECT '{a}_of_{b}' AS rule, count(*) FILTER (al) AS alerts, count(*) FILTER (al AND y = 0) AS false_alerts FROM (SELECT y, h = 1 AND sum(h) OVER (PARTITION BY tag ORDER BY ts, event_id ROWS BETWEEN {b - 1} PRECEDING AND CURRENT ROW) >= {a} AS al FROM h) x" for a, b in ((1, 1), (2, 3), (3, 6))
)


def _operational_rules(spark, sf_dir):
    return metrics.compare_rules(_operational(spark, sf_dir), 0.6, most_false_days=5.0)


def _rule_sql(hits: int, of: int) -> str:
    curve = CURVE_CTE.replace("5 PRECEDING AND CURRENT ROW) >= 3", f"{of - 1} PRECEDING AND CURRENT ROW) >= {hits}")
    return f"SELECT '{hits}_of_{of}' AS rule, * FROM (WITH {OPERATIONAL_CTE}, g(t) AS (VALUES (0.6::DOUBLE)), {curve} SELECT * FROM cu)"


OPERATIONAL_RULES_SQL = f"""WITH ru AS ({" UNION ALL ".join(_rule_sql(*r) for r in metrics.RULES)}), ra AS (SELECT false_days_per_month AS raw FROM ru WHERE rule = '1_of_1')
SELECT rule, threshold, {CURVE_COLUMNS}, round(raw - false_days_per_month, 6) AS fewer_false_days, round(coalesce((raw - false_days_per_month) / nullif(raw, 0), 0), 6) AS fewer_share, false_days_per_month <= 5 AS limit_met FROM ru CROSS JOIN ra"""


def _reliability(spark, sf_dir):
    return rounded(metrics.reliability(T(spark, sf_dir, "scored"), "y", _S))


RELIABILITY_CTE = """r AS (SELECT greatest(1, ceil(round(score * 10, 9)))::INT AS bin, count(*) AS n, sum(y)::BIGINT AS positives, avg(score) AS mean_score FROM {scored} GROUP BY 1),
w AS (SELECT *, positives / n AS p, 1.959963984540054 AS z FROM r)"""
RELIABILITY_SQL = f"""WITH {RELIABILITY_CTE} SELECT bin, n, positives, round(mean_score, 6) AS mean_score, round(p, 6) AS observed,
 round(greatest(0, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n)), 6) AS lower, round(least(1, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n)), 6) AS upper FROM w"""


def _bootstrap(spark, sf_dir):
    """The score against the schedule (days since the last incident)."""
    return rounded(metrics.cluster_bootstrap(fitted.with_schedule(spark, sf_dir), "tag", "y", ["score", "days"]))


def _draws_sql(c: str) -> str:
    return f"""{c}c AS (SELECT tag, {c} AS s, count(*) AS n, sum(y) AS p FROM sc GROUP BY 1, 2), {c}r AS (SELECT iteration, s, sum(w * n) AS n, sum(w * p) AS p FROM w JOIN ids USING (slot) JOIN {c}c USING (tag) GROUP BY 1, 2),
{c}u AS (SELECT *, sum(n) OVER q AS cn, sum(p) OVER q AS cp FROM {c}r WINDOW q AS (PARTITION BY iteration ORDER BY s DESC)), {c}a AS (SELECT iteration, sum(p * cp / cn) / nullif(sum(p), 0) AS {c} FROM {c}u GROUP BY iteration)"""


_POINTS = "count(*) AS draws, round(avg({0}), 6) AS mean, round(quantile_cont({0}, 0.025), 6) AS lower, round(quantile_cont({0}, 0.975), 6) AS upper"
BOOT_SQL = f"""WITH {fitted.SCHEDULE_CTE.replace("s AS", "sc AS", 1)}, ids AS (SELECT tag, row_number() OVER (ORDER BY tag) - 1 AS slot FROM (SELECT DISTINCT tag FROM sc) x),
d AS (SELECT i.iteration, (('0x' || substr(md5('boot|' || i.iteration || '|' || s.slot), 1, 12))::BIGINT % (SELECT count(*) FROM ids)) AS slot FROM range(500) i(iteration) CROSS JOIN ids s),
w AS (SELECT iteration, slot, count(*) AS w FROM d GROUP BY 1, 2), {_draws_sql("score")}, {_draws_sql("days")}, b AS (SELECT score, days FROM scorea JOIN daysa USING (iteration) WHERE score IS NOT NULL)
SELECT 'score' AS name, {_POINTS.format("score")}, NULL::DOUBLE AS share_better FROM b UNION ALL SELECT 'days', {_POINTS.format("days")}, NULL FROM b
UNION ALL SELECT 'difference', {_POINTS.format("score - days")}, round(avg((score > days)::INT), 6) FROM b"""


FEATURES = ["feed_rate", "hour_of_day", *[f"{x}_{c}" for x in ("feed_rate", "hour_of_day") for c in ("lag_1h", "mean_12h", "std_12h", "zscore_12h", "delta_1h")]]


def _signal_rows(spark, sf_dir):
    r = T(spark, sf_dir, "readings").select("event_id", "tag", "ts", "feed_rate", F.hour("ts").cast("double").alias("hour_of_day"))
    return timeseries.causal_rolling(r, "tag", ["ts", "event_id"], ["feed_rate", "hour_of_day"], 4, 12)


def _latest_signals(rows):
    return rows.groupBy("tag").agg(F.max_by(F.struct("event_id", *FEATURES), F.struct("ts", "event_id")).alias("r")).select("tag", "r.*")


def _profile(spark, sf_dir):
    return rounded(quality.feature_profile(_signal_rows(spark, sf_dir), FEATURES))


def _quality(spark, sf_dir, rows=None):
    rows = store.stored(_signal_rows(spark, sf_dir)) if rows is None else rows
    profile = quality.feature_profile(rows, FEATURES)
    return quality.assess_quality(_latest_signals(rows), "tag", profile, FEATURES, ("feed_rate", "hour_of_day"), short=4, long=12)


def _signal_sql(x: str) -> str:
    w = "OVER (PARTITION BY tag ORDER BY ts, event_id ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)"
    enough = f"CASE WHEN count({x}) {w} >= 3 THEN"
    return f"lag({x}) OVER (PARTITION BY tag ORDER BY ts, event_id) AS {x}_lag_1h, {enough} avg({x}) {w} END AS {x}_mean_12h, {enough} stddev_samp({x}) {w} END AS {x}_std_12h"


_MORE = ", ".join(f"({x} - {x}_mean_12h) / nullif({x}_std_12h, 0) AS {x}_zscore_12h, {x} - {x}_lag_1h AS {x}_delta_1h" for x in ("feed_rate", "hour_of_day"))
SIGNAL_CTE = f"""sg AS (SELECT *, {_signal_sql("feed_rate")}, {_signal_sql("hour_of_day")} FROM (SELECT event_id, tag, ts, feed_rate, hour(ts)::DOUBLE AS hour_of_day FROM {{readings}}) b), sr AS (SELECT *, {_MORE} FROM sg)"""
PROFILE_CTE = SIGNAL_CTE + ", pf AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) AS n, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.005) - 0.1 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lower, quantile_cont({c}, 0.995) + 0.1 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS upper FROM sr HAVING count({c}) >= 100"
    for c in FEATURES
) + ")"
PROFILE_SQL = f"WITH {PROFILE_CTE} SELECT feature, n, round(median, 6) AS median, round(lower, 6) AS lower, round(upper, 6) AS upper FROM pf"
_OFF = " + ".join(
    f"(coalesce(abs({x}_delta_1h - ({x} - {x}_lag_1h)) / greatest(1, abs({x})) > 1e-5, FALSE) OR coalesce(abs({x}_zscore_12h - ({x} - {x}_mean_12h) / CASE WHEN abs({x}_std_12h) > 1e-9 THEN {x}_std_12h END) > 1e-4, FALSE))::INT"
    for x in ("feed_rate", "hour_of_day")
)
QUALITY_CTE = f"""{PROFILE_CTE}, ls AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY ts DESC, event_id DESC) AS i FROM sr) x WHERE i = 1),
un AS ({" UNION ALL ".join(f"SELECT tag, '{c}' AS feature, {c} AS v FROM ls" for c in FEATURES)}),
sh AS (SELECT tag, avg((v IS NULL)::INT) AS missing, avg(coalesce(v < lower OR v > upper, FALSE)::INT) AS outside FROM un JOIN pf USING (feature) GROUP BY tag),
qr AS (SELECT ls.tag, {_OFF} AS violations, coalesce(missing, 0) AS missing, coalesce(outside, 0) AS outside FROM ls LEFT JOIN sh ON ls.tag = sh.tag),
qu AS (SELECT *, nullif(concat_ws('; ', CASE WHEN missing > 0.05 THEN 'missing features ' || round(100 * missing, 1) || '%' END, CASE WHEN outside > 0.06 THEN 'features out of range ' || round(100 * outside, 1) || '%' END,
  CASE WHEN violations > 0 THEN violations || ' incoherent signals' END), '') AS why FROM qr)"""
GUARD_SQL = f"WITH {QUALITY_CTE} SELECT tag, violations::INT AS violations, round(missing, 6) AS missing, round(outside, 6) AS outside, CASE WHEN why IS NULL THEN 'PASS' ELSE 'REVIEW' END AS status, why IS NULL AS publish_allowed, coalesce(why, 'passed') AS reason FROM qu"


def _frame_profile(spark, sf_dir):
    return quality.frame_profile(T(spark, sf_dir, "incidents").select("tag", "failure_mode", "downtime_hours"))


FRAME_SQL = " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) AS n, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS n_distinct FROM {{incidents}}" for c in ("tag", "failure_mode", "downtime_hours"))


LIMITS = {7: (0.6, 0.4), 30: (0.8, 0.7)}


def _risk(spark, sf_dir):
    scored = T(spark, sf_dir, "scored").select("event_id", "tag", "ts", F.col("score").alias("score_7d"), F.sqrt("score").alias("score_30d"))
    rows = store.stored(_signal_rows(spark, sf_dir))
    deviations = _latest_signals(rows).select("tag", F.col("feed_rate_zscore_12h").alias("feed_rate"), F.col("hour_of_day_zscore_12h").alias("hour_of_day"))
    return risk.latest_risk(scored, LIMITS, _quality(spark, sf_dir, rows), deviations, at("2024-02-01 00:00:00"))


_W = "OVER (PARTITION BY tag ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"
_HITS = ", ".join(f"sum((s{h} >= {t})::INT) {_W} AS {n}_hits_{h}d" for h, limits in LIMITS.items() for n, t in zip(("alert", "warning"), limits, strict=True))
_STATE = ", ".join(f"coalesce(s{h} >= {t} AND {n}_hits_{h}d >= 3, FALSE) AS m_{n}_{h}d" for h, limits in LIMITS.items() for n, t in zip(("alert", "warning"), limits, strict=True))
_CUT = ", ".join(f"m_{n}_{h}d AND NOT review AS {n}_{h}d" for h in LIMITS for n in ("alert", "warning"))
_ACTION = "CASE level " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in risk.ACTIONS.items()) + " END"
_SEVERITY = "CASE level " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in risk.SEVERITY.items()) + " END"
RISK_CTE = f"""{QUALITY_CTE}, sc AS (SELECT event_id, tag, ts, score AS s7, sqrt(score) AS s30 FROM {{scored}}),
hi AS (SELECT *, {_HITS}, count(*) OVER (PARTITION BY tag) AS observations, max(ts) OVER () AS newest, row_number() OVER (PARTITION BY tag ORDER BY ts DESC, event_id DESC) AS i FROM sc),
la AS (SELECT hi.*, {_STATE}, coalesce(why IS NOT NULL, FALSE) AS review, CASE WHEN qu.tag IS NULL THEN 'NOT_EVALUATED' WHEN why IS NULL THEN 'PASS' ELSE 'REVIEW' END AS quality, coalesce(why, 'passed') AS quality_reason,
  round(s7 / 0.6, 9) AS u7, round(s30 / 0.8, 9) AS u30, feed_rate_zscore_12h AS z1, hour_of_day_zscore_12h AS z2 FROM hi LEFT JOIN qu ON hi.tag = qu.tag LEFT JOIN ls ON hi.tag = ls.tag WHERE hi.i = 1),
lb AS (SELECT *, {_CUT}, CASE WHEN m_alert_7d THEN 'ACTION_NOW' WHEN m_alert_30d THEN 'PLAN_MAINTENANCE' WHEN m_warning_7d OR m_warning_30d THEN 'MONITOR' ELSE 'NORMAL' END AS model_level, greatest(u7, u30) AS most FROM la),
lc AS (SELECT *, CASE WHEN review THEN 'DATA_QUALITY_REVIEW' ELSE model_level END AS level, greatest(coalesce(abs(z1), -1), coalesce(abs(z2), -1)) AS top FROM lb),
rk AS (SELECT *, row_number() OVER (ORDER BY {_SEVERITY} DESC, most DESC, tag)::INT AS risk_rank, {_ACTION} AS action, least(100, 100 * most) AS proximity, (epoch_us(newest) - epoch_us(ts)) / 3.6e9 AS lag_hours,
  CASE WHEN top < 0 THEN NULL WHEN abs(z1) = top THEN 'feed_rate' ELSE 'hour_of_day' END AS dominant_signal, CASE WHEN top < 0 THEN NULL WHEN abs(z1) = top THEN z1 ELSE z2 END AS dominant_z,
  coalesce((abs(z1) >= 2)::INT, 0) + coalesce((abs(z2) >= 2)::INT, 0) AS deviating_signals,
  CASE WHEN epoch_us(TIMESTAMP '2024-02-01') - epoch_us(newest) < -3600000000 THEN 'FUTURE' WHEN epoch_us(TIMESTAMP '2024-02-01') - epoch_us(newest) > 48 * 3600000000 THEN 'STALE' ELSE 'CURRENT' END AS source_status FROM lc)"""
RISK_SQL = f"""WITH {RISK_CTE} SELECT tag, ts, round(s7, 6) AS score_7d, round(s30, 6) AS score_30d, {", ".join(f"{n}_hits_{h}d, {n}_{h}d" for h in LIMITS for n in ("alert", "warning"))}, observations,
 s7 >= 0.6 AS raw_alert_7d, s30 >= 0.8 AS raw_alert_30d, round(u7, 6) AS utilisation_7d, round(u30, 6) AS utilisation_30d, quality, NOT review AS publish_allowed, quality_reason, model_level, level, review AND model_level <> 'NORMAL' AS suppressed,
 CASE WHEN review THEN 'held back by data quality: ' || quality_reason WHEN alert_7d THEN 'score of 7 days over its action threshold in 3 of the last 6 readings' WHEN alert_30d THEN 'score of 30 days over its action threshold in 3 of the last 6 readings'
  WHEN warning_7d OR warning_30d THEN 'score over a warning threshold in 3 of the last 6 readings' ELSE 'no persistent warning' END AS reason,
 round(proximity, 6) AS proximity, round(lag_hours, 6) AS lag_hours, lag_hours > 24 AS stale, source_status, action, dominant_signal, round(dominant_z, 6) AS dominant_z, deviating_signals, risk_rank FROM rk"""


def _plants(spark, sf_dir):
    return rounded(risk.plant_summary(_risk(spark, sf_dir), T(spark, sf_dir, "equipment")))


_LEVELS = ", ".join(f"count(*) FILTER (level = '{x}') AS {x.lower()}" for x in risk.SEVERITY)
PLANTS_SQL = f"""WITH {RISK_CTE}, s AS (SELECT plant, count(*) AS equipment, {_LEVELS}, count(*) FILTER (alert_7d) AS alerts_7d, max(s7) AS t7, count(*) FILTER (alert_30d) AS alerts_30d, max(s30) AS t30, count(*) FILTER (lag_hours > 24) AS stale,
  max(proximity) AS p, max(ts) AS last_ts, arg_min(rk.tag, risk_rank) AS top_tag, arg_min(level, risk_rank) AS top_level FROM rk JOIN {{equipment}} e ON rk.tag = e.tag GROUP BY plant)
SELECT * EXCLUDE (t7, t30, p), round(t7, 6) AS top_score_7d, round(t30, 6) AS top_score_30d, round(p, 6) AS top_proximity, row_number() OVER (ORDER BY action_now DESC, plan_maintenance DESC, data_quality_review DESC, monitor DESC, round(p, 9) DESC, plant)::INT AS plant_rank FROM s"""
OVERALL_SQL = f"""WITH {RISK_CTE} SELECT count(*) AS equipment, {_LEVELS}, count(*) FILTER (alert_7d) AS alerts_7d, count(*) FILTER (alert_30d) AS alerts_30d, count(*) FILTER (review AND model_level <> 'NORMAL') AS suppressed,
 count(*) FILTER (review) AS blocked, count(*) FILTER (lag_hours > 24) AS stale, max(ts) AS last_ts, max(source_status) AS source_status FROM rk"""


def _publish(spark, sf_dir):
    return risk.publish_payload(_risk(spark, sf_dir), LIMITS)


PUBLISH_SQL = f"""WITH {RISK_CTE}, p AS (SELECT *, CASE WHEN alert_7d THEN 7 WHEN alert_30d THEN 30 WHEN s7 / 0.4 >= s30 / 0.7 THEN 7 ELSE 30 END AS h FROM rk WHERE level IN ('ACTION_NOW', 'PLAN_MAINTENANCE', 'MONITOR') AND NOT review)
SELECT 'RISK-' || strftime(ts, '%Y%m%d') || '-' || tag || '-' || h || 'D' AS alert_id, tag, ts::DATE AS predicted_at, h::INT AS horizon_days, round(100 * CASE h WHEN 7 THEN s7 ELSE s30 END, 6) AS probability_pct,
 CASE level WHEN 'ACTION_NOW' THEN 'Critical' WHEN 'PLAN_MAINTENANCE' THEN 'High' ELSE 'Medium' END AS severity, 'Open' AS status, NULL::BIGINT AS incident_seq,
 'context only: ' || coalesce(dominant_signal, 'no dominant deviation') AS hint, action AS recommended_action FROM p"""


def _payloads(spark, sf_dir):
    s = T(spark, sf_dir, "scored").where("score >= 0.7").select(F.concat_ws("-", F.lit("A"), "event_id").alias("alert_id"), "tag", F.to_date("ts").alias("predicted_at"), "event_id")
    return s.where("event_id % 2 = 0"), s.where("event_id % 2 = 1")


def _publish_cooldown(spark, sf_dir):
    payload, existing = _payloads(spark, sf_dir)
    return risk.cooldown_filter(payload, existing).drop("event_id")


PUBCOOL_SQL = """WITH s AS (SELECT 'A-' || event_id AS alert_id, tag, ts::DATE AS predicted_at, event_id FROM {scored} WHERE score >= 0.7)
SELECT alert_id, tag, predicted_at FROM s p WHERE event_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM s e WHERE e.event_id % 2 = 1 AND e.tag = p.tag AND 24 * (p.predicted_at - e.predicted_at) >= 0 AND 24 * (p.predicted_at - e.predicted_at) < 72)"""


def _split(spark, sf_dir):
    s = T(spark, sf_dir, "scored").drop("split")
    return labels.assign_split(s, "ts", labels.split_boundaries(s, "ts"), 1).groupBy("split").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


SPLIT_SQL = """WITH t AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM {scored}) x), b AS (SELECT max(ts) FILTER (i = floor(n * 0.575)) AS v, max(ts) FILTER (i = floor(n * (0.575 + 0.225))) AS e FROM t),
s AS (SELECT ts, CASE WHEN ts >= e THEN 'test' WHEN ts >= v AND ts < e - INTERVAL 1 DAY THEN 'validation' WHEN ts < v - INTERVAL 1 DAY THEN 'train' END AS split FROM {scored} CROSS JOIN b) SELECT split, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY split"""


def _daily_labels(spark, sf_dir):
    rows = labels.failure_labels(T(spark, sf_dir, "scored").drop("y"), T(spark, sf_dir, "incidents"), (1,), 6)
    return rows.select("tag", "ts", "next_failure_date", F.col("failure_within_1d").alias("y"))


def _candidates(spark, sf_dir):
    return labels.split_candidates(_daily_labels(spark, sf_dir), "ts", "y", 1)


def _folds(spark, sf_dir):
    start = labels.split_boundaries(T(spark, sf_dir, "scored"), "ts").first().test_start
    return labels.rolling_folds(_daily_labels(spark, sf_dir), "ts", "y", F.lit(start).cast("timestamp_ntz"), 1)


DAILY_CTE = OPERATIONAL_CTE.replace("days <= 7", "days <= 1").replace("INTERVAL 7 DAY", "INTERVAL 1 DAY") + """,
t AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM {scored}) x)"""


def _parts_sql(parts: list[str]) -> str:
    return ", ".join(
        f"count(*) FILTER (part = '{p}') AS {p}_rows, count(*) FILTER (part = '{p}' AND y = 1) AS {p}_positives, count(DISTINCT (tag, nxt)) FILTER (part = '{p}' AND y = 1) AS {p}_events" for p in parts
    )


def _reasons_sql(parts: dict[str, int], events_first: bool) -> str:
    both = [f"CASE WHEN {p}_positives = 0 OR {p}_positives = {p}_rows THEN '{p} lacks both classes' END" for p in parts]
    few = [f"CASE WHEN {p}_events < {n} THEN '{p} events ' || {p}_events || ' < {n}' END" for p, n in parts.items()]
    return f"nullif(concat_ws('; ', {', '.join(few + both if events_first else both + few)}), '') AS rejection"


CANDIDATES_SQL = f"""WITH {DAILY_CTE}, c(candidate, a, b) AS (VALUES {", ".join(f"('{c}', {a!r}::DOUBLE, {round(a + b, 9)!r}::DOUBLE)" for c, (a, b) in labels.CANDIDATES.items())}),
b AS (SELECT candidate, (SELECT ts FROM t WHERE i = floor(n * a)) AS vs, (SELECT ts FROM t WHERE i = floor(n * b)) AS es FROM c),
m AS (SELECT candidate, vs, es, tag, nxt, y, CASE WHEN ts < vs - INTERVAL 1 DAY THEN 'train' WHEN ts >= vs AND ts < es - INTERVAL 1 DAY THEN 'validation' WHEN ts >= es THEN 'test' END AS part FROM l CROSS JOIN b),
g AS (SELECT candidate, vs AS validation_start, es AS test_start, {_parts_sql(["train", "validation", "test"])} FROM m GROUP BY 1, 2, 3)
SELECT *, {_reasons_sql({"train": 12, "validation": 8, "test": 8}, False)} FROM g"""
FOLDS_SQL = f"""WITH {DAILY_CTE}, te AS (SELECT ts AS es FROM t WHERE i = floor(n * 0.8)),
d AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM {{scored}}, te WHERE ts < es - INTERVAL 1 DAY) x),
e AS (SELECT k.k AS fold, min(ts) AS vs FROM range(1, 4) k(k) JOIN d ON d.i = floor(n * 0.5) + floor((n - floor(n * 0.5)) * (k.k - 1) / 3) GROUP BY 1),
w AS (SELECT fold, vs, coalesce(lead(vs) OVER (ORDER BY fold), es) - INTERVAL 1 DAY AS ve FROM e CROSS JOIN te),
m AS (SELECT fold, vs, ve, tag, nxt, y, CASE WHEN ts < vs - INTERVAL 1 DAY THEN 'train' WHEN ts >= vs AND ts < ve THEN 'validation' END AS part FROM l CROSS JOIN w),
g AS (SELECT fold::INT AS fold, vs AS validation_start, ve AS validation_end, {_parts_sql(["train", "validation"])} FROM m GROUP BY 1, 2, 3)
SELECT *, {_reasons_sql({"train": 8, "validation": 5}, True)} FROM g"""


def _around(spark, sf_dir):
    ev = T(spark, sf_dir, "incidents").select("tag", "incident_seq", "failure_date")
    return timeseries.window_around(ev, T(spark, sf_dir, "readings").select("event_id", "tag", "ts"), "tag", "failure_date", "ts").select("tag", "incident_seq", "event_id")


def _days(spark, sf_dir):
    v = T(spark, sf_dir, "environment").join(F.broadcast(T(spark, sf_dir, "plants").select("plant", "region")), "plant")
    return v.groupBy("region", F.to_date("ts").alias("day")).agg(F.sum("energy_kwh").alias("y"))


DAYS_CTE = "dy AS (SELECT region, ts::DATE AS day, sum(energy_kwh) AS y FROM {environment} JOIN {plants} USING (plant) GROUP BY 1, 2)"
CAL_CTE = f"""{DAYS_CTE}, gr AS (SELECT region, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM dy GROUP BY region),
jo AS (SELECT gr.region, gr.day, y, CASE WHEN y IS NOT NULL THEN gr.day END AS k FROM gr LEFT JOIN dy USING (region, day)),
nb AS (SELECT *, last_value(k IGNORE NULLS) OVER w AS bd, last_value(y IGNORE NULLS) OVER w AS bv, first_value(k IGNORE NULLS) OVER f AS ad, first_value(y IGNORE NULLS) OVER f AS av FROM jo
 WINDOW w AS (PARTITION BY region ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY region ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
ca AS (SELECT region, day, coalesce(y, bv + (av - bv) * (day - bd) / nullif(ad - bd, 0)) AS y, y IS NULL AS filled FROM nb)"""


LAG_SQL = f"""WITH {CAL_CTE} SELECT region, day, round(y, 6) AS y, {", ".join(f"round(lag(y, {k}) OVER w, 6) AS lag_{k}" for k in (1, 2, 3, 7, 14, 28))},
 {", ".join(f"round(avg(y) OVER b{n}, 6) AS mean_{n}, round(stddev_pop(y) OVER b{n}, 6) AS std_{n}" for n in (7, 28))},
 {", ".join(f"round({f}(2 * pi() * {x} / {n}), 6) + 0.0 AS {c}_{f}" for c, x, n in (("week", "(isodow(day) - 1)", "7"), ("year", "dayofyear(day)", "365.25")) for f in ("sin", "cos"))}
FROM ca WINDOW w AS (PARTITION BY region ORDER BY day), b7 AS (PARTITION BY region ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),
 b28 AS (PARTITION BY region ORDER BY day ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING)"""


def _calendar(spark, sf_dir):
    return forecast.on_calendar(_days(spark, sf_dir), "region", "day", "y")


def _tfidf(spark, sf_dir):
    d = T(spark, sf_dir, "benchmark")
    return rounded(retrieval.tfidf(d, "item_id", "text").groupBy("id").agg(F.count("*").alias("terms"), F.round(F.sum("weight"), 6).alias("total"), F.max("weight").alias("top")))


TFIDF_CTE = """w AS (SELECT item_id AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: length(x) >= 2 AND NOT list_contains([""" + ", ".join(f"'{x}'" for x in retrieval.STOP_WORDS) + """], x)) AS w FROM {benchmark}),
g AS (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w), tf AS (SELECT id, term, count(*) AS tf FROM g GROUP BY id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), rw AS (SELECT id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM {benchmark})) / (1 + df)) + 1) AS v FROM tf JOIN df USING (term)),
nm AS (SELECT id, sqrt(sum(v * v)) AS nm FROM rw GROUP BY id), ti AS (SELECT id, term, v / nm AS weight FROM rw JOIN nm USING (id))"""


def _nearest_documents(spark, sf_dir):
    """Every hundredth document asks, all others answer; as long as the best is like enough."""
    docs = T(spark, sf_dir, "documents")
    return rounded(retrieval.nearest_texts(docs, "doc_id", "text", docs.where("doc_id % 100 = 0"), "doc_id", "text", 3, 0.08, same=True))


#: Cases are five documents in a row, of which every third is no verified one; every twentieth document asks.
SLIDES = """SELECT doc_id - doc_id % 5 AS case_no, doc_id % 5 AS slide_no, CASE WHEN doc_id % 15 < 10 THEN 'real_rca_backed' ELSE 'synthetic_support' END AS source_type, source AS title, text AS content FROM {documents}"""
ASKED = """SELECT doc_id AS query_id, text, CASE WHEN doc_id % 60 = 0 THEN 'NORMAL' ELSE 'MONITOR' END AS level, CASE WHEN doc_id % 100 = 0 THEN 'REVIEW' ELSE 'PASS' END AS quality FROM {documents} WHERE doc_id % 20 = 0"""


def _retrieval(spark, sf_dir):
    found = retrieval.retrieve_cases(adapters.run(spark, sf_dir, ASKED), adapters.run(spark, sf_dir, SLIDES))
    return rounded(found.withColumn("excerpt", F.md5("excerpt")))


DOCUMENTS_CTE = TFIDF_CTE.replace("{benchmark}", "{documents}").replace("item_id", "doc_id")
NEAREST_SQL = f"""WITH {DOCUMENTS_CTE}, sc AS (SELECT q.id AS query_id, i.id, round(sum(q.weight * i.weight), 9) AS score FROM ti q JOIN ti i USING (term) WHERE q.id % 100 = 0 AND i.id <> q.id GROUP BY 1, 2),
rn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, max(score) OVER (PARTITION BY query_id) AS best FROM sc)
SELECT query_id, id, round(score, 6) AS score, rank FROM rn WHERE rank <= 3 AND best >= 0.08"""


def _terms_sql(x: str, table: str, id_: str, text: str) -> str:
    """{x}f: id, term, tf of a table's texts."""
    words = f"list_filter(string_split_regex(lower(coalesce({text}, '')), '[^a-z0-9]+'), lambda x: length(x) >= 2 AND NOT list_contains([{', '.join(repr(w) for w in retrieval.STOP_WORDS)}], x))"
    return f"{x}w AS (SELECT {id_} AS id, {words} AS w FROM {table}), {x}f AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM {x}w) GROUP BY 1, 2)"


def _fit_sql(x: str) -> str:
    """{x}i: the index over {x}f, {x}q: the queries by its weights."""
    weigh = lambda name, t: f"{name}r AS (SELECT id, term, (1 + ln(tf)) * idf AS v FROM {t} JOIN {x}d USING (term)), {name} AS (SELECT id, term, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS w FROM {name}r)"
    return f"{x}d AS (SELECT term, ln((1 + (SELECT count(*) FROM {x}w)) / (1 + count(*))) + 1 AS idf FROM {x}f GROUP BY term), {weigh(f'{x}i', f'{x}f')}, {weigh(f'{x}q', 'qf')}"


RETRIEVAL_SQL = f"""WITH sl AS ({SLIDES}), ve AS (SELECT * FROM sl WHERE source_type = 'real_rca_backed'),
ca AS (SELECT case_no, string_agg(coalesce(content, ''), ' ' ORDER BY slide_no) AS content, count(*) AS slides FROM ve GROUP BY case_no), qu AS (SELECT * FROM ({ASKED}) x WHERE level <> 'NORMAL' AND quality = 'PASS'),
{_terms_sql("q", "qu", "query_id", "text")}, {_terms_sql("c", "ca", "case_no", "content")}, {_terms_sql("s", "ve", "case_no + slide_no", "content")}, {_fit_sql("c")}, {_fit_sql("s")},
m AS (SELECT q.id AS query_id, i.id AS case_no, round(sum(q.w * i.w), 9) AS score FROM cq q JOIN ci i USING (term) GROUP BY 1, 2), r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, case_no) AS rank FROM m) x WHERE rank <= 3),
e AS (SELECT q.id AS query_id, i.id AS slide, round(sum(q.w * i.w), 9) AS s FROM sq q JOIN si i USING (term) GROUP BY 1, 2),
b AS (SELECT * FROM (SELECT r.*, ve.slide_no, coalesce(s, 0) AS s, ve.content, row_number() OVER (PARTITION BY r.query_id, r.case_no ORDER BY coalesce(s, 0) DESC, slide_no) AS i FROM r JOIN ve USING (case_no) LEFT JOIN e ON e.query_id = r.query_id AND e.slide = r.case_no + slide_no) x WHERE i = 1)
SELECT query_id, rank, case_no, round(score, 6) AS score, CASE WHEN rank = 1 AND score >= 0.08 THEN 'VERIFIED_PRECEDENT' ELSE 'BELOW_THRESHOLD' END AS status, slides, slide_no AS evidence_slide, round(s, 6) AS evidence_score, md5(substr(coalesce(b.content, ''), 1, 700)) AS excerpt
FROM b JOIN ca USING (case_no)"""


def _release(spark, sf_dir):
    weekly, pm = flows.release_times(T(spark, sf_dir, "condition_weekly"), T(spark, sf_dir, "pm_schedule"))
    now = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    a = flows.due(weekly, now).agg(F.lit("condition_weekly").alias("name"), F.count("*").alias("n"), F.max("release_at").alias("last"))
    return a.unionByName(flows.due(pm, now).agg(F.lit("pm_schedule").alias("name"), F.count("*").alias("n"), F.max("release_at").alias("last")))


RELEASE_SQL = """WITH w AS (SELECT week_date + INTERVAL 7 DAY AS r FROM {condition_weekly}), p AS (SELECT coalesce(completed_date + INTERVAL 17 HOUR, scheduled_date + INTERVAL 6 DAY) AS r FROM {pm_schedule})
SELECT 'condition_weekly' AS name, count(*) AS n, max(r) AS last FROM w WHERE r <= TIMESTAMP '2024-01-16' UNION ALL SELECT 'pm_schedule', count(*), max(r) FROM p WHERE r <= TIMESTAMP '2024-01-16'"""


def _parameters(spark, sf_dir):
    p = adapters.run(spark, sf_dir, """SELECT c_custkey AS tag, n AS parameter_no, concat('P', CAST(n AS STRING)) AS parameter_name, 50.0D + n AS alarm_value, 80.0D + n AS trip_value FROM {customer} CROSS JOIN (VALUES (1), (2), (3), (4)) t(n) WHERE c_custkey % 9 + n <> 9""")
    return docs_source.pivot_parameters(p, "tag").select("tag", F.col("1_name").alias("name_1"), F.col("2_alarm").alias("alarm_2"), F.col("3_trip").alias("trip_3"), "complete")


PARAMETERS_SQL = """WITH p AS (SELECT c_custkey AS tag, n FROM {customer} CROSS JOIN (VALUES (1), (2), (3), (4)) t(n) WHERE c_custkey % 9 + n <> 9)
SELECT tag, max(CASE WHEN n = 1 THEN 'P1' END) AS name_1, max(CASE WHEN n = 2 THEN 52.0::DOUBLE END) AS alarm_2, max(CASE WHEN n = 3 THEN 83.0::DOUBLE END) AS trip_3, count(*) = 4 AS complete FROM p GROUP BY tag"""

def _prepared(spark, sf_dir):
    raw = T(spark, sf_dir, "pm_schedule").select(F.col("pm_id").alias(" pm_id "), F.col("tag").alias("tag "), F.col("scheduled_date").cast("string").alias("scheduled"))
    return tables.prepared(raw, ["pm_id"], ("scheduled",)).select("pm_id", "tag", F.col("scheduled").cast("date").alias("scheduled"))


def _wall_time(spark, sf_dir):
    r = T(spark, sf_dir, "readings")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.when(F.col("event_id") % 2 == 0, "+00:00").otherwise("+02:00"))
    return r.select("event_id", tables.wall_time(text, "Asia/Jakarta").alias("local_ts"))


def _cases_added(spark, sf_dir):
    c = T(spark, sf_dir, "conversations").groupBy((F.col("conv_id") % 50).alias("task_id")).agg(F.count("*").alias("turns"))
    rows = T(spark, sf_dir, "conversations").where("turn = 0").select((F.col("conv_id") % 50).alias("task_id"), F.lit("Closed").alias("status"), (F.col("conv_id") % 50 % 3 > 0).alias("approved"))
    rows = rows.join(c, "task_id").withColumns({"root_cause": F.when(F.col("turns") % 2 == 0, "wear"), "corrective_action": F.lit("replaced")})
    have = spark.range(0, 10).select(F.col("id").alias("task_id"))
    return tables.cases_to_append(rows, have).select("task_id", "turns", "root_cause")


def _document_numbers(spark, sf_dir):
    """Pages whose address names a nation's number at its end, matched to the nation."""
    docs = T(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("page of NATION-"), (F.col("page_id") % 30).cast("string"), F.lit(" and others")).alias("text"))
    master = T(spark, sf_dir, "plants").select(F.concat(F.lit("NATION-"), "plant").alias("number"))
    return docs_source.match_documents(docs, master, "text", "number", strict=False).select("page_id", "matches", "number")


def _linked(spark, sf_dir):
    alerts = T(spark, sf_dir, "scored").where("score >= 0.7").select(F.concat_ws("-", F.lit("A"), "event_id").alias("alert_id"), "tag", F.to_date("ts").alias("predicted_at"))
    return flows.linked_alerts(alerts, T(spark, sf_dir, "incidents"), 7)


def _directions(spark, sf_dir):
    """The seasonal naive forecast of a week ahead against the last value."""
    c = _calendar(spark, sf_dir)
    last = c.groupBy("region").agg(F.max_by("y", "day").alias("latest"), F.stddev_pop("y").alias("sigma"))
    ahead = forecast.seasonal_naive(c, "region", "day", "y", 7).select("region", "step", "forecast")
    return ahead.join(last, "region").select("region", "step", forecast.direction(F.col("latest"), F.col("forecast"), F.col("sigma")).alias("direction"))


def _roll_sql(x: str, key: str, order: str, short: int, long: int, digits: int = 6) -> list[str]:
    """The columns of causal_rolling() for one signal."""
    w = f"OVER (PARTITION BY {key} ORDER BY {order}"
    near, far = (f"{w} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in (short, long))
    out = {f"{x}_lag_1h": f"lag({x}, 1) {w})", f"{x}_lag_{short}h": f"lag({x}, {short}) {w})"}
    for n, over in ((short, near), (long, far)):
        out |= {f"{x}_{c}_{n}h": f"CASE WHEN count({x}) {over} >= {max(2, n // 4)} THEN {f}({x}) {over} END" for c, f in (("mean", "avg"), ("std", "stddev_samp"))}
    out[f"{x}_zscore_{long}h"] = f"({x} - {out[f'{x}_mean_{long}h']}) / nullif({out[f'{x}_std_{long}h']}, 0)"
    out[f"{x}_delta_1h"] = f"{x} - lag({x}, 1) {w})"
    return [f"round({v}, {digits}) AS {k}" for k, v in out.items()]


def _clock_sql(ts: str, digits: int = 6) -> str:
    parts = {"hour": f"hour({ts})", "day_of_week": f"(isodow({ts}) - 1)"}
    turns = [f"round({f}(2 * pi() * {v} / {n}), {digits}) + 0.0 AS {k}_{f}" for (k, v), n in zip(parts.items(), (24, 7), strict=True) for f in ("sin", "cos")]
    return ", ".join([f"{v}::INT AS {k}" for k, v in parts.items()] + [f"month({ts})::INT AS month", *turns])


def _plant_hours(spark, sf_dir):
    return features.plant_hours(T(spark, sf_dir, "readings"), T(spark, sf_dir, "equipment"), T(spark, sf_dir, "environment"))


def _equipment_rows(spark, sf_dir):
    return features.equipment_rows(T(spark, sf_dir, "readings"), T(spark, sf_dir, "equipment"), T(spark, sf_dir, "incidents"))


PLANT_HOURS_SQL = f"""WITH m AS (SELECT plant, date_trunc('hour', ts) AS hour_ts, count(DISTINCT r.tag) AS equipment, count(DISTINCT CASE WHEN run_status = 'ON' THEN r.tag END) AS running, sum(feed_rate) AS rate, sum(power_kw) AS power,
  avg((run_status = 'ON')::INT) AS on_share FROM {{readings}} r JOIN {{equipment}} e ON r.tag = e.tag GROUP BY 1, 2),
a AS (SELECT plant, date_trunc('hour', ts) AS hour_ts, sum(energy_kwh) AS energy, sum(co2_ton) AS co2, avg(nox_ppm) AS nox, avg(sox_ppm) AS sox, sum(voc_kg) AS voc, sum(wastewater_m3) AS wastewater FROM {{environment}} GROUP BY 1, 2),
j AS (SELECT *, energy / nullif(rate, 0) AS energy_per_rate FROM m LEFT JOIN a USING (plant, hour_ts))
SELECT plant, hour_ts, equipment, running, round(rate, 9) AS rate, round(power, 9) AS power, round(on_share, 9) AS on_share, {", ".join(f"round({c}, 9) AS {c}" for c in features.PLANT_SIGNALS[2:])},
 {", ".join(x for c in features.PLANT_SIGNALS for x in _roll_sql(c, "plant", "hour_ts", 24, 168, 9))}, {_clock_sql("hour_ts", 9)} FROM j"""
EQUIPMENT_ROWS_SQL = f"""WITH n AS (SELECT tag, failure_date, row_number() OVER (PARTITION BY tag ORDER BY failure_date, incident_seq)::INT AS n FROM {{incidents}}),
f AS (SELECT event_id, tag, ts, round(feed_rate, 6) AS feed_rate, round(power_kw, 6) AS power_kw, {", ".join(x for c in ("feed_rate", "power_kw") for x in _roll_sql("r." + c, "tag", "ts, event_id", 4, 12)).replace("AS r.", "AS ")}, {_clock_sql("ts")},
  row_number() OVER (PARTITION BY tag ORDER BY ts DESC, event_id DESC) = 1 AS is_latest FROM {{readings}} r)
SELECT f.*, coalesce(n.n, 0)::INT AS incidents_before, round((epoch_us(f.ts) - epoch_us(n.failure_date)) / 8.64e10, 6) AS days_since_incident, e.plant, e.equipment_type
FROM f ASOF LEFT JOIN n ON f.tag = n.tag AND f.ts > n.failure_date LEFT JOIN {{equipment}} e ON e.tag = f.tag"""
WEEKLY_SQL = """WITH v AS (SELECT tag, week_date, CASE WHEN parameter_value - 40 >= 0 THEN parameter_value - 40 END AS value, (parameter_value - 40 < 0)::INT AS negative FROM {condition_weekly}),
b AS (SELECT *, count(*) FILTER (NOT coalesce(value >= 20, FALSE)) OVER (PARTITION BY tag ORDER BY week_date) AS k FROM v)
SELECT tag, week_date, round(value, 6) AS value, negative, round(20 - value, 6) AS to_alarm, round(40 - value, 6) AS to_trip, round(lag(value) OVER w, 6) AS lag_1, round(avg(value) OVER p, 6) AS mean, round(stddev_samp(value) OVER p, 6) AS std,
 count(value) OVER p AS weeks_before, CASE WHEN value >= 20 THEN count(*) FILTER (coalesce(value >= 20, FALSE)) OVER (PARTITION BY tag, k ORDER BY week_date) ELSE 0 END AS alarm_run, round(value - lag(value) OVER w, 6) AS step
FROM b WINDOW w AS (PARTITION BY tag ORDER BY week_date), p AS (PARTITION BY tag ORDER BY week_date ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)"""


OPERATORS_MORE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "src7_prepared_table": (_prepared, "SELECT pm_id, tag, scheduled_date AS scheduled FROM {pm_schedule}"),
    "src9_document_match": (_document_numbers, "SELECT page_id, (page_id % 30 < (SELECT count(*) FROM {plants}))::BIGINT AS matches, CASE WHEN page_id % 30 < (SELECT count(*) FROM {plants}) THEN 'NATION-' || (page_id % 30) END AS number FROM {pages}"),
    "src15_append_cases": (_cases_added, """WITH k AS (SELECT conv_id % 50 AS task_id, count(*) AS turns FROM {conversations} GROUP BY 1), s AS (SELECT DISTINCT conv_id % 50 AS task_id FROM {conversations} WHERE turn = 0)
SELECT task_id, turns, 'wear' AS root_cause FROM k JOIN s USING (task_id) WHERE task_id >= 10 AND task_id % 3 > 0 AND turns % 2 = 0"""),
    "fea1_plant_hour_features": (lambda s, d: rounded(_plant_hours(s, d), 9), PLANT_HOURS_SQL),
    "fea2_equipment_features": (lambda s, d: rounded(_equipment_rows(s, d)), EQUIPMENT_ROWS_SQL),
    "fea3_weekly_features": (
        lambda s, d: rounded(features.weekly_rows(T(s, d, "condition_weekly").withColumn("parameter_value", F.col("parameter_value") - 40), 20.0, 40.0)), WEEKLY_SQL,
    ),
    "lab3_event_weeks": (
        lambda s, d: features.event_weeks(T(s, d, "condition_weekly"), T(s, d, "incidents")),
        "SELECT c.tag, c.week_date, count(i.tag) AS incidents, count(i.tag) > 0 AS is_event_week FROM {condition_weekly} c LEFT JOIN {incidents} i ON i.tag = c.tag AND i.failure_date::DATE - c.week_date BETWEEN 0 AND 6 GROUP BY 1, 2",
    ),
    "dq6_wall_time": (_wall_time, "SELECT event_id, date_trunc('second', ts) + CASE WHEN event_id % 2 = 0 THEN INTERVAL 7 HOUR ELSE INTERVAL 5 HOUR END AS local_ts FROM {readings}"),
    "sta10_autocorrelation": (
        lambda s, d: rounded(forecast.autocorrelation(_calendar(s, d), "region", "day", "y")),
        f"WITH {CAL_CTE}, de AS (SELECT region, day, y - avg(y) OVER (PARTITION BY region) AS d FROM ca), "
        + "po AS (SELECT region, d, row_number() OVER (PARTITION BY region ORDER BY day) AS i FROM de), la(lag) AS (VALUES (1), (2), (7), (24), (168), (720)), "
        + "va AS (SELECT region, sum(d * d) AS s FROM po GROUP BY region) "
        + "SELECT va.region, la.lag::INT AS lag, round(sum(a.d * b.d) / max(va.s), 6) AS autocorrelation FROM va CROSS JOIN la LEFT JOIN po a ON a.region = va.region LEFT JOIN po b ON b.region = a.region AND b.i = a.i - la.lag GROUP BY 1, 2",
    ),
    "fc10_direction": (
        _directions,
        f"WITH {CAL_CTE}, o AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY day DESC) AS i FROM ca), z AS (SELECT region, max(y) FILTER (i = 1) AS latest, stddev_pop(y) AS sigma FROM o GROUP BY region) "
        + "SELECT region, s.step::INT AS step, CASE WHEN abs(y - latest) <= greatest(0.25 * sigma, 0.005 * abs(latest)) THEN 'Stable' WHEN y > latest THEN 'Rising' ELSE 'Falling' END AS direction FROM o JOIN z USING (region) JOIN range(1, 8) s(step) ON o.i = 8 - s.step",
    ),
    "str3_linked_alerts": (
        _linked,
        """WITH a AS (SELECT 'A-' || event_id AS alert_id, tag, ts::DATE AS predicted_at FROM {scored} WHERE score >= 0.7), j AS (SELECT alert_id, a.tag, predicted_at, incident_seq, failure_date, row_number() OVER (PARTITION BY alert_id ORDER BY failure_date, incident_seq) AS i
FROM a LEFT JOIN {incidents} x ON x.tag = a.tag AND x.failure_date::DATE - predicted_at BETWEEN 0 AND 7)
SELECT alert_id, tag, predicted_at, incident_seq, failure_date AS resolved_at, CASE WHEN incident_seq IS NULL THEN 'Open' ELSE 'Resolved' END AS status FROM j WHERE i = 1""",
    ),
    "str6_distinct_readings": (
        lambda s, d: flows.distinct_readings(T(s, d, "readings").select("tag", F.date_trunc("day", "ts").alias("ts")), ["tag", "ts"]),
        "SELECT DISTINCT tag, date_trunc('day', ts)::TIMESTAMP AS ts FROM {readings}",
    ),
}


#: name: (query, SQL or None)
OPERATORS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "agg3_kpi_bundle": (_kpi, KPI_SQL),
    "win1_causal_rolling": (_rolling, ROLLING_SQL),
    "win2_time_features": (lambda s, d: rounded(timeseries.time_features(T(s, d, "readings").select("event_id", "ts"), "ts").drop("ts")), "SELECT event_id, hour(ts)::INT AS hour, (isodow(ts) - 1)::INT AS day_of_week, month(ts)::INT AS month, round(sin(2 * pi() * hour(ts) / 24), 6) + 0.0 AS hour_sin, round(cos(2 * pi() * hour(ts) / 24), 6) + 0.0 AS hour_cos, round(sin(2 * pi() * (isodow(ts) - 1) / 7), 6) + 0.0 AS day_of_week_sin, round(cos(2 * pi() * (isodow(ts) - 1) / 7), 6) + 0.0 AS day_of_week_cos FROM {readings}"),
    "j6_asof_forward_strict": (_asof("forward", False), _asof_sql("<")),
    "j7_asof_backward_inclusive": (_asof("backward", True), _asof_sql(">=")),
    "j8_days_since_incident": (_days_since, "SELECT r.event_id, round((epoch_us(r.ts) - epoch_us(coalesce(i.failure_date, TIMESTAMP '2024-01-01'))) / 8.64e10, 6) AS days FROM {readings} r ASOF LEFT JOIN {incidents} i ON r.tag = i.tag AND r.ts > i.failure_date"),
    "j9_window_around_event": (_around, "SELECT r.tag, incident_seq, r.event_id FROM {readings} r JOIN {incidents} i ON r.tag = i.tag AND r.ts BETWEEN failure_date - INTERVAL 48 HOUR AND failure_date + INTERVAL 24 HOUR"),
    "lab1_failure_labels": (_labels, LABELS_SQL),
    "dq9_label_audit": (_audit, AUDIT_SQL),
    "win6_persistence": (_persistence, "WITH h AS (SELECT *, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS h FROM {scored}) SELECT event_id, (sum(h) OVER w)::BIGINT AS hits, h = 1 AND sum(h) OVER w >= 3 AS persistent FROM h WINDOW w AS (PARTITION BY tag ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"),
    "win7_alert_episodes": (_episodes, EPISODES_SQL),
    "win8_notification_cooldown": (_cooldown, COOLDOWN_SQL),
    "met1_confusion": (_confusion, CONFUSION_SQL),
    "met2_roc_auc": (lambda s, d: rounded(metrics.roc_auc(T(s, d, "scored"), ["split"], "y", _S)), AUC_SQL),
    "met3_average_precision": (lambda s, d: rounded(metrics.average_precision(T(s, d, "scored"), ["split"], "y", _S)), AP_SQL),
    "met4_best_f_beta": (lambda s, d: rounded(metrics.best_f_beta(T(s, d, "scored"), ["split"], "y", _S)), FBETA_SQL),
    "met5_operational_metrics": (lambda s, d: rounded(metrics.operational_metrics(_operational(s, d), 0.6)), OPERATIONAL_SQL),
    "met7_threshold_curve": (lambda s, d: rounded(_curve(s, d)), CURVE_SQL),
    "met8_select_threshold": (lambda s, d: rounded(metrics.select_threshold(_curve(s, d), 0.8, 3.0, 1.0)), SELECT_SQL),
    "met9_compare_persistence": (_rules, RULES_SQL),
    "met9_operational_rules": (lambda s, d: rounded(_operational_rules(s, d)), OPERATIONAL_RULES_SQL),
    "met12_episode_report": (lambda s, d: rounded(_episode_report(s, d)), REPORT_SQL),
    "agg24_event_metrics": (_event_metrics, EVENTS_SQL),
    "sta5_cluster_bootstrap": (_bootstrap, BOOT_SQL),
    "sta8_reliability": (_reliability, RELIABILITY_SQL),
    "sta9_calibration_error": (lambda s, d: rounded(metrics.calibration_error(metrics.reliability(T(s, d, "scored"), "y", _S))), f"WITH {RELIABILITY_CTE} SELECT round(sum(n * abs(mean_score - p)) / sum(n), 6) AS ece FROM w"),
    "dq11_frame_profile": (_frame_profile, FRAME_SQL),
    "dq12_feature_profile": (_profile, PROFILE_SQL),
    "dq13_quality_guardrail": (lambda s, d: rounded(_quality(s, d)), GUARD_SQL),
    "rsk1_latest_risk": (lambda s, d: rounded(_risk(s, d)), RISK_SQL),
    "rsk3_plant_summary": (_plants, PLANTS_SQL),
    "rsk3_overall_summary": (lambda s, d: risk.overall_summary(_risk(s, d)), OVERALL_SQL),
    "pub1_publish_payload": (_publish, PUBLISH_SQL),
    "pub2_publish_cooldown": (_publish_cooldown, PUBCOOL_SQL),
    "spl1_chronological_split": (_split, SPLIT_SQL),
    "spl3_split_candidates": (_candidates, CANDIDATES_SQL),
    "spl4_expanding_folds": (_folds, FOLDS_SQL),
    "win14_interpolated_calendar": (lambda s, d: rounded(_calendar(s, d), 6), f"WITH {CAL_CTE} SELECT region, day, round(y, 6) AS y, filled FROM ca"),
    "win14_missing_shares": (
        lambda s, d: rounded(forecast.missing_shares(_days(s, d), "region", "day", "y")),
        f"WITH {DAYS_CTE} SELECT region, max(day) - min(day) + 1 AS days, round(1 - count(DISTINCT day) FILTER (y IS NOT NULL) / (max(day) - min(day) + 1), 6) AS missing FROM dy GROUP BY region",
    ),
    "win15_lag_matrix": (lambda s, d: rounded(forecast.lag_matrix(_calendar(s, d).drop("filled"), "region", "day", "y")), LAG_SQL),
    "fc1_seasonal_naive": (lambda s, d: rounded(forecast.seasonal_naive(_calendar(s, d), "region", "day", "y", 10), 4), f"WITH {CAL_CTE}, o AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY day DESC) AS i, max(day) OVER (PARTITION BY region) AS e FROM ca) SELECT region, s.step::INT AS step, (e + s.step::INT)::DATE AS day, round(y, 4) AS forecast FROM o CROSS JOIN range(1, 11) s(step) WHERE i = 7 - ((s.step - 1) % 7)"),
    "fc5_backtest_naive": (lambda s, d: rounded(forecast.backtest_naive(_calendar(s, d), "region", "day", "y"), 4), f"WITH {CAL_CTE}, e AS (SELECT region, y, lag(y, 7) OVER (PARTITION BY region ORDER BY day) - y AS e FROM ca) SELECT region, round(avg(abs(e)), 4) AS mae, round(100 * sum(abs(e)) / sum(abs(y)), 4) AS wape_pct, round(avg(e), 4) AS bias FROM e WHERE e IS NOT NULL GROUP BY region"),
    "fc9_trend_projection": (lambda s, d: rounded(forecast.trend_projection(_calendar(s, d), "region", "day", "y"), 2), f"""WITH {CAL_CTE}, o AS (SELECT *, -(row_number() OVER (PARTITION BY region ORDER BY day DESC))::DOUBLE AS x FROM ca), l AS (SELECT * FROM o WHERE x >= -30), f AS (SELECT region, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(y) AS m, stddev_pop(y) AS sd, count(*) AS n, greatest(0, regr_syy(y, x) - regr_slope(y, x) * regr_slope(y, x) * regr_sxx(y, x)) AS sse FROM l GROUP BY region)
SELECT region, round(b, 2) AS slope, round(a + 6 * b, 2) AS projected, round(a + 6 * b - 1.645 * sqrt(sse / n), 2) AS lower, round(a + 6 * b + 1.645 * sqrt(sse / n), 2) AS upper, round(m + 2 * sd, 2) AS spike, CASE WHEN a + 6 * b > m + 2 * sd THEN 'SPIKE' WHEN b > 0 THEN 'RISING' ELSE 'STABLE' END AS decision FROM f"""),
    "txt1_tfidf": (_tfidf, f"WITH {TFIDF_CTE} SELECT id, count(*) AS terms, round(sum(weight), 6) AS total, round(max(weight), 6) AS top FROM ti GROUP BY id"),
    "txt2_case_retrieval": (_retrieval, RETRIEVAL_SQL),
    "txt2_nearest_documents": (_nearest_documents, NEAREST_SQL),
    "str1_due_rows": (_release, RELEASE_SQL),
    "str5_sessions": (lambda s, d: flows.episodes(T(s, d, "scored").where("score >= 0.6").select("tag", F.col("ts").cast("timestamp").alias("ts"))), f'WITH {EPISODES_CTE} SELECT tag, "start", "end", alerts FROM ep'),
    "str7_hourly_rollup": (lambda s, d: rounded(flows.rollup(T(s, d, "readings").select("tag", F.col("ts").cast("timestamp").alias("ts"), "feed_rate"), "tag", "feed_rate")), "SELECT tag, date_trunc('hour', ts) AS \"start\", count(*) AS n, round(sum(feed_rate), 6) AS total, round(avg(feed_rate), 6) AS mean FROM {readings} GROUP BY 1, 2"),
    "src6_parameter_pivot": (_parameters, PARAMETERS_SQL),
    "src8_page_sections": (lambda s, d: docs_source.sections(T(s, d, "pages")), None),
}

OPERATORS |= OPERATORS_MORE | fitted.OPERATORS


def operators() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    """All queries that are no plain SQL; those of other modules build on this one's."""
    from . import evidence, history, modelling, series

    return OPERATORS | modelling.OPERATORS | series.OPERATORS | history.OPERATORS | evidence.OPERATORS


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    sql = {n: (lambda s, d, t=t: adapters.run(s, d, t)) for n, t in SQL_QUERIES.items()}
    return sql | {n: q for n, (q, _) in operators().items()}


def oracle_sql() -> dict[str, str]:
    return {n: adapters.plain(t) for n, t in (SQL_QUERIES | {n: t for n, (_, t) in operators().items() if t}).items()}
