"""Queries on how new data carries on from history, on baselines, snapshots and manifests, and on cases cut from pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import continuity, features, labels, models
from ..sources import documents as docs_source
from . import adapters, catalog, fitted
from .adapters import rounded

T = adapters.frame
SPLIT, AIR = "2000-01-01 00:00:00", ["energy_kwh", "co2_ton", "nox_ppm"]


def _moves(spark, sf_dir) -> DataFrame:
    return rounded(continuity.bucket_moves(T(spark, sf_dir, "environment"), ["plant"], "ts", AIR))


def _steps(spark, sf_dir) -> DataFrame:
    return rounded(continuity.join_steps(T(spark, sf_dir, "environment"), "plant", "ts", AIR, catalog.at(SPLIT)))


# Sums and counts by day and by plant, one column a signal, as rows.
_UNPIVOTED = " UNION ALL ".join(f"SELECT plant, '{c}' AS signal, ts, {c}::DOUBLE AS v FROM {{environment}}" for c in AIR)


def _buckets(where: str) -> str:
    return f"""f AS (SELECT plant, min(ts)::DATE AS first_day FROM u WHERE {where} GROUP BY plant),
b AS (SELECT u.plant, signal, (u.ts::DATE - first_day) // 28 AS bucket, min(first_day) AS first_day, avg(v) AS mean FROM u JOIN f ON u.plant = f.plant WHERE {where} GROUP BY 1, 2, 3 HAVING count(v) > 0),
m AS (SELECT b.plant, b.signal, b.bucket, b.first_day, b.mean, abs(b.mean / nullif(a.mean, 0) - 1) AS move FROM b LEFT JOIN b a ON a.plant = b.plant AND a.signal = b.signal AND a.bucket = b.bucket - 1)"""


MOVES_SQL = f"WITH u AS ({_UNPIVOTED}), {_buckets('TRUE')} SELECT plant, signal, bucket, first_day + (28 * bucket)::INT AS start, round(mean, 6) AS mean, round(move, 6) AS move FROM m"
STEPS_SQL = f"""WITH u AS ({_UNPIVOTED}), {_buckets(f"u.ts < TIMESTAMP '{SPLIT}'")},
l AS (SELECT signal, quantile_cont(move, 0.99) AS lim FROM m GROUP BY signal),
e AS (SELECT plant, signal, avg(v) FILTER (ts >= TIMESTAMP '{SPLIT}' - INTERVAL 28 DAY AND ts < TIMESTAMP '{SPLIT}') AS old_mean, avg(v) FILTER (ts >= TIMESTAMP '{SPLIT}' AND ts < TIMESTAMP '{SPLIT}' + INTERVAL 28 DAY) AS new_mean,
  stddev_samp(v) FILTER (ts < TIMESTAMP '{SPLIT}') AS s, stddev_samp(v) FILTER (ts >= TIMESTAMP '{SPLIT}') AS t FROM u GROUP BY plant, signal),
k AS (SELECT plant, signal, old_mean, new_mean, abs(new_mean / nullif(old_mean, 0) - 1) AS step, lim, t / nullif(s, 0) AS ratio FROM e LEFT JOIN l USING (signal)),
o AS (SELECT *, coalesce(step <= lim, TRUE) AS step_ok FROM k)
SELECT plant, signal, round(old_mean, 6) AS old_mean, round(new_mean, 6) AS new_mean, round(step, 6) AS step, round(lim, 6) AS "limit", step_ok, round(ratio, 6) AS std_ratio,
  coalesce(ratio BETWEEN 0.6 AND 1.4, TRUE) AS spread_ok, count(*) FILTER (NOT step_ok) OVER (PARTITION BY signal) <= 1 AS signal_ok FROM o"""

# Parameters are order priorities by week, failures the large finished orders of the first, limits by entity.
ORDERS = {
    "weekly": "SELECT o_custkey AS tag, o_orderpriority AS parameter, CAST(date_trunc('week', o_orderdate) AS DATE) AS week_date, avg(o_totalprice) AS value FROM {orders} GROUP BY 1, 2, 3",
    "failures": "SELECT o_custkey AS tag, o_orderdate AS failure_date FROM {orders} WHERE o_orderstatus = 'F' AND o_totalprice >= 460000",
    "limits": "SELECT DISTINCT o_custkey AS tag, o_orderpriority AS parameter, 400000e0 + c_acctbal * 5 AS trip_value FROM {orders} JOIN {customer} ON o_custkey = c_custkey",
}


def _baselines(spark, sf_dir) -> DataFrame:
    t = {n: adapters.run(spark, sf_dir, text) for n, text in ORDERS.items()}
    return rounded(continuity.parameter_baselines(t["weekly"], t["failures"], t["limits"]), 4)


BASELINES_SQL = f"""WITH w AS ({ORDERS["weekly"]}), f AS (SELECT DISTINCT tag, date_trunc('week', failure_date)::DATE AS fw FROM ({ORDERS["failures"]}) x), l AS ({ORDERS["limits"]}),
k AS (SELECT w.*, EXISTS (SELECT 1 FROM f WHERE f.tag = w.tag AND w.week_date BETWEEN f.fw - 98 AND f.fw + 21) AS near, EXISTS (SELECT 1 FROM f WHERE f.tag = w.tag AND f.fw = w.week_date) AS failed FROM w),
g AS (SELECT tag, parameter, count(value) FILTER (NOT near) AS n, avg(value) FILTER (NOT near) AS mean, stddev_samp(value) FILTER (NOT near) AS sd, min(value) FILTER (NOT near) AS lowest, count(value) FILTER (failed) AS failures FROM k GROUP BY 1, 2),
p AS (SELECT k.tag, k.parameter, avg((k.value - g.mean) / nullif(l.trip_value - g.mean, 0)) AS ramp FROM k JOIN g USING (tag, parameter) JOIN l USING (tag, parameter) WHERE k.failed GROUP BY 1, 2)
SELECT g.tag, g.parameter, n, round(mean, 4) AS mean, round(sd, 4) AS sd, round(lowest, 4) AS lowest, failures, round(trip_value, 4) AS trip_value, round(coalesce(ramp, 0), 4) AS ramp, coalesce(ramp, 0) > 0.5 AS drives,
  coalesce(abs(mean) < 1e-9 OR abs(sd / nullif(mean, 0)) >= 0.2, FALSE) AS resample FROM g LEFT JOIN p USING (tag, parameter) LEFT JOIN l USING (tag, parameter)"""

# A week's snapshot is taken from its readings of the sixth day at midnight, of some entities wrongly.
SNAPSHOTS = {
    "hourly": "SELECT user_id AS tag, date_trunc('day', ts) AS ts, avg(value) AS feed_rate, max(value) AS vibration FROM {events} GROUP BY 1, 2",
    "weekly": """SELECT tag, week_date, max(CASE WHEN away = 6 THEN feed_rate END) AS sun_feed_rate, max(CASE WHEN away = 6 - tag % 2 THEN vibration END) AS sun_vibration
        FROM (SELECT user_id AS tag, CAST(date_trunc('week', ts) AS DATE) AS week_date, datediff('day', date_trunc('week', ts), date_trunc('day', ts)) AS away, avg(value) AS feed_rate, max(value) AS vibration FROM {events} GROUP BY 1, 2, 3) d GROUP BY 1, 2""",
}


def _snapshots(spark, sf_dir) -> DataFrame:
    weekly = adapters.run(spark, sf_dir, SNAPSHOTS["weekly"].replace("datediff('day', ", "datediff(day, "))
    found = continuity.snapshot_check(weekly, adapters.run(spark, sf_dir, SNAPSHOTS["hourly"]), "tag", "week_date", "ts", {"sun_feed_rate": "feed_rate", "sun_vibration": "vibration"})
    return found.groupBy("tag", "signal", "status").agg(F.count("*").alias("weeks"))


SNAPSHOTS_SQL = f"""WITH h AS ({SNAPSHOTS["hourly"]}), w AS ({SNAPSHOTS["weekly"]}), j AS (SELECT w.tag, w.week_date, sun_feed_rate, sun_vibration, feed_rate, vibration FROM w LEFT JOIN h ON h.tag = w.tag AND h.ts = w.week_date + 6),
l AS (SELECT tag, 'sun_feed_rate' AS signal, sun_feed_rate AS s, feed_rate AS r FROM j UNION ALL SELECT tag, 'sun_vibration', sun_vibration, vibration FROM j)
SELECT tag, signal, CASE WHEN r IS NULL THEN 'no_reading' WHEN s IS NULL THEN 'no_snapshot' WHEN abs(s - r) <= 1e-6 * greatest(1, abs(s), abs(r)) THEN 'equal' ELSE 'differs' END AS status, count(*) AS weeks FROM l GROUP BY 1, 2, 3"""


def _manifest(spark, sf_dir) -> DataFrame:
    rows = T(spark, sf_dir, "incidents").select("tag", "failure_date", "downtime_hours", "failure_mode", "is_source_rca")
    return continuity.manifest(rows, "failure_date", ("failure_mode",), ("is_source_rca",))


_HELD = ["tag", "failure_date", "downtime_hours", "failure_mode", "is_source_rca"]
MANIFEST_SQL = (
    "SELECT 'frame' AS section, 'rows' AS name, NULL::VARCHAR AS item, count(*)::BIGINT AS n, NULL::TIMESTAMP AS at FROM {incidents} UNION ALL SELECT 'frame', 'columns', NULL, 5, NULL UNION ALL SELECT 'frame', 'numeric_columns', NULL, 2, NULL "
    "UNION ALL SELECT 'span', 'first', NULL, NULL, min(failure_date) FROM {incidents} UNION ALL SELECT 'span', 'last', NULL, NULL, max(failure_date) FROM {incidents} "
    + " ".join(f"UNION ALL SELECT 'nulls', '{c}', NULL, count(*) - count({c}), NULL FROM {{incidents}}" for c in _HELD)
    + " UNION ALL SELECT 'label', 'failure_mode', failure_mode, count(*), NULL FROM {incidents} GROUP BY failure_mode UNION ALL SELECT 'provenance', 'is_source_rca', is_source_rca::VARCHAR, count(*), NULL FROM {incidents} GROUP BY is_source_rca"
)


def _registry(spark, sf_dir) -> DataFrame:
    """Equipment and the pages whose address holds its number."""
    pages = T(spark, sf_dir, "pages").select("page_id", "url", F.sha2(F.coalesce("html", F.lit("")), 256).alias("sha256"))
    return docs_source.incident_registry(T(spark, sf_dir, "equipment").select("tag", "equipment_name", "plant"), pages, "tag", "page_id", "url")


def _corpus(spark, sf_dir) -> DataFrame:
    return docs_source.case_corpus(_registry(spark, sf_dir), docs_source.slides(T(spark, sf_dir, "pages")), "tag", "page_id", ("plant",))


_BLANK = r"[\x09-\x0D\x20]"
SLIDES_CTE = rf"""v AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g') AS h FROM {{pages}}),
p AS (SELECT page_id, string_split(regexp_replace(replace(h, chr(1), ''), '(?i)(<h[12]{_BLANK}|<h[12]>)', chr(1) || '\1', 'g'), chr(1)) AS parts FROM v),
q AS (SELECT page_id, unnest(parts) AS part, generate_subscripts(parts, 1)::BIGINT AS slide_number FROM p),
r AS (SELECT page_id, slide_number, list_filter(list_transform(string_split_regex(part, '<[^>]*>'), lambda x: regexp_replace(x, '^{_BLANK}+|{_BLANK}+$', '', 'g')), lambda x: x <> '') AS runs FROM q),
sl AS (SELECT page_id, slide_number, coalesce(runs[1], '') AS section_title, array_to_string(runs, ' | ') AS content, sha256(array_to_string(runs, ' | ')) AS content_sha256 FROM r)"""
REGISTRY_CTE = r"""t AS (SELECT page_id, sha256(coalesce(html, '')) AS sha, unnest(list_distinct(regexp_extract_all(coalesce(url, ''), '[A-Za-z0-9]+(-[A-Za-z0-9]+)*'))) AS word FROM {pages}),
d AS (SELECT word, count(*) AS k, min(page_id) AS page_id, min(sha) AS sha FROM t GROUP BY word),
re AS (SELECT tag, equipment_name, plant, coalesce(k, 0) AS matches, CASE WHEN k = 1 THEN page_id END AS source_document, CASE WHEN k = 1 THEN sha END AS source_document_sha256,
  CASE WHEN k = 1 THEN 'real_rca_backed' ELSE 'synthetic_support' END AS source_type, coalesce(k = 1, FALSE) AS rca_demo_eligible, CASE WHEN k = 1 THEN 'rca_document' ELSE 'synthetic_generation' END AS label_source
  FROM {equipment} e LEFT JOIN d ON d.word = e.tag::VARCHAR)"""
CORPUS_SQL = f"""WITH {REGISTRY_CTE}, {SLIDES_CTE} SELECT tag || ':slide:' || slide_number AS document_id, tag, plant, source_type, source_document, source_document_sha256, slide_number, section_title, content, content_sha256
FROM re JOIN sl ON sl.page_id = re.source_document"""


# A week's condition in four slots, and its first and last reading as signals; who has cases that documents tell.
CONDITION = """SELECT tag, week_date, CASE WHEN mean >= 60 THEN 'ALARM' ELSE 'NORMAL' END AS health_status, CASE WHEN tag % 2 = 0 THEN 'vibration' ELSE 'level' END AS parameter_name_1, mean - 45 AS parameter_value_1,
    'pressure' AS parameter_name_2, low AS parameter_value_2, 'temperature' AS parameter_name_3, high AS parameter_value_3, 'level' AS parameter_name_4, errors - 20 AS parameter_value_4, clicks AS sun_feed_rate, views AS sun_power
    FROM (SELECT user_id AS tag, CAST(date_trunc('week', ts) AS DATE) AS week_date, avg(value) AS mean, min(value) AS low, max(value) AS high, sum(CASE WHEN event_type = 'error' THEN value END) AS errors,
      avg(CASE WHEN event_type = 'click' THEN value END) AS clicks, avg(CASE WHEN event_type = 'view' THEN value END) AS views FROM {events} GROUP BY 1, 2) w"""
PROVENANCE_ROWS = """SELECT e.tag, failure_date, CASE WHEN real THEN 'real_rca_backed' ELSE 'synthetic_support' END AS source_type, coalesce(real, FALSE) AS rca_demo_eligible, CASE WHEN real THEN 'rca_document' ELSE 'synthetic_generation' END AS label_source
    FROM {equipment} e LEFT JOIN (SELECT tag, min(failure_date) AS failure_date, max(CASE WHEN is_source_rca THEN 1 ELSE 0 END) = 1 AS real FROM {incidents} GROUP BY tag) i ON e.tag = i.tag"""
SLOT_VALUES = [f"parameter_value_{i}" for i in range(1, 5)]
ADDED = ["value", *[f"CASE WHEN event_type = '{t}' THEN value END" for t in ("error", "click", "view")]]
WEEK_SIGNALS, NONNEGATIVE = ["sun_feed_rate", "sun_power"], ["vibration", "pressure"]


def _condition(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    condition, registry = (adapters.run(spark, sf_dir, t) for t in (adapters.whatever_order(CONDITION, *ADDED), PROVENANCE_ROWS))
    return features.condition_features(condition, registry, NONNEGATIVE, WEEK_SIGNALS, as_of=F.lit("2024-01-28").cast("date"), short=2, long=4)


def _windows(s: str, order: str, short: int, long: int, unit: str) -> str:
    """The columns of one signal's causal windows."""
    lag = lambda k: f"lag({s}, {k}) OVER (PARTITION BY tag ORDER BY {order})"
    before = lambda n: f"OVER (PARTITION BY tag ORDER BY {order} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    over = lambda f, n: f"CASE WHEN count({s}) {before(n)} >= {max(2, n // 4)} THEN {f}({s}) {before(n)} END"
    out = {f"lag_1{unit}": lag(1), f"lag_{short}{unit}": lag(short), f"delta_1{unit}": f"{s} - {lag(1)}", f"zscore_{long}{unit}": f"({s} - {over('avg', long)}) / nullif({over('stddev_samp', long)}, 0)"}
    out |= {f"{name}_{n}{unit}": over(f, n) for n in (short, long) for name, f in (("mean", "avg"), ("std", "stddev_samp"))}
    return ", ".join(f"round({x}, 6) AS {s}_{c}" for c, x in out.items())


_WRONG = {i: f"coalesce(parameter_name_{i} IN ('vibration', 'pressure') AND parameter_value_{i} < 0, FALSE)" for i in range(1, 5)}
CONDITION_SQL = f"""WITH c AS ({CONDITION}), g AS ({PROVENANCE_ROWS}),
f AS (SELECT c.tag, week_date, source_type, rca_demo_eligible, label_source, sun_feed_rate, sun_power, {", ".join(f"parameter_name_{i}, ({w})::INT AS parameter_{i}_invalid_physical, CASE WHEN NOT {w} THEN parameter_value_{i} END AS parameter_value_{i}" for i, w in _WRONG.items())}
  FROM c JOIN g ON c.tag = g.tag WHERE week_date <= DATE '2024-01-28')
SELECT tag, week_date, source_type, rca_demo_eligible, label_source, {", ".join(f"parameter_name_{i}, parameter_{i}_invalid_physical" for i in _WRONG)}, {" + ".join(f"parameter_{i}_invalid_physical" for i in _WRONG)} AS data_quality_flag_count,
  {", ".join(f"round({s}, 6) AS {s}" for s in SLOT_VALUES + WEEK_SIGNALS)}, {", ".join(_windows(s, "week_date", 2, 4, "w") for s in SLOT_VALUES + WEEK_SIGNALS)}, week(week_date) AS week_of_year, month(week_date) AS month, '1' AS feature_version FROM f"""
CONDITION_LABELS_SQL = f"""WITH c AS ({CONDITION}), g AS ({PROVENANCE_ROWS}) SELECT c.tag, week_date, health_status, failure_date, source_type, rca_demo_eligible, label_source,
  coalesce(failure_date::DATE - week_date BETWEEN 0 AND 6, FALSE)::INT AS is_event_week, TRUE AS status_label_is_rule_derived FROM c JOIN g ON c.tag = g.tag WHERE week_date <= DATE '2024-01-28'"""

PLANT_CONTEXT = """SELECT plant, date_trunc('hour', ts) AS hour_ts, count(DISTINCT e.tag) AS plant_running, avg(plant_rate) AS plant_mean_rate FROM {readings} r JOIN {equipment} e ON r.tag = e.tag WHERE run_status = 'ON' GROUP BY 1, 2"""


def _equipment(spark, sf_dir) -> DataFrame:
    registry, context = (adapters.run(spark, sf_dir, t) for t in (PROVENANCE_ROWS, PLANT_CONTEXT))
    rows = features.equipment_features(T(spark, sf_dir, "readings"), T(spark, sf_dir, "equipment"), registry, context, ["feed_rate", "power_kw"], ("ts", "event_id"), catalog.at("2024-01-25 00:00:00"), 4, 12)
    return rounded(rows.drop("hour_sin", "hour_cos", "day_of_week_sin", "day_of_week_cos"))


EQUIPMENT_SQL = f"""WITH g AS ({PROVENANCE_ROWS}), x AS ({PLANT_CONTEXT}), r AS (SELECT * FROM {{readings}} WHERE ts <= TIMESTAMP '2024-01-25 00:00:00'),
w AS (SELECT tag, ts, event_id, run_status, round(feed_rate, 6) AS feed_rate, round(power_kw, 6) AS power_kw, {", ".join(_windows(s, "ts, event_id", 4, 12, "h") for s in ("feed_rate", "power_kw"))}, hour(ts) AS hour, (dayofweek(ts) + 6) % 7 AS day_of_week, month(ts) AS month,
  (run_status = 'ON')::INT AS is_running, row_number() OVER (PARTITION BY tag ORDER BY ts DESC, event_id DESC) = 1 AS is_latest FROM r)
SELECT w.*, e.equipment_name, e.plant, e.equipment_type, round(e.price, 6) AS price, g.source_type, g.rca_demo_eligible, g.label_source, x.plant_running, round(x.plant_mean_rate, 6) AS plant_mean_rate, '1' AS feature_version
FROM w JOIN g ON g.tag = w.tag LEFT JOIN {{equipment}} e ON e.tag = w.tag LEFT JOIN x ON x.plant = e.plant AND x.hour_ts = date_trunc('hour', w.ts)"""


def _joint(spark, sf_dir) -> DataFrame:
    """Whether an entity fails within a day, on all signals together, learnt before and judged after the test's start."""
    rows = fitted._features(spark, sf_dir).persist()
    cut = F.lit(labels.split_boundaries(rows, "ts").first().test_start).cast("timestamp_ntz")
    found = models.joint_association(rows.where(F.col("ts") < cut), rows.where(F.col("ts") >= cut), fitted.SIGNALS, "y")
    return spark.createDataFrame([], "section string, name string, value double") if found is None else found


OPERATORS = {
    "win18_moves_28d": (_moves, MOVES_SQL),
    "dq21_join_steps": (_steps, STEPS_SQL),
    "agg37_parameter_baselines": (_baselines, BASELINES_SQL),
    "dq18_snapshot_rows": (_snapshots, SNAPSHOTS_SQL),
    "dq11_frame_manifest": (_manifest, MANIFEST_SQL),
    "src8_slides": (lambda s, d: docs_source.slides(T(s, d, "pages")), f"WITH {SLIDES_CTE} SELECT * FROM sl"),
    "src9_incident_registry": (_registry, f"WITH {REGISTRY_CTE} SELECT * FROM re"),
    "src9_case_corpus": (_corpus, CORPUS_SQL),
    "fea2_equipment_context": (_equipment, EQUIPMENT_SQL),
    "fea3_condition_slots": (lambda s, d: rounded(_condition(s, d)[0]), CONDITION_SQL),
    "fea3_condition_labels": (lambda s, d: _condition(s, d)[1], CONDITION_LABELS_SQL),
    "ml4_joint_association": (_joint, None),
}
