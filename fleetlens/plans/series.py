"""Queries of backtests by origin, hour grids, nearest rows, facets, and of streams run to the end of what there is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import origins, quality, timeseries
from ..sources import store
from ..streaming import flows
from . import adapters, catalog, fitted
from .adapters import rounded

T = adapters.frame
NAIVE = (origins.BASELINE, "last_value")


def _said(spark, sf_dir) -> DataFrame:
    days = store.stored(catalog._calendar(spark, sf_dir).drop("filled"))
    return origins.backtest(days, "region", "day", "y", NAIVE)


ORIGINS_CTE = f"""{catalog.CAL_CTE.replace("ca AS (", "ca AS MATERIALIZED (")}, sp AS (SELECT region, min(day) AS f, count(*) AS n FROM ca GROUP BY region),
og AS (SELECT region, k::INT AS fold, (f + (n - (4 - k) * 30 - 1)::INT)::DATE AS te FROM sp CROSS JOIN range(1, 4) t(k) WHERE n - (4 - k) * 30 >= 90),
kd AS MATERIALIZED (SELECT region * 1000000 + (day - DATE '1970-01-01') AS k, y FROM ca),
st AS MATERIALIZED (SELECT region, fold, region * 1000000 + (te - DATE '1970-01-01') AS kc, s, (s - 1) % 7 - 6 AS back FROM og CROSS JOIN range(1, 31) t(s)),
sd AS (SELECT st.region, fold, a.y AS actual, b.y AS naive, c.y AS flat FROM st JOIN kd a ON a.k = kc + s JOIN kd b ON b.k = kc + back JOIN kd c ON c.k = kc),
un AS (SELECT region, fold, 'seasonal_naive' AS method, naive - actual AS e, actual FROM sd UNION ALL SELECT region, fold, 'last_value', flat - actual, actual FROM sd),
er AS (SELECT region, method, fold, count(*) AS days, avg(abs(e)) AS mae, 100 * sum(abs(e)) / sum(abs(actual)) AS wape_pct, avg(e) AS bias FROM un GROUP BY ALL)"""
ORIGINS_SQL = f"WITH {ORIGINS_CTE} SELECT region, method, fold, days, round(mae, 4) AS mae, round(wape_pct, 4) AS wape_pct, round(bias, 4) AS bias FROM er"
CHOICE_SQL = f"""WITH {ORIGINS_CTE}, me AS (SELECT region, method, avg(mae) AS mae, avg(wape_pct) AS wape, avg(bias) AS bias FROM er GROUP BY ALL), ba AS (SELECT * FROM me WHERE method = 'seasonal_naive'),
wo AS (SELECT a.region, avg((a.wape_pct < b.wape_pct)::INT) AS won FROM er a JOIN er b ON b.region = a.region AND b.fold = a.fold AND b.method = 'seasonal_naive' WHERE a.method = 'last_value' GROUP BY a.region),
ca2 AS (SELECT ba.region, ba.wape AS bw, ba.mae AS bm, ba.bias AS bb, o.wape AS ow, o.mae AS om, o.bias AS ob, won, 100 * (ba.wape - o.wape) / ba.wape AS gain FROM ba JOIN me o ON o.region = ba.region AND o.method = 'last_value' JOIN wo ON wo.region = ba.region),
de AS (SELECT *, round(gain, 9) >= 1 AND round(won, 9) >= round(2 / 3, 9) AS better FROM ca2)
SELECT region, CASE WHEN better THEN 'last_value' ELSE 'seasonal_naive' END AS method, CASE WHEN better THEN '{origins.BEATEN}' ELSE '{origins.RETAINED}' END AS reason, round(CASE WHEN better THEN om ELSE bm END, 4) AS mae,
 round(CASE WHEN better THEN ow ELSE bw END, 4) AS wape_pct, round(CASE WHEN better THEN ob ELSE bb END, 4) AS bias, round(bw, 4) AS baseline_wape, round(CASE WHEN better THEN gain ELSE 0 END, 4) AS gain_pct, round(CASE WHEN better THEN won ELSE 1 END, 4) AS won FROM de"""


def _artefacts(spark, sf_dir):
    """The four tables in one: what they have in common, and their name."""
    days = store.stored(fitted._plant_days(spark, sf_dir))
    a = origins.artefacts(days, "plant", "day", "y", horizon=30, history_days=30, methods=(origins.BASELINE, "ridge"))
    none, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    wide = lambda name, df, day, method, value, low, high: df.select(F.lit(name).alias("artefact"), "plant", day.alias("day"), method.alias("method"), value.alias("value"), low.alias("lower"), high.alias("upper"))
    out = wide("history", a.history, F.col("day"), text, F.col("y"), none, none)
    out = out.unionByName(wide("prediction", a.prediction, F.col("day"), F.col("method"), F.col("forecast"), F.col("lower"), F.col("upper")))
    out = out.unionByName(wide("metrics", a.metrics, F.lit(None).cast("date"), F.col("method"), F.col("wape_pct"), F.col("baseline_wape"), F.col("won")))
    return rounded(out.unionByName(wide("backtest", a.backtest, F.col("day"), F.col("method"), F.col("forecast"), F.col("actual"), none)))


def _hour_grid(spark, sf_dir):
    return quality.hour_gaps(T(spark, sf_dir, "readings"), "tag", "ts")


GRID_SQL = """WITH h AS (SELECT DISTINCT tag, date_trunc('hour', ts) AS hour FROM {readings}), s AS (SELECT tag, min(hour) AS a, max(hour) AS b, count(*) AS seen FROM h GROUP BY tag),
g AS (SELECT tag, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS hour FROM s), m AS (SELECT g.tag, count(*) AS missing, min(g.hour) AS first_missing FROM g ANTI JOIN h ON h.tag = g.tag AND h.hour = g.hour GROUP BY g.tag)
SELECT s.tag, (date_diff('hour', a, b) + 1)::BIGINT AS expected, seen, coalesce(missing, 0) AS missing, first_missing FROM s LEFT JOIN m ON m.tag = s.tag"""


def _off_hours(spark, sf_dir):
    """Hours in which an entity is off against the hours that its incidents' downtime touches."""
    off = T(spark, sf_dir, "readings").where("run_status = 'OFF'").select("tag", F.date_trunc("hour", "ts").alias("hour"))
    down = quality.hours_expanded(T(spark, sf_dir, "incidents"), "tag", "failure_date", F.col("downtime_hours"))
    return quality.reconciled(off, down, "tag", "hour").withColumnsRenamed({"left_only": "off_only", "right_only": "incident_only"})


OFF_SQL = """WITH o AS (SELECT DISTINCT tag, date_trunc('hour', ts) AS hour FROM {readings} WHERE run_status = 'OFF'),
d AS (SELECT DISTINCT tag, date_trunc('hour', failure_date) + INTERVAL 1 HOUR * k AS hour FROM (SELECT tag, failure_date, unnest(range(ceil(downtime_hours)::BIGINT)) AS k FROM {incidents} WHERE downtime_hours > 0) x)
SELECT coalesce(o.tag, d.tag) AS tag, count(*) FILTER (o.tag IS NOT NULL AND d.tag IS NOT NULL) AS both, count(*) FILTER (d.tag IS NULL) AS off_only, count(*) FILTER (o.tag IS NULL) AS incident_only
FROM o FULL JOIN d ON o.tag = d.tag AND o.hour = d.hour GROUP BY 1"""


def _nearest(spark, sf_dir):
    found = timeseries.nearest_join(T(spark, sf_dir, "readings").select("event_id", "tag", "ts"), T(spark, sf_dir, "incidents").select("tag", "failure_date", "incident_seq"), "tag", "ts", "failure_date", ["incident_seq"], 36 * 3600)
    return found.select("event_id", "nearest_ts", "nearest_incident_seq")


NEAREST_SQL = """WITH a AS (SELECT r.event_id, r.ts, i.failure_date AS t0, i.incident_seq FROM {readings} r ASOF LEFT JOIN {incidents} i ON r.tag = i.tag AND r.ts >= i.failure_date),
b AS (SELECT r.event_id, i.failure_date AS t1, i.incident_seq FROM {readings} r ASOF LEFT JOIN {incidents} i ON r.tag = i.tag AND r.ts <= i.failure_date),
c AS (SELECT a.event_id, a.ts, t1 IS NULL OR coalesce(epoch_us(a.ts) - epoch_us(t0) <= epoch_us(t1) - epoch_us(a.ts), FALSE) AS earlier, t0, a.incident_seq AS s0, t1, b.incident_seq AS s1 FROM a JOIN b ON a.event_id = b.event_id),
d AS (SELECT event_id, ts, CASE WHEN earlier THEN t0 ELSE t1 END AS t, CASE WHEN earlier THEN s0 ELSE s1 END AS seq FROM c)
SELECT event_id, CASE WHEN abs(epoch_us(ts) - epoch_us(t)) <= 129600000000 THEN t END AS nearest_ts, CASE WHEN abs(epoch_us(ts) - epoch_us(t)) <= 129600000000 THEN seq END AS nearest_incident_seq FROM d"""


def _facets(spark, sf_dir):
    dim = T(spark, sf_dir, "equipment").withColumn("band", F.floor(F.coalesce("price", F.lit(-1.0)) / 2500))
    _, options = quality.facet_options(dim, {"plant": [0, 3, 7, 99], "equipment_type": ["BUILDING", "MACHINERY", "NONE"], "band": [0, 1]})
    return options


#: No chosen value but 99 and NONE is without a row on the given tables; those two drop out in the first round.
FACETS_SQL = """WITH d AS (SELECT plant, equipment_type, floor(coalesce(price, -1) / 2500)::BIGINT AS band FROM {equipment})
SELECT 'plant' AS field, plant::VARCHAR AS choice, plant IN (0, 3, 7, 99) AS chosen, count(*) AS n FROM d WHERE equipment_type IN ('BUILDING', 'MACHINERY', 'NONE') AND band IN (0, 1) GROUP BY plant
UNION ALL SELECT 'equipment_type', equipment_type, equipment_type IN ('BUILDING', 'MACHINERY', 'NONE'), count(*) FROM d WHERE plant IN (0, 3, 7, 99) AND band IN (0, 1) GROUP BY equipment_type
UNION ALL SELECT 'band', band::VARCHAR, band IN (0, 1), count(*) FROM d WHERE plant IN (0, 3, 7, 99) AND equipment_type IN ('BUILDING', 'MACHINERY', 'NONE') GROUP BY band"""


def _streamed(rows: DataFrame, ts: str, parts: int = 3) -> DataFrame:
    """rows as a stream of `parts` micro-batches in the order of time, each a folder of its own written after the one before."""
    spark, root = rows.sparkSession, store.scratch(rows.sparkSession)
    low, high = rows.agg(F.min(F.unix_micros(ts)), F.max(F.unix_micros(ts))).first()
    width = max(1, ((high or 0) - (low or 0)) // parts + 1)
    for k in range(parts):
        rows.where(F.floor((F.unix_micros(ts) - (low or 0)) / width) == k).coalesce(1).write.parquet(f"{root}/part={k}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/part=*")


def _zoned(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def _sessions(spark, sf_dir):
    alerts = _streamed(_zoned(T(spark, sf_dir, "scored").where("score >= 0.6").select("tag", "ts")), "ts")
    return flows.run_available(flows.episodes(alerts, delay="60 days"), store.scratch(spark), "complete")


def _rollup(spark, sf_dir):
    readings = _streamed(_zoned(T(spark, sf_dir, "readings").select("tag", "ts", "feed_rate")), "ts")
    return rounded(flows.run_available(flows.rollup(readings, "tag", "feed_rate", delay="60 days"), store.scratch(spark), "complete"))


def _live_persistence(spark, sf_dir):
    rows = _zoned(T(spark, sf_dir, "scored").select("tag", "ts", (F.col("score") >= 0.5).alias("hit")))
    with flows.rocks_state(spark):
        return flows.run_available(flows.live_persistence(_streamed(rows, "ts")), store.scratch(spark), "append").withColumn("hits", F.col("hits").cast("long"))


#: name: (query, SQL or None)
OPERATORS = {
    "fc5_rolling_origins": (lambda s, d: rounded(origins.errors(_said(s, d), "region"), 4), ORIGINS_SQL),
    "fc6_champion_by_origin": (lambda s, d: rounded(origins.choose(origins.errors(_said(s, d), "region"), "region"), 4), CHOICE_SQL),
    "fc7_artefacts": (_artefacts, None),
    "dq16_hour_grid": (_hour_grid, GRID_SQL),
    "dq17_off_hours": (_off_hours, OFF_SQL),
    "j14_nearest_incident": (_nearest, NEAREST_SQL),
    "fil6_facets_until_stable": (_facets, FACETS_SQL),
    "str4_live_persistence": (_live_persistence, "WITH h AS (SELECT *, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS h FROM {scored}) SELECT tag, ts, (sum(h) OVER w)::BIGINT AS hits, h = 1 AND sum(h) OVER w >= 3 AS persistent FROM h WINDOW w AS (PARTITION BY tag ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"),
    "str5_streamed_sessions": (_sessions, catalog.OPERATORS["str5_sessions"][1]),
    "str7_streamed_rollup": (_rollup, catalog.OPERATORS["str7_hourly_rollup"][1]),
}
