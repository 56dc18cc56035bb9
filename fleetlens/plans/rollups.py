"""Declarative queries: filters, rollups, rankings and set operations over the logical tables, as Spark SQL.

A name in braces is a table (see adapters). All filters and projections reach the Parquet scans, rollups aggregate
before they shuffle, and dimensions are joined by whatever strategy Spark picks from their sizes.
"""

from __future__ import annotations

PERIOD = "ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00'"
INCIDENTS = "failure_date >= TIMESTAMP '2024-01-05 00:00:00' AND failure_date < TIMESTAMP '2024-01-20 00:00:00'"

QUERIES = {
    # Sources
    "src16_row_counts": """SELECT 'readings' AS name, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM {readings}
        UNION ALL SELECT 'incidents', count(*), min(failure_date), max(failure_date) FROM {incidents}
        UNION ALL SELECT 'environment', count(*), min(ts), max(ts) FROM {environment}""",
    "src17_freshness": """SELECT r.newest AS newest_reading, i.newest AS newest_incident, p.newest AS newest_pm, r.newest < TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 3 HOUR AS stale
        FROM (SELECT max(ts) AS newest FROM {readings}) r CROSS JOIN (SELECT max(failure_date) AS newest FROM {incidents}) i
        CROSS JOIN (SELECT max(coalesce(completed_date, scheduled_date)) AS newest FROM {pm_schedule}) p""",
    "src18_date_bounds": "SELECT CAST(min(ts) AS DATE) AS first_day, CAST(max(ts) AS DATE) AS last_day, count(DISTINCT tag) AS tags FROM {readings}",
    "src11_load_if_absent": """WITH live AS (SELECT * FROM {incidents} WHERE event_id % 3 > 0), staged AS (SELECT * FROM {incidents} WHERE event_id % 2 = 0)
        SELECT tag, incident_seq, downtime_hours FROM live UNION ALL
        SELECT s.tag, s.incident_seq, s.downtime_hours FROM staged s LEFT ANTI JOIN live l ON s.tag = l.tag AND s.incident_seq = l.incident_seq""",
    "src12_keyed_upsert": """WITH target AS (SELECT tag, incident_seq, downtime_hours FROM {incidents}), source AS (SELECT tag, incident_seq, downtime_hours + 1 AS downtime_hours FROM {incidents} WHERE tag % 4 = 0)
        SELECT tag, incident_seq, downtime_hours FROM source UNION ALL
        SELECT t.tag, t.incident_seq, t.downtime_hours FROM target t LEFT ANTI JOIN source s ON t.tag = s.tag AND t.incident_seq = s.incident_seq""",
    "src19_split_by_clock": """SELECT CASE WHEN ts > TIMESTAMP '2024-01-20 00:00:00' THEN 'staging' ELSE 'live' END AS part, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts
        FROM {readings} GROUP BY 1""",
    # Filters
    "fil1_in_list": "SELECT event_id, tag, feed_rate FROM {readings} WHERE tag IN (1, 3, 5, 7, 11)",
    "fil2_half_open_range": f"SELECT event_id, tag, ts FROM {{readings}} WHERE {PERIOD}",
    "fil3_closed_dates": "SELECT pm_id, scheduled_date, status FROM {pm_schedule} WHERE scheduled_date BETWEEN DATE '1996-01-01' AND DATE '1996-03-31'",
    "fil4_entity_series": f"SELECT ts, feed_rate, plant_rate, run_status FROM {{readings}} WHERE tag = 3 AND {PERIOD} ORDER BY ts",
    "fil7_risk_list_filter": """SELECT tag, equipment_name, plant FROM {equipment} WHERE plant IN (1, 2, 3, 4) AND equipment_type IN ('BUILDING', 'MACHINERY')
        AND contains(lower(concat_ws(' ', CAST(tag AS STRING), equipment_name, equipment_type)), 'mach')""",
    "fil9_priority_branches": """SELECT event_id, CASE WHEN feed_rate >= 150 THEN 'ACTION_NOW' WHEN feed_rate >= 100 THEN 'PLAN_MAINTENANCE' WHEN run_status = 'OFF' THEN 'REVIEW' WHEN feed_rate >= 50 THEN 'MONITOR' ELSE 'NORMAL' END AS level FROM {readings}""",
    "fil10_suppress_on_review": """SELECT event_id, feed_rate >= 100 AND NOT coalesce(run_status = 'OFF', FALSE) AS alert, feed_rate >= 60 AND NOT coalesce(run_status = 'OFF', FALSE) AS warning FROM {readings}""",
    "fil11_value_map": """WITH m(status, severity) AS (VALUES ('Completed', 'Low'), ('Planned', 'Medium'), ('Missed', 'High')) SELECT pm_id, severity FROM {pm_schedule} JOIN m USING (status)""",
    "fil13_workflow_status": """SELECT pm_id, CASE WHEN lower(trim(status)) IN ('completed', 'closed', 'done') THEN 'Solved' ELSE coalesce(nullif(trim(status), ''), 'Unknown') END AS workflow FROM {pm_schedule}""",
    "fil14_reading_status": """SELECT event_id, CASE WHEN feed_rate >= trip THEN 'TRIP' WHEN feed_rate >= alarm THEN 'ALARM' ELSE 'NORMAL' END AS status
        FROM {readings} JOIN (SELECT tag AS t, CASE WHEN tag % 3 > 0 THEN 60 END AS alarm, CASE WHEN tag % 5 > 0 THEN 120 END AS trip FROM {equipment}) e ON tag = t""",
    "fil15_plants_needing_attention": """SELECT plant, count(*) FILTER (WHERE health_status <> 'NORMAL') AS abnormal FROM {condition_weekly} c JOIN {equipment} e ON c.tag = e.tag
        GROUP BY plant HAVING count(*) FILTER (WHERE health_status <> 'NORMAL') > 0""",
    "fil17_incident_timeline": f"SELECT i.tag, plant_name, failure_date, downtime_hours, failure_mode FROM {{incidents}} i JOIN {{equipment}} e ON i.tag = e.tag JOIN {{plants}} p ON e.plant = p.plant WHERE {INCIDENTS}",
    # Joins
    "j1_dimension_enrichment": "SELECT event_id, r.tag, equipment_name, plant FROM {readings} r LEFT JOIN {equipment} e ON r.tag = e.tag",
    "j3_one_to_one": "SELECT r.event_id, r.feed_rate, s.score, s.y FROM {readings} r JOIN {scored} s ON r.tag = s.tag AND r.ts = s.ts AND r.event_id = s.event_id",
    "j4_star_join": "SELECT plant_name, equipment_type, count(*) AS n, round(sum(feed_rate), 4) AS total FROM {readings} r JOIN {equipment} e ON r.tag = e.tag JOIN {plants} p ON e.plant = p.plant GROUP BY plant_name, equipment_type",
    "j5_flag_default": "SELECT r.event_id, coalesce(i.is_source_rca, FALSE) AS is_rca FROM {readings} r LEFT JOIN {incidents} i ON r.tag = i.tag AND r.ts = i.failure_date AND r.event_id = i.event_id",
    "j11_semi_anti": "SELECT tag, equipment_name, TRUE AS failed FROM {equipment} e LEFT SEMI JOIN {incidents} i ON e.tag = i.tag UNION ALL SELECT tag, equipment_name, FALSE FROM {equipment} e LEFT ANTI JOIN {incidents} i ON e.tag = i.tag",
    "j14_fixed_key_list": "WITH k(level) AS (VALUES ('NORMAL'), ('ALARM'), ('TRIP'), ('UNKNOWN')) SELECT k.level, coalesce(n, 0) AS n FROM k LEFT JOIN (SELECT health_status, count(*) AS n FROM {condition_weekly} GROUP BY health_status) c ON k.level = c.health_status",
    "j15_link_with_exists": """SELECT s.event_id, i.incident_seq FROM {scored} s JOIN {incidents} i ON s.event_id = i.event_id WHERE s.score >= 0.7 AND EXISTS (SELECT 1 FROM {pm_schedule} p WHERE p.tag = s.tag)""",
    "j16_incident_days": """SELECT d.tag, d.day, d.feed_rate, i.day IS NOT NULL AS incident_day FROM (SELECT tag, CAST(ts AS DATE) AS day, round(avg(feed_rate), 6) AS feed_rate FROM {readings} GROUP BY 1, 2) d
        LEFT JOIN (SELECT DISTINCT tag, CAST(failure_date AS DATE) AS day FROM {incidents}) i ON d.tag = i.tag AND d.day = i.day""",
    # Aggregations
    "agg1_plant_hour": """SELECT plant, date_trunc('hour', ts) AS hour_ts, count(DISTINCT r.tag) AS equipment, count(*) FILTER (WHERE run_status = 'ON') AS running, round(sum(power_kw), 4) AS sum_power,
        round(avg(power_kw), 6) AS mean_power, round(sum(plant_rate), 4) AS sum_rate, round(avg(plant_rate), 6) AS mean_rate, round(avg(feed_rate), 6) AS mean_feed FROM {readings} r JOIN {equipment} e ON r.tag = e.tag GROUP BY 1, 2""",
    "agg2_energy_intensity": "SELECT plant, round(sum(energy_kwh) / nullif(sum(co2_ton), 0), 6) AS intensity FROM {environment} GROUP BY plant",
    "agg4_conditional_count": "SELECT tag, count(*) FILTER (WHERE status = 'Completed') AS completed, count(*) AS total FROM {pm_schedule} GROUP BY tag",
    "agg5_daily_power": f"SELECT tag, CAST(ts AS DATE) AS day, round(avg(power_kw), 6) AS avg_power_kw FROM {{readings}} WHERE {PERIOD} GROUP BY 1, 2",
    "agg6_daily_rate_of_one": f"SELECT CAST(ts AS DATE) AS day, round(avg(feed_rate), 6) AS feed_rate, round(avg(plant_rate), 6) AS plant_rate FROM {{readings}} WHERE tag = 3 AND {PERIOD} GROUP BY 1",
    "agg7_two_level_rate": f"""SELECT day, round(sum(feed_rate), 4) AS feed_rate, round(sum(plant_rate), 4) AS plant_rate FROM (SELECT tag, CAST(ts AS DATE) AS day, avg(feed_rate) AS feed_rate, avg(plant_rate) AS plant_rate
        FROM {{readings}} WHERE {PERIOD} GROUP BY 1, 2) d GROUP BY day""",
    "agg8_daily_run_status": """SELECT tag, CAST(ts AS DATE) AS day, round(avg(feed_rate), 6) AS avg_feed_rate, count(*) FILTER (WHERE run_status = 'ON') AS on_observations,
        count(*) FILTER (WHERE run_status <> 'ON' OR run_status IS NULL) AS off_observations, count(*) AS total_observations FROM {readings} GROUP BY 1, 2""",
    "agg9_availability_ranking": "SELECT tag, round(100 * avg(CASE WHEN run_status = 'ON' THEN 1 ELSE 0 END), 6) AS availability_pct FROM {readings} GROUP BY tag",
    "agg10_bad_actors": "SELECT tag, count(*) AS n, round(sum(downtime_hours), 4) AS downtime, CAST(row_number() OVER (ORDER BY count(*) DESC, round(sum(downtime_hours), 4) DESC, tag) AS BIGINT) AS rank FROM {incidents} GROUP BY tag",
    "agg11_downtime_by_mode": "SELECT failure_mode, count(*) AS n, round(sum(downtime_hours), 4) AS downtime FROM {incidents} WHERE failure_mode IS NOT NULL GROUP BY failure_mode",
    "agg12_downtime_by_plant_and_mode": "SELECT plant, failure_mode, round(sum(downtime_hours), 4) AS downtime FROM {incidents} i JOIN {equipment} e ON i.tag = e.tag GROUP BY plant, failure_mode",
    "agg13_mode_frequency": "SELECT failure_mode, count(*) AS n FROM {incidents} GROUP BY failure_mode",
    "agg14_environment_kpis": """SELECT plant, round(sum(co2_ton), 4) AS co2, round(avg(nox_ppm), 6) AS nox, round(avg(sox_ppm), 6) AS sox, round(sum(voc_kg), 4) AS voc, round(sum(energy_kwh), 2) AS energy, count(*) AS hours,
        count(*) FILTER (WHERE nox_ppm <= 8 AND sox_ppm <= 6) AS compliant FROM {environment} GROUP BY plant""",
    "agg15_environment_trend": "SELECT plant, CAST(ts AS DATE) AS day, round(avg(nox_ppm), 6) AS nox FROM {environment} GROUP BY 1, 2",
    "agg16_plant_benchmark": "SELECT plant, round(avg(co2_ton), 6) AS co2, round(avg(nox_ppm), 6) AS nox, round(avg(sox_ppm), 6) AS sox, round(avg(voc_kg), 6) AS voc, round(avg(wastewater_m3), 6) AS water, round(avg(energy_kwh), 4) AS energy FROM {environment} GROUP BY plant",
    "agg17_composition": """SELECT day, round(sum(co2), 9) AS co2_ton, round(sum(voc), 9) AS voc_kg, round(avg(nox), 6) AS nox_ppm, round(avg(sox), 6) AS sox_ppm FROM (SELECT plant, CAST(ts AS DATE) AS day, avg(co2_ton) AS co2, avg(voc_kg) AS voc, avg(nox_ppm) AS nox, avg(sox_ppm) AS sox
        FROM {environment} GROUP BY 1, 2) d GROUP BY day""",
    "agg18_scaled_composition": "WITH c AS (SELECT plant, sum(co2_ton) AS co2, sum(voc_kg) AS voc FROM {environment} GROUP BY plant) SELECT plant, round(co2 / max(co2) OVER (), 6) AS co2, round(voc / max(voc) OVER (), 6) AS voc FROM c",
    "agg19_period_over_period": """WITH p AS (SELECT plant, sum(CASE WHEN ts >= TIMESTAMP '1997-01-01 00:00:00' THEN energy_kwh END) / 1e6 AS now_gwh, sum(CASE WHEN ts < TIMESTAMP '1997-01-01 00:00:00' THEN energy_kwh END) / 1e6 AS before_gwh
        FROM {environment} WHERE ts >= TIMESTAMP '1996-01-01 00:00:00' AND ts < TIMESTAMP '1998-01-01 00:00:00' GROUP BY plant)
        SELECT plant, round(now_gwh, 6) AS now_gwh, round(before_gwh, 6) AS before_gwh, round(now_gwh * 85.98, 4) AS now_toe, round(100 * (now_gwh - before_gwh) / nullif(before_gwh, 0), 4) AS change_pct FROM p""",
    "agg20_plant_day_targets": """SELECT plant, CAST(ts AS DATE) AS day, round(sum(energy_kwh), 2) AS energy, round(sum(co2_ton), 4) AS co2, round(avg(nox_ppm), 6) AS nox, round(avg(sox_ppm), 6) AS sox, count(*) AS hours
        FROM {environment} WHERE energy_kwh >= 0 AND co2_ton IS NOT NULL GROUP BY 1, 2""",
    "agg21_daily_sensors_and_label": """SELECT a.tag, a.day, a.feed_rate, b.y, b.mean_score FROM (SELECT tag, CAST(ts AS DATE) AS day, round(avg(feed_rate), 6) AS feed_rate FROM {readings} GROUP BY 1, 2) a
        LEFT JOIN (SELECT tag, CAST(ts AS DATE) AS day, CAST(max(y) AS BIGINT) AS y, round(avg(score), 6) AS mean_score FROM {scored} WHERE split = 'test' GROUP BY 1, 2) b ON a.tag = b.tag AND a.day = b.day""",
    "agg23_level_counts": "WITH k(pos, level) AS (VALUES (1, 'TRIP'), (2, 'ALARM'), (3, 'NORMAL'), (4, 'NONE')) SELECT k.pos, k.level, count(c.tag) AS n FROM k LEFT JOIN {condition_weekly} c ON k.level = c.health_status GROUP BY k.pos, k.level",
    "agg25_distinct_events": "SELECT split, count(DISTINCT CASE WHEN y = 1 THEN concat(CAST(tag AS STRING), '|', CAST(CAST(ts AS DATE) AS STRING)) END) AS events FROM {scored} GROUP BY split",
    "agg26_exposure": "SELECT split, round(count(DISTINCT concat(CAST(tag AS STRING), '|', CAST(CAST(ts AS DATE) AS STRING))) / 30.4375, 6) AS months, count(DISTINCT CASE WHEN score >= 0.6 AND y = 0 THEN concat(CAST(tag AS STRING), '|', CAST(CAST(ts AS DATE) AS STRING)) END) AS false_days FROM {scored} GROUP BY split",
    "agg30_production_change": """WITH d AS (SELECT tag, CAST(ts AS DATE) AS day, avg(feed_rate) AS rate FROM {readings} GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY day) AS i, row_number() OVER (PARTITION BY tag ORDER BY day DESC) AS j, count(*) OVER (PARTITION BY tag) AS n FROM d),
        k AS (SELECT *, greatest(1, least(7, floor(n / 2))) AS k FROM o), c AS (SELECT tag, avg(CASE WHEN i <= k THEN rate END) AS base, avg(CASE WHEN j <= k THEN rate END) AS latest FROM k GROUP BY tag)
        SELECT tag, round(base, 6) AS base, round(latest, 6) AS latest, round(latest - base, 6) AS change, round(CASE WHEN abs(base) > 1e-9 THEN 100 * (latest - base) / base END, 6) AS change_pct FROM c""",
    "agg31_decline_ranking": """WITH d AS (SELECT tag, avg(CASE WHEN ts < TIMESTAMP '2024-01-15 00:00:00' THEN feed_rate END) AS before, avg(CASE WHEN ts >= TIMESTAMP '2024-01-15 00:00:00' THEN feed_rate END) AS after, avg(CASE WHEN run_status = 'ON' THEN 0 ELSE 1 END) AS off_share FROM {readings} GROUP BY tag)
        SELECT tag, round(after - before, 6) AS change, round(off_share, 6) AS off_share FROM d WHERE after < before""",
    "agg36_health_matrix": "SELECT tag, week_date, max(CASE health_status WHEN 'TRIP' THEN 2 WHEN 'ALARM' THEN 1 ELSE 0 END) AS code FROM {condition_weekly} GROUP BY tag, week_date",
    # Windows
    "win3_latest_row": "SELECT tag, ts, feed_rate FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY ts DESC, event_id DESC) AS i FROM {readings}) r WHERE i = 1",
    "win4_scoring_window": "SELECT event_id, tag, ts FROM (SELECT *, max(ts) OVER (PARTITION BY tag) AS last_ts FROM {readings}) r WHERE ts >= last_ts - INTERVAL 23 HOUR",
    "win5_observation_end": "SELECT event_id, max(ts) OVER (PARTITION BY tag) AS observation_window_end FROM {readings}",
    "win10_pareto": """WITH c AS (SELECT failure_mode, count(*) AS n, sum(downtime_hours) AS downtime FROM {incidents} WHERE failure_mode IS NOT NULL GROUP BY failure_mode)
        SELECT failure_mode, n, round(100e0 * sum(n) OVER (ORDER BY n DESC, round(downtime, 6) DESC, failure_mode ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(n) OVER (), 6) AS cumulative_pct FROM c""",
    "win13_rolling_mean_7": "SELECT event_id, round(avg(feed_rate) OVER (PARTITION BY tag ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS mean_7 FROM {readings}",
    "win16_first_event_row": "SELECT tag, day, event_id FROM (SELECT tag, CAST(failure_date AS DATE) AS day, event_id, row_number() OVER (PARTITION BY tag, CAST(failure_date AS DATE) ORDER BY is_source_rca DESC, incident_seq) AS i FROM {incidents}) f WHERE i = 1",
    "win17_last_rows": "SELECT tag, event_id FROM (SELECT tag, event_id, row_number() OVER (PARTITION BY tag ORDER BY ts DESC, event_id DESC) AS i FROM {readings}) r WHERE i <= 30",
    # Top k and sets
    "top1_detail_and_total": f"SELECT event_id, tag, ts, feed_rate, total FROM (SELECT event_id, tag, ts, feed_rate FROM {{readings}} WHERE {PERIOD} ORDER BY ts DESC, event_id LIMIT 2000) d CROSS JOIN (SELECT count(*) AS total FROM {{readings}} WHERE {PERIOD}) t",
    "top2_page": "SELECT event_id, tag FROM {readings} ORDER BY ts DESC, event_id LIMIT 50 OFFSET 100",
    "top4_priority_ten": "SELECT tag, week_date, parameter_value FROM {condition_weekly} WHERE health_status <> 'NORMAL' ORDER BY parameter_value DESC, tag, week_date LIMIT 10",
    "top6_dominant_signal": """SELECT tag, CASE WHEN a >= b AND a >= c THEN 'feed' WHEN b >= c THEN 'power' ELSE 'rate' END AS dominant FROM (SELECT tag, round(abs(avg(feed_rate) - 50), 9) AS a, round(abs(avg(power_kw) - 110), 9) AS b, round(abs(avg(plant_rate) - 35), 9) AS c FROM {readings} GROUP BY tag) s""",
    "set1_concat_frames": "SELECT event_id, tag, score, 7 AS horizon FROM {scored} WHERE split = 'test' UNION ALL SELECT event_id, tag, score * 0.5, 30 FROM {scored} WHERE split = 'validation'",
    "set2_missing_keys": "SELECT tag FROM {equipment} EXCEPT SELECT tag FROM {incidents}",
    "set4_distinct_pairs": "SELECT DISTINCT tag, CAST(ts AS DATE) AS day FROM {readings}",
    # Data quality
    "dq2_duplicate_keys": "SELECT coalesce(sum(n - 1), 0) AS duplicates, count(*) AS keys FROM (SELECT tag, CAST(ts AS DATE) AS day, count(*) AS n FROM {readings} GROUP BY 1, 2) k",
    "dq4_orphans": "SELECT count(*) AS orphans FROM {environment} v LEFT ANTI JOIN {plants} p ON v.plant = p.plant",
    "dq5_as_of_cutoff": "SELECT event_id, ts FROM {readings} WHERE ts <= TIMESTAMP '2024-01-10 12:00:00'",
    "dq8_negative_to_null": "SELECT event_id, CASE WHEN feed_rate - 20 < 0 THEN NULL ELSE feed_rate - 20 END AS feed_rate, CASE WHEN feed_rate - 20 < 0 THEN 1 ELSE 0 END AS flag FROM {readings}",
    "dq15_usable_features": "SELECT count(feed_rate) > 0 AND count(DISTINCT feed_rate) > 1 AS feed_rate, count(power_kw) > 0 AND count(DISTINCT power_kw) > 1 AS power_kw FROM {readings}",
    "dq23_split_viability": "SELECT split, count(*) AS n, count(DISTINCT y) = 2 AS viable FROM {scored} GROUP BY split",
}
