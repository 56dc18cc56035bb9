"""Audits, validation rules, feature tables, scenario tests and evidence rankings over the logical tables, as Spark SQL.

A name in braces is a table (see adapters). The next event of a reading comes from one descending window over readings
and incidents together, with incidents after readings of the same time, so that it lies strictly later.
"""

from __future__ import annotations

LATEST_WEEK = """l AS (SELECT tag, week_date, parameter_value, health_status FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY week_date DESC) AS i FROM {condition_weekly}) w WHERE i = 1)"""
SEVERITY = "CASE health_status WHEN 'TRIP' THEN 2 WHEN 'ALARM' THEN 1 ELSE 0 END"
NEXT_EVENT = """u AS (SELECT tag, ts, event_id, 0 AS k, CASE WHEN FALSE THEN ts END AS f FROM {readings} UNION ALL SELECT tag, failure_date, event_id, 1, failure_date FROM {incidents}),
        n AS (SELECT tag, ts, event_id, k, min(f) OVER (PARTITION BY tag ORDER BY ts DESC, k, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nxt FROM u)"""
DAILY = "d AS (SELECT tag, CAST(ts AS DATE) AS day, avg(feed_rate) AS rate FROM {readings} GROUP BY 1, 2)"
SIGNALS = """s AS (SELECT tag, 'feed_rate' AS feature, feed_rate AS v, ts, event_id FROM {readings} UNION ALL SELECT tag, 'hours', CAST(hour(ts) AS DOUBLE), ts, event_id FROM {readings}
        UNION ALL SELECT tag, 'off', CASE WHEN run_status = 'OFF' THEN 1e0 ELSE 0e0 END, ts, event_id FROM {readings}),
        b AS (SELECT feature, avg(v) AS m, stddev_pop(v) AS sd FROM s GROUP BY feature),
        z AS (SELECT tag, s.feature, round(avg((v - m) / nullif(sd, 0e0)), 9) AS z FROM s JOIN b ON s.feature = b.feature GROUP BY 1, 2)"""
HITS = """h AS (SELECT *, CASE WHEN score >= 5e-1 THEN 1 ELSE 0 END AS hit FROM {scored}),
        p AS (SELECT *, hit = 1 AND sum(hit) OVER (PARTITION BY tag ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) >= 3 AS alert FROM h)"""
KINDS = """e AS (SELECT doc_id, source, n_chars, CASE WHEN contains(lower(text), 'root cause') OR contains(lower(text), 'because') THEN 'cause' WHEN contains(lower(text), 'should') OR contains(lower(text), 'must') THEN 'action'
        WHEN contains(lower(text), 'summary') OR contains(lower(text), 'report') THEN 'summary' ELSE 'other' END AS kind FROM {documents} WHERE text IS NOT NULL)"""

QUERIES = {
    # Validation
    "dq3_validated_join": """WITH k AS (SELECT tag, count(*) AS n FROM {equipment} GROUP BY tag) SELECT count(*) AS joined, count(k.tag) AS matched, max(k.n) AS most_per_key, max(k.n) <= 1 AS many_to_one FROM {readings} r LEFT JOIN k ON r.tag = k.tag""",
    "dq10_event_audit": f"""WITH {NEXT_EVENT} SELECT tag, nxt AS next_failure_date, concat(CAST(tag AS STRING), '|', CAST(CAST(nxt AS DATE) AS STRING)) AS event_key, count(*) AS n,
        count(*) FILTER (WHERE ts >= nxt - INTERVAL 1 DAY) AS positive_1d, count(*) FILTER (WHERE ts >= nxt - INTERVAL 7 DAY) AS positive_7d, min(CASE WHEN ts >= nxt - INTERVAL 7 DAY THEN ts END) AS first_positive, max(ts) AS last_positive,
        nxt > TIMESTAMP '2024-01-20 00:00:00' AS is_future FROM n WHERE k = 0 AND nxt IS NOT NULL GROUP BY tag, nxt""",
    "dq14_reporting_contract": """SELECT 'unique_tag' AS rule, count(*) = count(DISTINCT tag) AS passed FROM {equipment} UNION ALL SELECT 'known_levels', count(*) FILTER (WHERE health_status NOT IN ('TRIP', 'ALARM', 'NORMAL')) = 0 FROM {condition_weekly}
        UNION ALL SELECT 'not_empty', count(*) > 0 FROM {readings} UNION ALL SELECT 'plants_known', count(*) = count(p.plant) FROM {equipment} e LEFT JOIN {plants} p ON e.plant = p.plant""",
    "dq16_validation_rules": """SELECT 'days_missing' AS rule, CAST(sum(days - seen) AS BIGINT) AS violations FROM (SELECT tag, count(DISTINCT CAST(ts AS DATE)) AS seen FROM {readings} GROUP BY tag) r CROSS JOIN (SELECT count(DISTINCT CAST(ts AS DATE)) AS days FROM {readings}) a
        UNION ALL SELECT 'sequence_gaps', CAST(sum(top - n) AS BIGINT) FROM (SELECT tag, max(incident_seq) AS top, count(*) AS n FROM {incidents} GROUP BY tag) i
        UNION ALL SELECT 'repeated_ids', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT event_id, count(*) AS n FROM {readings} GROUP BY event_id) r
        UNION ALL SELECT 'orphans', count(*) FROM {incidents} i LEFT ANTI JOIN {equipment} e ON i.tag = e.tag
        UNION ALL SELECT 'status_without_date', count(*) FROM {pm_schedule} WHERE (status = 'Completed') <> (completed_date IS NOT NULL)
        UNION ALL SELECT 'negative_or_null', count(*) FROM {environment} WHERE energy_kwh IS NULL OR energy_kwh < 0""",
    "dq17_off_reconciliation": """SELECT count(*) FILTER (WHERE i.event_id IS NULL) AS off_only, count(*) FILTER (WHERE r.event_id IS NULL) AS incident_only, count(*) FILTER (WHERE r.event_id IS NOT NULL AND i.event_id IS NOT NULL) AS both_sides
        FROM (SELECT event_id FROM {readings} WHERE run_status = 'OFF') r FULL OUTER JOIN (SELECT event_id FROM {incidents}) i ON r.event_id = i.event_id""",
    "dq18_snapshot_equality": """WITH r AS (SELECT tag, CAST(date_trunc('week', ts) AS DATE) AS week_date, sum(feed_rate) AS total, count(feed_rate) AS n FROM {readings} GROUP BY 1, 2)
        SELECT count(*) AS compared, count(*) FILTER (WHERE abs(total / n - parameter_value) > 1e-6 * greatest(1e0, abs(parameter_value))) AS different FROM {condition_weekly} c JOIN r ON c.tag = r.tag AND c.week_date = r.week_date""",
    "dq19_status_rederived": """WITH k AS (SELECT tag, CASE WHEN tag % 5 = 0 THEN 30e0 ELSE 60e0 END AS alarm, CASE WHEN tag % 5 = 0 THEN 20e0 ELSE 80e0 END AS trip FROM {equipment}),
        s AS (SELECT c.health_status, greatest(CASE WHEN (trip > alarm AND parameter_value >= trip) OR (trip <= alarm AND parameter_value <= trip) THEN 2 ELSE 0 END, CASE WHEN (trip > alarm AND parameter_value >= alarm) OR (trip <= alarm AND parameter_value <= alarm) THEN 1 ELSE 0 END) AS severity
        FROM {condition_weekly} c JOIN k ON c.tag = k.tag) SELECT health_status, CASE severity WHEN 2 THEN 'TRIP' WHEN 1 THEN 'ALARM' ELSE 'NORMAL' END AS derived, count(*) AS n FROM s GROUP BY 1, 2""",
    "dq20_alarm_run": """WITH w AS (SELECT tag, week_date, health_status, sum(CASE WHEN health_status <> 'ALARM' THEN 1 ELSE 0 END) OVER (PARTITION BY tag ORDER BY week_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM {condition_weekly}),
        a AS (SELECT tag, island, count(*) FILTER (WHERE health_status = 'ALARM') AS run FROM w GROUP BY tag, island) SELECT w.tag, w.week_date, coalesce(a.run, 0) AS alarm_weeks FROM w LEFT JOIN a ON w.tag = a.tag AND a.island = w.island - 1 WHERE w.health_status = 'TRIP'""",
    "dq21_drift": """WITH g AS (SELECT tag, avg(CASE WHEN ts < TIMESTAMP '2024-01-15 00:00:00' THEN feed_rate END) AS m0, avg(CASE WHEN ts >= TIMESTAMP '2024-01-15 00:00:00' THEN feed_rate END) AS m1,
        stddev_samp(CASE WHEN ts < TIMESTAMP '2024-01-15 00:00:00' THEN feed_rate END) AS s0, stddev_samp(CASE WHEN ts >= TIMESTAMP '2024-01-15 00:00:00' THEN feed_rate END) AS s1 FROM {readings} GROUP BY tag)
        SELECT tag, round(m1 / nullif(m0, 0e0), 6) AS mean_ratio, round(s1 / nullif(s0, 0e0), 6) AS std_ratio, abs(m1 / nullif(m0, 0e0) - 1) <= 3e-2 AS mean_ok, s1 / nullif(s0, 0e0) BETWEEN 6e-1 AND 14e-1 AS std_ok FROM g""",
    # Filters and joins
    "fil6_faceted_options": """SELECT 'plant' AS field, CAST(plant AS STRING) AS choice FROM {equipment} WHERE equipment_type IN ('BUILDING', 'MACHINERY') AND price > 0 GROUP BY plant
        UNION ALL SELECT 'equipment_type', equipment_type FROM {equipment} WHERE plant IN (1, 2, 3) AND price > 0 GROUP BY equipment_type""",
    "fil12_scope": """SELECT e.tag, e.equipment_name, p.plant_name FROM {equipment} e JOIN {plants} p ON e.plant = p.plant WHERE upper(p.plant_name) IN ('FRANCE', 'JAPAN') OR CAST(p.plant AS STRING) IN ('3', '7')""",
    "fil16_reproducible_sample": "SELECT event_id, tag, feed_rate FROM {readings} ORDER BY md5(concat('sample|', CAST(event_id AS STRING))), event_id LIMIT 25000",
    "j2_plant_day_environment": """WITH a AS (SELECT plant, CAST(failure_date AS DATE) AS day, count(*) AS failures FROM {incidents} i JOIN {equipment} e ON i.tag = e.tag GROUP BY 1, 2),
        v AS (SELECT plant, CAST(ts AS DATE) AS day, round(sum(energy_kwh), 2) AS energy FROM {environment} GROUP BY 1, 2) SELECT v.plant, v.day, v.energy, coalesce(a.failures, 0) AS failures FROM v LEFT JOIN a ON v.plant = a.plant AND v.day = a.day""",
    "j10_theta_cooldown": """WITH a AS (SELECT event_id, tag, ts FROM {scored} WHERE score >= 7e-1) SELECT a.event_id, a.tag, a.ts FROM a LEFT ANTI JOIN a b ON a.tag = b.tag AND a.event_id <> b.event_id AND b.ts <= a.ts AND b.ts > a.ts - INTERVAL 6 HOUR""",
    "j12_threshold_rows": """WITH g(threshold) AS (VALUES (2e-1), (4e-1), (5e-1), (6e-1), (8e-1)) SELECT threshold, split, count(*) AS n, count(*) FILTER (WHERE score >= threshold) AS predicted FROM {scored} CROSS JOIN g GROUP BY threshold, split""",
    "j13_candidate_against_baseline": f"""WITH {DAILY}, f AS (SELECT tag, day, rate, lag(rate, 1) OVER (PARTITION BY tag ORDER BY day) AS last_value, avg(rate) OVER (PARTITION BY tag ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS mean_7 FROM d),
        c AS (SELECT CAST(date_trunc('week', day) AS DATE) AS fold, avg(abs(rate - mean_7)) AS mae FROM f GROUP BY 1), b AS (SELECT CAST(date_trunc('week', day) AS DATE) AS fold, avg(abs(rate - last_value)) AS mae FROM f GROUP BY 1)
        SELECT c.fold, round(c.mae, 6) AS candidate, round(b.mae, 6) AS baseline, c.mae < b.mae AS won FROM c JOIN b ON c.fold = b.fold WHERE c.mae IS NOT NULL""",
    "j17_latest_task": """WITH t AS (SELECT pm_id, concat('Inspect #', CAST(tag AS STRING), ' ', pm_type) AS title, scheduled_date FROM {pm_schedule}),
        m AS (SELECT pm_id, scheduled_date, CAST(regexp_extract(title, '#([0-9]+) ', 1) AS BIGINT) AS tag FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY scheduled_date DESC, pm_id DESC) AS i FROM m)
        SELECT e.tag, r.pm_id, r.scheduled_date FROM {equipment} e JOIN r ON e.tag = r.tag WHERE i = 1""",
    # Aggregates
    "agg22_plant_levels": f"""WITH {LATEST_WEEK}, p AS (SELECT e.plant, count(*) AS equipment, count(*) FILTER (WHERE health_status = 'TRIP') AS trip, count(*) FILTER (WHERE health_status = 'ALARM') AS alarm, count(*) FILTER (WHERE health_status = 'NORMAL') AS normal,
        count(*) FILTER (WHERE week_date < DATE '2024-01-15') AS stale, max(parameter_value) AS top FROM l JOIN {{equipment}} e ON l.tag = e.tag GROUP BY e.plant)
        SELECT plant, equipment, trip, alarm, normal, stale, round(top, 6) AS top_value, CAST(row_number() OVER (ORDER BY trip DESC, alarm DESC, top DESC, plant) AS BIGINT) AS plant_rank FROM p""",
    "agg28_most_common": "SELECT tag, pm_type, n FROM (SELECT tag, pm_type, count(*) AS n, row_number() OVER (PARTITION BY tag ORDER BY count(*) DESC, pm_type) AS i FROM {pm_schedule} GROUP BY tag, pm_type) m WHERE i = 1",
    "agg29_quiet_baseline": """SELECT tag, count(*) AS n, round(avg(feed_rate), 6) AS mean_rate, round(stddev_samp(feed_rate) / nullif(avg(feed_rate), 0e0), 6) AS cv
        FROM (SELECT r.tag, r.feed_rate FROM {readings} r LEFT ANTI JOIN {incidents} i ON r.tag = i.tag AND r.ts >= i.failure_date - INTERVAL 2 DAY AND r.ts <= i.failure_date + INTERVAL 1 DAY WHERE r.run_status = 'ON') q GROUP BY tag""",
    "agg33_series_kpis": f"""WITH {DAILY}, r AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY day DESC) AS i FROM d),
        k AS (SELECT tag, max(CASE WHEN i = 1 THEN rate END) AS latest, avg(CASE WHEN i <= 30 THEN rate END) AS mean_30, avg(CASE WHEN i <= 7 THEN rate END) AS mean_7 FROM r GROUP BY tag),
        c AS (SELECT *, 100 * (mean_7 - mean_30) / nullif(mean_30, 0e0) AS change FROM k)
        SELECT tag, round(latest, 6) AS latest, round(mean_30, 6) AS mean_30, round(mean_7, 6) AS mean_7, round(change, 4) AS change_pct, CASE WHEN round(change, 4) > 1 THEN 'UP' WHEN round(change, 4) < -1 THEN 'DOWN' ELSE 'STABLE' END AS direction FROM c""",
    "agg34_global_importance": f"WITH {SIGNALS} SELECT feature, round(avg(abs(z)), 6) AS importance FROM z GROUP BY feature ORDER BY importance DESC, feature LIMIT 12",
    "agg35_ppm_to_mg": "SELECT plant, CAST(ts AS DATE) AS day, round(avg(nox_ppm) * 46.01e0 / 24.45e0, 6) AS nox_mg_nm3, round(avg(sox_ppm) * 64.07e0 / 24.45e0, 6) AS sox_mg_nm3 FROM {environment} GROUP BY 1, 2",
    "agg37_parameter_ramp": """WITH q AS (SELECT c.tag, avg(parameter_value) AS m, stddev_samp(parameter_value) AS sd FROM (SELECT c.tag, c.parameter_value FROM {condition_weekly} c LEFT ANTI JOIN {incidents} i ON c.tag = i.tag AND CAST(i.failure_date AS DATE) >= c.week_date AND CAST(i.failure_date AS DATE) <= c.week_date + INTERVAL 6 DAY) c GROUP BY c.tag),
        f AS (SELECT DISTINCT c.tag, c.week_date, c.parameter_value FROM {condition_weekly} c JOIN {incidents} i ON c.tag = i.tag AND CAST(date_trunc('week', i.failure_date) AS DATE) = c.week_date)
        SELECT q.tag, round(m, 6) AS mean_value, round(sd, 6) AS sd_value, round(avg((f.parameter_value - m) / nullif(80 - m, 0e0)), 6) AS ramp FROM q LEFT JOIN f ON q.tag = f.tag GROUP BY q.tag, m, sd""",
    # Windows and rankings
    "win9_gaps": "SELECT tag, event_id, previous FROM (SELECT tag, event_id, ts, lag(ts) OVER (PARTITION BY tag ORDER BY ts, event_id) AS previous FROM {readings}) g WHERE ts > previous + INTERVAL 12 HOUR",
    "win11_risk_rank": f"WITH {LATEST_WEEK} SELECT tag, health_status, CAST(row_number() OVER (ORDER BY {SEVERITY} DESC, round(parameter_value, 9) DESC, tag) AS BIGINT) AS risk_rank FROM l",
    "win12_spearman": """WITH a AS (SELECT r.tag, round(avg(feed_rate), 6) AS x, count(*) AS y FROM {readings} r GROUP BY r.tag),
        k AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2e0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2e0 AS ry FROM a) SELECT count(*) AS n, round(corr(rx, ry), 6) AS spearman FROM k""",
    "win18_bucket_moves": """WITH b AS (SELECT tag, CAST(date_trunc('week', ts) AS DATE) AS bucket, avg(feed_rate) AS m FROM {readings} GROUP BY 1, 2),
        d AS (SELECT tag, bucket, m - lag(m) OVER (PARTITION BY tag ORDER BY bucket) AS move FROM b) SELECT tag, bucket, round(move, 6) AS move FROM d WHERE move IS NOT NULL""",
    "top3_top_features": f"WITH {SIGNALS} SELECT tag, feature, z, CAST(i AS BIGINT) AS feature_rank FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY abs(z) DESC, feature) AS i FROM z) r WHERE i <= 2",
    "top5_candidate_choice": """WITH c AS (SELECT tag % 10 AS candidate, count(*) AS n, round(avg(score), 9) AS mean_score, count(*) FILTER (WHERE y = 1) AS positives FROM {scored} GROUP BY 1) SELECT candidate, n, positives FROM c WHERE positives > 0 ORDER BY positives DESC, mean_score, candidate LIMIT 1""",
    # Labels, feature tables and folds
    # Evaluation
    "met11_cohorts": "SELECT CASE WHEN tag % 10 = 0 THEN 'held_out' ELSE 'support' END AS cohort, count(*) AS n, count(DISTINCT tag) AS entities, count(*) FILTER (WHERE score >= 5e-1 AND y = 1) AS tp, count(*) FILTER (WHERE score >= 5e-1 AND y = 0) AS fp, round(avg((score - y) * (score - y)), 6) AS brier FROM {scored} GROUP BY 1",
    # Text and evidence
    "txt3_query_text": f"""WITH {SIGNALS}, r AS (SELECT tag, feature, row_number() OVER (PARTITION BY tag ORDER BY abs(z) DESC, feature) AS i FROM z), t AS (SELECT tag, max(CASE WHEN i = 1 THEN feature END) AS a, max(CASE WHEN i = 2 THEN feature END) AS b FROM r GROUP BY tag)
        SELECT e.tag, concat_ws(' ', equipment_name, lower(equipment_type), replace(a, '_', ' '), replace(b, '_', ' ')) AS query FROM {{equipment}} e JOIN t ON e.tag = t.tag""",
    "txt4_balanced_evidence": f"""WITH {KINDS}, r AS (SELECT *, row_number() OVER (PARTITION BY source, kind ORDER BY n_chars DESC, doc_id) AS k FROM e), o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN k = 1 AND kind <> 'other' THEN 0 ELSE 1 END, n_chars DESC, doc_id) AS i FROM r)
        SELECT source, doc_id, kind, CAST(i AS BIGINT) AS place FROM o WHERE i <= 5""",
    "txt5_evidence_kinds": f"WITH {KINDS} SELECT doc_id, kind FROM e",
    "txt6_qualified_references": """WITH q AS (SELECT event_id, tag, score, event_id % 7 = 0 AS verified FROM {scored} WHERE score > 7e-1 OR (event_id % 7 = 0 AND y = 1)), r AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY verified DESC, score DESC, event_id) AS i FROM q)
        SELECT tag, event_id, verified, CAST(i AS BIGINT) AS place FROM r WHERE i <= 3""",
    "txt7_guidance_steps": f"""WITH {SIGNALS}, m(feature, step) AS (VALUES ('feed_rate', 'Check the feed line'), ('hours', 'Review the shift log'), ('off', 'Inspect the trip history')), g AS (SELECT z.tag, m.step, max(abs(z)) AS weight FROM z JOIN m ON z.feature = m.feature GROUP BY z.tag, m.step)
        SELECT tag, step, CAST(i AS BIGINT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY weight DESC, step) AS i FROM g) r WHERE i <= 4""",
}
