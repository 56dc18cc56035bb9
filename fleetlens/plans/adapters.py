"""Logical tables of the library, derived from the star schema by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")

TABLES = {
    "readings": """SELECT event_id, user_id AS tag, ts, CASE WHEN event_type = 'error' THEN 'OFF' ELSE 'ON' END AS run_status,
        value AS feed_rate, value * 0.8 AS plant_rate, value * 2 AS power_kw, event_type FROM {events}""",
    "incidents": """SELECT event_id, user_id AS tag, ts AS failure_date, value / 10 AS downtime_hours,
        CASE WHEN event_id % 6 < 5 THEN concat('MODE-', CAST(event_id % 6 AS STRING)) END AS failure_mode,
        CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS incident_seq, event_id % 7 = 0 AS is_source_rca
        FROM {events} WHERE event_type = 'error' AND value >= 100""",
    "equipment": """SELECT c_custkey AS tag, c_name AS equipment_name, c_nationkey AS plant, c_mktsegment AS equipment_type,
        CASE WHEN c_custkey % 10 > 0 THEN abs(c_acctbal) END AS price FROM {customer}""",
    "plants": "SELECT n_nationkey AS plant, n_name AS plant_name, n_regionkey AS region FROM {nation}",
    "pm_schedule": """SELECT o_orderkey AS pm_id, o_custkey AS tag, CAST(o_orderdate AS DATE) AS scheduled_date, o_orderpriority AS pm_type,
        CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Planned' ELSE 'Missed' END AS status,
        CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate + INTERVAL 2 DAY AS DATE) END AS completed_date FROM {orders}""",
    "environment": """SELECT s_nationkey AS plant, l_shipdate AS ts, l_quantity AS co2_ton, l_discount * 100 AS nox_ppm, l_tax * 100 AS sox_ppm,
        l_extendedprice / 1000 AS voc_kg, l_quantity * 3 AS wastewater_m3, l_extendedprice AS energy_kwh FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey""",
    "condition_weekly": """SELECT tag, week_date, v AS parameter_value, CASE WHEN v >= 80 THEN 'TRIP' WHEN v >= 60 THEN 'ALARM' ELSE 'NORMAL' END AS health_status
        FROM (SELECT user_id AS tag, CAST(date_trunc('week', ts) AS DATE) AS week_date, avg(value) AS v FROM {events} GROUP BY 1, 2) w""",
    "scored": """SELECT event_id, user_id AS tag, ts, value / (value + 50) AS score, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y,
        CASE WHEN event_id % 3 = 0 THEN 'validation' ELSE 'test' END AS split FROM {events}""",
}


def whatever_order(text: str, *values: str) -> str:
    """text with each avg and sum of the given expressions added up in decimals, so that no result hangs on the order of
    rows: a mean on a limit or half way between two roundings stays there. Values that are no decimal of 13 digits before
    the point make their group's result that of doubles."""
    for x in values:
        d = f"try_cast({x} AS DECIMAL(28, 15))"
        exact = f"CASE WHEN count({d}) = count({x}) THEN CAST(try_sum({d}) AS DOUBLE)"
        text = text.replace(f"avg({x})", f"coalesce({exact} / nullif(count({x}), 0) END, avg({x}))").replace(f"sum({x})", f"coalesce({exact} END, sum({x}))")
    return text


#: What Spark reads instead of the SQL of TABLES, with the same meaning.
OWN = {"condition_weekly": whatever_order(TABLES["condition_weekly"], "value")}


def frames(spark: SparkSession, sf_dir: str, names: set[str]) -> dict[str, DataFrame]:
    """The named tables, logical or raw."""
    out = {}
    for n in names:
        text = OWN.get(n, TABLES.get(n))
        out[n] = spark.sql(text, **frames(spark, sf_dir, _names(text))) if text else spark.read.parquet(f"{sf_dir}/{n}.parquet")
    return out


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return frames(spark, sf_dir, {name})[name]


def _names(text: str) -> set[str]:
    return set(re.findall(r"\{(\w+)\}", text))


def run(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Spark SQL over the tables named in braces. Times have no zone, so that their filters are pushed down as they are."""
    return spark.sql(text.replace("TIMESTAMP '", "TIMESTAMP_NTZ '"), **frames(spark, sf_dir, _names(text)))


def plain(text: str) -> str:
    """The same text for an engine that has the raw tables only: logical ones come first as common table expressions."""
    made = {n: re.sub(r"\{(\w+)\}", r"\1", TABLES[n]) for n in sorted(_names(text)) if n in TABLES}
    body = re.sub(r"\{(\w+)\}", r"\1", text).strip().replace("LEFT ANTI JOIN", "ANTI JOIN").replace("LEFT SEMI JOIN", "SEMI JOIN")
    head = ", ".join(f"{n} AS ({t})" for n, t in made.items())
    if not head:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {body[15:]}"
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
