"""The latest-risk table, plant summaries, alert payloads and their cooldown, the KPI bundle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks
from .timeseries import persistence, seconds

#: Levels from the worst down (fixed values), what to do and how an alert of the level is rated.
SEVERITY = {"ACTION_NOW": 5, "PLAN_MAINTENANCE": 4, "DATA_QUALITY_REVIEW": 3, "MONITOR": 2, "NORMAL": 1}
ACTIONS = {
    "ACTION_NOW": "inspect now and prepare maintenance", "PLAN_MAINTENANCE": "review within a day and plan maintenance", "DATA_QUALITY_REVIEW": "check the sensors and score again before acting",
    "MONITOR": "watch the trend in the next shift", "NORMAL": "routine monitoring",
}
RATINGS = {"ACTION_NOW": "Critical", "PLAN_MAINTENANCE": "High", "MONITOR": "Medium"}
#: By horizon in days: the threshold of an action and of a warning.
Thresholds = dict[int, tuple[float, float]]


def _looked_up(pairs: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])[key]


def severity(level: Column) -> Column:
    return F.coalesce(_looked_up(SEVERITY, level), F.lit(0))


def latest_risk(scored: DataFrame, thresholds: Thresholds, quality: DataFrame | None = None, deviations: DataFrame | None = None, now: Column | None = None, lookback: int = 6, min_hits: int = 3,
                stale_hours: float = 24, source_stale_hours: float = 48, future_hours: float = 1, z_alert: float = 2.0) -> DataFrame:
    """One row per entity from its latest reading.

    scored has tag, ts, event_id and score_<h>d for the horizons of thresholds, the shorter one first. For each: score,
    utilisation of the action threshold, raw alert, persistent alert and warning with their hits. quality (tag, status,
    publish_allowed, reason) holds back alerts under review; without it all pass. deviations (tag and one column of
    z-scores per signal) gives the dominant signal, the first of equal ones. The level is the worst that applies; the rank
    goes by level, utilisation and tag. lag_hours is how far the entity is behind the newest reading, source_status how old
    that one is at `now`.
    """
    near, far = thresholds
    rows = scored
    for h, limits in thresholds.items():
        for name, limit in zip(("alert", "warning"), limits, strict=True):
            rows = persistence(rows, ["tag"], ["ts", "event_id"], F.col(f"score_{h}d") >= limit, lookback, min_hits).withColumnsRenamed({"hits": f"{name}_hits_{h}d", "persistent": f"{name}_{h}d"})
    kept = [c for c in rows.columns if c != "tag"]
    last = rows.groupBy("tag").agg(F.max_by(F.struct(*kept), F.struct("ts", "event_id")).alias("r"), F.count("*").alias("observations")).select("tag", "r.*", "observations")
    newest = scored.agg(F.max("ts").alias("_newest"))
    last = last.crossJoin(F.broadcast(newest))
    for h, (action, _) in thresholds.items():
        last = last.withColumns({f"raw_alert_{h}d": F.col(f"score_{h}d") >= action, f"utilisation_{h}d": F.round(F.col(f"score_{h}d") / action, 9)})
    if quality is None:
        last = last.withColumns({"quality": F.lit("NOT_EVALUATED"), "publish_allowed": F.lit(True), "quality_reason": F.lit("not evaluated")})
    else:
        last = last.join(quality.select("tag", F.col("status").alias("quality"), "publish_allowed", F.col("reason").alias("quality_reason")), "tag", "left")
        last = last.withColumns({"quality": F.coalesce("quality", F.lit("NOT_EVALUATED")), "publish_allowed": F.coalesce("publish_allowed", F.lit(True)), "quality_reason": F.coalesce("quality_reason", F.lit("not evaluated"))})
    review = F.col("quality") == "REVIEW"
    level_of = lambda a, b, m: F.when(a, "ACTION_NOW").when(b, "PLAN_MAINTENANCE").when(m, "MONITOR").otherwise("NORMAL")
    warned = F.col(f"warning_{near}d") | F.col(f"warning_{far}d")
    last = last.withColumn("model_level", level_of(F.col(f"alert_{near}d"), F.col(f"alert_{far}d"), warned))
    last = last.withColumns({f"{c}_{h}d": F.col(f"{c}_{h}d") & ~review for h in thresholds for c in ("alert", "warning")})
    level = F.when(review, "DATA_QUALITY_REVIEW").otherwise(F.col("model_level"))
    lasting = f" in {min_hits} of the last {lookback} readings"
    reason = F.when(review, F.concat(F.lit("held back by data quality: "), F.col("quality_reason")))
    for name, h in (("alert", near), ("alert", far)):
        reason = reason.when(F.col(f"{name}_{h}d"), f"score of {h} days over its action threshold{lasting}")
    reason = reason.when(warned, f"score over a warning threshold{lasting}").otherwise("no persistent warning")
    most = F.greatest(*[F.col(f"utilisation_{h}d") for h in thresholds])
    lag = (seconds("_newest") - seconds("ts")) / 3600
    age = (seconds(now if now is not None else F.current_timestamp()) - seconds("_newest")) / 3600
    status = F.when(age < -future_hours, "FUTURE").when(age > source_stale_hours, "STALE").otherwise("CURRENT")
    out = last.withColumns({
        "level": level, "suppressed": review & (F.col("model_level") != "NORMAL"), "reason": reason, "proximity": F.least(F.lit(100.0), 100 * most), "_most": most, "lag_hours": lag, "stale": lag > stale_hours, "source_status": status,
    }).withColumn("action", _looked_up(ACTIONS, F.col("level")))
    if deviations is not None:
        signals = [c for c in deviations.columns if c != "tag"]
        size = lambda c: F.coalesce(F.abs(F.col(c)), F.lit(-1.0))
        top = F.greatest(*map(size, signals)) if len(signals) > 1 else size(signals[0])
        name = F.when(top >= 0, F.coalesce(*[F.when(size(c) == top, F.lit(c)) for c in signals]))
        value = F.when(top >= 0, F.coalesce(*[F.when(size(c) == top, F.col(c)) for c in signals]))
        found = deviations.select("tag", name.alias("dominant_signal"), value.alias("dominant_z"), sum((size(c) >= z_alert).cast("int") for c in signals).alias("deviating_signals"))
        out = out.join(found, "tag", "left").withColumn("deviating_signals", F.coalesce("deviating_signals", F.lit(0)))
    key = 1e4 * severity(F.col("level")) + F.least(F.col("_most"), F.lit(9998.0))
    return ranks.position(out, key, [severity(F.col("level")).desc(), F.col("_most").desc(), F.col("tag")], "risk_rank").drop("_most", "_newest", "event_id")


def plant_summary(risk: DataFrame, equipment: DataFrame, horizons: tuple[int, int] = (7, 30)) -> DataFrame:
    """Levels, alerts, stale entities, the largest scores and the best-ranked entity by plant, ranked."""
    rows = risk.join(equipment.select("tag", "plant"), "tag")
    counts = [F.count_if(F.col("level") == x).alias(x.lower()) for x in SEVERITY]
    sums = [f for h in horizons for f in (F.count_if(f"alert_{h}d").alias(f"alerts_{h}d"), F.max(f"score_{h}d").alias(f"top_score_{h}d"))]
    best = F.min_by(F.struct("tag", "level"), "risk_rank")
    out = rows.groupBy("plant").agg(F.count("*").alias("equipment"), *counts, *sums, F.count_if("stale").alias("stale"), F.max("proximity").alias("top_proximity"), F.max("ts").alias("last_ts"), best.alias("b"))
    order = [F.col(x.lower()).desc() for x in list(SEVERITY)[:4]]
    out = out.select("*", F.col("b.tag").alias("top_tag"), F.col("b.level").alias("top_level")).drop("b")
    return out.withColumn("plant_rank", F.row_number().over(Window.orderBy(*order, F.round("top_proximity", 9).desc(), "plant")))


def overall_summary(risk: DataFrame, horizons: tuple[int, int] = (7, 30)) -> DataFrame:
    """One row: entities, levels, alerts, reviews, what is held back, what is stale."""
    counts = [F.count_if(F.col("level") == x).alias(x.lower()) for x in SEVERITY]
    return risk.agg(
        F.count("*").alias("equipment"), *counts, *[F.count_if(f"alert_{h}d").alias(f"alerts_{h}d") for h in horizons], F.count_if("suppressed").alias("suppressed"),
        F.count_if(~F.col("publish_allowed")).alias("blocked"), F.count_if("stale").alias("stale"), F.max("ts").alias("last_ts"), F.max("source_status").alias("source_status"),
    )


def publish_payload(risk: DataFrame, thresholds: Thresholds, prefix: str = "RISK", levels: tuple[str, ...] = tuple(RATINGS)) -> DataFrame:
    """Alerts to publish: of the levels, where data quality allows it; an id of day, entity and horizon.

    The horizon is that of the alert, the shorter one first; without an alert that whose score is nearest to its warning
    threshold. Ids are unique, as the table of risks has one row per entity; names that differ only in signs that an id
    cannot hold fail.
    """
    near, far = thresholds
    rows = risk.where(F.col("level").isin(*levels) & F.col("publish_allowed"))
    nearer = F.col(f"score_{near}d") / thresholds[near][1] >= F.col(f"score_{far}d") / thresholds[far][1]
    horizon = F.when(F.col(f"alert_{near}d"), near).when(F.col(f"alert_{far}d"), far).when(nearer, near).otherwise(far)
    tag = F.regexp_replace(F.upper(F.col("tag").cast("string")), "[^A-Z0-9-]+", "-")
    pct = F.round(100 * F.when(F.col("horizon_days") == near, F.col(f"score_{near}d")).otherwise(F.col(f"score_{far}d")), 6)
    hint = F.concat(F.lit("context only: "), F.coalesce("dominant_signal", F.lit("no dominant deviation"))) if "dominant_signal" in risk.columns else F.lit("context only: no dominant deviation")
    named = rows.withColumn("horizon_days", horizon).select(
        F.concat_ws("-", F.lit(prefix), F.date_format("ts", "yyyyMMdd"), tag, F.concat(F.col("horizon_days").cast("string"), F.lit("D"))).alias("alert_id"), "tag", F.to_date("ts").alias("predicted_at"),
        "horizon_days", pct.alias("probability_pct"), _looked_up(RATINGS, F.col("level")).alias("severity"), F.lit("Open").alias("status"), F.lit(None).cast("long").alias("incident_seq"), hint.alias("hint"), F.col("action").alias("recommended_action"),
    )
    copies = F.count("*").over(Window.partitionBy("alert_id"))
    return named.withColumn("_n", copies).where(F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("alert_id twice: "), F.col("alert_id"))).cast("boolean")).otherwise(F.lit(True))).drop("_n")


def cooldown_filter(payload: DataFrame, existing: DataFrame, hours: int = 72) -> DataFrame:
    """payload without alerts whose entity has another alert less than `hours` old; the same id may pass."""
    e = existing.select(F.col("alert_id").alias("_id"), F.col("tag").alias("_tag"), F.col("predicted_at").alias("_at"))
    age = 24 * F.date_diff("predicted_at", "_at")
    return payload.join(e, (F.col("tag") == F.col("_tag")) & (F.col("alert_id") != F.col("_id")) & (age >= 0) & (age < hours), "left_anti")


def kpi_bundle(readings: DataFrame, incidents: DataFrame, weekly: DataFrame, pm: DataFrame, equipment: DataFrame, start: Column, end: Column, tags: list | None = None) -> DataFrame:
    """One row of operational figures for [start, end): failures, downtime, availability, MTBF, MTTR, health, PM, loss.

    Each table is filtered, then aggregated by itself; only one-row frames and one row per entity are joined.
    """
    scope = lambda df: df if tags is None else df.where(F.col("tag").isin(list(tags)))
    r = scope(readings).where((F.col("ts") >= start) & (F.col("ts") < end))
    i = scope(incidents).where((F.col("failure_date") >= start) & (F.col("failure_date") < end))
    d0, d1 = F.to_date(start), F.date_sub(F.to_date(end), 1)
    w = scope(weekly).where(F.col("week_date").between(d0, d1))
    p = scope(pm)
    status = lambda s: F.count_if(F.col("health_status") == s)
    zero = F.lit(0.0)
    rate = r.where("run_status = 'ON'").groupBy("tag").agg(F.avg("feed_rate").alias("rate"))
    down = i.groupBy("tag").agg(F.sum("downtime_hours").alias("down"))
    loss = down.join(rate, "tag").join(equipment.select("tag", "price"), "tag").agg(F.coalesce(F.sum(F.col("rate") * F.col("down")), zero).alias("production_loss_ton"), F.coalesce(F.sum(F.col("rate") * F.col("down") * F.col("price")) / 1000, zero).alias("estimated_loss_kusd"))
    one = (
        i.agg(F.count("*").alias("no_failures"), F.coalesce(F.sum("downtime_hours"), zero).alias("total_downtime"), F.coalesce(F.avg("downtime_hours"), zero).alias("mttr"))
        .crossJoin(r.agg(F.count("*").alias("period_hours")))
        .crossJoin(w.agg(F.count_distinct("week_date").alias("monitoring_weeks"), status("ALARM").alias("alarm"), status("TRIP").alias("trip"), status("NORMAL").alias("normal")))
        .crossJoin(p.agg(F.coalesce(100.0 * F.count_if(F.col("status") == "Completed") / F.nullif(F.count("*"), F.lit(0)), zero).alias("pm_compliance_pct")))
        .crossJoin(loss)
    )
    hours = F.nullif(F.col("period_hours"), F.lit(0))
    return one.withColumns({"availability_pct": F.coalesce(100 * (F.col("period_hours") - F.col("total_downtime")) / hours, zero), "mtbf": F.col("period_hours") / F.nullif(F.col("no_failures"), F.lit(0))})
