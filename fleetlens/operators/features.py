"""Feature tables: plants by hour, equipment by reading, equipment by week. Only what was known at the row's time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guards import without_leakage
from .timeseries import asof_join, causal_rolling, seconds, time_features

#: Columns that tell the outcome; none may be among the features.
OUTCOMES = ("y", "next_failure_date", "days_to_next_failure", "is_event_week", "label_source")


#: What is rolled over a plant's hours.
PLANT_SIGNALS = ("rate", "power", "energy", "co2", "nox", "sox", "voc", "wastewater", "energy_per_rate")


def plant_hours(readings: DataFrame, equipment: DataFrame, environment: DataFrame, short: int = 24, long: int = 168, strict: bool = False) -> DataFrame:
    """plant, hour_ts: production summed over the plant's equipment, how many are there and run, share of running readings,
    emissions of the hour (sums of energy, CO2, VOC and waste water, means of NOx and SOx), energy per rate, and lags, means,
    deviations, score and step of PLANT_SIGNALS over the plant's hours before; calendar.

    Readings of equipment that the master does not know, or that has no plant, count nowhere; strict: they fail the job, with
    their tag in the message. Hours without emissions have nulls.
    """
    master = equipment.select(F.col("tag").alias("_tag"), "plant")
    known = readings.join(master, F.col("tag") == F.col("_tag"), "left" if strict else "inner")
    if strict:
        unknown = F.raise_error(F.concat(F.lit("no plant for "), F.coalesce(F.col("tag").cast("string"), F.lit("null"))))
        known = known.withColumn("plant", F.when(F.col("plant").isNull(), unknown.cast(equipment.schema["plant"].dataType)).otherwise(F.col("plant")))
    on = F.col("run_status") == "ON"
    made = known.where("plant IS NOT NULL").groupBy("plant", F.date_trunc("hour", "ts").alias("hour_ts")).agg(
        F.count_distinct("tag").alias("equipment"), F.count_distinct(F.when(on, F.col("tag"))).alias("running"), F.sum("feed_rate").alias("rate"), F.sum("power_kw").alias("power"), F.avg(on.cast("double")).alias("on_share")
    )
    air = environment.groupBy("plant", F.date_trunc("hour", "ts").alias("hour_ts")).agg(
        F.sum("energy_kwh").alias("energy"), F.sum("co2_ton").alias("co2"), F.avg("nox_ppm").alias("nox"), F.avg("sox_ppm").alias("sox"), F.sum("voc_kg").alias("voc"), F.sum("wastewater_m3").alias("wastewater")
    )
    rows = made.join(air, ["plant", "hour_ts"], "left").withColumn("energy_per_rate", F.col("energy") / F.nullif(F.col("rate"), F.lit(0.0)))
    out = causal_rolling(rows, "plant", ["hour_ts"], list(PLANT_SIGNALS), short, long)
    return without_leakage(time_features(out, "hour_ts"), OUTCOMES)


def equipment_rows(readings: DataFrame, equipment: DataFrame, incidents: DataFrame, signals: tuple[str, ...] = ("feed_rate", "power_kw"), short: int = 4, long: int = 12) -> DataFrame:
    """Readings with lags, means, deviations, score and step of each signal, calendar, the equipment's kind and plant, the
    number of its incidents so far and the days since the last, and whether the row is its latest."""
    out = causal_rolling(readings.select("event_id", "tag", "ts", *signals), "tag", ["ts", "event_id"], list(signals), short, long)
    out = time_features(out, "ts").withColumn("is_latest", F.row_number().over(Window.partitionBy("tag").orderBy(F.col("ts").desc(), F.col("event_id").desc())) == 1)
    numbered = incidents.select("tag", "failure_date", F.row_number().over(Window.partitionBy("tag").orderBy("failure_date", "incident_seq")).alias("n"))
    out = asof_join(out, numbered, "tag", "ts", "failure_date", "backward", False, ["n"])
    out = out.withColumns({"incidents_before": F.coalesce("asof_n", F.lit(0)), "days_since_incident": (seconds("ts") - seconds("asof_ts")) / 86400}).drop("asof_ts", "asof_n")
    return without_leakage(out.join(equipment.select("tag", "plant", "equipment_type"), "tag", "left"), OUTCOMES)


def weekly_rows(condition: DataFrame, alarm: float = 60.0, trip: float = 80.0, weeks: int = 4) -> DataFrame:
    """tag, week_date: the value (a negative one is null and flagged), its distance to alarm and trip, last week's value and
    step, mean and deviation over the weeks before, weeks in a row at or over alarm."""
    w = Window.partitionBy("tag").orderBy("week_date")
    before = w.rowsBetween(-weeks, -1)
    rows = condition.select("tag", "week_date", F.when(F.col("parameter_value") >= 0, F.col("parameter_value")).alias("value"), (F.col("parameter_value") < 0).cast("int").alias("negative"))
    over = F.coalesce(F.col("value") >= alarm, F.lit(False))
    rows = rows.withColumn("_block", F.count_if(~over).over(w))
    out = rows.withColumns({
        "to_alarm": alarm - F.col("value"), "to_trip": trip - F.col("value"), "lag_1": F.lag("value").over(w), "mean": F.avg("value").over(before), "std": F.stddev_samp("value").over(before), "weeks_before": F.count("value").over(before),
        "alarm_run": F.when(over, F.count_if(over).over(Window.partitionBy("tag", "_block").orderBy("week_date"))).otherwise(0),
    })
    return without_leakage(out.withColumn("step", F.col("value") - F.col("lag_1")).drop("_block"), OUTCOMES)


def event_weeks(condition: DataFrame, incidents: DataFrame) -> DataFrame:
    """tag, week_date of the condition table, the number of incidents 0 to 6 days after that date, and whether there is one.

    Weeks may begin on any day. An incident is counted by entity and day and goes to the seven dates it can belong to.
    """
    days = incidents.groupBy("tag", F.to_date("failure_date").alias("day")).agg(F.count("*").alias("n"))
    dates = days.where("day IS NOT NULL").select("tag", F.explode(F.sequence(F.date_sub("day", 6), "day")).alias("week_date"), "n")
    per = dates.groupBy("tag", "week_date").agg(F.sum("n").alias("incidents"))
    out = condition.select("tag", "week_date").join(per, ["tag", "week_date"], "left")
    return out.withColumns({"incidents": F.coalesce("incidents", F.lit(0)), "is_event_week": F.col("incidents").isNotNull()})


#: What a registry says of an entity's cases.
PROVENANCE = ("source_type", "rca_demo_eligible", "label_source")


def with_provenance(df: DataFrame, registry: DataFrame, key: str = "tag", cols: tuple[str, ...] = PROVENANCE) -> DataFrame:
    """df with cols of the registry's row of its key; a key that the registry lacks, names without a source_type, or names
    twice fails the job, with the key in the message. A null key fails too."""
    one = registry.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_rows"), *[F.first(c).alias(c) for c in cols])
    joined = df.join(one, F.col(key) == F.col("_key"), "left")
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    wrong = F.when(F.col("_rows") > 1, F.raise_error(F.concat(F.lit("provenance is repeated for "), name))).when(F.col("source_type").isNull(), F.raise_error(F.concat(F.lit("no provenance for "), name)))
    return joined.withColumn("source_type", F.coalesce(wrong.cast("string"), F.col("source_type"))).drop("_key", "_rows")


def _keyed_once(df: DataFrame, ent: str, order: list[str]) -> DataFrame:
    """df; two rows of an entity that are equal in all of order fail the job. It shares the sort of the rolling windows."""
    w = Window.partitionBy(ent).orderBy(*order)
    same = None
    for c in order:
        equal = F.col(c).eqNullSafe(F.lag(c).over(w))
        same = equal if same is None else same & equal
    # Without a row before, eqNullSafe compares with null, so the first row is told by its number.
    again = same & (F.row_number().over(w) > 1)
    wrong = F.raise_error(F.concat_ws(" ", F.lit("repeated key"), F.coalesce(F.col(ent).cast("string"), F.lit("null")), *[F.col(c).cast("string") for c in order]))
    return df.withColumn("_again", again).where(F.when(F.col("_again"), wrong.cast("boolean")).otherwise(F.lit(True))).drop("_again")


def equipment_features(readings: DataFrame, equipment: DataFrame, registry: DataFrame, context: DataFrame, signals: list[str], order: tuple[str, ...] = ("ts",), as_of: Column | None = None, short: int = 24, long: int = 168, version: str = "1") -> DataFrame:
    """Readings up to as_of as features: the equipment's identity (all columns of its master), provenance, is_running, calendar,
    causal windows of the signals, the plant's context of the hour, version, and whether the row is its entity's latest.

    context: plant, hour_ts and columns of its own, one row of each plant and hour; readings without one have nulls. Rows
    are told apart by tag and order: repeated ones fail the job, as do tags without provenance. Latest is by the same order.
    """
    rows = readings if as_of is None else readings.where(F.col("ts") <= as_of)
    rows = _keyed_once(rows.select("tag", *dict.fromkeys(["ts", *order]), "run_status", *signals), "tag", list(order))
    out = causal_rolling(rows, "tag", list(order), signals, short, long)
    last = Window.partitionBy("tag").orderBy(*[F.col(c).desc_nulls_last() for c in order])
    out = time_features(out, "ts").withColumns({"is_running": (F.col("run_status") == "ON").cast("int"), "is_latest": F.row_number().over(last) == 1})
    out = with_provenance(out.join(equipment, "tag", "left"), registry)
    clash = sorted((set(context.columns) - {"plant", "hour_ts"}) & set(out.columns))
    if clash:
        raise ValueError(f"context has columns of the features: {clash}")
    out = out.withColumn("hour_ts", F.date_trunc("hour", "ts")).join(context, ["plant", "hour_ts"], "left").drop("hour_ts")
    return without_leakage(out.withColumn("feature_version", F.lit(version)), [c for c in OUTCOMES if c not in PROVENANCE])


def condition_features(condition: DataFrame, registry: DataFrame, nonnegative: list[str], signals: list[str], slots: int = 4, as_of: Column | None = None, short: int = 4, long: int = 12, version: str = "1") -> tuple[DataFrame, DataFrame]:
    """Weekly features, and the labels of the same rows as a table apart.

    condition: tag, week_date, health_status, parameter_name_i and parameter_value_i of each slot, and signals; registry: tag,
    failure_date and PROVENANCE. A negative value of a parameter that cannot be negative becomes null and is flagged; flags are
    summed up. Values and signals get causal windows over weeks, the date its ISO week and month. Labels: the status, the
    registry's columns, and whether the failure lies 0 to 6 days after the week's date. Repeated weeks of an entity and tags
    without provenance fail the job.
    """
    rows = condition if as_of is None else condition.where(F.col("week_date") <= as_of)
    rows = _keyed_once(rows, "tag", ["week_date"])
    joined = with_provenance(rows, registry, "tag", (*PROVENANCE, "failure_date"))
    days = F.date_diff(F.to_date("failure_date"), F.to_date("week_date"))
    labels = joined.select("tag", "week_date", "health_status", "failure_date", *PROVENANCE, F.coalesce(days.between(0, 6), F.lit(False)).cast("int").alias("is_event_week"), F.lit(True).alias("status_label_is_rule_derived"))
    flags, values = {}, {}
    for i in range(1, slots + 1):
        wrong = F.coalesce(F.col(f"parameter_name_{i}").isin(nonnegative) & (F.col(f"parameter_value_{i}") < 0), F.lit(False))
        flags[f"parameter_{i}_invalid_physical"], values[f"parameter_value_{i}"] = wrong.cast("int"), F.when(~wrong, F.col(f"parameter_value_{i}"))
    out = joined.withColumns(flags).withColumns(values).withColumn("data_quality_flag_count", sum((F.col(c) for c in flags), F.lit(0)))
    out = causal_rolling(out.drop("health_status", "failure_date"), "tag", ["week_date"], [*values, *signals], short, long, "w")
    out = out.withColumns({"week_of_year": F.weekofyear("week_date"), "month": F.month("week_date"), "feature_version": F.lit(version)})
    return without_leakage(out, ("health_status", "failure_date", "is_event_week")), labels
