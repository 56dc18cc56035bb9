"""Failure labels, their source and their audit; chronological splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timeseries import asof_join, seconds


def canonical_events(incidents: DataFrame) -> DataFrame:
    """One row per entity and time: documented causes first, then the smallest sequence number."""
    w = Window.partitionBy("tag", "failure_date").orderBy(F.col("is_source_rca").desc_nulls_last(), "incident_seq")
    return incidents.withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i")


def failure_labels(readings: DataFrame, incidents: DataFrame, horizons: tuple[int, ...] = (7, 30), recovery_hours: float = 72) -> DataFrame:
    """Days to the next failure (strictly later), hours since the last one (or now), recovery, and a label per horizon.

    A label is null until known: 0 where the window lies within the entity's observations, 1 where a failure comes
    within the horizon (also in an incomplete window), null again during recovery.
    """
    events = canonical_events(incidents).select("tag", "failure_date", "is_source_rca")
    rows = readings.withColumn("observation_end", F.max("ts").over(Window.partitionBy("tag")))
    rows = asof_join(rows, events, "tag", "ts", "failure_date", "forward", False, ["is_source_rca"])
    rows = rows.withColumnsRenamed({"asof_ts": "next_failure_date", "asof_is_source_rca": "next_is_rca"})
    rows = asof_join(rows, events, "tag", "ts", "failure_date", "backward", True, []).withColumnRenamed("asof_ts", "previous_failure_date")
    days = (seconds("next_failure_date") - seconds("ts")) / 86400
    since = (seconds("ts") - seconds("previous_failure_date")) / 3600
    rows = rows.withColumns({"days_to_next_failure": days, "hours_since_previous": since})
    recovery = F.coalesce(F.col("hours_since_previous").between(0, recovery_hours), F.lit(False))
    rows = rows.withColumn("is_recovery_window", recovery)
    return rows.withColumns({f"failure_within_{h}d": horizon_label(h) for h in horizons}).withColumn("label_source", label_source())


def horizon_label(h: int) -> Column:
    complete = seconds("ts") + 86400 * h <= seconds("observation_end")
    ahead = (F.col("days_to_next_failure") > 0) & (F.col("days_to_next_failure") <= h)
    return F.when(F.col("is_recovery_window"), None).when(ahead, 1).when(complete, 0).cast("byte")


def label_source() -> Column:
    return F.when(F.col("next_failure_date").isNull(), "no_observed_future_event").when(F.col("next_is_rca"), "rca_document").otherwise("incident_history")


def audit_labels(labels: DataFrame, reference: Column, short: str, long: str) -> DataFrame:
    """One row: counts of duplicates, nulls, order errors, mismatched days, gaps, future rows; and a status."""
    w = Window.partitionBy("tag").orderBy("ts", "event_id")
    step = seconds("ts") - seconds(F.lag("ts").over(w))
    days = (seconds("next_failure_date") - seconds("ts")) / 86400
    rows = labels.withColumns({"_gap": step > 3600 * 24, "_copies": F.count("*").over(Window.partitionBy("tag", "ts")), "_off": F.abs(days - F.col("days_to_next_failure")) > 1e-3})
    out = rows.agg(
        F.count("*").alias("n"), F.count_if(F.col("_copies") > 1).alias("duplicates"), F.count_if(F.col("tag").isNull() | F.col("ts").isNull()).alias("missing_keys"),
        F.count_if((F.col(short) == 1) & (F.col(long) == 0)).alias("order_errors"), F.count_if("_off").alias("day_errors"), F.count_if("_gap").alias("gaps"),
        F.count_if(F.col("ts") > reference).alias("future_rows"), F.count_if("is_recovery_window").alias("recovery"), F.count_if(F.col(short).isNull() & ~F.col("is_recovery_window")).alias("censored"),
    )
    fails = F.col("missing_keys") + F.col("order_errors") + F.col("day_errors")
    return out.withColumn("status", F.when(fails > 0, "FAIL").when(F.col("future_rows") + F.col("duplicates") > 0, "WARN").otherwise("PASS"))


def times_at(df: DataFrame, ts: str, cuts: dict[str, Column]) -> DataFrame:
    """cut, time: the distinct time at each position; positions are numbers made of "total", the number of times.

    Positions come from counts per day and then within the day found, so no sort of all times meets in one task: only
    days do. A position outside the table has no row.
    """
    times = df.select(F.col(ts).alias("t")).where("t IS NOT NULL").distinct()
    days = times.groupBy(F.to_date("t").alias("day")).agg(F.count("*").alias("n"))
    before = days.withColumns({"before": F.sum("n").over(Window.orderBy("day")) - F.col("n"), "total": F.sum("n").over(Window.partitionBy())})
    asked = F.explode(F.array(*[F.struct(F.lit(k).alias("cut"), F.floor(p).cast("long").alias("position")) for k, p in cuts.items()])).alias("c")
    found = before.select("*", asked).select("day", "before", "n", "c.*").where((F.col("position") >= F.col("before")) & (F.col("position") < F.col("before") + F.col("n")))
    inside = times.withColumn("day", F.to_date("t")).join(F.broadcast(found), "day").withColumn("i", F.row_number().over(Window.partitionBy("cut").orderBy("t")) - 1 + F.col("before"))
    return inside.where("i = position").select("cut", F.col("t").alias("time"))


def split_boundaries(df: DataFrame, ts: str, train: float = 0.575, valid: float = 0.225) -> DataFrame:
    """One row: the times at which validation and test begin, by position among distinct times."""
    at = times_at(df, ts, {"validation": F.col("total") * train, "test": F.col("total") * round(train + valid, 9)})
    return at.agg(F.max(F.when(F.col("cut") == "validation", F.col("time"))).alias("validation_start"), F.max(F.when(F.col("cut") == "test", F.col("time"))).alias("test_start"))


def assign_split(df: DataFrame, ts: str, bounds: DataFrame, horizon_days: int) -> DataFrame:
    """split: train, validation or test; rows less than the horizon before the next part are purged (null)."""
    gap = F.make_dt_interval(days=F.lit(horizon_days))
    t = F.col(ts)
    split = F.when(t >= F.col("test_start"), "test").when((t >= F.col("validation_start")) & (t < F.col("test_start") - gap), "validation").when(t < F.col("validation_start") - gap, "train")
    return df.crossJoin(F.broadcast(bounds)).withColumn("split", split).drop(*bounds.columns)


#: Shares of training and validation of the usual candidates; the rest is the test.
CANDIDATES = {"50_30_20": (0.5, 0.3), "52.5_27.5_20": (0.525, 0.275), "55_25_20": (0.55, 0.25), "57.5_22.5_20": (0.575, 0.225), "60_20_20": (0.6, 0.2), "65_15_20": (0.65, 0.15), "70_10_20": (0.7, 0.1), "80_10_10": (0.8, 0.1)}


def _in_parts(rows: DataFrame, parts: dict[tuple[str, str], Column], y: str, key: str, event: str) -> DataFrame:
    """name, part, rows, positives, events of each named part of rows, which may overlap; one pass over rows.

    Rows are counted by entity and next event first, so an event's rows become one. Null labels do not count.
    """
    known = rows.where(F.col(y).isNotNull())
    flags = {f"{k}": F.coalesce(c, F.lit(False)) for k, c in enumerate(parts.values())}
    per = known.groupBy(key, event).agg(*[f for k, c in flags.items() for f in (F.count_if(c).alias(f"n{k}"), F.count_if(c & (F.col(y) == 1)).alias(f"p{k}"))])
    sums = per.agg(*[f for k in flags for f in (F.sum(f"n{k}").alias(f"n{k}"), F.sum(f"p{k}").alias(f"p{k}"), F.count_if((F.col(f"p{k}") > 0) & F.col(event).isNotNull()).alias(f"e{k}"))])
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    each = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(part).alias("part"), zero(f"n{k}").alias("rows"), zero(f"p{k}").alias("positives"), zero(f"e{k}").alias("events")) for k, (name, part) in enumerate(parts)])
    return sums.select(F.explode(each).alias("x")).select("x.*")


def split_candidates(rows: DataFrame, ts: str, y: str, horizon_days: int, candidates: dict[str, tuple[float, float]] | None = None, least: tuple[int, int, int] = (12, 8, 8),
                     held_out: Column | None = None, key: str = "tag", event: str = "next_failure_date") -> DataFrame:
    """candidate, its boundaries, rows, positives and distinct events by part, and why it is rejected (null: it is not).

    Boundaries lie at positions among all distinct times; parts are purged by the horizon as in assign_split().
    Entities in held_out do not train. Each part needs both classes and `least` events. What comes to the driver is two
    times a candidate.
    """
    candidates = candidates or CANDIDATES
    cuts = {f"{c}|{k}": F.col("total") * round(sum(shares[: k + 1]), 9) for c, shares in candidates.items() for k in (0, 1)}
    at = {r.cut: r.time for r in times_at(rows, ts, cuts).collect()}
    kind, gap = rows.schema[ts].dataType, F.make_dt_interval(days=F.lit(horizon_days))
    time = lambda c, k: F.lit(at.get(f"{c}|{k}")).cast(kind)
    t, parts = F.col(ts), {}
    for c in candidates:
        trains = t < time(c, 0) - gap
        parts[c, "train"] = trains if held_out is None else trains & ~held_out
        parts[c, "validation"] = (t >= time(c, 0)) & (t < time(c, 1) - gap)
        parts[c, "test"] = t >= time(c, 1)
    found = _in_parts(rows, parts, y, key, event).groupBy("name")
    names = ("train", "validation", "test")
    wide = found.agg(*[F.max(F.when(F.col("part") == p, F.col(c))).alias(f"{p}_{c}") for p in names for c in ("rows", "positives", "events")])
    reasons = [F.when((F.col(f"{p}_positives") == 0) | (F.col(f"{p}_positives") == F.col(f"{p}_rows")), F.lit(f"{p} lacks both classes")) for p in names]
    reasons += [F.when(F.col(f"{p}_events") < n, F.concat(F.lit(f"{p} events "), F.col(f"{p}_events").cast("string"), F.lit(f" < {n}"))) for p, n in zip(names, least, strict=True)]
    starts = F.coalesce(*[F.when(F.col("name") == c, F.struct(time(c, 0).alias("v"), time(c, 1).alias("t"))) for c in candidates])
    return wide.select(F.col("name").alias("candidate"), starts["v"].alias("validation_start"), starts["t"].alias("test_start"), *[c for c in wide.columns if c != "name"], F.nullif(F.concat_ws("; ", *reasons), F.lit("")).alias("rejection"))


def rolling_folds(rows: DataFrame, ts: str, y: str, test_start: Column, horizon_days: int, folds: int = 3, initial: float = 0.5, least: tuple[int, int] = (8, 5), held_out: Column | None = None,
                  key: str = "tag", event: str = "next_failure_date") -> DataFrame:
    """fold, validation_start, validation_end, rows, positives and events of training and validation, rejection.

    Folds expand: edges lie evenly among the distinct times before test_start less the horizon, from `initial` of them
    on. A fold trains before its edge less the horizon and is judged from its edge to the next one (the last: to
    test_start) less the horizon.
    """
    gap = F.make_dt_interval(days=F.lit(horizon_days))
    first = F.floor(F.col("total") * initial)
    cuts = {str(k): first + F.floor((F.col("total") - first) * k / folds) for k in range(folds)}
    at = {r.cut: r.time for r in times_at(rows.where(F.col(ts) < test_start - gap), ts, cuts).collect()}
    kind, t, parts, ends = rows.schema[ts].dataType, F.col(ts), {}, {}
    for k in range(folds):
        start = F.lit(at.get(str(k))).cast(kind)
        ends[k] = start, (F.lit(at.get(str(k + 1))).cast(kind) if k + 1 < folds else test_start) - gap
        parts[str(k + 1), "train"] = t < start - gap if held_out is None else (t < start - gap) & ~held_out
        parts[str(k + 1), "validation"] = (t >= start) & (t < ends[k][1])
    names = ("train", "validation")
    wide = _in_parts(rows, parts, y, key, event).groupBy("name").agg(*[F.max(F.when(F.col("part") == p, F.col(c))).alias(f"{p}_{c}") for p in names for c in ("rows", "positives", "events")])
    reasons = [F.when(F.col(f"{p}_events") < n, F.concat(F.lit(f"{p} events "), F.col(f"{p}_events").cast("string"), F.lit(f" < {n}"))) for p, n in zip(names, least, strict=True)]
    reasons += [F.when((F.col(f"{p}_positives") == 0) | (F.col(f"{p}_positives") == F.col(f"{p}_rows")), F.lit(f"{p} lacks both classes")) for p in names]
    spans = F.coalesce(*[F.when(F.col("name") == str(k + 1), F.struct(a.alias("a"), b.alias("b"))) for k, (a, b) in ends.items()])
    return wide.select(F.col("name").cast("int").alias("fold"), spans["a"].alias("validation_start"), spans["b"].alias("validation_end"), *[c for c in wide.columns if c != "name"], F.nullif(F.concat_ws("; ", *reasons), F.lit("")).alias("rejection"))
