"""Time-series operators: causal rolling features, as-of joins, persistence, episodes, cooldown."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seconds(ts: str | Column) -> Column:
    """Seconds since 1970 with their fraction."""
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp")) / F.lit(1e6)


def causal_rolling(df: DataFrame, ent: str, order: list[str], signals: list[str], short: int = 24, long: int = 168, suffix: str = "h") -> DataFrame:
    """Lags, rolling means and deviations over the rows before the current one, score and step.

    Windows count rows; a value needs max(2, window // 4) known ones. All columns share one partitioning and sort.
    """
    w = Window.partitionBy(ent).orderBy(*order)
    out = {}
    for s in signals:
        x, lag = F.col(s), F.lag(s, 1).over(w)
        out[f"{s}_lag_1{suffix}"], out[f"{s}_lag_{short}{suffix}"] = lag, F.lag(s, short).over(w)
        stats = {}
        for n in (short, long):
            before = w.rowsBetween(-n, -1)
            enough = F.count(s).over(before) >= max(2, n // 4)
            stats[n] = F.when(enough, F.avg(s).over(before)), F.when(enough, F.stddev_samp(s).over(before))
            out[f"{s}_mean_{n}{suffix}"], out[f"{s}_std_{n}{suffix}"] = stats[n]
        mean, std = stats[long]
        out[f"{s}_zscore_{long}{suffix}"] = (x - mean) / F.nullif(std, F.lit(0.0))
        out[f"{s}_delta_1{suffix}"] = x - lag
    return df.select("*", *[c.alias(n) for n, c in out.items()])


def time_features(df: DataFrame, ts: str) -> DataFrame:
    """hour, day_of_week (Monday 0), month, and the circle coordinates of the first two."""
    out = df.withColumns({"hour": F.hour(ts), "day_of_week": F.weekday(ts), "month": F.month(ts)})
    turn = lambda c, n: F.lit(2 * math.pi) * F.col(c) / n
    return out.withColumns({f"{c}_{f.__name__}": f(turn(c, n)) for c, n in (("hour", 24), ("day_of_week", 7)) for f in (F.sin, F.cos)})


def asof_join(left: DataFrame, right: DataFrame, by: str, left_ts: str, right_ts: str, direction: str, allow_exact: bool, cols: list[str]) -> DataFrame:
    """left with cols of the nearest row of right before ("backward") or after ("forward") it, by entity.

    One union and one window that runs towards the row, so its cost is that of a sort: no join. At equal times,
    allow_exact decides. Of rows of right at one time the nearest by its columns' order counts: the last one backward, the
    first one forward. cols get the prefix asof_. Rows without an entity or a time have no match and match nothing.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"direction: {direction}")
    forward = direction == "forward"
    keyed = lambda ts: F.col(by).isNotNull() & F.col(ts).isNotNull()
    event = right.where(keyed(right_ts)).select(F.col(by).alias("_by"), F.col(right_ts).alias("_ts"), F.struct(F.col(right_ts).alias("_at"), *cols).alias("_event"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_row"))
    row = left.select(F.col(by).alias("_by"), F.col(left_ts).alias("_ts"), F.lit(None).cast(event.schema["_event"].dataType).alias("_event"), F.struct("*").alias("_row"))
    is_row = F.col("_row").isNotNull().cast("int")
    # At a row's own time, events come before it in the window's order if they may match.
    order = [F.col("_ts"), is_row if allow_exact else 1 - is_row, F.col("_event")]
    order = [order[0].desc(), order[1], order[2].desc()] if forward else order
    w = Window.partitionBy("_by").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    known = F.col("_by").isNotNull() & F.col("_ts").isNotNull()
    found = row.where(known).unionByName(event).withColumn("_pick", F.last("_event", ignorenulls=True).over(w)).where("_row IS NOT NULL")
    out = found.select("_row", "_pick").unionByName(row.where(~known).select("_row", F.col("_event").alias("_pick")))
    return out.select("_row.*", F.col("_pick")["_at"].alias("asof_ts"), *[F.col("_pick")[c].alias(f"asof_{c}") for c in cols])


def nearest_join(left: DataFrame, right: DataFrame, by: str, left_ts: str, right_ts: str, cols: list[str], tolerance_s: float | None = None) -> DataFrame:
    """left with cols of the row of right that is nearest in time, by entity; of two as near the earlier one.

    Both neighbours come from windows over one partitioning, one in each direction; a row at the same time is the nearest.
    Beyond tolerance_s there is none. cols get the prefix nearest_, and nearest_ts is the row's time. Of rows of right at one
    time the last by its columns' order counts. Rows without an entity or a time have no match and match nothing.
    """
    keyed = lambda ts: F.col(by).isNotNull() & F.col(ts).isNotNull()
    of = right.where(keyed(right_ts)).groupBy(F.col(by).alias("_by"), F.col(right_ts).alias("_ts")).agg(F.max(F.struct(F.col(right_ts).alias("_at"), *cols)).alias("_event"))
    event = of.select("_by", "_ts", "_event", F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_row"))
    row = left.select(F.col(by).alias("_by"), F.col(left_ts).alias("_ts"), F.lit(None).cast(event.schema["_event"].dataType).alias("_event"), F.struct("*").alias("_row"))
    known, is_row = F.col("_by").isNotNull() & F.col("_ts").isNotNull(), F.col("_row").isNotNull().cast("int")
    last = lambda ts: F.last("_event", ignorenulls=True).over(Window.partitionBy("_by").orderBy(ts, is_row).rowsBetween(Window.unboundedPreceding, -1))
    found = row.where(known).unionByName(event).withColumns({"_a": last(F.col("_ts")), "_b": last(F.col("_ts").desc())}).where("_row IS NOT NULL")
    before, after = seconds("_ts") - seconds(F.col("_a._at")), seconds(F.col("_b._at")) - seconds("_ts")
    pick = F.when(F.col("_b").isNull() | (before <= after), F.col("_a")).otherwise(F.col("_b"))
    if tolerance_s is not None:
        pick = F.when(F.abs(seconds(pick["_at"]) - seconds("_ts")) <= tolerance_s, pick)
    out = found.select("_row", pick.alias("_pick")).unionByName(row.where(~known).select("_row", F.col("_event").alias("_pick")))
    return out.select("_row.*", F.col("_pick")["_at"].alias("nearest_ts"), *[F.col("_pick")[c].alias(f"nearest_{c}") for c in cols])


def window_around(events: DataFrame, readings: DataFrame, by: str, event_ts: str, ts: str, before_h: int = 48, after_h: int = 24) -> DataFrame:
    """Readings from before_h before to after_h after each event, both ends in: an equi-join on entity and day, then the range."""
    span = F.sequence(F.to_date(F.col(event_ts) - F.make_dt_interval(hours=F.lit(before_h))), F.to_date(F.col(event_ts) + F.make_dt_interval(hours=F.lit(after_h))))
    e = events.withColumn("_day", F.explode(span)).withColumnRenamed(by, "_by")
    r = readings.withColumn("_rday", F.to_date(ts))
    age = seconds(ts) - seconds(event_ts)
    return r.join(e, (F.col(by) == F.col("_by")) & (F.col("_rday") == F.col("_day"))).where((age >= -3600 * before_h) & (age <= 3600 * after_h)).drop("_day", "_rday", "_by")


def persistence(df: DataFrame, keys: list[str], order: list[str], hit: Column, lookback: int = 6, min_hits: int = 3, require_latest: bool = True) -> DataFrame:
    """hits among the last `lookback` rows, this one included, and whether the alert persists."""
    now = F.coalesce(hit, F.lit(False))
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - lookback, 0)
    hits = F.sum(now.cast("int")).over(w)
    return df.withColumn("hits", hits).withColumn("persistent", (F.col("hits") >= min_hits) & (now if require_latest else F.lit(True)))


def alert_episodes(df: DataFrame, keys: list[str], ts: str, order: list[str], truth: str, reset_hours: float = 24) -> DataFrame:
    """df holds alerts only -> one row per episode; one ends when the next alert comes more than reset_hours later."""
    w = Window.partitionBy(*keys).orderBy(*order)
    gap = seconds(ts) - seconds(F.lag(ts).over(w))
    numbered = df.withColumn("episode", F.sum(F.when(gap > 3600 * reset_hours, 1).otherwise(0)).over(w))
    return numbered.groupBy(*keys, "episode").agg(
        F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("alerts"), F.max(F.col(truth) == 1).alias("true_episode")
    ).withColumn("span_hours", (seconds("end") - seconds("start")) / 3600 + 1)


def notifications(episodes: DataFrame, keys: list[str], cooldown_hours: float = 72) -> DataFrame:
    """episodes with sent: a notification goes out if the last one sent is cooldown_hours old or more.

    The rule is greedy, so an entity's starts are folded in order; their number is that of its episodes.
    """
    limit = 3600.0 * cooldown_hours
    starts = episodes.groupBy(*keys).agg(F.sort_array(F.collect_list(seconds("start"))).alias("_all"))
    fold = F.aggregate("_all", F.array().cast("array<double>"), lambda sent, t: F.when((F.size(sent) == 0) | (t - F.element_at(sent, -1) >= limit), F.array_append(sent, t)).otherwise(sent))
    sent = starts.select(*keys, fold.alias("_sent"))
    return episodes.join(sent, keys).withColumn("sent", F.array_contains("_sent", seconds("start"))).drop("_sent")
