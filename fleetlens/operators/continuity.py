"""Whether new data carries on where history ends: means of fixed spans, steps at the join, baselines, snapshots, manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks
from .timeseries import asof_join


def _long(df: DataFrame, keys: list[str], cols: list[str], values: dict[str, str]) -> DataFrame:
    """keys, signal and values: for each column c of cols the columns f"{prefix}{c}", under the names that values gives."""
    parts = [F.struct(F.lit(c).alias("signal"), *[F.col(f"{p}{c}").alias(n) for p, n in values.items()]) for c in cols]
    return df.select(*keys, F.explode(F.array(*parts)).alias("_p")).select(*keys, "_p.*")


def bucket_moves(df: DataFrame, by: list[str], ts: str, cols: list[str], days: int = 28) -> DataFrame:
    """by, signal, bucket, start, mean, move: means over spans of `days` days that begin with the group's first day, and
    by which share each differs from the one before.

    Rows go out as sums and counts by day, so only these are shuffled and sorted. Rows without a time count nowhere, null
    keys are a group. A span without values has no row; a move across it, or from a mean of 0, is null.
    """
    day = df.where(F.col(ts).isNotNull()).groupBy(*by, F.to_date(ts).alias("_day")).agg(*[x for c in cols for x in (F.sum(c).alias(f"s_{c}"), F.count(c).alias(f"n_{c}"))])
    first = F.min("_day").over(Window.partitionBy(*by))
    day = day.withColumn("_first", first).withColumn("bucket", F.floor(F.date_diff("_day", "_first") / days))
    means = _long(day, [*by, "_first", "bucket"], cols, {"s_": "s", "n_": "n"}).groupBy(*by, "signal", "bucket").agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("mean"), F.first("_first").alias("_first"))
    w = Window.partitionBy(*by, "signal").orderBy("bucket")
    known = means.where("mean IS NOT NULL")
    before = F.when(F.lag("bucket").over(w) == F.col("bucket") - 1, F.lag("mean").over(w))
    out = known.withColumn("move", F.abs(F.col("mean") / F.nullif(before, F.lit(0.0)) - 1))
    return out.select(*by, "signal", "bucket", F.date_add("_first", (F.col("bucket") * days).cast("int")).alias("start"), "mean", "move")


def join_steps(df: DataFrame, by: str, ts: str, cols: list[str], split: Column, days: int = 28, share: float = 0.99, exceptions: int = 1, spread: tuple[float, float] = (0.6, 1.4)) -> DataFrame:
    """by, signal: means of the last `days` days before `split` and the first from it on, step (the share by which they
    differ), limit (the quantile `share` of all groups' moves in history, see bucket_moves), std_ratio of all that follows
    to all of history, and what these say: step_ok, spread_ok, and signal_ok, that at most `exceptions` groups of the
    signal step past its limit.

    A signal whose history shows no move has no limit, and no step of it is past it. A group on one side alone has nulls.
    Two scans: one for sums by side, one for history's moves; quantiles go by ranges of the moves, not in one task.
    """
    if df.schema[ts].dataType.typeName() == "date":
        raise ValueError(f"{ts} is a date; the sides are told apart by times")
    old, near = F.col(ts) < split, F.make_dt_interval(days=F.lit(days))
    sides = {"a": old & (F.col(ts) >= split - near), "b": (F.col(ts) >= split) & (F.col(ts) < split + near)}
    aggs = [F.avg(F.when(on, F.col(c))).alias(f"{p}_{c}") for c in cols for p, on in sides.items()]
    aggs += [F.stddev_samp(F.when(on, F.col(c))).alias(f"{p}_{c}") for c in cols for p, on in (("s", old), ("t", F.col(ts) >= split))]
    each = _long(df.groupBy(by).agg(*aggs), [by], cols, {"a_": "old_mean", "b_": "new_mean", "s_": "old_std", "t_": "new_std"})
    each = each.withColumns({"step": F.abs(F.col("new_mean") / F.nullif("old_mean", F.lit(0.0)) - 1), "std_ratio": F.col("new_std") / F.nullif("old_std", F.lit(0.0))})
    moves = bucket_moves(df.where(old), [by], ts, cols, days)
    limits = ranks.quantiles_by(moves, ["signal"], "move", [share]).select("signal", F.col("q").alias("limit"))
    rows = each.join(limits, "signal", "left").withColumns({
        "step_ok": F.coalesce(F.col("step") <= F.col("limit"), F.lit(True)), "spread_ok": F.coalesce(F.col("std_ratio").between(*spread), F.lit(True)),
    })
    past = rows.groupBy("signal").agg((F.count_if(~F.col("step_ok")) <= exceptions).alias("signal_ok"))
    return rows.join(past, "signal").select(by, "signal", "old_mean", "new_mean", "step", "limit", "step_ok", "std_ratio", "spread_ok", "signal_ok")


def parameter_baselines(weekly: DataFrame, failures: DataFrame, limits: DataFrame, before: int = 14, after: int = 3, driver: float = 0.5) -> DataFrame:
    """tag, parameter, n, mean, sd, lowest of the weeks that lie neither up to `before` weeks before a failure's week nor up
    to `after` weeks after it; failures (with a value in their week), ramp, drives, resample.

    weekly: tag, parameter, week_date, value; failures: tag, failure_date, whose week begins on Monday; limits: tag,
    parameter, trip_value. ramp is the mean share of the way from the baseline to the trip value that the parameter has
    gone in the weeks of failures, 0 without any; drives: it is over `driver`. resample: the values spread by a fifth of
    their mean or more, or around 0, so that they are drawn again rather than modelled. Rows without a tag or a week, and
    failures without a time, count nowhere. The nearest failures come from as-of windows, not pairs.
    """
    rows = weekly.where("tag IS NOT NULL AND week_date IS NOT NULL").select("tag", "parameter", F.col("week_date").cast("date").alias("week_date"), F.col("value").cast("double").alias("value"))
    weeks = failures.select("tag", F.date_trunc("week", "failure_date").cast("date").alias("failure_week")).where("tag IS NOT NULL AND failure_week IS NOT NULL").distinct()
    marked = asof_join(rows, weeks, "tag", "week_date", "failure_week", "forward", True, []).withColumnRenamed("asof_ts", "_next")
    marked = asof_join(marked, weeks, "tag", "week_date", "failure_week", "backward", True, []).withColumnRenamed("asof_ts", "_last")
    near = (F.date_diff("_next", "week_date") <= 7 * before, F.date_diff("week_date", "_last") <= 7 * after)
    clean = ~reduce(lambda a, b: a | b, [F.coalesce(x, F.lit(False)) for x in near])
    at_failure = F.when(F.col("_next") == F.col("week_date"), F.col("value"))
    inside = F.when(clean, F.col("value"))
    out = marked.groupBy("tag", "parameter").agg(
        F.count(inside).alias("n"), F.avg(inside).alias("mean"), F.stddev_samp(inside).alias("sd"), F.min(inside).alias("lowest"), F.count(at_failure).alias("failures"), F.avg(at_failure).alias("_at")
    )
    # The mean of shares is the share of the mean, as one baseline and one trip value hold for all of a group's failures.
    share = (F.col("_at") - F.col("mean")) / F.nullif(F.col("trip_value") - F.col("mean"), F.lit(0.0))
    out = out.join(limits.select("tag", "parameter", "trip_value"), ["tag", "parameter"], "left").withColumn("ramp", F.coalesce(share, F.lit(0.0)))
    wide = (F.abs("mean") < 1e-9) | (F.abs(F.col("sd") / F.nullif("mean", F.lit(0.0))) >= 0.2)
    return out.withColumns({"drives": F.col("ramp") > driver, "resample": F.coalesce(wide, F.lit(False))}).drop("_at")


def snapshot_check(weekly: DataFrame, hourly: DataFrame, by: str, week: str, ts: str, cols: dict[str, str], offset_days: int = 6, tolerance: float = 1e-6) -> DataFrame:
    """by, week, signal, snapshot, reading, status for each of cols (snapshot column -> hourly column): the snapshot against
    the reading `offset_days` after the week's date at 00:00. status: equal, differs, no_reading, no_snapshot, repeated.

    Values are equal within `tolerance` of the larger one's size, at least 1. Several readings at the hour are "repeated",
    whatever they are. Weeks without a date have no reading; rows that repeat in weekly are judged each.
    """
    hit = hourly.where(F.col(ts) == F.date_trunc("day", ts)).groupBy(F.col(by).alias("_by"), F.to_date(ts).alias("_day")).agg(F.count("*").alias("_n"), *[F.first(h).alias(f"r_{s}") for s, h in cols.items()])
    rows = weekly.select(F.col(by), F.col(week), *[F.col(s).alias(f"w_{s}") for s in cols])
    joined = rows.join(hit, (F.col(by) == F.col("_by")) & (F.date_add(week, offset_days) == F.col("_day")), "left")
    long = _long(joined, [by, week, "_n"], list(cols), {"w_": "snapshot", "r_": "reading"})
    size = F.greatest(F.lit(1.0), F.abs("snapshot"), F.abs("reading"))
    status = (
        F.when(F.col("_n") > 1, "repeated").when(F.col("reading").isNull(), "no_reading").when(F.col("snapshot").isNull(), "no_snapshot")
        .when(F.abs(F.col("snapshot") - F.col("reading")) <= tolerance * size, "equal").otherwise("differs")
    )
    return long.withColumn("status", status).drop("_n")


def manifest(df: DataFrame, ts: str, labels: tuple[str, ...] = (), provenance: tuple[str, ...] = ()) -> DataFrame:
    """section, name, item, n, at: what a frame holds, in long form.

    frame: rows, columns and numeric_columns; span: the first and the last time (in at); nulls: how many each column has;
    label and provenance: rows of each value of the named columns, a null value as item null. One scan: rows are summed up by
    the values of the named columns (a few combinations), and all figures are sums over these. An empty frame has rows 0,
    null times, and no values.
    """
    named = list(dict.fromkeys((*labels, *provenance)))
    numeric = sum(t.split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal") for _, t in df.dtypes)
    nulls = [F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)]
    cells = df.groupBy(*[F.col(c).cast("string").alias(f"v{i}") for i, c in enumerate(named)]).agg(F.count("*").alias("rows"), F.min(ts).alias("first"), F.max(ts).alias("last"), *nulls)
    no_time = F.lit(None).cast(df.schema[ts].dataType)

    def line(section: str, name: str, item: Column, n: Column, at: Column = no_time) -> Column:
        return F.struct(F.lit(section).alias("section"), F.lit(name).alias("name"), item.cast("string").alias("item"), n.cast("long").alias("n"), at.alias("at"))

    none = F.lit(None)
    lines = [line("frame", "rows", none, F.col("rows")), line("span", "first", none, none, F.col("first")), line("span", "last", none, none, F.col("last"))]
    lines += [line("nulls", c, none, F.col(f"n{i}")) for i, c in enumerate(df.columns)]
    lines += [line("label" if c in labels else "provenance", c, F.col(f"v{i}"), F.col("rows")) for i, c in enumerate(named)]
    each = cells.select(F.explode(F.array(*lines)).alias("_l")).select("_l.*")
    at = F.when(F.col("name") == "first", F.min("at")).otherwise(F.max("at"))
    found = each.groupBy("section", "name", "item").agg(F.sum("n").alias("n"), at.alias("at"))
    # Of an empty frame there is no cell, so its lines come from here; elsewhere these add nothing.
    zeros = df.sparkSession.range(1).select(F.explode(F.array(
        line("frame", "columns", none, F.lit(len(df.columns))), line("frame", "numeric_columns", none, F.lit(numeric)), line("frame", "rows", none, F.lit(0)),
        line("span", "first", none, none), line("span", "last", none, none), *[line("nulls", c, none, F.lit(0)) for c in df.columns],
    )).alias("_l")).select("_l.*")
    return found.unionByName(zeros).groupBy("section", "name", "item").agg(F.sum("n").alias("n"), F.max("at").alias("at"))
