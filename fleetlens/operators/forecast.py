"""Calendars, lags, naive and trend forecasts, backtests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def on_calendar(df: DataFrame, key: str, day: str, y: str, most_missing: float | None = None) -> DataFrame:
    """Each entity's days without gaps; missing values lie on the line between their neighbours.

    most_missing: entities with a larger share of days without a value are left out; missing_shares() names them. Both
    neighbours come from windows that run towards the day. Rows without a key or day are left out.
    """
    known = df.where(F.col(key).isNotNull() & F.col(day).isNotNull())
    grid = known.groupBy(key).agg(F.explode(F.sequence(F.min(day), F.max(day))).alias(day))
    rows = grid.join(known.select(key, day, y), [key, day], "left")
    at = F.when(F.col(y).isNotNull(), F.struct(F.col(day).alias("d"), F.col(y).alias("v")))
    last = lambda order: F.last(at, ignorenulls=True).over(Window.partitionBy(key).orderBy(order))
    rows = rows.withColumns({"_b": last(F.col(day)), "_a": last(F.col(day).desc())})
    if most_missing is not None:
        share = F.avg(F.col(y).isNull().cast("double")).over(Window.partitionBy(key))
        rows = rows.withColumn("_missing", share).where(F.col("_missing") <= most_missing)
    gap = F.date_diff("_a.d", "_b.d")
    blend = F.col("_b.v") + (F.col("_a.v") - F.col("_b.v")) * F.date_diff(F.col(day), F.col("_b.d")) / F.nullif(gap, F.lit(0))
    # Beyond the first or last value there is one neighbour only; it goes on.
    return rows.select(key, day, F.coalesce(y, blend, "_b.v", "_a.v").alias(y), F.col(y).isNull().alias("filled"))


def missing_shares(df: DataFrame, key: str, day: str, y: str) -> DataFrame:
    """key, days, missing: the days between an entity's first and last one, and the share of them without a value."""
    known = df.where(F.col(key).isNotNull() & F.col(day).isNotNull())
    days = F.date_diff(F.max(day), F.min(day)) + 1
    return known.groupBy(key).agg(days.alias("days"), (1 - F.count_distinct(F.when(F.col(y).isNotNull(), F.col(day))) / days).alias("missing"))


def lag_matrix(df: DataFrame, key: str, day: str, y: str, lags: tuple[int, ...] = (1, 2, 3, 7, 14, 28)) -> DataFrame:
    """df with lags, means and deviations of the last 7 and 28 days, and places in the week and year on a circle."""
    w = Window.partitionBy(key).orderBy(day)
    out = {f"lag_{k}": F.lag(y, k).over(w) for k in lags}
    for n in (7, 28):
        before = w.rowsBetween(-n, -1)
        out |= {f"mean_{n}": F.avg(y).over(before), f"std_{n}": F.stddev_pop(y).over(before)}
    for name, at, n in (("week", F.weekday(day), 7.0), ("year", F.dayofyear(day), 365.25)):
        out |= {f"{name}_sin": F.sin(2 * F.pi() * at / n), f"{name}_cos": F.cos(2 * F.pi() * at / n)}
    return df.withColumns(out)


def seasonal_naive(df: DataFrame, key: str, day: str, y: str, horizon: int = 7, season: int = 7) -> DataFrame:
    """The last season's values, repeated over the horizon."""
    w = Window.partitionBy(key).orderBy(F.col(day).desc())
    last = df.withColumns({"_i": F.row_number().over(w), "_end": F.max(day).over(Window.partitionBy(key))}).where(F.col("_i") <= season)
    steps = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")
    rows = last.select(key, y, "_i", "_end", steps).where(F.pmod(F.col("step") - 1, F.lit(season)) == season - F.col("_i"))
    return rows.select(key, "step", F.date_add("_end", F.col("step")).alias(day), F.col(y).alias("forecast"))


def backtest_naive(df: DataFrame, key: str, day: str, y: str, season: int = 7) -> DataFrame:
    """Error of the seasonal naive forecast by entity: MAE, WAPE in percent, bias."""
    w = Window.partitionBy(key).orderBy(day)
    e = F.lag(y, season).over(w) - F.col(y)
    rows = df.withColumn("_e", e).where("_e IS NOT NULL")
    return rows.groupBy(key).agg(F.avg(F.abs("_e")).alias("mae"), (100 * F.sum(F.abs("_e")) / F.nullif(F.sum(F.abs(y)), F.lit(0.0))).alias("wape_pct"), F.avg("_e").alias("bias"))


def trend_projection(df: DataFrame, key: str, day: str, y: str, horizon: int = 7, n: int = 30) -> DataFrame:
    """A line through each entity's last n days, its value `horizon` days on, a 90 % band and the spike limit."""
    w = Window.partitionBy(key).orderBy(F.col(day).desc())
    last = df.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= n).withColumn("_x", -F.col("_i").cast("double"))
    fit = last.groupBy(key).agg(F.count(y).alias("n"), F.regr_slope(y, "_x").alias("slope"), F.regr_intercept(y, "_x").alias("intercept"), F.avg(y).alias("mean"), F.stddev_pop(y).alias("sd"), (F.regr_syy(y, "_x") - F.pow(F.regr_slope(y, "_x"), 2) * F.regr_sxx(y, "_x")).alias("sse"))
    at = F.col("intercept") + F.col("slope") * (horizon - 1)
    sigma = F.sqrt(F.greatest(F.lit(0.0), F.col("sse")) / F.col("n"))
    out = fit.select(key, "slope", at.alias("projected"), (at - 1.645 * sigma).alias("lower"), (at + 1.645 * sigma).alias("upper"), (F.col("mean") + 2 * F.col("sd")).alias("spike"))
    return out.withColumn("decision", F.when(F.col("projected") > F.col("spike"), "SPIKE").when(F.col("slope") > 0, "RISING").otherwise("STABLE"))


def autocorrelation(df: DataFrame, key: str, day: str, y: str, lags: tuple[int, ...] = (1, 2, 7, 24, 168, 720)) -> DataFrame:
    """key, lag, autocorrelation: products of deviations a lag apart over the sum of squares, by series in its order."""
    whole, w = Window.partitionBy(key), Window.partitionBy(key).orderBy(day)
    rows = df.withColumn("_d", F.col(y) - F.avg(y).over(whole))
    rows = rows.select(key, "_d", *[(F.col("_d") * F.lag("_d", k).over(w)).alias(f"_p{k}") for k in lags])
    sums = rows.groupBy(key).agg(F.sum(F.col("_d") * F.col("_d")).alias("_s"), *[F.sum(f"_p{k}").alias(f"_p{k}") for k in lags])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), (F.col(f"_p{k}") / F.nullif(F.col("_s"), F.lit(0.0))).alias("autocorrelation")) for k in lags])).alias("x")
    return sums.select(key, each).select(key, "x.*")


def direction(latest: Column, forecast: Column, sigma: Column) -> Column:
    """Stable within a quarter of sigma or half a percent of the latest value, whichever is more; else Rising or Falling."""
    change = forecast - latest
    room = F.greatest(0.25 * F.coalesce(sigma, F.lit(0.0)), 0.005 * F.abs(latest))
    return F.when(change.isNull(), None).when(F.abs(change) <= room, "Stable").when(change > 0, "Rising").otherwise("Falling")
