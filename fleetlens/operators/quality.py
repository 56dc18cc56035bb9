"""Range profiles, guardrails on latest rows, frame profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranks


def unpivoted(df: DataFrame, ids: list[str], cols: list[str]) -> DataFrame:
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(ids, cols, "feature", "value")


def feature_profile(train: DataFrame, cols: list[str], least: int = 100, widen: float = 0.1) -> DataFrame:
    """feature, n, median, lower, upper: exact quantiles of each column, bounds widened by a share of the middle range.

    Columns with fewer than `least` known values are left out.
    """
    points = [0.005, 0.25, 0.5, 0.75, 0.995]
    long = unpivoted(train, [], cols)
    found = ranks.quantiles_by(long, ["feature"], "value", points).groupBy("feature").agg(*[F.max(F.when(F.col("i") == i, F.col("q"))).alias(f"q{i}") for i in range(5)])
    counts = long.groupBy("feature").agg(F.count("value").alias("n")).where(F.col("n") >= least)
    margin = widen * (F.col("q3") - F.col("q1"))
    return counts.join(found, "feature").select("feature", "n", F.col("q2").alias("median"), (F.col("q0") - margin).alias("lower"), (F.col("q4") + margin).alias("upper"))


def coherence(signal: str, short: int = 24, long: int = 168, delta_tolerance: float = 1e-5, z_tolerance: float = 1e-4) -> Column:
    """1 where a signal's recorded step or score is not what its value, lag, mean and deviation give, else 0.

    Columns are named as timeseries.causal_rolling() names them. Nulls cannot contradict.
    """
    x, lag, step = F.col(signal), F.col(f"{signal}_lag_1h"), F.col(f"{signal}_delta_1h")
    mean, std, z = (F.col(f"{signal}_{c}_{long}h") for c in ("mean", "std", "zscore"))
    off = F.abs(step - (x - lag)) / F.greatest(F.lit(1.0), F.abs(x)) > delta_tolerance
    away = F.abs(z - (x - mean) / F.when(F.abs(std) > 1e-9, std)) > z_tolerance
    return (F.coalesce(off, F.lit(False)) | F.coalesce(away, F.lit(False))).cast("int")


def assess_quality(latest: DataFrame, key: str, profile: DataFrame, cols: list[str], signals: tuple[str, ...] = (), max_missing: float = 0.05, max_outside: float = 0.06, max_violations: int = 0, **windows: int) -> DataFrame:
    """missing and outside (shares of the profiled features), violations (incoherent signals), status PASS or REVIEW,
    publish_allowed and the reason, by entity. latest has one row of each; profile a row for each feature at most."""
    violated = sum((coherence(s, **windows) for s in signals), F.lit(0))
    marks = latest.select(F.col(key), violated.alias("violations"))
    rows = unpivoted(latest, [key], cols).join(F.broadcast(profile), "feature")
    outside = F.coalesce((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper")), F.lit(False))
    shares = rows.groupBy(key).agg(F.avg(F.col("value").isNull().cast("double")).alias("missing"), F.avg(outside.cast("double")).alias("outside"))
    out = marks.join(shares, key, "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("missing", "outside")})
    percent = lambda c: F.concat(F.round(100 * F.col(c), 1).cast("string"), F.lit("%"))
    reasons = [
        F.when(F.col("missing") > max_missing, F.concat(F.lit("missing features "), percent("missing"))),
        F.when(F.col("outside") > max_outside, F.concat(F.lit("features out of range "), percent("outside"))),
        F.when(F.col("violations") > max_violations, F.concat(F.col("violations").cast("string"), F.lit(" incoherent signals"))),
    ]
    reason = F.nullif(F.concat_ws("; ", *reasons), F.lit(""))
    return out.withColumns({"status": F.when(reason.isNull(), "PASS").otherwise("REVIEW"), "publish_allowed": reason.isNull(), "reason": F.coalesce(reason, F.lit("passed"))})


def hours_expanded(intervals: DataFrame, key: str, start: str, hours: Column) -> DataFrame:
    """key, hour of each full or begun hour that an interval of so many hours touches from its start on, once each.

    Intervals without a start or of no length touch none.
    """
    first = F.date_trunc("hour", start)
    rows = intervals.where(F.col(start).isNotNull() & (hours > 0)).select(key, F.explode(F.sequence(first, first + F.make_dt_interval(hours=(F.ceil(hours) - 1).cast("int")), F.expr("INTERVAL 1 HOUR"))).alias("hour"))
    return rows.distinct()


def reconciled(left: DataFrame, right: DataFrame, key: str, at: str) -> DataFrame:
    """key, both, left_only, right_only: how two lists of (key, at) cover each other, repeated rows once."""
    one = left.select(key, at).distinct().withColumn("l", F.lit(1)).unionByName(right.select(key, at).distinct().withColumn("l", F.lit(2)))
    each = one.groupBy(key, at).agg(F.sum("l").alias("s"))
    return each.groupBy(key).agg(F.count_if(F.col("s") == 3).alias("both"), F.count_if(F.col("s") == 1).alias("left_only"), F.count_if(F.col("s") == 2).alias("right_only"))


def hour_gaps(df: DataFrame, key: str, ts: str, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """key, expected, seen, missing, first_missing of the hours from start to end (else each entity's own first and last).

    Only entities whose counts differ get a grid of hours, against which theirs are anti-joined.
    """
    hour = F.date_trunc("hour", ts)
    inside = df.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    inside = inside if start is None else inside.where(hour >= F.date_trunc("hour", start))
    inside = inside if end is None else inside.where(hour <= F.date_trunc("hour", end))
    seen = inside.select(key, hour.alias("hour")).distinct()
    span = seen.groupBy(key).agg(F.min("hour").alias("a"), F.max("hour").alias("b"), F.count("*").alias("seen"))
    span = span.withColumns({k: F.date_trunc("hour", v) for k, v in (("a", start), ("b", end)) if v is not None})
    span = span.withColumn("expected", ((F.unix_micros(F.col("b").cast("timestamp")) - F.unix_micros(F.col("a").cast("timestamp"))) / 3_600_000_000 + 1).cast("long"))
    short = span.where("seen < expected")
    grid = short.select(key, F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 HOUR"))).alias("hour"))
    gaps = grid.join(seen, [key, "hour"], "left_anti").groupBy(key).agg(F.count("*").alias("missing"), F.min("hour").alias("first_missing"))
    return span.select(key, "expected", "seen").join(gaps, key, "left").withColumn("missing", F.coalesce("missing", F.lit(0)))


def facet_options(dim: DataFrame, selected: dict[str, list]) -> tuple[dict[str, list], DataFrame]:
    """What stays of a selection, and (field, choice, chosen) of all values that go with what the other fields have chosen.

    A field with an empty selection does not filter. Values that no row has together with the other fields' choices are
    dropped, round by round until none is, since a dropped one may free or bar others. Rounds go over the distinct
    combinations of the fields, not the rows; what comes to the driver are chosen values that stay.
    """
    fields = list(selected)
    cells = dim.groupBy(*fields).agg(F.count("*").alias("n")).persist()
    chosen = {f: list(v) for f, v in selected.items()}
    others = lambda f: [F.col(g).isin(chosen[g]) for g in fields if g != f and chosen[g]]

    def scoped(f: str) -> DataFrame:
        rows = cells
        for c in others(f):
            rows = rows.where(c)
        return rows

    while True:
        stay = {f: [v for v in chosen[f] if v in {r[0] for r in scoped(f).where(F.col(f).isin(chosen[f])).select(f).distinct().collect()}] if chosen[f] else [] for f in fields}
        if stay == chosen:
            break
        chosen = stay
    out = None
    for f in fields:
        part = scoped(f).groupBy(f).agg(F.sum("n").alias("n")).select(F.lit(f).alias("field"), F.col(f).cast("string").alias("choice"), F.col(f).isin(chosen[f]).alias("chosen") if chosen[f] else F.lit(False).alias("chosen"), "n")
        out = part if out is None else out.unionByName(part)
    return chosen, out


def frame_profile(df: DataFrame) -> DataFrame:
    """Rows, nulls and distinct values per column, one pass."""
    one = df.agg(*[F.struct(F.count("*").alias("n"), F.count_if(F.col(c).isNull()).alias("nulls"), F.count_distinct(c).alias("d")).alias(c) for c in df.columns])
    return one.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, df.columns)), F.array(*df.columns))).alias("name", "s")).select("name", F.col("s.n").alias("n"), F.col("s.nulls").alias("nulls"), F.col("s.d").alias("n_distinct"))
