"""Evaluation of scored rows: confusion, ranking metrics, thresholds, events, calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import wilson_bounds
from . import ranks
from .timeseries import alert_episodes, notifications, persistence, seconds

BASES = ("all_limits_met", "false_alert_limit_relaxed", "least_event_and_lead_shortfall")


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))


def confusion(df: DataFrame, by: list[str], y: str, predicted: Column, score: str) -> DataFrame:
    """Counts, precision, recall, F1, balanced accuracy, Brier score and positive rate by group, in one pass."""
    p, t = predicted, F.col(y) == 1
    out = df.groupBy(*by).agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"), F.count_if(~p & ~t).alias("tn"), F.avg(F.pow(F.col(score) - F.col(y), 2)).alias("brier"), F.avg(F.col(y).cast("double")).alias("positive_rate"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = out.withColumns({"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn)})
    return out.withColumns({"f1": _ratio(2 * tp, 2 * tp + fp + fn), "balanced_accuracy": (F.col("recall") + _ratio(tn, tn + fp)) / 2})


def score_counts(df: DataFrame, by: list[str], y: str, score: str) -> DataFrame:
    """Rows and positives by distinct score, with running sums from the largest score down."""
    c = df.groupBy(*by, score).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("long")).alias("p"))
    return ranks.running(c, by, score, ["n", "p"])


def average_precision(df: DataFrame, by: list[str], y: str, score: str) -> DataFrame:
    """Sum of recall steps times precision over distinct scores."""
    return score_counts(df, by, y, score).groupBy(*by).agg((F.sum(F.col("p") * F.col("cum_p") / F.col("cum_n")) / F.nullif(F.max("all_p"), F.lit(0))).alias("average_precision"))


def roc_auc(df: DataFrame, by: list[str], y: str, score: str) -> DataFrame:
    """Area under the curve with ties at half, from counts by distinct score."""
    c = score_counts(df, by, y, score)
    below = F.col("all_n") - F.col("all_p") - (F.col("cum_n") - F.col("cum_p"))
    wins = F.sum(F.col("p") * (below + (F.col("n") - F.col("p")) / 2.0))
    return c.groupBy(*by).agg((wins / F.nullif(F.max(F.col("all_p") * (F.col("all_n") - F.col("all_p"))), F.lit(0))).alias("roc_auc"))


def best_f_beta(df: DataFrame, by: list[str], y: str, score: str, beta: float = 1.0) -> DataFrame:
    """The lowest threshold among those of the best F-beta; candidates are the distinct scores."""
    c = score_counts(df, by, y, score)
    b = beta * beta
    f = _ratio((1 + b) * F.col("cum_p"), b * F.col("all_p") + F.col("cum_n"))
    return c.withColumn("f", F.round(f, 12)).groupBy(*by).agg(F.max_by(F.struct(F.col(score).alias("threshold"), "f"), F.struct("f", -F.col(score))).alias("b")).select(*by, "b.threshold", F.col("b.f").alias("f_beta"))


def f_beta_and_precision(df: DataFrame, y: str, score: str, beta: float = 1.0) -> DataFrame:
    """One row: threshold and f_beta as of best_f_beta(), and average_precision, from one count of the scores."""
    c = score_counts(df, [], y, score)
    b = beta * beta
    f = F.round(_ratio((1 + b) * F.col("cum_p"), b * F.col("all_p") + F.col("cum_n")), 12)
    best = F.max_by(F.struct(F.col(score).alias("threshold"), f.alias("f")), F.struct(f, -F.col(score)))
    return c.agg(best.alias("b"), (F.sum(F.col("p") * F.col("cum_p") / F.col("cum_n")) / F.nullif(F.max("all_p"), F.lit(0))).alias("average_precision")).select("b.threshold", F.col("b.f").alias("f_beta"), "average_precision")


def grid_points(count: int = 121) -> list[float]:
    """Quantiles to take: a quarter of them evenly below 0.9, the others up to 0.9999, and 1."""
    n = max(count, 25)
    low = max(n // 4, 8)
    high = n - low
    return sorted({*[0.9 * i / low for i in range(low)], *[0.9 + (0.9999 - 0.9) * i / (high - 1) for i in range(high)], 1.0})


def threshold_grid(df: DataFrame, score: str, count: int = 121) -> list[float]:
    """Candidate thresholds: distinct quantiles of the scores within [1e-9, 1]; `count` + 1 at most."""
    found = ranks.quantiles(df, score, grid_points(count))
    return sorted({min(1.0, max(1e-9, x)) for x in found if x is not None})


def lasting_score(df: DataFrame, keys: list[str], order: list[str], score: str, lookback: int = 6, min_hits: int = 3) -> DataFrame:
    """df with lasting: the largest threshold at which the row is a persistent alert, null if there is none.

    That is its score, or the min_hits-th largest of the last `lookback` scores if that is less. One window thus serves
    all thresholds.
    """
    last = F.collect_list(score).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - lookback, 0))
    of = F.sort_array(last, asc=False)
    return df.withColumn("lasting", F.when(F.size(of) >= min_hits, F.least(score, F.get(of, F.lit(min_hits - 1)))))


def threshold_curve(scored: DataFrame, grid: list[float], y: str = "y", event: str = "next_failure_date", days: str = "days_to_next_failure", key: str = "tag", ts: str = "ts",
                    reset_hours: float = 24, order: tuple[str, ...] = ("ts", "event_id"), score: str = "score", lookback: int = 6, min_hits: int = 3) -> DataFrame:
    """One row for each threshold of grid: what persistent alerts at that threshold find and cost.

    Rows: predicted, tp, precision, recall, f1, false_rows. Days: false_days (entity and day with a false alert),
    exposure_months (observed entity days / 30.4375), false_days_per_month. Events (entity and next failure): events,
    detected, event_recall, median_lead_days of the earliest alert. Episodes (alerts no more than reset_hours apart):
    episodes, true_episodes, false_episodes, false_episodes_per_month, episode_precision, median_span_hours.

    Rows, days and events are first counted by the grid's cells, so they are not multiplied by the thresholds; episodes
    depend on which alerts lie between, so alerts alone are followed threshold by threshold. Rates with nothing to
    divide by are 0, medians over nothing null. grid is a bounded list; rows with a null y are left out. The narrow rows
    are persisted, since each count reads them.
    """
    spark = scored.sparkSession
    rows = lasting_score(scored.where(F.col(y).isNotNull()), [key], list(order), score, lookback, min_hits)
    cell = ranks.range_of(F.coalesce("lasting", F.lit(-1.0)), grid)
    rows = rows.select(key, ts, F.col(y).cast("long").alias("y"), event, days, F.to_date(ts).alias("day"), cell.cast("int").alias("cell")).persist()
    points = F.broadcast(spark.createDataFrame([(i + 1, t) for i, t in enumerate(grid)], "i int, threshold double"))

    def at_least(cells: DataFrame, **sums: Column) -> DataFrame:
        """Sums over the cells from each threshold's on; cells has a row for each cell at most."""
        return points.join(F.broadcast(cells), F.col("cell") >= F.col("i"), "left").groupBy("threshold").agg(*[F.coalesce(c, F.lit(0)).cast("long").alias(n) for n, c in sums.items()])

    counts = rows.groupBy("cell").agg(F.count("*").alias("n"), F.sum("y").alias("p"))
    out = at_least(counts, predicted=F.sum("n"), tp=F.sum("p"))
    false_days = rows.where("y = 0").groupBy(key, "day").agg(F.max("cell").alias("cell")).groupBy("cell").agg(F.count("*").alias("d"))
    out = out.join(at_least(false_days, false_days=F.sum("d")), "threshold")

    seen = rows.where(F.col(event).isNotNull()).groupBy(key, event, "cell").agg(F.max(days).alias("lead"))
    first = Window.partitionBy(key, event).orderBy(F.col("cell").desc())
    below = F.coalesce(F.lead("cell").over(first), F.lit(0))
    led = seen.withColumns({"lead": F.max("lead").over(first), "below": below}).where("cell > 0")
    # From the next lower cell's threshold up to its own, an event's earliest alert is the same.
    per_event = led.select("lead", F.explode(F.sequence(F.col("below") + 1, F.col("cell"))).alias("at"))
    leads = per_event.groupBy("at").agg(F.count("*").alias("detected"), F.percentile("lead", 0.5).alias("median_lead_days"))
    out = out.join(points.join(F.broadcast(leads), F.col("i") == F.col("at"), "left").select("threshold", F.coalesce("detected", F.lit(0)).cast("long").alias("detected"), "median_lead_days"), "threshold")

    each = rows.where("cell > 0").select(key, ts, "y", F.explode(F.sequence(F.lit(1), F.col("cell"))).alias("at"))
    follow = Window.partitionBy("at", key).orderBy(ts)
    gap = seconds(ts) - seconds(F.lag(ts).over(follow))
    numbered = each.withColumn("episode", F.sum(F.when(gap > 3600 * reset_hours, 1).otherwise(0)).over(follow))
    episodes = numbered.groupBy("at", key, "episode").agg(F.max("y").alias("y"), ((seconds(F.max(ts)) - seconds(F.min(ts))) / 3600 + 1).alias("span"))
    found = episodes.groupBy("at").agg(F.count("*").alias("episodes"), F.sum("y").alias("true_episodes"), F.percentile("span", 0.5).alias("median_span_hours"))
    found = points.join(F.broadcast(found), F.col("i") == F.col("at"), "left")
    whole = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("episodes", "true_episodes")]
    out = out.join(found.select("threshold", *whole, "median_span_hours"), "threshold")

    totals = counts.agg(F.sum("p").alias("all_p"))
    totals = totals.crossJoin(rows.select(key, "day").distinct().agg((F.count("*") / 30.4375).alias("exposure_months")))
    totals = totals.crossJoin(rows.where(F.col(event).isNotNull()).select(key, event).distinct().agg(F.count("*").alias("events")))
    out = out.crossJoin(F.broadcast(totals))
    months, false_episodes = F.col("exposure_months"), F.col("episodes") - F.col("true_episodes")
    return out.select(
        "threshold", "predicted", "tp", _ratio(F.col("tp"), F.col("predicted")).alias("precision"), _ratio(F.col("tp"), F.col("all_p")).alias("recall"),
        _ratio(2 * F.col("tp"), F.col("predicted") + F.col("all_p")).alias("f1"), (F.col("predicted") - F.col("tp")).alias("false_rows"),
        "false_days", "exposure_months", _ratio(F.col("false_days"), months).alias("false_days_per_month"),
        "events", "detected", _ratio(F.col("detected"), F.col("events")).alias("event_recall"), "median_lead_days",
        "episodes", "true_episodes", false_episodes.alias("false_episodes"), _ratio(false_episodes, months).alias("false_episodes_per_month"),
        _ratio(F.col("true_episodes"), F.col("episodes")).alias("episode_precision"), "median_span_hours",
    )


def operational_metrics(scored: DataFrame, threshold: float, **options) -> DataFrame:
    """The row of threshold_curve() for one threshold."""
    return threshold_curve(scored, [threshold], **options)


def select_threshold(curve: DataFrame, min_event_recall: float = 0.8, min_lead_days: float = 0.0, max_false_days: float | None = None, max_false_episodes: float | None = None,
                     metric: str = "days", cap: float | None = None) -> DataFrame:
    """The quietest threshold of a curve that keeps the limits; one row, with the basis on which it was chosen.

    First of those that keep all limits the one with the fewest false alerts; else, of those with enough events and lead,
    the one that breaks the false-alert limits least (relative to them); else the one that breaks the others least. Ties go
    by the other false-alert rate, precision, events and lead, and the larger threshold. cap: thresholds above it are
    left out. No row if none is left. A missing rate of episodes counts as over its limit.
    """
    if metric not in ("days", "episodes"):
        raise ValueError(f"metric: {metric}")
    if "false_episodes_per_month" not in curve.columns:
        if max_false_episodes is not None:
            raise ValueError("a limit on episodes needs their rate")
        curve = curve.withColumn("false_episodes_per_month", F.lit(None).cast("double"))
    if cap is not None:
        curve = curve.where(F.col("threshold") <= cap + 1e-12)
    many = F.lit(1e308)
    recall, lead = F.coalesce("event_recall", F.lit(0.0)), F.coalesce("median_lead_days", F.lit(0.0))
    limits = [("false_days_per_month", max_false_days), ("false_episodes_per_month", max_false_episodes)]
    over = lambda c, most: F.greatest(F.lit(0.0), F.coalesce(c, many) - most) / max(most, 1e-9)
    quiet, excess = F.lit(True), F.lit(0.0)
    for c, most in limits:
        if most is not None:
            quiet, excess = quiet & (F.coalesce(c, many) <= most), excess + over(c, most)
    safe = (recall >= min_event_recall) & (lead >= min_lead_days)
    unsafe = F.greatest(F.lit(0.0), min_event_recall - recall) / max(min_event_recall, 1e-9) + F.greatest(F.lit(0.0), min_lead_days - lead) / max(min_lead_days, 1.0)
    first, second = (F.coalesce(c, many) for c, _ in (limits if metric == "days" else limits[::-1]))
    precision, threshold, none = -F.col("precision"), -F.col("threshold"), F.lit(0.0)
    tier = F.when(safe & quiet, 0).when(safe, 1).otherwise(2)
    keys = F.when(tier == 0, F.array(first, second, precision, -recall, -lead, threshold, none)).when(
        tier == 1, F.array(excess, first, second, precision, -recall, threshold, none)
    ).otherwise(F.array(unsafe, -recall, first, second, precision, threshold, none))
    basis = F.element_at(F.array(*map(F.lit, BASES)), tier + 1)
    ranked = curve.withColumns({"_tier": tier, "_keys": F.transform(keys, lambda x: F.when(F.abs(x) < 1e300, F.round(x, 9)).otherwise(x)), "selection_basis": basis, "limits_met": safe & quiet, "events_and_lead_met": safe, "false_alert_limit_met": quiet})
    return ranked.orderBy("_tier", "_keys").limit(1).drop("_tier", "_keys")


def event_metrics(df: DataFrame, event: str, predicted: Column, days: str) -> DataFrame:
    """events, detected, recall and median of the earliest lead among detected ones; rows outside events do not count."""
    per = df.where(F.col(event).isNotNull()).groupBy("tag", event).agg(F.max(predicted).alias("hit"), F.max(F.when(predicted, F.col(days))).alias("lead"))
    return per.agg(F.count("*").alias("events"), F.count_if("hit").alias("detected"), F.avg(F.col("hit").cast("double")).alias("event_recall"), F.percentile("lead", 0.5).alias("median_lead_days"))


def episode_report(scored: DataFrame, by: list[str], alert: Column, y: str = "y", key: str = "tag", ts: str = "ts", order: tuple[str, ...] = ("ts", "event_id"), reset_hours: float = 24, cooldown_hours: float = 72) -> DataFrame:
    """One row per group: episodes of alerts, how many are true, the notifications that go out after a cooldown, and both
    false rates per observed entity month. alert says which rows are alerts; a group without rows has no row, one without
    alerts has zeros. An episode is true if one of its alerts is."""
    rows = scored.select(*by, key, ts, *[c for c in order if c != ts], F.coalesce(alert, F.lit(False)).alias("alert"), F.col(y).alias("y"))
    found = notifications(alert_episodes(rows.where("alert"), [*by, key], ts, list(order), "y", reset_hours), [*by, key], cooldown_hours)
    counts = found.groupBy(*by).agg(
        F.count("*").alias("episodes"), F.count_if("true_episode").alias("true_episodes"), F.count_if("sent").alias("notifications"), F.count_if(F.col("sent") & ~F.col("true_episode")).alias("false_notifications"),
        F.sum("alerts").alias("alerts"), F.percentile("span_hours", 0.5).alias("median_span_hours"), F.max("span_hours").alias("longest_hours"),
    )
    months = rows.select(*by, key, F.to_date(ts).alias("day")).distinct().groupBy(*by).agg((F.count("*") / 30.4375).alias("exposure_months"))
    out = months.join(counts, by, "left").na.fill(0, ["episodes", "true_episodes", "notifications", "false_notifications", "alerts"])
    false = F.col("episodes") - F.col("true_episodes")
    return out.withColumns({
        "false_episodes": false, "episode_precision": _ratio(F.col("true_episodes"), F.col("episodes")), "false_episodes_per_month": _ratio(false, F.col("exposure_months")),
        "false_notifications_per_month": _ratio(F.col("false_notifications"), F.col("exposure_months")),
    })


def compare_persistence(df: DataFrame, keys: list[str], order: list[str], score: str, y: str, threshold: float, rules: list[tuple[int, int]]) -> DataFrame:
    """Alerts and false alerts of each rule (hits, rows); rule 1 of 1 is the raw signal. One sort serves all."""
    hit = F.col(score) >= threshold
    rows = df
    for need, of in rules:
        rows = persistence(rows, keys, order, hit, of, need).withColumnRenamed("persistent", f"_r{need}_{of}").drop("hits")
    each = F.explode(F.array(*[F.struct(F.lit(f"{a}_of_{b}").alias("rule"), F.col(f"_r{a}_{b}").alias("alert")) for a, b in rules])).alias("r")
    return rows.select(y, each).groupBy("r.rule").agg(F.count_if("r.alert").alias("alerts"), F.count_if(F.col("r.alert") & (F.col(y) == 0)).alias("false_alerts"))


#: Hits of rows that make an alert last: none asked for, the usual rule, and others to compare it with.
RULES = ((1, 1), (3, 6), (2, 3), (4, 6), (9, 12), (18, 24))


def compare_rules(scored: DataFrame, threshold: float, rules: tuple[tuple[int, int], ...] = RULES, most_false_days: float | None = None, **options) -> DataFrame:
    """operational_metrics() of each rule (hits, rows) at one threshold, a row for each: what lasting alerts find and cost.

    The first rule is the one without persistence: each row also has by how much its false days a month are fewer, in
    numbers and as a share (0 if there are none), and, with most_false_days, whether they keep that limit.
    """
    out = None
    for hits, of in rules:
        one = operational_metrics(scored, threshold, lookback=of, min_hits=hits, **options).withColumn("rule", F.lit(f"{hits}_of_{of}"))
        out = one if out is None else out.unionByName(one)
    out = out.persist()
    raw = out.where(F.col("rule") == "{}_of_{}".format(*rules[0])).select(F.col("false_days_per_month").alias("_raw"))
    fewer = F.col("_raw") - F.col("false_days_per_month")
    out = out.crossJoin(F.broadcast(raw)).withColumns({"fewer_false_days": fewer, "fewer_share": _ratio(fewer, F.col("_raw"))})
    if most_false_days is not None:
        out = out.withColumn("limit_met", F.col("false_days_per_month") <= most_false_days)
    return out.select("rule", *[c for c in out.columns if c not in ("rule", "_raw")])


def reliability(df: DataFrame, y: str, score: str, bins: int = 10) -> DataFrame:
    """Rows, mean score, observed rate and its Wilson bounds by right-closed bin; the first bin holds its lower edge."""
    b = F.greatest(F.lit(1), F.ceil(F.round(F.col(score) * bins, 9))).cast("int")
    out = df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("long")).alias("positives"), F.avg(score).alias("mean_score"))
    low, high = wilson_bounds(F.col("positives"), F.col("n"))
    return out.withColumns({"observed": F.col("positives") / F.col("n"), "lower": low, "upper": high})


def calibration_error(table: DataFrame) -> DataFrame:
    return table.agg((F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("observed"))) / F.sum("n")).alias("ece"))


def cluster_draws(clusters: DataFrame, cluster: str, iterations: int, seed: str = "boot") -> DataFrame:
    """cluster, iteration, times: the iterations that pick it (a list) and how often they do.

    clusters has one row of each. An iteration picks as many as there are, each by a hash of seed, iteration and slot, so
    reruns agree.
    """
    number = F.col(cluster).cast("double") if clusters.schema[cluster].dataType.typeName() in ("byte", "short", "integer", "long", "double") else F.lit(0.0)
    numbered = ranks.position(clusters, -number, [F.col(cluster)], "slot").withColumn("slot", F.col("slot") - 1)
    total = clusters.count()
    # A cluster becomes `iterations` rows: as many tasks as that takes, whatever the few clusters' bytes say.
    tasks, short = total * iterations // PICKS + 1, "smallint" if iterations < 1 << 15 else "int"
    slots = numbered.select(F.col("slot").alias("s")).repartition(tasks, "s").select("s", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("iteration"))
    picked = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "iteration", "s")), 1, 12), 16, 10).cast("long"), F.lit(max(1, total))).cast("int")
    dealt = slots.select(picked.alias("slot"), F.col("iteration").cast(short).alias("iteration")).repartition(tasks, "slot")
    times = dealt.groupBy("slot", "iteration").agg(F.count("*").cast(short).alias("times"))
    draws = times.groupBy("slot").agg(F.collect_list(F.struct("iteration", "times")).alias("d"))
    return numbered.repartition(tasks, "slot").join(draws.hint("merge"), "slot").select(cluster, F.col("d.iteration").alias("iteration"), F.col("d.times").alias("times"))


#: Draws that one task makes.
PICKS = 1_000_000
#: Rows of a range of scores, and rows of one score from which they are summed by iteration before.
IN_RANGE, OF_SCORE = 20_000, 1_000


#: Rows whose draws a task holds as numbers by iteration; ranges whose sums it holds.
AT_ONCE = 1_000


def _drawn(b: pa.RecordBatch, key: str = "range") -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of rows with lists the key, n, p, and of all list entries the row, the iteration and the times."""
    iteration, times = b.column("iteration"), b.column("times")
    row = np.repeat(np.arange(b.num_rows), iteration.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    lists = row, iteration.flatten().to_numpy(zero_copy_only=False).astype(np.int64), times.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return b.column(key).to_numpy(zero_copy_only=False), *(b.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("n", "p")), lists


def _by_iteration(at: np.ndarray, size: int, n: np.ndarray, p: np.ndarray, lists: tuple[np.ndarray, np.ndarray, np.ndarray], iterations: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of n and p, as often as drawn, by place and iteration."""
    row, which, times = lists
    total = lambda key, x: np.bincount(key, x, minlength=size * iterations).reshape(size, iterations)
    key, some = at[row] * iterations + which, p[row] != 0
    return total(key, times * n[row]), total(key[some], (times * p[row])[some])


def drawn_precision(cells: DataFrame, iterations: int) -> DataFrame:
    """iteration, ap: the average precision of each iteration; without positives there is none.

    cells: score, n, p, iteration and times (lists of the row's cluster). Ranges of scores go to tasks; a task sums the iterations as vectors
    from the largest score down and starts from the sums of the ranges above (ranges x iterations numbers). There are more
    ranges with more rows, and a score of many rows comes as one row with its sums: what a task holds does not grow.
    """
    edges = ranks.edges_of(cells, F.col("score"), max(ranks.PARTS, cells.count() // IN_RANGE))
    cut = cells.withColumn("range", ranks.range_of(F.col("score"), edges).cast("int"))

    def by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def told() -> pa.RecordBatch:
            at = np.repeat(np.array([*held], np.int32), iterations)
            n, p = (np.concatenate([x[k] for x in held.values()]) for k in (0, 1))
            some = n != 0
            which = np.tile(np.arange(iterations, dtype=np.int32), len(held))
            return pa.RecordBatch.from_arrays([pa.array(at[some]), pa.array(which[some]), pa.array(n[some].astype(np.int64)), pa.array(p[some].astype(np.int64))], names=["range", "iteration", "n", "p"])

        for b in batches:
            for k in range(0, b.num_rows, AT_ONCE):
                ranges, n, p, lists = _drawn(b.slice(k, AT_ONCE))
                found, at = np.unique(ranges, return_inverse=True)
                for i, r in enumerate(found.tolist()):
                    held.setdefault(r, np.zeros((2, iterations)))
                sums = _by_iteration(at, len(found), n, np.nan_to_num(p), lists, iterations)
                for i, r in enumerate(found.tolist()):
                    held[r] += (sums[0][i], sums[1][i])
                if len(held) > AT_ONCE:
                    yield told()
                    held.clear()
        if held:
            yield told()

    kind = cells.schema["iteration"].dataType.elementType
    each = cut.select("range", F.col("n").cast("double").alias("n"), F.col("p").cast("double").alias("p"), "iteration", "times").mapInArrow(by_range, "range int, iteration int, n long, p long")
    each = each.groupBy("range", F.col("iteration").cast(kind).alias("iteration")).agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    above = Window.partitionBy("iteration").orderBy(F.col("range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    before = each.select("range", "iteration", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n"), F.coalesce(F.sum("p").over(above), F.lit(0)).alias("p"))
    start = before.groupBy("range").agg(F.collect_list(F.struct("iteration", "n", "p")).alias("start")).withColumn("first", F.lit(True))
    empty = F.array().cast(cells.schema["iteration"].dataType)
    sums_of, no_start = "array<struct<iteration:int,n:bigint,p:bigint>>", F.lit(None).cast(start.schema["start"].dataType).alias("start")
    none = F.lit(None).cast(sums_of).alias("summed")
    heads = start.select("range", F.lit(None).cast("double").alias("score"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("p"), empty.alias("iteration"), empty.alias("times"), none, "start")
    often = cells.groupBy(F.col("score").cast("double").alias("_s")).agg(F.count("*").alias("_n")).where(F.col("_n") > OF_SCORE).select("_s", F.lit(True).alias("_hot"))
    known = cut.withColumn("score", F.col("score").cast("double")).join(F.broadcast(often), F.col("score").eqNullSafe(F.col("_s")), "left").withColumn("hot", F.coalesce("_hot", F.lit(False)))
    hot = known.where("hot").select("range", "score", "n", "p", F.explode(F.arrays_zip("iteration", "times")).alias("d"))
    hot = hot.groupBy("range", "score", "d.iteration").agg(F.sum(F.col("d.times") * F.col("n")).alias("n"), F.sum(F.col("d.times") * F.col("p")).alias("p"))
    hot = hot.groupBy("range", "score").agg(F.collect_list(F.struct("iteration", "n", "p")).cast(sums_of).alias("summed"))
    hot = hot.select("range", "score", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("p"), empty.alias("iteration"), empty.alias("times"), "summed", no_start)
    rows = known.where("NOT hot").select("range", "score", F.col("n").cast("long").alias("n"), F.col("p").cast("long").alias("p"), "iteration", "times", none, no_start)
    dealt = heads.unionByName(rows).unionByName(hot).repartitionById(len(edges) + 1, F.col("range")).sortWithinPartitions("range", F.col("start").isNull(), F.col("score").desc_nulls_last())

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, p, held_n, held_p, ap = (np.zeros(iterations) for _ in range(5))
        at: float | None = None

        def close() -> None:
            """The rows of one score are complete."""
            np.add(n, held_n, out=n)
            np.add(p, held_p, out=p)
            np.add(ap, np.divide(held_p * p, n, out=np.zeros(iterations), where=n > 0), out=ap)
            held_n[:] = held_p[:] = 0

        same = lambda a, b: (a == b) | ((a != a) & (b != b))  # noqa: E731  null scores, the last, are one score

        def plain(b: pa.RecordBatch) -> None:
            """Rows with lists: sums of each score and iteration, then all scores at once."""
            nonlocal at
            score, rows_n, rows_p, lists = _drawn(b, "score")
            new = np.r_[at is None or not same(score[0], at), ~same(score[1:], score[:-1])]
            group = np.cumsum(new) - new[0]
            by_n, by_p = _by_iteration(group, group[-1] + 1, rows_n, rows_p, lists, iterations)
            if not new[0]:
                held_n[:], held_p[:] = held_n + by_n[0], held_p + by_p[0]
                by_n, by_p = by_n[1:], by_p[1:]
            if len(by_n):
                close()
                cum_n, cum_p = n + np.cumsum(by_n[:-1], axis=0), p + np.cumsum(by_p[:-1], axis=0)
                if len(cum_n):
                    np.add(ap, np.divide(by_p[:-1] * cum_p, cum_n, out=np.zeros_like(cum_n), where=cum_n > 0).sum(axis=0), out=ap)
                    n[:], p[:] = cum_n[-1], cum_p[-1]
                held_n[:], held_p[:] = by_n[-1], by_p[-1]
                at = score[-1]

        for b in batches:
            special = np.flatnonzero(b.column("start").is_valid().to_numpy(zero_copy_only=False) | b.column("summed").is_valid().to_numpy(zero_copy_only=False))
            done = 0
            for i in [*special.tolist(), b.num_rows]:
                for k in range(done, i, AT_ONCE):
                    plain(b.slice(k, min(AT_ONCE, i - k)))
                done = i + 1
                if i == b.num_rows:
                    break
                first, summed, score = (b.column(c)[i].as_py() for c in ("start", "summed", "score"))
                if first is not None:
                    close()
                    n[:] = p[:] = 0
                    for d in first:
                        n[d["iteration"]], p[d["iteration"]] = d["n"], d["p"]
                    at = None
                    continue
                score = np.nan if score is None else score
                if at is None or not same(score, at):
                    close()
                    at = score
                for d in summed:
                    held_n[d["iteration"]] += d["n"]
                    held_p[d["iteration"]] += d["p"]
        close()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(iterations, dtype=np.int32)), pa.array(ap)], names=["iteration", "part"])

    parts = dealt.mapInArrow(sums, "iteration int, part double").groupBy("iteration").agg(F.sum("part").alias("part"))
    positives = each.groupBy("iteration").agg(F.sum("p").alias("all_p")).where("all_p > 0")
    return parts.join(positives, "iteration").select("iteration", (F.col("part") / F.col("all_p")).alias("ap"))


def cluster_bootstrap(df: DataFrame, cluster: str, y: str, scores: list[str], iterations: int = 500, seed: str = "boot", confidence: float = 0.95) -> DataFrame:
    """name, draws, mean, lower, upper, share_better: the average precision over resampled clusters, a row for each score.

    With two scores also their difference in the same draws (first less second) and the share of draws in which the
    first is better. Rows are counted by cluster and score before anything is drawn.
    """
    clusters = df.select(cluster).where(F.col(cluster).isNotNull()).distinct().persist()
    draws = cluster_draws(clusters, cluster, iterations, seed).persist()
    each = []
    for s in scores:
        cells = df.groupBy(cluster, F.col(s).cast("double").alias("score")).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("long")).alias("p")).join(draws, cluster)
        each.append(drawn_precision(cells.select("score", "n", "p", "iteration", "times"), iterations).select("iteration", F.col("ap").alias(s)))
    found = each[0]
    for other in each[1:]:
        found = found.join(other, "iteration")
    pairs = [(s, F.col(s), F.lit(None).cast("double")) for s in scores]
    if len(scores) == 2:
        gap = F.col(scores[0]) - F.col(scores[1])
        pairs.append(("difference", gap, (gap > 0).cast("double")))
    long = found.select(F.explode(F.array(*[F.struct(F.lit(k).alias("name"), v.alias("v"), b.alias("b")) for k, v, b in pairs])).alias("x")).select("x.*")
    tail = (1 - confidence) / 2
    return long.groupBy("name").agg(F.count("*").alias("draws"), F.avg("v").alias("mean"), F.percentile("v", tail).alias("lower"), F.percentile("v", 1 - tail).alias("upper"), F.avg("b").alias("share_better"))
