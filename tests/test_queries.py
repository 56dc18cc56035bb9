"""Queries against their SQL on sf0.001, and pinned cases of single operators."""

import datetime as dt
import os
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fleetlens.operators import forecast, labels, metrics, ranks, risk, timeseries
from fleetlens.plans import adapters, catalog
from fleetlens.streaming import flows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in adapters.RAW:
        p = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def cells(df: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if x is None or pd.isna(x):
            return "~"
        if isinstance(x, (int, float)) and not isinstance(x, bool):
            return f"{float(x):.9g}"
        return str(pd.Timestamp(x)) if isinstance(x, (dt.date, dt.datetime, pd.Timestamp)) else str(x)

    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(cell(x) for x in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_agrees_with_its_sql(spark, duck, name):
    assert cells(catalog.queries()[name](spark, SF).toPandas()) == cells(duck.execute(catalog.oracle_sql()[name]).df())


def hours(*at):
    return [dt.datetime(2026, 1, 1) + dt.timedelta(hours=h) for h in at]


def test_persistence_counts_the_latest_rows(spark):
    rows = spark.createDataFrame([(1, t, s) for t, s in zip(hours(*range(7)), (0.9, 0.1, 0.9, 0.9, 0.1, 0.1, 0.9))], "tag int, ts timestamp_ntz, s double")
    out = timeseries.persistence(rows, ["tag"], ["ts"], F.col("s") >= 0.5).orderBy("ts").collect()
    assert [r.hits for r in out] == [1, 1, 2, 3, 3, 3, 3]
    assert [r.persistent for r in out] == [False, False, False, True, False, False, True]


def test_episodes_and_notifications(spark):
    rows = spark.createDataFrame([(1, t, 0) for t in hours(0, 3, 6)], "tag int, ts timestamp_ntz, y int")
    out = timeseries.notifications(timeseries.alert_episodes(rows, ["tag"], "ts", ["ts"], "y", 2), ["tag"], 5).orderBy("start").collect()
    assert [r.sent for r in out] == [True, False, True]


def test_asof_join_takes_the_strictly_next_event(spark):
    left = spark.createDataFrame([(1, t) for t in hours(0, 1, 2, 3)], "tag int, ts timestamp_ntz")
    right = spark.createDataFrame([(1, hours(2)[0], "x")], "tag int, at timestamp_ntz, name string")
    out = timeseries.asof_join(left, right, "tag", "ts", "at", "forward", False, ["name"]).orderBy("ts").collect()
    assert [r.asof_name for r in out] == ["x", "x", None, None]


def test_labels_are_null_in_recovery_and_until_known(spark):
    day = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    readings = spark.createDataFrame([(i, 1, day(d)) for i, d in enumerate((0, 4, 10, 45, 58))], "event_id long, tag int, ts timestamp_ntz")
    incidents = spark.createDataFrame([(1, 1, day(8), True), (1, 2, day(50), False)], "tag int, incident_seq int, failure_date timestamp_ntz, is_source_rca boolean")
    out = labels.failure_labels(readings, incidents).orderBy("ts").collect()
    assert [r.failure_within_7d for r in out] == [0, 1, None, 1, None]
    assert [r.label_source for r in out] == ["rca_document", "rca_document", "incident_history", "incident_history", "no_observed_future_event"]


def test_cooldown_suppresses_other_ids_only(spark):
    d = dt.date(2026, 10, 4)
    payload = spark.createDataFrame([("A", 1, d)], "alert_id string, tag int, predicted_at date")
    other = spark.createDataFrame([("B", 1, d - dt.timedelta(days=1))], payload.schema)
    assert risk.cooldown_filter(payload, other).count() == 0
    assert risk.cooldown_filter(payload, payload).count() == 1


def test_average_precision_with_ties(spark):
    rows = spark.createDataFrame([(0.9, 1), (0.9, 0), (0.5, 1), (0.1, 0)], "s double, y int")
    assert metrics.average_precision(rows, [], "y", "s").first()[0] == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3)
    assert metrics.roc_auc(rows, [], "y", "s").first()[0] == pytest.approx(0.625)


def test_calendar_fills_gaps_on_a_line(spark):
    rows = spark.createDataFrame([(1, dt.date(2024, 1, 1), 1.0), (1, dt.date(2024, 1, 4), 4.0)], "k int, day date, y double")
    assert [r.y for r in forecast.on_calendar(rows, "k", "day", "y").orderBy("day").collect()] == [1.0, 2.0, 3.0, 4.0]


def test_sessions_agree_with_episodes_in_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, t) for t in hours(0, 24, 49)], "tag int, ts timestamp_ntz").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = flows.episodes(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("sessions").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(120)
    assert sorted(r.alerts for r in spark.sql("SELECT * FROM sessions").collect()) == [1, 2]


def test_release_writer_adds_each_row_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    write = flows.release_writer(str(tmp_path / "out"), ["id"])
    write(rows, 0)
    write(rows.union(spark.createDataFrame([(3, "c")], rows.schema)), 1)
    write(rows, 1)
    write(rows.union(spark.createDataFrame([(3, "c")], rows.schema)), 1)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


CURVE = "threshold double, precision double, event_recall double, median_lead_days double, false_days_per_month double, false_episodes_per_month double"
MANY = 1e308


def by_hand(rows, least_recall, least_lead, days=None, episodes=None, metric="days"):
    """The choice by its definition: a plain sort of tuples."""
    judged = []
    for threshold, precision, recall, lead, d, e in rows:
        recall, lead, d, e = recall or 0.0, lead or 0.0, MANY if d is None else d, MANY if e is None else e
        safe = recall >= least_recall and lead >= least_lead
        excess = sum(max(0.0, x - most) / most for x, most in ((d, days), (e, episodes)) if most is not None and x > most)
        quiet = all(x <= most for x, most in ((d, days), (e, episodes)) if most is not None)
        short = max(0.0, least_recall - recall) / least_recall + max(0.0, least_lead - lead) / max(least_lead, 1.0)
        noise = (d, e) if metric == "days" else (e, d)
        if safe and quiet:
            key = (0, *noise, -precision, -recall, -lead, -threshold)
        elif safe:
            key = (1, excess, *noise, -precision, -recall, -threshold)
        else:
            key = (2, short, -recall, *noise, -precision, -threshold)
        judged.append((tuple(round(k, 9) if abs(k) < 1e300 else k for k in key), threshold, safe, quiet))
    return min(judged, default=None)


@pytest.mark.parametrize("seed", range(12))
def test_threshold_is_the_one_chosen_by_hand(spark, seed):
    rng = random.Random(seed)
    some = lambda *values: rng.choice(values)
    # Few distinct values, so that most keys tie somewhere; nulls in all that can be missing.
    rows = [(t / 16, some(0.25, 0.5), some(None, 0.125, 0.375, 0.625), some(None, 1.5, 6.5, 11.0), some(None, 0.5, 1.75, 4.5), some(None, 0.0, 0.625)) for t in rng.sample(range(1, 16), 7)]
    curve = spark.createDataFrame(rows, CURVE)
    for limits in ((0.375, 1.5, 1.75, None, "days"), (0.125, 6.5, 0.5, 0.625, "episodes"), (0.625, 11.0, None, None, "days")):
        key, threshold, safe, quiet = by_hand(rows, *limits)
        r = metrics.select_threshold(curve, *limits).first()
        assert (r.threshold, r.events_and_lead_met, r.false_alert_limit_met, r.selection_basis) == (threshold, safe, quiet, metrics.BASES[key[0]]), limits
    capped = [x for x in rows if x[0] <= 0.5]
    r = metrics.select_threshold(curve, 0.375, 1.5, 1.75, cap=0.5).first()
    assert (r.threshold if r else None) == (by_hand(capped, 0.375, 1.5, 1.75)[1] if capped else None)


def test_threshold_without_a_rate_of_episodes(spark):
    curve = spark.createDataFrame([(0.25, 0.5, 0.375, 2.0, 1.0, 0.125)], CURVE).drop("false_episodes_per_month")
    assert metrics.select_threshold(curve, 0.25, 1.0, 2.0).first().limits_met
    for wrong in ({"max_false_episodes": 0.5}, {"metric": "alarms"}):
        with pytest.raises(ValueError):
            metrics.select_threshold(curve, **wrong)


def test_curve_follows_persistent_alerts(spark):
    """One entity, hourly: scores pinned with their alerts at 0.5 (the fourth and the seventh row)."""
    day = dt.datetime(2026, 1, 1)
    rows = [(i, 1, t, s, int(i >= 5), day + dt.timedelta(days=3), 3 - i / 24) for i, (t, s) in enumerate(zip(hours(*range(7)), (0.9, 0.1, 0.8, 0.7, 0.1, 0.1, 0.9)))]
    scored = spark.createDataFrame(rows, "event_id long, tag int, ts timestamp_ntz, score double, y int, next_failure_date timestamp_ntz, days_to_next_failure double")
    out = {r.threshold: r for r in metrics.threshold_curve(scored, [0.05, 0.5, 0.85, 0.95]).collect()}
    assert (out[0.5].predicted, out[0.5].tp, out[0.5].false_rows, out[0.5].episodes, out[0.5].true_episodes, out[0.5].false_days) == (2, 1, 1, 1, 1, 1)
    assert (out[0.5].events, out[0.5].detected, out[0.5].median_lead_days, out[0.5].median_span_hours) == (1, 1, 3 - 3 / 24, 4.0)
    assert (out[0.05].predicted, out[0.85].predicted, out[0.95].predicted, out[0.95].event_recall, out[0.95].median_lead_days) == (5, 0, 0, 0.0, None)
    assert out[0.5].exposure_months == pytest.approx(1 / 30.4375)
    assert metrics.threshold_curve(scored.limit(0), [0.5]).first().predicted == 0


def test_running_sums_positions_and_quantiles_do_not_need_one_task(spark):
    rows = spark.range(20_000).select((F.pmod(F.hash("id"), F.lit(5003)) / 10.0).alias("s"), (F.col("id") % 3).alias("g"))
    counts = rows.groupBy("g", "s").agg(F.count("*").alias("n"))
    local = counts.toPandas().sort_values(["g", "s"], ascending=[True, False])
    local["cum_n"] = local.groupby("g")["n"].cumsum()
    got = ranks.running(counts, ["g"], "s", ["n"]).toPandas().sort_values(["g", "s"], ascending=[True, False])
    assert got["cum_n"].tolist() == local["cum_n"].tolist() and set(got["all_n"]) == set(local.groupby("g")["n"].sum())
    points = [0.0, 0.1, 0.333, 0.5, 0.9999, 1.0]
    assert ranks.quantiles(rows, "s", points) == pytest.approx(rows.toPandas()["s"].quantile(points).tolist())
    placed = ranks.position(rows.withColumn("id", F.monotonically_increasing_id()), F.col("s"), [F.col("id")], "place").orderBy("place").collect()
    assert [r.place for r in placed] == list(range(1, 20_001)) and all((a.s, -a.id) > (b.s, -b.id) for a, b in zip(placed, placed[1:]))
    assert ranks.quantiles(rows.limit(0), "s", [0.5]) == [None]


def test_held_out_entities_do_not_train(spark):
    rows = [(tag, t, t + dt.timedelta(hours=5), i % 2) for tag in (1, 2) for i, t in enumerate(hours(*range(0, 24 * 20, 6)))]
    df = spark.createDataFrame(rows, "tag int, ts timestamp_ntz, next_failure_date timestamp_ntz, y int")
    out = labels.split_candidates(df, "ts", "y", 1, {"a": (0.5, 0.3)}, (1, 1, 1), F.col("tag") == 1).first()
    assert (out.train_rows, out.validation_rows, out.test_rows, out.rejection) == (36, 40, 32, None)
    folds = labels.rolling_folds(df, "ts", "y", F.lit(hours(24 * 16)[0]).cast("timestamp_ntz"), 1, least=(15, 3)).orderBy("fold").collect()
    assert [r.train_rows for r in folds] == [52, 72, 92] and [r.validation_rows for r in folds] == [12, 12, 20]
    assert folds[0].rejection is None
