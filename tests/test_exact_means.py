"""Means of a week that lie on a limit, whatever the order of their readings."""

import datetime as dt
import math
import random

from fleetlens.plans import adapters, history


def events(spark, tmp_path, groups):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), tag, "click", v, "{}") for tag, values in groups.items() for i, v in enumerate(values)]
    random.Random(3).shuffle(rows)
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").repartition(7).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def on(limit, rng):
    cents = [rng.randrange(1, 2 * limit * 100) for _ in range(12)]
    while not 0 < (last := limit * 1300 - sum(cents)) < 100_000:
        cents = [rng.randrange(1, 2 * limit * 100) for _ in range(12)]
    return [c / 100 for c in (*cents, last)]


def test_means_on_a_limit_reach_it(spark, tmp_path):
    rng = random.Random(5)
    groups = {tag: on(60 if tag % 2 else 80, rng) for tag in range(400)}
    root = events(spark, tmp_path, groups)
    found = {r.tag: (r.parameter_value, r.health_status) for r in adapters.frame(spark, root, "condition_weekly").collect()}
    assert found == {tag: (60.0, "ALARM") if tag % 2 else (80.0, "TRIP") for tag in groups}
    slots = adapters.run(spark, root, adapters.whatever_order(history.CONDITION, *history.ADDED)).collect()
    assert {r.tag: (r.parameter_value_1 + 45, r.sun_feed_rate) for r in slots} == {tag: (60.0, 60.0) if tag % 2 else (80.0, 80.0) for tag in groups}


def test_means_of_values_beyond_decimals(spark, tmp_path):
    root = events(spark, tmp_path, {1: [1e300, 2e300], 2: [float("nan"), 1.0], 3: [None, None], 4: [None, 30.0, 31.0], 5: [float("inf"), 1.0]})
    found = {r.tag: (r.parameter_value, r.health_status) for r in adapters.frame(spark, root, "condition_weekly").collect()}
    assert math.isclose(found[1][0], 1.5e300) and found[1][1] == "TRIP"
    assert math.isnan(found[2][0]) and found[3] == (None, "NORMAL") and found[4] == (30.5, "NORMAL") and found[5] == (math.inf, "TRIP")
