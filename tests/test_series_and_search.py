"""As-of and nearest rows, hour grids, facets, origins and retrieval against plain loops."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import forecast, origins, quality, retrieval, timeseries

START = dt.datetime(2024, 1, 1)


def test_forward_as_of_costs_what_backward_does(spark):
    n = 200_000
    hours = lambda k, c: F.timestamp_seconds(F.col("id") * 3600 * k).alias(c)
    left = spark.range(n).select(F.lit(1).alias("k"), hours(1, "ts"))
    right = spark.range(n // 50).select(F.lit(1).alias("k"), hours(50, "at"), "id")

    def run(direction):
        start = time.time()
        r = timeseries.asof_join(left, right, "k", "ts", "at", direction, False, ["id"]).agg(F.sum("asof_id"), F.count("asof_ts")).first()
        return time.time() - start, tuple(r)

    run("backward")
    (back, b), (ahead, a) = run("backward"), run("forward")
    assert b == (sum((h - 1) // 50 for h in range(1, n)), n - 1) and a == (sum(h // 50 + 1 for h in range(n - 50)), n - 50)
    assert ahead < 2 * back + 1


def test_rows_without_entity_or_time_match_nothing(spark):
    left = spark.createDataFrame([(None, 5), (1, None), (1, 5), (2, 5), (None, None)], "k int, ts int")
    right = spark.createDataFrame([(None, 6, 1), (1, 6, 2), (1, None, 3), (None, None, 4), (1, 6, 9)], "k int, at int, v int")
    for direction, ts in (("forward", 6), ("backward", None)):
        out = {(r.k, r.ts): (r.asof_ts, r.asof_v) for r in timeseries.asof_join(left, right, "k", "ts", "at", direction, False, ["v"]).collect()}
        assert len(out) == 5 and out[1, 5] == ((ts, 2) if ts else (None, None)) and all(v == (None, None) for k, v in out.items() if k != (1, 5))


def test_nearest_row_in_either_direction(spark):
    rng = random.Random(2)
    t = lambda m: START + dt.timedelta(minutes=m)
    left = [(i, rng.choice([1, 2, 3, None]), t(rng.randint(0, 400))) for i in range(200)] + [(900, 1, None)]
    right = [(rng.choice([1, 2, None]), t(rng.randint(0, 400) // 4 * 4), rng.randint(0, 9)) for _ in range(60)]
    got = {r.i: (r.nearest_ts, r.nearest_v) for r in timeseries.nearest_join(spark.createDataFrame(left, "i int, k int, ts timestamp_ntz"), spark.createDataFrame(right, "k int, at timestamp_ntz, v int"), "k", "ts", "at", ["v"], 600).collect()}
    for i, k, ts in left:
        near = [(abs((a - ts).total_seconds()), a, -v) for kk, a, v in right if kk == k and k is not None and ts is not None]
        best = min(near, default=None)
        assert got[i] == ((best[1], -best[2]) if best and best[0] <= 600 else (None, None)), i


def test_hour_grids_and_intervals(spark):
    h = lambda *n: [START + dt.timedelta(hours=x, minutes=7) for x in n]
    df = spark.createDataFrame([(1, t) for t in h(0, 1, 1, 2)] + [(2, t) for t in h(3, 6, 8)] + [(None, START), (3, None)], "k int, ts timestamp_ntz")
    out = {r.k: (r.expected, r.seen, r.missing, r.first_missing) for r in quality.hour_gaps(df, "k", "ts").collect()}
    assert out == {1: (3, 3, 0, None), 2: (6, 3, 3, START + dt.timedelta(hours=4))}
    fixed = {r.k: (r.expected, r.missing) for r in quality.hour_gaps(df, "k", "ts", F.lit(START), F.lit(START + dt.timedelta(hours=9))).collect()}
    assert fixed == {1: (10, 7), 2: (10, 7)}
    iv = spark.createDataFrame([(1, h(0)[0], 2.5), (1, h(2)[0], 1.0), (2, h(5)[0], 0.0), (2, None, 3.0), (3, h(9)[0], None)], "k int, at timestamp_ntz, n double")
    hours = quality.hours_expanded(iv, "k", "at", F.col("n"))
    assert sorted((r.k, r.hour.hour) for r in hours.collect()) == [(1, 0), (1, 1), (1, 2)]
    seen = df.where("k IS NOT NULL AND ts IS NOT NULL").select("k", F.date_trunc("hour", "ts").alias("hour"))
    assert {r.k: (r.both, r.left_only, r.right_only) for r in quality.reconciled(seen, hours, "k", "hour").collect()} == {1: (3, 0, 0), 2: (0, 3, 0)}


def test_facets_drop_until_stable(spark):
    rows = [("x", 1, "p"), ("x", 2, "q"), ("y", 3, "p"), ("y", 3, "r")]
    dim = spark.createDataFrame(rows, "a string, b int, c string")
    # 2 goes with q only, which is not chosen; without 2 nothing holds x, and without x only y and 3 are left.
    chosen, options = quality.facet_options(dim, {"a": ["x", "y"], "b": [2, 3], "c": ["p", "r"]})
    assert chosen == {"a": ["y"], "b": [3], "c": ["p", "r"]}
    assert {(r.field, r.choice): (r.chosen, r.n) for r in options.collect()} == {("a", "y"): (True, 2), ("b", "3"): (True, 2), ("c", "p"): (True, 1), ("c", "r"): (True, 1)}
    assert quality.facet_options(dim, {"a": ["none"], "b": []})[0] == {"a": [], "b": []}


@pytest.fixture(scope="module")
def days(spark):
    rng = random.Random(4)
    rows = [(k, dt.date(2024, 1, 1) + dt.timedelta(days=i), 50.0 + 10 * (i % 7) * (k == 1) + rng.random() * (30 if k == 2 else 1)) for k in (1, 2) for i in range(150)]
    return spark.createDataFrame(rows + [(3, dt.date(2024, 1, 1), 1.0)], "k int, day date, y double").persist()


def test_origins_are_rows_and_forecasts_know_nothing_after_them(spark, days):
    said = origins.backtest(days, "k", "day", "y", ("seasonal_naive", "last_value", "ridge"), folds=3, horizon=14, least=90).persist()
    spans = {(r.k, r.fold): r.training_days for r in said.select("k", "fold", "training_days").distinct().collect()}
    assert spans == {(k, f): 150 - (4 - f) * 14 for k in (1, 2) for f in (1, 2, 3)}
    assert said.count() == 2 * 3 * 3 * 14
    value = {(r.k, r.day): r.y for r in days.collect()}
    for r in said.where("method <> 'ridge'").collect():
        back = r.train_end if r.method == "last_value" else r.train_end + dt.timedelta(days=(r.step - 1) % 7 - 6)
        assert r.forecast == value[r.k, back] and r.actual == value[r.k, r.day] and r.day == r.train_end + dt.timedelta(days=r.step)
    first = lambda df: sorted(tuple(r) for r in df.where("fold = 1 AND method = 'ridge'").select("k", "step", "forecast", "train_end").collect())
    early = origins.backtest(days.where(F.col("day") <= F.date_add(F.lit(dt.date(2024, 1, 1)), 121)), "k", "day", "y", ("ridge",), folds=1, horizon=14, least=90)
    assert first(early) == first(said)
    e = {(r.k, r.method, r.fold): r for r in origins.errors(said, "k").collect()}
    rows = [r for r in said.collect() if (r.k, r.method, r.fold) == (1, "ridge", 2)]
    assert e[1, "ridge", 2].mae == pytest.approx(sum(abs(r.forecast - r.actual) for r in rows) / 14) and e[1, "ridge", 2].days == 14


def test_choice_needs_gain_and_wins(spark):
    wape = {("a", "ridge"): (5, 5, 12), ("a", "boosting"): (6, 6, 6), ("b", "ridge"): (1, 11, 11), ("b", "boosting"): (9.95, 9.95, 9.95), ("c", "ridge"): (None,) * 3}
    rows = [(k, m, f, 1.0, None if w is None else float(w), 0.5) for (k, m), v in wape.items() for f, w in enumerate(v)] + [(k, "seasonal_naive", f, 2.0, 10.0, 0.0) for k in "abc" for f in range(3)]
    out = {r.k: r for r in origins.choose(spark.createDataFrame(rows, "k string, method string, fold int, mae double, wape_pct double, bias double"), "k").collect()}
    assert out["a"].method == "boosting" and out["a"].reason == origins.BEATEN and out["a"].won == 1 and out["a"].gain_pct == pytest.approx(40)
    assert out["b"].method == out["c"].method == "seasonal_naive" and out["b"].reason == origins.RETAINED and out["b"].gain_pct == 0 and out["b"].wape_pct == 10


def test_artefacts_are_whole(spark, days):
    a = origins.artefacts(days.where("k < 3"), "k", "day", "y", horizon=7, methods=("seasonal_naive", "ridge"), folds=2, least=60)
    assert a.history.count() == 60 and a.metrics.count() == 2 and a.backtest.count() == 2 * 2 * 2 * 30
    p = a.prediction.collect()
    assert len(p) == 14 and all(0 <= r.lower <= r.forecast <= r.upper for r in p) and min(r.day for r in p) == dt.date(2024, 5, 30)


def test_calendar_guard_and_edges(spark):
    d = lambda n: dt.date(2024, 1, n)
    df = spark.createDataFrame([(1, d(1), 1.0), (1, d(2), None), (1, d(3), 3.0), (2, d(1), None), (2, d(2), 5.0), (2, d(9), 6.0), (None, d(1), 1.0), (1, None, 1.0)], "k int, day date, y double")
    out = {(r.k, r.day.day): (round(r.y, 6), r.filled) for r in forecast.on_calendar(df, "k", "day", "y").collect()}
    assert out[1, 2] == (2, True) and out[2, 1] == (5, True) and out[2, 3] == (round(5 + 1 / 7, 6), True) and len(out) == 12
    assert {r.k for r in forecast.on_calendar(df, "k", "day", "y", 0.5).collect()} == {1}
    assert {r.k: round(r.missing, 6) for r in forecast.missing_shares(df, "k", "day", "y").collect()} == {1: round(1 / 3, 6), 2: round(7 / 9, 6)}


def test_search_is_exact_and_touches_few_pairs(spark):
    rng = random.Random(9)
    common = [f"c{i}" for i in range(6)]
    texts = [" ".join(common + [f"r{rng.randint(0, 400)}" for _ in range(12)]) for _ in range(600)]
    texts += [texts[i].replace("c1", "d1") for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    t = retrieval.tfidf(docs, "id", "text").persist()
    vectors = {}
    for r in t.collect():
        vectors.setdefault(r.id, {})[r.term] = r.weight
    queries = [i for i in vectors if i % 10 == 0]
    got = {}
    for r in retrieval.cosine_topk(t.where("id % 10 = 0"), t, 3, 0.08).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    met = 0
    for q in queries:
        scores = {i: sum(w * v.get(term, 0) for term, w in vectors[q].items()) for i, v in vectors.items() if i != q}
        met += sum(s > 0 for s in scores.values())
        best = sorted((-round(s, 9), i) for i, s in scores.items() if s > 0)[:3]
        best = best if best and -best[0][0] >= 0.08 else []
        assert [(i, s) for _, i, s in sorted(got.get(q, []))] == [(i, pytest.approx(-s, abs=1e-8)) for s, i in best], q
    pairs, _ = retrieval.reached(t.where("id % 10 = 0"), t, 3)
    assert met == len(queries) * (len(texts) - 1) and pairs.count() < met / 4


def test_only_verified_cases_answer_and_only_gated_queries_ask(spark):
    slide = "case_no long, slide_no int, source_type string, title string, content string"
    ok, no = "real_rca_backed", "synthetic_support"
    slides = [(1, 1, ok, "t", "pump bearing wear"), (1, 2, ok, "t", "lubrication failed on the pump bearing"), (2, 1, ok, "t", "valve seat erosion"), (3, 1, no, "t", "pump bearing wear pump bearing"), (4, 1, ok, "t", None), (None, 1, ok, "t", "pump")]
    asks = [(10, "bearing lubrication", "MONITOR", "PASS"), (11, "bearing", "NORMAL", "PASS"), (12, "bearing", "MONITOR", "REVIEW"), (13, "unheard words", "ACTION_NOW", "PASS"), (1, "valve", "ACTION_NOW", "PASS"), (14, None, "MONITOR", "PASS")]
    out = retrieval.retrieve_cases(spark.createDataFrame(asks, "query_id long, text string, level string, quality string"), spark.createDataFrame(slides, slide)).collect()
    assert {(r.query_id, r["rank"], r.case_no, r.status) for r in out} == {(10, 1, 1, "VERIFIED_PRECEDENT"), (1, 1, 2, "VERIFIED_PRECEDENT")}
    (r,) = [r for r in out if r.query_id == 10]
    assert r.evidence_slide == 2 and r.slides == 2 and r.excerpt.startswith("lubrication") and r.evidence_score > 0


def test_readings_without_a_plant_fail_where_asked(spark):
    from fleetlens.operators import features

    r = spark.createDataFrame([(1, START, "ON", 2.0, 4.0), (9, START, "OFF", 1.0, 1.0)], "tag int, ts timestamp_ntz, run_status string, feed_rate double, power_kw double")
    e = spark.createDataFrame([(1, 5), (2, None)], "tag int, plant int")
    air = spark.createDataFrame([(5, START, 1.0, 30.0, 20.0, 3.0, 4.0, 10.0)], "plant int, ts timestamp_ntz, co2_ton double, nox_ppm double, sox_ppm double, voc_kg double, wastewater_m3 double, energy_kwh double")
    (row,) = features.plant_hours(r, e, air).collect()
    assert (row.plant, row.equipment, row.running, row.rate, row.nox, row.energy_per_rate, row.rate_lag_1h) == (5, 1, 1, 2, 30, 5, None)
    with pytest.raises(Exception, match="no plant for 9"):
        features.plant_hours(r, e, air, strict=True).collect()
