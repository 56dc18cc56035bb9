"""Hardening, split choice, saved models, stress and attribution on small pinned cases."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import hardening, stress

START = dt.datetime(2024, 1, 1)


def at(hours):
    return START + dt.timedelta(hours=hours)


@pytest.fixture(scope="module")
def rows(spark):
    """Forty entities, hourly for 20 days; one fails every five days, and x rises in the day before."""
    out = []
    for tag in range(40):
        shift = (tag % 5) * 24
        for h in range(480):
            next_ = ((h + shift) // 120 + 1) * 120 - shift
            days = (next_ - h) / 24
            out.append((tag * 1000 + h, tag, at(h), (1.0 if days <= 1 else 0.0) + ((tag * 7 + h * 13) % 100) / 250, None if h % 50 == 0 else float((h * 31 + tag) % 97), int(days <= 1) if h < 456 else None, at(next_), days))
    schema = "event_id long, tag int, ts timestamp_ntz, x double, z double, y int, next_failure_date timestamp_ntz, days_to_next_failure double"
    return spark.createDataFrame(out, schema).persist()


COLS = ["x", "z"]


def fit(train):
    return hardening.logistic(train, COLS, "y", 1).score


@pytest.fixture(scope="module")
def scored(rows):
    start = F.lit(at(360)).cast("timestamp_ntz")
    return hardening.out_of_fold(rows, fit, start, 1, held_out=F.col("tag") == 0).persist()


def test_no_row_is_scored_by_a_model_that_saw_it(scored):
    found = scored.groupBy("split", "fold").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("trained_before").alias("cut"), F.countDistinct("trained_before").alias("cuts")).orderBy("split", "fold").collect()
    assert [(r.split, r.fold) for r in found] == [("rolling_validation", 1), ("rolling_validation", 2), ("rolling_validation", 3), ("test", 0)]
    assert all(r.cuts == 1 and r.cut + dt.timedelta(days=1) <= r.first for r in found)
    assert scored.where("y IS NULL").count() == 0 and scored.groupBy("event_id").count().where("count > 1").count() == 0


def test_thresholds_come_from_rolling_validation_alone(scored):
    limits = {"min_event_recall": 0.3, "min_lead_days": 0.0, "max_false_days": 30.0}
    h = hardening.harden(scored, limits, limits | {"min_event_recall": 0.5}, strict=True, candidates=25)
    other = hardening.harden(scored.withColumn("score", F.when(F.col("split") == "test", 1 - F.col("score")).otherwise(F.col("score"))), limits, limits, candidates=25)
    assert h.action == other.action and h.warning <= h.action and h.release == "INSPECTION_PRIORITY_BASELINE"
    report = {r.split: r for r in hardening.hardening_report(h).collect()}
    assert set(report) == {"rolling_validation", "test"}
    for r in report.values():
        assert r.action_rows == r.tp + r.fp <= r.warning_rows and r.tp > 0 and r.tp / (r.tp + r.fp) > 0.8
    never = hardening.harden(scored, {"min_event_recall": 1.0, "min_lead_days": 99.0, "max_false_days": 0.0}, limits, strict=True, candidates=25)
    assert never.release == "EXPERIMENTAL"
    with pytest.raises(ValueError, match="no scores"):
        hardening.harden(scored.where("split = 'test'"), limits, limits)


def test_split_choice_takes_the_best_of_those_with_enough_events(rows):
    both = rows.withColumns({"y_1d": F.col("y"), "y_2d": F.when(F.col("y").isNotNull(), (F.col("days_to_next_failure") <= 2).cast("int"))})
    candidates = {"late": (0.6, 0.2), "early": (0.3, 0.4), "tiny": (0.97, 0.01)}
    blind = lambda train: lambda valid: valid.withColumn("score", F.lit(0.5))

    def either(train):
        """Knows the label only where it was trained on more than half of the days."""
        knows = train.agg(F.max("ts")).first()[0] > at(250)
        return lambda valid: valid.withColumn("score", F.col("y").cast("double")) if knows else blind(train)(valid)

    out = {r.candidate: r for r in hardening.search_splits(both, {1: either, 2: blind}, candidates=candidates, least=(5, 5, 5)).collect()}
    assert out["tiny"].status == "rejected_insufficient_events" and "1d: " in out["tiny"].rejection and out["tiny"].horizons == []
    assert out["late"].chosen and not out["early"].chosen and not out["tiny"].chosen
    assert [h.horizon_days for h in out["late"].horizons] == [1, 2] and out["late"].horizons[0].f1 == 1 and out["late"].horizons[0].false_rows == 0
    assert out["late"].mean_f1 == pytest.approx((1 + out["late"].horizons[1].f1) / 2) and out["late"].mean_f1 > out["early"].mean_f1


def test_a_saved_model_scores_as_before(spark, rows, tmp_path):
    model = hardening.boosted(rows.where("y IS NOT NULL AND event_id % 7 = 0"), COLS, "y", 1, iterations=3)
    model.action, model.release = 0.7, "INSPECTION_PRIORITY_BASELINE"
    for _ in range(2):  # an older one is replaced
        model.save(str(tmp_path / "m"))
    again = hardening.FailureModel.load(spark, str(tmp_path / "m"))
    assert (again.cols, again.horizon_days, again.action, again.warning, again.release) == (COLS, 1, 0.7, None, "INSPECTION_PRIORITY_BASELINE")
    part = rows.where("tag = 3")
    scores = lambda m: [r.score for r in m.score(part, key="event_id").orderBy("event_id").collect()]
    assert scores(model) == scores(again) and part.columns + ["score"] == again.score(part).columns
    with pytest.raises(ValueError, match="features are missing: z"):
        again.score(part.drop("z"))


@pytest.mark.parametrize("bad", [float("nan"), 1.5, -0.1, None, float("inf")])
def test_scores_that_are_no_probabilities_are_named(spark, bad):
    df = spark.createDataFrame([(3, 0.5), (2, bad), (9, bad), (1, 0.0)], "k int, s double")
    with pytest.raises(ValueError, match="s of k 2 is"):
        hardening.check_probabilities(df, "s", "k")
    with pytest.raises(Exception, match="s of k (2|9) is"):
        df.select(hardening.valid_probability("s", "k")).collect()
    good = df.where("k IN (1, 3)")
    assert hardening.check_probabilities(good, "s", "k").count() == 2 and good.select(hardening.valid_probability("s", "k")).count() == 2


WIDE = ["a", "a_lag_1h", "a_mean_12h", "a_std_12h", "b", "hour"]


def test_scenarios_touch_the_columns_of_their_kind(spark):
    kinds = {k: stress.touched(stress.Scenario("s", k, 0.1), WIDE, ("a", "b")) for k in ("noise", "outage", "dropout", "shift")}
    assert kinds == {"noise": ["a", "a_lag_1h", "a_mean_12h", "a_std_12h", "b"], "outage": ["a", "b"], "dropout": WIDE, "shift": ["a", "a_lag_1h", "a_mean_12h", "b"]}
    with pytest.raises(ValueError, match="scenario kind"):
        stress.touched(stress.Scenario("s", "fire"), WIDE, ("a",))
    df = spark.range(4000).select(F.col("id").alias("k"), *[F.lit(10.0).alias(c) for c in WIDE])
    run = lambda s, n=1: stress.perturbed(df.repartition(n), s, WIDE, ("a", "b"), ["k"]).orderBy("k").collect()
    noise = run(stress.Scenario("n", "noise", 0.05))
    assert noise == run(stress.Scenario("n", "noise", 0.05), 5)
    z = [(r.a / 10 - 1) / 0.05 for r in noise]
    assert abs(sum(z) / len(z)) < 0.06 and abs(math.sqrt(sum(v * v for v in z) / len(z)) - 1) < 0.05 and noise[0].hour == 10 and noise[0].a != noise[0].b
    dropped = [r.hour is None for r in run(stress.Scenario("d", "dropout", 0.1))]
    assert abs(sum(dropped) / len(dropped) - 0.1) < 0.02
    shifted, out = run(stress.Scenario("u", "shift", 0.1))[0], run(stress.Scenario("o", "outage"))[0]
    assert (shifted.a, shifted.a_lag_1h, shifted.a_std_12h, shifted.hour) == (11, 11, 10, 10) and (out.a, out.b, out.a_lag_1h) == (None, None, 10)


def test_stability_counts_what_is_kept_held_and_lost(spark):
    levels = {1: ("ACTION_NOW", "NORMAL"), 2: ("NORMAL", "ACTION_NOW"), 3: ("MONITOR", "DATA_QUALITY_REVIEW"), 4: ("PLAN_MAINTENANCE", "DATA_QUALITY_REVIEW"), 5: ("NORMAL", "NORMAL")}
    out = []
    for tag, pair in levels.items():
        for name, level in zip((stress.BASELINE, "s"), pair, strict=True):
            review = level == "DATA_QUALITY_REVIEW"
            out.append((name, tag, level, tag if name == "s" else 6 - tag, 0.5 if name == "s" else 0.4, "REVIEW" if review else "PASS", not review))
    df = spark.createDataFrame(out, "scenario string, tag int, level string, rank int, score_7d double, status string, publish_allowed boolean")
    r = stress.stability(df, {7: (0.6, 0.4)}).first()
    assert (r.n, r.retention, r.safe_retention, r.changed, r.urgent_lost, r.urgent_gained, r.unsafe_gained, r.reviews, r.urgent_held, r.unreviewed_changes) == (5, 0.2, 0.6, 4, 1, 1, 1, 2, 1, 2)
    assert r.rank_correlation == pytest.approx(-1) and r.mean_change_7d == pytest.approx(0.1) and not r.stable and not r.guardrail_passed


def test_attribution_of_any_scorer_adds_up(spark):
    target = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, None)], "k int, a double, b double")
    base = spark.createDataFrame([(0.0, 0.0)], "a double, b double")
    linear = lambda df: df.withColumn("score", F.col("a") + F.coalesce(F.col("b"), F.lit(5.0)))
    out = {(r.k, r.feature): r for r in stress.attribution(target, "k", ["a", "b"], base, linear, draws=6).collect()}
    assert {k: round(r.value, 12) for k, r in out.items()} == {(1, "a"): 1, (1, "b"): 2, (2, "a"): 3, (2, "b"): 5}
    assert all(r.base_value == 0 and r.error < 1e-12 for r in out.values()) and out[1, "a"].output == 3 and out[1, "b"]["rank"] == 1
    product = lambda df: df.withColumn("score", F.col("a") * F.coalesce(F.col("b"), F.lit(5.0)))
    mixed = stress.attribution(target, "k", ["a", "b"], spark.createDataFrame([(0.5, 1.0), (2.0, 0.0)], "a double, b double"), product)
    assert mixed.agg(F.max("error")).first()[0] < 1e-9
    table = {r.feature: r for r in stress.attribution_table(mixed, "k", target, base, ["a", "b"], {"a": "first"}, 2).where("k = 1").collect()}
    assert table["a"].feature_group == "first" and table["b"].feature_group == "other" and table["b"].feature_value == 2 and table["a"].reference_median == 0


def test_registered_model_queries(spark):
    from fleetlens.plans import catalog

    queries, sf = catalog.queries(), "/root/testdata/sf0.001"
    saved = queries["ml3_saved_models"](spark, sf).collect()
    assert saved and all(0 <= r.score_1d <= 1 and 0 <= r.score_3d <= 1 for r in saved)
    values = queries["exp1_attribution"](spark, sf).collect()
    assert len({r.tag for r in values}) * 12 == len(values) and max(r.error for r in values) < 1e-9
    stable = {r.scenario: r for r in queries["rob2_stability"](spark, sf).collect()}
    assert set(stable) == {s.name for s in stress.SCENARIOS} and all(r.safe_retention == 1 and r.guardrail_passed for r in stable.values())
    folds = queries["met10_rolling_scores"](spark, sf).collect()
    assert folds and all(r.trained_before + dt.timedelta(days=1) <= r.ts for r in folds)
