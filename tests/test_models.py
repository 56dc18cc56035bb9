"""Pinned cases of fits, exact intervals and attributions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleetlens.functions.exact import clopper_pearson, poisson_interval
from fleetlens.operators import models
from fleetlens.operators.metrics import cluster_bootstrap, cluster_draws, roc_auc
from fleetlens.plans import catalog, fitted, modelling

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in fitted.OPERATORS.items() if sql is None and n not in ("ml2_boosted_trees", "ml4_association", "fc3_boosted_forecast")))
def test_fitted_query_returns_rows(spark, name):
    assert catalog.queries()[name](spark, SF).limit(1).count() == 1


def test_exact_share_brackets_the_extremes(spark):
    rows = spark.createDataFrame([(10, 10), (0, 5), (0, 0), (5, 10)], "k long, n long").withColumn("i", clopper_pearson("k", "n"))
    found = {(r.k, r.n): r.i for r in rows.collect()}
    assert found[10, 10].lower == pytest.approx(0.6915, abs=1e-4) and found[10, 10].upper == 1
    assert found[0, 5].lower == 0 and found[0, 5].upper == pytest.approx(0.5218, abs=1e-4)
    assert found[5, 10].lower == pytest.approx(0.1871, abs=1e-4) and found[5, 10].upper == pytest.approx(0.8129, abs=1e-4)
    assert found[0, 0].lower is None or found[0, 0].lower != found[0, 0].lower


def test_exact_rate_brackets_the_rate(spark):
    r = spark.createDataFrame([(4, 2.0)], "k long, t double").select(poisson_interval("k", "t").alias("i")).first().i
    assert r.lower == pytest.approx(1.0899 / 2, abs=1e-4) and r.upper == pytest.approx(10.2416 / 2, abs=1e-4)


def test_attribution_of_a_linear_score_adds_up(spark):
    target = spark.createDataFrame([(1, 1.0, 2.0)], "k int, a double, b double")
    base = spark.createDataFrame([(0.0, 0.0)], "a double, b double")
    out = {r.feature: (r.value, r["rank"]) for r in models.permutation_attribution(target, "k", ["a", "b"], base, lambda v: v[0] + v[1]).collect()}
    assert out["a"][0] == pytest.approx(1) and out["b"][0] == pytest.approx(2)
    assert (out["a"][1], out["b"][1]) == (2, 1)


def test_champion_keeps_the_baseline_without_enough_wins(spark):
    rows = [(1, "seasonal_naive", f, 10.0) for f in range(3)] + [(1, "ridge", 0, 1.0), (1, "ridge", 1, 11.0), (1, "ridge", 2, 11.0)]
    rows += [(2, "seasonal_naive", f, 10.0) for f in range(3)] + [(2, "ridge", 0, 5.0), (2, "ridge", 1, 5.0), (2, "ridge", 2, 11.0)]
    out = {r.k: r.method for r in models.champion(spark.createDataFrame(rows, "k int, method string, fold int, mae double"), "k").collect()}
    assert out == {1: "seasonal_naive", 2: "ridge"}


def test_ridge_follows_a_season_and_its_band_is_ordered(spark):
    days = [(1, dt.date(2024, 1, 1) + dt.timedelta(days=i), 10.0 + i % 7) for i in range(70)]
    out = models.ridge_forecast(spark.createDataFrame(days, "k int, day date, y double"), "k", "day", "y").orderBy("step").collect()
    assert all(0 <= r.lower <= r.forecast <= r.upper for r in out)
    assert [round(r.forecast) for r in out] == [10 + i % 7 for i in range(7)]


def test_isotonic_scores_never_fall(spark):
    rows = spark.range(2000).select(((F.col("id") * 7919) % 1000 / 1000).alias("score")).withColumn("y", (F.col("score") * F.col("score") > F.pmod(F.hash("score"), F.lit(1000)) / 1000).cast("int"))
    out = [r.calibrated for r in models.isotonic_scores(rows, rows, "y", "score").orderBy("score").collect()]
    assert out == sorted(out) and 0 <= out[0] and out[-1] <= 1


def test_logistic_fit_finds_the_direction(spark):
    rows = spark.range(400).select((F.col("id") % 20).cast("double").alias("x"), ((F.col("id") % 20) >= 10).cast("int").alias("y"))
    out = models.association(rows, ["x"], "y").first()
    assert out.auc == pytest.approx(1) and out.coefficient > 0 and out.strength == "strong"
    assert models.association(rows.limit(5), ["x"], "y").count() == 0


def test_boosted_trees_and_association_on_the_given_events(spark, monkeypatch):
    """Of the queries that are too slow for all their iterations here: a few of them, and figures that must hold."""
    rows = fitted._features(spark, SF)
    scored = models.boosted_scores(rows.withColumn("y", (F.col("feed_rate") > 60).cast("int")), rows.withColumn("y", (F.col("feed_rate") > 60).cast("int")), fitted.SIGNALS, "y", iterations=5)
    assert roc_auc(scored, [], "y", "score").first()[0] > 0.99
    assert scored.where("score < 0 OR score > 1 OR score IS NULL").count() == 0 and scored.count() == rows.count()
    found = {r.feature: r for r in models.association(rows, fitted.SIGNALS[:2], "y").collect()}
    assert set(found) == {"feed_rate", "hour_of_day"} and all(0.3 < r.auc < 0.7 and r.n > 100 for r in found.values())


def test_fitted_queries_hold_what_they_promise(spark):
    found = catalog.queries()
    a = found["exp1_attribution"](spark, SF).groupBy("tag").agg(F.count("*").alias("n"), F.max("rank").alias("r")).collect()
    assert a and all(r.n == r.r == len(modelling.FEATURES) for r in a)
    band = found["fc8_risk_band"](spark, SF)
    assert band.where("risk < 0 OR risk > 1 OR p10 > p90").count() == 0
    back = found["fc7_rolling_backtest"](spark, SF)
    assert {r.fold for r in back.select("fold").distinct().collect()} == {0, 1, 2} and back.where("mae < 0 OR isnan(mae)").count() == 0
    i = found["sta4_episode_intervals"](spark, SF).first()
    assert 0 <= i.event_lower <= i.detected / max(1, i.events) <= i.event_upper <= 1 and i.rate_lower <= i.false_episodes / i.exposure_months <= i.rate_upper
    s = found["sta7_isotonic"](spark, SF).agg(F.min("calibrated"), F.max("calibrated")).first()
    assert 0 <= s[0] <= s[1] <= 1


def test_boosted_forecast_follows_the_series(spark):
    days = [(k, dt.date(2024, 1, 1) + dt.timedelta(days=i), 20.0 * k + (i % 7)) for k in (1, 2, 3) for i in range(90)]
    out = models.boosted_forecast(spark.createDataFrame(days, "k int, day date, y double"), "k", "day", "y", 3, iterations=20).collect()
    assert len(out) == 9 and all(abs(r.forecast - 20 * r.k - 3) < 5 for r in out)


def test_bootstrap_pairs_two_scores(spark):
    """A score that knows the outcome against one that does not; weights by brute force."""
    rows = [(tag, i % 3 == 0, (i % 3 == 0) * 0.5 + (i * 7 % 10) / 20, (i * 13 % 17) / 17) for tag in range(6) for i in range(tag, tag + 20)]
    df = spark.createDataFrame([(t, int(y), a, b) for t, y, a, b in rows], "tag int, y int, a double, b double")
    out = {r["name"]: r for r in cluster_bootstrap(df, "tag", "y", ["a", "b"], 40).collect()}
    assert out["a"].draws == 40 and out["a"].mean > out["b"].mean and out["difference"].share_better == 1.0
    draws = {r.tag: dict(zip(r.iteration, r.times)) for r in cluster_draws(df.select("tag").distinct(), "tag", 40).collect()}
    aps = []
    for k in range(40):
        w = [(x[3], x[1], draws.get(x[0], {}).get(k, 0)) for x in rows]
        total, ap = sum(y * m for _, y, m in w), 0.0
        for s in {s for s, _, _ in w}:
            above = [(y, m) for t, y, m in w if t >= s]
            ap += sum(y * m for t, y, m in w if t == s) * sum(y * m for y, m in above) / max(1, sum(m for _, m in above))
        aps.append(ap / total)
    assert out["b"].mean == pytest.approx(sum(aps) / 40)
