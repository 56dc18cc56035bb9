"""Exact intervals of large counts, fits side by side, attributions dealt to tasks."""

import threading
import time

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetlens.functions import exact
from fleetlens.operators import hardening, metrics, models, stress
from fleetlens.plans import fitted
from fleetlens.sources import store


def test_intervals_of_large_counts_take_terms_by_the_root_of_the_count():
    """a tail was summed from 0 up, at each of 140 steps."""
    start, k = time.time(), np.array([1e6, 1e7])
    top = k + 10 * np.sqrt(k + 1) + 20
    low = exact._solve(lambda m: 1 - exact.poisson_tail(m, k - 1) >= 0.025, np.zeros(2), top)
    high = exact._solve(lambda m: exact.poisson_tail(m, k) <= 0.025, np.zeros(2), top)
    assert time.time() - start < 60
    # Wilson and Hilferty's approximation is good to the seventh digit here.
    wilson = lambda n, z: n * (1 - 1 / (9 * n) + z / (3 * np.sqrt(n))) ** 3
    assert low == pytest.approx(wilson(k, -1.959964), rel=1e-7) and high == pytest.approx(wilson(k + 1, 1.959964), rel=1e-7)


def test_a_tail_is_the_sum_of_its_terms():
    k = np.array([-1.0, 0, 0, 3, 3, 40, 40, 40])
    m = np.array([2.0, 2, 1e-9, 0.5, 9, 20, 40, 90])
    whole = [sum(np.exp(i * np.log(b) - b - sum(np.log(np.arange(1, i + 1)))) for i in range(int(a) + 1)) for a, b in zip(k, m)]
    assert exact.poisson_tail(m, k) == pytest.approx(whole, rel=1e-12, abs=1e-300)


def test_attribution_scores_a_small_table_of_targets_in_many_tasks(spark):
    """the latest rows are few bytes, so all their draws and steps were scored in one task."""
    rows = spark.range(400).select((F.col("id") % 200).alias("k"), "id", *[(F.col("id") % n).cast("double").alias(c) for n, c in ((7, "a"), (5, "b"))])
    last = rows.withColumn("_i", F.row_number().over(Window.partitionBy("k").orderBy(F.col("id").desc()))).where("_i = 1").select("k", "a", "b")
    score = lambda df: df.withColumn("task", F.spark_partition_id()).transform(lambda d: seen.append(d) or d).withColumn("score", F.col("a") * F.col("b"))
    seen = []
    found = stress.attribution(last, "k", ["a", "b"], rows, score, draws=6).collect()
    assert len(found) == 400 and max(r.error for r in found) < 1e-9
    assert seen[0].select("task").distinct().count() > 1


def test_fits_beside_each_other_and_one_count_of_scores(spark):
    """each fit computed its rows for each of its passes, waited for the others, and counted its scores twice."""
    df = spark.createDataFrame([(i % 10 / 10, i % 3 % 2 if i % 11 else None) for i in range(300)], "score double, y int")
    one = metrics.f_beta_and_precision(df.dropna(), "y", "score").first()
    assert (one.threshold, one.f_beta) == tuple(metrics.best_f_beta(df.dropna(), [], "y", "score").first()[:2])
    assert one.average_precision == pytest.approx(metrics.average_precision(df.dropna(), [], "y", "score").first().average_precision, rel=1e-12)
    rows, held, n = models.fit_rows(df, ["score"], "y")
    assert n == 300 and held.is_cached and rows.columns == ["score", "y", "weight"]
    assert sorted(map(tuple, rows.collect())) == sorted((r.score, r.y, r.weight) for r in models.class_weights(df, "y").collect())
    held.unpersist()
    both = threading.Barrier(2, timeout=30)
    assert hardening.side_by_side([lambda k=k: both.wait() * 0 + spark.range(k).count() for k in (3, 5)]) == [3, 5]


def test_risk_model_makes_its_features_once(spark):
    """every pass of the fit went through the shuffles of the as-of join again."""
    before = len(store._made.get(spark.sparkContext.applicationId, []))
    fitted._risk_model(spark, "/root/testdata/sf0.001")
    assert len(store._made[spark.sparkContext.applicationId]) == before + 1
