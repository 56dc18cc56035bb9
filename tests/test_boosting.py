"""Trees grown from packed rows are Spark's own, whatever the order of rows."""

import datetime as dt

import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from fleetlens.operators import boosting, hardening, models
from fleetlens.sources import store

COLS = ["a", "b", "one", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    """Few values in each column, so that Spark tries all of them as well."""
    h = lambda k, n: F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(n))
    df = spark.range(3000).select("id", (h("a", 30) / 3).alias("a"), h("b", 7).cast("double").alias("b"), F.lit(1.0).alias("one"), h("c", 25).cast("double").alias("c"))
    df = df.withColumn("y", (F.col("a") + F.col("b") + h("e", 9) > 12).cast("int")).withColumn("t", F.col("a") * F.col("b") + h("f", 5))
    return df.withColumn("w", F.when(F.col("y") == 1, 1.7).otherwise(0.6)).persist()


@pytest.mark.parametrize("logistic", [True, False])
def test_trees_are_those_of_spark(rows, logistic):
    vector = VectorAssembler(inputCols=COLS, outputCol="v").transform(rows)
    learner = GBTClassifier(featuresCol="v", labelCol="y", weightCol="w", maxIter=6, stepSize=0.3, maxDepth=4, seed=7) if logistic else GBTRegressor(featuresCol="v", labelCol="t", maxIter=6, stepSize=0.3, maxDepth=4, seed=7)
    spark_s = vector_to_array("probability")[1] if logistic else F.col("prediction")
    trees = boosting.fit(rows, COLS, "y" if logistic else "t", "w" if logistic else None, logistic, 6, 0.3)
    raw = boosting.raw_score(trees, [F.col(c) for c in COLS])
    out = learner.fit(vector).transform(vector).withColumn("raw", raw).select(spark_s.alias("s"), (1 / (1 + F.exp(-2 * F.col("raw"))) if logistic else F.col("raw")).alias("own"))
    r = out.agg(F.max(F.abs(F.col("s") - F.col("own"))).alias("d"), F.stddev("s").alias("sd")).first()
    assert r.d < 1e-9 and r.sd > 0.1


def test_a_lineage_cut_changes_nothing(rows, monkeypatch):
    whole = boosting.fit(rows, COLS, "y", "w", True, 4)
    monkeypatch.setattr(boosting, "CUT", 1)
    assert boosting.fit(rows, COLS, "y", "w", True, 4) == whole


def test_values_that_few_rows_hold_are_tried(spark):
    """Spark looks for splits in 10,000 of the rows; a value that 8 of 400,000 hold was mostly not tried."""
    df = spark.range(400_000).select((F.col("id") % 50_000 == 7).cast("double").alias("x"), (F.col("id") % 97).cast("double").alias("z"), (F.col("id") % 50_000 == 7).cast("int").alias("y"))
    for n in (3, 8):
        model = hardening.boosted(df.repartition(n, "z"), ["x", "z"], "y", 1, iterations=3)
        found = {r.y: (r.low, r.high) for r in model.score(df).groupBy("y").agg(F.min("score").alias("low"), F.max("score").alias("high")).collect()}
        assert found[1][0] > 0.8 and found[0][1] < 0.2


def test_rows_without_a_split_get_the_mean(spark):
    df = spark.range(40).select(F.lit(3.0).alias("x"), (F.col("id") % 4).cast("double").alias("t"))
    trees = boosting.fit(df, ["x"], "t", None, False, 2)
    assert {r[0] for r in df.select(boosting.raw_score(trees, [F.col("x")])).collect()} == {1.5}


def test_scores_of_boosted_trees_hang_on_rare_values_too(spark):
    """as F23, where nulls are flagged."""
    rare = F.col("id") % 50_000 == 7
    df = spark.range(400_000).select(F.when(rare, 1.0).otherwise(F.when(F.col("id") % 3 > 0, 0.0)).alias("x"), rare.cast("int").alias("y"))
    for n in (3, 8):
        out = models.boosted_scores(df.repartition(n), df, ["x"], "y", iterations=3)
        found = {r.y: (r.low, r.high) for r in out.groupBy("y").agg(F.min("score").alias("low"), F.max("score").alias("high")).collect()}
        assert out.columns == ["x", "y", "score"] and found[1][0] > 0.8 and found[0][1] < 0.2


def test_forecast_makes_its_lags_once(spark):
    """each pass before the trees went through the windows again."""
    days = spark.createDataFrame([(k, dt.date(2024, 1, 1) + dt.timedelta(days=i), 20.0 * k + (i % 7)) for k in (1, 2) for i in range(60)], "k int, day date, y double")
    before = len(store._made.get(spark.sparkContext.applicationId, []))
    out = models.boosted_forecast(days, "k", "day", "y", 2, iterations=4)
    assert len(store._made[spark.sparkContext.applicationId]) == before + 1
    assert sorted((r.k, r.step) for r in out.collect()) == [(1, 1), (1, 2), (2, 1), (2, 2)]
