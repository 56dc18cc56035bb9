"""The bootstrap over many small ranges of scores and scores of many rows."""

import random

import pytest

from fleetlens.operators import metrics


def test_ranges_and_frequent_scores_change_nothing(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(tag, rng.randrange(2), rng.random(), rng.choice([None, 1.0, 2.0, 3.0])) for tag in range(40) for _ in range(12)]
    df = spark.createDataFrame(rows, "tag int, y int, a double, b double").persist()
    whole = {r["name"]: r for r in metrics.cluster_bootstrap(df, "tag", "y", ["a", "b"], 30).collect()}
    monkeypatch.setattr(metrics, "IN_RANGE", 2)
    monkeypatch.setattr(metrics, "OF_SCORE", 3)
    monkeypatch.setattr(metrics, "PICKS", 200)
    cut = {r["name"]: r for r in metrics.cluster_bootstrap(df, "tag", "y", ["a", "b"], 30).collect()}
    for name in ("a", "b", "difference"):
        assert cut[name].draws == whole[name].draws == 30
        assert [cut[name][c] for c in ("mean", "lower", "upper")] == pytest.approx([whole[name][c] for c in ("mean", "lower", "upper")])


def test_draws_are_dealt_to_tasks_by_their_number(spark, monkeypatch):
    clusters = spark.range(100).withColumnRenamed("id", "tag")
    plain = {r.tag: (r.iteration, r.times) for r in metrics.cluster_draws(clusters, "tag", 40).collect()}
    monkeypatch.setattr(metrics, "PICKS", 500)
    draws = metrics.cluster_draws(clusters, "tag", 40)
    assert {r.tag: dict(zip(r.iteration, r.times)) for r in draws.collect()} == {t: dict(zip(*d)) for t, d in plain.items()}
    assert draws._jdf.queryExecution().toString().count("hashpartitioning(") and "REPARTITION_BY_NUM, [plan_id=" in draws._jdf.queryExecution().executedPlan().toString()


def test_draws_are_no_rows_and_slices_change_nothing(spark, monkeypatch):
    """each row became a row for each of its draws; only frequent scores do."""
    rng = random.Random(6)
    rows = [(float(rng.randrange(15)) if k % 9 else None, rng.randrange(1, 4), rng.randrange(2), *zip(*[(i, rng.randrange(1, 4)) for i in range(8) if rng.random() < 0.6] or [(0, 1)])) for k in range(90)]
    cells = spark.createDataFrame(rows, "score double, n long, p long, iteration array<smallint>, times array<smallint>").persist()
    expected = {}
    for i in range(8):
        mine = [(s, n * times[which.index(i)], p * times[which.index(i)]) for s, n, p, which, times in rows if i in which]
        at = total = positive = 0
        for score in sorted({s for s, _, _ in mine}, key=lambda s: (s is None, -(s or 0))):
            p = sum(x[2] for x in mine if x[0] == score)
            total, positive = total + sum(x[1] for x in mine if x[0] == score), positive + p
            at += p * positive / total
        expected[i] = pytest.approx(at / positive)
    for size, often in ((1000, 1000), (3, 1000), (3, 6)):
        monkeypatch.setattr(metrics, "AT_ONCE", size)
        monkeypatch.setattr(metrics, "OF_SCORE", often)
        found = metrics.drawn_precision(cells, 8)
        assert {r.iteration: r.ap for r in found.collect()} == expected
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate explode(") == 1
