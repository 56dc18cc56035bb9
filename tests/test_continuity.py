"""Steps at the join, baselines, snapshots, manifests, slides and registries on small pinned cases."""

import datetime as dt
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.operators import continuity, models
from fleetlens.sources import documents

D0 = dt.datetime(2024, 1, 1)


def day(n, hour=0):
    return D0 + dt.timedelta(days=n, hours=hour)


def at(n):
    return F.lit(day(n)).cast("timestamp_ntz")


def series(spark, rows):
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, a double, b double")


def test_bucket_moves_begin_with_each_group_and_skip_empty_spans(spark):
    rows = [("x", day(3), 10.0, None), ("x", day(30), 20.0, 0.0), ("x", day(31), 33.0, 5.0), ("x", day(3 + 3 * 28), 66.0, 5.0), ("y", day(0), 1.0, 1.0), (None, day(0), 4.0, 1.0), (None, day(28), 2.0, 1.0), ("x", None, 9e9, 9e9)]
    out = {(r.k, r.signal, r.bucket): r for r in continuity.bucket_moves(series(spark, rows), ["k"], "ts", ["a", "b"]).collect()}
    assert out["x", "a", 0]["mean"] == 15.0 and out["x", "a", 0].move is None and out["x", "a", 0].start == dt.date(2024, 1, 4)
    assert out["x", "a", 1]["mean"] == 33.0 and out["x", "a", 1].move == pytest.approx(1.2) and out["x", "a", 1].start == dt.date(2024, 2, 1)
    assert out["x", "a", 3].move is None and ("x", "a", 2) not in out
    assert out["x", "b", 0]["mean"] == 0.0 and out["x", "b", 1].move is None
    assert out[None, "a", 1].move == 0.5
    assert continuity.bucket_moves(series(spark, []), ["k"], "ts", ["a", "b"]).count() == 0


def test_join_steps_against_numpy(spark):
    rng, rows, split = np.random.default_rng(5), [], 28 * 12
    for g in range(6):
        for n in range(split + 40):
            jump = 3.0 if n >= split and g < 2 else 1.0
            rows.append((f"g{g}", day(n, 6), float(10 + g + rng.normal()) * jump, float(5 + rng.normal())))
    rows.append(("late", day(split + 1), 1.0, 1.0))
    out = {(r.k, r.signal): r for r in continuity.join_steps(series(spark, rows), "k", "ts", ["a", "b"], at(split)).collect()}
    data = {g: np.array([r[2] for r in rows if r[0] == g]) for g in (f"g{g}" for g in range(6))}
    moves = []
    for v in data.values():
        m = v[:split].reshape(-1, 28).mean(axis=1)
        moves += list(np.abs(np.diff(m) / m[:-1]))
    for g, v in data.items():
        r = out[g, "a"]
        assert r.limit == pytest.approx(np.percentile(moves, 99))
        assert r.step == pytest.approx(abs(v[split:split + 28].mean() / v[split - 28:split].mean() - 1))
        assert r.std_ratio == pytest.approx(v[split:].std(ddof=1) / v[:split].std(ddof=1))
        assert r.step_ok == (g not in ("g0", "g1")) and not r.signal_ok
    assert out["late", "a"].step is None and out["late", "a"].step_ok and out["g0", "b"].signal_ok
    one = continuity.join_steps(series(spark, [r for r in rows if r[0] != "g1"]), "k", "ts", ["a"], at(split)).where("k = 'g0'").first()
    assert not one.step_ok and one.signal_ok
    assert continuity.join_steps(series(spark, []), "k", "ts", ["a"], at(split)).count() == 0
    with pytest.raises(ValueError, match="date"):
        continuity.join_steps(series(spark, []).withColumn("ts", F.to_date("ts")), "k", "ts", ["a"], at(split))


def test_parameter_baselines_leave_out_weeks_around_failures(spark):
    week = lambda n: (D0 + dt.timedelta(weeks=n)).date()
    rows = [("m", p, week(n), float(v)) for p, values in ((1, {0: 10, 5: 99, 20: 90, 22: 80, 23: 99, 24: 14}), (2, {0: -1, 24: 1})) for n, v in values.items()] + [("m", 3, week(0), None), ("n", 1, week(9), 5.0), (None, 1, week(0), 1.0), ("m", 1, None, 1.0)]
    weekly = spark.createDataFrame(rows, "tag string, parameter int, week_date date, value double")
    failures = spark.createDataFrame([("m", day(20 * 7 + 2)), ("m", day(20 * 7 + 4)), ("m", None), (None, day(3))], "tag string, failure_date timestamp_ntz")
    limits = spark.createDataFrame([("m", 1, 112.0), ("m", 2, 0.0)], "tag string, parameter int, trip_value double")
    out = {(r.tag, r.parameter): r for r in continuity.parameter_baselines(weekly, failures, limits).collect()}
    r = out["m", 1]
    # The failure's week is 20: weeks 6 to 23 are left out, 5 and 24 are not.
    assert (r.n, r["mean"], r.lowest, r.failures) == (3, 41.0, 10.0, 1)
    assert r.ramp == pytest.approx((90 - 41) / (112 - 41)) and r.drives and r.resample
    assert out["m", 2]["mean"] == 0.0 and out["m", 2].resample and out["m", 2].ramp == 0.0
    assert out["m", 3].n == 0 and out["m", 3]["mean"] is None and not out["m", 3].resample
    assert out["n", 1].n == 1 and out["n", 1].trip_value is None and set(out) == {("m", 1), ("m", 2), ("m", 3), ("n", 1)}


def test_snapshot_statuses(spark):
    weekly = spark.createDataFrame([(1, dt.date(2024, 1, 1), 5.0), (2, dt.date(2024, 1, 1), 5.1), (3, dt.date(2024, 1, 1), None), (4, dt.date(2024, 1, 1), 5.0), (5, dt.date(2024, 1, 1), 5.0), (None, None, 5.0)], "tag int, week date, snap double")
    hourly = spark.createDataFrame([(t, day(6), 5.0) for t in (1, 2, 3, 5, 5)] + [(4, day(6, 1), 5.0)], "tag int, ts timestamp_ntz, v double")
    out = continuity.snapshot_check(weekly, hourly, "tag", "week", "ts", {"snap": "v"}).collect()
    assert {r.tag: r.status for r in out} == {1: "equal", 2: "differs", 3: "no_snapshot", 4: "no_reading", 5: "repeated", None: "no_reading"}


def test_manifest_counts_in_one_scan(spark):
    df = spark.createDataFrame([(1, day(1), "a", None), (2, day(3), "a", True), (None, None, None, True)], "id int, ts timestamp_ntz, mode string, real boolean")
    found = continuity.manifest(df, "ts", ("mode",), ("real",))
    out = {(r.section, r.name, r.item): (r.n, r.at) for r in found.collect()}
    assert out["frame", "rows", None] == (3, None) and out["frame", "columns", None][0] == 4 and out["frame", "numeric_columns", None][0] == 1
    assert out["span", "first", None] == (None, day(1)) and out["span", "last", None] == (None, day(3))
    assert [out["nulls", c, None][0] for c in df.columns] == [1, 1, 1, 1]
    assert out["label", "mode", "a"][0] == 2 and out["label", "mode", None][0] == 1 and out["provenance", "real", "true"][0] == 2
    empty = {(r.section, r.name): (r.n, r.at) for r in continuity.manifest(df.limit(0), "ts", ("mode",)).collect()}
    assert empty["frame", "rows"] == (0, None) and empty["span", "last"] == (None, None) and empty["nulls", "id"] == (0, None) and not [k for k in empty if k[0] == "label"]


def test_slides_and_registry(spark):
    html = "<html><title> Deck  one </title><script>x='<h1>no</h1>'</script><!-- <h2>no</h2> --><H1 class='a'>Top</H1><p>a <b>b</b></p><h2>\x01Next</h2><h2></h2></html>"
    pages = spark.createDataFrame([(1, html), (2, None), (3, "plain")], "page_id int, html string")
    out = [tuple(r)[:4] for r in documents.slides(pages).orderBy("page_id", "slide_number").collect()]
    assert out == [(1, 1, "Deck  one", "Deck  one"), (1, 2, "Top", "Top | a | b"), (1, 3, "Next", "Next"), (1, 4, "", ""), (2, 1, "", ""), (3, 1, "plain", "plain")]
    assert documents.slides(pages).where("page_id = 3").first().content_sha256 == hashlib.sha256(b"plain").hexdigest()

    master = spark.createDataFrame([("t1", "AR-1", "p"), ("t2", "AR-2", "p"), ("t3", None, "q"), ("t4", "AR-1", "q")], "tag string, ar_no string, plant string")
    one = spark.createDataFrame([(1, "case AR-1, AR-1.", "s1"), (2, "AR-2!", "s2")], "doc int, text string, sha256 string")
    registry = documents.incident_registry(master, one, "ar_no", "doc", "text", expected=3)
    assert {r.tag: (r.matches, r.source_document, r.source_type, r.label_source) for r in registry.collect()} == {
        "t1": (1, 1, "real_rca_backed", "rca_document"), "t2": (1, 2, "real_rca_backed", "rca_document"), "t3": (0, None, "synthetic_support", "synthetic_generation"), "t4": (1, 1, "real_rca_backed", "rca_document")}
    deck = documents.slides(pages.withColumnRenamed("page_id", "doc"), "doc")
    cases = documents.case_corpus(registry, deck, "ar_no", "doc", ("plant",))
    assert sorted(r.document_id for r in cases.collect()) == sorted(["AR-1:slide:1", "AR-1:slide:2", "AR-1:slide:3", "AR-1:slide:4"] * 2 + ["AR-2:slide:1"])
    for docs, expected, message in (
        (one.unionByName(spark.createDataFrame([(3, "AR-2", "s")], one.schema)), 3, "several documents hold AR-2"),
        (one, 2, "3 rows are backed"), (one.unionByName(spark.createDataFrame([(4, None, "s")], one.schema)), 3, "document 4 holds no number"),
    ):
        with pytest.raises(ValueError, match=message):
            documents.incident_registry(master, docs, "ar_no", "doc", "text", expected)


def test_joint_association_tells_signal_from_noise(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 2))
    y = (rng.random(600) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c), i) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))] + [(None, 0.0, 1, 1), (0.0, 0.0, None, 1)], "a double, b double, y int, i int")
    train, test = df.where("i < 400"), df.where("i >= 400")
    out = {(r.section, r.name): r.value for r in models.joint_association(train, test, ["a", "b"], "y").collect()}
    assert out["coefficient", "a"] > 1.2 and abs(out["coefficient", "b"]) < 0.5
    assert out["measure", "roc_auc"] > 0.8 and out["measure", "event_rate"] == pytest.approx(y[400:].mean())
    assert sum(k[0] == "observed" for k in out) == 10 and out["observed", "bin_09"] > out["observed", "bin_00"]
    assert models.joint_association(train, test.where("i < 420"), ["a", "b"], "y") is None
    assert models.joint_association(train.where("y = 1"), test, ["a", "b"], "y") is None
