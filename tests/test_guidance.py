"""Evidence and guidance on small pinned cases, and against plain loops over random ones; feature tables that must fail."""

import datetime as dt
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fleetlens.operators import features, guidance

SCORED = "query_id int, slide_id int, document string, kind string, source_type string, score double, exact boolean"


def plain_balanced(rows, k=3):
    out = {}
    for q in {r[0] for r in rows}:
        mine = {r[1]: r for r in rows if r[0] == q}
        least = float("-inf")
        by_score = lambda r: (-(least if r[5] is None else r[5]), r[1])
        exact = [r for r in mine.values() if r[6]]
        led = []
        for kind in guidance.KINDS:
            of_kind = sorted((r for r in exact if r[3] == kind), key=by_score)
            led += of_kind[:1]
        rest = sorted((r for r in (exact or mine.values()) if r not in led), key=by_score)
        out[q] = [r[1] for r in (led + rest)[:k]]
    return out


def test_balanced_evidence_against_a_loop(spark):
    rng = random.Random(11)
    rows = [(q, s, f"d{s % 5}", rng.choice([*guidance.KINDS, "title", None]), "real_rca_backed", rng.choice([None, 0.0, 0.25, 0.5, 0.5, 0.9]), rng.choice([True, False, None]) if q % 3 else rng.choice([False, None])) for q in range(40) for s in range(rng.randrange(1, 14))]
    found = {}
    for r in guidance.balanced_evidence(spark.createDataFrame(rows + rows[:5], SCORED)).orderBy("place").collect():
        found.setdefault(r.query_id, []).append(r.slide_id)
    assert found == plain_balanced(rows)
    assert guidance.balanced_evidence(spark.createDataFrame([], SCORED)).count() == 0


def test_qualified_references(spark):
    rows = [
        (1, 1, "a", "capa", "real_rca_backed", 0.2, True), (1, 2, "a", "root_cause", "real_rca_backed", 0.1, True), (1, 3, "b", None, "verified_closed_sme", 0.9, None), (1, 4, "b", "capa", "verified_closed_sme", 0.2, True),
        (1, 5, "c", "case_summary", "synthetic_support", 0.99, True), (1, 6, "c", "case_summary", "real_rca_backed", 0.75, False), (2, 7, "d", "capa", "real_rca_backed", 0.8, False), (2, 8, "d", "root_cause", "real_rca_backed", 0.76, False),
    ]
    out = guidance.qualified_references(spark.createDataFrame(rows, SCORED)).orderBy("query_id", "place").collect()
    # Slide 6 is not over the threshold, 4 is exact but has no document of a case behind it, 5 is no verified source.
    assert [(r.query_id, r.slide_id, r.basis) for r in out] == [(1, 2, "exact_equipment_match"), (1, 1, "exact_equipment_match"), (1, 3, "similarity_threshold"), (2, 8, "similarity_threshold"), (2, 7, "similarity_threshold")]
    for bad in ((1, 1, "a", "capa", "real_rca_backed", 1.5, True), (1, 1, "", "capa", "real_rca_backed", 0.5, True), (1, 1, "a", "capa", "real_rca_backed", None, True)):
        with pytest.raises(PySparkException, match="invalid reference 1"):
            guidance.qualified_references(spark.createDataFrame([bad], SCORED)).collect()
    with pytest.raises(ValueError, match="threshold"):
        guidance.qualified_references(spark.createDataFrame([], SCORED), 1.2)


ATTRIBUTED = "tag string, horizon int, feature string, feature_group string, rank int"
RISK = "tag string, level string, model_level string, utilisation_7d double, utilisation_30d double, dominant_signal string, name string"


def test_query_texts_and_guidance(spark):
    at = spark.createDataFrame([("a", 7, "x_1", "heat", 1), ("a", 7, "x_2", "heat", 2), ("a", 7, "y", None, 3), ("a", 30, "far_z", "flow", 1), ("b", 30, "far_z", "flow", 4), ("b", 30, "w", "sound", 2), ("c", 7, "q", "sound", 1)], ATTRIBUTED)
    risk = spark.createDataFrame([("a", "ACTION_NOW", "ACTION_NOW", 0.1, 0.9, "heat", "Pump"), ("b", "MONITOR", "MONITOR", 0.9, 0.1, None, ""), ("c", "DATA_QUALITY_REVIEW", "NORMAL", 0.5, 0.5, None, None), ("d", "NORMAL", "NORMAL", 0.0, 0.1, None, "Fan"), ("e", "MONITOR", None, None, None, None, None)], RISK)
    asked = {r.tag: (r.horizon, r.groups, r["query"]) for r in guidance.query_texts(risk, at, ["name"]).collect()}
    assert asked == {
        "a": (7, ["heat", "heat"], "a Pump ACTION_NOW heat heat heat x 1 x 2 y"), "b": (30, ["sound", "flow"], "b MONITOR sound flow w far z"), "c": (7, ["sound"], "c NORMAL sound q"), "d": (30, [], "d Fan NORMAL"), "e": (30, [], "e MONITOR"),
    }
    found = spark.createDataFrame([("a", 1, 17, 0.8123, True), ("a", 2, 18, 0.9, True), ("b", 1, 3, 0.01, False), ("c", 1, 4, 0.9, True)], "tag string, rank int, case_no int, score double, meets boolean")
    out = {r.tag: r for r in guidance.guidance(risk, at, found, {"heat": "Cool it.", "flow": "Open it.", "sound": "Hear it."}, "Look.", "Note it.", "Held.", top=5).collect()}
    assert set(out) == {"a", "b", "c", "e"}
    assert (out["a"].steps, out["a"].precedent_status, out["a"].case_no) == (["Cool it.", "Note it."], "VERIFIED_PRECEDENT", 17) and "17, similarity 0.812;" in out["a"].guidance and out["a"].guidance.endswith("- Cool it.\n- Note it.")
    assert (out["b"].steps, out["b"].precedent_status, out["b"].case_no) == (["Hear it.", "Open it.", "Note it."], "NO_VERIFIED_PRECEDENT", None)
    assert (out["c"].precedent_status, out["c"].case_no, out["c"].guidance) == ("SKIPPED_DATA_QUALITY", None, "Held.")
    assert out["e"].steps == ["Look.", "Note it."]


CONDITION = "tag string, week_date date, health_status string, " + ", ".join(f"parameter_name_{i} string, parameter_value_{i} double" for i in (1, 2)) + ", sun double"
REGISTRY = "tag string, failure_date timestamp_ntz, source_type string, rca_demo_eligible boolean, label_source string"


def test_condition_features_flag_label_and_refuse(spark):
    week = lambda n: dt.date(2024, 1, 1) + dt.timedelta(weeks=n)
    rows = [("m", week(n), "NORMAL", "heat", float(n - 1), "level", -5.0, float(n)) for n in range(4)] + [("m", week(9), "TRIP", "heat", None, None, -1.0, None)]
    df = spark.createDataFrame(rows, CONDITION)
    registry = spark.createDataFrame([("m", dt.datetime(2024, 1, 21, 5), "real_rca_backed", True, "rca_document"), ("x", None, "s", False, "l")], REGISTRY)
    args = {"nonnegative": ["heat"], "signals": ["sun"], "slots": 2, "short": 2, "long": 8}
    table, labels = features.condition_features(df, registry, as_of=F.lit(week(8)), **args)
    out = table.orderBy("week_date").collect()
    assert [r.parameter_value_1 for r in out] == [None, 0.0, 1.0, 2.0] and [r.parameter_1_invalid_physical for r in out] == [1, 0, 0, 0] and [r.data_quality_flag_count for r in out] == [1, 0, 0, 0]
    assert [r.parameter_value_2 for r in out] == [-5.0] * 4 and out[3].parameter_value_1_mean_2w == 0.5 and out[3].sun_lag_2w == 1.0 and out[2].sun_delta_1w == 1.0 and [r.week_of_year for r in out] == [1, 2, 3, 4]
    assert not {"health_status", "failure_date", "is_event_week"} & set(table.columns) and out[0].source_type == "real_rca_backed"
    # The failure of Sunday the 21st belongs to the week of the 15th.
    assert [r.is_event_week for r in labels.orderBy("week_date").collect()] == [0, 0, 1, 0]
    for bad, reg, message in (
        (df.unionByName(df.limit(1)), registry, "repeated key m 2024-01-01"), (df.withColumn("tag", F.lit("q")), registry, "no provenance for q"), (df.withColumn("tag", F.lit(None).cast("string")), registry, "no provenance for null"),
        (df, registry.unionByName(registry), "provenance is repeated for m"),
    ):
        with pytest.raises(PySparkException, match=message):
            features.condition_features(bad, reg, **args)[0].collect()
    assert features.condition_features(df.limit(0), registry, **args)[0].count() == 0
