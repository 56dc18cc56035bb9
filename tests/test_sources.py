"""Guards, table sources and streams."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import guards
from fleetlens.operators import forecast
from fleetlens.sources import documents, store, tables
from fleetlens.streaming import flows


def test_guards_name_what_is_wrong(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert guards.require_columns(df, ["a"]) is df and guards.without_leakage(df, ["y"]) is df
    for bad in (lambda: guards.require_columns(df, ["z"]), lambda: guards.without_leakage(df, ["b"]), lambda: guards.chosen("x", ["a"]), lambda: guards.feature_union(["a"], ["y"], forbidden=["y"])):
        with pytest.raises(ValueError):
            bad()
    assert guards.feature_union(["a", "b"], ["b", "c"]) == ["a", "b", "c"]
    bundle = {"horizon_days": 7, "features": ["a"], "action": 0.6, "warning": 0.4}
    assert guards.checked_bundle(bundle, 7, df.columns) is bundle
    for change in ({"horizon_days": 30}, {"features": ["q"]}, {"warning": 0.9}, {"action": 1.5}):
        with pytest.raises(ValueError):
            guards.checked_bundle(bundle | change, 7, df.columns)
    assert guards.first_present({"base": lambda: df}, "operational", "base") is df


def test_csv_reports_and_counts(spark, tmp_path):
    (tmp_path / "x.csv").write_text("day,value\n2024-01-02,1.5\n2024-01-03,\n")
    rows = tables.csv_rows(spark, str(tmp_path / "x.csv"), "day date, value double")
    assert [(r.day, r.value) for r in rows.orderBy("day").collect()] == [(dt.date(2024, 1, 2), 1.5), (dt.date(2024, 1, 3), None)]
    (tmp_path / "bad.csv").write_text("day,value\nnever,1\n")
    with pytest.raises(Exception):
        tables.csv_rows(spark, str(tmp_path / "bad.csv"), "day date, value double").collect()
    tables.write_report(rows, str(tmp_path / "report"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "report")).collect()) == ['{"day":"2024-01-02","value":1.5}', '{"day":"2024-01-03","value":null}']
    assert tables.verified(rows, 2) is rows
    with pytest.raises(ValueError):
        tables.verified(rows, 3)


def test_prepared_tables_check_their_keys(spark):
    df = spark.createDataFrame([(1, "2024-01-02"), (2, "no date"), (3, None)], "` id` int, `day ` string")
    out = tables.prepared(df, ["id"], ("day",)).orderBy("id").collect()
    assert [r.day for r in out] == [dt.datetime(2024, 1, 2), None, None]
    for bad in (df.union(df.limit(1)), df.union(spark.createDataFrame([(None, "x")], df.schema))):
        with pytest.raises(Exception, match="key"):
            tables.prepared(bad, ["id"], ("day",)).collect()
    assert tables.prepared(df.union(df), ["id"], unique=False).count() == 6 and tables.prepared(df.limit(0), ["id"]).count() == 0
    with pytest.raises(ValueError):
        tables.prepared(spark.createDataFrame([(1, 2)], "`a ` int, a int"), ["a"])


def test_wall_time_of_mixed_offsets(spark):
    rows = spark.createDataFrame([("2024-06-01 10:00:00+02:00",), ("2024-06-01T08:00:00Z",), ("2024-06-01 08:00:00",), (None,)], "t string")
    assert [r[0] for r in rows.select(tables.wall_time(F.col("t"), "Asia/Jakarta")).collect()] == [dt.datetime(2024, 6, 1, 15)] * 3 + [None]


def test_two_writers_at_once_and_a_broken_pointer_leave_whole_versions(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "p")
    assert tables.publish({"a": spark.range(1)}, root) == 1
    seen, real = [], tables._pointers

    def late(s, r):
        """Another writer publishes between this one's look at the numbers and its own pointer."""
        found = real(s, r)
        if not seen:
            seen.append(1)
            tables.publish({"a": spark.range(2)}, root)
        return found

    monkeypatch.setattr(tables, "_pointers", late)
    assert tables.publish({"a": spark.range(3)}, root) == 3
    monkeypatch.undo()
    assert tables.published(spark, root, "a").count() == 3
    (tmp_path / "p" / "pointer" / "000000000004.json").write_text('{"version": "cut o')
    assert tables.published(spark, root, "a").count() == 3
    assert tables.publish({"a": spark.range(5)}, root) == 5 and tables.published(spark, root, "a").count() == 5
    with pytest.raises(ValueError, match="nothing is published"):
        tables.published(spark, str(tmp_path / "q"), "a")


def test_stored_tables_are_dropped(spark):
    store.drop_stored(spark)
    path = store.stored(spark.range(4)).inputFiles()[0]
    assert store.drop_stored(spark) == 1 and not os.path.exists(path.removeprefix("file://")) and store.drop_stored(spark) == 0


def test_a_failed_publication_leaves_the_old_version(spark, tmp_path):
    root, one = str(tmp_path / "p"), spark.range(3)
    tables.publish({"a": one, "b": one}, root)
    broken = spark.range(1).select(F.raise_error(F.lit("broken")).alias("x"))
    with pytest.raises(Exception):
        tables.publish({"a": spark.range(9), "b": broken}, root)
    assert tables.published(spark, root, "a").count() == 3
    tables.publish({"a": spark.range(9)}, root)
    assert tables.published(spark, root, "a").count() == 9
    with pytest.raises(ValueError):
        tables.published(spark, root, "b")


def test_cases_are_added_once(spark):
    schema = "task_id int, status string, approved boolean, root_cause string, corrective_action string"
    rows = [(1, "Closed", True, "wear", "x"), (1, "Closed", True, "wear", "y"), (2, "Open", True, "a", "b"), (3, "Closed", False, "a", "b"), (4, "Closed", True, " ", "b"), (5, "closed", True, "a", "b"), (None, "Closed", True, "a", "b")]
    df = spark.createDataFrame(rows, schema)
    out = tables.cases_to_append(df, spark.createDataFrame([(5,)], "task_id int"))
    assert [r.task_id for r in out.collect()] == [1]
    assert tables.cases_to_append(df, df.where("task_id IN (1, 5)")).count() == 0


def test_documents_match_one_master_row(spark):
    master = spark.createDataFrame([("AR-1",), ("AR-2",)], "ar string")
    docs = spark.createDataFrame([(1, "report on AR-1 only"), (2, "AR-1 and AR-2"), (3, "AR-11"), (4, None)], "id int, text string")
    out = {r.id: (r.matches, r.ar) for r in documents.match_documents(docs, master, "text", "ar", strict=False).collect()}
    assert out == {1: (1, "AR-1"), 2: (2, "AR-1"), 3: (0, None), 4: (0, None)}
    assert documents.match_documents(docs.where("id = 1"), master, "text", "ar").count() == 1
    with pytest.raises(Exception, match="fits 2"):
        documents.match_documents(docs.where("id = 2"), master, "text", "ar").collect()


def test_sections_of_pages(spark):
    html = "<title>A</title><P class='x'>one <b>two</b>\n three</p><p> </p><li>last</li>"
    out = documents.sections(spark.createDataFrame([(1, html), (2, None), (3, "plain")], "page_id int, html string")).orderBy("section").collect()
    assert [(r.page_id, r.section, r.content) for r in out] == [(1, 1, "A"), (1, 2, "one two three"), (1, 4, "last")]


def test_autocorrelation_and_direction(spark):
    rows = spark.createDataFrame([(1, dt.date(2024, 1, 1) + dt.timedelta(days=i), float(i % 2)) for i in range(100)], "k int, day date, y double")
    out = {r.lag: r.autocorrelation for r in forecast.autocorrelation(rows, "k", "day", "y", (1, 2, 200)).collect()}
    assert out[1] == pytest.approx(-0.99) and out[2] == pytest.approx(0.98) and out[200] is None
    d = spark.createDataFrame([(100.0, 100.4, 0.0), (100.0, 102.0, 10.0), (100.0, 103.0, 10.0), (100.0, 90.0, None), (1.0, None, 1.0)], "a double, b double, s double")
    assert [r[0] for r in d.select(forecast.direction(F.col("a"), F.col("b"), F.col("s"))).collect()] == ["Stable", "Stable", "Rising", "Falling", None]


def test_late_incidents_resolve_an_alert_once(spark, tmp_path):
    day = dt.date(2024, 1, 1)
    alerts = spark.createDataFrame([("A", 1, day), ("B", 2, day)], "alert_id string, tag int, predicted_at date")
    alerts.write.parquet(str(tmp_path / "alerts"))
    incident = lambda seq, d: spark.createDataFrame([(1, seq, dt.datetime(2024, 1, d))], "tag int, incident_seq int, failure_date timestamp_ntz")
    write = flows.resolving_writer(str(tmp_path / "alerts"), str(tmp_path / "out"))
    write(incident(1, 9), 0)
    write(incident(2, 5), 1)
    write(incident(2, 5), 1)
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.alert_id, r.incident_seq, r.status) for r in out] == [("A", 1, "Resolved")]
    both = {r.alert_id: (r.incident_seq, r.status) for r in flows.linked_alerts(alerts, incident(1, 9).union(incident(2, 5)).union(incident(3, 9).withColumn("failure_date", F.lit("2023-12-30").cast("timestamp_ntz")))).collect()}
    assert both == {"A": (2, "Resolved"), "B": (None, "Open")}


def test_late_and_repeated_readings_are_dropped_in_a_stream(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    (tmp_path / "in").mkdir()
    rows = lambda hours: spark.createDataFrame([(1, start + dt.timedelta(hours=h)) for h in hours], "tag int, ts timestamp")
    stream = flows.distinct_readings(spark.readStream.schema("tag int, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), ["tag", "ts"])
    for hours in ((0, 0, 1), (1, 20), (0, 21)):
        rows(hours).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    got = sorted(r.ts for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [start + dt.timedelta(hours=h) for h in (0, 1, 20, 21)]


def test_live_persistence_keeps_the_last_flags(spark, tmp_path):
    provider = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)
    (tmp_path / "in").mkdir()
    start, hits = dt.datetime(2024, 1, 1), (True, False, True, True, False, False, True)
    stream = flows.live_persistence(spark.readStream.schema("tag long, ts timestamp, hit boolean").parquet(str(tmp_path / "in")))
    for part in (range(3), range(3, 7)):
        spark.createDataFrame([(1, start + dt.timedelta(hours=i), hits[i]) for i in part], "tag long, ts timestamp, hit boolean").write.mode("append").parquet(str(tmp_path / "in"))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(180)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    out = spark.read.parquet(str(tmp_path / "out")).orderBy("ts").collect()
    assert [r.hits for r in out] == [1, 1, 2, 3, 3, 3, 3] and [r.persistent for r in out] == [False, False, False, True, False, False, True]
