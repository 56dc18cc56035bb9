"""Structured Streaming forms of the time-driven operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.timeseries import asof_join


def due(staged: DataFrame, now: Column, live: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """Rows whose release time has come and that are not live yet."""
    rows = staged.where(F.col("release_at") <= now)
    return rows if live is None else rows.join(live.select(*keys), keys, "left_anti")


def release_times(weekly: DataFrame, pm: DataFrame) -> tuple[DataFrame, DataFrame]:
    """When rows come due: the end of their week; 17:00 of the day of completion, or six days after a missed date."""
    end = F.date_add("week_date", 7).cast("timestamp_ntz")
    done = F.col("completed_date").cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(17))
    missed = F.date_add("scheduled_date", 6).cast("timestamp_ntz")
    return weekly.withColumn("release_at", end), pm.withColumn("release_at", F.coalesce(done, missed))


def _earlier(spark: SparkSession, path: str, schema: StructType, number: int) -> DataFrame:
    """The rows of the batches before this one."""
    kinds = StructType([*schema.fields, StructField("batch", LongType())])
    return spark.read.schema(kinds).option("ignoreMissingFiles", "true").parquet(path).where(F.col("batch") < number)


def release_writer(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends rows whose keys are not there yet, so that a repeated batch adds nothing.

    The batch number is part of the folder's name and each batch is written in overwrite mode. Earlier batches are read
    as one table, partitioned by batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates(keys)
        if number:
            rows = rows.join(_earlier(spark, path, batch.schema, number).select(*keys), keys, "left_anti")
        rows.select(*batch.columns).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def episodes(alerts: DataFrame, ts: str = "ts", key: str = "tag", reset: str = "24 hours", delay: str = "1 hour") -> DataFrame:
    """Alert episodes as sessions; the last alert's own time is the end."""
    rows = alerts.withWatermark(ts, delay) if alerts.isStreaming else alerts
    w = rows.groupBy(key, F.session_window(ts, reset)).agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("alerts"))
    return w.select(key, "start", "end", "alerts")


def distinct_readings(readings: DataFrame, keys: list[str], ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Repeated readings dropped; late ones are dropped once the watermark has passed."""
    if not readings.isStreaming:
        return readings.dropDuplicates(keys)
    return readings.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def rollup(readings: DataFrame, key: str, value: str, width: str = "1 hour", ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Count, sum and mean by entity and window of time."""
    rows = readings.withWatermark(ts, delay) if readings.isStreaming else readings
    w = rows.groupBy(key, F.window(ts, width).alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return w.select(key, F.col("w.start").alias("start"), "n", "total", "mean")


class LastHits(StatefulProcessor):
    """State of an entity: its last `lookback` flags."""

    def __init__(self, lookback: int = 6, min_hits: int = 3):
        self.lookback, self.min_hits = lookback, min_hits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.flags = handle.getValueState("flags", "flags array<boolean>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        flags = list(self.flags.get()[0]) if self.flags.exists() else []
        frame = pd.concat(rows).sort_values("ts", kind="stable")
        out = []
        for ts, hit in zip(frame["ts"], frame["hit"], strict=True):
            flags = [*flags, bool(hit)][-self.lookback :]
            out.append((key[0], ts, sum(flags), sum(flags) >= self.min_hits and flags[-1]))
        self.flags.update((flags,))
        yield pd.DataFrame(out, columns=["tag", "ts", "hits", "persistent"])

    def close(self) -> None:
        pass


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """The session's state store for streams that keep state of their own; afterwards what it was before."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def live_persistence(alerts: DataFrame, lookback: int = 6, min_hits: int = 3) -> DataFrame:
    """N-of-M persistence over a stream of (tag, ts, hit); needs the RocksDB state store."""
    return alerts.groupBy("tag").transformWithStateInPandas(LastHits(lookback, min_hits), "tag long, ts timestamp, hits int, persistent boolean", "Append", "None")


def run_available(stream: DataFrame, root: str, mode: str) -> DataFrame:
    """Run a stream over what its source holds, batch by batch, and read its result: of mode "complete" the last batch's
    rows, of "append" all batches'. root: a folder for the batches and the checkpoint; a run that failed goes on there.
    """
    if mode not in ("complete", "append"):
        raise ValueError(f"mode: {mode}")
    spark, done = stream.sparkSession, []

    def write(batch: DataFrame, number: int) -> None:
        # All batches lie in one partitioned table, so that reading it names one folder.
        batch.write.mode("overwrite").parquet(f"{root}/result/batch={number}")
        done.append(number)

    query = stream.writeStream.foreachBatch(write).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{root}/checkpoint").start()
    query.awaitTermination()
    if not done:
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(stream.schema).option("basePath", f"{root}/result")
    return rows.parquet(f"{root}/result/batch={max(done)}" if mode == "complete" else f"{root}/result").select(*stream.columns)


def linked_alerts(alerts: DataFrame, incidents: DataFrame, horizon_days: int = 30) -> DataFrame:
    """Open alerts (alert_id, tag, predicted_at) with the first incident of their entity within the horizon after them.

    Those with one are resolved: incident_seq and resolved_at are set, status is Resolved; others stay Open.
    """
    rows = alerts.withColumn("_from", F.col("predicted_at").cast(incidents.schema["failure_date"].dataType))
    out = asof_join(rows, incidents.select("tag", "failure_date", "incident_seq"), "tag", "_from", "failure_date", "forward", True, ["incident_seq"])
    within = F.coalesce(F.date_diff(F.to_date("asof_ts"), "predicted_at") <= horizon_days, F.lit(False))
    status = F.when(within, "Resolved").otherwise("Open")
    return out.select(*alerts.columns, F.when(within, F.col("asof_incident_seq")).alias("incident_seq"), F.when(within, F.col("asof_ts")).alias("resolved_at"), status.alias("status"))


def resolving_writer(alerts_path: str, out_path: str, horizon_days: int = 30) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over live incidents: each batch resolves the alerts that are not resolved by an earlier one.

    A batch's folder is overwritten when it is repeated, so late or repeated incidents resolve an alert once.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        alerts = spark.read.parquet(alerts_path)
        found = linked_alerts(alerts, batch, horizon_days).where("status = 'Resolved'")
        if number:
            done = _earlier(spark, out_path, found.schema, number).select("alert_id")
            found = found.join(done, "alert_id", "left_anti").select(*found.columns)
        found.write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return write
