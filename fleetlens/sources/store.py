"""Named tables and intermediate ones under a root that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Intermediate tables of this process, by application, so that they can be dropped.
_made: dict[str, list[str]] = {}


def checkpoints(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a private folder in local mode only, which becomes it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base


def scratch(spark: SparkSession) -> str:
    """A new path under checkpoints()."""
    path = f"{checkpoints(spark).rstrip('/')}/{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """df, written once as Parquet and read from there: what follows neither computes it again nor loses it with an
    executor. drop_stored() removes it."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held(spark: SparkSession, path: str | None) -> bool:
    """Whether this application made the path and has not dropped it."""
    return path in _made.get(spark.sparkContext.applicationId, [])


def removed(spark: SparkSession, path: str) -> bool:
    """Delete a path of any file system that Spark can write to; whether there was one."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def freed(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files that nothing asks for any more, such as those behind a stored table. It does so when the
    driver collects its garbage, which an idle driver may not do for long: until then they lie beside what is written next.
    A plan just run is still held by the events of its end, so that takes a second look."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)


def drop_stored(spark: SparkSession) -> int:
    """Delete the intermediate tables that this application has made so far; how many there were. Call it once the
    results that read them are written."""
    return sum(removed(spark, p) for p in _made.pop(spark.sparkContext.applicationId, []))
