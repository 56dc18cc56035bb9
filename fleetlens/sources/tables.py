"""Reading, preparing, publishing and appending tables."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.guards import require_columns


def csv_rows(spark: SparkSession, path: str, schema: str, **options: str) -> DataFrame:
    """A CSV file with a header and typed columns; a row that does not fit its types fails the read."""
    return spark.read.options(header="true", mode="FAILFAST", **options).schema(schema).csv(path)


def verified(df: DataFrame, expected: int, name: str = "table") -> DataFrame:
    """df, if it has as many rows as its source says; for partitioned reads of a whole table."""
    found = df.count()
    if found != expected:
        raise ValueError(f"{name} has {found} rows, its source says {expected}")
    return df


def prepared(df: DataFrame, key: list[str], dates: tuple[str, ...] = (), unique: bool = True) -> DataFrame:
    """Columns with trimmed names, dates parsed, and keys checked.

    A null or (with unique) repeated key fails the job, with the key in the message. Dates that cannot be parsed are
    null. Names that are equal once trimmed fail at once.
    """
    names = [c.strip() for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError("names are equal once trimmed")
    out = require_columns(df.toDF(*names), [*key, *dates])
    out = out.withColumns({c: F.try_to_timestamp(F.col(c).cast("string")) for c in dates})
    missing = F.greatest(*[F.col(k).isNull() for k in key]) if len(key) > 1 else F.col(key[0]).isNull()
    out = out.where(F.when(missing, F.raise_error(F.lit(f"null in key {', '.join(key)}")).cast("boolean")).otherwise(F.lit(True)))
    if not unique:
        return out
    repeated = out.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1")
    twice = F.raise_error(F.concat_ws(" ", F.lit("repeated key"), *[F.col(f"_k.{k}").cast("string") for k in key]))
    marks = repeated.select(F.struct(*key).alias("_k"))
    joined = out.join(marks, [out[k] == F.col(f"_k.{k}") for k in key], "left")
    return joined.where(F.when(F.col("_k").isNotNull(), twice.cast("boolean")).otherwise(F.lit(True))).drop("_k")


def wall_time(ts: Column, zone: str) -> Column:
    """Local wall time of an instant; texts with offsets are read as instants first, those without as UTC."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), F.to_timestamp(ts.cast("string")).cast("timestamp_ntz"))


def write_report(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, nulls written out."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def _pointers(spark: SparkSession, root: str) -> tuple[object, object, list[int]]:
    """The file system, the folder of pointers, and their numbers."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/pointer")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
    return files, folder, sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def publish(tables: dict[str, DataFrame], root: str) -> int:
    """Write all tables to a new version, then point to it; returns the version's number.

    The pointer is one file named by its number that is created only if it is not there yet, so of two writers at once the
    second takes the next number, and readers follow the largest. A failure before leaves the version before in place, one
    while the file is written leaves a file that is no pointer. Old versions stay for those who still read them.
    """
    version, spark = uuid.uuid4().hex, next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.parquet(f"{root}/versions/{version}/{name}")
    body = bytearray(json.dumps({"version": version, "tables": sorted(tables)}).encode())
    while True:
        files, folder, numbers = _pointers(spark, root)
        number = (numbers[-1] if numbers else 0) + 1
        try:
            out = files.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, f"{number:012d}.json"), False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            continue
        out.write(body)
        out.close()
        return number


def published(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the version with the largest number whose pointer is whole."""
    _, _, numbers = _pointers(spark, root)
    for number in reversed(numbers):
        rows = spark.read.text(f"{root}/pointer/{number:012d}.json").collect()
        try:
            last = json.loads(rows[0].value)
        except (IndexError, ValueError):
            continue
        if name not in last["tables"]:
            raise ValueError(f"{name} is not in the published version")
        return spark.read.parquet(f"{root}/versions/{last['version']}/{name}")
    raise ValueError(f"nothing is published under {root}")


def cases_to_append(candidates: DataFrame, existing: DataFrame, key: str = "task_id", needed: tuple[str, ...] = ("root_cause", "corrective_action")) -> DataFrame:
    """Cases that may be added: approved, closed, complete, and neither there yet nor twice in the batch.

    Of rows with one key that with the least hash is taken. Running it again on its own result adds nothing.
    """
    complete = F.lit(True)
    for c in needed:
        complete = complete & (F.length(F.trim(F.coalesce(c, F.lit("")))) > 0)
    rows = candidates.where(F.col("approved") & (F.lower("status") == "closed") & complete & F.col(key).isNotNull())
    rows = rows.join(existing.select(key), key, "left_anti")
    once = rows.groupBy(key).agg(F.min_by(F.struct(*candidates.columns), F.xxhash64(*candidates.columns)).alias("r"))
    return once.select("r.*")
