"""Helpers shared by the corpus operators: tables, scratch space, words, skew-safe joins."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import freed  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words are maximal runs of bytes other than space and \t \n \v \f \r. bytes.split() cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder under the cluster's shared spark.checkpoint.dir; where that is unset, a private one in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame, partition_by: list[str] | None = None, **options: str) -> DataFrame:
    """Cut the lineage: written once as Parquet in the shared folder, read from there by all that follows."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.options(**{"compression": "zstd", **options}).partitionBy(*partition_by or []).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; the built-in lower() is right, and faster, for texts of ASCII alone."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts. A null id counts as empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts).cast("int")


def heavy_join(fact: DataFrame, groups: DataFrame, keys: list[str], spread: Column, count: str = "n", heavy: int = 1000, total: int | None = None) -> DataFrame:
    """Left join of fact to one row per key, safe for keys that hold any share of fact's rows.

    groups has the number of fact's rows of each key in `count`. At most `heavy` keys can hold 1/heavy of all rows
    each; these are broadcast (so the broadcast has at most `heavy` rows, whatever the input's size). Rows of these
    keys are dealt by `spread` through the shuffle that joins all other keys. groups is read several times: a stored
    table, unless it is cheap. total: the sum of `count`, where the caller knows it.
    """
    if total is None:
        total = groups.agg(F.sum(count)).first()[0] or 0
    least = max(2, math.ceil(total / heavy))
    values = [c for c in groups.columns if c not in keys]
    # Always 0; of a literal 0 the optimizer makes a filter, and the salt is no key of the join any more.
    no_salt = F.pmod(F.col(count), F.lit(1)).cast("int")
    hot = groups.where(F.col(count) >= least).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.struct(*values).alias("_hot"))
    cold = groups.where(F.col(count) < least).select(*[F.col(k).alias(f"_c{i}") for i, k in enumerate(keys)], no_salt.alias("_s"), F.struct(*values).alias("_cold"))
    on = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)]
    left = fact.join(F.broadcast(hot), on, "left").drop(*[f"_k{i}" for i in range(len(keys))])
    left = left.withColumn("_salt", F.when(F.col("_hot").isNotNull(), 1 + F.pmod(F.xxhash64(spread), F.lit(65536)).cast("int")).otherwise(0))
    joined = left.join(cold, [*(F.col(k) == F.col(f"_c{i}") for i, k in enumerate(keys)), F.col("_salt") == F.col("_s")], "left")
    found = F.coalesce("_hot", "_cold")
    return joined.select(*fact.columns, *[found[c].alias(c) for c in values])


class WordHashes(dict):
    """64-bit hash by word (bytes); a cache of bounded size."""

    def __init__(self, limit: int = 100_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, text: str | None) -> np.ndarray:
        """Hashes of the text's words, A-Z lower-cased, in order."""
        data = (text or "").encode("utf-8", "surrogatepass").lower()
        parts = []
        for piece in pieces(data):
            words = piece.split()
            parts.append(np.fromiter(map(self.__getitem__, words), np.uint64, len(words)))
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def slices(batches: Iterable[pa.RecordBatch], size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """All rows in their order, in batches of about `size` bytes each: a batch can hold a task's whole input.

    At the end Arrow gives its unused memory back; a worker that is kept for later tasks would hold it while they run.
    """
    for b in batches:
        step = max(1, b.num_rows * size // max(size, b.nbytes))
        for at in range(0, max(1, b.num_rows), step):
            yield b.slice(at, step)
    b = None
    pa.default_memory_pool().release_unused()


def pieces(data: bytes, size: int = 4 << 20) -> list[bytes]:
    """data in pieces of about `size` bytes that end at white space, so that long texts need little memory at once."""
    if len(data) <= size:
        return [data]
    out, at = [], 0
    while at < len(data):
        end = at + size
        while end < len(data) and data[end : end + 1].strip():
            end += 1
        out.append(data[at:end])
        at = end
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(words: np.ndarray, n: int = 5) -> np.ndarray:
    """Hashes of all runs of n words, in order; of fewer words, one for the whole sequence; of none, none."""
    if not len(words):
        return words
    n = min(n, len(words))
    h = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        h = (h + words[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return mix(h)
