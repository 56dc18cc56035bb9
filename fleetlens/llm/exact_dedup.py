"""Exact deduplication by a log-structured merge index of text digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RUNS, BITS = 4, 16


def normalised(text: Column) -> Column:
    return common.ascii_lower(F.coalesce(text, F.lit("")))


def full_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


class DigestIndex:
    """Runs of (digest, id, n), sorted by digest, with a filter each, under one folder of the shared checkpoint store.

    flush() turns a batch's memtable (its digests aggregated by key, spilled by Spark as needed) into level-0 runs.
    compact() merges all runs into one, keeping for each digest the smallest identifier (the largest with
    keep="largest") and the number of rows. lookup() asks the filters first which runs may hold a digest, then these runs
    alone. A filter is a Bloom filter in blocks of 2^15 bits, two bits a digest, BITS bits for each row that the index
    expects in a run; with more rows it lets more through, and no digest is missed. Byte verification of hits is
    exact_groups()'s and same_bytes()'s.
    """

    def __init__(self, spark: SparkSession, keep: str = "smallest", digest=full_digest, expected: int = 1_000_000):
        if keep not in ("smallest", "largest"):
            raise ValueError(f"keep: {keep}")
        self.spark, self.keep, self.digest = spark, keep, digest
        self.blocks, self.runs, self.filters, self.next = max(1, -(-expected * BITS >> 15)), [], [], 0

    def _best(self, c: str) -> Column:
        return (F.min if self.keep == "smallest" else F.max)(c)

    def _place(self) -> list[Column]:
        h = F.xxhash64(F.lit(1), "digest")
        return [F.pmod(F.xxhash64("digest"), F.lit(self.blocks)).alias("block"), h.bitwiseAND(32767).alias("bit1"), F.shiftright(h, 20).bitwiseAND(32767).alias("bit2")]

    def _add(self, run: DataFrame) -> DataFrame:
        """run: run, digest, id, n; a task sorts its part of each run and writes it in order."""
        kept = common.stored(run.sortWithinPartitions("run", "digest"), partition_by=["run"])
        bits = kept.select("run", *self._place()).select("run", "block", F.explode(F.array("bit1", "bit2")).alias("bit"))
        self.runs.append(kept)
        self.filters.append(common.stored(bits.groupBy("run", "block").agg(F.bitmap_construct_agg("bit").alias("bits"))))
        return kept

    def flush(self, digests: DataFrame, runs: int = 1) -> DataFrame:
        """digests: digest, id, as `runs` new runs. A run has each of its digests once; repeated rows and ties only
        raise n."""
        run = (F.pmod(F.xxhash64("id"), F.lit(runs)) + self.next).cast("int").alias("run")
        self.next += runs
        return self._add(digests.groupBy(run, "digest").agg(self._best("id").alias("id"), F.count("*").alias("n")))

    def _all(self, tables: list[DataFrame]) -> DataFrame:
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t)
        return out

    def compact(self) -> DataFrame:
        """All runs as one: digest, id, n."""
        merged = self._all(self.runs).groupBy("digest").agg(self._best("id").alias("id"), F.sum("n").alias("n")).withColumn("run", F.lit(self.next))
        self.next += 1
        self.runs, self.filters = [], []
        return self._add(merged)

    def candidates(self, digests: DataFrame) -> DataFrame:
        """digest, run: the runs whose filter lets the digest through; each digest once a run."""
        asked = digests.select("digest").distinct().select("digest", *self._place())
        held = self._all(self.filters).withColumnRenamed("block", "b")
        is_set = lambda bit: F.conv(F.hex(F.substring("bits", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int").bitwiseAND(F.expr(f"shiftleft(1, cast({bit} & 7 AS int))")) > 0
        return asked.join(held, (F.col("block") == F.col("b")) & is_set("bit1") & is_set("bit2")).select("digest", "run")

    def lookup(self, digests: DataFrame) -> DataFrame:
        """digests (digest, id, ...; a stored table) with keep_id and n of the index's rows of their digest; n is 0
        where it holds none."""
        if not self.runs:
            return digests.withColumns({"keep_id": F.lit(None).cast("long"), "n": F.lit(0).cast("long")})
        hits = self.candidates(digests).join(self._all(self.runs), ["run", "digest"])
        found = hits.groupBy("digest").agg(self._best("id").alias("keep_id"), F.sum("n").alias("n"))
        asked = digests.groupBy("digest").agg(F.count("*").alias("asked"))
        joined = common.heavy_join(digests, common.stored(found.join(asked, "digest")), ["digest"], F.col("id"), count="asked")
        return joined.withColumn("n", F.coalesce("n", F.lit(0))).drop("asked")


def same_bytes(hits: DataFrame, texts: DataFrame, chunk: int = 64) -> DataFrame:
    """hits (id, digest, keep_id, n) with same: whether the two texts are equal byte for byte.

    The kept text of a group of n rows goes out once for each `chunk` rows, so that no key has more rows than that.
    """
    shares = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(chunk)))
    asked = hits.withColumn("share", F.pmod(F.xxhash64("id"), shares))
    kept = hits.groupBy("digest").agg(F.first("keep_id").alias("keep_id"), F.first("n").alias("n"))
    kept = kept.join(texts.select(F.col("id").alias("keep_id"), F.col("text").alias("kept_text"), F.col("digest").alias("kept_digest")), "keep_id")
    kept = kept.where("digest = kept_digest").dropDuplicates(["digest"])
    kept = kept.select(F.col("digest").alias("kd"), F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)).alias("ks"), "kept_text")
    asked = asked.join(texts.select(F.col("id").alias("tid"), F.col("digest").alias("td"), "text"), (F.col("id") == F.col("tid")) & (F.col("digest") == F.col("td")))
    return asked.join(kept, (F.col("digest") == F.col("kd")) & (F.col("share") == F.col("ks"))).select("id", "digest", (F.col("text") == F.col("kept_text")).alias("same"))


def exact_groups(docs: DataFrame, keep: str = "largest", digest=full_digest, runs: int = RUNS) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty, and empty texts are one group. A
    repeated doc_id with one text counts each time; its rows are kept together. Null ids are kept as they are and name
    no group unless all its ids are null. Rows whose digest is known but whose bytes differ from the kept row's (a
    digest collision) are grouped anew by their whole texts.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").alias("id"), normalised(F.col("text")).alias("text"))
    texts = texts.withColumn("sha", F.sha2("text", 256))
    texts = texts.withColumn("digest", F.unhex("sha") if digest is full_digest else digest(F.col("text")))
    digests = common.stored(texts.select("id", "digest", "sha"))
    index = DigestIndex(spark, keep, digest, digests.count())
    index.flush(digests.select("id", "digest"), runs)
    index.compact()
    found = common.stored(index.lookup(digests))
    hits = found.where("n > 1 AND id <> keep_id")
    verified = same_bytes(hits.select("id", "digest", "keep_id", "n"), texts)
    differs = common.stored(verified.where(~F.col("same")).select("id", "digest").distinct())
    done = found
    if differs.limit(1).count():
        again = texts.join(differs.withColumnRenamed("id", "i").withColumnRenamed("digest", "d"), (F.col("id") == F.col("i")) & (F.col("digest") == F.col("d")), "left_semi")
        groups = again.groupBy("text").agg(index._best("id").alias("keep_id"), F.count("*").alias("n"))
        regrouped = again.join(groups, "text").select("id", "digest", "sha", "keep_id", "n")
        gone = differs.withColumnRenamed("id", "i").withColumnRenamed("digest", "d")
        stay = found.join(gone, (F.col("id") == F.col("i")) & (F.col("digest") == F.col("d")), "left_anti").drop("n")
        sizes = stay.groupBy("digest").agg(F.count("*").alias("n"))
        done = common.heavy_join(stay, sizes, ["digest"], F.col("id")).unionByName(regrouped)
    return done.select(
        F.col("id").alias("doc_id"), "keep_id", F.col("n").alias("group_size"), F.coalesce(F.col("id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), F.col("sha").alias("text_sha256")
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


OP3_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, coalesce(doc_id = keep_id, keep_id IS NULL) AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""
