"""From documents to packed token ids: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import common, decontaminate, minmax_dedup, mixing, packing, toxicity


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labels of the training folds."""
    model = toxicity.model_of(docs.select("doc_id", "text"), common.table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score(docs, model).where(F.col("score") < toxicity.THRESHOLD).drop("score")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id; rows without a doc_id all stay.

    Of rows that repeat a doc_id and its text one stays; rows of one doc_id with other texts are one document and all
    stay if it does.
    """
    gone = minmax_dedup.near_groups(docs.select("doc_id", "text")).where(~F.col("kept")).select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti")
    key = ["doc_id", F.xxhash64("text").alias("_text")]
    repeated = common.stored(docs.where("doc_id IS NOT NULL").groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n"))
    if not repeated.limit(1).count():
        return kept
    again = kept.join(repeated, (kept["doc_id"] == repeated["doc_id"]) & (F.xxhash64(kept["text"]) == repeated["_text"]), "left_semi")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    once = again.groupBy("doc_id", "text").agg(F.min_by(F.struct(*others), F.xxhash64(*others)).alias("_row")) if others else again.distinct()
    once = once.select("doc_id", "text", "_row.*").select(*docs.columns) if others else once
    rest = kept.join(repeated, (kept["doc_id"] == repeated["doc_id"]) & (F.xxhash64(kept["text"]) == repeated["_text"]), "left_anti")
    return rest.unionByName(once)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_contaminated(docs, common.table(spark, sf_dir, "benchmark").select("item_id", "text"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of token ids."""
    return packing.packed(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Neither the classifier nor the similarity search can be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir))
    return docs
