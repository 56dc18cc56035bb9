"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BITS, THRESHOLD, FOLDS, HELD_OUT = 20, 0.7, 3, 1
#: The fit's bound: so many labelled rows of each class at most, those with the smallest seeded hash of the id.
MAX_ROWS_PER_CLASS = 8_000
#: Rows a shard fits; with a larger sample, the shards' weights are averaged.
SHARD_ROWS = 16_000
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 30.0, 0.0, 3
PUNCTUATION = b".,;:!?\"'()[]{}<>*#|-_"


class Tokens(common.WordHashes):
    """Hashes of words without punctuation around them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.strip(PUNCTUATION) or word)
        return h


def features(words: np.ndarray) -> np.ndarray:
    """Hashed unigrams, bigrams and skip-grams (one word left out), with repeats."""
    m = np.uint64(0x9E3779B97F4A7C15)
    bi = common.mix(words[:-1] * m + words[1:])
    skip = common.mix((words[:-2] * m + words[2:]) * m) if len(words) > 2 else words[:0]
    return (np.concatenate([common.mix(words), bi, skip]) >> np.uint64(64 - BITS)).astype(np.int64)


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def fit(rows: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, float]:
    """Indices and values of the weights that L1 leaves, and the bias. rows: distinct features and label."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bz = bn = 0.0
    positive = max(1, sum(y for _, y in rows))
    weight = (max(1, len(rows) - positive) / positive, 1.0)
    solve = lambda z, n: -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2) * (np.abs(z) > L1)
    for _ in range(EPOCHS):
        for x, y in rows:
            x = x.astype(np.intp)  # rows may hold them in fewer bytes
            w = solve(z[x], n[x])
            bias = -bz / ((BETA + bn**0.5) / ALPHA)
            g = (sigmoid(w.sum() + bias) - y) * (weight[0] if y else weight[1])
            root = np.sqrt(n[x] + g * g) - np.sqrt(n[x])
            z[x] += g - root / ALPHA * w
            n[x] += g * g
            bz += g - ((bn + g * g) ** 0.5 - bn**0.5) / ALPHA * bias
            bn += g * g
    w = solve(z, n)
    at = np.flatnonzero(w)
    return at, w[at], -bz / ((BETA + bn**0.5) / ALPHA)


def train(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """labelled: text, label, doc_id, of bounded size -> averaged weights (indices, values) and bias.

    With one class or no row there is nothing to learn: no weights, and a bias of that class or 0.
    """
    n = labelled.count()
    shards = max(1, -(-n // SHARD_ROWS))

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, rows = Tokens(), []
        for b in common.slices(batches):
            for text, y, key in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                rows.append((key, np.unique(features(tokens.of(text)).astype(np.int32)), int(y)))
        rows.sort(key=lambda r: r[0])
        if rows:
            at, w, bias = fit([r[1:] for r in rows])
            yield pa.RecordBatch.from_pydict({"at": pa.array(np.append(at, -1)), "w": pa.array(np.append(w, bias))})

    key = F.md5(F.concat_ws("|", F.lit("order"), F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")))))
    dealt = labelled.select("text", "label", key.alias("key")).withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    dealt = dealt.repartition(shards, "shard").select("text", "label", "key")
    if not n:
        return np.zeros(0, np.int64), np.zeros(0), 0.0
    # At most 2^BITS indices and the bias come back: a bound that does not depend on the input.
    sums = dealt.mapInArrow(fitted, "at long, w double").groupBy("at").agg((F.sum("w") / shards).alias("w")).toPandas().sort_values("at")
    bias = float(sums.w[sums["at"] == -1].iloc[0])
    kept = sums[(sums["at"] >= 0) & (sums["w"].abs() > 1e-6)]
    return kept["at"].to_numpy(np.int64), kept["w"].to_numpy(), bias


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MAX_ROWS_PER_CLASS) -> DataFrame:
    """doc_id, text, label of labelled rows outside the held-out fold, at most `most` of each class.

    Null labels teach nothing; a doc_id labelled twice has its largest label, one with several texts that of the least hash.
    """
    known = labels.where(F.col("toxic").isNotNull() & (common.fold(F.col("doc_id"), FOLDS) != HELD_OUT)).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    order = F.md5(F.concat_ws("|", F.lit("sample"), F.col("doc_id").cast("string")))
    picked = [known.where(c).orderBy(order, "doc_id").limit(most) for c in ("label > 0", "label <= 0")]
    ids = picked[0].union(picked[1]).select("doc_id", (F.col("label") > 0).cast("int").alias("label"))
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "label", F.struct(F.md5(F.coalesce("text", F.lit(""))), "text").alias("t"))
    return texts.groupBy("doc_id").agg(F.min("t").alias("t"), F.first("label").alias("label")).select("doc_id", "t.text", "label")


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """docs with score (0 to 1). Null and empty texts have no features: the bias alone speaks. All texts are whole."""
    weights = docs.sparkSession.sparkContext.broadcast(model)
    columns = [c for c in docs.columns if c != "score"]
    at = columns.index("text")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idx, w, bias = weights.value
        dense = np.zeros(1 << BITS, np.float32)
        dense[idx] = w
        tokens = Tokens()
        for b in common.slices(batches):
            out = np.empty(b.num_rows)
            for i, text in enumerate(b.column(at)):
                x = features(tokens.of(text.as_py()))
                x = x[dense[x] != 0]
                out[i] = sigmoid(float(dense[np.unique(x)].sum()) + bias)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=[*columns, "score"])

    rows = docs.select(*columns)
    return rows.mapInArrow(scored, rows.withColumn("score", F.lit(0.0)).schema)


def model_of(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    return train(common.stored(training_rows(docs, labels)))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = model_of(docs, common.table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = score(docs, model)
    return scored.select("doc_id", (common.fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
