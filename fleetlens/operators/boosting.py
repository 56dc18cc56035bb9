"""Boosted trees for many rows: the trees that Spark's GBTClassifier and GBTRegressor grow, from features kept as a byte each.

Spark's learners go over objects of every row 4 times a tree. Here rows are packed once into blocks of columns; tasks add up what each level needs by bin, and the driver sees these sums only, whose size does not hang
on the number of rows. Candidates of splits come from all rows, not from Spark's sample of 10,000.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel, keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import store

#: Spark's maxBins, and the depth that all models here have.
BINS, DEPTH = 32, 4
#: Rows of a block, and the partitions whose sums the driver adds up by itself.
BLOCK, DIRECT = 65_536, 64
#: The lineage is cut after so many trees.
CUT = 30


def edges_of(rows: DataFrame, cols: list[str]) -> list[list[float]]:
    """The splits to try of each column, at most BINS - 1: halfway between neighbours where there are few values, else quantiles."""
    points = [i / BINS for i in range(1, BINS)]
    value = lambda c: F.col(c).cast("double")
    found = rows.agg(*[F.struct(F.approx_count_distinct(value(c)).alias("n"), F.percentile_approx(value(c), points, 10_000).alias("q")).alias(f"_{i}") for i, c in enumerate(cols)]).first()
    few = [i for i in range(len(cols)) if found[i].n <= 2 * BINS]
    values = dict(zip(few, rows.agg(*[F.collect_set(value(cols[i])).alias(f"_{i}") for i in few]).first(), strict=True)) if few else {}
    out = []
    for i, x in enumerate(found):
        each = sorted(values.get(i, []))
        out.append([(a + b) / 2 for a, b in zip(each, each[1:])] if i in values and len(each) <= BINS else sorted(set(x.q or [])))
    return out


def packed(rows: DataFrame, cols: list[str], y: str, weight: str | None, edges: list[list[float]]) -> RDD:
    """Blocks (bins by column, y, weight, score so far) of the rows, in their partitions."""
    ends = [np.array(e, float) for e in edges]

    def block(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(batches)
        column = lambda k: np.asarray(t.column(k), float)
        bins = np.stack([np.searchsorted(e, column(k)) for k, e in enumerate(ends)]).astype(np.uint8)
        return pa.RecordBatch.from_pydict({k: pa.array([v.tobytes()], pa.binary()) for k, v in (("x", bins), ("y", column(len(ends))), ("w", column(len(ends) + 1)))})

    def pack(batches):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= BLOCK:
                yield block(held)
                held, n = [], 0
        if n:
            yield block(held)

    def unpack(r) -> tuple:
        y, w = np.frombuffer(r.y), np.frombuffer(r.w)
        return np.frombuffer(r.x, np.uint8).reshape(len(ends), len(y)), y, w, np.zeros(len(y))

    names = [F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)]
    wanted = rows.select(*names, F.col(y).cast("double").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
    return wanted.mapInArrow(pack, "x binary, y binary, w binary").rdd.map(unpack)


def leaves(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """The place from the left, at the given depth of a tree, of each column of x. A node's children are 2 i + 1 and 2 i + 2."""
    n = x.shape[1]
    node, flat, at = np.zeros(n, np.intp), x.reshape(-1), np.arange(n)
    for level in range(depth):
        i = node + (2**level - 1)
        node = 2 * node + ~(flat[feature[i] * n + at] <= cut[i])
    return node


def residuals(y: np.ndarray, score: np.ndarray, logistic: bool, first: bool) -> np.ndarray:
    """What the next tree is fitted on, as Spark has it: the labels, -1 and 1 for classes; then the losses' slopes."""
    if not logistic:
        return y if first else 2 * (y - score)
    sign = 2 * y - 1
    return sign if first else 4 * sign / (1 + np.exp(np.minimum(2 * sign * score, 700)))


def _sums(state: RDD, feature: np.ndarray, cut: np.ndarray, level: int, logistic: bool, first: bool) -> np.ndarray:
    """Sums of weights and of weighted residuals by node of the level, column and bin."""
    nodes = 2**level

    def run(blocks):
        total = None
        for x, y, w, score in blocks:
            total = np.zeros((2, len(x), nodes * BINS)) if total is None else total
            base, wr = leaves(x, feature, cut, level) * BINS, w * residuals(y, score, logistic, first)
            for k, bins in enumerate(x):
                at = base + bins
                total[0, k] += np.bincount(at, w, nodes * BINS)
                total[1, k] += np.bincount(at, wr, nodes * BINS)
        return [] if total is None else [total]

    each = state.mapPartitions(run)
    found = each.treeReduce(np.add) if each.getNumPartitions() > DIRECT else sum(each.collect())
    return found.reshape(2, -1, nodes, BINS)


def _grow(sums: np.ndarray, edges: list[list[float]], feature: np.ndarray, cut: np.ndarray, value: np.ndarray, level: int) -> None:
    """Split the nodes of a level where that lowers the variance most; a node without such a split sends all rows left."""
    for j in range(2**level):
        i, (w, s) = 2**level - 1 + j, sums[:, :, j]
        wl, sl = w.cumsum(1)[:, :-1], s.cumsum(1)[:, :-1]
        wr, sr = w[:, ::-1].cumsum(1)[:, ::-1][:, 1:], s[:, ::-1].cumsum(1)[:, ::-1][:, 1:]
        value[2 * i + 1 : 2 * i + 3] = value[i]
        total = w[0].sum()
        if total <= 0:
            continue
        with np.errstate(all="ignore"):
            gain = np.where((wl > 0) & (wr > 0), sl**2 / wl + sr**2 / wr - s.sum(1, keepdims=True) ** 2 / total, -np.inf)
        k, b = np.unravel_index(np.argmax(gain), gain.shape)
        if gain[k, b] > 1e-14 * total:
            feature[i], cut[i] = k, b
            value[2 * i + 1 : 2 * i + 3] = sl[k, b] / wl[k, b], sr[k, b] / wr[k, b]


def fit(rows: DataFrame, cols: list[str], y: str, weight: str | None = None, logistic: bool = True, iterations: int = 120, rate: float = 0.08) -> str:
    """The trees as JSON, see BoostedTrees. rows: no nulls in y; classes are 0 and 1. They are read three times."""
    spark = rows.sparkSession
    edges = edges_of(rows, cols)
    used = [i for i, e in enumerate(edges) if e]  # a column of one value cannot split
    if not used:
        used, edges[0] = [0], [float("inf")]
    edges, trees = [edges[i] for i in used], []
    state, older, old = packed(rows, [cols[i] for i in used], y, weight, edges).persist(StorageLevel.MEMORY_AND_DISK), None, None
    for m in range(iterations):
        size = 2 ** (DEPTH + 1) - 1
        feature, cut, value = np.zeros(size, np.intp), np.full(size, 255, np.uint8), np.zeros(size)
        for level in range(DEPTH):
            sums = _sums(state, feature, cut, level, logistic, m == 0)
            if level == 0:
                if older is not None:
                    older.unpersist()
                if state.isCheckpointed():
                    old = old and store.removed(spark, old) and None
                    old = state.getCheckpointFile()
                value[0] = sums[1, 0].sum() / sums[0, 0].sum()
            _grow(sums, edges, feature, cut, value, level)
        step, leaf = (rate if m else 1.0), value[2**DEPTH - 1 :]
        # A cut of 255 is one that no row passes.
        trees.append({"feature": [used[k] for k in feature[: 2**DEPTH - 1]], "cut": [None if c == 255 else edges[k][c] for k, c in zip(feature, cut[: 2**DEPTH - 1])], "leaf": [step * float(v) for v in leaf]})
        if m + 1 < iterations:
            older, state = state, state.map(lambda b, f=feature, c=cut, v=step * leaf: (*b[:3], b[3] + v[leaves(b[0], f, c, DEPTH)])).persist(StorageLevel.MEMORY_AND_DISK)
            if (m + 1) % CUT == 0:
                store.checkpoints(spark)
                state.checkpoint()
    state.unpersist()
    if old:
        store.removed(spark, old)
    return json.dumps(trees)


def raw_score(trees: str, cols: list[Column]) -> Column:
    """The sum of the trees' leaves: half the log odds of a class, or the value itself."""
    each = [(np.array(t["feature"]), np.array([np.inf if c is None else c for c in t["cut"]]), np.array(t["leaf"])) for t in json.loads(trees)]

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        x, out = np.stack([c.to_numpy(float) for c in columns]), np.zeros(len(columns[0]))
        for feature, cut, leaf in each:
            out += leaf[leaves(x, feature, cut, DEPTH)]
        return pd.Series(out)

    return score(*[c.cast("double") for c in cols])


class BoostedTrees(Transformer, HasInputCols, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the probabilities of both classes as a vector. trees: a JSON list of the columns, cuts (null: all go left) and
    leaves (step size included) of complete trees; values up to a cut go left."""

    trees = Param(Params._dummy(), "trees", "the trees as JSON", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, *, trees=None, inputCols=None, outputCol=None):
        super().__init__()
        self._setDefault(outputCol="probability")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        raw = raw_score(self.getOrDefault("trees"), [F.col(c) for c in self.getInputCols()])
        p = dataset.withColumn("_raw", raw).withColumn("_p", 1 / (1 + F.exp(-2 * F.col("_raw"))))
        return p.withColumn(self.getOutputCol(), array_to_vector(F.array(1 - F.col("_p"), F.col("_p")))).drop("_raw", "_p")
