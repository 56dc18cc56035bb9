"""Failure models from fit to release: pipelines that outlive their session, scores out of fold, the search for a split,
thresholds from rolling validation alone."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, fields
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting, labels, metrics, models
from .timeseries import persistence

#: A fit takes rows with features and label and returns what scores rows.
Scorer = Callable[[DataFrame], DataFrame]
Fit = Callable[[DataFrame], Scorer]
ROLLING, TEST = "rolling_validation", "test"


def _is_probability(score: Column) -> Column:
    return F.coalesce(~F.isnan(score) & (score >= 0) & (score <= 1), F.lit(False))


def valid_probability(score: str, key: str) -> Column:
    """The score; a row whose score is no number within 0 and 1 fails the job, with its key in the message."""
    found = F.concat(F.lit(f"{score} of {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(" is "), F.coalesce(F.col(score).cast("string"), F.lit("null")))
    return F.when(_is_probability(F.col(score)), F.col(score)).otherwise(F.raise_error(found).cast("double"))


def check_probabilities(df: DataFrame, score: str, key: str) -> DataFrame:
    """df, if all its scores are numbers within 0 and 1; else an error that names the row with the smallest key."""
    bad = df.where(~_is_probability(F.col(score))).select(F.col(key).alias("k"), F.col(score).alias("s")).orderBy(F.col("k").asc_nulls_last()).limit(1).collect()
    if bad:
        raise ValueError(f"{score} of {key} {bad[0].k} is {bad[0].s}")
    return df


#: Fits that run beside each other: their many short jobs leave cores idle.
AT_ONCE = 4


def side_by_side(calls: list[Callable[[], object]]) -> list:
    """What the calls return, in their order; AT_ONCE of them run at a time."""
    with ThreadPool(AT_ONCE) as pool:
        return pool.map(lambda call: call(), [inheritable_thread_target(SparkSession.getActiveSession())(c) for c in calls], chunksize=1)


@dataclass
class FailureModel:
    """A fitted pipeline with what goes with it: features, horizon, thresholds and the state of release."""

    pipeline: PipelineModel
    cols: list[str]
    horizon_days: int
    action: float | None = None
    warning: float | None = None
    release: str | None = None
    notes: dict[str, str] = field(default_factory=dict)

    def score(self, rows: DataFrame, name: str = "score", key: str | None = None) -> DataFrame:
        """rows with the probability of a failure. key: the column that names a row whose probability is none."""
        missing = [c for c in self.cols if c not in rows.columns]
        if missing:
            raise ValueError(f"features are missing: {', '.join(missing)}")
        out = self.pipeline.transform(rows).withColumn(name, vector_to_array("probability")[1])
        out = out.select(*[F.col(c) for c in rows.columns if c != name], name)
        return out.withColumn(name, valid_probability(name, key)) if key else out

    def save(self, path: str) -> None:
        """The pipeline and one JSON row beside it, under path; an older model there is replaced."""
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        facts = {f.name: getattr(self, f.name) for f in fields(self) if f.name != "pipeline"}
        SparkSession.getActiveSession().createDataFrame([(json.dumps(facts, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")

    @staticmethod
    def load(spark: SparkSession, path: str) -> FailureModel:
        return FailureModel(PipelineModel.load(f"{path}/pipeline"), **json.loads(spark.read.text(f"{path}/facts").first().value))


def _prepared(cols: list[str]) -> list:
    """Stages from columns with nulls to a vector: medians for nulls, and a flag for each."""
    values = ", ".join(f"CAST(`{c}` AS DOUBLE) AS `{c}__value`, CAST(`{c}` IS NULL AS DOUBLE) AS `{c}__missing`" for c in cols)
    filler = Imputer(inputCols=[f"{c}__value" for c in cols], outputCols=[f"{c}__filled" for c in cols], strategy="median")
    return [SQLTransformer(statement=f"SELECT *, {values} FROM __THIS__"), filler, VectorAssembler(inputCols=[f"{c}__{k}" for k in ("filled", "missing") for c in cols], outputCol="_vector")]


def boosted(train: DataFrame, cols: list[str], y: str, horizon_days: int, iterations: int = 120, rate: float = 0.08) -> FailureModel:
    """Boosted trees with balanced classes."""
    rows, held, _ = models.fit_rows(train, list(cols), y)
    *first, vector = _prepared(cols)
    filled, names = Pipeline(stages=first).fit(rows), vector.getInputCols()
    trees = boosting.fit(filled.transform(rows), names, y, "weight", iterations=iterations, rate=rate)
    held.unpersist()
    return FailureModel(PipelineModel([*filled.stages, boosting.BoostedTrees(trees=trees, inputCols=names)]), list(cols), horizon_days)


def logistic(train: DataFrame, cols: list[str], y: str, horizon_days: int) -> FailureModel:
    """A logistic fit on standardised columns with balanced classes and the usual unit penalty."""
    rows, held, n = models.fit_rows(train, list(cols), y)
    learner = LogisticRegression(featuresCol="_scaled", labelCol=y, weightCol="weight", regParam=1.0 / max(n, 1), standardization=False, maxIter=100)
    stages = [*_prepared(cols), StandardScaler(inputCol="_vector", outputCol="_scaled", withMean=True), learner]
    fitted = Pipeline(stages=stages).fit(rows)
    held.unpersist()
    return FailureModel(fitted, list(cols), horizon_days)


def out_of_fold(rows: DataFrame, fit: Fit, test_start: Column, horizon_days: int, ts: str = "ts", y: str = "y", folds: int = 3, initial: float = 0.5, least: tuple[int, int] = (8, 5),
                held_out: Column | None = None, key: str = "tag", event: str = "next_failure_date") -> DataFrame:
    """rows with split, fold, trained_before and score; none is scored by a model that has seen it or its horizon.

    Each of the expanding folds before test_start gets a fit of its own on what lies before it less the horizon, and gives
    its part of the rolling validation; the test (fold 0) is scored by a fit on all before test_start less the horizon.
    Rows with a null label and entities in held_out do not train; rows with a null label are not scored. Folds that are
    rejected (see labels.rolling_folds()) give no rows. There are folds + 1 fits, each over all its rows.
    """
    known, gap = rows.where(F.col(y).isNotNull()), F.make_dt_interval(days=F.lit(horizon_days))
    kind, learn = rows.schema[ts].dataType, known if held_out is None else known.where(~held_out)
    calls = []

    def scored(trained_before: Column, part: DataFrame, split: str, fold: int) -> None:
        def run() -> DataFrame:
            trained = fit(learn.where(F.col(ts) < trained_before))
            return trained(part).withColumns({"split": F.lit(split), "fold": F.lit(fold), "trained_before": trained_before})

        calls.append(run)

    for f in labels.rolling_folds(rows, ts, y, test_start, horizon_days, folds, initial, least, held_out, key, event).orderBy("fold").collect():
        if f.rejection is None:
            start, end = (F.lit(x).cast(kind) for x in (f.validation_start, f.validation_end))
            scored(start - gap, known.where((F.col(ts) >= start) & (F.col(ts) < end)), ROLLING, f.fold)
    scored(test_start - gap, known.where(F.col(ts) >= test_start), TEST, 0)
    first, *others = side_by_side(calls)
    for p in others:
        first = first.unionByName(p)
    return first


@dataclass
class Hardened:
    """Thresholds from rolling validation: a row for action and warning each, all splits labelled again, the curve."""

    thresholds: DataFrame
    relabelled: DataFrame
    curve: DataFrame
    action: float
    warning: float
    release: str


def harden(scored: DataFrame, action: dict, warning: dict, strict: bool = False, candidates: int = 121, lookback: int = 6, min_hits: int = 3, reset_hours: float = 24, rolling: str = ROLLING) -> Hardened:
    """Thresholds of action and warning from the rows of split `rolling` alone, applied to all splits.

    scored: split, tag, ts, event_id, y, score, next_failure_date, days_to_next_failure. action and warning are limits as
    metrics.select_threshold() takes them; a warning's threshold is no larger than the action's. Persistence goes by split
    and entity. strict: a model whose action breaks a limit is experimental. No rows of rolling validation are an error.
    """
    chosen = scored.where((F.col("split") == rolling) & F.col("y").isNotNull()).persist()
    grid = metrics.threshold_grid(chosen, "score", candidates)
    if not grid:
        raise ValueError("no scores of rolling validation")
    curve = metrics.threshold_curve(chosen, grid, reset_hours=reset_hours, lookback=lookback, min_hits=min_hits).persist()
    first = metrics.select_threshold(curve, **action).withColumn("kind", F.lit("action")).persist()
    a = first.first()
    second = metrics.select_threshold(curve, **warning, cap=a.threshold).withColumn("kind", F.lit("warning")).persist()
    w = second.first()
    release = "EXPERIMENTAL" if strict and not a.limits_met else "INSPECTION_PRIORITY_BASELINE"
    rows = scored
    for name, limit in (("action", a.threshold), ("warning", w.threshold)):
        rows = persistence(rows, ["split", "tag"], ["ts", "event_id"], F.col("score") >= limit, lookback, min_hits).withColumnsRenamed({"hits": f"{name}_hits", "persistent": name})
        rows = rows.withColumn(f"{name}_threshold", F.lit(float(limit)))
    return Hardened(first.unionByName(second), rows, curve, float(a.threshold), float(w.threshold), release)


def hardening_report(h: Hardened, y: str = "y") -> DataFrame:
    """By split: rows, both thresholds, rows of either alert, confusion of the action, and the state of release."""
    a, t = F.col("action"), F.col(y) == 1
    out = h.relabelled.where(F.col(y).isNotNull()).groupBy("split", "action_threshold", "warning_threshold").agg(
        F.count("*").alias("n"), F.count_if(a).alias("action_rows"), F.count_if("warning").alias("warning_rows"), F.count_if(a & t).alias("tp"), F.count_if(a & ~t).alias("fp"), F.count_if(~a & t).alias("fn")
    )
    return out.withColumn("release", F.lit(h.release))


def search_splits(rows: DataFrame, fits: dict[int, Fit], ts: str = "ts", candidates: dict[str, tuple[float, float]] | None = None, least: tuple[int, int, int] = (12, 8, 8), beta: float = 1.0,
                  held_out: Column | None = None, key: str = "tag", event: str = "next_failure_date") -> DataFrame:
    """One row per split candidate: status, why it is rejected, its validation scores, and whether it is the chosen one.

    fits: by horizon in days, what fits on rows with features and y. rows: a stored table with features, y_<h>d of each
    horizon, the next event and days_to_next_failure. A candidate that a horizon rejects (see labels.split_candidates())
    is not fitted. Of the others each horizon is fitted on the training part and judged on validation: the threshold of the
    best F-beta, precision, recall, F1, average precision, share of events found. Chosen is the best mean F1, then mean
    average precision, then least share of events, then the name. No test row is scored.
    """
    spark, candidates = rows.sparkSession, candidates or labels.CANDIDATES
    found: dict[str, dict] = {c: {"candidate": c, "rejection": None, "scores": []} for c in candidates}
    bounds = {}
    for h in fits:
        for r in labels.split_candidates(rows, ts, f"y_{h}d", h, candidates, least, held_out, key, event).collect():
            bounds[r.candidate] = r.validation_start, r.test_start
            if r.rejection is not None:
                found[r.candidate]["rejection"] = "; ".join(filter(None, [found[r.candidate]["rejection"], f"{h}d: {r.rejection}"]))
    kind, asked = rows.schema[ts].dataType, []

    def judged(h: int, fit: Fit, start: Column, end: Column) -> tuple:
        known, gap = rows.where(F.col(f"y_{h}d").isNotNull()).withColumn("y", F.col(f"y_{h}d").cast("int")), F.make_dt_interval(days=F.lit(h))
        learn = known.where(F.col(ts) < start - gap)
        valid = fit(learn if held_out is None else learn.where(~held_out))(known.where((F.col(ts) >= start) & (F.col(ts) < end - gap)))
        valid = valid.select(key, event, "days_to_next_failure", "y", "score").persist()
        t, ap = metrics.f_beta_and_precision(valid, "y", "score", beta).select("threshold", "average_precision").first()
        hit = F.col("score") >= t
        m = metrics.confusion(valid, [], "y", hit, "score").first()
        e = metrics.event_metrics(valid.where("y = 1"), event, hit, "days_to_next_failure").first()
        valid.unpersist()
        return h, float(t), m.precision, m.recall, m.f1, ap, e.event_recall or 0.0, m.fp

    for c, f in found.items():
        if f["rejection"] is not None or c not in bounds:
            f["rejection"] = f["rejection"] or "no rows"
            continue
        start, end = (F.lit(x).cast(kind) for x in bounds[c])
        asked += [(c, lambda h=h, fit=fit, start=start, end=end: judged(h, fit, start, end)) for h, fit in fits.items()]
    for (c, _), scores in zip(asked, side_by_side([call for _, call in asked]), strict=True):
        found[c]["scores"].append(scores)
    mean = lambda f, i: sum(s[i] for s in f["scores"]) / len(f["scores"])
    out = []
    for c, f in found.items():
        judged = f["rejection"] is None
        out.append((c, "evaluated" if judged else "rejected_insufficient_events", f["rejection"], *([mean(f, 4), mean(f, 5), min(s[6] for s in f["scores"])] if judged else [None] * 3), f["scores"]))
    best = min((o for o in out if o[2] is None), key=lambda o: (-round(o[3], 12), -round(o[4], 12), -round(o[5], 12), o[0]), default=None)
    schema = """candidate string, status string, rejection string, mean_f1 double, mean_average_precision double, least_event_recall double,
        horizons array<struct<horizon_days: int, threshold: double, precision: double, recall: double, f1: double, average_precision: double, event_recall: double, false_rows: long>>, chosen boolean"""
    return spark.createDataFrame([(*o, best is not None and o[0] == best[0]) for o in out], schema)
