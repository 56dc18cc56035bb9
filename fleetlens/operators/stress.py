"""What a fitted model does when its inputs are disturbed, and what its scores are made of."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import stored
from . import quality, ranks, risk

URGENT = ("ACTION_NOW", "PLAN_MAINTENANCE")


@dataclass(frozen=True)
class Scenario:
    """kind: noise (all columns of a signal, times 1 + size z), outage (the signals themselves, null), dropout (any
    feature, null with probability size), shift (a signal, its lags and means, times 1 + size)."""

    name: str
    kind: str
    size: float = 0.0


#: The usual four.
SCENARIOS = (Scenario("noise_5pct", "noise", 0.05), Scenario("outage", "outage"), Scenario("dropout_10pct", "dropout", 0.1), Scenario("shift_10pct", "shift", 0.1))
BASELINE = "baseline"


def uniform(*key: Column) -> Column:
    """A number within (0, 1) by hash: the same in each run."""
    return (F.pmod(F.xxhash64(*key), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def normal(*key: Column) -> Column:
    """A standard normal by hash (Box and Muller)."""
    return F.sqrt(-2 * F.log(uniform(F.lit("radius"), *key))) * F.cos(2 * F.pi() * uniform(F.lit("angle"), *key))


def touched(s: Scenario, cols: list[str], signals: tuple[str, ...]) -> list[str]:
    """The columns that a scenario changes. A signal's columns have its name, and what is made of it after a _."""
    of = lambda c, ends: any(c == x or any(c.startswith(f"{x}_{e}") for e in ends) for x in signals)
    chosen = {"noise": lambda c: of(c, ("",)), "outage": lambda c: c in signals, "dropout": lambda c: True, "shift": lambda c: of(c, ("lag", "mean"))}
    if s.kind not in chosen:
        raise ValueError(f"scenario kind: {s.kind}")
    return [c for c in cols if chosen[s.kind](c)]


def perturbed(rows: DataFrame, s: Scenario, cols: list[str], signals: tuple[str, ...], key: list[str], seed: str = "stress") -> DataFrame:
    """rows with the scenario's changes. Draws are hashed from seed, scenario, key and column."""

    def changed(c: str) -> Column:
        name = [F.lit(f"{seed}|{s.name}|{c}"), *[F.col(k) for k in key]]
        if s.kind == "noise":
            return F.col(c) * (1 + s.size * normal(*name))
        if s.kind == "shift":
            return F.col(c) * (1 + s.size)
        return F.when(uniform(*name) >= s.size, F.col(c)) if s.kind == "dropout" else F.lit(None).cast("double")

    return rows.withColumns({c: changed(c) for c in touched(s, cols, signals)})


def stressed_risk(window: DataFrame, score: Callable[[DataFrame], DataFrame], thresholds: risk.Thresholds, profile: DataFrame, cols: list[str], signals: tuple[str, ...], scenarios: tuple[Scenario, ...] = SCENARIOS,
                  now: Column | None = None, seed: str = "stress", **windows: int) -> DataFrame:
    """scenario, tag, level, rank, scores, quality status and leave to publish, of the baseline and each scenario.

    window: the last rows of each entity (tag, ts, event_id, cols). All scenarios are scored in one go; levels come from the
    persistence, thresholds and quality gate of the risk table, ranks from within the scenario. windows: as
    quality.assess_quality() takes them.
    """
    each = window.withColumn("scenario", F.lit(BASELINE))
    for s in scenarios:
        each = each.unionByName(perturbed(window, s, cols, signals, ["tag", "ts", "event_id"], seed).withColumn("scenario", F.lit(s.name)))
    # An entity under a scenario is an entity of its own.
    named = stored(score(each).withColumn("tag", F.struct("scenario", "tag")))
    latest = named.groupBy("tag").agg(F.max_by(F.struct(*cols), F.struct("ts", "event_id")).alias("r")).select("tag", "r.*")
    gate = quality.assess_quality(latest, "tag", profile, cols, signals, **windows)
    gate = stored(gate)
    found = risk.latest_risk(named.select("tag", "ts", "event_id", *[f"score_{h}d" for h in thresholds]), thresholds, gate, None, now)
    kept = stored(found.select("tag.scenario", "tag.tag", "level", "risk_rank", *[f"score_{h}d" for h in thresholds], F.col("quality").alias("status"), "publish_allowed"))
    out = None
    for name in (BASELINE, *[s.name for s in scenarios]):
        part = ranks.position(kept.where(F.col("scenario") == name), -F.col("risk_rank"), [F.col("risk_rank")], "rank").drop("risk_rank")
        out = part if out is None else out.unionByName(part)
    return out


def stability(rows: DataFrame, thresholds: risk.Thresholds, least_retention: float = 0.8) -> DataFrame:
    """By scenario of stressed_risk(): how many entities keep their level (safe: or are held for review), urgent alerts lost
    and gained, unsafe ones among them, reviews, rank correlation, changes of scores, and whether the targets are met."""
    scores = [f"score_{h}d" for h in thresholds]
    base = rows.where(F.col("scenario") == BASELINE).select("tag", *[F.col(c).alias(f"base_{c}") for c in ("level", "rank", *scores)])
    both = rows.where(F.col("scenario") != BASELINE).join(base, "tag")
    same, review = F.col("level") == F.col("base_level"), F.col("status") == "REVIEW"
    was, is_ = F.col("base_level").isin(*URGENT), F.col("level").isin(*URGENT)
    share = lambda c: F.avg(c.cast("double"))
    change = lambda c: F.abs(F.col(c) - F.col(f"base_{c}"))
    out = both.groupBy("scenario").agg(
        F.count("*").alias("n"), share(same).alias("retention"), share(same | review).alias("safe_retention"), F.count_if(~same).alias("changed"), F.count_if(was & ~is_ & ~review).alias("urgent_lost"),
        F.count_if(~was & is_).alias("urgent_gained"), F.count_if(~was & is_ & F.col("publish_allowed")).alias("unsafe_gained"), F.count_if(review).alias("reviews"), F.count_if(was & review).alias("urgent_held"),
        F.count_if(~same & ~review).alias("unreviewed_changes"), F.corr("base_rank", "rank").alias("rank_correlation"),
        *[f for c in scores for f in (F.avg(change(c)).alias(f"mean_change_{c[6:]}"), F.max(change(c)).alias(f"max_change_{c[6:]}"))],
    )
    return out.withColumns({"stable": F.col("retention") >= least_retention, "guardrail_passed": (F.col("unsafe_gained") == 0) & (F.col("urgent_lost") == 0)})


def log_odds(p: Column) -> Column:
    within = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.log(within / (1 - within))


def attribution(targets: DataFrame, key: str, cols: list[str], background: DataFrame, score: Callable[[DataFrame], DataFrame], draws: int = 24, most: int = 120, seed: str = "attribution") -> DataFrame:
    """key, feature, value, base_value, output, error, rank of any scorer (it adds the column score).

    For each of `draws` draws a background row turns into the target one feature after the other, in an order by hash; a
    feature's value is the mean change of the score at its turn. All rows of all steps are scored in one go. background is
    a reference of at most `most` rows, chosen by hash, as the method needs a bounded one. base_value is the mean score
    of the rows drawn; the values add up to output less base_value, but for `error`. Nulls are values.
    """
    n = len(cols)
    values = F.struct(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    pool = background.select(values.alias("b")).withColumn("_h", F.xxhash64(F.lit(seed), "b")).orderBy("_h", "b").limit(most)
    pool = pool.select((F.row_number().over(Window.orderBy("_h", "b")) - 1).alias("slot"), "b")
    size = pool.agg(F.count("*").alias("_n"))
    # A target becomes draws * (n + 1) rows that stay where it is, so the targets are dealt first to as many tasks as a shuffle
    # has. By a hash: Spark drops a deal by the key itself where targets come by key, and few bytes of them end in one task.
    dealt = targets.select(key, values.alias("x")).repartition(int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(key))
    rows = dealt.select(key, "x", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).crossJoin(F.broadcast(size))
    rows = rows.withColumn("slot", F.pmod(F.xxhash64(F.lit(seed), key, "draw"), F.col("_n")).cast("int")).join(F.broadcast(pool), "slot")
    order = F.array_sort(F.array(*[F.struct(F.xxhash64(F.lit(f"{seed}{i}"), key, "draw").alias("h"), F.lit(i).alias("i")) for i in range(n)]))
    rows = rows.withColumn("path", F.transform(order, lambda s: s["i"])).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(n))))
    turned = lambda i: F.array_position("path", i) <= F.col("step")
    walk = rows.select(key, "draw", "step", "path", *[F.when(turned(i), F.col(f"x.c{i}")).otherwise(F.col(f"b.c{i}")).alias(c) for i, c in enumerate(cols)])
    scored = score(walk).select(key, "draw", "step", "path", F.col("score").cast("double").alias("score"))
    # A step's score counts for the feature that it turns, and against the one that the next step turns.
    turns, next_ = F.get("path", F.col("step") - 1), F.get("path", F.col("step"))
    gains = [F.sum(F.when(turns == i, F.col("score")).when(next_ == i, -F.col("score"))) / draws for i in range(n)]
    at = lambda step: F.avg(F.when(F.col("step") == step, F.col("score")))
    each = F.array(*[F.struct(F.lit(c).alias("feature"), g.alias("value")) for c, g in zip(cols, gains, strict=True)])
    sums = scored.groupBy(key).agg(at(0).alias("base_value"), at(n).alias("output"), each.alias("each"))
    out = sums.select(key, "base_value", "output", F.explode("each").alias("e")).select(key, "e.*", "base_value", "output")
    total = F.sum("value").over(Window.partitionBy(key))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.abs(F.round("value", 9)).desc(), "feature"))
    return out.select(key, "feature", "value", "base_value", "output", F.abs(F.col("base_value") + total - F.col("output")).alias("error"), rank.alias("rank"))


def attribution_table(values: DataFrame, key: str, targets: DataFrame, background: DataFrame, cols: list[str], groups: dict[str, str], top: int | None = None) -> DataFrame:
    """values with direction (raises, lowers), the feature's group (that of its longest prefix in groups, else other), its
    own value and its median over the whole background; the first `top` of each key."""
    group = F.lit("other")
    for prefix in sorted(groups, key=len):
        group = F.when(F.col("feature").startswith(prefix), groups[prefix]).otherwise(group)
    medians = ranks.quantiles_by(quality.unpivoted(background, [], cols), ["feature"], "value", [0.5]).select("feature", F.col("q").alias("reference_median"))
    own = quality.unpivoted(targets, [key], cols).withColumnRenamed("value", "feature_value")
    rows = values if top is None else values.where(F.col("rank") <= top)
    out = rows.join(own, [key, "feature"], "left").join(F.broadcast(medians), "feature", "left")
    direction = F.when(F.round("value", 9) >= 0, "raises").otherwise("lowers")
    return out.select(key, "feature", "rank", "value", direction.alias("direction"), group.alias("feature_group"), "feature_value", "reference_median", "base_value", "output", "error")
