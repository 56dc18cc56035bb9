"""Positions and running sums over a whole order, without one task that holds it all.

Rows are cut into ranges of the key by approximate quantiles (a bounded list of numbers; any edges give the same
result). Sums by range are a bounded table; within a range a window goes on from what lies before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = 64


def edges_of(df: DataFrame, key: Column, parts: int = PARTS) -> list[float]:
    """Distinct approximate quantiles of a number, `parts` - 1 at most; the more rows, the more of them."""
    points = [i / parts for i in range(1, parts)]
    n, found = df.agg(F.count(key), F.percentile_approx(key.cast("double"), points, 10_000)).first()
    return sorted(set(found or [])) if n > 1000 * parts else sorted(set((found or [])[:: max(1, parts // 4)]))


def range_of(key: Column, edges: list[float]) -> Column:
    """How many edges the number reaches, by halving; null is in range 0."""
    if not edges:
        return F.lit(0)
    half = len(edges) // 2
    above = range_of(key, edges[half + 1 :])
    return F.when(key >= edges[half], above + (half + 1)).otherwise(range_of(key, edges[:half]))


def running(df: DataFrame, by: list[str], key: str, sums: list[str]) -> DataFrame:
    """df with cum_<c> for each of sums: its sum over all rows of the group with a key no smaller than the row's.

    Keys are distinct within a group; also all_<c>, the group's sum.
    """
    number = F.col(key).cast("double")
    edges = edges_of(df, number)
    cut = df.withColumn("_range", range_of(number, edges).cast("int"))
    per = cut.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    above = Window.partitionBy(*by).orderBy(F.col("_range").desc())
    before = per.select(
        *[F.col(c).alias(f"_by_{c}") for c in by], F.col("_range").alias("_at"),
        *[(F.sum(f"_{c}").over(above) - F.col(f"_{c}")).alias(f"_before_{c}") for c in sums],
        *[F.sum(f"_{c}").over(Window.partitionBy(*by)).alias(f"all_{c}") for c in sums],
    )
    on = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by] + [F.col("_range") == F.col("_at")]
    inside = Window.partitionBy(*by, "_range").orderBy(F.col(key).desc())
    out = cut.withColumns({f"cum_{c}": F.sum(c).over(inside) for c in sums}).join(before, on)
    return out.select(*df.columns, *[(F.col(f"cum_{c}") + F.col(f"_before_{c}")).alias(f"cum_{c}") for c in sums], *[f"all_{c}" for c in sums])


def position(df: DataFrame, key: Column, order: list[Column], name: str) -> DataFrame:
    """df with its rows' place from 1 in the order, whose first part is the number key from the largest down."""
    number = key.cast("double")
    cut = df.withColumn("_range", range_of(number, edges_of(df, number)).cast("int"))
    per = cut.groupBy("_range").agg(F.count("*").alias("_n"))
    before = per.select(F.col("_range").alias("_at"), (F.sum("_n").over(Window.orderBy(F.col("_range").desc())) - F.col("_n")).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(number.desc(), *order)
    placed = cut.withColumn("_i", F.row_number().over(inside)).join(before, F.col("_range") == F.col("_at"))
    return placed.select(*df.columns, (F.col("_i") + F.col("_before")).cast("int").alias(name))


def quantiles_by(df: DataFrame, by: list[str], value: str, points: list[float]) -> DataFrame:
    """by, i, q: exact quantiles of each group, i the place in points, linear between neighbours; nulls do not count.

    Rows are counted by distinct value first; the counts are persisted, since the ranges are found from them.
    """
    known = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n")).persist()
    run = running(known, by, "v", ["n"])
    # From the smallest up, a value takes the positions first..last.
    rows = run.select(*by, "v", (F.col("all_n") - F.col("cum_n")).alias("first"), (F.col("all_n") - F.col("cum_n") + F.col("n") - 1).alias("last"), (F.col("all_n") - 1).alias("end"))
    asked = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(points)])).alias("asked")
    at = F.col("asked.p") * F.col("end")
    low_here, high_here = F.floor(at).between(F.col("first"), F.col("last")), F.ceil(at).between(F.col("first"), F.col("last"))
    here = rows.select("*", asked).where(low_here | high_here)
    found = here.groupBy(*by, F.col("asked.i").alias("i")).agg(F.max(F.when(low_here, F.col("v"))).alias("low"), F.max(F.when(high_here, F.col("v"))).alias("high"), F.max(at - F.floor(at)).alias("part"))
    return found.select(*by, "i", (F.col("low") + (F.col("high") - F.col("low")) * F.col("part")).alias("q"))


def quantiles(df: DataFrame, value: str, points: list[float]) -> list[float | None]:
    """The same of the whole table, as numbers."""
    found = {r.i: r.q for r in quantiles_by(df, [], value, points).collect()}
    return [found.get(i) for i in range(len(points))]
