"""Mixing sources to target weights: repetition rates by source, whole copies plus one seeded draw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WEIGHTS, CAP, SEED = (5, 2, 1), 3, "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def placed(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows, stored, with their place from 0 in the order.

    The place comes from a distributed sort: position within a partition plus the rows of the partitions before it (the
    driver sees one count per partition).
    """
    kept = common.stored(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    kept = kept.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1))
    before, starts = 0, []
    for part, n in sorted(kept.groupBy("_part").count().collect()):
        starts.append((part, before))
        before += n
    first = rows.sparkSession.createDataFrame(starts or [(0, 0)], "_part long, _before long")
    return kept.join(F.broadcast(first), "_part").withColumn(name, F.col("_at") + F.col("_before")).select(*rows.columns, name)


def ranked_sources(sized: DataFrame) -> DataFrame:
    """One row per source: source, source_size, n, rank from 0 by code point, null last."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    return placed(per, [F.col("source").asc_nulls_last()], "rank")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """Targets by source: shares of the total by weight, none above cap times the source's size.

    What a capped source gives up goes to the others by weight, until none is above. Each round is one aggregate over
    the sources; a source once capped stays capped, so the rounds end.
    """
    w = F.array(*map(F.lit, weights))[F.pmod(F.col("rank"), F.lit(len(weights))).cast("int")].cast("double")
    sources = common.stored(ranked_sources(sized).withColumn("weight", w).withColumn("most", F.col("source_size") * float(cap)))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, capped = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("weight") * level >= F.col("most")
        gone, n, free = sources.agg(F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0.0)), F.count_if(full), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if n == capped or not free:
            break
        level, capped = (total - gone) / free, n
    return sources.withColumn("target", F.least("most", F.col("weight") * F.lit(float(level or 0)))).drop("weight", "most", "rank")


def draw(key: Column, seed: str) -> Column:
    """A number in [0, 1) from a hash of the seed and the key: the same in each run and for each task's retry."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(key.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def drawn(docs: DataFrame, seed: str) -> DataFrame:
    """docs with u, the row's draw: by its doc_id, or, where that is null or has several rows, by the row's place among
    all such rows in the order of id, source and text. Equal rows are one another's like, so reruns agree."""
    keyed = docs.withColumn("_id", F.coalesce(F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.lit("")))
    again = common.stored(keyed.groupBy("_id").agg(F.count("*").alias("_rows")).where("_rows > 1 OR _id = ''"))
    by_id = draw(F.col("doc_id"), seed)
    if not again.limit(1).count():
        return docs.withColumn("u", by_id)
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    marked = common.stored(common.heavy_join(keyed, again.withColumn("_odd", F.lit(True)), ["_id"], text, count="_rows"))
    odd = marked.where("_odd").drop("_odd", "_rows").withColumn("_row", F.monotonically_increasing_id())
    order = [F.col("_id"), F.col("source").asc_nulls_last(), text, F.col("_row")]
    by_place = placed(odd, order, "_place").withColumn("u", draw(F.concat(F.lit("again|"), F.col("_place").cast("string")), seed))
    once = marked.where("_odd IS NULL").withColumn("u", by_id)
    return once.select(*docs.columns, "u").unionByName(by_place.select(*docs.columns, "u"))


def with_copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """docs with size, source_size, target and copies (how often the mix holds the row).

    copies is floor(rate) plus one more with probability rate - floor(rate), rate = target / source_size.
    Null or empty texts have size 0 and are drawn like others; a null source is a source. Rows without
    a doc_id and rows that repeat one each have a draw of their own. A source with no words has rate 0. Columns of docs stay, but for those named like the new ones.
    """
    docs = docs.drop("size", "source_size", "target", "copies", "n", "u")
    sized = drawn(docs, seed).withColumn("size", word_count(F.col("text")))
    targets = common.stored(source_targets(sized.select("source", "size"), weights, cap))
    keyed = sized.withColumn("_src", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    by = targets.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("_src"), "source_size", "target", "n")
    joined = common.heavy_join(keyed, by, ["_src"], F.col("doc_id"))
    rate = F.least(F.lit(float(cap)), F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0)))
    whole = F.floor(rate)
    copies = whole + (F.col("u") < rate - whole).cast("long")
    return joined.withColumn("copies", copies.cast("long")).drop("_src", "n", "u")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row as often as its copies, with docs' own columns."""
    return with_copies(docs, **options).where("copies > 0").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return with_copies(docs).select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("size") * F.col("copies")).alias("taken"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT] AS w FROM d GROUP BY source),
o AS (SELECT *, 3.0 * source_size AS most, 3.0 * source_size / w AS filled FROM s),
p AS (SELECT *, coalesce(sum(most) OVER (ORDER BY filled, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone,
             sum(w) OVER (ORDER BY filled, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM o),
l AS (SELECT min((SELECT sum(source_size) FROM s) - gone) AS x, arg_min(((SELECT sum(source_size) FROM s) - gone) / free, filled) FILTER (((SELECT sum(source_size) FROM s) - gone) / free <= filled) AS level FROM p),
t AS (SELECT source, source_size, least(most, w * (SELECT level FROM l)) AS target FROM o),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, least(3.0, coalesce(t.target / nullif(t.source_size, 0), 0)) AS rate,
             ('0x' || substr(md5('mix-1|' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0 AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS taken FROM r
"""
