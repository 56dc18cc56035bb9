"""TF-IDF over one- and two-word terms and cosine retrieval, as joins and aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import stored
from . import packs


#: Common English words that say nothing of a text's subject.
STOP_WORDS = tuple(
    "about above after again all also although always am among an and any are as at be because been before being below between both but by can could did do does doing down during each either else ever every few for"
    " from further had has have having he her here hers him his how however if in into is it its itself just less many may me might more most much must my neither never no nor not now of off often on once one only"
    " or other others our ours out over own perhaps per quite rather same several she should since so some still such than that the their theirs them then there therefore these they this those though through thus"
    " to together too toward under until up upon us very was we well were what when where whether which while who whom whose why will with within without would yet you your yours".split()
)


def words_of(text: Column, least: int = 2) -> Column:
    """Lower-cased words of letters and digits, at least `least` long and no stop words."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: (F.char_length(w) >= least) & ~w.isin(*STOP_WORDS))


def between(items: Column, first: Callable[[Column], Column] = lambda x: x, second: Callable[[Column], Column] = lambda x: x) -> Column:
    """Pairs of neighbours in an array: first of the one and second of the next."""
    at = lambda i: F.element_at(items, i.cast("int"))
    return F.when(F.size(items) > 1, F.transform(F.sequence(F.lit(1), F.size(items) - 1), lambda i: F.concat_ws(" ", first(at(i)), second(at(i + 1))))).otherwise(F.array().cast("array<string>"))


def terms(docs: DataFrame, id_: str, text: str, least: int = 2) -> DataFrame:
    """id, term, tf: words_of() the text and pairs of neighbours among them. The texts are dealt by id, so that their terms are
    counted where they arise."""
    docs = docs.select(F.col(id_).alias("id"), F.col(text).alias("_t")).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    w = F.col("_w")
    return docs.select("id", words_of(F.col("_t"), least).alias("_w")).select("id", F.explode(F.concat(w, between(w))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def idf_of(t: DataFrame, total: DataFrame) -> DataFrame:
    """term, df, idf of terms(): ln((1 + n) / (1 + df)) + 1. total has one row with the number of texts, n."""
    df = t.groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(total)).select("term", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def weighted(t: DataFrame, idf: DataFrame) -> DataFrame:
    """id, term, weight, df: (1 + ln tf) idf, each text scaled to length 1. Terms without an idf do not count."""
    raw = t.join(idf, "term").withColumn("weight", (1 + F.log("tf")) * F.col("idf"))
    norm = raw.groupBy("id").agg(F.sqrt(F.sum(F.pow("weight", 2))).alias("norm"))
    return raw.join(norm, "id").select("id", "term", (F.col("weight") / F.col("norm")).alias("weight"), "df")


def tfidf(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """id, term, weight, df of the texts by their own idf."""
    t = terms(docs, id_, text)
    return weighted(t, idf_of(t, docs.agg(F.count("*").alias("n"))))


#: Postings that one task reads of a term; a term's first postings that seed a query; texts that bound its k-th score.
POSTINGS, SEED, SEEDS = 100_000, 64, 16
SLACK = 1e-9


def bounded(queries: DataFrame, index: DataFrame) -> DataFrame:
    """query_id, term, qw, df, before (postings of the query's rarer terms), rest: what this term and the more frequent
    ones can add to a text's score at most, by the largest weights of their postings and by their length."""
    most = index.groupBy("term").agg(F.max("weight").alias("most"), F.max("df").alias("df"))
    q = queries.select(F.col("id").alias("query_id"), "term", F.col("weight").alias("qw")).join(most, "term")
    rare = Window.partitionBy("query_id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
    frequent = Window.partitionBy("query_id").orderBy(F.col("df").desc(), F.col("term").desc())
    rest = F.least(F.sum(F.col("qw") * F.col("most")).over(frequent), F.sqrt(F.sum(F.col("qw") * F.col("qw")).over(frequent)))
    return q.select("query_id", "term", "qw", "df", F.coalesce(F.sum("df").over(rare), F.lit(0)).alias("before"), rest.alias("rest"))


def posted(q: DataFrame, index: DataFrame) -> DataFrame:
    """query_id, id, part: what the terms of q (query_id, term, qw, df) give to each text that has one of them.

    A term with many postings is dealt to several tasks by the texts' ids.
    """
    shares = F.greatest(F.lit(1), F.ceil(F.col("df") / F.lit(POSTINGS))).cast("int")
    asked = q.withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1))).select("query_id", "term", "qw", "share")
    held = index.select("id", "term", "weight", F.pmod(F.xxhash64("id"), shares).cast("int").alias("share"))
    return asked.join(held, ["term", "share"]).where("id <> query_id").groupBy("query_id", "id").agg(F.sum(F.col("qw") * F.col("weight")).alias("part"))


def completed(pairs: DataFrame, q: DataFrame, index: DataFrame) -> DataFrame:
    """pairs (query_id, id, part) with score: part and what the terms of q, which part does not have, add."""
    more = pairs.select("query_id", "id").join(q.select("query_id", "term", "qw"), "query_id").join(index.select("id", "term", "weight"), ["id", "term"])
    more = more.groupBy("query_id", "id").agg(F.sum(F.col("qw") * F.col("weight")).alias("more"))
    return pairs.join(more, ["query_id", "id"], "left").select("query_id", "id", F.round(F.col("part") + F.coalesce("more", F.lit(0.0)), 9).alias("score"))


def placed(scores: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def reached(queries: DataFrame, index: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """pairs (query_id, id, part) that can be among a query's k best, and the terms (query_id, term, qw) that part lacks.

    Terms are taken from the rarest on. The texts that a query's rarest terms lead to are scored in full; the k-th of these
    scores is a bound that the answer cannot fall below. A term is needed as long as it and the more frequent ones together
    can reach the bound; a text that only meets terms beyond never gets there, nor does one whose part falls short of
    it by more than those can add.
    """
    q = stored(bounded(queries, index))
    first = q.where(F.col("before") < SEED)
    seeds = placed(posted(first, index).withColumnRenamed("part", "score"), max(SEEDS, k)).withColumnRenamed("score", "part").drop("rank")
    bound = placed(completed(seeds, q.where(F.col("before") >= SEED), index), k).where(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
    judged = q.join(bound, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(0.0)) - SLACK)
    judged = stored(judged)
    needed, beyond = judged.where(F.col("rest") >= F.col("bound")), judged.where(F.col("rest") < F.col("bound"))
    room = judged.groupBy("query_id").agg(F.first("bound").alias("bound"), F.coalesce(F.max(F.when(F.col("rest") < F.col("bound"), F.col("rest"))), F.lit(0.0)).alias("room"))
    pairs = posted(needed, index).join(room, "query_id").where(F.col("part") + F.col("room") >= F.col("bound"))
    return pairs.select("query_id", "id", "part"), beyond.select("query_id", "term", "qw")


def cosine_topk(queries: DataFrame, index: DataFrame, k: int = 3, threshold: float | None = 0.08) -> DataFrame:
    """query_id, id, score, rank: the k nearest by cosine of queries whose nearest reaches the threshold (None: of all).

    Both sides are (id, term, weight) with vectors of length 1, index with df too; a row is no answer to itself. Ties go to
    the smaller id. Texts that share no term with a query are no answers. Exact; see reached() for what is left out.
    """
    pairs, beyond = reached(queries, index, k)
    ranked = placed(completed(pairs, beyond, index), k)
    if threshold is None:
        return ranked
    best = F.first("score").over(Window.partitionBy("query_id").orderBy("rank"))
    return ranked.withColumn("_best", best).where(F.col("_best") >= threshold).drop("_best")


#: Texts of a pack, and queries that meet it at once.
BLOCK, CHUNK = 8_192, 4_096


def nearest_texts(docs: DataFrame, id_: str, text: str, asking: DataFrame, query_id: str, ask: str, k: int = 3, threshold: float | None = None, same: bool = False) -> DataFrame:
    """query_id, id, score, rank as of cosine_topk() over the tfidf() of docs and the queries by the texts' idf.

    same: queries are texts of docs and no answers to themselves. All texts are compared with all queries that they share a
    term with, which is quadratic in time; see packs for how. Neither terms of texts nor pairs are shuffled as rows. Texts and
    queries without an id count, but are no answers and ask nothing.
    """
    texts = docs.select(F.col(id_).alias("id"), F.lit(None).cast("int").alias("slide_no"), F.col(text).alias("content"))
    ranked = packs.Index(texts, asking.select(F.col(query_id).alias("id"), F.col(ask).alias("content")), None, 0, BLOCK, CHUNK, STOP_WORDS, 2).nearest(k, same)
    if threshold is None:
        return ranked
    best = F.first("score").over(Window.partitionBy("query_id").orderBy("rank"))
    return ranked.withColumn("_best", best).where(F.col("_best") >= threshold).drop("_best")


#: The source of the cases that answer.
VERIFIED = "real_rca_backed"


def verified_cases(slides: DataFrame, verified: str = VERIFIED) -> DataFrame:
    """case_no, told (slide_no, content in the order of the slides) and slides, their number; of verified sources only.

    slides: case_no, slide_no, source_type, title, content. Null contents are empty. Slides without a case are none.
    """
    kept = slides.where((F.col("source_type") == verified) & F.col("case_no").isNotNull()).withColumn("content", F.coalesce("content", F.lit("")))
    told = kept.groupBy("case_no").agg(F.sort_array(F.collect_list(F.struct("slide_no", "content"))).alias("told"))
    return told.withColumn("slides", F.size(F.array_distinct(F.filter(F.col("told.slide_no"), lambda n: n.isNotNull()))).cast("long"))


def _first_of_slide(told: Column, p: Column) -> Column:
    """Whether place p of a case is the first with its slide_no; further ones belong to the case, but are no slides."""
    return (p == 0) | ~F.get(told, p - 1)["slide_no"].eqNullSafe(F.get(told, p)["slide_no"])


def case_terms(cases: DataFrame) -> DataFrame:
    """id (the case), term, tf, at: terms of the cases' whole texts, and how often each of their slides has them (p, its
    place, and n). Pairs from one slide to the next are in no slide. All of a case's terms are counted in one task."""
    words = cases.select(F.col("case_no").alias("id"), "told", F.transform("told", lambda t: words_of(t["content"])).alias("_w"))
    each = F.transform("_w", lambda w, p: F.struct(F.when(_first_of_slide(F.col("told"), p), p).otherwise(-1).alias("p"), F.concat(w, between(w)).alias("t")))
    across = F.struct(F.lit(-1).alias("p"), between(F.filter("_w", lambda w: F.size(w) > 0), lambda w: F.element_at(w, -1), lambda w: F.element_at(w, 1)).alias("t"))
    long = words.select("id", F.explode(F.concat(each, F.array(across))).alias("x")).select("id", "x.p", F.explode("x.t").alias("term"))
    counts = long.groupBy("id", "term", "p").agg(F.count("*").alias("n"))
    return counts.groupBy("id", "term").agg(F.sum("n").alias("tf"), F.collect_list(F.when(F.col("p") >= 0, F.struct("p", "n"))).alias("at"))


def case_weights(t: DataFrame, asked: DataFrame, total: DataFrame) -> DataFrame:
    """Terms of cases and queries, stored: query_id, id, asks, code, both (whether cases and queries have the term), tf, at, v by
    the cases' idf, and idf, that of the slides (null in terms that no slide has).

    t: case_terms(), asked: terms(), total: n (cases) and m (slides). Cases and slides go through one shuffle together.
    """
    query, id_, at = asked.schema["id"].dataType, t.schema["id"].dataType, t.schema["at"].dataType
    rows = t.select(F.lit(None).cast(query).alias("query_id"), "id", "term", "tf", "at", F.lit(False).alias("asks"))
    rows = rows.unionByName(asked.select(F.col("id").alias("query_id"), F.lit(None).cast(id_).alias("id"), "term", "tf", F.lit(None).cast(at).alias("at"), F.lit(True).alias("asks")))
    rows = rows.repartition("term").withColumn("u", F.monotonically_increasing_id())
    w = Window.partitionBy("term")
    over = {"code": F.min("u"), "df": F.count(F.when(~F.col("asks"), 1)), "sdf": F.sum(F.size(F.coalesce("at", F.array().cast(at)))), "both": F.max("asks")}
    rows = rows.select("query_id", "id", "asks", "tf", "at", *[c.over(w).alias(n) for n, c in over.items()]).where("df > 0").crossJoin(F.broadcast(total))
    idf = lambda n, df: F.log((1 + F.col(n)) / (1 + F.col(df))) + 1
    return stored(rows.select("query_id", "id", "asks", "code", "both", "tf", "at", ((1 + F.log("tf")) * idf("n", "df")).alias("v"), F.when(F.col("sdf") > 0, idf("m", "sdf")).alias("idf")))


def retrieve_cases(queries: DataFrame, slides: DataFrame, k: int = 3, threshold: float = 0.08, excerpt: int = 700) -> DataFrame:
    """query_id, rank, case_no, score, status, slides, evidence_slide, evidence_score, excerpt: the k verified cases most
    like each query that may be answered, and the slide of each case that speaks for it.

    queries: query_id, text, level, quality; answered are those whose level is not NORMAL and whose quality is PASS. Weights
    are those of the cases; a query's other words do not count. Status is VERIFIED_PRECEDENT on rank 1 from the threshold
    on, else BELOW_THRESHOLD. The evidence is the case's slide most like the query by the slides' own weights, the first
    of equals; without a common word it is the first slide. Cases without a common word are not listed.
    """
    kept = slides.where((F.col("source_type") == VERIFIED) & F.col("case_no").isNotNull()).select(F.col("case_no").alias("id"), "slide_no", F.coalesce("content", F.lit("")).alias("content"))
    n, m = kept.groupBy("id", "slide_no").agg(F.lit(1).alias("one")).groupBy("id").agg(F.count("*").alias("m")).agg(F.count("*"), F.coalesce(F.sum("m"), F.lit(0))).first()
    asked = queries.where((F.col("level") != "NORMAL") & (F.col("quality") == "PASS")).select(F.col("query_id").alias("id"), F.col("text").alias("content"))
    found = packs.Index(kept, asked, n, m, BLOCK, CHUNK, STOP_WORDS, 2, excerpt).nearest(k, quoted=True)
    status = F.when((F.col("rank") == 1) & (F.col("score") >= threshold), "VERIFIED_PRECEDENT").otherwise("BELOW_THRESHOLD")
    return found.select("query_id", "rank", F.col("id").alias("case_no"), "score", status.alias("status"), "slides", F.col("slide_no").alias("evidence_slide"), F.col("slide_score").alias("evidence_score"), "excerpt")
