"""Sources beyond plain tables: pages as ordered sections, matching of documents to master rows, parameter pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What source_type and label_source are called.
BACKED, SUPPORT = "real_rca_backed", "synthetic_support"
FROM_DOCUMENT, GENERATED = "rca_document", "synthetic_generation"


def sections(pages: DataFrame, id_: str = "page_id", html: str = "html") -> DataFrame:
    """One row per paragraph or heading of a page: number, text without tags, its digest. Pages without any give none."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<(?:p|h1|h2|li|title)(?:\s[^>]*)?>(.*?)</(?:p|h1|h2|li|title)>"), F.lit(1))
    rows = pages.select(id_, F.posexplode(found).alias("pos", "raw"))
    text = F.trim(F.regexp_replace(F.regexp_replace("raw", r"<[^>]*>", ""), r"\s+", " "))
    return rows.select(id_, (F.col("pos") + 1).alias("section"), text.alias("content")).where("content <> ''").withColumn("content_sha256", F.sha2("content", 256))


def _visible(html: str) -> Column:
    """Markup without scripts, styles and comments."""
    out = F.coalesce(F.col(html), F.lit(""))
    for hidden in (r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"(?s)<!--.*?-->"):
        out = F.regexp_replace(out, hidden, " ")
    return out


def slides(pages: DataFrame, id_: str = "page_id", html: str = "html") -> DataFrame:
    """A document as slides: id_, slide_number (from 1), section_title, content, content_sha256.

    A slide begins at each heading of the first two levels; what stands before the first is a slide too. Its content is its
    runs of text in order, trimmed, empty ones left out, joined by " | "; the first run is its title. A slide without text has
    an empty title and content; so has a document that is null, which is one such slide. Entities stay as they are written.
    """
    # A control character, which text must not hold, marks where slides begin.
    parts = F.split(F.regexp_replace(F.translate(_visible(html), "\x01", ""), r"(?i)(<h[12][\x09-\x0D\x20>])", "\x01$1"), "\x01")
    rows = pages.select(id_, F.posexplode(parts).alias("_p", "_part"))
    trimmed = F.transform(F.split("_part", r"<[^>]*>"), lambda x: F.regexp_replace(x, r"^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$", ""))
    runs = rows.select(id_, (F.col("_p") + 1).cast("long").alias("slide_number"), F.filter(trimmed, lambda x: x != "").alias("_runs"))
    out = runs.select(id_, "slide_number", F.coalesce(F.try_element_at("_runs", F.lit(1)), F.lit("")).alias("section_title"), F.array_join("_runs", " | ").alias("content"))
    return out.withColumn("content_sha256", F.sha2("content", 256))


def incident_registry(master: DataFrame, documents: DataFrame, number: str, doc: str, text: str, expected: int | None = None) -> DataFrame:
    """master with matches (how many documents hold its number), the source document and its digest if it is one, source_type,
    rca_demo_eligible and label_source.

    documents: one row each, with doc, text and sha256. Numbers are cut from texts by pattern, as match_documents() does, and
    joined. A row is backed by a document if exactly one holds its number. expected: the number of backed rows that must come
    out; then a number in several documents, a document that holds none, and any other count raise. A row without a number
    is backed by none, and a number that several master rows have backs each of them.
    """
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([A-Za-z0-9]+(?:-[A-Za-z0-9]+)*)"), F.lit(1)))
    named = documents.select(F.col(doc).alias("_doc"), F.col("sha256").alias("_sha"), F.explode_outer(found).alias("_n"))
    wanted = master.select(F.col(number).cast("string").alias("_m")).where("_m IS NOT NULL").distinct()
    hits = named.join(wanted, F.col("_n") == F.col("_m"))
    per = hits.groupBy("_m").agg(F.count("*").alias("_k"), F.min(F.struct("_doc", "_sha")).alias("_d"))
    out = master.join(per, F.col(number).cast("string") == F.col("_m"), "left")
    one = F.col("_k") == 1
    backed = F.coalesce(one, F.lit(False))
    registry = out.select(
        *[F.col(c) for c in master.columns], F.coalesce("_k", F.lit(0)).alias("matches"), F.when(one, F.col("_d._doc")).alias("source_document"), F.when(one, F.col("_d._sha")).alias("source_document_sha256"),
        F.when(backed, BACKED).otherwise(SUPPORT).alias("source_type"), backed.alias("rca_demo_eligible"), F.when(backed, FROM_DOCUMENT).otherwise(GENERATED).alias("label_source"),
    )
    if expected is None:
        return registry
    several, count = registry.agg(F.min(F.when(F.col("matches") > 1, F.col(number).cast("string"))), F.count_if("rca_demo_eligible")).first()
    if several is not None:
        raise ValueError(f"several documents hold {several}")
    if count != expected:
        raise ValueError(f"{count} rows are backed by a document, {expected} expected")
    lone = documents.select(F.col(doc).alias("_doc")).join(hits.select("_doc").distinct(), "_doc", "left_anti").limit(1).collect()
    if lone:
        raise ValueError(f"document {lone[0][0]} holds no number of the master")
    return registry


def case_corpus(registry: DataFrame, deck: DataFrame, number: str, doc: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """The slides of the documents that back a registry's rows: document_id ("number:slide:n"), number, the carried columns of
    the row, its source, and the slide's own columns. Slides of other documents are left out."""
    backed = registry.where("rca_demo_eligible").select(F.col(number), *carry, "source_type", F.col("source_document").alias("_doc"), "source_document_sha256")
    rows = deck.join(backed, F.col(doc) == F.col("_doc"))
    name = F.concat(F.col(number).cast("string"), F.lit(":slide:"), F.col("slide_number").cast("string"))
    return rows.select(name.alias("document_id"), number, *carry, "source_type", F.col("_doc").alias("source_document"), "source_document_sha256", "slide_number", "section_title", "content", "content_sha256")


def match_documents(documents: DataFrame, master: DataFrame, text: str, number: str, strict: bool = True) -> DataFrame:
    """documents with matches and the number of the master row that their text holds.

    Candidate numbers are cut from the text by pattern, so this is an equi-join. strict: a document that holds none or
    several of the numbers fails the job; else matches says how many, and number is the least of them or null. A number
    that several master rows have counts once for each. documents has an id of its own per row, or rows are counted anew.
    """
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([A-Za-z0-9]+(?:-[A-Za-z0-9]+)*)"), F.lit(1)))
    keys = documents.columns
    named = documents.select(*keys, F.explode_outer(found).alias("_n"))
    hit = named.join(master.select(F.col(number).cast("string").alias("_m")), F.col("_n") == F.col("_m"), "left")
    out = hit.groupBy(*keys).agg(F.count("_m").alias("matches"), F.min("_m").alias(number))
    if not strict:
        return out
    wrong = F.raise_error(F.concat(F.lit("a document fits "), F.col("matches").cast("string"), F.lit(" master rows")))
    return out.where(F.when(F.col("matches") != 1, wrong.cast("boolean")).otherwise(F.lit(True)))


def pivot_parameters(parameters: DataFrame, key: str, slots: int = 4) -> DataFrame:
    """Rows (key, parameter_no, parameter_name, alarm_value, trip_value) -> one row per key, and whether all slots are there once."""
    p = parameters.groupBy(key).pivot("parameter_no", list(range(1, slots + 1))).agg(F.first("parameter_name").alias("name"), F.first("alarm_value").alias("alarm"), F.first("trip_value").alias("trip"))
    whole = parameters.groupBy(key).agg(((F.count("*") == slots) & (F.count_distinct("parameter_no") == slots)).alias("complete"))
    return p.join(whole, key)
