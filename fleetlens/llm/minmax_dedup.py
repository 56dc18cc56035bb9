"""MinHash near-deduplication with min-max hashing: each permutation gives its minimum and its maximum."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WORDS, SIMILARITY = 5, (75, 100)
#: 64 permutations give 128 values, cut into 42 bands of 3: a pair at 0.75 shares no band in 1 of 10^10 cases.
PERMUTATIONS, BAND_ROWS = 64, 3
BANDS = 2 * PERMUTATIONS // BAND_ROWS
#: A set that is compared with many others goes to so many tasks at most.
CHUNKS = 1024
_SEED = np.random.default_rng(20240501)
MULTIPLIERS = _SEED.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _SEED.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)


def shingle_set(words: np.ndarray) -> np.ndarray:
    return np.unique(common.shingles(words, WORDS))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum and maximum under each permutation, interleaved so that no band has both of one permutation twice."""
    low, high = np.full(PERMUTATIONS, np.iinfo(np.uint64).max), np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(shingles), 512):  # a block of all permutations stays in the cache
        h = MULTIPLIERS[:, None] * shingles[at : at + 512] + OFFSETS[:, None]
        h ^= h >> np.uint64(29)
        np.minimum(low, h.min(1), out=low)
        np.maximum(high, h.max(1), out=high)
    return np.concatenate([low, high])


def bands_of(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band."""
    rows = sig[: BANDS * BAND_ROWS].reshape(BAND_ROWS, BANDS)
    h = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for r in rows:
        h = common.mix(h + r)
    return h.view(np.int64)


def key_of(shingles: bytes) -> bytes | None:
    """A digest of a whole set; of the empty set there is none."""
    return hashlib.blake2b(shingles, digest_size=16).digest() if shingles else None


def signed(docs: DataFrame) -> DataFrame:
    """row id fields: doc_id, n_shingles, set_key (digest of the full set), bands (null where there is no word)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = common.WordHashes()
        for b in common.slices(batches):
            n, keys, bands = [], [], []
            for text in b.column(1):
                s = shingle_set(hashes.of(text.as_py()))
                n.append(len(s))
                keys.append(key_of(s.tobytes()))
                bands.append(bands_of(signature(s)) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_key", "bands"])

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def sets_of(docs: DataFrame) -> DataFrame:
    """doc_id, set_key and the sorted 64-bit shingle hashes of the whole text, as bytes."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = common.WordHashes()
        for b in common.slices(batches):
            found = [shingle_set(hashes.of(t.as_py())).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(key_of, found), pa.binary()), pa.array(found, pa.binary())], names=["doc_id", "set_key", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(build, "doc_id long, set_key binary, shingles binary")


def attached(pairs: DataFrame, sets: DataFrame, **sides: str) -> DataFrame:
    """pairs with the sets of two columns, each by the name it is given.

    A set with many partners goes once to each of CHUNKS chunks of these, so that no task meets all pairs of one set,
    whichever side of the pairs it is on. pairs is read three times: a stored table.
    """
    out = pairs
    for (key, name), other in zip(sides.items(), reversed(list(sides)), strict=True):
        chunk = F.pmod(F.xxhash64(other), F.lit(CHUNKS)).alias("_chunk")
        once = pairs.select(key, chunk).distinct().join(sets.select(F.col("id").alias(key), F.col("shingles").alias(name)), key)
        out = out.withColumn("_chunk", chunk).join(once, [key, "_chunk"]).drop("_chunk")
    return out


def linked(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """Of pairs (a, b) those whose full sets are similar enough."""
    both = attached(common.stored(pairs), sets, a="sa", b="sb")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, whole = similarity
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if min(len(x), len(y)) * whole >= part * max(len(x), len(y)):
                    common_n = np.intersect1d(x, y, assume_unique=True).size
                    if whole * common_n >= part * (len(x) + len(y) - common_n):
                        keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], names=["a", "b"])

    return both.select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (id) -> id, label: the smallest id reachable over edges (a, b).

    Labels move along edges, then each takes its label's label; both steps aggregate before they shuffle. The rounds
    end when no label changes, after about the logarithm of the longest path.
    """
    both = common.stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    total = both.count()
    labels = common.stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("label"), F.count("*").alias("n")))
    while total:
        # A hub's edges and a component's members are dealt to many tasks.
        at = common.heavy_join(both, labels.select(F.col("id").alias("a"), "label", "n"), ["a"], F.col("b"), total=total)
        near = at.groupBy(F.col("b").alias("id")).agg(F.min("label").alias("near"))
        moved = common.stored(labels.join(near, "id").select("id", "n", "label", F.least("label", "near").alias("new")))
        jump = moved.groupBy("new").agg(F.count("*").alias("m")).join(labels.select(F.col("id").alias("new"), F.col("label").alias("far")), "new")
        jumped = common.heavy_join(moved, common.stored(jump), ["new"], F.col("id"), count="m")
        moved = common.stored(jumped.select("id", "n", "label", F.least("new", F.coalesce("far", "new")).alias("new")))
        changed = moved.where("new <> label").limit(1).count()
        labels = moved.select("id", "n", F.col("new").alias("label"))
        if not changed:
            break
    return nodes.select("id").join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("label"))


def near_groups(docs: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id, kept; one row per row of docs.

    Texts of equal sets are one class, and its smallest doc_id goes on for it. In each band's bucket the member with
    most company is paired with all others; pairs are confirmed on full sets. Buckets that still hold several
    components are then searched between these by bounds that no link breaks, so none is missed. Texts without words
    stay alone. Rows that repeat a doc_id count as one document: they are linked by name, whatever their texts, and each
    row keeps its own n_shingles. A null doc_id links nothing and is kept. doc_ids are below 2^62: higher numbers stand
    for further texts of a doc_id.
    """
    rows = common.stored(signed(docs))
    real = rows.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    classes = common.stored(real.groupBy("set_key").agg(F.min("doc_id").alias("doc"), F.count("*").alias("n")))
    many = _docs_of_several_texts(real)
    classes = _named_classes(classes, many)
    # A class's representative carries its bands.
    bands = real.join(classes.select("set_key", "doc", "id"), "set_key").where("doc_id = doc").dropDuplicates(["set_key"])
    buckets = bands.select("id", "n_shingles", F.posexplode("bands").alias("band", "key"))
    sizes = common.stored(buckets.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1"))
    shared = common.stored(common.heavy_join(buckets, sizes, ["band", "key"], F.col("id")).where("n > 1"))
    # The member with most company over all its buckets is nearest to the text that the others are copies of.
    company = common.stored(shared.groupBy("id").agg(F.sum("n").alias("company")))
    ranked = shared.join(company, "id")
    centers = common.stored(ranked.groupBy("band", "key").agg(F.max_by("id", F.struct("company", "id")).alias("center"), F.count("*").alias("n")))
    shared = common.stored(common.heavy_join(shared.drop("n"), centers, ["band", "key"], F.col("id")))
    members = common.stored(shared.select("id").distinct())
    sets = common.stored(_member_sets(docs, members, classes, many))
    if sets.limit(1).count() == 0:
        edges = shared.select(F.col("id").alias("a"), F.col("id").alias("b"))
    else:
        star = lambda x, c: x.where(F.col("id") != F.col(c)).select(F.least("id", c).alias("a"), F.greatest("id", c).alias("b")).distinct()
        edges = common.stored(linked(star(shared, "center"), sets, similarity))
        labels = common.stored(components(members, edges))
        groups = _outside(_pivot_groups(shared, labels, company), sets)
        edges = common.stored(edges.union(linked(_cross_pairs(groups, similarity), sets, similarity)))
    if many is not None:
        named = real.join(many, "doc_id", "left_semi").join(classes.select("set_key", "id"), "set_key").select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
        edges = common.stored(edges.union(named).distinct())
        members = common.stored(members.union(edges.select("a")).union(edges.select("b")).distinct())
    labels = components(members, edges)
    found = common.heavy_join(rows.drop("bands"), classes.select("set_key", F.col("id").alias("class_id"), "n"), ["set_key"], F.coalesce("doc_id", F.lit(0)))
    sized = common.stored(labels.join(classes.groupBy("id").agg(F.sum("n").alias("n")), "id"))
    named = common.heavy_join(found.drop("n").withColumn("id", F.coalesce("class_id", "doc_id")), sized, ["id"], F.coalesce("doc_id", F.lit(0)))
    component = F.coalesce("label", "id")
    return named.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _docs_of_several_texts(real: DataFrame) -> DataFrame | None:
    """doc_id of those whose rows have different sets; None if there are none, as there should be."""
    h = F.xxhash64("set_key")
    many = common.stored(real.groupBy("doc_id").agg(F.min(h).alias("l"), F.max(h).alias("h")).where("l <> h").select("doc_id"))
    return many if many.limit(1).count() else None


def _named_classes(classes: DataFrame, many: DataFrame | None) -> DataFrame:
    """classes with id: the representative's doc_id, or, where that stands for several classes, a number of their own."""
    if many is None:
        return classes.withColumn("id", F.col("doc"))
    marked = classes.join(many.select(F.col("doc_id").alias("doc"), F.lit(True).alias("shared")), "doc", "left")
    own = F.lit(1 << 62) + F.pmod(F.xxhash64("set_key"), F.lit(1 << 62))
    return common.stored(marked.withColumn("id", F.when(F.col("shared"), own).otherwise(F.col("doc"))).drop("shared"))


def _member_sets(docs: DataFrame, members: DataFrame, classes: DataFrame, many: DataFrame | None) -> DataFrame:
    """id, shingles of the members."""
    texts = docs.select("doc_id", "text")
    if many is None:
        wanted = texts.join(members.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
        return sets_of(wanted.dropDuplicates(["doc_id"])).select(F.col("doc_id").alias("id"), "shingles")
    wanted = classes.join(members, "id", "left_semi").select(F.col("doc").alias("doc_id"), "set_key", "id")
    sets = sets_of(texts.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi"))
    return sets.join(wanted, ["doc_id", "set_key"]).dropDuplicates(["id"]).select("id", "shingles")


def _pivot_groups(shared: DataFrame, labels: DataFrame, company: DataFrame) -> DataFrame:
    """pivot, id, label, n_shingles, far of buckets that hold several components; far: not of the pivot's component.

    A component's hub is its member with most company. A bucket's pivot is the hub with most company among those that
    its members meet in any bucket, so that variants of one text have one pivot wherever they meet. Two members of a
    bucket, of which one is its centre, have been compared.
    """
    keys = ["band", "key"]
    labelled = common.stored(shared.join(labels, "id"))
    mixed = labelled.groupBy(*keys).agg(F.min("label").alias("l"), F.max("label").alias("h"), F.count("*").alias("m")).where("l <> h AND m > 2").select(*keys, "m")
    mixed = common.stored(mixed)
    open_ = common.stored(common.heavy_join(labelled, mixed, keys, F.col("id"), count="m").where("m IS NOT NULL"))
    hubs = labels.join(company, "id").groupBy("label").agg(F.max(F.struct("company", F.col("id").alias("pivot"), F.col("label").alias("own"))).alias("hub"))
    met = common.stored(open_.where("id = center").join(hubs, "label").select(*keys, "hub", "m"))
    guide = common.heavy_join(open_.drop("m"), met, keys, F.col("id"), count="m").groupBy("id").agg(F.max("hub").alias("hub"))
    pivots = common.stored(open_.join(guide, "id").groupBy(*keys).agg(F.max("hub").alias("hub"), F.max("m").alias("m")))
    found = common.heavy_join(open_.drop("m"), pivots, keys, F.col("id"), count="m")
    return found.select(F.col("hub.pivot").alias("pivot"), "id", "label", "n_shingles", (F.col("label") != F.col("hub.own")).alias("far")).distinct()


def _outside(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """groups with inside, the number of the set's shingles that the pivot has, and outside, the other shingles."""
    both = attached(common.stored(groups), sets, id="si", pivot="sp")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.setdiff1d(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), assume_unique=True).view(np.int64) for x, y in zip(batch.column(5), batch.column(6), strict=True)]
            inside = pa.array(batch.column(3).to_numpy() - np.array([len(x) for x in found], np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], inside, pa.array(found, pa.list_(pa.int64()))], names=["pivot", "id", "label", "n_shingles", "far", "inside", "outside"])

    return both.select("pivot", "id", "label", "n_shingles", "far", "si", "sp").mapInArrow(part, "pivot long, id long, label long, n_shingles long, far boolean, inside long, outside array<long>")


def _cross_pairs(groups: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of one pivot's group, of different components, whose sets can be similar enough.

    Sets of m and n shingles need an overlap of similarity / (1 + similarity) * (m + n). What two sets share lies inside
    the pivot, where it is no more than either has there, or outside it. So a pair either has enough inside alone (found
    by size), or shares shingles outside, at least as many as its inside leaves open. Of these, rarest first, one must be
    in a prefix of each, and as many as are needed must be left from the first shared one on. Variants of one text share little but the text, hence few pairs come of a large group.
    """
    part, whole = similarity
    rows = common.stored(groups)
    least = common.stored(rows.groupBy("pivot").agg(F.min("n_shingles").alias("least"), F.count("*").alias("m")))
    rows = common.heavy_join(rows, least, ["pivot"], F.col("id"), count="m").drop("m")
    smallest = F.greatest(F.ceil(F.col("n_shingles") * part / whole), F.col("least"))
    need = F.ceil((F.col("n_shingles") + smallest) * part / (whole + part))
    rows = common.stored(rows.withColumn("open", F.greatest(F.lit(1), need - F.col("inside"))))
    named = {c: f"{c}_y" for c in ("id", "label", "n_shingles", "far", "inside")}
    after = F.least("rest", "rest_y")
    renamed = lambda x: x.select("pivot", *[F.col(c).alias(f"{c}_y" if c == "rest" else named.get(c, c)) for c in x.columns if c != "pivot"])
    sizes = F.col("n_shingles") + F.col("n_shingles_y")
    apart = (F.col("label") != F.col("label_y")) & (~F.col("far_y") | (F.col("id") < F.col("id_y")))
    apart &= F.least("n_shingles", "n_shingles_y") * whole >= F.greatest("n_shingles", "n_shingles_y") * part
    inner = F.least("inside", "inside_y")
    pair = (F.least("id", "id_y").alias("a"), F.greatest("id", "id_y").alias("b"))

    each = rows.select("pivot", *named, "open", F.explode("outside").alias("shingle"))
    met = each.groupBy("pivot", "shingle").agg(F.min("label").alias("l"), F.max("label").alias("h"), F.count("*").alias("m")).where("l <> h").select("pivot", "shingle", "m")
    met = common.stored(met)
    each = common.heavy_join(each, met, ["pivot", "shingle"], F.col("id"), count="m").where("m IS NOT NULL")
    own = Window.partitionBy("pivot", "id")
    each = each.withColumn("k", F.row_number().over(own.orderBy("m", "shingle"))).withColumn("of", F.count("*").over(own))
    each = common.stored(each.where("k <= of - open + 1").select("pivot", "shingle", *named, (F.col("of") - F.col("k") + 1).alias("rest")))
    beyond = each.where("far").join(renamed(each), ["pivot", "shingle"]).where(apart & ((inner + after) * (whole + part) >= sizes * part)).select(*pair)

    bin_of = lambda n: F.floor(F.log(n) * 100).cast("int")
    able = rows.where(F.col("inside") * (whole + part) >= (F.col("n_shingles") + smallest) * part)
    ys = able.select("pivot", *named, bin_of(F.col("n_shingles")).alias("bin"))
    counts = common.stored(ys.groupBy("pivot", "bin").agg(F.count("*").alias("m")))
    most = F.least(F.col("n_shingles") * whole / part, F.col("inside") * (whole + part) / part - F.col("n_shingles"))
    xs = able.where("far").select("pivot", *named, F.explode(F.sequence(bin_of(smallest), F.greatest(bin_of(smallest), bin_of(most)))).alias("bin"))
    shares = F.ceil(F.col("m") / F.lit(256))
    xs = common.heavy_join(xs, counts, ["pivot", "bin"], F.col("id"), count="m").where("m IS NOT NULL").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1))).drop("m")
    ys = common.heavy_join(ys, counts, ["pivot", "bin"], F.col("id"), count="m").withColumn("share", F.pmod(F.xxhash64("id"), shares)).drop("m")
    within = xs.join(renamed(ys), ["pivot", "bin", "share"]).where(apart & (inner * (whole + part) >= sizes * part)).select(*pair)
    return beyond.union(within).distinct()


def op5_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
