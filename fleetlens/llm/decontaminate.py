"""Benchmark decontamination by templates: numbers, names and units become typed slots; windows of templates are
hash-joined, and slot values must map one to one, so that questions with other parameters are caught."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WINDOW, MIN_LITERALS, COVERAGE, VERBATIM = 8, 3, 0.5, 6
FILTER_BITS, FILTER_SHIFTS = 24, (0, 30)
#: Windows of items are broadcast up to so many bytes, else joined by shuffle.
BROADCAST_BYTES = 64 << 20
PUNCTUATION = b".,;:!?\"'()[]{}<>*#|_"
NUMBER = re.compile(rb"[+-]?[$\xc2\xa3]?\d[\d.,:/]*%?$")
#: Units of measure and of currency (fixed values).
UNITS = frozenset(
    b"% mm cm m km in ft yd mi mg g kg t lb oz ml l s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years"
    b" stunde stunden tag tage woche wochen monat monate jahr jahre meter heure heures jour jours semaine semaines mois an ans"
    b" hora horas dia dias semana semanas mes meses metro metros euros usd eur gbp dollar dollars cent cents euro euros pound pounds hz khz mhz w kw mw v kv a ma j kj pa kpa bar psi c f k b kb mb gb tb px mph kmh degrees percent".split()
)
LITERAL, NUM, UNIT, NAME, SKIP = range(5)
_SLOT = np.array([xxhash.xxh3_64_intdigest(x) for x in (b"", b"<number>", b"<unit>", b"<name>")], np.uint64)
WINDOWS = "row long, doc_id long, pos int, size int, h long, slots array<string>"


class Kinds(dict):
    """By word: its hash, with its kind in bits 0-2 and whether it ends a sentence in bit 3."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        bare = word.strip(PUNCTUATION)
        kind = LITERAL
        if not bare:
            kind = SKIP
        elif NUMBER.match(bare):
            kind = NUM
        elif bare.lower() in UNITS:
            kind = UNIT
        elif bare[:1].isupper() and not (len(bare) > 1 and bare.isupper()):
            kind = NAME
        ends = word.rstrip(b"\"')]")[-1:] in (b".", b"!", b"?", b":")
        h = self[word] = xxhash.xxh3_64_intdigest(bare.lower()) >> 4 << 4 | ends << 3 | kind
        return h


def template(words: list[bytes], kinds: Kinds) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and kinds of the template's tokens, each one's place in words, and hashes of the words themselves.

    A capital makes a name inside a sentence only; a unit counts behind a number only; all capitals are plain words.
    """
    code = np.fromiter(map(kinds.__getitem__, words), np.uint64, len(words))
    kind, ends = (code & np.uint64(7)).astype(np.int8), (code & np.uint64(8)) > 0
    at = np.flatnonzero(kind != SKIP)
    exact, kind, ends = code[at] >> np.uint64(4), kind[at], ends[at]
    h = exact
    if len(at):
        after = np.concatenate([[True], ends[:-1]])
        behind = np.concatenate([[False], kind[:-1] == NUM])
        kind = np.where((kind == NAME) & after | (kind == UNIT) & ~behind, LITERAL, kind)
        h = np.where(kind == LITERAL, h, _SLOT[kind])
    return h, kind, at, exact


def windows(h: np.ndarray, kind: np.ndarray, size: int, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of windows: of the template, or of the words themselves (exact) where few are literal."""
    if len(h) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    literal = np.concatenate([[0], np.cumsum(kind == LITERAL)])
    keys = common.shingles(h, size)
    poor = np.flatnonzero(literal[size:] - literal[:-size] < min(MIN_LITERALS, size))
    if len(poor):
        e = np.full(len(poor), size, np.uint64)
        for k in range(size):
            e = common.mix(e + exact[poor + k])
        keys[poor] = e
    return np.arange(len(keys)), keys


def template_windows(docs: DataFrame, sizes: list[int], bitmap: np.ndarray | None = None) -> DataFrame:
    """docs (doc_id, text) -> row, doc_id, pos, size, h, slots of windows; with a bitmap only those whose bit is set.

    slots has a window's slot values as kind, place and lower-cased text.
    """
    given = docs.sparkSession.sparkContext.broadcast(bitmap)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        kinds, bits, row = Kinds(), given.value, TaskContext.get().partitionId() << 40
        for b in common.slices(batches):
            out: list[list] = [[] for _ in range(6)]
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                h, kind, at, exact = template(words, kinds)
                for size in sizes if bits is not None else [min(WINDOW, len(h))] if len(h) else []:
                    pos, keys = windows(h, kind, size, exact)
                    if bits is not None:
                        for shift in FILTER_SHIFTS:
                            low = (keys >> np.uint64(shift) & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
                            hit = bits[low >> 3] >> (low & 7).astype(np.uint8) & 1 > 0
                            pos, keys = pos[hit], keys[hit]
                    for p, k in zip(pos.tolist(), keys.view(np.int64).tolist(), strict=True):
                        slots = [f"{kind[i]}{i - p} {words[at[i]].strip(PUNCTUATION).lower().decode('utf-8', 'replace')}" for i in range(p, p + size) if kind[i]]
                        for column, x in zip(out, (row, doc_id, p, size, k, slots), strict=True):
                            column.append(x)
                row += 1
            kinds_of = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds_of, strict=True)], names=["row", "doc_id", "pos", "size", "h", "slots"])

    return docs.select("doc_id", "text").mapInArrow(find, WINDOWS)


def bitmap_of(items: DataFrame) -> np.ndarray:
    """A filter of 2^FILTER_BITS bits with two bits of each window set: of one size, however many items there are."""
    bit = lambda shift: F.shiftrightunsigned("h", shift).bitwiseAND((1 << FILTER_BITS) - 1)
    low = items.select(F.explode(F.array(*map(bit, FILTER_SHIFTS))).alias("low"))
    rows = low.groupBy(F.shiftright("low", 15).alias("b")).agg(F.bitmap_construct_agg(F.pmod("low", F.lit(1 << 15))).alias("bits")).collect()
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for b, bits in rows:
        out[b << 12 : (b + 1) << 12] = np.frombuffer(bytes(bits), np.uint8)
    return out


def item_windows(benchmark: DataFrame, coverage: float, verbatim: int) -> DataFrame:
    """Windows of the items, and which of them are seeds.

    A pair needs `need` matched windows at least, so one of any windows - need + 1 of the item's is among them. The
    seeds are the rarest so many, by the number of windows with their hash among all items: templates that many items
    share are looked for only in pairs that a seed has found.
    """
    items = common.stored(template_windows(benchmark.select(F.col("item_id").cast("long").alias("doc_id"), "text"), [WINDOW]))
    rich = F.col("size") - F.size("slots") >= F.least(F.lit(MIN_LITERALS), "size")
    per = items.groupBy("row").agg(F.count("*").alias("windows"), F.count_if(rich).alias("rich_windows"))
    common_n = items.groupBy("h").agg(F.count("*").alias("alike"))
    need = F.least(F.ceil(F.col("windows") * coverage), F.when(F.col("rich_windows") > 0, F.ceil(F.col("rich_windows") * coverage)), F.lit(verbatim).cast("long"))
    ranked = items.join(per, "row").join(common_n, "h").withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy("alike", "pos")))
    return ranked.select(
        F.col("row").alias("item_row"), F.col("doc_id").alias("item_id"), F.col("pos").alias("item_pos"), "h", "size", F.col("slots").alias("item_slots"), rich.alias("rich"), "windows", "rich_windows",
        (F.col("rank") <= F.col("windows") - F.greatest(F.lit(1).cast("long"), need) + 1).alias("seed"),
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, verbatim: int = VERBATIM) -> DataFrame:
    """Pairs (doc_id, item_id) with windows, matched, exact, coverage: what the row's text holds of the item.

    A pair counts if windows of one alignment whose slots map one to one cover at least `coverage` of the item's
    windows, or `verbatim` windows of any one alignment match with equal slots. Windows with fewer than three plain
    words match only with equal slots: they count for the share of all windows, and the share of the others alone
    suffices too (coverage is the larger share). Items of fewer than eight tokens are one window. Null and empty texts,
    and items without words, match nothing. Repeated rows and doc_ids give one pair. Whole texts are searched.
    """
    items = common.stored(item_windows(benchmark, coverage, verbatim))
    sizes = sorted(r.size for r in items.select("size").distinct().collect()) or [WINDOW]
    found = common.stored(template_windows(docs, sizes, bitmap_of(items)))
    held = items.agg(F.sum(F.octet_length(F.concat_ws(" ", "item_slots")) + 100)).first()[0] or 0
    equal = F.col("slots") == F.col("item_slots")
    matches = (F.size("slots") == F.size("item_slots")) & (F.col("rich") | equal)
    seeds = items.where("seed").drop("seed", "size")
    if held <= BROADCAST_BYTES:
        seeded = found.join(F.broadcast(seeds), "h")
    else:
        # A window that many texts hold is dealt to many tasks; one that many items hold is in parts of 64.
        parts = seeds.withColumn("part", F.floor((F.row_number().over(Window.partitionBy("h").orderBy("item_row", "item_pos")) - 1) / 64))
        names = [c for c in seeds.columns if c != "h"]
        parts = parts.groupBy("h", "part").agg(F.collect_list(F.struct(*names)).alias("of"))
        asked = found.join(seeds.groupBy("h").agg(F.ceil(F.count("*") / 64).alias("parts")), "h").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
        asked = common.stored(asked)
        counted = common.stored(parts.join(asked.groupBy("h", "part").agg(F.count("*").alias("n")), ["h", "part"]))
        seeded = common.heavy_join(asked, counted, ["h", "part"], F.col("row")).select(*found.columns, F.explode("of").alias("i")).select(*found.columns, "i.*")
    seeded = common.stored(seeded.where(matches).select(*found.columns, *[c for c in seeds.columns if c != "h"]))
    pairs = seeded.select("row", "item_row").distinct()
    others = items.where("NOT seed").drop("seed", "size")
    rest = pairs.join(F.broadcast(others) if held <= BROADCAST_BYTES else others, "item_row").join(found, ["row", "h"]).where(matches)
    return _judged(seeded.unionByName(rest.select(*seeded.columns)), coverage, verbatim)


def _judged(pairs: DataFrame, coverage: float, verbatim: int) -> DataFrame:
    mapped = F.transform(F.arrays_zip("item_slots", "slots"), lambda x: F.struct(F.concat(F.substring(x["item_slots"], 1, 1), F.substring_index(x["item_slots"], " ", -1)).alias("a"), F.concat(F.substring(x["slots"], 1, 1), F.substring_index(x["slots"], " ", -1)).alias("b")))
    # Both kinds of windows may meet in one alignment; a window without plain words must be equal and maps nothing.
    found_rich = F.when(F.col("rich"), F.col("item_pos"))
    # One alignment of one item has no more windows than the item.
    aligned = pairs.groupBy("row", "doc_id", "item_row", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(
        F.first("windows").alias("windows"), F.first("rich_windows").alias("rich_windows"), F.collect_set(found_rich).alias("rich_places"), F.collect_set(F.when(~F.col("rich"), F.col("item_pos"))).alias("poor_places"),
        F.count_if(F.col("slots") == F.col("item_slots")).alias("exact"), F.array_distinct(F.flatten(F.collect_set(F.when(F.col("rich"), mapped)))).alias("map"),
    )
    one_to_one = (F.size("map") == F.size(F.array_distinct(F.transform("map", lambda m: m["a"])))) & (F.size("map") == F.size(F.array_distinct(F.transform("map", lambda m: m["b"]))))
    places = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c))))
    both = aligned.withColumn("rich_places", F.when(one_to_one, F.col("rich_places")).otherwise(F.array().cast("array<int>"))).groupBy("row", "doc_id", "item_id", "item_row").agg(
        F.first("windows").alias("windows"), F.first("rich_windows").alias("rich_windows"), places("rich_places").alias("rich_matched"), places("poor_places").alias("poor_matched"), F.max("exact").alias("exact")
    ).withColumn("matched", F.col("rich_matched") + F.col("poor_matched"))
    share = F.greatest(F.col("matched") / F.col("windows"), F.when(F.col("rich_windows") > 0, F.col("rich_matched") / F.col("rich_windows")))
    kept = both.where((share >= coverage) | (F.col("exact") >= verbatim))
    return kept.groupBy("doc_id", "item_id").agg(F.max("windows").cast("long").alias("windows"), F.max("matched").cast("long").alias("matched"), F.max("exact").alias("exact"), F.max(share).alias("coverage"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs but for rows whose doc_id holds a benchmark item."""
    bad = contaminated(docs, benchmark).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("_bad")), "left_anti")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return contaminated(docs, common.table(spark, sf_dir, "benchmark").select("item_id", "text"))
