"""Phrases whose words keep company: counted by tries with hash containers, level by level, scored by their weakest cut.

Phrases of n words are counted in one pass over the texts. A task keeps word ids and a trie whose hash containers hold
ranges of prefixes; what outgrows its memory leaves as sorted runs of whole subtrees, and the runs of all tasks are merged
by prefix partition. From the second word on only phrases count whose two parts of n - 1 words may be frequent (a
filter of bounded size says so; it lets some others through, never one too few), since a phrase is no more frequent than its
parts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

LEAST, MOST_WORDS, TOP, INSIDE_PERCENT = 10, 3, 2000, 50
#: Entries of a container that bursts, and the parts it bursts into; entries of a task's tries, and of its tables of words and prefixes; bytes of a block.
BURST, FAN, ENTRIES, NAMES, BLOCK = 50_000, 8, 1_500_000, 1_000_000, 4 << 20
#: Bits of a filter, by its phrases and at most (32 MB); partitions of a frequent first word's phrases.
BITS_EACH, MOST_BITS, SHARES = 16, 1 << 28, 64
#: Upper case to lower case, tabs to spaces; what ends a piece becomes a full stop, which no word holds.
BYTES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz......... ")
RUNS = "part long, lang string, phrase string, a long"


class HatTrie:
    """Counts by key: prefix id in the upper 32 bits, word id in the lower ones.

    A container (a dictionary) holds a range of prefixes. One with over BURST keys bursts into up to FAN containers of
    about as many keys each, down to single prefixes.
    """

    def __init__(self) -> None:
        self.lows, self.held, self.size = [0], [{}], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """keys are sorted and distinct."""
        edges = np.searchsorted(keys, np.array(self.lows, np.uint64) << np.uint64(32)).tolist() + [len(keys)]
        for i in range(len(self.held) - 1, -1, -1):
            if edges[i] < edges[i + 1]:
                held, new = self.held[i], keys[edges[i] : edges[i + 1]].tolist()
                before = len(held)
                held.update(zip(new, map(add, map(held.get, new, repeat(0)), counts[edges[i] : edges[i + 1]].tolist()), strict=True))
                self.size += len(held) - before
                if len(held) > BURST:
                    self._burst(i)

    def _burst(self, i: int) -> None:
        held = self.held[i]
        keys, counts = np.fromiter(held, np.uint64, len(held)), np.fromiter(held.values(), np.int64, len(held))
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        prefixes = keys >> np.uint64(32)
        # Ranges begin where a prefix does.
        starts = np.unique(np.searchsorted(prefixes, prefixes[np.arange(FAN) * len(keys) // FAN])).tolist()
        if len(starts) > 1:
            ends = [*starts[1:], len(keys)]
            self.held[i : i + 1] = [dict(zip(keys[a:b].tolist(), counts[a:b].tolist(), strict=True)) for a, b in zip(starts, ends, strict=True)]
            self.lows[i + 1 : i + 1] = [int(prefixes[a]) for a in starts[1:]]

    def take(self, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Keys and counts of whole containers, the largest first, until no more than `most` keys are left."""
        while self.size > most:
            i = max(range(len(self.held)), key=lambda k: len(self.held[k]))
            held, self.held[i] = self.held[i], {}
            self.size -= len(held)
            yield np.fromiter(held, np.uint64, len(held)), np.fromiter(held.values(), np.int64, len(held))


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def grown(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases with one word more."""
    return common.mix(h * np.uint64(0x9E3779B97F4A7C15) + word)


def places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a hash in a filter; bits is a power of two."""
    shift = np.uint64(64 - (bits.bit_length() - 1))
    return h >> shift, (h * np.uint64(0xD6E8FEB86659FD93)) >> shift


def may_hold(filter_: np.ndarray, h: np.ndarray) -> np.ndarray:
    one, two = places(h, len(filter_) * 8)
    at = lambda p: filter_[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & 1
    return (at(one) & at(two)).astype(bool)


class Numbers(dict):
    """Ids by name in the order of first appearance."""

    def __init__(self, first: list):
        super().__init__({name: i for i, name in enumerate(first)})
        self.names = list(first)

    def __missing__(self, name):
        i = self[name] = len(self.names)
        self.names.append(name)
        return i


class PhraseCounter:
    """A task's counts of phrases of n words by lang. filter_: bits of the phrases of n - 1 words that may be frequent."""

    def __init__(self, n: int, filter_: np.ndarray | None):
        self.n, self.filter, self.tries = n, filter_, {}
        self._clear()

    def _clear(self) -> None:
        # Word 0 is the end of a piece. prefixes[k] numbers phrases of k + 2 words, as the id of all but the last and the last.
        self.words, self.hashes = Numbers([b"."]), np.zeros(1, np.uint64)
        self.prefixes = [Numbers([]) for _ in range(self.n - 2)]
        self.short: dict[int, int] = {}

    def add(self, lang: str, data: bytes) -> Iterator[pa.RecordBatch]:
        """data: texts with full stops between them, of any length. Yields runs where memory is full."""
        tail = np.zeros(0, np.int64)
        for piece in common.pieces(data.translate(BYTES), BLOCK):
            ids = np.concatenate([tail, self._ids(piece)])
            self._count(lang, ids, len(tail))
            tail = ids[len(ids) - min(len(ids), self.n - 1) :]
            if max(len(self.words.names), *(len(p.names) for p in self.prefixes), 0) > NAMES:
                yield from self.runs(0)
                last = [self.words.names[i] for i in tail]
                self._clear()
                # The next piece goes on after the same words under new ids.
                tail = np.array([self.words[w] for w in last], np.int64)
            else:
                yield from self.runs(ENTRIES)

    def _ids(self, piece: bytes) -> np.ndarray:
        """Word ids in order, a 0 where pieces end. Words of up to 7 bytes are numbers (their bytes and length), of which
        each distinct one is looked up once."""
        data = np.frombuffer(piece + bytes(8), np.uint8)
        stop = data[: len(piece)] == 46
        inside = np.concatenate([[False], ~(stop | (data[: len(piece)] == 32)), [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        size, ids = ends - starts, np.empty(len(starts), np.int64)
        short = size <= 7
        key = np.lib.stride_tricks.sliding_window_view(data, 8)[starts[short]].view("<u8").ravel()
        length = size[short].astype(np.uint64)
        key = key & ((np.uint64(1) << length * np.uint64(8)) - np.uint64(1)) | length << np.uint64(56)
        distinct, inverse = np.unique(key, return_inverse=True)
        known = []
        for k in distinct.tolist():
            i = self.short.get(k)
            if i is None:
                i = self.short[k] = self.words[k.to_bytes(8, "little")[: k >> 56]]
            known.append(i)
        ids[short] = np.array(known, np.int64)[inverse]
        long = np.flatnonzero(~short)
        ids[long] = np.fromiter((self.words[piece[a:b]] for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)), np.int64, len(long))
        stops = np.flatnonzero(stop)
        before = np.searchsorted(stops, starts)
        breaks = np.diff(before, prepend=0) > 0
        last = int(len(stops) > (before[-1] if len(ids) else 0))
        out = np.zeros(len(ids) + int(breaks.sum()) + last, np.int64)
        out[np.arange(len(ids)) + np.cumsum(breaks)] = ids
        return out

    def _count(self, lang: str, ids: np.ndarray, old: int) -> None:
        names = self.words.names
        if len(names) > len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.fromiter(map(word_hash, names[len(self.hashes) :]), np.uint64, len(names) - len(self.hashes))])
        n, m = self.n, len(ids) - self.n + 1
        if m <= 0:
            return
        if n == 1:
            counts = np.bincount(ids)
            counts[0] = 0
            (found,) = np.nonzero(counts)
            if len(found):
                self.tries.setdefault(lang, HatTrie()).add(found.astype(np.uint64) << np.uint64(32), counts[found])
        else:
            # Of phrases of n - 1 words, which may be frequent; then of n words, where both parts may.
            seed = np.uint64(word_hash(lang.encode()))
            if n == 2:
                known = may_hold(self.filter, grown(np.full(len(self.hashes), seed), self.hashes))
                known[0] = False
                known = known[ids]
            else:
                inside = ids > 0
                whole, h = inside.copy(), grown(np.full(len(ids), seed), self.hashes[ids])
                for k in range(1, n - 1):
                    whole = whole[:-1] & inside[k:]
                    h = grown(h[:-1], self.hashes[ids[k:]])
                known = whole
                known[whole] = may_hold(self.filter, h[whole])
            at = np.flatnonzero(known[:m] & known[1 : m + 1])
            prefix, last = ids[at], ids[at + n - 1]
            for k, table in enumerate(self.prefixes):
                packed, inverse = np.unique(prefix << 32 | ids[at + k + 1], return_inverse=True)
                prefix = np.fromiter(map(table.__getitem__, packed.tolist()), np.int64, len(packed))[inverse]
            if len(at):
                keys, counts = np.unique((prefix << 32 | last).astype(np.uint64), return_counts=True)
                self.tries.setdefault(lang, HatTrie()).add(keys, counts)

    def runs(self, most: int) -> Iterator[pa.RecordBatch]:
        """Rows of what has to go, so that all tries together hold `most` keys, half as many once they have more."""
        if sum(t.size for t in self.tries.values()) <= most:
            return
        words = pa.array(self.words.names, pa.binary())
        for lang in sorted(self.tries, key=lambda k: -self.tries[k].size):
            others = sum(t.size for k, t in self.tries.items() if k != lang)
            for keys, counts in self.tries[lang].take(max(0, most // 2 - others)):
                yield from self._run(lang, words, keys, counts)
        for lang in [k for k, t in self.tries.items() if not t.size]:
            del self.tries[lang]

    def _run(self, lang: str, words: pa.Array, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        prefix, last = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        parts = [last] if self.n > 1 else []
        for table in reversed(self.prefixes):
            packed = np.array(table.names, np.int64)[prefix]
            parts.append(packed & 0xFFFFFFFF)
            prefix = packed >> 32
        parts.append(prefix)
        # In the order of the words' hashes, the first word first: the same in all tasks.
        order = np.lexsort([self.hashes[p] for p in parts])
        parts = [p[order] for p in parts]
        phrase = words.take(pa.array(parts[-1]))
        for p in parts[-2::-1]:
            phrase = pc.binary_join_element_wise(phrase, words.take(pa.array(p)), b" ")
        share = self.hashes[parts[0]] % np.uint64(SHARES) if self.n > 1 else np.uint64(0)
        part = (common.mix(self.hashes[parts[-1]] + share + np.uint64(word_hash(lang.encode()))) >> np.uint64(16)).astype(np.int64)
        langs = pa.DictionaryArray.from_arrays(np.zeros(len(keys), np.int32), [lang]).cast(pa.string())
        run = pa.table({"part": pa.array(part), "lang": langs, "phrase": phrase.cast(pa.string()), "a": pa.array(counts[order])})
        yield from run.to_batches(max_chunksize=50_000)


def counted(texts: DataFrame, n: int, filter_: np.ndarray | None = None) -> DataFrame:
    """texts (lang, text, neither null) -> part, lang, phrase, a: phrases of n words and how often they occur."""
    held = texts.sparkSession.sparkContext.broadcast(filter_)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PhraseCounter(n, held.value)
        for batch in batches:
            by_lang: dict[str, list[bytes]] = {}
            sizes: dict[str, int] = {}
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                lang, data = lang.as_py(), text.as_buffer().to_pybytes() if text.as_buffer() else b""
                by_lang.setdefault(lang, []).append(data)
                sizes[lang] = sizes.get(lang, 0) + len(data)
                if sizes[lang] >= BLOCK:
                    yield from counter.add(lang, b".".join(by_lang.pop(lang)))
                    del sizes[lang]
            for lang, data in by_lang.items():
                yield from counter.add(lang, b".".join(data))
        yield from counter.runs(0)

    runs = texts.select("lang", "text").mapInArrow(count, RUNS)
    # Grouped within the partition that all runs of a prefix go to.
    return runs.repartition("part").groupBy("part", "lang", "phrase").agg(F.sum("a").alias("a"))


def filter_of(phrases: DataFrame) -> np.ndarray:
    """The bits of phrases (lang, phrase; a stored table): a bitmap of bounded size, whatever their number."""
    bits = min(MOST_BITS, max(1 << 15, 1 << math.ceil(math.log2(max(1, BITS_EACH * phrases.count())))))

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = np.array([word_hash(lang.encode())], np.uint64)
                for w in phrase.encode().split(b" "):
                    h = grown(h, np.array([word_hash(w)], np.uint64))
                out.append(h)
            if out:
                at = np.concatenate(places(np.concatenate(out), bits)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at >> 15), pa.array(at & 32767)], ["block", "bit"])

    blocks = phrases.select("lang", "phrase").mapInArrow(positions, "block long, bit long").groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in blocks.collect():
        out[r.block << 12 : (r.block + 1) << 12] = np.frombuffer(r.bits, np.uint8)
    return out


def part_of(words: Column, start: int | Column, size: int | Column) -> Column:
    return F.concat_ws(" ", F.slice(words, start, size))


def cut_score() -> Column:
    """floor(1000000 a a / (l r)) in whole numbers of up to 38 digits."""
    wide = lambda c: f"CAST({c} AS DECIMAL(38, 0))"
    return F.expr(f"({wide(1000000)} * {wide('a')} * {wide('a')}) DIV ({wide('l')} * {wide('r')})").cast("long")


def looked_up(rows: DataFrame, counts: DataFrame, key: str, name: str) -> DataFrame:
    """rows with the count of the phrase in column key. A phrase that many rows ask for is broadcast."""
    asked = rows.groupBy("lang", key).agg(F.count("*").alias("asked"))
    groups = common.stored(asked.join(counts.select("lang", F.col("phrase").alias(key), F.col("a").alias(name)), ["lang", key]))
    return common.heavy_join(rows, groups, ["lang", key], F.col("phrase"), count="asked").drop("asked")


def collocations(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, top: int = TOP, inside_percent: int = INSIDE_PERCENT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each lang's best phrases of 2 to most_words words.

    A-Z are lower-cased, pieces end at . , ; : ! ? and line ends, words at spaces and tabs; no phrase leaves its piece or
    its text. Null langs count as `und`, null texts as empty; repeated rows count each time, and rows are not told apart
    by their id. a is the phrase's count, at least `least`; n that of all words of the lang. A cut into two parts with
    counts l and r scores floor(1000000 a a / (l r)), in whole numbers of up to 38 digits; the lowest counts, of equal
    ones the one with the shortest first part. A phrase goes if a longer one around it occurs inside_percent as often. A
    lang with no such phrase has no row. Other columns of docs do not count.
    """
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    words = common.stored(counted(texts, 1).drop("part"))
    totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
    levels = [common.stored(words.where(F.col("a") >= least))]
    for n in range(2, most_words + 1):
        levels.append(common.stored(counted(texts, n, filter_of(levels[-1])).where(F.col("a") >= least).drop("part")))
    counts = levels[0]
    for level in levels[1:]:
        counts = counts.unionByName(level)
    found = levels[1] if most_words > 1 else levels[0].limit(0)
    for level in levels[2:]:
        found = found.unionByName(level)
    w = F.split("phrase", " ")
    size = F.size(w)
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", part_of(w, F.lit(1), F.col("k")).alias("left"), part_of(w, F.col("k") + 1, size - F.col("k")).alias("right"))
    cuts = looked_up(looked_up(cuts, counts, "left", "l"), counts, "right", "r")
    weakest = cuts.withColumn("score", cut_score()).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    # Parts of longer phrases, with the largest count of what is around them.
    at = F.expr("flatten(transform(sequence(2, m - 1), s -> transform(sequence(1, m - s + 1), i -> struct(i, s))))")
    around = found.withColumn("m", size).where("m > 2").select("lang", "a", w.alias("w"), F.explode(at).alias("x")).select("lang", "a", part_of(F.col("w"), F.col("x.i"), F.col("x.s")).alias("phrase"))
    around = around.groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    kept = weakest.join(around, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("around") < inside_percent * F.col("a"), F.lit(True)))
    rows = kept.select("lang", "phrase", "a", "x.*", F.pmod(F.xxhash64("phrase"), F.lit(16)).alias("share"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    best = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(common.table(spark, sf_dir, "documents").select("lang", "text"))


OP13_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
o AS (SELECT lang, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM w, (VALUES (1), (2), (3)) s(m)),
f AS (SELECT lang, m, w[i:i + m - 1] AS p, count(*) AS a FROM o GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE m > 1 AND a >= 10),
k AS (SELECT lang, m, p, a, unnest(range(1, m)) AS k FROM c),
s AS (SELECT k.lang, k.p, k.m, k.a, k.k, x.a AS l, y.a AS r, (1000000::HUGEINT * k.a * k.a) // (x.a::HUGEINT * y.a) AS score
      FROM k JOIN f x ON x.lang = k.lang AND x.p = k.p[1:k.k] JOIN f y ON y.lang = k.lang AND y.p = k.p[k.k + 1:]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
i AS (SELECT lang, p[1:2] AS p, a FROM c WHERE m = 3 UNION ALL SELECT lang, p[2:3], a FROM c WHERE m = 3),
g AS (SELECT lang, p, max(a) AS around FROM i GROUP BY ALL),
t AS (SELECT b.*, array_to_string(b.p, ' ') AS phrase FROM b LEFT JOIN g USING (lang, p) WHERE around IS NULL OR 100 * around < 50 * b.a)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM t) JOIN n USING (lang) WHERE rank <= 2000
"""
