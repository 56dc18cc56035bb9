"""Subword lattice likelihood: the marginal probability of a text over all its segmentations into known pieces.

The pieces are those of an existing vocabulary. A word is a space and its bytes; no piece crosses a word, so the
lattice of a text falls into those of its words. Every single byte is a piece, so each word has a probability. The
vocabulary's own scores start the weights; expectation maximisation over the training words' lattices then fits them.

A word has two further arcs from its start to its end: one if training has seen it, weighted by its discounted relative
frequency (what the discount frees is what the pieces share), and one if the text itself has held it before, weighted by
how often. A text is thus drawn from an urn: word i has probability (CACHE * p(word) + its uses before i) / (CACHE + i),
with p the sum over all its other arcs. This product does not depend on the words' order, so counts by text suffice.

Weights and frequencies are fitted for each of a few classes of training texts (their languages); a text's probability
is the sum over classes, each by its share. The class of a text to be scored is never looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
FOLDS, HELD_OUT, ROUNDS = 7, 2, 4
#: Words with at least 1/HOT of all tokens go to each task with their probabilities: at most HOT words.
HOT = 500_000
#: Longer words are known by a digest, so that keys (and what is broadcast) have a bounded size.
KEY_BYTES = 64
#: Classes at most: the most frequent values of the class column; all other values are the last class.
CLASSES = 8
#: Weight of p(word) against the text's own words so far: on sf0.01, fold 3 by a model of the other training folds is likeliest at
#: 13,000 to 26,000.
CACHE = 16_000.0
BASE, LAST = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9)
#: Longer words are summed byte by byte, shorter ones many at a time.
LONG_WORD, CHUNK = 256, 1 << 15
NEVER = -1e30
END = b" "  # stands for the end of a text; no word holds a space


def load_vocabulary(path: str = VOCABULARY) -> list[tuple[bytes, float]]:
    """Distinct pieces as bytes (a space marks a word's start) with starting weights, summing to 1.

    The file's scores are minus the rank; weights fall with the rank as 1 / (rank + 10). Pieces that no word can hold
    are left out; a piece of one byte and that byte's fallback are one.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    weights: Counter = Counter()
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i):
            continue
        if model.is_byte(i):
            weights[bytes([int(model.id_to_piece(i)[1:-1], 16)])] += 1e-7
            continue
        piece = model.id_to_piece(i).replace("▁", " ").encode()
        if piece and not piece[1:].count(b" "):
            weights[piece] += 1.0 / (10 - model.get_score(i))
    for b in range(256):
        weights[bytes([b])] += 1e-7
    total = sum(weights.values())
    return [(p, w / total) for p, w in sorted(weights.items())]


def _sum_logs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log(exp(a) + exp(b)); NEVER stands for log 0."""
    high = np.maximum(a, b)
    return high + np.log(1.0 + np.exp(np.minimum(a, b) - high))


class Lattice:
    """Log probabilities of words by pieces, for each column (class) of their natural log weights."""

    def __init__(self, pieces: list[bytes], log_weights: np.ndarray):
        self.log_weights = log_weights.reshape(len(pieces), -1)
        self.lengths = sorted({len(p) for p in pieces})
        self.n_pieces, size = len(pieces), CHUNK + self.lengths[-1]
        self.power = np.multiply.accumulate(np.append(np.uint64(1), np.full(size, BASE, np.uint64)))
        self.inverse = np.multiply.accumulate(np.append(np.uint64(1), np.full(size, pow(BASE, -1, 2**64), np.uint64)))
        keys = np.zeros(len(pieces), np.uint64)
        for k in range(self.lengths[-1]):
            at = [i for i, p in enumerate(pieces) if len(p) > k]
            keys[at] += np.array([pieces[i][k] + 1 for i in at], np.uint64) * self.power[k]
        keys *= LAST
        # A small filter by 20 bits of the key rules out most strings; pieces whose place is taken are in the sorted rest.
        self.keys, at = np.append(keys, np.uint64(0)), self._place(keys)
        self.filter, self.table = np.zeros(1 << 20, bool), np.full(1 << 20, len(keys), np.int32)
        self.filter[at] = True
        self.table[at] = np.arange(len(keys))
        left = np.flatnonzero(self.table[at] != np.arange(len(keys)))
        self.rest = left[np.argsort(keys[left])]

    @staticmethod
    def _place(keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(44)).view(np.int64)

    def arcs(self, data: np.ndarray, since: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """End, size and piece of all pieces found in data that start no earlier than since (by end, the first byte)."""
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[: len(data)], out=total[1:])
        found: list[tuple] = []
        for size in self.lengths:
            n = len(data) - size + 1
            if n <= 0:
                break
            h = (total[size:] - total[:-size]) * self.inverse[:n] * LAST
            hit = self.filter[self._place(h)]
            hit &= since[size - 1 :] <= np.arange(n)
            start = np.flatnonzero(hit)
            keys = h[start]
            pieces = self.table[self._place(keys)].astype(np.int64)
            odd = np.flatnonzero(self.keys[pieces] != keys)
            if len(self.rest) and len(odd):
                i = np.minimum(np.searchsorted(self.keys[self.rest], keys[odd]), len(self.rest) - 1)
                pieces[odd] = self.rest[i]
            ok = self.keys[pieces] == keys
            found.append((start[ok] + size, np.full(int(ok.sum()), size), pieces[ok]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _block_arcs(self, words: list[bytes]) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """start, end, rows and pieces of the arcs of a block of words, by end within the word."""
        sizes = np.array([len(w) + 1 for w in words])
        first = np.cumsum(sizes) - sizes
        row = np.repeat(np.arange(len(words)), sizes)
        end, size, piece = self.arcs(np.frombuffer(b"".join(b" " + w for w in words), np.uint8), first[row])
        rows = row[end - 1]
        key = (end - first[rows]) * (self.lengths[-1] + 1) + size
        order = np.argsort(key.astype(np.uint16) if self.lengths[-1] < 200 else key, kind="stable")
        out = []
        for at in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
            j = int(end[at[0]] - first[rows[at[0]]])
            out.append((j - int(size[at[0]]), j, rows[at], piece[at]))
        return out

    @staticmethod
    def blocks(words: list[bytes]) -> Iterator[list[int]]:
        """Positions of words in blocks of like length and bounded size; words over LONG_WORD alone."""
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        block: list[int] = []
        for k in order:
            if block and (len(words[k]) > LONG_WORD or (len(block) + 1) * (len(words[k]) + 1) > CHUNK):
                yield block
                block = []
            block.append(k)
        if block:
            yield block

    def _forward(self, n: int, longest: int, arcs: list) -> np.ndarray:
        """The forward recursion in log space: entry j sums over all segmentations of the first j bytes."""
        alpha = np.full((longest + 1, n, self.log_weights.shape[1]), NEVER)
        alpha[0] = 0
        for i, j, rows, pieces in arcs:
            alpha[j, rows] = _sum_logs(alpha[j, rows], alpha[i, rows] + self.log_weights[pieces])
        return alpha

    def _long_arcs(self, word: bytes, backwards: bool = False) -> Iterator[tuple[int, int, int]]:
        """start, end, piece of one long word's arcs, in order of their ends (starts, if backwards), a chunk at a time."""
        data, reach = np.frombuffer(b" " + word, np.uint8), self.lengths[-1]
        chunks = range(0, len(data), CHUNK)
        for c in reversed(chunks) if backwards else chunks:
            low, high = (c, min(len(data), c + CHUNK + reach)) if backwards else (max(0, c - reach), min(len(data), c + CHUNK))
            end, size, piece = self.arcs(data[low:high], np.zeros(high - low, np.int64))
            start, end = end - size + low, end + low
            here = (start >= c) & (start < c + CHUNK) if backwards else end > c
            start, end, piece = start[here], end[here], piece[here]
            order = np.argsort(-start if backwards else end, kind="stable")
            yield from zip(start[order].tolist(), end[order].tolist(), piece[order].tolist(), strict=True)

    def _forward_long(self, word: bytes, column: int) -> list[float]:
        weights, alpha = self.log_weights[:, column].tolist(), [0.0] + [NEVER] * (len(word) + 1)
        for i, j, piece in self._long_arcs(word):
            a, b = alpha[j], alpha[i] + weights[piece]
            a, b = (a, b) if a > b else (b, a)
            alpha[j] = a + math.log1p(math.exp(b - a))
        return alpha

    def log10(self, words: list[bytes]) -> np.ndarray:
        """One row for each word: its log probability by each column of weights."""
        out = np.empty((len(words), self.log_weights.shape[1]))
        for at in self.blocks(words):
            if len(words[at[0]]) > LONG_WORD:
                out[at[0]] = [self._forward_long(words[at[0]], k)[-1] for k in range(out.shape[1])]
                continue
            part = [words[k] for k in at]
            alpha = self._forward(len(part), len(part[-1]) + 1, self._block_arcs(part))
            out[at] = alpha[[len(w) + 1 for w in part], np.arange(len(part))]
        return out / math.log(10)

    def expected(self, words: list[bytes]) -> np.ndarray:
        """Expected uses of each piece over all segmentations of the words, each word once (first column of weights)."""
        out, weights = np.zeros(self.n_pieces), self.log_weights[:, 0]
        for at in self.blocks(words):
            if len(words[at[0]]) > LONG_WORD:
                self._expect_long(words[at[0]], out)
                continue
            part = [words[k] for k in at]
            arcs, sizes = self._block_arcs(part), np.array([len(w) + 1 for w in part])
            alpha = self._forward(len(part), int(sizes[-1]), arcs)[:, :, 0]
            beta = np.full_like(alpha, NEVER)
            beta[sizes, np.arange(len(part))] = 0
            whole = alpha[sizes, np.arange(len(part))]
            for i, j, rows, pieces in reversed(arcs):
                beta[i, rows] = _sum_logs(beta[i, rows], beta[j, rows] + weights[pieces])
            used = np.concatenate([pieces for *_, pieces in arcs])
            p = np.concatenate([alpha[i, rows] + beta[j, rows] - whole[rows] for i, j, rows, _ in arcs])
            out += np.bincount(used, np.exp(p + weights[used]), len(out))
        return out

    def _expect_long(self, word: bytes, out: np.ndarray) -> None:
        alpha, weights = self._forward_long(word, 0), self.log_weights[:, 0].tolist()
        beta = [NEVER] * (len(word) + 1) + [0.0]
        for i, j, piece in self._long_arcs(word, backwards=True):
            a, b = beta[i], beta[j] + weights[piece]
            out[piece] += math.exp(min(0.0, alpha[i] + b - alpha[-1]))
            a, b = (a, b) if a > b else (b, a)
            beta[i] = a + math.log1p(math.exp(b - a))


def key_of(word: bytes) -> bytes:
    """The word itself, or for long ones a space (which no word holds) and a digest."""
    return word if len(word) <= KEY_BYTES else b" " + hashlib.blake2b(word, digest_size=16).digest()


def counts_of(text: str | None) -> Counter:
    """Uses of each word (lower-cased bytes) of a whole text."""
    found: Counter = Counter()
    for piece in common.pieces((text or "").encode("utf-8", "surrogatepass").lower()):
        found.update(piece.split())
    return found


def class_names(training: DataFrame, by: str | None, most: int = CLASSES) -> list[str | None]:
    """The values of `by` that are classes of their own; None is the class of all others. At most `most` in all."""
    if by is None or by not in training.columns:
        return [None]
    rows = training.groupBy(F.col(by).cast("string").alias("v")).count().orderBy(F.desc("count"), "v").limit(most).collect()
    named = [r.v for r in rows if r.v is not None][: most - 1]
    return named if 0 < len(rows) == len(named) < most else [*named, None]


def class_of(by: str | None, names: list[str | None], training: Column) -> Column:
    """Each row's place in names; -1 outside training."""
    found = F.lit(len(names) - 1)
    for k, name in enumerate(names):
        if name is not None:
            found = F.when(F.col(by).cast("string") == name, k).otherwise(found)
    return F.when(training, found).otherwise(-1).cast("int")


def word_counts(docs: DataFrame, n_classes: int, most: int = 400_000) -> DataFrame:
    """docs (text, class) -> key, long (the word where key is a digest), n (uses in all rows), c0, c1, ... (in a class).

    Tasks count in tables of bounded size before anything is shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for k, words in seen.items():
                keys = [key_of(w) if len(w) > KEY_BYTES else w for w in words]
                longs = [w if len(w) > KEY_BYTES else None for w in words]
                for i in range(0, len(keys), 100_000):
                    part = slice(i, i + 100_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[part], pa.binary()), pa.array(longs[part], pa.binary()), pa.array(np.full(len(keys[part]), k, np.int32)), pa.array(list(words.values())[part], pa.int64())],
                        names=["key", "long", "class", "n"],
                    )
            seen.clear()

        for b in batches:
            for text, k in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                into = seen.setdefault(k, Counter())
                for piece in common.pieces((text.as_py() or "").encode("utf-8", "surrogatepass").lower()):
                    into.update(piece.split())
                    if len(into) > most:
                        yield from out()
                        into = seen.setdefault(k, Counter())
        yield from out()

    rows = docs.select("text", "class").mapInArrow(count, "key binary, long binary, class int, n long")
    per = [F.coalesce(F.sum(F.when(F.col("class") == k, F.col("n"))), F.lit(0)).alias(f"c{k}") for k in range(n_classes)]
    return rows.groupBy("key", "long").agg(F.sum("n").alias("n"), *per)


@dataclass
class Model:
    """What is known of the training texts but for the words' own counts. Arrays have one entry for each class."""

    pieces: list[bytes]
    log_weights: np.ndarray
    prior: np.ndarray
    tokens: np.ndarray
    discount: np.ndarray
    share: np.ndarray
    end: np.ndarray
    texts: int
    distinct: int
    cache: float = CACHE


def fit(counts: DataFrame, texts: list[int], vocabulary: list[tuple[bytes, float]], rounds: int = ROUNDS, cache: float = CACHE) -> Model:
    """texts: the number of training texts of each class. All training words are used, each once a class.

    A seen word's discount is n1 / (n1 + 2 * n2), the leave-one-out estimate from words seen once and twice (0.5
    if none is seen once); the pieces share what it frees. A text ends after a word with the frequency of ends among the class's tokens.
    """
    spark, columns = counts.sparkSession, [f"c{k}" for k in range(len(texts))]
    asked = [f(F.col(c)) for c in columns for f in (lambda c: F.coalesce(F.sum(c), F.lit(0)), lambda c: F.count_if(c > 0), lambda c: F.count_if(c == 1), lambda c: F.count_if(c == 2))]
    total = sum(map(F.col, columns))
    *found, distinct = counts.agg(*asked, F.count_if(total > 0)).first()
    tokens, words, once, twice = np.array(found, float).reshape(-1, 4).T
    discount = np.where(once > 0, np.clip(once / np.maximum(1, once + 2 * twice), 0.05, 0.95), 0.5)
    share = np.where(tokens > 0, discount * words / np.maximum(1, tokens), 1.0)
    n = np.array(texts, float)
    # A class without texts or without words has no share of its own.
    end = np.where((n > 0) & (tokens > 0), n / np.maximum(1, n + tokens), 0.01)
    pieces, start = [p for p, _ in vocabulary], np.array([w for _, w in vocabulary])
    weights = np.repeat(np.log(start)[:, None], len(texts), 1)
    word = F.coalesce("long", "key").alias("word")
    for _ in range(rounds if tokens.sum() else 0):
        given = spark.sparkContext.broadcast((pieces, weights))

        def expect(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            pieces, weights = given.value
            lattices = [Lattice(pieces, weights[:, k]) for k in range(weights.shape[1])]
            uses = np.zeros(weights.shape)
            for b in batches:
                words = b.column(0).to_pylist()
                for k, lattice in enumerate(lattices):
                    uses[:, k] += lattice.expected([words[i] for i in np.flatnonzero(b.column(k + 1).to_numpy())])
            at, k = np.nonzero(uses)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(k), pa.array(uses[at, k])], names=["piece", "class", "n"])

        # One row for each piece and class at most: as many as the vocabulary has.
        seen = counts.where(total > 0).select(word, *columns).mapInArrow(expect, "piece long, class long, n double").groupBy("piece", "class").agg(F.sum("n").alias("n")).toPandas()
        uses = np.repeat(start[:, None], len(texts), 1)
        uses[seen["piece"].to_numpy(np.int64), seen["class"].to_numpy(np.int64)] += seen["n"].to_numpy()
        weights = np.log(uses / uses.sum(0))
    prior = n / n.sum() if n.sum() else np.full(len(n), 1 / len(n))
    return Model(pieces, weights, prior, tokens, discount, share, end, int(n.sum()), int(distinct), cache)


def priced(counts: DataFrame, model: Model) -> DataFrame:
    """key, n, c (uses in training), p0, p1, ...: each distinct word once with log10 of its probability by class."""
    k = len(model.prior)
    given = counts.sparkSession.sparkContext.broadcast(model)

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = given.value
        lattice = Lattice(m.pieces, m.log_weights)
        for b in batches:
            words = [x or y for x, y in zip(b.column(1).to_pylist(), b.column(0).to_pylist(), strict=True)]
            c = np.stack([b.column(3 + i).to_numpy() for i in range(k)], 1).astype(float)
            spelled = np.log10(m.share) + lattice.log10(words)
            with np.errstate(divide="ignore"):
                seen = np.log10(np.maximum(0, c - m.discount) / np.maximum(1, m.tokens))
            high = np.maximum(spelled, seen)
            p = high + np.log10(10.0 ** (spelled - high) + 10.0 ** (seen - high))
            total = pa.array(c.sum(1).astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), total, *(pa.array(p[:, i]) for i in range(k))], names=["key", "n", "c", *(f"p{i}" for i in range(k))])

    columns = ["key", "long", "n", *(f"c{i}" for i in range(k))]
    return counts.select(*columns).mapInArrow(price, "key binary, n long, c long, " + ", ".join(f"p{i} double" for i in range(k)))


def _stirling(x):
    """log gamma of x >= 8, for columns and arrays alike, but for a constant."""
    log = F.log if isinstance(x, Column) else np.log
    return (x - 0.5) * log(x) - x + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)


def urn(p: np.ndarray, k: np.ndarray, cache: float) -> np.ndarray:
    """log10 of x (x + 1) ... (x + k - 1), x = cache * 10 ** p: k draws of one word."""
    x = cache * 10.0**p
    product = np.ones_like(x)
    for j in range(1, 8):
        product *= np.where(k > j, x + j, 1.0)
    far = np.where(k > 8, _stirling(x + k) - _stirling(x + 8), 0.0)
    return math.log10(cache) + p + np.log10(product) + far / math.log(10)


def urn_column(p: Column, k: Column, cache: float) -> Column:
    """urn() for columns."""
    x = F.lit(cache) * F.pow(F.lit(10.0), p)
    product = F.lit(1.0)
    for j in range(1, 8):
        product = product * F.when(k > j, x + float(j)).otherwise(1.0)
    more = F.log10(product) + F.when(k > 8, (_stirling(x + k) - _stirling(x + 8.0)) / math.log(10)).otherwise(0.0)
    return F.lit(math.log10(cache)) + p + F.when(k > 1, more).otherwise(0.0)


def score(docs: DataFrame, words: DataFrame, model: Model, hot: int = HOT) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of each row of docs (doc_id, text).

    words is the table of priced(), with all words of docs in it. score is log10 of the marginal probability of the
    text's words and its end. Null and empty texts are an end alone. Frequent words (at most `hot`, each of KEY_BYTES
    bytes at most) are looked up in the task; all others, each in under 1/hot of all tokens, by a join of
    (row, word). Repeated rows are scored each, null doc_ids too. With no training text the pieces alone speak.
    Words of any length count whole; time is in proportion to their bytes. docs must be a stored table: its rows are
    numbered in the order in which a task reads them.
    """
    sc, n_classes = docs.sparkSession.sparkContext, len(model.prior)
    everything, seen_tokens = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("c"), F.lit(0))).first()
    total = int(seen_tokens) + model.texts
    scale = math.log10(total + model.distinct + (model.texts > 0) + 1)
    least, ps = max(2, math.ceil(everything / hot)), [f"p{i}" for i in range(n_classes)]
    frequent = words.where(F.col("n") >= least).select("key", "c", *ps).toPandas()
    given = sc.broadcast((list(map(bytes, frequent["key"])), frequent["c"].to_numpy(np.int64), frequent[ps].to_numpy(float)))
    cache, known_end = model.cache, int(model.texts > 0)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        keys, uses, p = given.value
        place, row = {w: i for i, w in enumerate(keys)}.get, TaskContext.get().partitionId() << 40
        base, known = np.log10(uses + 1.0) - scale, uses > 0

        def out(ids: list, found: list[Counter], row: int) -> pa.RecordBatch:
            n, sizes = len(ids), [len(f) for f in found]
            each = [w for f in found for w in f]
            k = np.fromiter((x for f in found for x in f.values()), np.int64, len(each))
            of = np.repeat(np.arange(n), sizes)
            at = np.fromiter(map(place, each, repeat(-1)), np.int64, len(each))
            miss = np.flatnonzero(at < 0)
            for i in (i for i in miss.tolist() if len(each[i]) > KEY_BYTES):
                each[i] = key_of(each[i])
                at[i] = place(each[i], -1)
            rare, hit = np.flatnonzero(at < 0), np.flatnonzero(at >= 0)
            a, f, times = at[hit], of[hit], k[hit]
            summed = lambda x: np.bincount(f, x, n)
            urns = urn(p[a], times[:, None], cache) if len(a) else np.zeros((0, n_classes))
            m = len(rare)
            own = [pa.array([b" %d" % (row + i) for i in range(n)], pa.binary()), pa.array([each[i] for i in rare.tolist()], pa.binary())]
            longs = lambda x: pa.concat_arrays([pa.array(x, pa.int64()), pa.nulls(m, pa.int64())])
            doubles = lambda x: pa.concat_arrays([pa.array(x, pa.float64()), pa.nulls(m, pa.float64())])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.arange(n), of[rare]]) + row), pa.concat_arrays(own), pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(k[rare])]), longs(ids),
                    longs(np.bincount(of, k, n).astype(np.int64)), longs(summed(np.where(known[a], times, 0)).astype(np.int64)), doubles(summed(times * base[a])),
                    *(doubles(summed(urns[:, i])) for i in range(n_classes)),
                ],
                names=["row", "key", "k", "doc_id", "n_words", "hits", "base", *(f"s{i}" for i in range(n_classes))],
            )

        for b in batches:
            ids, found, size = [], [], 0
            for d, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids.append(d)
                found.append(counts_of(text.as_py()))
                size += len(found[-1])
                if size > 200_000:
                    yield out(ids, found, row)
                    row, ids, found, size = row + len(ids), [], [], 0
            if ids:
                yield out(ids, found, row)
                row += len(ids)

    s = [f"s{i}" for i in range(n_classes)]
    schema = "row long, key binary, k long, doc_id long, n_words long, hits long, base double, " + ", ".join(f"{c} double" for c in s)
    rows = docs.select("doc_id", "text").mapInArrow(scored, schema)
    joined = rows.join(words.where(F.col("n") < least).select(F.col("key").alias("w"), "c", *ps).hint("merge"), F.col("key") == F.col("w"), "left")
    k, rare, zero = F.col("k"), F.col("w").isNotNull(), F.lit(0.0)
    by = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("m"),
        (F.max("hits") + F.coalesce(F.sum(F.when(F.col("c") > 0, k)), F.lit(0))).alias("known"),
        (F.max("base") + F.coalesce(F.sum(F.when(rare, k * (F.log10(F.col("c") + 1.0) - F.lit(scale)))), zero)).alias("base"),
        *((F.max(c) + F.coalesce(F.sum(F.when(rare, urn_column(F.col(p), k, cache))), zero)).alias(c) for c, p in zip(s, ps, strict=True)),
    )
    # The urn's draws are out of cache, cache + 1, ...: log10 of their product, by Stirling from 8 on.
    m, drawn = F.col("m"), F.lit(0.0)
    for j in range(8):
        drawn = drawn + F.when(m > j, F.log10(F.lit(cache + j))).otherwise(0.0)
    drawn = drawn + F.when(m > 8, (_stirling(m + F.lit(cache)) - _stirling(F.lit(cache + 8.0))) / math.log(10)).otherwise(0.0)
    parts = [F.col(c) + m * math.log10(1 - e) + math.log10(e) + (math.log10(q) if q else NEVER) for c, e, q in zip(s, model.end.tolist(), model.prior.tolist(), strict=True)]
    high = F.greatest(*parts) if len(parts) > 1 else parts[0]
    mixed = high + F.log10(sum(F.pow(F.lit(10.0), x - high) for x in parts)) - drawn
    end_base = math.log10(model.texts + 1) - scale
    return by.select(
        "doc_id", (m + 1).alias("n_tokens"), (F.col("known") + known_end).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + end_base).alias("base_score"), mixed.alias("score")
    )


def learned(docs: DataFrame, training: Column, by: str | None = None, vocabulary: str = VOCABULARY, rounds: int = ROUNDS) -> tuple[DataFrame, Model]:
    """The words of docs (text; by: the column of classes) with their probabilities, and the model; docs where
    `training` holds are learned from, all others only give the list of words."""
    names = class_names(docs.where(training), by)
    rows = docs.withColumn("class", class_of(by, names, training)).select("text", "class")
    counts = common.stored(word_counts(rows, len(names)))
    per = {r["class"]: r["count"] for r in rows.where("class >= 0").groupBy("class").count().collect()}
    model = fit(counts, [per.get(k, 0) for k in range(len(names))], load_vocabulary(vocabulary), rounds)
    return common.stored(priced(counts, model)), model


def op1_lattice_lm(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = common.fold(F.col("doc_id"), FOLDS)
    words, model = learned(docs, fold != HELD_OUT, "lang", vocabulary)
    return score(docs, words, model).withColumn("held_out", fold == HELD_OUT).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
