"""Token ids packed into rows of fixed length: best fit decreasing, with a segment tree over free capacities."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from . import common

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The vocabulary's public pre-tokenisation pattern (a fixed value), and the id of its end-of-text token.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A space that stands alone. What Python takes for white space includes all that the pattern does.
ALONE = re.compile(r"(?<=\S) (?=\S)")
END = 50256
SEQ_LEN, BLOCK_TOKENS = 2048, 1 << 20
PACKED = "shard int, block int, bin int, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, rows array<int>, offsets array<long>"


def encoding(ranks: bytes) -> tiktoken.Encoding:
    table = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


class Encoder(dict):
    """Ids by unit: a run of text with the space before it.

    A text may be cut before a space that stands alone between two characters that are no white space: no alternative
    of the pattern reaches over such a place from either side. Units that start or end with white space, and empty
    ones, mark a space that does not stand alone; a text with such units is cut by the rule itself.
    """

    def __init__(self, ranks: bytes, limit: int = 100_000):
        super().__init__()
        self.encode, self.limit = encoding(ranks).encode_ordinary, limit

    def __missing__(self, unit: str) -> tuple[int, ...] | None:
        ids = tuple(self.encode(" " + unit)) if unit and not unit[0].isspace() and not unit[-1].isspace() else None
        if len(self) < self.limit:
            self[unit] = ids
        return ids

    def ids(self, text: str) -> np.ndarray:
        """The text's ids and the end token, as 16-bit numbers; the same as of the whole text at once."""
        first, *rest = text.split(" ")
        found = list(map(self.__getitem__, rest))
        if rest and first[-1:].isspace() or None in found:
            first, *rest = ALONE.split(text)
            found = [self[unit] or self.encode(" " + unit) for unit in rest]
        parts = [np.array(self.encode(first), np.uint16)]
        for i in range(0, len(found), 200_000):
            parts.append(np.fromiter(chain.from_iterable(found[i : i + 200_000]), np.uint16))
        return np.concatenate([*parts, np.array([END], np.uint16)])


class Capacities:
    """A segment tree over capacities 0..most: the smallest one of at least a given size that a bin has free."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(most + 1)]

    def _add(self, capacity: int, by: int) -> None:
        i = capacity + self.size
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, capacity: int, b: int) -> None:
        self.bins[capacity].append(b)
        self._add(capacity, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """Capacity and bin of the tightest fit."""
        i = least + self.size
        while not self.count[i]:
            while i & 1:
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.size:
            i = 2 * i if self.count[2 * i] else 2 * i + 1
        capacity = i - self.size
        self._add(capacity, -1)
        return capacity, self.bins[capacity].pop()


def best_fit_decreasing(sizes: list[int], most: int) -> list[list[int]]:
    """Bins of items (positions in sizes), no bin over `most`; equal sizes in their order."""
    free, bins = Capacities(most), []
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        found = free.take(sizes[i])
        capacity, b = found or (most, len(bins))
        if not found:
            bins.append([])
        bins[b].append(i)
        if capacity > sizes[i]:
            free.put(capacity - sizes[i], b)
    return bins


def pack_block(docs: list[tuple[int | None, int, np.ndarray]], seq_len: int) -> list[dict]:
    """Rows of the packed matrix. docs: id, row number, ids. Longer ones are cut into segments of seq_len, none is lost."""
    segments = [(d, r, at, ids[at : at + seq_len]) for d, r, ids in docs for at in range(0, len(ids), seq_len)]
    rows = []
    for i, b in enumerate(best_fit_decreasing([len(s[3]) for s in segments], seq_len)):
        held = [segments[k] for k in b]
        ends = np.cumsum([len(s[3]) for s in held])
        ids = np.full(seq_len, END, "<u2")
        ids[: ends[-1]] = np.concatenate([s[3] for s in held])
        cu = [0, *map(int, ends)]
        rows.append({"bin": i, "n_tokens": cu[-1], "ids": ids.tobytes(), "cu_seqlens": cu, "position_resets": cu[:-1], "doc_ids": [s[0] for s in held], "rows": [s[1] for s in held], "offsets": [s[2] for s in held]})
    return rows


def position_ids(cu_seqlens: list[int]) -> np.ndarray:
    """Positions that start anew at each segment, as a model's input."""
    return np.concatenate([np.arange(b - a, dtype=np.int32) for a, b in zip(cu_seqlens, cu_seqlens[1:], strict=False)])


_SCHEMA = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("bin", pa.int32()), ("n_tokens", pa.int32()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("rows", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int64()))])


def packed(docs: DataFrame, tokenizer: str = TOKENIZER, seq_len: int = SEQ_LEN, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """docs (doc_id, text) -> packed rows: ids (16-bit little endian, padded with the end token), cumulative segment
    lengths, where positions start anew, and for each segment its doc_id, the row's number in the shard and its offset.

    Each task packs blocks of about block_tokens tokens, so memory is bounded and nothing is shuffled; a block leaves
    a few rows unfilled. A text longer than a block is a block of its own. Null and empty texts are an end token.
    Repeated rows have row numbers of their own. A task that is run again packs alike.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(open(tokenizer, "rb").read())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, encoder, held, size, block, row = TaskContext.get().partitionId(), Encoder(ranks.value), [], 0, 0, 0

        def out() -> Iterator[pa.RecordBatch]:
            rows = [r | {"shard": shard, "block": block} for r in pack_block(held, seq_len)]
            for i in range(0, len(rows), 1000):
                yield pa.RecordBatch.from_pylist(rows[i : i + 1000], _SCHEMA)

        for b in common.slices(batches):
            for doc_id, text in zip(b.column(0), b.column(1), strict=True):
                ids = encoder.ids(text.as_py() or "")
                held.append((doc_id.as_py(), row, ids))
                size, row = size + len(ids), row + 1
                if size >= block_tokens:
                    yield from out()
                    held, size, block = [], 0, block + 1
        if held:
            yield from out()

    return docs.select("doc_id", "text").mapInArrow(pack, PACKED)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(common.table(spark, sf_dir, "documents"))
