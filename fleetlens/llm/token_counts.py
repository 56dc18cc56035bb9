"""Token counts of a byte-level pair vocabulary, by two deterministic transducers compiled from its file.

The first runs over characters and marks where pieces (the units that pairs are merged in) begin. A block of texts is cut
into chunks; each chunk becomes a map from the state before it to the state after it, and the maps compose through a
prefix scan, so that all chunks go through the table side by side. The second runs over a piece's bytes; each transition
carries the number of tokens that it adds to those of the prefix read so far (a merge takes some back). Its states are
the subsets of the vocabulary's trie that a prefix can be in, compiled when first met.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from . import common

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
LIMIT_TOKENS = 512
#: Characters of a block, of a chunk (a multiple of STEP), and those taken at once in a chunk's map.
BLOCK, CHUNK, STEP = 1 << 20, 48, 3
#: Pieces and subset states that a worker remembers; beyond these it starts anew.
PIECES, STATES = 500_000, 300_000

#: Classes of characters. The letters that can follow an apostrophe in a contraction have classes of their own.
APOSTROPHE, STMD, R, E, V, L, LETTER, NUMBER, SPACE, BLANK, OTHER, END, PAD = range(13)
CLASSES = 13
#: Code points that the pieces' pattern takes for white space, but for the space itself (fixed values).
BLANKS = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: They stand in a block for the end of a text and for a special token; no text holds them, as they are halves of pairs.
TEXT_END, SPECIAL = "\udffe", "\udfff"


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class by code point. Letters and numbers that Python's tables do not know yet are those of the tokenizer library's."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    pieces_of = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
    for c in regex.findall(r"[\p{L}\p{N}]", "".join(chr(c) for c in np.flatnonzero(out == OTHER) if not 0xD800 <= c < 0xE000)):
        found = pieces_of(f"a{c}1")
        out[ord(c)] = LETTER if found[0][1][1] == 2 else NUMBER if len(found) == 2 else OTHER
    out[BLANKS] = BLANK
    for chars, k in ((" ", SPACE), ("'", APOSTROPHE), ("stmd", STMD), ("r", R), ("e", E), ("v", V), ("l", L), (TEXT_END + SPECIAL, END)):
        out[[ord(c) for c in chars]] = k
    return out


#: States: what the piece at hand is so far. AFTER_R, AFTER_V and AFTER_L have read an apostrophe and that letter.
START, LETTERS, NUMBERS, OTHERS, QUOTE, AFTER_R, AFTER_V, AFTER_L, DONE, ONE_SPACE, SPACES, ONE_BLANK, BLANKED = range(13)
#: Marks of a transition: a piece begins at this character, at the one before.
HERE, BEFORE = 1, 2


@lru_cache(maxsize=1)
def piece_table() -> tuple[np.ndarray, np.ndarray]:
    """next state and marks, by state and class."""
    letters, is_letter = LETTERS, lambda c: STMD <= c <= LETTER
    first = {APOSTROPHE: QUOTE, NUMBER: NUMBERS, SPACE: ONE_SPACE, BLANK: ONE_BLANK, OTHER: OTHERS, END: START}
    begin = lambda c: letters if is_letter(c) else first[c]

    def step(s: int, c: int) -> tuple[int, int]:
        if c == PAD:
            return s, 0
        if c == END:
            return START, HERE | (BEFORE if s in (AFTER_R, AFTER_V, AFTER_L) else 0)
        if s in (START, DONE):
            return begin(c), HERE
        if s in (LETTERS, AFTER_R, AFTER_V, AFTER_L):
            pair = {AFTER_R: E, AFTER_V: E, AFTER_L: L}.get(s)
            if c == pair:
                return DONE, 0
            late = BEFORE if pair is not None else 0
            return (letters, late) if is_letter(c) else (begin(c), late | HERE)
        if s == NUMBERS:
            return (s, 0) if c == NUMBER else (begin(c), HERE)
        if s in (OTHERS, QUOTE):
            if s == QUOTE and c in (STMD, R, V, L):
                return {STMD: DONE, R: AFTER_R, V: AFTER_V, L: AFTER_L}[c], 0
            return (OTHERS, 0) if c in (OTHER, APOSTROPHE) else (begin(c), HERE)
        if c in (SPACE, BLANK):
            return (SPACES if c == SPACE else BLANKED), 0
        # The last of a run of white space is a piece of its own, or, if a space, the first character of what follows.
        after = OTHERS if c == APOSTROPHE else begin(c)
        if s == ONE_SPACE:
            return after, 0
        if s == SPACES:
            return after, BEFORE
        return begin(c), HERE | (BEFORE if s == BLANKED else 0)

    cells = [[step(s, c) for c in range(CLASSES)] for s in range(13)]
    return np.array([[x[0] for x in row] for row in cells], np.uint8), np.array([[x[1] for x in row] for row in cells], np.uint8)


@lru_cache(maxsize=1)
def stepped_table() -> np.ndarray:
    """The state after STEP characters, by state and their classes as one number."""
    table, _ = piece_table()
    out = table
    for _ in range(STEP - 1):
        out = table[out].reshape(len(table), -1)
    return out


def chunk_maps(chunks: np.ndarray) -> np.ndarray:
    """Of each chunk (a row of classes), the state after it by the state before it."""
    steps, states = chunks.reshape(len(chunks), -1, STEP).astype(np.intp), len(piece_table()[0])
    digits = np.zeros(steps.shape[:2], np.intp)
    for k in range(STEP):
        digits = digits * CLASSES + steps[:, :, k]
    flat, width = stepped_table().ravel(), CLASSES**STEP
    now = np.tile(np.arange(states, dtype=np.intp), (len(chunks), 1))
    for k in range(digits.shape[1]):
        now = flat[now * width + digits[:, k, None]].astype(np.intp)
    return now


def scan(maps: np.ndarray, start: int) -> np.ndarray:
    """The state before each chunk: maps of neighbours compose to maps of pairs, these are scanned, and each pair's
    second chunk starts where its first one ends."""
    if len(maps) == 1:
        return np.array([start], np.intp)
    if len(maps) % 2:
        maps = np.concatenate([maps, np.arange(maps.shape[1], dtype=np.intp)[None]])
        return scan(maps, start)[:-1]
    out = np.empty(len(maps), np.intp)
    out[0::2] = scan(np.take_along_axis(maps[1::2], maps[0::2], 1), start)
    out[1::2] = maps[np.arange(0, len(maps), 2), out[0::2]]
    return out


def piece_starts(kinds: np.ndarray, start: int = START) -> np.ndarray:
    """Where pieces begin, of a block whose last character is an END (also a piece here)."""
    n = len(kinds)
    padded = np.full(-(-n // CHUNK) * CHUNK, PAD, np.uint8)
    padded[:n] = kinds
    chunks = padded.reshape(-1, CHUNK)
    table, marks = (t.ravel() for t in piece_table())
    now, found = scan(chunk_maps(chunks), start), np.empty(chunks.shape, np.uint8)
    for k in range(CHUNK):
        at = now * CLASSES + chunks[:, k]
        found[:, k] = marks[at]
        now = table[at].astype(np.intp)
    found = found.ravel()[:n]
    begins = found & HERE != 0
    begins[:-1] |= found[1:] & BEFORE != 0
    return np.flatnonzero(begins)


class Vocabulary:
    """What the file of a byte-level pair vocabulary says: merges in order, and special tokens.

    Tokens have numbers of their own here: the bytes first, then one for each merge. `spine` lists what stands at a
    token's edge while its merges are undone, with the rank of the merge that takes it up.
    """

    def __init__(self, data: bytes):
        found = json.loads(data)
        model, before = found["model"], found.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or found.get("normalizer"):
            raise ValueError("not a byte-level pair vocabulary without prefix space and normalizer")
        # Bytes that print stand for themselves, the others for the code points from 256 on.
        prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        letters = {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(prints))}
        self.special = [t["content"] for t in found.get("added_tokens", [])]
        self.tokens, self.parts, self.ranks = [bytes([b]) for b in range(256)], {}, {}
        number = {t: i for i, t in enumerate(self.tokens)}
        for rank, pair in enumerate(model["merges"]):
            a, b = (bytes(letters[c] for c in part) for part in (pair.split(" ") if isinstance(pair, str) else pair))
            if a + b in number:
                raise ValueError(f"two merges make {a + b!r}")
            number[a + b] = len(self.tokens)
            self.parts[len(self.tokens)] = number[a], number[b], rank
            self.ranks[number[a] << 32 | number[b]] = rank
            self.tokens.append(a + b)
        self.spine = lru_cache(maxsize=None)(self._spine)

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """side: 0 for the left edge, 1 for the right one."""
        out, end = [(token, sys.maxsize)], sys.maxsize
        while token in self.parts:
            token, end = self.parts[token][side], self.parts[token][2]
            out.append((token, end))
        return out

    def crossed(self, left: int, right: int, whole: bool = False) -> bool:
        """Whether a merge joins bytes of left with bytes of right where both stand side by side: its rank comes before
        those of the merges that take its two sides up (of equal ones the leftmost goes first). whole: but for the
        merge of left and right themselves."""
        for x, x_end in self.spine(left, 1):
            for y, y_end in self.spine(right, 0):
                rank = self.ranks.get(x << 32 | y)
                if rank is not None and rank < x_end and rank <= y_end and not (whole and x == left and y == right):
                    return True
        return False

    def reachable(self, token: int) -> bool:
        """Whether the token's bytes have it as their only token."""
        if token not in self.parts:
            return True
        a, b, _ = self.parts[token]
        return self.reachable(a) and self.reachable(b) and not self._before(a, b, token)

    def _before(self, a: int, b: int, token: int) -> bool:
        rank = self.parts[token][2]
        return any((r := self.ranks.get(x << 32 | y)) is not None and (x, y) != (a, b) and r < min(x_end, rank) and r <= min(y_end, rank) for x, x_end in self.spine(a, 1) for y, y_end in self.spine(b, 0))


class PairTransducer:
    """Tokens of a piece's bytes, one transition a byte.

    A state is a set of (trie node, token to its left, tokens up to there less those of the whole prefix): each is a
    token that may be under way. One token ends with each byte: the one that no merge joins with the token to its left.
    Only tokens that their own bytes lead to are in the trie.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.children, self.token = vocabulary, {}, [-1]
        for number, t in enumerate(vocabulary.tokens):
            if vocabulary.reachable(number):
                node = 0
                for b in t:
                    key = node << 8 | b
                    if key not in self.children:
                        self.children[key] = len(self.token)
                        self.token.append(-1)
                    node = self.children[key]
                self.token[node] = number
        self.clear()

    def clear(self) -> None:
        first = (0, -1, 0)
        self.states, self.number, self.moves = [first], {first: 0}, {}

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """The next state, and by how much the number of tokens grows."""
        entries, under_way, token, grown = self.states[state], [], -1, 0
        for i in range(0, len(entries), 3):
            child = self.children.get(entries[i] << 8 | byte)
            if child is not None:
                left, n = entries[i + 1], entries[i + 2]
                under_way.append((child, left, n))
                if token < 0 <= self.token[child] and (left < 0 or not self.vocabulary.crossed(left, self.token[child])):
                    token, grown = self.token[child], n + 1
        key = (0, token, 0, *(x for node, left, n in under_way for x in (node, left, n - grown)))
        at = self.number.get(key)
        if at is None:
            at = self.number[key] = len(self.states)
            self.states.append(key)
        move = self.moves[state << 8 | byte] = at, grown
        return move

    def count(self, data: bytes) -> int:
        if len(self.states) > STATES:
            self.clear()
        state, n, moves = 0, 0, self.moves
        for b in data:
            move = moves.get(state << 8 | b)
            state, grown = self.compile(state, b) if move is None else move
            n += grown
        return n


class TokenCounter(dict):
    """Tokens by piece (bytes); what is not known yet goes through the transducer."""

    def __init__(self, data: bytes):
        super().__init__()
        self.vocabulary = Vocabulary(data)
        self.transducer = PairTransducer(self.vocabulary)
        self.short: dict[int, int] = {}
        self.marks = {TEXT_END.encode("utf-8", "surrogatepass"): 0, SPECIAL.encode("utf-8", "surrogatepass"): 1}

    def __missing__(self, piece: bytes) -> int:
        n = self.marks.get(piece)
        if n is None:
            n = self.transducer.count(piece)
        if len(piece) <= 64:
            if len(self) >= PIECES:
                self.clear()
            self[piece] = n
        return n

    def block(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Where each piece begins, and its tokens. text ends with TEXT_END."""
        points, data = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), text.encode("utf-8", "surrogatepass")
        starts = piece_starts(classes()[points])
        at = starts
        if len(data) > len(text):
            width = np.ones(len(points), np.uint8)
            for least in (0x80, 0x800, 0x10000):
                width += points >= least
            at = (np.cumsum(width, dtype=np.int64) - width)[starts]
        return starts, self.of_pieces(data, at)

    def of_pieces(self, data: bytes, at: np.ndarray) -> np.ndarray:
        """Tokens of data's pieces, which begin at `at`. Short ones are numbers (their bytes and length), looked up once."""
        ends = np.append(at[1:], len(data))
        size, out = ends - at, np.empty(len(at), np.int64)
        short = size <= 7
        window = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data + bytes(8), np.uint8), 8)
        key = window[at[short]].view("<u8").ravel()
        key = key & ((np.uint64(1) << (size[short] * 8).astype(np.uint64)) - np.uint64(1)) | size[short].astype(np.uint64) << np.uint64(56)
        distinct, inverse = np.unique(key, return_inverse=True)
        n = np.fromiter((self[int(k).to_bytes(8, "little")[: int(k) >> 56]] if (found := self.short.get(k)) is None else found for k in distinct.tolist()), np.int64, len(distinct))
        if len(self.short) > PIECES:
            self.short.clear()
        self.short.update(zip(distinct.tolist(), n.tolist(), strict=True))
        out[short] = n[inverse]
        rest = ~short
        out[rest] = np.fromiter((self[data[a:b]] for a, b in zip(at[rest].tolist(), ends[rest].tolist(), strict=True)), np.int64, int(rest.sum()))
        return out

    def long(self, text: str) -> int:
        """Tokens of a text of any length, a block at a time; a block ends where its last piece begins."""
        total, at, size = 0, 0, BLOCK
        while at + size < len(text):
            starts, n = self.block(text[at : at + size] + TEXT_END)
            # The end that stands here is not the text's: what lies within the last characters may go on otherwise.
            sure = int(np.searchsorted(starts, size - 2)) - 1
            if sure > 0:
                total, at, size = total + int(n[:sure].sum()), at + int(starts[sure]), BLOCK
            else:
                size *= 2
        return total + int(self.block(text[at:] + TEXT_END)[1].sum())

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text; null counts as empty. A special token's string within a text is one token."""
        out = np.zeros(len(texts), np.int64)
        held, rows, size = [], [], 0

        def flush() -> None:
            if held:
                starts, n = self.block("".join(held))
                ends = np.cumsum([len(t) for t in held])
                out[rows] = np.add.reduceat(n, np.searchsorted(starts, np.concatenate([[0], ends[:-1]])))
            held.clear()
            rows.clear()

        for i, text in enumerate(texts):
            if not text:
                continue
            for special in self.vocabulary.special:
                text = text.replace(special, SPECIAL)
            if len(text) > BLOCK:
                out[i] = self.long(text)
                continue
            held.append(text + TEXT_END)
            rows.append(i)
            size += len(text)
            if size >= BLOCK:
                flush()
                size = 0
        flush()
        return out


@lru_cache(maxsize=1)
def counter_of(data: bytes) -> TokenCounter:
    """A worker's own; its tables serve all tasks that it runs."""
    return TokenCounter(data)


def with_token_counts(docs: DataFrame, tokenizer: str = TOKENIZER, name: str = "n_tokens") -> DataFrame:
    """docs with the number of tokens of each text, as a long.

    Rows stay as they are, repeated ones and those without an id too; nothing is shuffled. Null and empty texts have 0
    tokens. A column of docs that has the new one's name is replaced. The vocabulary's file (some MB whatever the input)
    is read on the driver and broadcast. A text may be as long as a row can be: it is taken block by block, and a piece
    that is longer than a block makes that block longer.
    """
    data = docs.sparkSession.sparkContext.broadcast(open(tokenizer, "rb").read())

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = counter_of(data.value)
        for texts in batches:
            yield pd.Series(counter.counts(texts.tolist()))

    return docs.withColumn(name, tokens(F.col("text")))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_token_counts(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")
    return docs.select("doc_id", n_bytes, "n_tokens", (F.col("n_tokens") > LIMIT_TOKENS).alias("over_limit"))
