"""Token counts against the tokenizer's own library."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from fleetlens.llm import registry, token_counts


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(token_counts.TOKENIZER)


@pytest.fixture(scope="module")
def counter():
    return token_counts.TokenCounter(open(token_counts.TOKENIZER, "rb").read())


def expected(library, texts):
    return [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def odd_texts(n):
    rng = random.Random(1)
    parts = [
        "'s", "'re", "'ve", "'ll", "'r", "'v", "'l", "'", "'S", " ", "  ", "\n", "\t", "a", "b", "s", "t", "r", "e", "l", "1", "23", "!", "?!", "é", "漢", "<|endoftext|>", "<|", "　", "the", "ing",
        "\U0001f600", "\x1c", "\x85", "\x00", "aaaa", "    ", "----",
    ]
    mixed = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    any_ = ["".join(chr(rng.choice((rng.randint(0, 127), rng.randint(0, 0x2FFF), rng.randint(0xE000, 0x10FFFF)))) for _ in range(rng.randint(0, 60))) for _ in range(n // 5)]
    return [*mixed, *any_, "", "a" * 5000, " " * 3000, "'" * 999, "<|endoftext|>" * 3, "x\n\n <|endoftext|> y"]


def test_odd_texts_as_the_library_counts_them(library, counter):
    texts = odd_texts(6000)
    assert counter.counts([*texts, None]).tolist() == [*expected(library, texts), 0]


def test_long_texts_are_taken_block_by_block(library, counter, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK", 64)
    texts = ["".join(odd_texts(300)[:200]), "a" * 3000 + " b" * 100, "\n " * 400, "it're we'll " * 60, "é" * 500 + "<|endoftext|>" + "'ll" * 200]
    assert [counter.counts([t])[0] for t in texts] == expected(library, texts)


def test_small_tables_of_pieces_and_states_change_nothing(library, monkeypatch):
    monkeypatch.setattr(token_counts, "PIECES", 3)
    monkeypatch.setattr(token_counts, "STATES", 5)
    own = token_counts.TokenCounter(open(token_counts.TOKENIZER, "rb").read())
    texts = odd_texts(200)
    assert own.counts(texts).tolist() == expected(library, texts)


def test_every_code_point_has_the_class_of_the_library(library):
    kinds = token_counts.classes()
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000:
            found = library.pre_tokenizer.pre_tokenize_str(f"a{chr(c)}1")
            joins_letters, joins_number = found[0][1][1] == 2, len(found) == 2 and found[0][1][1] == 1
            k = kinds[c]
            is_letter = token_counts.STMD <= k <= token_counts.LETTER
            assert (joins_letters, joins_number) == (is_letter, k in (token_counts.NUMBER, token_counts.SPACE)), hex(c)


def test_scan_equals_one_step_after_another():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 8, 31):
        maps = rng.integers(0, 13, (n, 13))
        state, want = 4, []
        for m in maps:
            want.append(state)
            state = m[state]
        assert token_counts.scan(maps, 4).tolist() == want


def test_tables_of_rows(spark, library):
    texts = ["one two", None, "", "one two", "it's", "<|endoftext|>"]
    docs = spark.createDataFrame([(None if i == 4 else i % 3, t, i, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens long, n_bytes string")
    got = token_counts.with_token_counts(docs)
    assert sorted(got.columns) == sorted(docs.columns)
    want = sorted(zip(map(str, texts), expected(library, texts), strict=True))
    assert sorted((str(r.text), r.n_tokens) for r in got.collect()) == want
    assert token_counts.with_token_counts(docs.limit(0)).count() == 0


def test_query_on_whole_documents(spark, library):
    got = registry.QUERIES["op11_token_counts"](spark, "/root/testdata/sf0.001")
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = {d.doc_id: (len((d.text or "").encode()), n, n > 512) for d, n in zip(docs, expected(library, [d.text for d in docs]), strict=True)}
    rows = got.collect()
    assert len(rows) == len(docs) and {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows} == want
