"""Collocations against plain counting."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from fleetlens.llm import collocations, registry

SCHEMA = "lang string, text string"


def words_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", piece) for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower)]


def counts_of(rows, most_words):
    counts = defaultdict(Counter)
    for lang, text in rows:
        for w in words_of(text):
            for m in range(1, most_words + 1):
                counts[lang or "und"].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    return counts


def plain(rows, least=10, most_words=3, top=2000, inside=50):
    out = []
    for lang, f in counts_of(rows, most_words).items():
        n = sum(a for p, a in f.items() if len(p) == 1)
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in found.items():
            if any(100 * b >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items() if len(q) > len(p)):
                continue
            score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def odd_rows(n=150):
    rng = random.Random(8)
    words = ["the", "The", "New", "new", "york", "times", "é", "naïve", "a\x1cb", "x", "y", "z", "\x00", "10"]
    ends = [" ", "  ", "\t", " ", " ", ". ", ",", "\n", "\r\n", "\x0b", "? "]
    text = lambda: "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randint(0, 60)))
    rows = [(rng.choice(["en", "de", None, "und"]), text()) for _ in range(n)]
    return [*rows, *[("en", "new york times new york")] * 12, ("en", None), (None, None), ("en", ""), ("fr", "one time only"), ("en", "x y " * 500)]


@pytest.mark.parametrize("options", [{}, {"least": 3, "most_words": 4, "top": 7, "inside_percent": 80}, {"most_words": 2, "least": 1, "top": 30}])
def test_odd_rows(spark, options):
    rows = odd_rows()
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("lang", "text", "1 AS rank", "'x' AS phrase", "2 AS a").repartition(3)
    names = {"inside_percent": "inside"}
    got = sorted(map(tuple, collocations.collocations(frame, **options).collect()))
    assert got == plain(rows, **{names.get(k, k): v for k, v in options.items()}) and got


def test_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).collect() == []


def phrases(counter, blocks):
    out = Counter()
    runs = [r for lang, data in blocks for r in counter.add(lang, data)] + list(counter.runs(0))
    for r in runs:
        assert r.column(2).to_pylist() == sorted(r.column(2).to_pylist(), key=lambda p: [collocations.word_hash(w) for w in p.encode().split(b" ")])
        for _, lang, phrase, a in zip(*(c.to_pylist() for c in r.columns), strict=True):
            out[lang, phrase] += a
    return out, len(runs)


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_small_memory_spills_and_bursts_to_the_same_counts(n, monkeypatch):
    rows = [(lang or "und", text or "") for lang, text in odd_rows()]
    blocks = [(lang, text.encode()) for lang, text in rows]
    everything = np.full(1 << 12, 255, np.uint8)
    want, _ = phrases(collocations.PhraseCounter(n, everything), blocks)
    plainly = {(lang, " ".join(p)): a for lang, f in counts_of(rows, n).items() for p, a in f.items() if len(p) == n}
    assert want == plainly
    for name, value in (("BURST", 3), ("ENTRIES", 20), ("NAMES", 12), ("BLOCK", 40)):
        monkeypatch.setattr(collocations, name, value)
    monkeypatch.setattr(collocations.common, "pieces", lambda data, size, f=collocations.common.pieces: f(data, 40))
    got, runs = phrases(collocations.PhraseCounter(n, everything), blocks)
    assert got == want and runs > 30


def test_trie_splits_its_ranges_and_keeps_its_counts(monkeypatch):
    monkeypatch.setattr(collocations, "BURST", 50)
    rng, trie, want = np.random.default_rng(1), collocations.HatTrie(), Counter()
    for _ in range(40):
        keys = rng.integers(0, 30, 100).astype(np.uint64) << np.uint64(32) | rng.integers(0, 20, 100).astype(np.uint64)
        keys, n = np.unique(keys, return_counts=True)
        trie.add(keys, n)
        want.update(dict(zip(keys.tolist(), n.tolist(), strict=True)))
    assert len(trie.held) > 5 and trie.size == len(want) and all(lo < hi for lo, hi in zip(trie.lows, trie.lows[1:], strict=False))
    assert {k: n for keys, counts in trie.take(0) for k, n in zip(keys.tolist(), counts.tolist(), strict=True)} == dict(want) and trie.size == 0


def test_filter_holds_all_its_phrases_and_few_others(spark):
    known = [("en", f"w{i} v{i}") for i in range(3000)]
    bits = collocations.filter_of(spark.createDataFrame(known, "lang string, phrase string"))

    def held(lang, phrase):
        h = np.array([collocations.word_hash(lang.encode())], np.uint64)
        for w in phrase.encode().split(b" "):
            h = collocations.grown(h, np.array([collocations.word_hash(w)], np.uint64))
        return bool(collocations.may_hold(bits, h)[0])

    assert all(held(*k) for k in known)
    assert sum(held("de", p) for _, p in known) + sum(held("en", p + "x") for _, p in known) < 300


def test_products_beyond_64_bits_are_exact(spark):
    rng = random.Random(6)
    rows = [(a := rng.randint(10, 10**12), a * rng.randint(1, 900), a + rng.randint(0, 10**9)) for _ in range(300)] + [(10**13, 10**13, 10**13)]
    got = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", collocations.cut_score().alias("score")).collect()
    assert all(r.score == 1000000 * r.a * r.a // (r.l * r.r) for r in got)


def test_query_on_whole_documents(spark):
    got = registry.QUERIES["op13_collocations"](spark, "/root/testdata/sf0.001")
    assert dict(got.dtypes) == {c: "string" if c in ("lang", "phrase") else "bigint" for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")}
    duck = duckdb.connect()
    duck.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(duck.execute(registry.ORACLE_SQL["op13_collocations"]).fetchall())
