"""Texts and cases in packs: words as Spark cuts them, evidence as a plain loop finds it, disk by the texts alone."""

import math
import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import packs, retrieval


def test_words_are_those_of_spark(spark):
    texts = [f"Aa{chr(c)}bB9 x{chr(c)} {chr(c)}y" for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(["".join(texts[k : k + 500]) for k in range(0, len(texts), 500)] + ["", None, "THE İstanbul of", "the and"])], "i int, t string")
    h = packs.Hashes(retrieval.STOP_WORDS, 2)
    for r in df.select("t", retrieval.words_of(F.col("t")).alias("w")).collect():
        assert h.of(r.t).tolist() == [h[w.encode()] for w in r.w]


def test_arrays_come_back():
    counts = packs.np.array([2, 0, 3, 1])
    places = packs.np.array([3, 70_000, 0, 1, 2, 5])
    assert packs._from_places(packs._coded(packs._places(places, counts)), counts).tolist() == places.tolist()
    assert packs._decoded(b"", packs.np.uint64).tolist() == []


def shuffled(spark) -> int:
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(f.stat().st_size for d in dirs for f in Path(d).rglob("shuffle_*.data"))


@pytest.mark.parametrize("cases", [False, True])
def test_disk_does_not_grow_with_the_queries(spark, monkeypatch, cases):
    """Each term of a text was a row, and a row for each chunk of queries again: 50 times the texts here."""
    monkeypatch.setattr(retrieval, "BLOCK", 300)
    monkeypatch.setattr(retrieval, "CHUNK", 30)
    rng = random.Random(4)
    texts = [(i, " ".join(f"w{int(rng.paretovariate(0.5)) % 9000}" for _ in range(150))) for i in range(900)]
    size = sum(len(x) for _, x in texts)
    docs = spark.createDataFrame(texts, "id long, text string").repartition(4).localCheckpoint()
    before = shuffled(spark)
    if cases:
        slides = docs.select((F.col("id") - F.col("id") % 5).alias("case_no"), (F.col("id") % 5).alias("slide_no"), F.lit(retrieval.VERIFIED).alias("source_type"), F.lit("t").alias("title"), F.col("text").alias("content"))
        asks = docs.where("id % 3 = 0").select(F.col("id").alias("query_id"), "text", F.lit("MONITOR").alias("level"), F.lit("PASS").alias("quality"))
        found = retrieval.retrieve_cases(asks, slides)
    else:
        found = retrieval.nearest_texts(docs, "id", "text", docs.where("id % 3 = 0"), "id", "text", 3, same=True)
    assert found.count() == 900
    assert shuffled(spark) - before < 4 * size


def test_evidence_against_a_loop(spark, monkeypatch):
    """Slides that repeat a number, slides without one, cases of empty slides, over several packs and chunks."""
    monkeypatch.setattr(retrieval, "BLOCK", 4)
    monkeypatch.setattr(retrieval, "CHUNK", 3)
    rng = random.Random(8)
    word = lambda: rng.choice([f"w{rng.randrange(6)}", f"r{rng.randrange(60)}"])
    slides = [(c, rng.choice([None, 1, 2, 3, 4]), " ".join(word() for _ in range(rng.choice([0, 1, 4, 9])))) for c in range(25) for _ in range(rng.randrange(1, 6))] + [(30, 1, None), (None, 1, "w1 w2")]
    asked = [(q, " ".join(word() for _ in range(rng.randrange(1, 9))) + " unheard") for q in range(20)] + [(50, "unheard"), (None, "w1")]
    df = spark.createDataFrame([(c, s, retrieval.VERIFIED, "t", x) for c, s, x in slides], "case_no long, slide_no int, source_type string, title string, content string")
    asks = spark.createDataFrame([(q, x, "MONITOR", "PASS") for q, x in asked], "query_id long, text string, level string, quality string")
    found = {(r.query_id, r["rank"]): (r.case_no, round(r.score, 7), r.slides, r.evidence_slide, round(r.evidence_score, 7), r.excerpt) for r in retrieval.retrieve_cases(asks, df, excerpt=9).collect()}
    told: dict = {}
    for c, s, x in sorted(((c, s, x or "") for c, s, x in slides if c is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2])):
        told.setdefault(c, []).append((s, x))
    terms = lambda x: Counter([*x.split(), *(f"{a} {b}" for a, b in zip(x.split(), x.split()[1:]))])
    whole = {c: terms(" ".join(x for _, x in t)) for c, t in told.items()}
    parts = {(c, p): terms(x) for c, t in told.items() for p, (s, x) in enumerate(t) if p == 0 or t[p - 1][0] != s}

    def scores(vectors, q):
        df = Counter(t for v in vectors.values() for t in v)
        weigh = lambda v: {t: (1 + math.log(n)) * (math.log((1 + len(vectors)) / (1 + df[t])) + 1) for t, n in v.items() if df[t] and t in heard}
        length = lambda v: math.sqrt(sum(x * x for x in v.values())) or 1
        mine, out = weigh(q), {}
        for k, v in vectors.items():
            theirs = weigh(v)
            out[k] = round(sum(x * theirs.get(t, 0) for t, x in mine.items()) / length(mine) / length(theirs), 9)
        return out

    heard = {t for v in whole.values() for t in v}
    expected = {}
    for q, x in asked:
        if q is not None:
            near, slide = scores(whole, terms(x)), scores(parts, terms(x))
            for rank, (s, c) in enumerate(sorted((-s, c) for c, s in near.items() if s > 0)[:3], 1):
                b, _, _, p = min((-slide[k], told[c][k[1]][0] is None, told[c][k[1]][0] or 0, k[1]) for k in parts if k[0] == c)
                expected[q, rank] = (c, round(-s, 7), len({n for n, _ in told[c]} - {None}), told[c][p][0], round(-b, 7), told[c][p][1][:9])
    assert found == expected
