"""Texts nearest to others, compared block by block, against a plain loop."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import retrieval
from fleetlens.plans import catalog, evidence

SF = "/root/testdata/sf0.001"


def plain(texts, asked, k, same):
    words = lambda x: [w for w in (x or "").split() if len(w) >= 2]
    counted = lambda x: Counter(words(x) + [f"{a} {b}" for a, b in zip(words(x), words(x)[1:])])
    tf = [(i, counted(x)) for i, x in texts]
    df = Counter(t for _, c in tf for t in c)
    weigh = lambda c: {t: (1 + math.log(n)) * (math.log((1 + len(texts)) / (1 + df[t])) + 1) for t, n in c.items() if t in df}
    length = lambda v: math.sqrt(sum(x * x for x in v.values()))
    vectors, out = [(i, weigh(c)) for i, c in tf], {}
    for q, x in asked:
        mine = weigh(counted(x))
        scores = [(-round(sum(w * v[t] for t, w in mine.items() if t in v) / length(mine) / length(v), 7), i) for i, v in vectors if i is not None and not (same and i == q) and mine.keys() & v.keys()]
        if q is not None and scores:
            out[q] = sorted(scores)[:k]
    return out


@pytest.mark.parametrize("same", [True, False])
def test_blocks_and_chunks_against_a_loop(spark, monkeypatch, same):
    monkeypatch.setattr(retrieval, "BLOCK", 40)
    monkeypatch.setattr(retrieval, "CHUNK", 7)
    rng = random.Random(2)
    texts = [(i, " ".join(rng.choice([f"w{rng.randrange(9)}", f"r{rng.randrange(300)}"]) for _ in range(rng.randrange(1, 30)))) for i in range(300)]
    texts += [(300 + i, texts[i * 7 % 20][1]) for i in range(60)] + [(400, None), (401, ""), (None, texts[3][1])]
    asked = [x for x in texts if x[0] is not None and x[0] % 10 == 0] if same else [(i, texts[i][1] + " unheard") for i in range(0, 300, 9)] + [(7000, "unheard of"), (None, "w1 w2")]
    docs, asks = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(asked, "q long, ask string")
    found = {}
    for r in retrieval.nearest_texts(docs, "id", "text", asks, "q", "ask", 3, same=same).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((-round(r.score, 7), r.id))
    assert found == plain(texts, asked, 3, same)


def test_names_that_are_no_numbers_and_no_texts(spark):
    docs = spark.createDataFrame([("b", "red pump"), ("a", "red pump"), ("c", "blue valve")], "id string, text string")
    asks = spark.createDataFrame([("x", "red pump")], "q string, ask string")
    found = retrieval.nearest_texts(docs, "id", "text", asks, "q", "ask", 3).orderBy("rank").collect()
    assert [(r.query_id, r.id, r.score) for r in found] == [("x", "a", 1.0), ("x", "b", 1.0)]
    assert retrieval.nearest_texts(docs.limit(0), "id", "text", asks, "q", "ask").count() == 0
    assert retrieval.nearest_texts(docs, "id", "text", asks.limit(0), "q", "ask").count() == 0


@pytest.mark.parametrize("name", ["txt2_nearest_documents", "txt4_exact_first_evidence", "txt6_qualified_slides", "txt2_case_retrieval", "txt7_guidance"])
def test_no_pairs_are_shuffled(spark, monkeypatch, name):
    def pairs(*_):
        raise AssertionError("pairs of queries and texts as rows")

    monkeypatch.setattr(retrieval, "posted", pairs)
    assert (catalog.OPERATORS | evidence.OPERATORS)[name][0](spark, SF).count() > 0


def test_cases_and_their_slides_share_one_count_of_terms(spark):
    """cases and slides went through shuffles of their own, with their texts."""
    slides = [(1, 2, "seal leak seal"), (1, 1, "pump bearing"), (1, 3, "of the"), (1, 4, "leak found"), (1, 2, "pump seal"), (2, 1, "leak found"), (3, 1, None), (None, 1, "pump")]
    df = spark.createDataFrame([(c, s, "real_rca_backed", "t", x) for c, s, x in slides], "case_no long, slide_no int, source_type string, title string, content string")
    cases = retrieval.verified_cases(df).persist()
    assert {r.case_no: (r.slides, len(r.told)) for r in cases.collect()} == {1: (4, 5), 2: (1, 1), 3: (1, 1)}
    t = retrieval.case_terms(cases).persist()
    whole = retrieval.terms(cases.select("case_no", F.concat_ws(" ", "told.content").alias("x")), "case_no", "x")
    assert sorted((r.id, r.term, r.tf) for r in t.collect()) == sorted((r.id, r.term, r.tf) for r in whole.collect())
    # Of two texts with the number 2 the first in order is the slide; pairs across slides are in none.
    found = {(r.id, r.term): sorted((x.p, x.n) for x in r["at"]) for r in t.collect()}
    assert found[1, "seal"] == [(1, 1)]
    assert found[1, "bearing pump"] == [] and found[1, "leak found"] == [(4, 1)] and found[2, "leak found"] == [(0, 1)]
    asked = retrieval.terms(spark.createDataFrame([(7, "pump leak")], "q long, x string"), "q", "x")
    raw = {(r.id, r.v > 0, r.idf is None) for r in retrieval.case_weights(t, asked, spark.createDataFrame([(3, 6)], "n long, m long")).where("both AND NOT asks").collect()}
    assert raw == {(1, True, False), (2, True, False)}
