"""Stages of the pipeline on awkward rows, and each against what it must keep."""

from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_corpus import groups_by_all_pairs

from fleetlens.llm import common, decontaminate, minmax_dedup, mixing, packing, toxicity

SF = "/root/testdata/sf0.001"
KEEPING = [s for s in corpus_pipeline.STAGES if s[0] != "packing"]


def awkward(spark):
    docs = common.table(spark, SF, "documents")
    odd = [(900001, None, None, None, None), (900002, "", "en", "web", 0), (None, "a row without a name that has some words", "en", None, None), (900003, "same " * 3000, "en", "web", 15000), (900003, "same " * 3000, "en", "web", 15000), (900004, " \x00 ünï", "de", "web", 7)]
    return docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumns({"score": F.lit("x"), "kept": F.lit(1), "text_sha256": F.lit("y")})


@pytest.mark.parametrize("name, stage", KEEPING)
def test_stage_keeps_columns_and_rows_of_its_input(spark, name, stage):
    docs = common.stored(awkward(spark).drop("score", "kept", "text_sha256"))
    out = common.stored(stage(spark, docs, SF))
    assert out.columns == docs.columns
    assert out.join(docs, [out[c].eqNullSafe(docs[c]) for c in docs.columns], "left_anti").count() == 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_takes_an_empty_table(spark, name, stage):
    docs = common.table(spark, SF, "documents")
    assert stage(spark, common.stored(docs.where("false")), SF).count() == 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_takes_clashing_columns(spark, name, stage):
    assert stage(spark, common.stored(awkward(spark)), SF).count() > 0


def test_near_dedup_keeps_one_of_each_group(spark):
    text = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (3, "quite another text of seven words here"), (4, None), (5, None)], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, SF).collect()) == [1, 3, 4, 5]


def test_near_dedup_keeps_one_of_repeated_rows(spark):
    text = "a text of more than five words for this case"
    rows = [(1, text, "b"), (1, text, "a"), (1, "another text of the same name with other words", "a"), (None, text, "a"), (None, text, "a"), (2, text + " x", "a")]
    docs = common.stored(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    out = corpus_pipeline.near_dedup_stage(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id or 0), r.text == text) for r in out.collect()) == [(0, True), (0, True), (1, False), (1, True)]


def test_groups_of_a_whole_table_are_those_of_all_pairs(spark):
    """Recall of links, measured: no component of sf0.01 differs from that of all pairs."""
    docs = common.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    sets, group = groups_by_all_pairs(docs)
    found = {r.doc_id: r.component_id for r in minmax_dedup.near_groups(docs).collect()}
    assert found == group and len(sets) == 1000 and len(set(group.values())) < 1000


def test_run_from_documents_to_packed_rows(spark):
    """Each stage's decisions hold in what the last one returns: its ids decode to the mix of the documents kept."""
    docs = common.table(spark, SF, "documents")
    kept = {r.doc_id: r for r in docs.collect()}
    model = toxicity.model_of(docs.select("doc_id", "text"), common.table(spark, SF, "labels").select("doc_id", "toxic"))
    for r in toxicity.score(docs, model).collect():
        if r.score >= toxicity.THRESHOLD:
            del kept[r.doc_id]
    frame = lambda: common.stored(spark.createDataFrame([tuple(r) for r in kept.values()], docs.schema))
    _, group = groups_by_all_pairs(frame())
    kept = {i: r for i, r in kept.items() if group[i] == i}
    items = [r.text for r in common.table(spark, SF, "benchmark").collect()]
    bad = {r.doc_id for r in decontaminate.contaminated(frame(), common.table(spark, SF, "benchmark").select("item_id", "text")).collect()}
    kept = {i: r for i, r in kept.items() if i not in bad}
    assert bad and not any(item in (r.text or "") for item in items for r in kept.values())
    copies = {r.doc_id: r.copies for r in mixing.with_copies(frame()).collect()}
    expected = Counter({(i, r.text or ""): copies[i] for i, r in kept.items() if copies[i]})
    encode, parts = packing.encoding(open(packing.TOKENIZER, "rb").read()), {}
    for r in corpus_pipeline.run(spark, SF).collect():
        ids = np.frombuffer(r.ids, "<u2")
        assert r.cu_seqlens[-1] == r.n_tokens <= len(ids) == packing.SEQ_LEN
        for k, doc_id in enumerate(r.doc_ids):
            parts.setdefault((doc_id, r.shard, r.rows[k]), {})[r.offsets[k]] = ids[r.cu_seqlens[k] : r.cu_seqlens[k + 1]].tolist()
    found: Counter = Counter()
    for (doc_id, *_), segments in parts.items():
        *ids, end = sum((x for _, x in sorted(segments.items())), [])
        assert end == packing.END
        found[doc_id, encode.decode(ids)] += 1
    assert found == expected
