"""Corpus operators against brute force and on odd rows."""

import base64
import hashlib
import math
import random
import struct
import time
from collections import Counter

import numpy as np
import pytest
import zstandard

from fleetlens.llm import common, decontaminate, exact_dedup, lattice_lm, minmax_dedup, mixing, packing, registry, suffix_dedup, toxicity, urls, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(("ta", "ri", "mo", "sel", "ku")) for _ in range(rng.randint(1, 3)))
    texts = [" ".join(word() for _ in range(rng.randint(1, 120))) for _ in range(40)]
    passage = " ".join(word() for _ in range(60))
    near = texts[0].split() + passage.split()
    rows = [*texts, texts[3], texts[3].upper(), f"{texts[5]} {passage}", f"{passage} {texts[6]}", " ".join(near), " ".join([*near[:-1], "zz"]), "", None, "   ", "é" * 300, "a" * 500, "one two", "one  two", passage + "\n" + passage]
    return spark.createDataFrame([(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", 0) for i, t in enumerate(rows)], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingle_sets(docs):
    out = {}
    for r in docs.collect():
        w = (r.text or "").encode().lower().split()
        out[r.doc_id] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def groups_by_all_pairs(docs):
    sets = shingle_sets(docs)
    group = {i: i for i in sets}
    links = [(i, j) for i in sets for j in sets if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            if group[i] != group[j]:
                group[i] = group[j] = min(group[i], group[j])
                changed = True
    return sets, group


def test_near_groups_against_all_pairs(spark, docs):
    sets, group = groups_by_all_pairs(docs)
    got = minmax_dedup.near_groups(docs).collect()
    assert {r.doc_id: r.component_id for r in got} == group
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(s) for i, s in sets.items()}
    assert minmax_dedup.near_groups(empty(spark)).count() == 0


def test_rows_of_one_name_are_one_document(spark):
    """Different texts under one doc_id, each near to others': all are linked by name, whichever text is read first."""
    base = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcd"]
    rows = [(5, base[0]), (5, base[1]), (7, base[0] + " more"), (8, base[1] + " more"), (3, base[2]), (5, base[2]), (9, base[3]), (9, base[3]), (10, ""), (10, base[3] + " x"), (None, base[0]), (11, None)]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        got = {(r.doc_id, r.component_id, r.kept) for r in minmax_dedup.near_groups(docs).collect()}
        assert got == {(5, 3, False), (7, 3, False), (8, 3, False), (3, 3, True), (9, 9, True), (10, 9, False), (None, 3, True), (11, 11, True)}


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_of_one_text_against_all_pairs(spark, seed):
    """Variants at all distances from a text, some of them cut short: many buckets hold several components."""
    rng = random.Random(seed)
    text, rows = [f"w{rng.randint(0, 999)}" for _ in range(150)], []
    for _ in range(220):
        words = text[:] if rng.random() < 0.7 else text[: rng.randint(100, 149)]
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 3)}"
        rows.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    _, group = groups_by_all_pairs(docs)
    found = {r.doc_id: r.component_id for r in minmax_dedup.near_groups(docs).collect()}
    assert found == group and 5 < len(set(group.values())) < 200


@pytest.mark.parametrize("large", [1, 2000])
@pytest.mark.parametrize("block", [1 << 20, 150])
def test_repeats_against_all_strings(spark, docs, monkeypatch, large, block):
    """With large = 1, all anchors are hot and all buckets large; a block of 150 bytes cuts most texts in parts."""
    monkeypatch.setattr(suffix_dedup, "LARGE_BUCKET", large)
    monkeypatch.setattr(suffix_dedup, "TEXT_BLOCK", block)
    seen, expected = set(), {}
    for r in sorted(docs.collect()):
        b = (r.text or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        expected[r.doc_id] = (len(b), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), kept)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.without_repeats(docs).collect()}
    assert got == expected
    assert suffix_dedup.without_repeats(empty(spark)).count() == 0


def test_repeated_rows_are_one_document(spark):
    """Rows equal in doc_id and text keep their strings; a null doc_id comes first, and other rows still lose theirs."""
    rng = random.Random(9)
    a, b, c = ("".join(rng.choice("abcdefgh ") for _ in range(300)) for _ in range(3))
    rows = [(1, a), (1, a), (1, a), (1, b), (2, a), (2, a), (3, "x" + b), (None, c), (None, c), (4, c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffix_dedup.without_repeats(docs).collect())
    assert got == [(0, 300, 0), (0, 300, 0), *[(1, 300, 0)] * 4, (2, 300, 300), (2, 300, 300), (3, 301, 300), (4, 300, 300)]


def test_hot_anchor_is_dealt_to_many_tasks(spark):
    """A line in all texts, each with other words around it: no task has a large part of its anchors' runs."""
    from pyspark.sql import functions as F

    rng, line = random.Random(3), "this one line of a licence stands in each and every one of the documents"
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(9))
    rows = [(i, i, " ".join(word() for _ in range(4)) + f" {line} " + " ".join(word() for _ in range(4))) for i in range(3000)]
    docs = common.stored(spark.createDataFrame(rows, "doc_id long, tag long, text string").repartition(8))
    hot = suffix_dedup.hot_bins(docs, 1000)
    assert 0 < hot.sum() < 10
    runs = suffix_dedup.dealt_runs(docs, hot).where(F.col("off") >= suffix_dedup.MARK)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    total, parts = runs.count(), [r["count"] for r in runs.groupBy(F.spark_partition_id()).count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert total >= 3000 and len(parts) >= 4 and max(parts) < 2 * total / len(parts)
    assert suffix_dedup.hot_bins(docs.limit(0)).sum() == 0


def test_cover_holds_all_differences():
    assert {(a - b) % suffix_dedup.PERIOD for a in suffix_dedup.COVER for b in suffix_dedup.COVER} == set(range(suffix_dedup.PERIOD))


def test_heavy_keys_go_to_many_tasks(spark):
    """A key with most rows is joined in many tasks; the salt stays in the join's keys."""
    from pyspark.sql import functions as F

    fact = spark.range(20_000).select(F.when(F.col("id") % 10 > 0, 1).otherwise(F.col("id")).alias("k"), "id")
    groups = common.stored(fact.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m")))
    for name, value in (("spark.sql.adaptive.coalescePartitions.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
        spark.conf.set(name, value)
    joined = common.heavy_join(fact, groups, ["k"], F.col("id"))
    parts = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    for name in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold"):
        spark.conf.unset(name)
    assert len(parts) == 4 and max(parts) < 7_000 and sum(parts) == 20_000
    assert joined.where("n IS NULL OR m < id").count() == 0


def test_sets_with_many_partners_go_to_many_tasks(spark):
    """Pairs of one set, on either side, meet its copies in chunks; each pair finds both sets."""
    from pyspark.sql import functions as F

    pairs = common.stored(spark.range(1, 5000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b")).unionByName(spark.range(1, 5000).select(F.col("id").alias("a"), F.lit(9999).cast("long").alias("b"))))
    sets = common.stored(spark.range(10_000).select("id", F.encode(F.col("id").cast("string"), "UTF-8").alias("shingles")))
    out = minmax_dedup.attached(pairs, sets, a="sa", b="sb")
    assert out.where(F.decode("sa", "UTF-8") == F.col("a").cast("string")).where(F.decode("sb", "UTF-8") == F.col("b").cast("string")).count() == 9998
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    parts = [r["count"] for r in minmax_dedup.attached(pairs, sets, a="sa", b="sb").groupBy(F.spark_partition_id()).count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(parts) == 4 and max(parts) < 4000


def test_components_of_a_hub_and_a_path(spark):
    hub = [(7, k) for k in range(100, 400)]
    path = [(k, k + 1) for k in range(1000, 1040)]
    edges = spark.createDataFrame(hub + path + [(5, 5)], "a long, b long")
    nodes = spark.createDataFrame([(k,) for k in [5, 6, 7, *range(100, 400), *range(1000, 1041)]], "id long")
    got = {r.id: r.label for r in minmax_dedup.components(nodes, edges).collect()}
    assert got == {5: 5, 6: 6, 7: 7, **{k: 7 for k in range(100, 400)}, **{k: 1000 for k in range(1000, 1041)}}
    assert minmax_dedup.components(nodes, edges.limit(0)).where("id <> label").count() == 0


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups_verify_bytes(spark, docs, weak):
    from pyspark.sql import functions as F

    digest = (lambda t: F.unhex(F.substring(F.sha2(t, 256), 1, 2))) if weak else exact_dedup.full_digest
    fold = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    rows = {r.doc_id: fold(r.text) for r in docs.collect()}
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(docs, digest=digest).collect()}
    for i, t in rows.items():
        same = [j for j, u in rows.items() if u == t]
        assert got[i] == (max(same), len(same), i == max(same), hashlib.sha256(t.encode()).hexdigest())


def test_index_takes_a_second_batch(spark):
    """A second batch finds the first one's texts; the filters name few runs but the right ones; then runs are merged."""
    from pyspark.sql import functions as F

    text = F.concat(F.lit("text "), F.col("id").cast("string"))
    rows = lambda a, b, shift=0: common.stored(spark.range(a, b).select((F.col("id") + shift).alias("id"), F.unhex(F.sha2(text, 256)).alias("digest")))
    index = exact_dedup.DigestIndex(spark, expected=2000)
    first = rows(0, 2000)
    assert index.lookup(first).where("n > 0 OR keep_id IS NOT NULL").count() == 0
    index.flush(first)
    assert index.flush(rows(5000, 7000), runs=2).select("run").distinct().count() == 2
    batch = rows(1500, 3500, 10_000)  # 500 of 2,000 are in run 0
    named = index.candidates(batch).groupBy("run").count().collect()
    assert sum(r["count"] for r in named if r.run == 0) >= 500 and sum(r["count"] for r in named) < 500 + 0.05 * 6000
    found = index.lookup(batch)
    assert found.count() == 2000 and found.where("n = 1 AND keep_id = id - 10000").count() == 500 and found.where("n = 0").count() == 1500
    index.flush(batch)
    merged = index.compact()
    assert (merged.count(), len(index.runs), merged.where("n = 2").count(), merged.select("run").distinct().count()) == (5500, 1, 500, 1)
    assert index.lookup(batch).where("keep_id = id - 10000 AND n = 2 OR keep_id = id AND n = 1").count() == 2000
    files = merged.select("digest", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i"))
    assert all(x == sorted(x) for x in ([bytes(d) for d in r.d] for r in files.groupBy("f").agg(F.expr("transform(array_sort(collect_list(struct(i, digest))), x -> x.digest)").alias("d")).collect()))


def test_exact_groups_of_odd_tables(spark):
    """No rows; null and repeated ids; columns that clash; each row has its result."""
    schema = "doc_id long, text string, id long, digest string, n int, run int, keep_id long"
    assert exact_dedup.exact_groups(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "A b"), (1, "a b"), (None, "a b"), (2, "z"), (None, None), (None, ""), (1, "other"), (3, "Éa"), (4, "éa")]
    docs = spark.createDataFrame([(*r, 9, "x", 9, 9, 9) for r in rows], schema)
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs).collect()), key=str)
    assert got == sorted([(1, 1, 3, True), (1, 1, 3, True), (None, 1, 3, False), (2, 2, 1, True), (None, None, 2, True), (None, None, 2, True), (1, 1, 1, True), (3, 3, 1, True), (4, 4, 1, True)], key=str)


def _by_all_segmentations(weight, word):
    """The sum over all segmentations, byte by byte, in plain probabilities."""
    s, total = b" " + word, [1.0] + [0.0] * (len(word) + 1)
    for j in range(1, len(s) + 1):
        total[j] = sum(total[i] * weight.get(s[i:j], 0) for i in range(j))
    return total[-1]


def test_lattice_sums_all_segmentations():
    weight = dict(lattice_lm.load_vocabulary())
    assert sum(weight.values()) == pytest.approx(1)
    lattice = lattice_lm.Lattice(list(weight), np.log(list(weight.values())))
    words = [b"tarimo", "été".encode(), b"a", b"x" * 30, b"inter" * 9, b"the"]
    for w, got in zip(words, lattice.log10(words)[:, 0]):
        assert got == pytest.approx(math.log10(_by_all_segmentations(weight, w)))
    # Uses expected by a derivative: d log P / d log weight.
    pieces, uses = list(weight), lattice.expected(words)
    for p in (b" the", b"er", b"t", b" t", b"ri"):
        more = {**weight, p: weight[p] * math.exp(1e-6)}
        change = sum(math.log(_by_all_segmentations(more, w)) - math.log(_by_all_segmentations(weight, w)) for w in words)
        assert uses[pieces.index(p)] == pytest.approx(change / 1e-6, abs=1e-4)


def test_words_of_any_length(monkeypatch):
    """A word longer than LONG_WORD, over several chunks, and one of 10,000 bytes, which takes no second."""
    vocabulary = lattice_lm.load_vocabulary()
    words = ["".join(random.Random(k).choice("abcdefé") for _ in range(n)).encode() for k, n in enumerate((40, 300, 900))]
    make = lambda: lattice_lm.Lattice([p for p, _ in vocabulary], np.log([w for _, w in vocabulary]))
    whole, uses = make().log10(words), make().expected(words)
    monkeypatch.setattr(lattice_lm, "LONG_WORD", 20)
    monkeypatch.setattr(lattice_lm, "CHUNK", 128)
    assert make().log10(words) == pytest.approx(whole, rel=1e-12)
    assert make().expected(words) == pytest.approx(uses, abs=1e-9)
    monkeypatch.undo()
    start = time.time()
    assert -1e5 < make().log10([b"qzx9" * 2500])[0, 0] < -1e3 and time.time() - start < 2


@pytest.mark.parametrize("by, hot", [(None, 20), ("lang", 100_000)])
def test_scores_against_one_draw_at_a_time(spark, docs, by, hot):
    """score is the sum over classes of the product over words, in order, of urn and lattice; base is as asked."""
    from pyspark.sql import functions as F

    odd = spark.createDataFrame([(900, "w" * 70 + " a " + "w" * 70, "fr", "s", 0), (901, "ta " * 30 + "mo", "fr", None, 0), (None, "ta ri", None, None, 0), (3, "two two", "de", "s", 0)], SCHEMA)
    docs = common.stored(docs.unionByName(odd).withColumns({"n": F.lit(1), "c": F.lit("x"), "row": F.lit(0)}))
    words, model = lattice_lm.learned(docs, F.coalesce(F.col("doc_id") < 30, F.lit(False)) | (F.col("doc_id") == 901), by, rounds=1)
    rows = docs.select("doc_id", "text", "lang").collect()
    split = lambda t: (t or "").encode().lower().split()
    known = [r for r in rows if r.doc_id is not None and (r.doc_id < 30 or r.doc_id == 901)]
    classes = sorted({r.lang if by else "" for r in known}, key=lambda k: (-sum((r.lang if by else "") == k for r in known), k))
    uses = {k: Counter(w for r in known if not by or r.lang == k for w in split(r.text)) for k in classes}
    texts = [sum(not by or r.lang == k for r in known) for k in classes]
    c = sum(uses.values(), Counter()) + Counter({lattice_lm.END: len(known)})
    n, v = sum(c.values()), len(c)
    weights = [dict(zip(model.pieces, np.exp(model.log_weights[:, k]))) for k in range(len(classes))]
    spelled = {}

    def chance(words):
        parts = []
        for k, name in enumerate(classes):
            seen, ones, twos = uses[name], sum(x == 1 for x in uses[name].values()), sum(x == 2 for x in uses[name].values())
            m, d = sum(seen.values()), min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5
            end = texts[k] / (texts[k] + m)
            p, mine = math.log10(texts[k] / sum(texts) * end), Counter()
            for i, w in enumerate(words):
                if (k, w) not in spelled:
                    spelled[k, w] = _by_all_segmentations(weights[k], w)
                first = max(0, seen[w] - d) / m + d * len(seen) / m * spelled[k, w]
                if model.cache * first + mine[w] < 1e-290:  # too long a word for plain probabilities
                    return None
                p += math.log10((1 - end) * (model.cache * first + mine[w]) / (model.cache + i))
                mine[w] += 1
            parts.append(p)
        return max(parts) + math.log10(sum(10 ** (x - max(parts)) for x in parts))

    got = {(r.doc_id, r.n_tokens, round(r.base_score, 6)): r for r in lattice_lm.score(docs, words, model, hot).collect()}
    assert sum(r.doc_id is None for r in got.values()) == 1
    for r in rows:
        tokens = [*split(r.text), lattice_lm.END]
        base = sum(math.log10((c[t] + 1) / (n + v + 1)) for t in tokens)
        o = got[r.doc_id, len(tokens), round(base, 6)]
        assert (o.n_known, o.train_tokens) == (sum(c[t] > 0 for t in tokens), n)
        expected = chance(tokens[:-1])
        assert (o.score == pytest.approx(expected, rel=1e-9)) if expected is not None else (-9999 < o.score < -50), (r, o, expected)


def test_scores_without_training_or_rows(spark, docs):
    from pyspark.sql import functions as F

    words, model = lattice_lm.learned(docs, F.lit(False), "lang")
    out = lattice_lm.score(docs, words, model).collect()
    assert len(out) == docs.count() and all(r.train_tokens == r.n_known == 0 and math.isfinite(r.score) and r.score < 0 for r in out)
    words, model = lattice_lm.learned(empty(spark), F.lit(True), "lang")
    assert lattice_lm.score(empty(spark), words, model).count() == 0


def test_archives_round_trip_and_damage(spark):
    html = ["x" * 200, "x" * 200, None, "", "short", "short", "<p>é</p>" * 50] * 4
    pages = spark.createDataFrame([(i, f"http://h/{i}" if i % 5 else None, h) for i, h in enumerate(html)], "page_id long, url string, html string")
    archives = warc.write_archives(warc.with_revisits(pages).coalesce(1), 3000).collect()
    got = {r.page_id: r for r in warc.checked(warc.read_archives(spark.createDataFrame(archives))).collect()}
    for i, h in enumerate(html):
        data = (h or "").encode()
        first = html.index(h)
        again = len(data) >= 100 and first < i
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].refers_to) == (len(data), hashlib.sha256(data).hexdigest(), first if again else None)
        assert again or bytes(got[i].payload) == data
    damaged = bytearray(archives[0].content)
    damaged[-20] ^= 255
    assert [r.error for r in warc.read_archives(spark.createDataFrame([("x", bytes(damaged))], "path string, content binary")).collect() if r.error]
    assert warc.parse_record(b"WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\n")["error"].startswith("missing")


def _record(kind, block, http=True, **fields):
    head = {"WARC-Type": kind, "WARC-Record-ID": "<urn:uuid:1>", "WARC-Date": "2020-01-01T00:00:00Z", "Content-Length": str(len(block))}
    head |= {k.replace("_", "-"): v for k, v in fields.items()} | ({"Content-Type": "application/http; msgtype=response"} if http else {})
    return b"WARC/1.0\r\n" + b"".join(f"{k}: {v}\r\n".encode("latin-1") for k, v in head.items()) + b"\r\n" + block + b"\r\n\r\n"


def test_archives_of_others_on_disk(spark, tmp_path):
    """sha1 digests, records of other types, chunked bodies, odd bytes in headers; with dictionary, without, skippable frames."""
    body = b"<p>hello</p>" * 20
    sha1 = base64.b32encode(hashlib.sha1(body).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\nX: caf\xe9\r\n\r\n" % len(body)
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + b"%x\r\n%s\r\n0\r\n\r\n" % (len(body), body)
    good = [
        (_record("warcinfo", b"software: x\r\n", http=False), "warcinfo", b"software: x\r\n"),
        (_record("request", b"GET / HTTP/1.1\r\n\r\n", http=False), "request", b"GET / HTTP/1.1\r\n\r\n"),
        (_record("response", http + body, WARC_Payload_Digest="sha1:" + sha1, WARC_Target_URI="http://h/caf\xe9"), "response", body),
        (_record("response", chunked, WARC_Payload_Digest="sha1:" + hashlib.sha1(body).hexdigest()), "response", body),
        (_record("response", chunked, WARC_Payload_Digest="sha1:" + hashlib.sha1(chunked.partition(b"\r\n\r\n")[2]).hexdigest()), "response", body),
        (_record("response", b"HTTP/1.1 204 No Content\r\n\r\n", WARC_Payload_Digest="blake9:zz"), "response", b""),
        (_record("revisit", http, WARC_Refers_To_Target_URI="http://h/"), "revisit", None),
        (_record("metadata", b"", http=False), "metadata", b""),
    ]
    bad = [
        (_record("response", http + body, WARC_Payload_Digest="sha1:" + sha1[::-1]), "payload digest differs"),
        (_record("response", http.replace(b"Content-Length: 240", b"Content-Length: 2x0") + body), "HTTP Content-Length is no number"),
        (_record("response", http + body + b"!"), "HTTP Content-Length is not the payload's length"),
        (_record("response", b"no header"), "no HTTP header"),
        (_record("revisit", http), "revisit refers to nothing"),
        (_record("metadata", b"x", http=False, WARC_Block_Digest="md5:00"), "block digest differs"),
        (_record("response", http + body)[:-1], "Content-Length is not the block's length"),
    ]
    records = [r for r, *_ in good] + [r for r, _ in bad]
    plain = zstandard.ZstdCompressor()
    skip = struct.pack("<II", 0x184D2A50, 3) + b"pad"
    (tmp_path / "plain.warc.zst").write_bytes(skip.join(plain.compress(r) for r in records))
    trained = zstandard.train_dictionary(2000, records * 4, k=64, d=8)
    packer = zstandard.ZstdCompressor(dict_data=trained)
    raw_dict = struct.pack("<II", 0x184D2A5D, len(trained.as_bytes())) + trained.as_bytes()
    (tmp_path / "trained.warc.zst").write_bytes(raw_dict + b"".join(packer.compress(r) for r in records))
    (tmp_path / "empty.warc.zst").write_bytes(b"")
    (tmp_path / "wrong.warc.zst").write_bytes(b"".join(packer.compress(r) for r in records))
    (tmp_path / "cut.warc.zst").write_bytes((raw_dict + packer.compress(records[2]))[:-3])
    (tmp_path / "own.warc.zst").write_bytes(warc.pack_archive([warc.record_bytes(k, "http://h/", body, len(body), hashlib.sha256(body).hexdigest(), None) for k in range(20)]))
    rows: dict = {}
    for r in warc.read_archives(spark.read.format("binaryFile").load(str(tmp_path))).collect():
        rows.setdefault(r.path.rpartition("/")[2], []).append(r)
    for name in ("plain.warc.zst", "trained.warc.zst"):
        found = sorted(rows.pop(name), key=lambda r: r.record)
        assert len(found) == len(records)
        for r, (_, kind, payload) in zip(found, good):
            assert (r.error, r.record_type, None if r.payload is None else bytes(r.payload)) == (None, kind, payload) and r.record_id == "<urn:uuid:1>"
        assert [r.error for r in found[len(good) :]] == [e for _, e in bad]
    assert [r.page_id for r in sorted(rows["own.warc.zst"], key=lambda r: r.record)] == list(range(20))
    assert {k: len(v) for k, v in rows.items()} == {"own.warc.zst": 20, "wrong.warc.zst": 1, "cut.warc.zst": 1}
    assert all(r.error.startswith("archive: ") for k in ("wrong.warc.zst", "cut.warc.zst") for r in rows[k])


def test_parser_survives_any_bytes():
    rng, seed = random.Random(2), _record("response", b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nabc", WARC_Payload_Digest="sha1:x")
    for _ in range(3000):
        raw = bytearray(seed)
        for _ in range(rng.randint(1, 6)):
            raw[rng.randrange(len(raw))] = rng.randrange(256)
        assert set(warc.parse_record(bytes(raw))) <= {x.split()[0] for x in warc.RECORD.split(", ")}


def test_archives_of_odd_tables(spark):
    """No rows; html above one archive; columns that clash; repeated and null ids."""
    schema = "page_id long, url string, html string, payload string, refers_to long, n long, first int"
    assert warc.read_archives(warc.write_archives(warc.with_revisits(spark.createDataFrame([], schema)))).count() == 0
    long = "ab " * 40_000
    pages = spark.createDataFrame([(i, None, h, "x", 5, 5, 5) for i, h in ((1, long), (1, long), (2, long), (None, long), (3, None))], schema)
    got = sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in warc.checked(warc.read_archives(warc.write_archives(warc.with_revisits(pages), 1000))).collect())
    assert got == [(0, "response", None, 120_000), (1, "response", None, 120_000), (1, "response", None, 120_000), (2, "revisit", 1, 120_000), (3, "response", None, 0)]


def test_mix_meets_targets(spark, docs):
    out = mixing.with_copies(docs).collect()
    total = sum(r.size for r in out)
    targets = {r.source: (r.target, r.source_size) for r in out}
    assert sum(t for t, _ in targets.values()) == pytest.approx(total)
    assert all(t <= 3 * s + 1e-6 for t, s in targets.values()) and all(0 <= r.copies <= 3 for r in out)
    assert mixing.mixed(docs).count() == sum(r.copies for r in out)
    assert mixing.with_copies(empty(spark)).count() == 0


def test_packing_loses_nothing(spark, docs):
    rows = packing.packed(docs, seq_len=64, block_tokens=500).collect()
    encode, parts = packing.encoding(open(packing.TOKENIZER, "rb").read()), {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == 64 and r.cu_seqlens[-1] == r.n_tokens <= 64 and r.position_resets == r.cu_seqlens[:-1]
        for k, (d, at) in enumerate(zip(r.doc_ids, r.offsets)):
            parts.setdefault(d, {})[at] = ids[r.cu_seqlens[k] : r.cu_seqlens[k + 1]].tolist()
    for r in docs.collect():
        assert sum((x for _, x in sorted(parts[r.doc_id].items())), []) == [*encode.encode_ordinary(r.text or ""), packing.END]
    sizes = [random.Random(1).randint(1, 100) for _ in range(300)]
    bins = packing.best_fit_decreasing(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(300)) and all(sum(sizes[i] for i in b) <= 100 for b in bins)
    assert len(bins) <= 11 / 9 * -(-sum(sizes) // 100) + 1


def test_odd_spaces_encode_as_the_whole_text():
    e = packing.Encoder(open(packing.TOKENIZER, "rb").read())
    for t in ("a  b", "a \n b", "\n\n x", "tail  ", "  ", "it's  a\ttest  x \n", "a\n  b"):
        assert e.ids(t).tolist() == [*e.encode(t), packing.END]


def test_ids_are_the_tokenizers_on_any_white_space():
    """100,000 random strings in which all kinds of white space stand beside words, marks and each other."""
    e, rng = packing.Encoder(open(packing.TOKENIZER, "rb").read()), random.Random(4)
    parts = [" "] * 6 + ["\u00a0", "\u3000", "\u2003", "\u0085", "\x1c", "\u200b", "\t", "\n", "\r", "a", "bc", "é", "'s", "'", "1", "中", ".", "!!", "It's"]
    for _ in range(100_000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert e.ids(t).tolist() == [*e.encode(t), packing.END], t


def test_best_fit_decreasing_is_that_of_a_plain_search():
    rng = random.Random(8)
    for most in (7, 64, 100):
        sizes = [rng.randint(1, most) for _ in range(400)]
        bins, free = [], []
        for i in sorted(range(400), key=lambda k: (-sizes[k], k)):
            fits = [f for f in free if f >= sizes[i]]
            if fits:
                free.remove(min(fits))
                free.append(min(fits) - sizes[i])
            else:
                free.append(most - sizes[i])
        bins = packing.best_fit_decreasing(sizes, most)
        assert sorted(most - sum(sizes[i] for i in b) for b in bins) == sorted(free)


def test_packing_of_odd_tables(spark):
    """No rows; a text above a block without a space; a null doc_id and a repeated row; columns that clash."""
    assert packing.packed(empty(spark)).count() == 0
    schema = "doc_id long, text string, ids string, block int, row int"
    long = "x" + "ab1" * 3000
    docs = spark.createDataFrame([(1, long, "z", 1, 1), (None, None, "z", 1, 1), (2, "a b", None, 1, 1), (2, "a b", None, 1, 1)], schema).coalesce(1)
    rows, e, got = packing.packed(docs, seq_len=64, block_tokens=200).collect(), packing.Encoder(open(packing.TOKENIZER, "rb").read()), {}
    for r in rows:
        for k, row in enumerate(r.rows):
            got.setdefault((row, r.doc_ids[k]), {})[r.offsets[k]] = np.frombuffer(r.ids, "<u2")[r.cu_seqlens[k] : r.cu_seqlens[k + 1]].tolist()
    whole = {k: sum((x for _, x in sorted(v.items())), []) for k, v in got.items()}
    assert whole == {(0, 1): e.ids(long).tolist(), (1, None): [packing.END], (2, 2): e.ids("a b").tolist(), (3, 2): e.ids("a b").tolist()}


def test_toxicity_learns_words(spark):
    rows = [(i, f"plain words number{i % 13} here " + ("awful scum" if i % 4 == 0 else "fine day"), int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, None), (1001, "")], "doc_id long, text string")
    known = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.model_of(docs, known)).collect()}
    assert all((got[i] >= 0.7) == bool(y) for i, _, y in rows) and 0 <= got[1000] == got[1001] < 0.7
    assert toxicity.score(docs, toxicity.model_of(docs, known.where("toxic IS NULL"))).count() == 402


def test_ftrl_is_the_plain_recursion():
    """The fit against a loop over coordinates, as the method is defined; L1 leaves few weights."""
    rng = random.Random(1)
    rows = [(np.unique([rng.randint(0, 40) + (900 if y else 0) * (rng.random() < 0.5) for _ in range(12)]), y) for y in (int(rng.random() < 0.3) for _ in range(500))]
    z, n, bz, bn = Counter(), Counter(), 0.0, 0.0
    ones = sum(y for _, y in rows)
    w_of = lambda i: 0.0 if abs(z[i]) <= toxicity.L1 else -(z[i] - math.copysign(toxicity.L1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)
    for _ in range(toxicity.EPOCHS):
        for x, y in rows:
            w, bias = {int(i): w_of(int(i)) for i in x}, -bz / ((toxicity.BETA + math.sqrt(bn)) / toxicity.ALPHA)
            g = (1 / (1 + math.exp(-(sum(w.values()) + bias))) - y) * ((500 - ones) / ones if y else 1)
            for i in w:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA * w[i]
                n[i] += g * g
            bz += g - (math.sqrt(bn + g * g) - math.sqrt(bn)) / toxicity.ALPHA * bias
            bn += g * g
    at, w, bias = toxicity.fit(rows)
    assert dict(zip(at.tolist(), w.tolist())) == pytest.approx({i: w_of(i) for i in z if w_of(i)}) and 0 < len(at) < len(z)
    assert bias == pytest.approx(-bz / ((toxicity.BETA + math.sqrt(bn)) / toxicity.ALPHA))


def test_toxicity_of_odd_rows_and_shards(spark, monkeypatch):
    """Labelled ids with several texts give one model in any order of rows; several shards are averaged."""
    rows = [(i, f"plain words number{i % 13} here " + ("awful scum" if i % 4 == 0 else "fine day"), int(i % 4 == 0)) for i in range(600)]
    texts = [(i, t) for i, t, _ in rows] + [(4, "another text"), (5, None), (8, "awful"), (None, "x")]
    known = spark.createDataFrame([(i, y) for i, _, y in rows] + [(4, 0), (None, 1)], "doc_id long, toxic int")
    make = lambda t: toxicity.model_of(spark.createDataFrame(t, "doc_id long, text string").repartition(5), known)
    a, b = make(texts), make(texts[::-1])
    assert all(np.array_equal(x, y) for x, y in zip(a, b)) and len(a[0])
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 150)
    monkeypatch.setattr(toxicity, "L1", 5.0)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t, _ in rows], "doc_id long, text string, label string, score int")
    got = {r.doc_id: r.score for r in toxicity.score(docs, make(texts)).collect()}
    assert sum((got[i] >= 0.5) == bool(y) for i, _, y in rows) > 590
    assert toxicity.score(docs.limit(0), a).count() == 0


def test_parameters_of_a_question_may_change(spark):
    item = "a train leaves the old station at 40 km every hour while Maria waits for 15 minutes near the Bridge and then walks home"
    other = item.replace("40", "75").replace("15", "22").replace("Maria", "Pedro")
    mixed_up = "a train with 40 wheels near the old home walks while every station waits for the hour and then leaves"
    bench = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")
    docs = spark.createDataFrame([(0, f"before it. {item} and after"), (1, f"So, {other}"), (2, mixed_up), (3, None), (4, "")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()} == {(0, 1), (1, 1)}
    assert sorted(r.doc_id for r in decontaminate.without_contaminated(docs, bench).collect()) == [2, 3, 4]


def test_equal_windows_count_whatever_else_their_alignment_changes(spark):
    """15 verbatim words, then a repeated number changed once: equal windows suffice without a one-to-one map."""
    head = "take 5 red apples and put them into the large basket near an open kitchen door"
    item = f"{head} before you count 5 more of those green pears that grow behind our tall garden wall every single autumn"
    text = f"{head} before you count 7 more of those green pears that grow behind our small yard"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(0, text), (1, " ".join(head.split()[:9]))], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()] == [(0, 1)]


def test_items_with_few_plain_words_are_found_verbatim(spark):
    """Numbers or names only: found when copied, not with other values; a changed sum in a question is still found."""
    numbers, names = "12 7 3 16 90 41 55 8 23 64 35", "he met Ada Bela Cleo Dora Edda Fina Gala Hela Ines"
    question = "please work out the total of these numbers and show each step 3 4 5 6 7 8 9 10 11 12 13 14 15 16"
    other = "please work out the total of these numbers and show each step 23 24 25 26 27 28 29 30 31 32 33 34 35 36"
    bench = spark.createDataFrame([(1, numbers), (2, names), (3, question), (4, "17 23")], "item_id long, text string")
    texts = [f"so {numbers} there", f"then {names} left", other, numbers.replace("16", "17").replace("41", "42"), names.replace("Ada", "Udo").replace("Ines", "Otto").replace("Edda", "Kurt"), "we saw 17 23 there", "we saw 17 24 there"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(0, 1), (1, 2), (2, 3), (5, 4)}


def _contaminated_by_all_alignments(docs, items, coverage=decontaminate.COVERAGE, verbatim=decontaminate.VERBATIM):
    """Every alignment of every text with every item, token by token; no hashes of windows, filters or joins."""
    kinds, out = decontaminate.Kinds(), {}

    def tokens(text):
        words = (text or "").encode().split()
        h, kind, at, _ = decontaminate.template(words, kinds)
        bare = [words[i].strip(decontaminate.PUNCTUATION).lower() for i in at]
        return [(None, w) if k == decontaminate.LITERAL else (int(k), w) for k, w in zip(kind.tolist(), bare)]

    for i, text in docs:
        d = tokens(text)
        for j, item in items:
            t = tokens(item)
            size = min(decontaminate.WINDOW, len(t))
            if not size:
                continue
            windows = range(len(t) - size + 1)
            rich = {p for p in windows if sum(k is None for k, _ in t[p : p + size]) >= min(decontaminate.MIN_LITERALS, size)}
            matched, poor, exact = set(), set(), 0
            for shift in range(-len(t), len(d)):
                here, pairs, n = set(), set(), 0
                for p in windows:
                    a, b = t[p : p + size], d[p + shift : p + shift + size] if p + shift >= 0 else []
                    like = len(a) == len(b) and all(x[0] == y[0] and (x[0] is not None or x[1] == y[1]) for x, y in zip(a, b))
                    if like and (p in rich or a == b):
                        n += a == b
                        (here if p in rich else poor).add(p)
                        if p in rich:
                            pairs |= {((x[0], x[1]), (y[0], y[1])) for x, y in zip(a, b) if x[0] is not None}
                exact = max(exact, n)
                if len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs}):
                    matched |= here
            share = max((len(matched) + len(poor)) / len(windows), len(matched) / len(rich) if rich else 0)
            if share >= coverage or exact >= verbatim:
                out[i, j] = (len(windows), len(matched) + len(poor), exact)
    return out


@pytest.mark.parametrize("held", [0, 1 << 26])
def test_contaminated_against_all_alignments(spark, monkeypatch, held):
    """Items that share most of their templates, texts that hold parts of them with values changed; both joins."""
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", held)
    rng = random.Random(6)
    word = lambda: rng.choice(("red", "green", "box", "holds", "walk", "stone", "open", "old", "river", "takes"))
    value = lambda: rng.choice((str(rng.randint(1, 9)), rng.choice(("Ada", "Bo", "Cleo")), "5 km", word()))
    head = "what is the {} of the {} when every one of the {} has been moved by {} to the other side"
    items = [head.format(*(value() for _ in range(4))) + " " + " ".join(word() if rng.random() < 0.7 else value() for _ in range(rng.randint(0, 14))) for _ in range(14)]
    items += ["one two", "7 8 9", "", None, "Ada Bo Cleo 1 2 3 4 5 6 7 8", "what is the 4 of the box"]
    texts = []
    for _ in range(90):
        t = (rng.choice(items) or "x").split()
        cut = t[rng.randint(0, len(t) // 2) :][: rng.randint(3, 40)]
        changed = [rng.choice((w, w, w, value())) if w[:1].isdigit() or w[:1].isupper() else w for w in cut]
        texts.append(" ".join([word() for _ in range(rng.randint(0, 5))] + changed + [value() for _ in range(rng.randint(0, 5))]))
    texts += ["", None, " ".join(x for x in items if x) * 2]
    docs, bench = list(enumerate(texts)), list(enumerate(items))
    expected = _contaminated_by_all_alignments(docs, bench)
    out = decontaminate.contaminated(spark.createDataFrame(docs + docs[:5], "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): (r.windows, r.matched, r.exact) for r in out} == expected and len(out) == len(expected) > 40
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), none).count() == 0


@pytest.mark.parametrize("held", [0, 1 << 26])
def test_urls_against_each_rule(spark, monkeypatch, held):
    """Random hosts, paths and rules, some rules twice or with both verdicts; hosts of many labels take no long time."""
    monkeypatch.setattr(urls, "BROADCAST_BYTES", held)
    rng = random.Random(3)
    host = lambda n: ".".join(rng.choice(("a", "bb", "com", "org")) for _ in range(n))
    path = lambda: "/" + "/".join(rng.choice(("x", "yy", "en")) for _ in range(rng.randint(0, 3)))
    rules = [(rng.choice(("block", "allow")), host(rng.randint(1, 3)), path()) for _ in range(60)]
    pages = [f"http://{host(rng.randint(1, 5))}{path()}{rng.choice(('', '?q=/x', '#/yy'))}" for _ in range(300)] + ["http://", "://a", "http://a/", "x" * 50, "http://" + "a." * 30_000 + "com/en"]
    got = urls.judge(spark.createDataFrame(list(enumerate(pages)), "page_id long, url string"), urls.rules_table(spark, rules)).collect()
    assert len(got) == len(pages)
    for r in got:
        best = None
        for v, h, p in rules:
            if r.host and (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p):
                best = max(best or (0,), (len(h + p), len(h), v == "block", h + p, v))
        assert (r.rule, r.verdict) == (best[3:] if best else (None, "allow")), r
    assert {r.verdict for r in urls.judge(spark.createDataFrame([(1, "http://a/")], "page_id long, url string"), urls.rules_table(spark, rules).limit(0)).collect()} == {"allow"}


def test_url_rules(spark):
    cases = {"http://a.example.com/en/71?x": ("example.com/en/7", "allow"), "https://B.COM/en/1": ("com/en/", "block"), "ftp://xcom/en/": (None, "allow"), "no url": (None, "allow"), None: (None, "allow"), "http://org/es/": ("org/es/", "block"), "http://example.net/de/81": ("example.net/de/8", "block")}
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(cases)] * 2, "page_id long, url string")
    got = urls.judge(pages, urls.rules_table(spark, urls.RULES)).collect()
    assert len(got) == 2 * len(cases) and all((r.rule, r.verdict) == cases[r.url] for r in got)


def test_queries_have_the_asked_columns(spark):
    assert {f"op{i}" for i in range(1, 11)} <= {n.split("_")[0] for n in registry.QUERIES}


def test_mix_comes_near_its_target_without_ids_and_with_repeated_ones(spark):
    rng = random.Random(3)
    text = lambda: " ".join(["w"] * rng.randint(3, 9))
    rows = [(None, text(), "a") for _ in range(400)] + [(7, text(), "b") for _ in range(400)] + [(None, "same text here", "c")] * 400 + [(i, text(), "d") for i in range(100, 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.with_copies(docs).collect()
    assert len(out) == len(rows)
    taken, target = Counter(), {}
    for r in out:
        taken[r.source] += r.size * r.copies
        target[r.source] = r.target
    assert all(abs(taken[s] - t) <= 0.12 * t for s, t in target.items()), (taken, target)
    again = mixing.with_copies(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_lattice_of_classes_without_words(spark):
    from pyspark.sql import functions as F

    rows = [(1, None, "en"), (2, "", "en"), (3, "some words here", "de"), (4, "  ", "fr"), (5, "words again", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for training in (F.lit(True), F.col("doc_id") != 5):
        words, model = lattice_lm.learned(docs, training, "lang")
        out = {r.doc_id: r for r in lattice_lm.score(docs, words, model).collect()}
        assert len(out) == 5 and all(math.isfinite(r.score) and r.score < 0 for r in out.values()) and out[5].score < out[2].score
    nothing = docs.withColumn("text", F.lit(None).cast("string"))
    words, model = lattice_lm.learned(nothing, F.lit(True), "lang")
    assert all(math.isfinite(r.score) for r in lattice_lm.score(nothing, words, model).collect())


CONTRACTS = {
    "op1": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op2": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op3": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op4": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op5": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op7": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op9": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op10": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
}


@pytest.mark.parametrize("op", CONTRACTS)
def test_query_has_the_columns_of_its_contract(spark, op):
    (name,) = [n for n in registry.QUERIES if n.split("_")[0] == op]
    got = dict(registry.QUERIES[name](spark, "/root/testdata/sf0.001").dtypes)
    assert {c: got.get(c) for c in CONTRACTS[op]} == CONTRACTS[op]
