"""The prefix trie of conversations against plain sets of prefixes."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from fleetlens.llm import prefix_trie, registry

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [v[2:] for v in sorted(found)] for c, found in own.items()}
    nodes, last, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        turns = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:])
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append(c)
        last[turns].append(c)
    for p in nodes:
        if p:
            children[p[:-1]].add(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) if children[p] else 1
        saved[p] = sum(saved[k] for k in children[p]) + ((len(nodes[p]) - 1) * len(p[-1][1]) if p else 0)
    sha = lambda p: hashlib.sha256(",".join(map(str, last.get(p, []))).encode()).hexdigest()
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], sha(p)) for p, m in nodes.items())


def by_operator(spark, rows, schema=SCHEMA):
    return sorted(map(tuple, prefix_trie.prefix_nodes(spark.createDataFrame(rows, schema)).collect()), key=lambda r: r[:2])


def odd_rows():
    rng = random.Random(4)
    text = lambda: rng.choice(["a", "bb", "é", "", None, "long text"])
    role = lambda: rng.choice(["user", "assistant", None])
    rows = [(c, t, role(), text()) for c in [*range(0, 40), *range(100, 130), 250, -5, -100, -130] for t in range(rng.randint(1, 9))]
    rows += [(c, t, "user", "same") for c in range(300, 360) for t in range(4)]  # many copies
    rows += [(c, t, "user", f"deep {t // (c - 399)}") for c in range(400, 404) for t in range(70)]  # long ones that part late
    rows += [(500, t, "user", text()) for t in (None, 3, 3, 3, None, 2)] + [(500, 3, "user", "x")] * 3  # ties, null turns, repeated rows
    rows += [(None, 1, "user", "no conversation"), (None, None, None, None)]
    rng.shuffle(rows)
    return rows


def test_odd_rows(spark):
    rows = odd_rows()
    assert by_operator(spark, rows) == plain(rows)


def test_small_segments_shards_and_spans(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SEGMENT", 3)
    monkeypatch.setattr(prefix_trie, "SHARD", 8)
    monkeypatch.setattr(prefix_trie, "SPAN", 4)
    rows = odd_rows()
    assert by_operator(spark, rows) == plain(rows)


def test_empty_table_turnless_members_and_other_columns(spark):
    assert by_operator(spark, []) == []
    # It takes turns of conversation 0, which is absent, and has no more than that of its own.
    c = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6)
    rows = [(c, 0, "user", "x", "depth", 1, 2)]
    got = by_operator(spark, rows, SCHEMA + ", depth string, part long, n long")
    assert got == plain([r[:4] for r in rows]) and got[0][:4] == (c, 0, None, 1)


def test_double_array_holds_its_sequences_and_no_others():
    rng = random.Random(2)
    sequences = sorted({tuple(rng.randint(1, 40) for _ in range(rng.randint(1, 6))) for _ in range(400)})
    trie = prefix_trie.DoubleArray([list(s) for s in sequences])
    prefixes = {s[:k] for s in sequences for k in range(1, len(s) + 1)}
    slots = {p: trie.walk(list(p)) for p in prefixes}
    assert all(len(v) == len(p) for p, v in slots.items()) and len({v[-1] for v in slots.values()}) == len(prefixes)
    for _ in range(2000):
        s = tuple(rng.randint(1, 41) for _ in range(rng.randint(1, 6)))
        assert (len(trie.walk(list(s))) == len(s)) == (s in prefixes)


def test_ids_of_a_group_are_hashed_over_many_runs(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(prefix_trie, "IDS", 3)
    ids = list(range(-4, 9))
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array(np.array(x, np.int64)) for x in ([1] * len(part), [2] * len(part), part)], ["e1", "e2", "conv_id"])
    runs = list(prefix_trie.joined_ids(iter([batch(ids[:5]), batch(ids[5:])])))
    assert sum(r.num_rows for r in runs) == 5
    (got,) = prefix_trie.hashed_ids(iter(runs))
    assert got.column(2).to_pylist() == [hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()]


@pytest.mark.parametrize("sf", ["0.001"])
def test_query_on_whole_conversations(spark, sf):
    got = registry.QUERIES["op12_prefix_trie"](spark, f"/root/testdata/sf{sf}")
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert {t for c, t in got.dtypes if c != "ends_sha256"} == {"bigint"}
    rows = spark.read.parquet(f"/root/testdata/sf{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == plain(map(tuple, rows))
