"""Tasks take batches of any size in slices, so that what a worker holds at once does not hang on a batch's rows."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from fleetlens.llm import common, decontaminate, minmax_dedup, toxicity

ROWS = 6_000


class Given:
    """Stands for documents; gives what runs in a task."""

    columns, schema = ["doc_id", "text"], None
    sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda value: SimpleNamespace(value=value)))

    def select(self, *columns):
        return self

    withColumn = select

    def mapInArrow(self, task, schema):
        return task


@pytest.fixture(scope="module")
def batch():
    texts = [" ".join(f"w{i * 7 + k}" for k in range(i % 400)) if i % 50 else None for i in range(ROWS)]
    return pa.RecordBatch.from_pydict({"doc_id": pa.array(range(ROWS), pa.int64()), "text": pa.array(texts, pa.string())})


def test_slices_hold_all_rows_in_their_order(batch):
    for size in (1, 1000, 1 << 20, 1 << 40):
        assert pa.Table.from_batches(common.slices([batch, batch.slice(0, 0), batch.slice(5, 9)], size)).equals(pa.Table.from_batches([batch, batch.slice(5, 9)]))
    assert [b.num_rows for b in common.slices([batch.slice(0, 0)])] == [0]
    wide = pa.RecordBatch.from_pydict({"text": ["a" * (1 << 22), "b"]})
    assert [b.num_rows for b in common.slices([wide])] == [1, 1]
    assert max(b.nbytes for b in common.slices([batch], 1 << 20)) < 3 << 20 < batch.nbytes


@pytest.mark.parametrize("step", ["signed", "sets", "score", "windows"])
def test_one_large_batch_comes_out_in_small_ones(spark, batch, step):
    rng = np.random.default_rng(5)
    task = {
        "signed": lambda: minmax_dedup.signed(Given()),
        "sets": lambda: minmax_dedup.sets_of(Given()),
        "score": lambda: toxicity.score(Given(), (np.arange(1 << 20), rng.normal(size=1 << 20), 0.5)),
        "windows": lambda: decontaminate.template_windows(Given(), [8], np.full(1 << (decontaminate.FILTER_BITS - 3), 0, np.uint8)),
    }[step]()
    if step == "windows":
        from pyspark import TaskContext

        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
            out, whole = list(task(iter([batch]))), list(task(batch.slice(i, 1) for i in range(ROWS)))
    else:
        out, whole = list(task(iter([batch]))), list(task(batch.slice(i, 1) for i in range(ROWS)))
    assert len(out) > 2
    assert max(b.nbytes for b in out) < 5 << 20
    assert pa.Table.from_batches(out).equals(pa.Table.from_batches(whole))


def test_fit_is_the_same_of_indices_of_four_bytes():
    rng = np.random.default_rng(7)
    rows = [(np.unique(rng.integers(0, 500, 60)), int(y)) for y in rng.random(300) < 0.4]
    narrow = [(x.astype(np.int32), y) for x, y in rows]
    for a, b in zip(toxicity.fit(rows), toxicity.fit(narrow), strict=True):
        assert np.array_equal(a, b)


def test_caches_of_words_stay_small():
    hashes = common.WordHashes()
    hashes.of(" ".join(map(str, range(150_000))))
    assert len(hashes) <= 100_000
    assert hashes.of("149999 7 7")[1] == hashes.of("7")[0]
