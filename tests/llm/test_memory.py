"""What Python workers hold at a time."""

import random
import tracemalloc

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from quadlake.llm import induced, suffix_dedup, toxicity
from quadlake.llm._common import BATCH, BATCH_BYTES


def test_sorting_a_shard_holds_a_few_times_its_bytes():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    text = " ".join(rng.choice(words) for _ in range(200_000)).encode()
    starts = [rng.randrange(300_000) for _ in range(1700)]
    pieces = [(text[a : a + 600], 201) for a in starts]
    tracemalloc.start()
    hits = suffix_dedup.repeated_starts(pieces, 400)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    times = np.bincount(np.add.outer(starts, np.arange(201)).ravel())
    assert [list(h) for h in hits] == [np.flatnonzero(times[a : a + 201] > 1).tolist() for a in starts]
    assert peak < 30 * sum(len(p) for p, _ in pieces)


def test_blocks_of_any_size(monkeypatch):
    """Types, seeds and common prefixes are found block by block."""
    rng = random.Random(12)
    for block in (1, 2, 3, 7, 64):
        monkeypatch.setattr(induced, "BLOCK", block)
        for _ in range(20):
            data = bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 60))) * rng.randrange(1, 4)
            found = [(p, c) for pos, lcp in induced.sorted_suffixes(data, 8, memory=64) for p, c in zip(pos.tolist(), lcp.tolist(), strict=True)]
            assert sorted(p for p, _ in found) == list(range(len(data)))
            for (a, _), (b, c) in zip(found, found[1:], strict=False):
                x, y = data[a:][:8], data[b:][:8]
                assert x >= y
                assert c == next((i for i in range(min(len(x), len(y))) if x[i] != y[i]), min(len(x), len(y)))


def test_shards_are_whole_keys_below_the_limit():
    rng = random.Random(13)
    rows = [(k, d, 1, b"x" * rng.randrange(1, 40)) for k in range(200) for d in range(rng.randrange(1, 4))]
    rows += [(200, d, 1, b"y" * 60) for d in range(3)] + [(201, 0, 1, b"z")]
    shards = list(suffix_dedup.batched(iter(rows), 150))
    assert [r for s in shards for r in s] == rows
    keys = [{r[0] for r in s} for s in shards]
    assert sum(map(len, keys)) == len(set().union(*keys))
    assert all(sum(len(r[3]) for r in s) <= 150 or len(k) == 1 for s, k in zip(shards, keys, strict=True))
    assert list(suffix_dedup.batched(iter([]), 1)) == []


@pytest.mark.parametrize("stage", ["toxicity", "near_duplicates", "decontamination"])
def test_stages_pass_texts_in_bounded_batches(spark, stage, tmp_path, monkeypatch):
    """A batch has a few MB however long its texts are; a limit of the session's own stays."""
    monkeypatch.setattr(corpus_pipeline, "SIMILARITY", 1.0)
    docs = spark.createDataFrame([(i, f"text {i}", "en", "s", 7) for i in range(4)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(0, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, "an item of some words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], ["size"])

    try:
        spark.conf.unset(BATCH)
        dict(corpus_pipeline.STAGES)[stage](spark, docs, str(tmp_path))
        texts = spark.range(0, 12_000, 1, 1).selectExpr("repeat('x', 2000) as text")
        assert max(r["size"] for r in texts.mapInArrow(run, "size long").collect()) < 1.1 * BATCH_BYTES
        spark.conf.set(BATCH, "1m")
        dict(corpus_pipeline.STAGES)[stage](spark, docs, str(tmp_path))
        assert spark.conf.get(BATCH) == "1m"
    finally:
        spark.conf.unset(BATCH)


class Taken:
    """Stands for a table: keeps the function that would run on its batches."""

    def __getattr__(self, name):
        return lambda *_: self

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def test_words_are_counted_a_few_rows_at_a_time():
    rows = 6000
    words = pa.array([[f"word{(i + j) % 997}" for j in range(100)] for i in range(rows)], pa.list_(pa.string()))
    batch = pa.RecordBatch.from_arrays([pa.array([i % 2 for i in range(rows)], pa.int32()), words], ["toxic", "words"])
    table = Taken()
    monkey = pytest.MonkeyPatch()
    monkey.setattr(toxicity, "F", Taken())
    try:
        toxicity._word_counts(table)
    finally:
        monkey.undo()
    tracemalloc.start()
    (out,) = table.run(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.num_rows == 997 and sum(out.column(2).to_pylist()) == 100 * rows
    assert peak < 8 << 20
