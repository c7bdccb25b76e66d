"""Substring dedup with a log-structured fingerprint index.

Documents come in batches. The index is a folder of sorted immutable runs of fingerprints of the windows of earlier
batches, one row per distinct minimizer region (see ``windows``) with the smallest document that has it, and of
manifests that list the runs that count. A new batch is fingerprinted, its distinct regions are merge-joined with the
runs, and what shares a key is verified: equal regions by the digest of their whole content, differing ones window
by window on the content of the windows (64 bits each, within one 64-bit key). The batch's own new regions then become
a run; when `fan_in` runs have gathered they are compacted into one. A manifest appears by one rename, so a reader
or a crash finds the old index or the new one, and an index can be opened by a later session.

``dedup`` runs a whole table through an index in batches of ascending doc_id, so that the index holds
exactly the smaller ids. ``FingerprintIndex`` takes any further batches.

Edge cases: null and empty texts have no words; texts with fewer words than a window lose nothing; very long texts are
read whole, in one task; windows are judged on the input; rows that repeat a doc_id count as one document: none of them
removes from the other, and each loses what smaller ids hold; rows with a null doc_id are kept whole, since no id is
smaller; ids must be integers (others are refused); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlake.llm._common import Scratch, hadoop_fs, integral, small, table
from quadlake.llm.windows import TEXT, Words, cut, named, region_table, with_texts

WINDOW, GRAM = 50, 8
#: Batches of a whole table; as many runs are compacted. The last batch meets a compacted run.
BATCHES, FAN_IN = 3, 2
RUN = "key long, digest long, doc_id long, body long, start int, count int"


class FingerprintIndex:
    """Runs of RUN rows in a folder, each sorted by key: the first place of every distinct region."""

    def __init__(self, spark: SparkSession, path: str, window: int = WINDOW, gram: int = GRAM, fan_in: int = FAN_IN):
        self.spark, self.path, self.window, self.gram, self.fan_in = spark, path.rstrip("/"), window, gram, fan_in
        self.scratch = Scratch(spark, "substring-batch")
        self.version, self.runs = 0, []
        self._open()

    # ---- the folder
    def _open(self) -> None:
        """The newest manifest; an index made with another window or gram is refused."""
        fs, at = hadoop_fs(self.spark, f"{self.path}/manifests")
        if not fs.exists(at):
            return
        names = sorted(s.getPath().getName() for s in fs.listStatus(at) if s.getPath().getName().isdigit())
        if names:
            held = json.loads(self.spark.read.text(f"{self.path}/manifests/{names[-1]}", wholetext=True).first()[0])
            if (held["window"], held["gram"]) != (self.window, self.gram):
                raise ValueError(f"the index at {self.path} has windows of {held['window']} words and grams of {held['gram']}")
            self.version, self.runs = int(names[-1]), held["runs"]

    def _publish(self, runs: list[str]) -> None:
        """A new manifest, by one rename; runs that it no longer lists go afterwards."""
        retired, self.version, self.runs = set(self.runs) - set(runs), self.version + 1, runs
        fs, fresh = hadoop_fs(self.spark, f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = fs.create(fresh, True)
        out.write(bytearray(json.dumps({"window": self.window, "gram": self.gram, "runs": runs}).encode()))
        out.close()
        _, at = hadoop_fs(self.spark, f"{self.path}/manifests/{self.version:010d}")
        if not fs.rename(fresh, at):
            raise RuntimeError(f"another writer has published version {self.version} of {self.path}")
        for name in retired:
            fs.delete(hadoop_fs(self.spark, f"{self.path}/{name}")[1], True)

    def _write_run(self, rows: DataFrame) -> str:
        name = f"run-{uuid.uuid4().hex}"
        rows.sortWithinPartitions("key", "digest").write.parquet(f"{self.path}/{name}")
        return name

    def history(self) -> DataFrame | None:
        if not self.runs:
            return None
        return self.spark.read.schema(RUN).parquet(*[f"{self.path}/{name}" for name in self.runs])

    # ---- batches
    def add(self, occurrences: DataFrame, corpus: DataFrame) -> DataFrame:
        """(doc_id, body, start, length): what the batch repeats of smaller doc_ids, in words; then the batch joins the index.

        `occurrences` are the batch's regions, `corpus` the ``named`` texts of the batch and of all earlier ones.
        """
        w = self.scratch.write
        place = F.min(F.struct("doc_id", "body", "start", "count")).alias("first")
        new = w(occurrences.groupBy("key", "digest").agg(place, F.max("doc_id").alias("last")))
        history = self.history()
        if history is None:
            known = new.withColumn("fresh", F.lit(True))
        else:
            met = history.join(new.select("key").distinct(), "key", "left_semi").select("key", "digest", F.struct("doc_id", "body", "start", "count").alias("first"), F.lit(None).cast("long").alias("last"))
            both = new.withColumn("mine", F.lit(1)).unionByName(met.withColumn("mine", F.lit(0)))
            known = w(both.groupBy("key", "digest").agg(F.min("first").alias("first"), F.max("last").alias("last"), (F.min("mine") == 1).alias("fresh")))
        contested = w(known.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"))
        held = w(known.join(contested, "key", "left_semi").select("key", "digest", "first.doc_id", "first.body", "first.start", "first.count"))
        flags = self._flagged(w(window_table(with_texts(corpus, held), self.window)))
        verdict = known.where(F.col("last").isNotNull()).join(flags, ["key", "digest"], "left")
        verdict = w(verdict.where(F.col("runs").isNotNull() | (F.col("last") > F.col("first.doc_id"))).select("key", "digest", F.col("first.doc_id").alias("first_doc"), "runs"))
        cuts = occurrences.join(verdict, ["key", "digest"])
        all_of = F.array(F.struct(F.lit(0).alias("at"), F.col("count").alias("n")))
        runs = cuts.select(*TEXT, "start", F.explode(F.when(F.col("doc_id") > F.col("first_doc"), all_of).otherwise(F.col("runs"))).alias("r"))
        out = w(runs.select(*TEXT, (F.col("start") + F.col("r.at")).alias("start"), (F.col("r.n") + self.window - 1).alias("length")))
        run = self._write_run(known.where("fresh").select("key", "digest", "first.doc_id", "first.body", "first.start", "first.count"))
        self._publish([*self.runs, run])
        for used in {id(x): x for x in (new, contested, held, verdict)}.values():
            self.scratch.drop(used)
        if len(self.runs) >= self.fan_in:
            self.compact()
        return out

    def _flagged(self, windows: DataFrame) -> DataFrame:
        """(key, digest, runs): runs of offsets whose window a smaller document holds too."""
        least = windows.groupBy("key", "content").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
        found = windows.join(least, ["key", "content"]).where("least < doc_id")
        offsets = found.groupBy("key", "digest").agg(F.collect_set("offset").alias("o"))  # at most as many as a region has windows
        first = F.sort_array(F.filter("o", lambda x: ~F.array_contains("o", x - 1)))
        last = F.sort_array(F.filter("o", lambda x: ~F.array_contains("o", x + 1)))
        runs = F.zip_with(first, last, lambda a, b: F.struct(a.alias("at"), (b - a + 1).alias("n")))
        out = self.scratch.write(offsets.select("key", "digest", runs.alias("runs")))
        self.scratch.drop(windows)
        return out

    def compact(self) -> None:
        """Merge all runs into one."""
        place = F.min(F.struct("doc_id", "body", "start", "count")).alias("first")
        merged = self.history().groupBy("key", "digest").agg(place).select("key", "digest", "first.doc_id", "first.body", "first.start", "first.count")
        self._publish([self._write_run(merged)])


def window_table(texts: DataFrame, window: int) -> DataFrame:
    """(key, content, digest, doc_id, offset): one row per window of the representatives; content is the window's hash."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest

        held, rows = [], 0

        def out():
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "content", "digest", "doc_id", "offset"])

        for batch in small(batches):
            bodies = batch.column(1).cast(pa.large_binary()).to_pylist()
            for doc_id, body, places in zip(batch.column(0).to_pylist(), bodies, batch.column(2).to_pylist(), strict=True):
                seq = Words(body)
                for p in places:
                    n, s = p["count"], p["start"]
                    content = np.fromiter((xxh3_64_intdigest(seq.slice(s + i, s + i + window)) for i in range(n)), np.uint64, n).view(np.int64)
                    held.append((np.full(n, p["key"], np.int64), content, np.full(n, p["digest"], np.int64), np.full(n, doc_id, np.int64), np.arange(n, dtype=np.int32)))
                    rows += n
                if rows >= 50_000:
                    yield out()
                    held, rows = [], 0
        if held:
            yield out()

    return texts.select("doc_id", "text", "places").mapInArrow(run, "key long, content long, digest long, doc_id long, offset int")


def batch_bounds(docs: DataFrame, batches: int, key: str = "doc_id") -> list[int]:
    """Upper bounds (exclusive) of all batches but the last."""
    found = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k")).approxQuantile("k", [i / batches for i in range(1, batches)], 0.02)
    return sorted({int(x) for x in found})


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, fan_in: int = FAN_IN, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, text, n_words, n_removed): every document with the words of repeated windows removed; its kept words are joined by one space."""
    integral(docs, key)
    scratch = Scratch(docs.sparkSession, "substring")
    texts = named(docs, text, key)
    bounds = batch_bounds(docs, batches, key) if batches > 1 else []
    number = F.lit(0)
    for b in bounds:
        number = number + F.when(F.col("doc_id") >= b, 1).otherwise(0)
    found = scratch.write(region_table(texts, Words, window, gram).withColumn("batch", number), partition_by="batch")
    index, spans = FingerprintIndex(docs.sparkSession, scratch.path(), window, gram, fan_in), None
    for b in range(len(bounds) + 1):
        part = index.add(found.where(F.col("batch") == b).drop("batch"), texts)
        spans = part if spans is None else spans.unionByName(part)
    scratch.drop(found)
    cuts = spans.groupBy(*TEXT).agg(F.collect_list(F.struct("start", "length")).alias("cuts"))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("body"), F.col(text).cast("string").alias("text"))
    joined = rows.join(cuts, list(TEXT), "left").select("doc_id", "text", "cuts")

    def run(rows):
        import numpy as np
        import pyarrow as pa

        for batch in small(rows):
            texts, words, gone = [], [], []
            for body, cuts in zip(batch.column(1).cast(pa.large_binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                seq = Words(body)
                words.append(seq.size)
                if not cuts:
                    gone.append(0)
                    texts.append(seq.data.decode())
                    continue
                removed = cut(seq, [c["start"] for c in cuts], [c["length"] for c in cuts])
                gone.append(int(removed.sum()))
                texts.append(b" ".join(seq.words[i] for i in np.flatnonzero(~removed).tolist()).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(words, pa.int64()), pa.array(gone, pa.int64())], ["doc_id", "text", "n_words", "n_removed"])

    return joined.mapInArrow(run, "doc_id long, text string, n_words long, n_removed long")


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of all documents."""
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
