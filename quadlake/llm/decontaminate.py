"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

For every benchmark item of n words all windows of n words of a document are compared by the weighted
Jaccard similarity of their word shingles. A window and an item of equal length have equally many
shingles, so a similarity of t needs at least t times that many shared ones (with multiplicity):
windows with fewer shingle hits are left out without loss. The others get a SimHash fingerprint from
running sums of shingle bits; the fingerprints of items of that size are indexed by blocks of bits, and
each block of a window's fingerprint fetches all items within a small Hamming ball of it, which by
pigeonhole covers every fingerprint within the radius. The complete distance and then the exact
similarity on the words themselves decide. The radius lies far above the distance expected at the
threshold (about 10 bits at 0.8).

The benchmark is cut into chunks of bounded size; each chunk is one broadcast and one pass, so its size
does not matter. Documents are never shuffled.

Edge cases: null and empty texts match nothing; items without words are never found; items with fewer
words than a shingle are one shingle, their whole sequence; texts are used whole, very long ones in one task; repeated
rows are judged one by one; repeated items count once, items that repeat an id with other texts each match; ids must be
integers (others are refused); an empty benchmark finds nothing; extra columns are ignored by
``matches`` and pass through ``clean``.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadlake.llm._common import arrow_rows, integral, small, table

SHINGLE, THRESHOLD, RADIUS = 5, 0.8, 22
BLOCKS, BLOCK_BITS = 8, 8
CHUNK_BYTES = 16 << 20


def similarity(a: list, b: list, shingle: int) -> float:
    """Weighted Jaccard of the shingle multisets of two word sequences."""
    x, y = (Counter(tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))) for w in (a, b))
    shared = sum((x & y).values())
    return shared / (x.total() + y.total() - shared)


def _mixed(grams):
    """Spread sums of word hashes over 64 bits."""
    import numpy as np

    g = grams.copy()
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53), (32, 1)):
        g ^= g >> np.uint64(shift)
        g *= np.uint64(factor)
    return g


def gram_hashes(words: list[bytes], shingle: int):
    """One 64-bit hash per shingle; process-local (built on the interpreter's string hash)."""
    import numpy as np

    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    n = max(1, len(words) - shingle + 1)
    out = np.zeros(n, np.uint64)
    factor = 1
    for j in range(min(shingle, len(words))):
        out += h[j : j + n] * np.uint64(factor)
        factor = factor * 0x9E3779B97F4A7C15 % (1 << 64)
    return _mixed(out)


def _votes(grams):
    """+1/-1 per bit of each hash."""
    import numpy as np

    return np.unpackbits(grams.astype(">u8").view(np.uint8)).reshape(-1, 64).astype(np.int8) * 2 - 1


def _pack(sums):
    import numpy as np

    return np.packbits(sums > 0, axis=1).view(">u8")[:, 0].astype(np.uint64)


class Index:
    """Items by size, with shingle hits and multi-index Hamming blocks. Built in the task that uses it."""

    def __init__(self, items: list[tuple[int, str | None]], shingle: int = SHINGLE, threshold: float = THRESHOLD, radius: int = RADIUS):
        import numpy as np

        self.shingle, self.threshold, self.radius = shingle, threshold, radius
        self.items = [(i, w) for i, t in items if (w := (t or "").encode().lower().split())]
        grams = [gram_hashes(w, shingle) for _, w in self.items]
        fps = [int(_pack(_votes(g).sum(0, dtype=np.int64)[None, :])[0]) for g in grams]
        self.by_size: dict[int, dict] = {}
        for k, (_, w) in enumerate(self.items):
            self.by_size.setdefault(len(w), {"items": []})["items"].append(k)
        near = np.array([bin(a ^ b).count("1") for a in range(256) for b in range(256)]).reshape(256, 256) <= radius // BLOCKS
        for size, group in self.by_size.items():
            mine = group["items"]
            group["fps"] = np.array([fps[k] for k in mine], np.uint64)
            group["grams"] = np.unique(np.concatenate([grams[k] for k in mine]))
            group["need"] = int(np.ceil(threshold * max(1, size - shingle + 1) - 1e-9))
            # table[block][value] -> which items have a block value within the ball
            parts = np.stack([(group["fps"] >> np.uint64(BLOCK_BITS * b)) & np.uint64(255) for b in range(BLOCKS)]).astype(np.int64)
            group["table"] = near[:, parts].transpose(1, 0, 2)
        self.long_sizes = [s for s in self.by_size if s >= shingle]
        self.short_sizes = [s for s in self.by_size if s < shingle]
        every = [self.by_size[s]["grams"] for s in self.long_sizes]
        self.all = np.unique(np.concatenate(every)) if every else np.zeros(0, np.uint64)
        self.bits = 1 << max(16, int(self.all.size * 32).bit_length())
        self.seen = np.zeros(self.bits, bool)
        self.seen[(self.all & np.uint64(self.bits - 1)).astype(np.int64)] = True
        self.least = min((self.by_size[s]["need"] for s in self.long_sizes), default=0)

    def matches(self, text: bytes | None) -> dict[int, tuple[float, int]]:
        """{position of the item: (similarity, first word)} of the best window of each item found."""
        import numpy as np

        words = (text or b"").lower().split()
        found: dict[int, tuple[float, int]] = {}
        if not words:
            return found
        if self.long_sizes and len(words) >= min(self.long_sizes):
            grams = gram_hashes(words, self.shingle)
            maybe = np.flatnonzero(self.seen[(grams & np.uint64(self.bits - 1)).astype(np.int64)])
            if maybe.size >= self.least:
                maybe = maybe[np.isin(grams[maybe], self.all)]
            if maybe.size >= self.least:
                for size in self.long_sizes:
                    if size <= len(words):
                        self._search(words, grams, maybe, size, found)
        for size in self.short_sizes:
            if size <= len(words):
                short = gram_hashes(words, size)
                self._search(words, short, np.flatnonzero(np.isin(short, self.by_size[size]["grams"])), size, found)
        return found

    def _search(self, words, grams, maybe, size, found) -> None:
        import numpy as np

        group, length = self.by_size[size], max(1, size - self.shingle + 1)
        hits = maybe[np.isin(grams[maybe], group["grams"])]
        need = group["need"]
        if hits.size < need:
            return
        # Every window that holds enough hits lies between the need-th hits around it.
        close = np.flatnonzero(hits[need - 1 :] - hits[: hits.size - need + 1] < length)
        if not close.size:
            return
        spans: list[list[int]] = []
        for i in close.tolist():
            low, high = max(0, int(hits[i + need - 1]) - length + 1), min(int(hits[i]), len(words) - size)
            if low > high:
                continue
            if spans and low <= spans[-1][1] + 1:
                spans[-1][1] = max(spans[-1][1], high)
            else:
                spans.append([low, high])
        for low, high in spans:
            sums = np.zeros((high - low + length + 1, 64), np.int32)
            np.cumsum(_votes(grams[low : high + length]), axis=0, out=sums[1:])
            fps = _pack(sums[length:] - sums[:-length])
            cand = np.zeros((fps.size, group["fps"].size), bool)
            for b in range(BLOCKS):
                cand |= group["table"][b][((fps >> np.uint64(BLOCK_BITS * b)) & np.uint64(255)).astype(np.int64)]
            at, which = np.nonzero(cand)
            apart = np.bitwise_count(fps[at] ^ group["fps"][which])
            order = np.argsort(apart, kind="stable")
            for j in order[apart[order] <= self.radius].tolist():
                item, start = group["items"][which[j]], low + int(at[j])
                if found.get(item, (0.0,))[0] >= 1.0:
                    continue
                value = similarity(words[start : start + size], self.items[item][1], self.shingle)
                if value >= self.threshold and (value, -start) > (found.get(item, (0.0, 0))[0], -found.get(item, (0.0, 0))[1]):
                    found[item] = (value, start)


def chunks(benchmark: DataFrame, chunk_bytes: int = CHUNK_BYTES, item: str = "item_id", text: str = "text"):
    """Lists of (item, text) of bounded size that together hold the whole benchmark."""
    integral(benchmark, item)
    rows = benchmark.select(F.col(item).cast("long").alias("item_id"), F.col(text).cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    total = rows.agg(F.sum(F.octet_length("text") + 64).alias("b")).first()["b"] or 0
    parts = max(1, -(-2 * total // chunk_bytes)) if total > chunk_bytes else 1
    for k in range(parts):
        part = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        yield sorted((r["item_id"], r["text"]) for r in part.collect())


def matches(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, radius: int = RADIUS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words): the best window of each item found in each document."""
    spark = docs.sparkSession
    integral(docs, key)
    schema = "doc_id long, item_id long, similarity double, start_word long, n_words long"
    out = None
    for items in chunks(benchmark):
        shared = spark.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            import pyarrow as pa

            index, rows = Index(shared.value, shingle, threshold, radius), []
            for doc_id, body in arrow_rows(batches, "doc_id", "text"):
                for k, (value, start) in sorted(index.matches(body).items()):
                    rows.append((doc_id, index.items[k][0], value, start, len(index.items[k][1])))
                if len(rows) >= 10_000:
                    yield _batch(pa, rows)
                    rows = []
            yield _batch(pa, rows)

        found = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def _batch(pa, rows):
    kinds = (("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("start_word", pa.int64()), ("n_words", pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], [n for n, _ in kinds])


def clean(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, radius: int = RADIUS, text: str = "text") -> DataFrame:
    """`docs` without the documents that hold an item; all columns as they are."""
    spark, out = docs.sparkSession, docs
    at = docs.columns.index(text)
    for items in chunks(benchmark):
        shared = spark.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            import pyarrow as pa

            index = Index(shared.value, shingle, threshold, radius)
            for batch in small(batches):
                bodies = batch.column(at).cast(pa.large_binary()).to_pylist()
                yield batch.filter(pa.array([not index.matches(b) for b in bodies], pa.bool_()))

        out = out.mapInArrow(run, T.StructType(docs.schema.fields))
    return out


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    """doc_id, item_ids, similarity (the highest) of every document that holds a benchmark item."""
    found = matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("similarity").alias("similarity"))
