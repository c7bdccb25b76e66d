"""Removal of byte strings that occur more than once, by external suffix sorting of shards.

A 400-byte string that starts in two places has the same minimizer region key in both (see ``windows``), so
regions that share a key with nothing else are out, and equal regions collapse to one row with a
count: what they hold is repeated. Distinct regions that share a key are contested. Their bytes go, key by
key, to shards; each shard's text is suffix-sorted by external induced sorting (see ``induced``), whose
disk-backed queues carry suffix tuples and common-prefix values, and windows whose common prefix with a
neighbour reaches the window's length are repeated.

A key whose distinct regions exceed a shard (a passage in very many surroundings) is split by content: windows at nearby
distances from the key's gram share a long core, and only windows with equal cores can be equal. So each region is
cut into pieces of ``LEVELS[0]`` windows, pieces with one core form a cell, equal pieces collapse with a count, and
cells that fit are sorted as above. A cell that still exceeds a shard is cut again, at the next level; at the last
one the core is the window. So no shard grows with the corpus and every group is pre-aggregated.

Edge cases: null and empty texts have no bytes; texts shorter than a window lose nothing; very long texts are read
whole, in one task; strings are judged on the input and never cross documents; a document may repeat itself, overlaps
included; repeated rows count as places of their own, so equal rows lose everything long enough; ids may repeat, be
null or of any type (a row is named by 64-bit hashes of its id and of its text); cuts may fall inside a
UTF-8 sequence, so what is kept is binary; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadlake.llm._common import Scratch, shuffle_partitions, small, table
from quadlake.llm.induced import sorted_suffixes
from quadlake.llm.windows import TEXT, Bytes, cut, region_table, with_texts

WINDOW, GRAM = 400, 32
#: Contested bytes of a shard at most; memory of its queues, beyond which they go to disk.
SHARD_BYTES, MEMORY = 4 << 20, 32 << 20
#: Windows of a piece of a crowded key, level by level; the last level must be one.
LEVELS = (64, 8, 1)
RUNS = "array<struct<at:int,n:int>>"


def repeated_starts(pieces: list[tuple[bytes, int]], window: int, memory: int = MEMORY) -> list:
    """For each (bytes, windows) an array of the offsets below `windows` whose window also starts elsewhere in the pieces."""
    import numpy as np

    data = b"".join(p for p, _ in pieces)
    sizes = np.fromiter((len(p) for p, _ in pieces), np.int64, len(pieces))
    start = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))
    valid = np.zeros(len(data), bool)
    for s, (_, n) in zip(start.tolist(), pieces, strict=False):
        valid[s : s + n] = True
    found: list = []
    open_: list = []  # starts of the group of equal windows at hand
    for pos, lcp in sorted_suffixes(data, window, memory):
        heads = np.flatnonzero(lcp < window)
        edges = [0, *heads.tolist(), pos.size] if not heads.size or heads[0] else [*heads.tolist(), pos.size]
        if heads.size and heads[0] == 0:
            _close(open_, found)
        if len(edges) > 4:  # groups inside the block, all at once
            inner = slice(edges[1], edges[-2])
            group = np.cumsum(lcp[inner] < window)
            ok = valid[pos[inner]]
            many = np.bincount(group[ok], minlength=int(group[-1]) + 1) > 1
            found.append(pos[inner][ok & many[group]])
            spans = [(edges[0], edges[1]), (edges[-2], edges[-1])]
        else:
            spans = list(zip(edges, edges[1:], strict=False))
        for i, (a, b) in enumerate(spans):
            if i:
                _close(open_, found)
            part = pos[a:b]
            open_.append(part[valid[part]])
    _close(open_, found)
    hits = np.concatenate(found) if found else np.zeros(0, np.int32)
    del found
    hits.sort()
    at = np.searchsorted(hits, start)
    return [hits[a:b] - s for a, b, s in zip(at.tolist(), at[1:].tolist(), start.tolist(), strict=False)]


def _close(open_: list, found: list) -> None:
    if sum(p.size for p in open_) > 1:
        found.extend(open_)
    open_.clear()


def _runs(hits) -> list[dict]:
    """Runs of consecutive offsets."""
    import numpy as np

    first = np.flatnonzero(np.diff(hits, prepend=hits[:1] - 2) != 1)
    return [{"at": at, "n": n} for at, n in zip(hits[first].tolist(), np.diff(first, append=hits.size).tolist(), strict=True)]


def _runs_type():
    import pyarrow as pa

    return pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())]))


def batched(rows: Iterator[tuple], limit: int) -> Iterator[list[tuple]]:
    """Rows (k, d, n, body) that come sorted by k, in lists of whole keys: of at most `limit` bytes, unless one key has more."""
    held, size, last, before = [], 0, 0, 0  # last, before: rows and bytes of the keys before the one at hand
    for row in rows:
        if held and row[0] != held[-1][0]:
            last, before = len(held), size
        held.append(row)
        size += len(row[3])
        if size > limit and last:
            yield held[:last]
            held, size, last, before = held[last:], size - before, 0, 0
    if held:
        yield held


def _sort(rows: DataFrame, total: int, window: int, shard_bytes: int, memory: int) -> DataFrame:
    """(k, d, runs) of the repeated windows, from (k, d, n, body) of `total` bytes: all rows of a k meet in one task, which sorts shards of whole keys."""
    tasks = int(max(1, min(-(-total // shard_bytes), 8 * shuffle_partitions(rows.sparkSession))))

    def run(batches):
        import pyarrow as pa

        for held in batched((row for batch in small(batches) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)), shard_bytes):
            hits = repeated_starts([(body, n) for _, _, n, body in held], window, memory)
            keep = [(k, d, _runs(h)) for (k, d, _, _), h in zip(held, hits, strict=True) if h.size]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in keep], pa.int64()), pa.array([x[1] for x in keep], pa.int64()), pa.array([x[2] for x in keep], _runs_type())], ["k", "d", "runs"])

    dealt = rows.select("k", "d", "n", "body").repartition(tasks, "k").sortWithinPartitions("k", "d")
    return dealt.mapInArrow(run, f"k long, d long, runs {RUNS}")


def _bodies(texts: DataFrame, window: int) -> DataFrame:
    """(k, d, n, body): the bytes of contested regions."""

    def run(batches):
        import pyarrow as pa

        kinds = (("k", pa.int64()), ("d", pa.int64()), ("n", pa.int32()), ("body", pa.binary()))
        for batch in small(batches):
            rows = []
            for text, places in zip(batch.column(1).cast(pa.large_binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                for p in places:
                    rows.append((p["key"], p["digest"], p["count"], (text or b"")[p["start"] : p["start"] + p["count"] + window - 1]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], [name for name, _ in kinds])

    return texts.select("doc_id", "text", "places").mapInArrow(run, "k long, d long, n int, body binary")


def split(body: bytes, ahead: int, n: int, window: int, size: int) -> Iterator[tuple[bytes, int, int, int]]:
    """(core, offset, ahead, windows) of the pieces of a body of `n` windows.

    The first window holds the key's gram `ahead` bytes after its start, each further one a byte less. A piece has the windows
    with one quotient of that distance by `size`; its core is what all windows with that quotient hold, and the quotient.
    """
    low = ahead - n + 1
    for j in range(ahead // size, low // size - 1, -1):
        top, bottom = min(ahead, j * size + size - 1), max(low, j * size)
        start = ahead - j * size
        yield body[start : start - size + 1 + window] + j.to_bytes(2, "big"), ahead - top, top, top - bottom + 1


PIECES = "k long, d long, at int, ahead int, n int, cell long, content long, body binary"


def _pieces(rows: DataFrame, window: int, size: int) -> DataFrame:
    """PIECES of (k, d, ahead, n, body)."""

    def run(batches):
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest

        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        names = ["k", "d", "at", "ahead", "n", "cell", "content", "body"]

        def signed(x: int) -> int:
            return x - (1 << 64) if x >> 63 else x

        for batch in small(batches):
            out: list[tuple] = []
            for k, d, ahead, n, body in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                for core, at, top, many in split(body, ahead, n, window, size):
                    piece = body[at : at + many - 1 + window]
                    cell = xxh3_64_intdigest(core, k % (1 << 64))
                    content = xxh3_64_intdigest(piece, top * 4096 + many)
                    out.append((k, d, at, top, many, signed(cell), signed(content), piece))
                if len(out) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)
                    out = []
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)

    return rows.select("k", "d", "ahead", "n", "body").mapInArrow(run, PIECES)


def _with_ahead(rows: DataFrame, gram: int) -> DataFrame:
    """(k, d, ahead, n, body): where the first window of a region holds the gram that is its key."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in small(batches):
            ahead = [int(np.flatnonzero(Bytes(body).grams(gram).view(np.int64) == k)[0]) for k, body in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ahead, pa.int32()), batch.column(2), batch.column(3)], ["k", "d", "ahead", "n", "body"])

    return rows.mapInArrow(run, "k long, d long, ahead int, n int, body binary")


def _crowded(scratch: Scratch, rows: DataFrame, window: int, shard_bytes: int, memory: int, levels: tuple[int, ...]) -> DataFrame:
    """(k, d, runs) from (k, d, ahead, n, body), split by content."""
    w, size = scratch.write, min(levels[0], max(1, window // 2))
    pieces = w(_pieces(rows, window, size))
    groups = w(pieces.groupBy("cell", "content").agg(F.count(F.lit(1)).alias("m"), *(F.first(c).alias(c) for c in ("ahead", "n", "body"))))
    whole = groups.where("m > 1").select(F.col("cell").alias("k"), F.col("content").alias("d"), F.array(F.struct(F.lit(0).alias("at"), F.col("n").alias("n"))).alias("runs"))
    if size > 1:
        cells = w(groups.groupBy("cell").agg(F.count(F.lit(1)).alias("holders"), F.sum(F.octet_length("body")).alias("bytes")).where("holders > 1"))
        sums = cells.agg(F.sum(F.when(F.col("bytes") <= shard_bytes, F.col("bytes"))).alias("small"), F.count(F.when(F.col("bytes") > shard_bytes, 1)).alias("large")).first()
        items = groups.join(cells, "cell").select(F.col("cell").alias("k"), F.col("content").alias("d"), "ahead", "n", "body", "bytes")
        found = whole
        if sums["small"]:
            found = found.unionByName(_sort(items.where(F.col("bytes") <= shard_bytes), sums["small"], window, shard_bytes, memory))
        if sums["large"]:
            found = found.unionByName(_crowded(scratch, items.where(F.col("bytes") > shard_bytes), window, shard_bytes, memory, levels[1:]))
    else:
        found = whole
    found = found.select(F.col("k").alias("cell"), F.col("d").alias("content"), F.explode("runs").alias("r"))
    back = pieces.select("k", "d", "at", "cell", "content").join(found, ["cell", "content"])
    out = w(back.groupBy("k", "d").agg(F.collect_list(F.struct((F.col("at") + F.col("r.at")).alias("at"), F.col("r.n").alias("n"))).alias("runs")))
    scratch.drop(pieces)
    scratch.drop(groups)
    return out


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, memory: int = MEMORY) -> DataFrame:
    """(doc_id, body, start, length): intervals of bytes covered by windows that also start elsewhere. `docs`: doc_id, body, text."""
    scratch = Scratch(docs.sparkSession, "suffix")
    w = scratch.write
    found = w(region_table(docs, Bytes, window, gram))
    place = F.min(F.struct("doc_id", "body", "start", "count")).alias("first")
    distinct = w(found.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("n"), place))
    contested = w(distinct.groupBy("key").agg(F.count(F.lit(1)).alias("holders"), F.sum(F.col("first.count") + window).alias("bytes")).where("holders > 1").drop("holders"))
    large = F.col("bytes") > shard_bytes
    sums = contested.agg(F.coalesce(F.sum(F.when(~large, F.col("bytes"))), F.lit(0)).alias("small"), F.count(F.when(large, 1)).alias("large")).first()
    held = w(distinct.join(contested, "key").select("key", "digest", "first.doc_id", "first.body", "first.start", "first.count", large.alias("crowded")))
    flags = w(_sort(_bodies(with_texts(docs, held.where("not crowded").drop("crowded")), window), sums["small"], window, shard_bytes, memory))
    if sums["large"]:
        crowded = _with_ahead(_bodies(with_texts(docs, held.where("crowded").drop("crowded")), window), gram)
        flags = flags.unionByName(_crowded(scratch, crowded, window, shard_bytes, memory, LEVELS))
    flags = flags.withColumnsRenamed({"k": "key", "d": "digest"})
    verdict = distinct.select("key", "digest", "n").join(flags, ["key", "digest"], "left").where(F.col("runs").isNotNull() | (F.col("n") > 1))
    scratch.drop(contested)
    scratch.drop(held)
    verdict = w(verdict)
    scratch.drop(distinct)
    cuts = found.join(verdict, ["key", "digest"])
    all_of = F.array(F.struct(F.lit(0).alias("at"), F.col("count").alias("n")))
    runs = cuts.select(*TEXT, "start", F.explode(F.when(F.col("n") > 1, all_of).otherwise(F.col("runs"))).alias("r"))
    out = w(runs.select(*TEXT, (F.col("start") + F.col("r.at")).alias("start"), (F.col("r.n") + window - 1).alias("length")))
    scratch.drop(found)
    scratch.drop(verdict)
    return out


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, memory: int = MEMORY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, n_spans) of every document; kept is binary."""
    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("doc_id", F.xxhash64(F.col("id").cast("string"))).withColumn("body", F.xxhash64("text"))
    spans = repeats(rows.select("doc_id", "body", "text"), window, gram, shard_bytes, memory)
    cuts = spans.groupBy(*TEXT).agg(F.collect_list(F.struct("start", "length")).alias("cuts"))
    joined = rows.join(cuts, list(TEXT), "left").select("id", "text", "cuts")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in small(batches):
            kept, sizes, gone, runs = [], [], [], []
            for body, intervals in zip(batch.column(1).cast(pa.large_binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                seq = Bytes(body)
                sizes.append(seq.size)
                if not intervals:
                    kept.append(seq.data)
                    gone.append(0)
                    runs.append(0)
                    continue
                removed = cut(seq, [c["start"] for c in intervals], [c["length"] for c in intervals])
                gone.append(int(removed.sum()))
                runs.append(int(removed[0]) + int((removed[1:] & ~removed[:-1]).sum()))
                kept.append(np.frombuffer(seq.data, np.uint8)[~removed].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (sizes, gone, runs))], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return joined.mapInArrow(run, f"doc_id {kind}, kept binary, n_bytes long, n_removed long, n_spans long")


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of all documents."""
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
