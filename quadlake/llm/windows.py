"""Windows of fixed length that recur, found through minimizer regions.

A window's minimizer is the k-gram inside it with the smallest hash (the leftmost of equals). It depends
on the window's content alone, so equal windows have equal minimizers at equal offsets. Consecutive
windows with the same minimizer occurrence form a region; a text of n items has about 2n/w of them.
Two windows can only be equal if their regions share the k-gram hash (the key), and equal regions (key
and digest) hold equal windows. So one row a region replaces one row a window, copies collapse to one row per
distinct region before anything is compared, and only keys with several distinct regions are contested
and need a closer look.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadlake.llm._common import arrow_rows

#: Grams per piece of a long text: positions stay below the bits kept for them.
PIECE, POSITION = 1 << 19, (1 << 20) - 1
FACTORS = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)
#: A text is named by its document and a hash of its own, so that documents may repeat an id.
TEXT = ("doc_id", "body")
REGION = "key long, digest long, doc_id long, body long, start int, count int"


def scramble(x):
    """A bijection of uint64 that spreads every bit; in place."""
    import numpy as np

    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(32)
    return x


class Words:
    """A text as words; the content of a window is its words joined by one space."""

    def __init__(self, text: bytes | None):
        import numpy as np

        words = (text or b"").split()
        self.size = len(words)
        self.data = b" ".join(words)
        self.words = words
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        self.at = np.concatenate((np.zeros(1, np.int64), ends))

    def grams(self, k: int):
        import numpy as np
        from xxhash import xxh64_intdigest

        h = np.fromiter(map(xxh64_intdigest, self.words), np.uint64, self.size)
        n = self.size - k + 1
        out = h[:n] * np.uint64(FACTORS[0])
        for j in range(1, k):
            out += h[j : j + n] * np.uint64(FACTORS[j])
        return scramble(out)

    def slice(self, first: int, last: int) -> bytes:
        return self.data[self.at[first] : self.at[last] - 1]


class Bytes:
    """A text as UTF-8 bytes."""

    def __init__(self, text: bytes | None):
        self.data = text or b""
        self.size = len(self.data)

    def grams(self, k: int):
        import numpy as np

        x = np.frombuffer(self.data, np.uint8).astype(np.uint64)
        for step in (1, 2, 4):  # eight bytes from every position
            x = x[:-step] | (x[step:] << np.uint64(8 * step))
        n = self.size - k + 1
        out = x[:n] * np.uint64(FACTORS[0])
        for j in range(1, k // 8):
            out += x[8 * j : 8 * j + n] * np.uint64(FACTORS[j])
        return scramble(out)

    def slice(self, first: int, last: int) -> bytes:
        return self.data[first:last]


def regions(seq, window: int, k: int):
    """(keys, digests, starts, counts) of the regions of one text, as signed integers."""
    import numpy as np
    from xxhash import xxh3_64_intdigest

    empty = np.zeros(0, np.int64)
    if seq.size < window:
        return empty, empty, empty, empty
    grams = seq.grams(k)
    w = window - k + 1
    keys, starts, counts, anchors = [], [], [], []
    total = grams.size - w + 1
    low = np.uint64(POSITION)
    for base in range(0, total, PIECE):
        g = grams[base : base + PIECE + w - 1]
        n = min(PIECE, total - base)
        m = (g & ~low) | np.arange(g.size, dtype=np.uint64)
        span = 1
        while span * 2 <= w:
            m = np.minimum(m[:-span], m[span:])
            span *= 2
        if span < w:
            m = np.minimum(m[:n], m[w - span : w - span + n])
        at = (m[:n] & low).astype(np.int64)
        first = np.concatenate((np.zeros(1, np.int64), np.flatnonzero(at[1:] != at[:-1]) + 1))
        counts.append(np.diff(np.append(first, n)))
        keys.append(g[at[first]])
        starts.append(first + base)
        anchors.append(at[first] - first)
    keys, starts, counts, anchors = (np.concatenate(x) for x in (keys, starts, counts, anchors))
    digests = np.fromiter((xxh3_64_intdigest(seq.slice(s, s + c + window - 1), a) for s, c, a in zip(starts.tolist(), counts.tolist(), anchors.tolist(), strict=True)), np.uint64, starts.size)
    return keys.view(np.int64), digests.view(np.int64), starts, counts


def named(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, body, text) of the rows with an id."""
    body = F.col(text).cast("string")
    return docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(body).alias("body"), body.alias("text"))


def region_table(docs: DataFrame, kind: type, window: int, k: int) -> DataFrame:
    """(key, digest, doc_id, body, start, count): one row per region of every text of ``named`` documents."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held, rows = [], 0

        def out():
            key, digest, start, count, doc, body = (np.concatenate(c) for c in zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(digest), pa.array(doc), pa.array(body), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))], ["key", "digest", "doc_id", "body", "start", "count"])

        for doc_id, body, text in arrow_rows(batches, "doc_id", "body", "text"):
            found = regions(kind(text), window, k)
            n = found[0].size
            if n:
                held.append((*found, np.full(n, doc_id, np.int64), np.full(n, body, np.int64)))
                rows += n
            if rows >= 50_000:
                yield out()
                held, rows = [], 0
        if held:
            yield out()

    return docs.select("doc_id", "body", "text").mapInArrow(run, REGION)


def with_texts(docs: DataFrame, reps: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """(doc_id, text, places) for the texts that hold representatives; places: array of structs of the other columns of `reps`.

    A text's places are about as many as its windows over half the window's length, so they stay in proportion to
    the text. The names of the texts are broadcast to thin the documents before the shuffle if there are at most `limit` of them.
    """
    places = reps.groupBy(*TEXT).agg(F.collect_list(F.struct(*[c for c in reps.columns if c not in TEXT])).alias("places"))
    ids = reps.select(*TEXT).distinct()
    source = docs
    if ids.count() <= limit:
        source = docs.join(F.broadcast(ids), list(TEXT), "left_semi")
    return source.join(places, list(TEXT)).select("doc_id", "text", "places")


def cut(seq, starts: list[int], lengths: list[int]):
    """Boolean mask of the items covered by any of the intervals."""
    import numpy as np

    marks = np.zeros(seq.size + 1, np.int32)
    np.add.at(marks, np.asarray(starts, np.int64), 1)
    np.add.at(marks, np.asarray(starts, np.int64) + np.asarray(lengths, np.int64), -1)
    return np.cumsum(marks[:-1]) > 0
