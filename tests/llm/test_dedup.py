"""SimHash, suffix and substring dedup against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from quadlake.llm import induced, simhash, substring_dedup, suffix_dedup, windows
from quadlake.llm._common import Scratch

EDGE = [(None, "no id " * 30), (900, None), (901, ""), (902, "one"), (903, " \t\n ")]


def corpus(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]

    def text(n):
        return " ".join(rng.choice(words) for _ in range(n))

    passage, rows = text(70), []
    for i in range(30):
        kind = i % 6
        body = text(rng.randrange(20, 160))
        if kind == 1 and rows:
            body = rows[rng.randrange(len(rows))][1]
        elif kind == 2:
            body = f"{text(9)}\n{passage}  {text(12)}"
        elif kind == 3 and rows:
            parts = rows[rng.randrange(len(rows))][1].split(" ")
            parts[rng.randrange(len(parts))] = "changed"
            body = " ".join(parts)
        elif kind == 4:
            body = f"{passage} {passage}"
        rows.append((i, body))
    rows.append((700, "aa é " * 600))
    return [*rows, *EDGE]


def brute_fingerprint(text, k):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark):
    rows = [*corpus(), (950, "One"), (950, "One")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, fp int")
    got = sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()))
    fps = [(i, brute_fingerprint(t, 4)) for i, t in rows if i is not None]
    root = {i: i for i, _ in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in fps:
        for j, b in fps:
            if bin(a ^ b).count("1") <= 4:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    assert got == sorted((i, f, find(i)) for i, f in fps)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("radius", "parts"), [(4, 3), (6, 4), (3, 2)])
def test_links_are_complete(spark, radius, parts):
    rng = random.Random(radius)
    values = {rng.getrandbits(64) for _ in range(40)}
    for v in list(values):
        for _ in range(3):
            for b in rng.sample(range(64), rng.randrange(1, 9)):
                v ^= 1 << b
            values.add(v)
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    near = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) % (1 << 64)).count("1") <= radius}
    for comp in (lambda v: v, lambda v: v % 3, lambda v: 0):
        nodes = spark.createDataFrame([(v, v, comp(v)) for v in signed], "node long, fp long, comp long")
        for crowd in (64, 2):
            got = [tuple(r) for r in simhash.cross_links(Scratch(spark, "links"), nodes, radius, parts, crowd).collect()]
            assert len(got) == len(set(got)) and set(got) == {(a, b) for a, b in near if comp(a) != comp(b)}


def test_large_group_makes_few_links(spark):
    """Near copies of one text: a star of links joins them, and no pairs within the component are made."""
    base, rng = 0x1234_5678_9ABC_DEF0, random.Random(2)
    nodes = spark.createDataFrame(sorted({(base ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)),) for _ in range(800)}), "fp long").selectExpr("fp as node", "fp").cache()
    n, hubs = nodes.count(), simhash.hub_links(nodes, 4, 3).count()
    assert n > 600 and hubs < 4 * n
    joined = nodes.selectExpr("node", "fp", "0L as comp")
    assert simhash.cross_links(Scratch(spark, "links"), joined, 4, 3).count() == 0


def test_induced_sorting():
    rng = random.Random(3)
    for t in range(300):
        data = bytes(rng.choice(rng.choice([b"a", b"ab", b"abc", bytes(range(255))])) for _ in range(rng.randrange(1, 50))) * rng.randrange(1, 4)
        depth = rng.choice([3, 8, 20])
        pos, lcp = [], []
        for p, l in induced.sorted_suffixes(data, depth, memory=rng.choice([64, 1 << 20])):
            pos += p.tolist()
            lcp += l.tolist()
        assert sorted(pos) == list(range(len(data)))
        for a, b, l in zip(pos, pos[1:], lcp[1:], strict=False):
            x, y = data[a:][:depth], data[b:][:depth]
            assert x >= y
            same = next((i for i, (c, d) in enumerate(zip(x, y, strict=False)) if c != d), min(len(x), len(y)))
            assert same == l


def test_regions_cover_every_window_once():
    data = ("lorem ipsum dolor " * 40 + "x" * 500).encode()
    _, _, starts, counts = windows.regions(windows.Bytes(data), 100, 16)
    assert starts[0] == 0 and np.array_equal(starts[1:], (starts + counts)[:-1]) and starts[-1] + counts[-1] == len(data) - 99


def brute_bytes(rows, w):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + w] for t in texts for i in range(len(t) - w + 1))
    out = []
    for (doc, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - w + 1):
            if seen[t[i : i + w]] > 1:
                gone[i : i + w] = True
        kept = bytes(c for c, g in zip(t, gone, strict=False) if not g)
        out.append((doc, len(t), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("shard_bytes", "memory"), [(1 << 20, 1 << 20), (1 << 11, 1 << 10), (200, 64)])
def test_suffix_dedup(spark, shard_bytes, memory):
    """Whole keys sorted; keys and cells larger than a shard split by content, with queues that spill."""
    rows = [*corpus(2), (5, "again " * 40), (5, "again " * 40)]
    docs = spark.createDataFrame([(*r, b"x") for r in rows], "doc_id long, text string, kept binary")
    out = suffix_dedup.dedup(docs, window=80, gram=16, shard_bytes=shard_bytes, memory=memory)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in out.collect()), key=repr)
    assert got == brute_bytes(rows, 80)
    assert suffix_dedup.dedup(docs.limit(0)).count() == 0


def brute_words(rows, w):
    split = [(d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, x in split:
        for i in range(len(x) - w + 1):
            key = tuple(x[i : i + w])
            if d is not None:
                first[key] = min(first.get(key, d), d)
    out = []
    for d, x in split:
        gone = [False] * len(x)
        for i in range(len(x) - w + 1):
            if d is not None and first[tuple(x[i : i + w])] < d:
                gone[i : i + w] = [True] * w
        out.append((d, len(x), sum(gone), b" ".join(c for c, g in zip(x, gone, strict=True) if not g).decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("batches", "fan_in"), [(1, 2), (3, 2), (6, 3)])
def test_substring_dedup(spark, batches, fan_in):
    """Few and many batches, runs compacted and met again; ids that repeat, with equal and other texts."""
    rows = corpus(4)
    rows += [(rows[3][0], rows[20][1] + " more words"), (rows[9][0], rows[9][1]), (1, "other " + rows[8][1]), (1, "short")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, batch int")
    out = substring_dedup.dedup(docs, window=20, gram=4, batches=batches, fan_in=fan_in)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in out.collect()), key=repr) == brute_words(rows, 20)


def test_index_opened_again(spark, tmp_path):
    """A batch added by an index opened later finds what the earlier ones hold; compaction keeps it."""
    rows = [r for r in corpus(6) if r[0] is not None and r[1]]
    docs = windows.named(spark.createDataFrame(rows, "doc_id long, text string"))
    bounds, found = [0, 6, 13, 20, 27, 1 << 40], []
    for low, high in zip(bounds, bounds[1:], strict=False):
        index = substring_dedup.FingerprintIndex(spark, str(tmp_path / "index"), window=20, gram=4, fan_in=3)
        part = docs.where((docs.doc_id >= low) & (docs.doc_id < high))
        found += index.add(windows.region_table(part, windows.Words, 20, 4), docs).collect()
    assert len(index.runs) == 1 and index.version == 7
    gone = Counter()
    for i, text in rows:
        cuts = [(r.start, r.length) for r in found if r.doc_id == i]
        gone[i] = int(windows.cut(windows.Words(text.encode()), [a for a, _ in cuts], [n for _, n in cuts]).sum())
    assert {r[0]: r[2] for r in brute_words(rows, 20)} == dict(gone)
    with pytest.raises(ValueError, match="windows of 20"):
        substring_dedup.FingerprintIndex(spark, str(tmp_path / "index"), window=30, gram=4)


def test_long_texts(spark):
    """One text of a million characters against its own copy in pieces."""
    rng = random.Random(8)
    words = [f"word{rng.randrange(5000)}" for _ in range(120_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[1000:1400])), (3, " ".join(words[70_000:90_000]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(rows[0][1]) > 1_000_000
    got = {r.doc_id: r.n_removed for r in substring_dedup.dedup(docs).collect()}
    assert got == {1: 0, 2: 400, 3: 20_000}
    out = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.dedup(docs).collect()}
    assert out[1][2] == 2 and out[2][0] == out[2][1] and out[3][0] == out[3][1]


def test_substring_dedup_edges(spark):
    assert substring_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(TypeError):
        substring_dedup.dedup(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
