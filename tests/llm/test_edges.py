"""Very long texts, repeated rows and ids of other types, for the operators whose own tests have none."""

import random

import pytest
from xxhash import xxh64_intdigest

from quadlake.llm import decontaminate, mixing, pii, simhash, toxicity, url_filter

LONG = 1_100_000


@pytest.fixture(scope="module")
def words():
    rng = random.Random(12)
    return [f"w{rng.randrange(10_000)}x" for _ in range(LONG // 7)]


def test_long_url(spark):
    path = "/a" * (LONG // 2)
    rows = [(1, f"HTTP://Spam.Example.com{path}?q=1#f"), (2, f"http://spam.example.com{path}?q=1"), (2, f"http://spam.example.com{path}?q=1"), (3, "x" * LONG), (4, "a://" + "h" * LONG)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    listed = spark.createDataFrame([(f"spam.example.com{path}?q=1",)], "listed_url string")
    got = sorted((r.page_id, len(r.host), len(r.path), r.verdict) for r in url_filter.judge(pages, listed).collect())
    assert got == [(1, 16, len(path), "block"), (2, 16, len(path), "block"), (2, 16, len(path), "block"), (3, 0, 0, "allow"), (4, LONG, 0, "allow")]


def test_long_text_fingerprint(spark, words):
    rows = [(5, " ".join(words)), (3, " ".join(words).upper()), (9, "\n".join(words)), (9, "\n".join(words)), (1, " ".join(words[:-1]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_duplicates(docs).collect()
    assert {r.component_id for r in got} == {1} and len(got) == 5
    low = [w.encode() for w in words]
    hashes = [xxh64_intdigest(b" ".join(low[i : i + 4]), 42) for i in range(len(low) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert {r.fp % (1 << 64) for r in got if r.doc_id == 5} == {want}
    assert {r.component_id for r in simhash.near_duplicates(docs, shingle=5, similarity=0.8).collect()} == {1}


def test_long_text_in_a_mix(spark, words):
    docs = spark.createDataFrame([(1, " ".join(words), "a"), (2, "x y", "a"), (3, "z " * 50, None)], "doc_id long, text string, source string")
    got = {r.doc_id: (r["size"], len(r.placements)) for r in mixing.mix(docs).collect()}
    assert got[1][0] == len(words) and got[2][0] == 2 and all(n <= 2 for _, n in got.values())


def test_long_text_with_an_item(spark, words):
    """A benchmark item at the end of a very long text; rows and items that repeat."""
    item = " ".join(f"item{i}" for i in range(30))
    rows = [(1, " ".join(words) + " " + item), (1, " ".join(words) + " " + item), (2, " ".join(words)), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (7, item), (8, item.upper()), (9, None)], "item_id long, text string")
    got = sorted(tuple(r) for r in decontaminate.matches(docs, bench).collect())
    assert got == sorted([(1, 7, 1.0, len(words), 30), (1, 8, 1.0, len(words), 30)] * 2)
    assert sorted(r.doc_id for r in decontaminate.clean(docs, bench).collect()) == [2, 3]


def test_other_ids(spark):
    docs = spark.createDataFrame([("a", "x y z"), ("b", None)], "doc_id string, text string")
    for run in (lambda: simhash.near_duplicates(docs), lambda: decontaminate.matches(docs, docs.selectExpr("1 as item_id", "text"))):
        with pytest.raises(TypeError, match="integer"):
            run()
    assert pii.pseudonymize(docs).count() == 2 and mixing.mix(docs.selectExpr("*", "'s' as source")).count() == 2
    model = toxicity.learn(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, model).count() == 2
