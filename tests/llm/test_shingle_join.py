"""The pipeline's near duplicates against brute force at a 5-word shingle similarity of 0.8."""

import random

import pytest

import corpus_pipeline
from quadlake.llm import shingle_join


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    line = [rng.choice(words) for _ in range(40)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randrange(6, 300))]
        texts.append(base)
        for _ in range(9):
            body = list(base if rng.random() < 0.6 else texts[-1])
            for _ in range(rng.randrange(0, 1 + max(1, len(body) // 30))):
                body[rng.randrange(len(body))] = rng.choice(words)
            texts.append(body)
        texts.append(line + [rng.choice(words) for _ in range(rng.randrange(8, 60))])
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    return [*rows, (900, rows[3][1].upper()), (901, None), (902, ""), (903, "one two"), (904, "One  two"), (None, rows[0][1])]


def brute(rows):
    sets = {}
    for i, text in rows:
        if i is not None:
            w = (text or "").lower().split()
            sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and (a == b or 5 * len(a & b) >= 4 * len(a | b)):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in sets}


@pytest.mark.parametrize(("sample", "least"), [(16, 6), (1, 3)])
def test_components(spark, sample, least):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int")
    got = {r.doc_id: r.component_id for r in shingle_join.similar_documents(docs, sample=sample, least=least).collect()}
    want = brute(rows)
    assert got == want and len(set(want.values())) < len(want) - 20


def test_stage(spark):
    rows = corpus()
    docs = spark.createDataFrame([*rows, rows[3], rows[3], (3, rows[3][1].lower() + " ")], "doc_id long, text string")
    kept = [r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()]
    assert sorted(i for i in kept if i is not None) == sorted(i for i, c in brute(rows).items() if i == c)
    assert kept.count(None) == 1
