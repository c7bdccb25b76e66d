"""URL filter, personal data, mixing."""

import re

import duckdb
from pyspark.sql import functions as F

from quadlake.llm import mixing, pii, url_filter

SF = "/root/testdata/sf0.001"


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def test_url_rules_and_edges(spark):
    rows = [(1, "http://a.b.NET/x"), (2, "https://example.net/en/1"), (3, "http://w.example.com/de/2?q"), (4, "http://x.org/fr/"), (5, None), (6, "nothing"), (7, "http://spam.example.com/a/?utm_source=x#t"), (7, "http://spam.example.com/a/?utm_source=x#t"), (8, "http://net"), (9, "")]
    pages = spark.createDataFrame([(i, u, "clash", 1) for i, u in rows], "page_id long, url string, host string, block int")
    listed = spark.createDataFrame([("spam.example.com/a",), (None,), ("",)], "listed_url string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, listed).collect()}
    assert got == {
        (1, "a.b.net", "/x", "net/", "block"), (2, "example.net", "/en/1", "example.net/en/", "allow"), (3, "w.example.com", "/de/2", "example.com/de/", "block"), (4, "x.org", "/fr/", "org/fr/", "allow"),
        (5, "", "", None, "allow"), (6, "", "", None, "allow"), (7, "spam.example.com", "/a/", None, "block"), (8, "net", "", None, "allow"), (9, "", "", None, "allow"),
    }
    assert url_filter.judge(pages.limit(0), listed).count() == 0
    # one bit block: every URL passes the filter, the exact join still decides
    tight = {(r.page_id, r.verdict) for r in url_filter.judge(pages, listed, blocks=1).collect()}
    assert (7, "block") in tight and (8, "allow") in tight


def test_url_query_matches_sql(spark):
    got = sorted(map(tuple, url_filter.op1_url_filter(spark, SF).collect()), key=repr)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    assert got == sorted(con.execute(url_filter.OP1_SQL).fetchall(), key=repr)


TEXTS = [
    "call +1 (017) 555-7713 or und.34@mail7.example.com, UND.34@MAIL7.EXAMPLE.COM",
    "4845168114407329 and 4845-1681-1440-7329 but 4845168114407328",
    "ip 97.51.17.173 version 1.2.3.4.5 not 300.1.1.1",
    "born 1984-02-29, 02/03/1990, 31/12/1999, 31.12.1999, never 1984-02-30",
    "ssn 123-45-6789 000-12-3456",
    "DE89 3704 0044 0532 0130 00, GB82WEST12345698765432, DE88 3704 0044 0532 0130 00",
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"',
    "", None, "nothing 4.0 2020",
]


def test_pseudonyms(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*TEXTS, TEXTS[1]])], "doc_id long, text string, found string")
    out = {r.doc_id: r for r in pii.pseudonymize(docs).collect()}
    assert [out[i].n_replaced for i in range(10)] == [3, 2, 1, 4, 1, 2, 1, 0, 0, 0]
    assert out[7].text == "" and out[8].text is None and out[9].text == TEXTS[9] and out[0].found == "x"
    mails = re.findall(r"\S+@\S+\w", out[0].text)
    assert mails[0].lower() == mails[1].lower() and mails[0] != "und.34@mail7.example.com" and mails[1].isupper()
    cards = re.findall(r"\d[\d-]{15,}", out[1].text)
    assert cards[0] == cards[1].replace("-", "") and luhn(cards[0]) and cards[0] != "4845168114407329" and cards[2] == "4845168114407328"
    assert "1.2.3.4.5" in out[2].text and "300.1.1.1" in out[2].text and "97.51.17.173" not in out[2].text
    assert "1984-02-30" in out[3].text and "1984-02-29" not in out[3].text
    assert out[10].text == out[1].text  # linked across documents
    ibans = [re.sub(r" ", "", x) for x in re.findall(r"[A-Z]{2}\d{2}[ A-Z0-9]+\d", out[5].text)]
    for x in ibans[:2]:
        assert int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1
    assert pii.pseudonymize(docs.limit(0)).count() == 0


def test_feistel_is_a_permutation(spark):
    pairs = spark.range(77).select(pii.permute_pair(F.floor(F.col("id") / 11), F.pmod(F.col("id"), F.lit(11)), (7, 11), "k", "t").alias("p"))
    assert pairs.distinct().count() == 77
    strings = spark.range(1000).select(pii.permute_symbols(F.lpad(F.col("id").cast("string"), 3, "0"), pii.DIGITS, "k", "t").alias("p"))
    assert strings.distinct().count() == 1000


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        room = total - sum(capped.values())
        share = {s: room * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 2.0 * sizes[s] for s in over}


def test_mixing(spark):
    rows = [(i, "w " * (i % 40 + 1), f"s{i % 7 if i % 3 else 0}") for i in range(600)] + [(1000, None, "s1"), (1001, "", None), (1002, "a b c", None), (1002, "a b c", None), (None, "x y", "")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, skey string")
    out = mixing.mix(docs, shards=5, block_docs=16).collect()
    assert len(out) == len(rows)
    sizes, taken = {}, {}
    for r in out:
        assert r.size == len((r.text or "").split()) and len(r.placements) <= 2 and r.skey == "clash"
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.size * len(r.placements)
    targets = brute_targets(sizes)
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - targets[r.source]) < 1e-6
    assert all(0 <= targets[s] - taken[s] <= 40 for s in sizes)
    again = mixing.mix(docs.repartition(7), shards=5, block_docs=16)
    assert sorted((str(r.doc_id), str(r.source), tuple(r.placements)) for r in again.collect()) == sorted((str(r.doc_id), str(r.source), tuple(r.placements)) for r in out)
    assert mixing.mix(docs.limit(0)).count() == 0
    several = mixing.mix(docs, shards=5, block_docs=16, max_sources=2).collect()  # groups of sources with a tree each
    assert sorted((str(r.doc_id), str(r.source), len(r.placements)) for r in several) == sorted((str(r.doc_id), str(r.source), len(r.placements)) for r in out)
    per_shard = [sum(len([p for p in r.placements if p["shard"] == k]) for r in out) for k in range(5)]
    assert min(per_shard) > 0.4 * max(per_shard)
    assert all(len({p["pass"] for p in r.placements}) == len(r.placements) for r in out)


def test_taken_is_what_the_shards_drew(spark, monkeypatch):
    """Without a shard's ranges its documents are not taken."""
    docs = spark.createDataFrame([(i, "w " * 9, f"s{i % 3}") for i in range(400)], "doc_id long, text string, source string")
    whole = {r.doc_id: len(r.placements) for r in mixing.mix(docs, shards=4, block_docs=8).collect()}
    tree = mixing.split_tree
    monkeypatch.setattr(mixing, "split_tree", lambda *a: [row for row in tree(*a) if row[1] != 2])
    part = {r.doc_id: len(r.placements) for r in mixing.mix(docs, shards=4, block_docs=8).collect()}
    assert all(part[i] <= whole[i] for i in whole) and 0 < sum(part.values()) < sum(whole.values())


def test_tree_is_exact_and_disjoint():
    quotas = {"a": 100, "b": 7, "c": 0, "d": 33}
    rows = mixing.split_tree(quotas, 8, 3)
    for name, n in quotas.items():
        ranges = sorted((at, at + k) for s, _, at, k in rows if s == name)
        assert sum(b - a for a, b in ranges) == n and all(x[1] == y[0] for x, y in zip(ranges, ranges[1:], strict=False))
    per_shard = [sum(k for _, sh, _, k in rows if sh == i) for i in range(8)]
    assert max(per_shard) - min(per_shard) <= 3
