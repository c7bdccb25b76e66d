"""Toxicity, decontamination, HTML extraction, exact search, pipeline."""

import math
import random
import time
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from quadlake.llm import decontaminate, html_text, topk, toxicity
from quadlake.llm._common import Scratch

SF = "/root/testdata/sf0.001"


def test_channel_decoding(spark):
    texts = ["the idiot said stupid worthless things and the moron was a clown " * 20, "plain words of the text and more words " * 200]
    grams = toxicity.count_ngrams(spark.createDataFrame([(t,) for t in [*texts, None, ""]], "text string")).collect()
    price = toxicity.CharModel([r["code"] for r in grams], [r["n"] for r in grams]).price
    restorer = toxicity.Restorer(price)
    for spelled, word in (("1d10t", "idiot"), ("i d i o t", "idiot"), ("stup!d", "stupid"), ("w0rthl3ss", "worthless"), ("m.o.r.o.n", "moron"), ("clooooown", "clown"), ("IDIOT!!", "idiot")):
        assert word in restorer.words(f"of the {spelled}, and"), spelled
    assert restorer.words("") == set()
    for joined in ("-".join(["1d10t"] * 20), ".".join(["w0rthl3ss"] * 200), "st" + "u" * 500 + "pid"):  # tokens of any length
        assert restorer.words(joined) & {"idiot", "worthless", "stupid"}, joined[:40]
    began = time.perf_counter()
    restorer.words("q7z!" * 25_000 + " " + "aaa" * 30_000 + " " + "a b " * 25_000)
    assert time.perf_counter() - began < 60


def test_toxicity_learns_without_held_out(spark):
    rng = random.Random(1)
    plain = [f"{a}{b}" for a in "bdfgklmnprst" for b in "aeiou"]
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        words = [rng.choice(plain) + rng.choice(plain) for _ in range(30)]
        if bad:
            words[3] = "vileword" if i % 10 else "v1l3w0rd"
        rows.append((i, " ".join(words), "clash"))
        labels.append((i, int(bad)))
    rows += [(None, "x", "c"), (901, None, "c"), (902, "", "c"), (903, "y " * 50_000, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = spark.createDataFrame([*labels, (None, 1), (5000, None), (0, 1)], "doc_id long, toxic int").where(~toxicity.held_out())
    model = toxicity.learn(docs, marks)
    out = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert len(out) == len(rows) and all(0 <= s <= 1 for s in out.values())
    for i, bad in labels:
        if zlib.crc32(str(i).encode()) % 4 == 2:
            assert (out[i] >= toxicity.THRESHOLD) == bool(bad), i
    one_class = toxicity.learn(docs, marks.where("toxic = 0"))
    assert one_class.weights == {} and toxicity.score(docs.limit(0), one_class).count() == 0


def test_decontamination(spark):
    rng = random.Random(2)
    vocab = [f"v{i}" for i in range(300)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randrange(25, 50)))) for k in range(12)] + [(50, "too short"), (51, None), (52, ""), (53, "too short")]
    rows = []
    for i in range(60):
        body = [rng.choice(vocab) for _ in range(rng.randrange(20, 200))]
        if i % 3 == 0:
            part = items[rng.randrange(12)][1].split()
            if i % 2:
                part[rng.randrange(len(part))] = "edited"
            at = rng.randrange(len(body))
            body[at:at] = part
        rows.append((i, " ".join(body).upper() if i % 4 == 0 else "\n".join(body)))
    rows += [(100, None), (101, ""), (102, "this is too short here"), (None, items[0][1])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start_word) for r in decontaminate.matches(docs, bench).collect()}
    brute = {}
    for d, t in rows:
        words = (t or "").lower().split()
        for k, b in items:
            item = (b or "").split()
            found = [(round(decontaminate.similarity(words[i : i + len(item)], item, 5), 9), -i) for i in range(len(words) - len(item) + 1)] if item else []
            if found and max(found)[0] >= 0.8:
                brute[d, k] = (max(found)[0], -max(found)[1])
    assert got == brute and len(brute) >= 15
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in brute}
    assert decontaminate.matches(docs, bench.limit(0)).count() == 0 and decontaminate.matches(docs.limit(0), bench).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var x="</p>";</script></head><body class="ad-free"><header><h1>Site</h1></header>
<nav><ul><li><a href="/x">menu</a></ul></nav><div id="cookieNotice">cookies</div><main><article><header><h1>Head &lt;line&gt; &#233;</h1></header>
<p>One <b>bold<br>two</p><p>Un<i>cl</i>osed<ul><li>a<li>b</ul><div class="advert-box">buy</div><form><p>name</p></form><p>Site line</p><!-- no --></article>
<section class="comments"><article class="comment">nice</article></section></main><aside>side</aside><footer>foot"""


def test_html_page():
    assert html_text.Page(PAGE).text() == "Head <line> é\n\nOne bold two\n\nUnclosed\n\na\n\nb\n\nSite line"
    for source in ("", "<", "<p", "a < b", "<p>x</div></p></p>y", "<a href='>'>q</a>", "&amp;&nosuch;", "<script>never"):
        assert isinstance(html_text.Page(source).text(), str)
    assert html_text.Page("<table><tr><td>a<td>b<tr><td>c</table>").text() == "a\n\nb\n\nc"


def test_html_templates(spark):
    rows = [(i, f"http://{'h' if i % 3 else 'g'}.example/{i}", f"<div><p>text {i} here</p><div>Shared line of the site</div></div>") for i in range(30)]
    rows += [(100, None, None), (101, "http://h.example/", ""), (102, "x", "<p>alone</p>"), (102, "x", "<p>alone</p>")]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, host string")
    out = [tuple(r) for r in html_text.extract(pages).collect()]
    assert len(out) == len(rows)
    texts = {r[0]: r[2] for r in out}
    assert all(texts[i] == f"text {i} here" for i in range(30)) and texts[100] == "" and texts[101] == "" and texts[102] == "alone"
    assert all(r[3] == len(r[2]) for r in out)
    assert html_text.extract(pages.limit(0)).count() == 0


def test_topk_matches_sql(spark):
    got = sorted(tuple(r) for r in topk.op7_topk(spark, SF).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert got == sorted(con.execute(topk.OP7_SQL).fetchall())


def brute_topk(rows, k):
    sound = [(i, [int(math.floor(1024 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and x == x and abs(x) != math.inf for x in v)]
    out = []
    for n, (q, a) in enumerate(sound):
        if q % 100 == 0:
            scores = [(sum(x * y for x, y in zip(a, b, strict=False)), i) for m, (i, b) in enumerate(sound) if m != n]
            best = sorted((-min(2**63 - 1, max(1 - 2**63, s)), i) for s, i in scores)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_topk_edges(spark):
    """Unsound, short, empty, repeated and huge vectors; query rows that repeat an id."""
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, [-1.0, 9e9]), (4, [nan, 1.0]), (5, [inf]), (6, None), (7, [None, 1.0]), (8, [2.0]), (9, []), (None, [1.0]), (100, [0.1, 0.1]), (2, [1.0, 0.5])]
    rows += [(100, [0.1, 0.1]), (100, [-3.0]), (11, [1e16, 2.0]), (12, [-1e300]), (13, [3e15, -7.5]), (200, [1e13, 1.0]), (300, [0.0])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, pack int")
    asks = F.col("vec_id") % 100 == 0
    for k, block_rows in ((4, 3), (10, 256), (40, 2)):
        got = sorted(tuple(r) for r in topk.top_inner_products(df, asks, k=k, block_rows=block_rows).collect())
        assert got == brute_topk(rows, k)
    assert topk.top_inner_products(df.limit(0), asks).count() == 0
    assert topk.top_inner_products(df.where("vec_id = 1"), asks).count() == 0
    with pytest.raises(TypeError):
        topk.top_inner_products(df.selectExpr("string(vec_id) as vec_id", "embedding"), asks)


def test_topk_ships_few_blocks(spark):
    """Where ranges of ids lie close together, most pairs of batch and block go before any block is shipped."""
    rng = random.Random(4)
    rows = []
    for group in range(40):
        centre = [rng.gauss(0, 1) if d // 4 == group % 12 else 0.0 for d in range(48)]
        rows += [(group * 100 + i, [max(0.0, c + rng.gauss(0, 0.05)) if c else 0.0 for c in centre]) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asks = F.col("vec_id") == 700
    scratch = Scratch(spark, "test-topk")
    blocks, _, pairs = topk.candidate_pairs(scratch, df, asks, 10, "vec_id", "embedding", 50)
    assert blocks.count() >= 80 and 1 <= pairs.count() <= 20
    got = [tuple(r) for r in topk.top_inner_products(df, asks, block_rows=50).collect()]
    assert sorted(got) == [r for r in brute_topk(rows, 10) if r[0] == 700]


def test_pipeline(spark):
    out = __spark_entry__.queries()["pipeline"](spark, SF)
    rows = out.collect()
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and rows
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in rows}
    assert kept <= {r.doc_id for r in docs.select("doc_id").collect()}
    dirty = {r.doc_id for r in decontaminate.matches(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert not kept & dirty
    copies = [tuple(r) for r in docs.groupBy("text").agg({"doc_id": "min", "*": "count"}).where("`count(1)` > 1").collect()]
    texts = docs.select("doc_id", "text").collect()
    for text, *_ in copies:
        assert len(kept & {r.doc_id for r in texts if r.text == text}) <= 1
    assert len(corpus_pipeline.STAGES) == 5
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
