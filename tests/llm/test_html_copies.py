"""What counts as a template: pages that differ, shells inside articles, against a brute-force count."""

import time
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

from quadlake.llm import html_text
from quadlake.llm.html_text import Page

SF = "/root/testdata/sf0.001"


def texts(spark, rows, **options):
    return {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), **options).collect()}


def test_copies_of_a_page_are_no_template(spark):
    article = "<html><body><article><h1>Title</h1><p>Same words on every copy.</p></article></body></html>"
    rows = [(i, f"http://one.example/{i}", article) for i in range(6)]
    rows += [(10 + i, f"http://two.example/{i}", f"<div><p>text {i % 6}</p></div><div>Shared line</div>") for i in range(12)]
    rows += [(30 + i, f"http://three.example/{i}", f"<div>menu {i}</div>{article}") for i in range(8)]  # the pages differ, the article does not
    out = texts(spark, rows)
    assert {out[i] for i in (*range(6), *range(30, 38))} == {"Title\n\nSame words on every copy."}
    assert [out[10 + i] for i in range(12)] == [f"text {i % 6}" for i in range(12)]


def test_shells_inside_articles(spark):
    page = "<article><h2>Summary</h2><p>Story {i} is this.</p><div><a href='/s'>Tell</a> <a href='/t'>friends</a></div></article>"
    rows = [(i, None, page.format(i=i)) for i in range(6)]
    rows += [(20 + i, f"http://a.example/{i}", f"<main><div><h2>Top</h2></div><p>Body {i}</p></main><div>Bottom</div>") for i in range(6)]
    out = texts(spark, rows)
    assert [out[i] for i in range(6)] == [f"Summary\n\nStory {i} is this." for i in range(6)]
    assert [out[20 + i] for i in range(6)] == [f"Top\n\nBody {i}" for i in range(6)]


@pytest.mark.parametrize("unmarked", [False, True])
def test_counts_against_brute_force(spark, unmarked):
    """The given pages, as they are and without the tags and names that mark their parts."""
    rows = []
    for r in pq.read_table(f"{SF}/pages.parquet").to_pylist():
        source = r["html"] or ""
        if unmarked:
            for name in ("article", "nav", "footer"):
                source = source.replace(f"<{name}", "<div").replace(f"</{name}", "</div")
            source = source.replace('class="ad"', 'class="x"') + "<div>All pages say this</div>"
        rows.append((r["page_id"], f"http://h{r['page_id'] % 3}.example/", source))
    count, total, seen = defaultdict(Counter), Counter(), {}
    for _, url, source in rows:
        page = Page(source)
        digests = sorted({d for d, _, _ in page.subtrees})
        key = (url, page.key())
        seen[key] = min(seen.get(key, digests), digests)
    for (url, _), digests in seen.items():
        total[url] += 1
        count[url].update(digests)
    template = {u: {d for d, n in c.items() if n >= 5 and n >= total[u] / 2} for u, c in count.items()}
    out = texts(spark, rows)
    assert out == {i: Page(source).text(template[url]) for i, url, source in rows}
    said = sum("All pages say this" in t for t in out.values())
    assert said == 0 and (not unmarked or all(template.values()))


def test_time_is_in_proportion():
    """Deep nesting, unclosed quotes and a text of a million characters."""
    for source in ("<div>x" * 40_000, "<a href=\"x>y" * 40_000, "<b><p>x" * 40_000, "<p>" + "long text " * 100_000, "<i>" * 40_000 + "</b>" * 40_000, "<li>a</ul>" * 40_000):
        began = time.perf_counter()
        assert isinstance(Page(source).text(), str)
        assert time.perf_counter() - began < 10
    assert Page("<p>a</p><a href=\"x>b</a><p>c</p>").text() == "a\n\nb\n\nc"
