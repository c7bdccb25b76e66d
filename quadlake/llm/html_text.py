"""Main text of HTML pages, with site templates removed.

1. A light parser (no library) reads a page into elements and text blocks; end tags that HTML implies are
   supplied. Every element subtree with text gets a hash of its tags, its text and the hashes inside it.
2. Spark counts on how many pages of a host each subtree recurs. Pages with the same main part count as one, so that
   copies of an article are no template. Rows are pre-aggregated in the task, so a host that holds a third of all pages is
   a few rows per task. Subtrees on at least `min_pages` pages and `min_share` of the host's pages are its template. A host
   has at most (subtrees per page / min_share) of them, so the list that a page needs is short.
3. The second reading drops template subtrees, elements that are never main text (menus, headers, footers,
   sidebars, notices, adverts, forms, scripts, styles, reader comments) and, where a page marks its
   article or main part, everything outside it. A subtree that holds the marked part is never dropped, and one inside
   it only if it has links or controls: a heading that every article has stays.

Blocks are the runs of text between block-level tags; their white space is collapsed and character references are
decoded. Nothing is capped. Reading takes time in proportion to a page, however deep its elements are nested; after a
quote that nothing closes, quotes in tags count as plain characters.

Edge cases: null or empty html and pages without main text give the empty string; a null URL or one without
``://`` belongs to the host ''; unclosed, crossed or truncated tags are repaired as far as the nesting allows; very long
pages are read whole; repeated rows are extracted one by one, and equal pages of a host count as one; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_hexdigest

from quadlake.llm._common import Scratch, arrow_rows, small, table
from quadlake.llm.url_filter import host_of

MIN_PAGES, MIN_SHARE = 5, 0.5
#: Template lists of up to this many hosts and subtrees together are broadcast; longer tables are joined by a shuffle.
BROADCAST_ITEMS = 1 << 20

ASIDE = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>", re.S)
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: The rest of a tag: with quoted values, and where a quote is never closed.
REST, LAX_REST = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"), re.compile(r"([^>]*+)>")
TEXT = re.compile(r"[^<]+|<")
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
TRUNCATED = re.compile(r"<[a-zA-Z/!?][^<>]*\Z")
#: Element names of HTML by role.
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
INLINE = frozenset(("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"))
NEVER = frozenset(("nav", "header", "footer", "aside", "form", "button", "select", "option", "input", "svg", "canvas", "object", "audio", "video", "menu", "dialog", "head", "fieldset", "map", "datalist", "legend")) | RAW
LINKS = frozenset(("a", "button", "input", "select", "option", "form"))
#: An element of the key closes open elements of the value, up to the nearest scope.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "tbody", "thead"}, "tfoot": {"tr", "td", "th", "tbody", "thead"}, "body": {"head"}}
SCOPE = frozenset(("ul", "ol", "dl", "table", "div", "section", "article", "main", "body", "html", "nav", "aside", "header", "footer", "form", "blockquote", "td", "th", "select"))
ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu", "menubar", "form", "toolbar", "status"))
#: Words of class and id attributes that name what surrounds an article.
AROUND = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot banner sponsor sponsored promo promoted promotion "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager sidebar aside widget widgets "
    "footer header masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay paywall "
    "comment comments commentlist discussion disqus respond reply replies social share sharing sharebar related recommended "
    "newsletter subscribe subscription signup login search searchbox copyright legal disclaimer skip".split()
)
NAME_PARTS = re.compile(r"[^a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Element:
    __slots__ = ("tag", "start", "drop", "main", "parts", "links", "mains", "inside")

    def __init__(self, tag: str, start: int, drop: bool, main: bool, parts: list[str], links: int, mains: int, inside: bool):
        self.tag, self.start, self.drop, self.main, self.parts, self.links, self.mains, self.inside = tag, start, drop, main, parts, links, mains, inside


def _marks(tag: str, attributes: str, inside_article: bool) -> tuple[bool, bool]:
    """(never main text, marked as the main part)."""
    drop, main = tag in NEVER, tag in ("article", "main")
    if attributes:
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m.group(1).lower(), (m.group(2) or "").strip("\"'")
            if name in ("class", "id"):
                words = set(NAME_PARTS.split(CAMEL.sub("-", value).lower()))
                drop = drop or (not words.isdisjoint(AROUND) and tag not in ("body", "html", "main"))
            elif name == "role":
                drop = drop or value.lower() in ROLES
                main = main or value.lower() in ("main", "article")
            elif name == "itemprop":
                main = main or value.lower() == "articlebody"
                drop = drop or value.lower() == "comment"
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                drop = drop or name == "hidden"
            elif name == "style" and "display:none" in value.replace(" ", "").lower():
                drop = True
    return drop, main and not drop


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


class Page:
    """Blocks and subtrees of one page."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, bool, bool]] = []  # text, never main text, inside a marked main part
        self.subtrees: list[tuple[int, int, int]] = []  # hash, first block, end block, of what may be a template
        self._open: list[Element] = []
        self._count: Counter = Counter()  # open elements by tag
        self._text: list[str] = []
        self._root: list[str] = []
        self._drops = self._mains = 0
        self._links = self._marked = 0  # links and marked main parts so far
        self._lax = False
        self._read(source)

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            self._text.clear()
            if text:
                self.blocks.append((text, self._drops > 0, self._mains > 0))
                (self._open[-1].parts if self._open else self._root).append("=" + xxh64_hexdigest(text))

    def _enter(self, tag: str, attributes: str) -> None:
        drop, main = _marks(tag, attributes, self._mains > 0)
        if tag == "header" and drop and self._mains and not self._drops:
            drop = False  # an article's own headline; its other parts are marked by name
        if tag not in INLINE:
            self._flush()
        parts = [tag]
        if tag in INLINE:  # an inline element writes to the block it is in
            parts = self._open[-1].parts if self._open else self._root
        self._open.append(Element(tag, len(self.blocks), drop, main, parts, self._links, self._marked, self._mains > 0))
        self._count[tag] += 1
        self._links += tag in LINKS
        self._marked += main
        self._drops += drop
        self._mains += main

    def _leave(self) -> None:
        element = self._open.pop()
        self._count[element.tag] -= 1
        if element.tag not in INLINE or element.drop:
            self._open.append(element)
            self._flush()
            self._open.pop()
        self._drops -= element.drop
        self._mains -= element.main
        if element.tag not in INLINE and len(self.blocks) > element.start:
            digest = xxh64_hexdigest("\x00".join(element.parts), 7)
            shell = not element.inside or self._links > element.links
            if not element.drop and shell and self._marked == element.mains:
                self.subtrees.append((_signed(int(digest, 16)), element.start, len(self.blocks)))
            (self._open[-1].parts if self._open else self._root).append(digest)

    def _close_until(self, names, scope) -> None:
        if not any(self._count[n] for n in names):
            return
        for i in range(len(self._open) - 1, -1, -1):
            tag = self._open[i].tag
            if tag in names:
                while len(self._open) > i:
                    self._leave()
                return
            if tag in scope:
                return

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        cut = TRUNCATED.search(source, max(0, source.rfind("<")))
        end = cut.start() if cut else size
        while at < end:
            if source[at] != "<":
                m = TEXT.match(source, at, end)
                at, text = m.end(), m.group()
                self._text.append(html_lib.unescape(text) if "&" in text else text)
                continue
            m = NAME.match(source, at, end)
            if m is None:
                m = ASIDE.match(source, at, end)
                if m is None:
                    self._text.append("<")
                at = at + 1 if m is None else m.end()
                continue
            rest = None if self._lax else REST.match(source, m.end(), end)
            if rest is None:
                self._lax = True
                rest = LAX_REST.match(source, m.end(), end)
                if rest is None:
                    at += 1
                    continue
            at, tag, attributes = rest.end(), m.group(2).lower(), rest.group(1)
            if m.group(1):
                if tag == "p" and not self._count["p"]:
                    self._flush()
                elif tag in VOID:
                    self._text.append(" ")
                else:
                    self._end(tag)
                continue
            if tag in VOID:
                if tag in INLINE:
                    self._text.append(" " if tag in ("br", "wbr", "img") and tag != "wbr" else "")
                elif tag == "hr":
                    self._close_until(("p",), SCOPE)
                    self._flush()
                continue
            if tag not in INLINE:
                self._close_until(("p",), SCOPE)
            if tag in CLOSES:
                self._close_until(CLOSES[tag], SCOPE - CLOSES[tag])
            self._enter(tag, attributes)
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}\s*/?>", re.I).search(source, at)
                at = close.end() if close else end
                self._leave()
            elif attributes.endswith("/") and tag in ("svg", "path", "object", "iframe"):
                self._leave()
        while self._open:
            self._leave()
        self._flush()

    def _end(self, tag: str) -> None:
        if not self._count[tag]:
            return
        for i in range(len(self._open) - 1, -1, -1):
            if self._open[i].tag == tag:
                while len(self._open) > i:
                    self._leave()
                return
            if tag in INLINE and self._open[i].tag in SCOPE:
                return

    def main(self) -> list[int]:
        """The blocks of the main part, templates aside."""
        kept = [i for i, (_, drop, _) in enumerate(self.blocks) if not drop]
        return [i for i in kept if self.blocks[i][2]] or kept

    def key(self) -> int:
        """A hash of the main part, which tells the pages of a host apart."""
        return _signed(int(xxh64_hexdigest("\x00".join(self.blocks[i][0] for i in self.main())), 16))

    def text(self, template: frozenset | set = frozenset()) -> str:
        """The main text: blocks that nothing excludes, in page order."""
        edges = [0] * (len(self.blocks) + 1)
        for digest, first, last in self.subtrees:
            if digest in template:
                edges[first] += 1
                edges[last] -= 1
        depth = list(accumulate(edges))
        kept = [i for i, (_, drop, _) in enumerate(self.blocks) if not drop and not depth[i]]
        marked = [i for i in kept if self.blocks[i][2]]
        return "\n\n".join(self.blocks[i][0] for i in (marked or kept))


def subtree_counts(pages: DataFrame) -> DataFrame:
    """(host, digest, n): pages of the host that hold the subtree; digest null: all pages of the host. Pages with one main part count once."""

    def run(batches):
        import pyarrow as pa

        hosts, keys, lists = [], [], []

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(keys, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], ["host", "page", "digests"])
            for column in (hosts, keys, lists):
                column.clear()
            return batch

        for host, source in arrow_rows(batches, "host", "html"):
            page = Page((source or b"").decode())
            hosts.append(host.decode())
            keys.append(page.key())
            lists.append(sorted({d for d, _, _ in page.subtrees}))
            if len(hosts) >= 5_000:
                yield out()
        yield out()

    read = pages.mapInArrow(run, "host string, page long, digests array<long>")
    # Of pages with one main part the least list counts, so that reruns agree.
    once = read.groupBy("host", "page").agg(F.min("digests").alias("digests"))
    return once.select("host", F.explode(F.concat("digests", F.array(F.lit(None).cast("long")))).alias("digest")).groupBy("host", "digest").agg(F.count(F.lit(1)).alias("n"))


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, digests): subtrees that recur across many pages of the host."""
    scratch = Scratch(pages.sparkSession, "html")
    often = scratch.write(subtree_counts(pages).where(F.col("n") >= min_pages))
    totals = often.where("digest is null").select(F.col("host").alias("site"), F.col("n").alias("pages"))
    found = often.where("digest is not null").join(totals, F.col("host") == F.col("site")).where(F.col("n") >= min_share * F.col("pages"))
    return scratch.write(found.groupBy("host").agg(F.sort_array(F.collect_list("digest")).alias("digests")))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(key, url, text, n_chars) of every page."""
    kind = dict(pages.dtypes)[key]
    narrow = pages.select(F.col(key).alias("id"), F.col(url).cast("string").alias("url"), host_of(F.col(url)).alias("host"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    known = templates(narrow.select("host", "html"), min_pages, min_share).withColumnRenamed("host", "site")
    items = known.agg(F.coalesce(F.sum(F.size("digests") + F.octet_length("site") + 8), F.lit(0)).alias("n")).first()["n"]
    if items <= BROADCAST_ITEMS:
        known = F.broadcast(known)
    joined = narrow.join(known, F.col("host") == F.col("site"), "left").select("id", "url", "html", "digests")

    def run(batches):
        import pyarrow as pa

        for batch in small(batches):
            texts = []
            for source, digests in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                texts.append(Page(source).text(set(digests or ())) if source else "")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [key, "url", "text", "n_chars"])

    return joined.mapInArrow(run, f"`{key}` {kind}, url string, text string, n_chars long")


def op10_html_text(spark, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of all pages."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
