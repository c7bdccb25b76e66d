"""URL verdicts: host and path rules first, then a list of canonical URLs.

A URL that no rule fits is looked up in the list. A register-blocked Bloom filter (one 64-bit block
per URL, four bits each) of the listed canonical URLs is aggregated with bit_or and broadcast. It has
a block for every listed URL, so about one unlisted URL in a thousand passes, up to MAX_BLOCKS, which bounds the
broadcast; with a longer list more pass. URLs that pass it are possible hits and go to an exact hash join with the
list, which removes false positives; all others never leave their partition. A URL that holds a third of all rows is one skewed key of a plain
left join, which the adaptive planner splits.

Everything is DataFrame expressions.

Edge cases: a null URL or one without ``://`` has empty host and path, and its canonical form is
empty, which is never listed: such a page is allowed. Very long URLs are judged whole, in
time in proportion to their length: the patterns never go back. Repeated rows are judged one by one; an empty
list allows whatever no rule blocks; an empty table gives an empty result; extra columns pass through
``judge`` unless they have the names it adds, which it then replaces.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadlake.llm._common import Scratch, ascii_lower, table

#: Production rules: host and path prefix, verdict.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Sites whose pages make up the production list.
LISTED_SITES = r"(^|\.)(ads-track|casino-win|cheap-pills|free-bets|spam-farm)\.example\.(com|net|org)$"
MIN_BLOCKS, MAX_BLOCKS = 1 << 10, 1 << 21


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^(?>.*?://)([^/?#]*+)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^(?>.*?://)[^/?#]*+([^?#]*+)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Scheme, leading www., default ports, closing slashes, utm_ parameters and fragment removed; host lower-cased."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":(80|443)$", "")
    query = F.coalesce(F.regexp_extract(url, r"(?s)^(?>.*?://)[^?#]*+(\?[^#]*+)", 1), F.lit(""))
    kept = F.regexp_replace(F.regexp_replace(query, r"[?&]utm_[^&]*", ""), r"^&", "?")
    return F.concat(host, F.regexp_replace(path_of(url), r"/+$", ""), kept)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does. Ties go to the earlier rule."""
    found = None
    for rule, verdict in sorted(rules, key=lambda r: -len(r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url, F.lit("block")), F.lit(blocks))


def _mask(url: Column) -> Column:
    h, out = F.xxhash64(url, F.lit("bits")), F.lit(0).cast("long")
    for i in range(4):
        place = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return out


def bloom(listed: DataFrame, column: str, blocks: int) -> DataFrame:
    """(block, word): at most `blocks` rows of 16 bytes."""
    return listed.select(_block(F.col(column), blocks).alias("block"), _mask(F.col(column)).alias("m")).groupBy("block").agg(F.bit_or("m").alias("word"))


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str]] = RULES, url: str = "url", blocks: int | None = None) -> DataFrame:
    """`pages` with host, path, rule, canonical_url, listed and verdict. `listed` has one column of canonical URLs."""
    added = ("host", "path", "rule", "canonical_url", "listed", "verdict")
    kept = [c for c in pages.columns if c.lower() not in added]
    names = listed.columns[0]
    canon = listed.select(F.col(names).alias("listed_url")).where(F.col("listed_url").isNotNull() & (F.col("listed_url") != "")).distinct()
    canon = Scratch(pages.sparkSession, "url-list").write(canon)
    if blocks is None:
        blocks = min(MAX_BLOCKS, max(MIN_BLOCKS, 1 << canon.count().bit_length()))
    # The caller's columns travel in one struct, so that no name can clash with the ones used here.
    row = F.struct(*[F.col(f"`{c}`") for c in kept], F.lit(1).alias("_")).alias("row")
    parsed = pages.select(row, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), canonical(F.col(url)).alias("canonical_url"))
    ruled = parsed.withColumn("found", rule_for(F.col("host"), F.col("path"), rules))
    filter_ = F.broadcast(bloom(canon, "listed_url", blocks))
    tried = ruled.withColumn("at", _block(F.col("canonical_url"), blocks)).withColumn("mask", _mask(F.col("canonical_url"))).join(filter_, F.col("at") == F.col("block"), "left")
    tried = tried.withColumn("maybe", F.col("found").isNull() & F.coalesce(F.col("word").bitwiseAND(F.col("mask")) == F.col("mask"), F.lit(False)))
    shape = ["row", "host", "path", F.col("found.rule").alias("rule"), "canonical_url"]
    missed = tried.where(~F.col("maybe")).select(*shape, F.when(F.col("found").isNull(), F.lit(False)).alias("listed"), F.coalesce("found.verdict", F.lit("allow")).alias("verdict"))
    exact = tried.where("maybe").select(*shape).join(canon.hint("shuffle_hash"), F.col("canonical_url") == F.col("listed_url"), "left").withColumn("listed", F.col("listed_url").isNotNull())
    exact = exact.select("row", "host", "path", "rule", "canonical_url", "listed", F.when(F.col("listed"), "block").otherwise("allow").alias("verdict"))
    return missed.unionByName(exact).select(*[F.col("row")[c].alias(c) for c in kept], "host", "path", "rule", "canonical_url", "listed", "verdict")


def listed_urls(pages: DataFrame, sites: str = LISTED_SITES) -> DataFrame:
    """The production list: canonical URLs of the pages on known abusive sites."""
    return pages.where(host_of(F.col("url")).rlike(sites)).select(canonical(F.col("url")).alias("listed_url"))


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of all pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, listed_urls(pages)).select("page_id", "host", "path", "rule", "verdict", "canonical_url")


_HOST = r"translate(coalesce(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"coalesce(regexp_extract({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
_QUERY = r"regexp_replace(regexp_replace(coalesce(regexp_extract({u}, '(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)', 1), ''), '[?&]utm_[^&]*', '', 'g'), '^&', '?')"
OP1_SQL = (
    f"""
WITH parsed AS (
  SELECT page_id, {_HOST.format(u="url")} AS host, {_PATH.format(u="url")} AS path, {_QUERY.format(u="url")} AS query FROM pages
), named AS (
  SELECT page_id, host, path,
         regexp_replace(regexp_replace(host, '^www\\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '') || query AS canonical_url
  FROM parsed
), listed AS (
  SELECT DISTINCT canonical_url FROM named
  WHERE canonical_url <> '' AND regexp_matches(host, '(^|\\.)(ads-track|casino-win|cheap-pills|free-bets|spam-farm)\\.example\\.(com|net|org)$')
)
SELECT page_id, host, path,
       CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
            WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
            WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
            WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
       CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'allow'
            WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'block'
            WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'allow'
            WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'block'
            WHEN canonical_url IN (SELECT canonical_url FROM listed) THEN 'block' ELSE 'allow' END AS verdict,
       canonical_url
FROM named"""
)
