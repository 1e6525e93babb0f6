"""URL filters, by DataFrame functions alone: rules for hosts and paths first, then a list of canonical URLs.

The list is tested through a blocked Bloom filter: a URL's hash names one block of 512 bits, held as one row of eight longs, and one
bit in each of them. Rows that the filter passes are joined with the list itself by a hash join on the whole URL, which takes the
false positives out; other rows are never moved.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, table

#: (host, path prefix, verdict); a rule fits its host and all subdomains. Tried one by one on each row, so for a list of hundreds at most.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

#: Query parameters that say where a visitor came from and not what the page is.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|\z)"

#: Marks of pages that were mangled on the way; a page with this many of them puts its URL on the list of op12.
MANGLED, LEAST_MARKS = r"%%%|\*\*\*|###|\$\$\$|&amp;&amp;&amp;", 20

#: Longs of a block, and bits that the filter has for each listed URL: a miss passes about once in a hundred times.
WORDS, BITS_PER_URL = 8, 12
#: Blocks up to which the filter is broadcast (72 bytes each), and bytes of URLs up to which the list is; beyond, rows meet them by a shuffle.
BROADCAST_BLOCKS, BROADCAST_BYTES = 500_000, 32 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ://, null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null and without ://."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ?, # or the end; empty for null and without ://."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_of(url: Column) -> Column:
    """Host, path and query of a URL in one spelling; null for null and without ://.

    Scheme, fragment, default port, trailing dots and a leading www. of the host, index files, trailing slashes and tracking parameters
    go; other parameters stand in order.
    """
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host_of(url), r":(80|443)\z", ""), r"\.+\z", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"/index\.html?\z", "/"), r"/+\z", "")
    asked = F.split(F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1), "&")
    query = F.array_join(F.array_sort(F.filter(asked, lambda x: (x != "") & ~x.rlike(TRACKING))), "&")
    return F.concat(host, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits (ties: the first in order of host, then path), null without one."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, prefix, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r), reverse=True):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(prefix))
        out = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def _bit(url: Column, word: int) -> Column:
    """The one bit that a URL has in a word of its block."""
    at = F.shiftright(F.xxhash64(F.lit(1), url), 6 * word).bitwiseAND(F.lit(63).cast("long")).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), at)


def bloom_filter(urls: DataFrame, blocks: int) -> DataFrame:
    """block, w0 to w7 of the blocks that any of urls (canonical) falls into."""
    return urls.groupBy(_block(F.col("canonical"), blocks).alias("block")).agg(*(F.bit_or(_bit(F.col("canonical"), w)).alias(f"w{w}") for w in range(WORDS)))


def on_list(rows: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """rows (with a string canonical, and a column `key` that spreads those without one) and listed: whether canonical is one of listed (canonical).

    Null is on no list; null and repeated entries of the list count for nothing. Columns that rows have otherwise stay.
    """
    listed = stored(listed.select("canonical").where("canonical is not null").distinct(), "listed")
    n, size = listed.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("canonical")), F.lit(0))).first()
    blocks = max(1, math.ceil(n * BITS_PER_URL / (64 * WORDS)))
    bloom = bloom_filter(listed, blocks)
    if blocks <= BROADCAST_BLOCKS:
        bloom = F.broadcast(bloom)
    url, other = F.col("canonical"), F.struct(*rows.columns).alias("row")
    probed = rows.select(other, "canonical", F.coalesce(_block(url, blocks), -1 - F.pmod(F.xxhash64(key), F.lit(1024))).alias("block")).join(bloom, "block", "left")
    maybe = F.lit(True)
    for w in range(WORDS):
        maybe = maybe & (F.col(f"w{w}").bitwiseAND(_bit(url, w)) != 0)
    probed = probed.select("row", "canonical", F.coalesce(maybe, F.lit(False)).alias("maybe"))
    exact = listed.withColumn("listed", F.lit(True))
    if size <= BROADCAST_BYTES:
        exact = F.broadcast(exact)
    hits = probed.where("maybe").join(exact, "canonical", "left").select("row.*", F.coalesce("listed", F.lit(False)).alias("listed"))
    return probed.where(~F.col("maybe")).select("row.*", F.lit(False).alias("listed")).unionByName(hits)


def judge_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, canonical, listed of every row of pages (page_id, url).

    The longest rule that fits says the verdict; without one, a URL whose canonical form is on the list (a table of canonical) is
    blocked, and any other allowed. Null urls and those without :// have an empty host and path and are allowed. Rows stand alone, so
    null and repeated page ids and urls give a row each; other columns are ignored; an empty table or list is fine.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), canonical_of(F.col("url")).alias("canonical"))
    told = on_list(rows, listed, "page_id").withColumn("by_rule", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("by_rule.verdict", F.when(F.col("listed"), "block").otherwise("allow"))
    return told.select("page_id", "host", "path", F.col("by_rule.rule").alias("rule"), verdict.alias("verdict"), "canonical", "listed")


def mangled_urls(pages: DataFrame) -> DataFrame:
    """canonical: URLs of pages whose html has LEAST_MARKS marks of mangled text or more. Null urls and html are on no list."""
    return pages.where(F.regexp_count("html", F.lit(MANGLED)) >= LEAST_MARKS).select(canonical_of(F.col("url")).alias("canonical"))


def op12_bloom_urls(spark, sf_dir):
    """Judge every url of pages; the list has the canonical URLs of the pages that came back mangled. Odd rows as in judge_urls."""
    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages, mangled_urls(pages))


OP12_SQL = r"""
WITH r AS (
  SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), s AS (
  SELECT page_id, html, rest IS NOT NULL AS whole,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
         list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|\z)'))) AS asked
  FROM r
), c AS (
  SELECT *, CASE WHEN whole THEN
    regexp_replace(regexp_replace(regexp_replace(host, ':(80|443)\z', ''), '\.+\z', ''), '^www\.', '')
    || CASE WHEN regexp_replace(regexp_replace(path, '/index\.html?\z', '/'), '/+\z', '') = '' THEN '/' ELSE regexp_replace(regexp_replace(path, '/index\.html?\z', '/'), '/+\z', '') END
    || CASE WHEN len(asked) > 0 THEN '?' || array_to_string(asked, '&') ELSE '' END END AS canonical
  FROM s
), listed AS (
  SELECT DISTINCT canonical FROM c WHERE canonical IS NOT NULL AND len(regexp_extract_all(html, '%%%|\*\*\*|###|\$\$\$|&amp;&amp;&amp;')) >= 20
), j AS (
  SELECT c.*, l.canonical IS NOT NULL AS listed,
         CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
              WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
              WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
              WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
              WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM c LEFT JOIN listed l ON l.canonical = c.canonical
)
SELECT page_id, host, path, rule, canonical, listed,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL OR listed THEN 'block' ELSE 'allow' END AS verdict
FROM j
"""
