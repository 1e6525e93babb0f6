"""URL filters against plain Python, with and without broadcasts, and on odd inputs."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemill.llm import url_filter
from tidemill.llm.url_filter import RULES

DDL = "page_id long, url string, html string"


def plain(url):
    """host, path, canonical of a url."""
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    m = re.match(r"([^/?#]*)([^?#]*)(?:\?([^#]*))?", rest)
    host, path, query = re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2], m[3] or ""
    name = re.sub(r"^www\.", "", re.sub(r"\.+\Z", "", re.sub(r":(80|443)\Z", "", host)))
    where = re.sub(r"/+\Z", "", re.sub(r"/index\.html?\Z", "/", path)) or "/"
    asked = sorted((x for x in query.split("&") if x and not re.match(r"(utm_[^=]*|ref|fbclid|gclid)(=|\Z)", x)), key=str.encode)
    return host, path, name + where + ("?" + "&".join(asked) if asked else "")


def judged(rows, listed):
    out = []
    for page_id, url, *_ in rows:
        host, path, canonical = plain(url)
        fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits) if fits else (0, None, "block" if canonical in listed else "allow")
        out.append((page_id, host, path, rule[1], rule[2], canonical, canonical in listed if canonical else False))
    return Counter(out)


ODD = [None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.COM/en/X", "https://com", "https://com/", "x://a.example.com?/en/", "http://example.net/es/?b=2&a=1#f", "http://example.net:443/es/index.html?a=1&&b=2&utm_x=1",
       "http://ÄB.org./fr//", "http://äb.org/fr", "http://notexample.com/en/", "http://a://b/c", "http://example.com/en\n/", "http://h/p\n?q\n#r", "http://www.example.com/en/1", "http://b.www.example.com/en/1", "http://example.com/en"]


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_judges_as_plain_python(spark, monkeypatch, bound):
    monkeypatch.setattr(url_filter, "BROADCAST_BLOCKS", bound)
    monkeypatch.setattr(url_filter, "BROADCAST_BYTES", bound)
    r = random.Random(2)
    make = lambda: f"{r.choice(['http', 'https'])}://{r.choice(['', 'www.', 'm.', 'WWW.'])}{r.choice('abcd')}{r.choice(['.org', '.net', '.example.com', '.org:80'])}/{r.choice(['en', 'es', 'fr'])}/{r.randrange(60)}{r.choice(['', '/', '?ref=x', '?page=2&a=1', '#top', '/index.html'])}"
    urls = ODD + [make() for _ in range(2000)] + ["http://a.org/en/1"] * 1000
    rows = [(i if i % 9 else None, u, "%%%" * (i % 40)) for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, DDL).withColumns({c: F.lit("clash") for c in ("canonical", "listed", "block", "w0", "row", "host")})
    entries = {c for i, u, _ in rows if (c := plain(u)[2]) and zlib.crc32(c.encode()) % 3 == 0} | {"never.seen/x"}
    listed = spark.createDataFrame([(c,) for c in [*entries, None, *entries]], "canonical string")
    assert Counter(map(tuple, url_filter.judge_urls(pages, listed).collect())) == judged(rows, entries)
    marked = {c for _, u, html in rows if html.count("%%%") >= url_filter.LEAST_MARKS and (c := plain(u)[2])}
    assert {x[0] for x in url_filter.mangled_urls(pages).collect()} - {None} == marked


def test_filter_has_every_listed_url_and_few_others(spark):
    n = 4000
    urls = spark.range(3 * n).select(F.concat(F.lit("h/"), "id").alias("canonical"), "id")
    blocks = n * url_filter.BITS_PER_URL // 512
    bloom = url_filter.bloom_filter(urls.where(f"id < {n}"), blocks)
    passed = urls.join(bloom, url_filter._block(F.col("canonical"), blocks) == F.col("block"))
    for w in range(url_filter.WORDS):
        passed = passed.where(F.col(f"w{w}").bitwiseAND(url_filter._bit(F.col("canonical"), w)) != 0)
    hit, missed = passed.where(f"id < {n}").count(), passed.where(f"id >= {n}").count()
    assert hit == n and missed < 0.03 * 2 * n


def test_empty_tables(spark):
    pages, none = spark.createDataFrame([(1, "http://a.org/x", None)], DDL), spark.createDataFrame([], "canonical string")
    assert [r.verdict for r in url_filter.judge_urls(pages, none).collect()] == ["allow"]
    assert url_filter.judge_urls(pages.limit(0), none).count() == 0


def test_only_built_in_functions(spark, tmp_path):
    spark.createDataFrame([(1, "http://a.org/x", "###" * 30)], DDL).write.parquet(f"{tmp_path}/pages.parquet")
    out = url_filter.op12_bloom_urls(spark, str(tmp_path))
    assert [r.verdict for r in out.collect()] == ["block"]
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().toString())
