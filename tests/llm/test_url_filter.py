from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.compare import connect, difference
from wayloom.llm.url_filter import ORACLE, Cascade, build_cascade, judge_urls, op2_url_filter


def brute(url, rules, words):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
    path = rest[end:]
    path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for rule in rules:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or (len(rule), len(h)) > (len(best), len(best.split("/")[0]))):
            best = rule
    import re

    bad = bool(set(re.split("[^a-z0-9]+", host)) & set(words))
    return host, path, best, rules[best] if best else "block" if bad else "allow"


URLS = [
    None, "", "nothing", "http://", "http://x.net", "http://x.net/", "HTTP://X.Net/a?b#c", "https://Example.NET/en/1", "https://a.example.net/english",
    "https://badexample.net/en/", "https://example.com/de/", "https://example.com/de", "https://m.example.com/DE/", "ftp://a.org/fr/x", "http://org/fr/",
    "http://casino.shop.com/x", "http://my-casino-win.org/en", "http://casinos.org/", "a://b://c.net/x", "http://x.net?u=http://example.net/en/",
    "http://x.net#f/", "http://ÉX.com/de/é", "http://a..net/q", "http://x.net./q", "http://example.net:80/en/", "x\ny://h.org/fr/\nz", "http://" + "a." * 300 + "net/" + "p" * 5000,
]


def test_against_brute_force(spark):
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow", "h.org/fr": "block"}
    pages = spark.createDataFrame([(i % 7, u, "x", "y") for i, u in enumerate(URLS + URLS)], "page_id long, url string, rule string, key string")
    found = judge_urls(pages, rules=rules)
    assert found.columns == ["page_id", "url", "key", "host", "path", "rule", "verdict"]
    rows = Counter((r.page_id, r.url, r.host, r.path, r.rule, r.verdict) for r in found.collect())
    words = ("casino",)
    assert rows == Counter((i % 7, u, *brute(u, rules, words)) for i, u in enumerate(URLS + URLS))
    assert judge_urls(pages.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [2.0, 8.0])
def test_cascade_is_exact(spark, bits):
    universe = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = spark.range(0, 6000, 17).select(F.concat(F.lit("k"), "id").alias("key")).union(spark.createDataFrame([(None,), ("k0",)], "key string"))
    cascade = build_cascade(universe, listed, bits_per_key=bits)
    assert len(cascade.levels) > 1
    wrong = universe.filter(cascade.holds(F.col("key")) != (F.substring("key", 2, 9).cast("int") % 17 == 0))
    assert wrong.isEmpty()
    with pytest.raises(ValueError):
        build_cascade(universe, listed, max_bits=128)


def test_empty_list(spark):
    universe = spark.createDataFrame([("a",)], "key string")
    assert build_cascade(universe, universe.limit(0)) == Cascade(())
    assert universe.filter(Cascade(()).holds(F.col("key"))).isEmpty()


def test_query_equals_sql(spark, sf_dir):
    assert difference(op2_url_filter(spark, sf_dir), connect(sf_dir), ORACLE) is None
