import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from modlens.llm import urls as U
from modlens.llm.queries import QUERIES


def brute(url):
    """Host, path and rule of a URL, step by step."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    best = None
    for says, rule in U.RULES:
        name, tail = rule.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail):
            if best is None or len(rule) > len(best[1]):
                best = says, rule
    return host, path, best


HARD = [
    None, "", "no scheme/en/", "://", "http://", "HTTP://WWW.Example.COM/en/x", "http://example.com/en", "http://example.com",
    "http://com/", "http://com", "http://notexample.com/en/", "http://a.net/es/1", "http://a.net/ES/1", "http://net/fr/", "x://y.NET/fr/?a=/b#c",
    "http://a.com?x=/", "http://a.com#/", "http://a.com:80/en/", "a://b.com/c://d.net/es/", "http://É.com/ü", "line\nbreak://a.net/es/\nx",
    "http://" + "a" * 50_000 + ".net/" + "1/" * 20_000,
]


def test_rules_match_brute_force(spark):
    rows = list(enumerate(HARD))
    got = U.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, best = brute(HARD[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, best and best[1])
        assert r.verdict == best[0] if best else r.verdict in ("allow", "block")
        assert (r.block_probability is None) == (best is not None)


def test_features(spark):
    url = "https://a-b.x1.org/en/12/?p=1&q=22#top"
    d = spark.createDataFrame([(1, url), (2, None)], "page_id long, url string")
    host, path = U.host_and_path(F.col("url"))
    a, b = U.with_features(d.withColumns({"host": host, "path": path})).orderBy("page_id").collect()
    n = len(url)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(url).values())
    assert a.suffix == "org" and abs(a.entropy - bits) < 1e-9
    assert (a.depth, a.n_params, a.has_fragment, a.n_labels, a.hyphens, a.longest_label) == (2, 2, 1, 3, 1, 3)
    assert abs(a.digit_ratio - 6 / n) < 1e-12 and b.url_length == 0 and b.entropy == 0


def test_learns_from_the_labelled_urls(spark):
    """Held out: URLs that look like blocked ones (deep, many digits) on hosts that no rule names."""
    rng = random.Random(4)

    def url(bad, host):
        tail = "/".join(str(rng.randrange(10**6)) for _ in range(5)) + "?a=1&b=2" if bad else "news"
        return f"http://{rng.choice('abc')}.{host}/{tail}"

    rules = (("block", "bad.example/"), ("allow", "good.example/"))
    rows = [(i, url(i % 2, "bad.example" if i % 2 else "good.example")) for i in range(400)]
    rows += [(1000 + i, url(i % 2, "other.example")) for i in range(100)]
    got = U.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).where("rule is null").collect()
    assert len(got) == 100 and sum((r.verdict == "block") == bool(r.page_id % 2) for r in got) >= 95


def test_nothing_to_learn_and_edges(spark):
    d = spark.createDataFrame([(1, "http://x.org/"), (1, "http://x.org/"), (None, None)], "page_id long, url string")
    d = d.withColumn("host", F.lit("clash")).withColumn("label", F.lit("clash"))
    got = U.judge_urls(d).collect()
    assert [r.verdict for r in got] == ["allow"] * 3
    only = U.judge_urls(d.unionByName(d.withColumn("url", F.lit("http://q.net/es/"))))
    assert {r.verdict for r in only.collect()} == {"block"}
    assert U.judge_urls(d.limit(0)).collect() == []


def test_query_rules_on_the_pages(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()}
    got = QUERIES["op4_boosted_url_filter"](spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        host, path, best = brute(pages[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, best and best[1])
        assert not best or r.verdict == best[0]
