import random
import re

from gradus.llm import url_rules as u


def brute(url, rules, default="allow"):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if c.isascii() else c for c in m[1]), m[2]) if m else ("", "")
    best = None
    for h, p, v in rules:
        h = (h or "").lower()
        if h and p is not None and v is not None and (host == h or host.endswith("." + h)) and path.startswith(p):
            key = (len(h + p), len(h), v)
            best = max(best, (key, h + p, v)) if best else (key, h + p, v)
    return host, path, best[1] if best else None, best[2] if best else default


RULES = [*u.RULES, ("Example.com", "/en/deep/", "allow"), ("a.b", "", "block"), ("a.b", "/x", "allow"), ("a.b", "/x", "block"), (None, "/", "block"), ("", "/", "block"), ("net", None, "block"), ("é.com", "/", "block")]
HOSTS = ["com", "example.com", "WWW.Example.com", "notexample.com", "a.example.net", "net", "x.a.b", "a.b", "aa.b", "é.com", "sub.é.com", "", "com.", "example.com:80", "a..b"]
PATHS = ["", "/", "/en/", "/en", "/en/deep/x", "/es/1", "/fr/?q=/es/", "/x", "/xy#/z", "?a", "#b", "/日本"]


def frame(spark, urls):
    return spark.createDataFrame([(i, x, "h", "p") for i, x in enumerate(urls)], "page_id long, url string, host string, part string")


def test_against_brute_force(spark):
    rnd = random.Random(5)
    urls = [None, "", "no scheme", "://", "x://", "http://a://b"] + [f"{rnd.choice(['http', 'HTTPS', ''])}://{h}{p}" for h in HOSTS for p in PATHS] * 2
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = u.judge(frame(spark, urls).repartition(3), rules).orderBy("page_id").collect()
    assert [tuple(r)[1:] for r in got] == [brute(x, RULES) for x in urls]


def test_empty_sides(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert [tuple(r) for r in u.judge(frame(spark, ["http://a/b"]), none, default="block").collect()] == [(0, "a", "/b", None, "block")]
    assert u.judge(frame(spark, []), u.production_rules(spark)).collect() == []


def test_equal_urls_and_long_ones(spark):
    """One url may hold most rows: its rows go to several ranges, and each meets all rules of its host."""
    urls = ["http://www.example.com/en/x"] * 3000 + [f"http://h{i}.net/es/{i}" for i in range(300)] + ["http://example.com/en/" + "a" * 200_000, None, "file:///etc"]
    got = u.judge(frame(spark, urls).repartition(6), u.production_rules(spark)).orderBy("page_id").collect()
    assert [tuple(r)[1:] for r in got] == [brute(x, u.RULES) for x in urls]
    again = u.judge(spark.createDataFrame([(1, urls[0])] * 50, "page_id long, url string"), u.production_rules(spark)).collect()
    assert len(again) == 50 and {r.rule for r in again} == {"www.example.com/en/"}
