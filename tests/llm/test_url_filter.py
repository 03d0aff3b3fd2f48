import random

from tablesync.llm import url_filter as u


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    ends = [rest.find(c) for c in "/?#" if c in rest]
    host, tail = (rest[: min(ends)], rest[min(ends) :]) if ends else (rest, "")
    ends = [tail.find(c) for c in "?#" if c in tail]
    path = tail[: min(ends)] if ends else tail
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def run(spark, urls, rules):
    pages = spark.createDataFrame([(i, x, "h", "r") for i, x in enumerate(urls)], "page_id long, url string, host string, rule string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    return {r.page_id: tuple(r)[1:] for r in u.url_verdicts(pages, table).collect()}


ODD = [None, "", "no scheme", "://", "http://", "http://A.Example.NET", "http://a.net/", "https://x.example.net/en/1?a=/b#c", "http://example.com/de/x", "http://net/", "http://net", "x://..net./", "http://.net/", "http://a.org/fr", "http://a.org/fr/", "ftp://u@b.org:80/fr/", "a://b://c.net/", "http://a.net?x/y", "http://a.net#/y", "http://example.com/de/" + "a/" * 3000, "http://" + "a." * 2000 + "net/"]


def test_odd_urls(spark):
    assert run(spark, ODD, u.RULES) == {i: brute(x, u.RULES) for i, x in enumerate(ODD)}


def test_random_rules(spark):
    rng = random.Random(5)
    hosts = ["net", "a.net", "b.a.net", "org", "x.org", "a"]
    paths = ["", "/", "/e", "/en/", "/en/1", "/en/1/", "/e/"]
    rules = list({(rng.choice(hosts), rng.choice(paths)): rng.choice(["allow", "block"]) for _ in range(20)}.items())
    rules = [(h, p, v) for (h, p), v in rules] + [("net", "/", "block"), ("net", "/", "allow")]
    urls = [f"http://{rng.choice(['', 'q.', 'Z.'])}{rng.choice(hosts)}{rng.choice([*paths, '/en/1/2', '/en/12', '/q'])}{rng.choice(['', '?k', '#t'])}" for _ in range(200)]
    assert run(spark, urls, rules) == {i: brute(x, rules) for i, x in enumerate(urls)}


def test_empty_tables(spark):
    assert run(spark, [], u.RULES) == {}
    assert run(spark, ["http://a.net/"], []) == {0: ("a.net", "/", None, "allow")}
