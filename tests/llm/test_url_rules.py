import random

from actorlens.llm import url_rules

RULES = [
    ("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"),
    ("a.example.com", "/", "allow"), ("example.com", "", "block"), ("b", "/x", "block"), ("b", "/xy", "allow"),
]


def by_hand(url, rules, default="allow"):
    url = url or ""
    if "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    tail = rest[end:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] + [len(tail)])]
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0])), default=None)
    return (host, path, best[0] + best[1], best[2]) if best else (host, path, None, default)


def _check(spark, urls, rules, ranges=0):
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)], "page_id bigint, url string, host string, verdict string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    rows = url_rules.judge(pages, table, ranges=ranges).collect()
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}
    assert found == {i: by_hand(u, rules) for i, u in enumerate(urls)}


def test_against_each_rule(spark):
    draw = random.Random(6)
    hosts = ["net", "example.net", "www.Example.NET", "example.com", "a.example.com", "x.a.example.com", "aexample.com",
             "org", "w.org", "b", "c.b", ".net", "a..net", "net.", "example.net:80", "net-x", "nét", ""]
    paths = ["", "/", "/en", "/en/", "/en/x?y=/de/", "/de/", "/fr/a#b", "?/en/", "#/", "/x", "/xy", "/xyz"]
    urls = [f"{draw.choice(['http', 'https', ''])}://{draw.choice(hosts)}{draw.choice(paths)}" for _ in range(500)]
    urls += [None, "", "no scheme", "a://b://net/", "http://net/en/\n/x", "http://example.net/en/" + "y" * 50_000]
    urls += ["https://hot.net/same"] * 300
    for ranges in (0, 1, 40):
        _check(spark, urls, RULES, ranges)
    _check(spark, urls[:40], [])


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string")
    assert url_rules.judge(pages, spark.createDataFrame(RULES, "host string, path string, verdict string")).count() == 0
