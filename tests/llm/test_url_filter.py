"""URL filters against a plain reading of the rules."""

from __future__ import annotations

import random

import pytest

from tidemark.llm.queries import URL_RULES
from tidemark.llm.url_filter import filter_urls

PAGES = "page_id long, url string, verdict string"
RULES = "host string, path string, verdict string"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    return host, path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def judged(url, rules):
    host, path = parts(url)
    fits = [
        (len(h + p), len(h), v == "block", h + p, v)
        for h, p, v in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=(0, 0, False, None, "allow"))
    return host, path, best[3], best[4]


def answers(spark, urls, rules):
    pages = spark.createDataFrame([(k, u, "old") for k, u in enumerate(urls)], PAGES)
    rows = filter_urls(pages, spark.createDataFrame(rules, RULES)).collect()
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}


def test_plain_and_odd_urls(spark):
    urls = [
        "http://example.com/en/1",
        "https://WWW.Example.COM/en/x?y#z",
        "http://a.www.example.com/en/",
        "http://b.net/es/",
        "http://b.net/es",
        "http://net/fr/1",
        "http://évil.net/fr/É?q",
        "http://notexample.com/en/",
        "no scheme",
        "",
        None,
        "http://",
        "http:///en/",
        "x://y://z",
        "http://com/",
        "http://.com/a",
        "http://a..net/es/q",
        "http://example.com?x=/en/",
        "http://example.com/en/" + "long/" * 20_000,
        "http://" + "a." * 300 + "net/es/1",
        "http://example.com/en/\nline",
    ]
    found = answers(spark, urls, URL_RULES)
    assert found == {k: judged(u, URL_RULES) for k, u in enumerate(urls)}


def test_any_rules(spark):
    chance = random.Random(3)
    labels, pieces = ["a", "b", "ab", "c"], ["", "/", "/x", "/xy", "/x/", "/x/y", "x"]

    def host():
        return ".".join(chance.choices(labels, k=chance.randint(1, 3)))

    rules = [(host(), chance.choice(pieces), chance.choice(("allow", "block"))) for _ in range(60)]
    urls = [
        f"http://{host()}{chance.choice(pieces[:1] + pieces[1:6])}{chance.choice(pieces)}"
        for _ in range(400)
    ]
    found = answers(spark, urls, rules)
    assert found == {k: judged(u, rules) for k, u in enumerate(urls)}


@pytest.mark.parametrize("rules", [[], [(None, "/", "block"), ("a", None, "block"), ("a", "/", None)]])
def test_rules_with_nulls_or_none(spark, rules):
    found = answers(spark, ["http://a/b", "http://b/"], rules)
    expected = ("a", "block") if rules else (None, "allow")
    assert found[0] == ("a", "/b", *expected)
    assert found[1] == ("b", "/", None, "allow")


def test_no_pages_and_repeats(spark):
    assert answers(spark, [], URL_RULES) == {}
    pages = spark.createDataFrame([(1, "http://b.net/es/", "")] * 3, PAGES)
    rows = filter_urls(pages, spark.createDataFrame(URL_RULES, RULES)).collect()
    assert [r.rule for r in rows] == ["net/es/"] * 3
