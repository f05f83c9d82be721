import random

import numpy as np
from pyspark.sql import functions as F

from titleworks.llm.queries import URL_RULES
from titleworks.llm.url_rules import Automaton, Rule, judge


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([len(rest)] + [rest.index(c) for c in "/?#" if c in rest])
    host, rest = rest[:cut], rest[cut:]
    path = rest[: min([len(rest)] + [rest.index(c) for c in "?#" if c in rest])]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def fits(rule, host, path):
    want, slash, rest = rule.text.partition("/")
    return (host == want or host.endswith("." + want)) and path.startswith(slash + rest)


def test_rules_against_plain_matching(spark):
    random.seed(4)
    hosts = ["net", "example.net", "EXAMPLE.com", "a.example.com", "xnet", "b.org", "org", "", "é.net", "net.org"]
    tails = ["", "/", "/en/", "/en", "/de/x", "/fr/1?q=/", "?x", "#/en/", "/EN/", "//"]
    urls = [random.choice(["http", "https", "", "a"]) + random.choice(["://", "://", ":/", "://x://"]) + random.choice(hosts) + random.choice(tails) for _ in range(400)]
    urls += [None, "", "://", "http://a.net/" + "p" * 200_000]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, url_rule string").repartition(3)
    got = {r.page_id: r for r in judge(pages, URL_RULES).collect()}
    assert len(got) == len(urls)
    for i, url in enumerate(urls):
        host, path = split(url)
        best = max((r for r in URL_RULES if fits(r, host, path)), key=lambda r: len(r.text), default=None)
        row = got[i]
        assert (row.url_host, row.url_path, row.url_rule, row.url_allowed) == (host, path, best and best.text, best.allow if best else True), url


def test_wildcards_and_more_than_one_word_of_bits():
    rules = [Rule("*ads*.net/", False), Rule("shop.org/*/cart", False), Rule("h?t.org/", False), *[Rule(f"host{i}.com/some/path/{i}/", i % 2 == 0) for i in range(40)]]
    machine = Automaton(rules)
    assert machine.words > 10
    cases = {".x.myads7.net/": "*ads*.net/", ".a.net/ads.net/": None, ".shop.org/a/b/cart": "shop.org/*/cart", ".shop.org/cart": None, ".hot.org/": "h?t.org/",
             ".h/t.org/": None, ".w.host39.com/some/path/39/x": "host39.com/some/path/39/", ".host39.com/some/path/3": None, "": None}
    rows = [c.encode() for c in cases]
    at = np.cumsum([0] + [len(r) for r in rows])
    found = machine.judge(np.frombuffer(b"".join(rows), np.uint8), at)
    assert [machine.rules[k].text if k >= 0 else None for k in found] == list(cases.values())


def test_no_pages(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert judge(empty, URL_RULES).agg(F.count("*")).first()[0] == 0


def test_columns_of_any_name_are_kept(spark):
    pages = spark.createDataFrame([("http://a.net/x", "kept", 1), ("http://b.org/", None, 2)], "url string, _Canonical string, __canonical int")
    got = {r.url: r for r in judge(pages, URL_RULES).collect()}
    row = got["http://a.net/x"]
    assert (row.url_host, row.url_path, row.url_rule, row.url_allowed, row["_Canonical"], row["__canonical"]) == ("a.net", "/x", "net/", False, "kept", 1)
    assert (got["http://b.org/"].url_rule, got["http://b.org/"].url_allowed, got["http://b.org/"]["_Canonical"]) == (None, True, None)
