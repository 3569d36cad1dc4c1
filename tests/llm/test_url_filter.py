"""URL rules against a plain loop over all rules."""

import random
import re

import pytest

from newsmood.llm import url_filter
from newsmood.llm.queries import URL_RULES

SCHEMA = "page_id long, url string, html string, host string, path string, row string, key string, best string, rule string"


def plain(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = []
    for rule, action in rules:
        if rule is None:
            continue
        at = rule.find("/")
        rule_host, rule_path = (rule, "") if at < 0 else (rule[:at], rule[at:])
        rule_host = rule_host.lower()
        if rule_host and host and ("." + host).endswith("." + rule_host) and path.startswith(rule_path):
            fits.append((len(rule), rule_host.count("."), action == "block", rule_host + rule_path))
    best = max(fits, default=None)
    return host, path, best and best[3], "block" if best and best[2] else "allow"


def check(spark, pages, rules, **sizes):
    df = spark.createDataFrame([(i, u, *["x"] * 7) for i, u in pages], SCHEMA)
    got = url_filter.verdicts(df, spark.createDataFrame(rules, "rule string, action string"), **sizes)
    want = [(i, *plain(u, rules)) for i, u in pages]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


ODD = [
    None, "", "example.net/en/", "http://", "https:///en/x", "http://EXAMPLE.net/en/Page?x=/de/", "http://a.example.net/en", "http://a.b.example.net/en/#f", "http://badexample.net/en/",
    "http://net/", "http://net", "http://x.net?/", "http://example.com/de/", "http://example.com/DE/", "http://www.org/fr/://net/", "ftp://É.Org/fr/é", "http://.net/", "http://net./", "http://x.net:80/",
    "http://u@a.net/", "http://a.net/\n/en/", "http://example.net/en/" + "y" * 20_000, "http://" + "a." * 500 + "net/", "http://example.net/en/", "http://example.net/en/",
]


def test_fixed_rules_on_odd_urls(spark):
    pages = list(enumerate(ODD, 1)) + [(None, "http://a.net/"), (1, "http://a.net/"), (None, None)]
    check(spark, pages, URL_RULES)
    check(spark, [], URL_RULES)
    check(spark, pages, [])
    check(spark, pages, [(None, "block"), ("/en/", "block"), ("", "allow"), ("net", "block"), ("Example.NET/e", "allow"), ("net", "block")])


@pytest.mark.parametrize("max_words", [1 << 20, 4])
def test_many_rules(spark, max_words):
    """Also with filters so short that the list is split into parts."""
    rng = random.Random(12)
    hosts = [f"h{i}.{rng.choice(['net', 'org', 'example.com'])}" for i in range(400)]
    url = lambda: f"http://{rng.choice(['', 'www.', 'a.b.'])}{rng.choice(hosts)}/{rng.choice(['', 'en/', 'de/x/'])}{rng.randint(0, 3)}"
    rules = {f"{h}{rng.choice(['', '/', '/en/', '/de/x/'])}": rng.choice(["allow", "block"]) for h in rng.sample(hosts, 250)}
    check(spark, [(i, url()) for i in range(3000)], [*rules.items(), ("net/", "block"), ("example.com/de/", "allow")], max_words=max_words)


def test_levels_alternate_until_exact(spark):
    listed = spark.createDataFrame([(f"k{i}",) for i in range(300)], "key string")
    universe = spark.range(20_000).selectExpr("concat('k', id) AS key")
    built = url_filter.cascade(listed, universe, 20_000)
    assert len(built.levels) > 2
    from pyspark.sql import functions as F

    inside = universe.where(built.lists(F.col("key")))
    assert {r["key"] for r in inside.collect()} == {f"k{i}" for i in range(300)}
    # Level 1 passes fewer unlisted keys than there are listed ones, so later levels stay small.
    assert sum(level.bits for level in built.levels[1:]) < built.levels[0].bits


def test_no_join_and_no_python(spark):
    df = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    plan = url_filter.verdicts(df, spark.createDataFrame(URL_RULES, "rule string, action string"))._jdf.queryExecution().toString()
    assert "Join" not in plan and "Python" not in plan and "Arrow" not in plan
