import random
import re
from collections import Counter

import pytest

from tierlake.llm import url_rules


def brute(pages, rules, default="allow"):
    best = {}
    for host, path, verdict in rules:
        if None not in (host, path, verdict):
            best[host, path] = max(verdict, best.get((host, path), verdict))
    out = []
    for page, url in pages:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        fit = [(len(h.split(".")), len(h), len(p), h + p, v) for (h, p), v in best.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fit)[3:] if fit else (None, default)
        out.append((page, host, path, rule, verdict))
    return Counter(out)


def got(spark, pages, rules, **more):
    df = spark.createDataFrame(pages, "page_id long, url string").selectExpr("*", "'x' AS row", "'y' AS key", "'z' AS path", "1 AS stack")
    return Counter(tuple(r) for r in url_rules.judge(df, spark.createDataFrame(rules, "host string, path string, verdict string"), **more).collect())


ODD = [
    (1, None),
    (2, ""),
    (3, "no scheme/com/en/"),
    (4, "http://"),
    (5, "HTTP://A.EXAMPLE.Com/EN/7"),
    (6, "x://com"),
    (6, "x://com"),
    (None, "http://com/en/"),
    (7, "http://example.com?/en/"),
    (8, "http://example.com/en/#x"),
    (9, "http://notexample.com/en/71"),
    (10, "http://a..com/en/"),
    (11, "http://com./en/"),
    (12, "http://é.example.com/en/7/é\U0001f600"),
    (13, "http://" + "a." * 500 + "com/en/" + "x" * 20_000),
    (14, "http://x/\ny?z"),
    (15, "a://b://com/en/"),
]
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("example.com", "/en/", "block"),
    ("example.com", "/en/", "allow"),
    ("a.example.com", "", "block"),
    (None, "/", "block"),
    ("com", None, "block"),
    ("net", "/", None),
]


def test_odd_urls(spark):
    assert got(spark, ODD, RULES) == brute(ODD, RULES)
    assert got(spark, ODD, [], default="block") == brute(ODD, [], "block")
    assert not got(spark, [], RULES)


@pytest.mark.parametrize("seed", range(3))
def test_random_rules(spark, seed):
    rng = random.Random(seed)
    host = lambda: ".".join(rng.choice("ab") for _ in range(rng.randint(1, 4)))
    path = lambda: "/" + "".join(rng.choice("xy/") for _ in range(rng.randint(0, 5)))
    rules = [(host(), path() * rng.randint(0, 1), rng.choice(["allow", "block"])) for _ in range(40)]
    pages = [(i, f"http://{host()}{path()}") for i in range(400)]
    assert got(spark, pages, rules, parts=3) == brute(pages, rules)
