"""URL rules and vocabulary on hand-made urls and against a regular expression."""

import random
import re

from rentlens.llm import url_vocabulary as U

CASES = {
    "http://a.EXAMPLE.net/en/x?q": ("a.example.net", "/en/x", "example.net/en/", "allow"),
    "http://example.net/EN/x": ("example.net", "/EN/x", "net/", "block"),
    "http://net/": ("net", "/", "net/", "block"),
    "http://net": ("net", "", None, "allow"),
    "http://b.net?x": ("b.net", "", None, "allow"),
    "http://fakeexample.com/de/": ("fakeexample.com", "/de/", None, "allow"),
    "http://w.example.com/de/1#f": ("w.example.com", "/de/1", "example.com/de/", "block"),
    "http://x.org/fr/casino": ("x.org", "/fr/casino", "org/fr/", "allow"),
    "http://x.org/casino": ("x.org", "/casino", None, "block"),
    "http://casinova.org/": ("casinova.org", "/", None, "allow"),
    "http://x.org/free": ("x.org", "/free", None, "allow"),
    "http://x.org/free/FREE-free": ("x.org", "/free/FREE-free", None, "allow"),
    "http://x.org/free?bets": ("x.org", "/free", None, "block"),
    "casino": ("", "", None, "block"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
    "a://b://c/d": ("b:", "//c/d", None, "allow"),
    "http://HOST.É.org/\np#q": ("host.É.org", "/\np", None, "allow"),
    "http://x.org/écasino": ("x.org", "/écasino", None, "block"),
}


def test_cases(spark):
    rows = [(i, u, "h", "r", 5) for i, u in enumerate(CASES)]
    out = U.judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string, verdict string, other int")).collect()
    assert {r.url: (r.host, r.path, r.rule, r.verdict) for r in out} == CASES
    assert U.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_weights():
    rng = random.Random(1)
    parts = [*U.STRICT, *U.SOFT, "-", "/", ".", "a", "9", "é", "X", "%"]
    a = U.automaton(U.STRICT, U.SOFT)
    for _ in range(3000):
        u = "".join(rng.choices(parts, k=rng.randint(0, 7)))
        has = lambda t: re.search(f"(?<![a-z0-9]){t}(?![a-z0-9])", u.lower().replace("É", "é")) is not None
        assert U.weigh(u, a) == 2 * sum(map(has, U.STRICT)) + sum(map(has, U.SOFT)), u
    assert U.weigh("casino " * 100_000, a) == 2
