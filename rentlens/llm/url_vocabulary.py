"""URL filter: host and path rules, else a weighted vocabulary matched by Aho-Corasick."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from rentlens.llm.shared import LOWER, UPPER, ascii_lower

#: Host, path and verdict of the given rules.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: A strict term weighs as much as the limit, so one is enough; soft terms count once each.
STRICT = ("casino", "porn", "porno", "xxx", "viagra", "cialis", "escort", "jackpot", "spam", "malware", "phishing", "warez", "hentai", "poker", "roulette")
SOFT = ("free", "bet", "bets", "win", "winner", "bonus", "cheap", "pills", "loan", "loans", "adult", "sex", "crack", "torrent", "hack", "slots",
        "lottery", "discount", "ads", "track", "tracker", "tracking", "click", "clicks", "farm", "seo", "promo", "affiliate", "popup", "download")
STRICT_WEIGHT, SOFT_WEIGHT, LIMIT = 2, 1, 2

_FOLD = str.maketrans(UPPER, LOWER)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    pick = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return ascii_lower(pick(1)), pick(2)


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text and its verdict; null where none fits.

    A rule fits its host and all subdomains where the path starts with the rule's. Rules are a short list
    given by the caller, so they are plain conditions, longest first.
    """
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


@lru_cache(maxsize=4)
def automaton(strict: tuple[str, ...], soft: tuple[str, ...], strict_weight: int = STRICT_WEIGHT, soft_weight: int = SOFT_WEIGHT) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for terms, weight in ((soft, soft_weight), (strict, strict_weight)):
        for t in terms:
            a.add_word(t.translate(_FOLD), (len(t), t, weight))
    a.make_automaton()
    return a


def weigh(url: str, a: ahocorasick.Automaton) -> int:
    """Sum of the weights of the distinct terms in the url that stand between boundaries.

    A boundary is the start, the end or any character but ASCII letters and digits.
    """
    u = url.translate(_FOLD)
    word = lambda c: c.isascii() and c.isalnum()
    hits = {}
    for end, (n, term, weight) in a.iter(u):
        start = end - n + 1
        if (start == 0 or not word(u[start - 1])) and (end + 1 == len(u) or not word(u[end + 1])):
            hits[term] = weight
    return sum(hits.values())


def judge_urls(pages: DataFrame, url_col: str = "url", *, rules=RULES, strict=STRICT, soft=SOFT, limit: int = LIMIT) -> DataFrame:
    """The rows with ``host, path, rule, term_weight, verdict`` (allow or block).

    The longest fitting rule decides; without one, a url whose terms weigh ``limit`` or more is blocked: one
    strict term, or several distinct soft ones. Host, path, query and fragment are searched. A null url has an
    empty host and path, weight 0 and is allowed. Input columns of these five names are replaced. An automaton
    of no terms at all cannot be searched; give at least one.
    """
    @pandas_udf("int")
    def weight(urls: Iterator[pd.Series]) -> Iterator[pd.Series]:
        a = automaton(tuple(strict), tuple(soft))
        for u in urls:
            yield u.fillna("").map(lambda x: weigh(x, a)).astype("int32")

    url = F.col(url_col)
    host, path = url_parts(url)
    out = pages.withColumns({"host": host, "path": path, "term_weight": weight(url)})
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    return out.withColumns({"rule": rule, "verdict": F.coalesce(verdict, F.when(F.col("term_weight") >= limit, "block").otherwise("allow"))})
