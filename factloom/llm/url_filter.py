"""URL filters: rules on hosts and paths, and logistic regression on hashed character n-grams where no rule fits.

A URL's host is what stands after its first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; its path
goes on up to ``?``, ``#`` or the end. A rule fits its host and all subdomains of it if the path starts with the rule's;
the longest rule wins (of equal ones, the first by its text). Else the regression over the n-grams of host and path
decides. It is trained on the driver, from a labelled table of a few dozen URLs; their features come from the same
expressions as the scored URLs'. Scoring uses SQL expressions only and needs no shuffle.

Cases: a null URL, or one without ``://``, has an empty host and path, fits no rule and gets the regression's verdict on
no n-grams (its bias). Rows are judged one by one, repeated or not; columns of the output's names are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, ORDERS = 4096, (3, 4)
#: Rules: verdict, host, start of the path.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Labelled URLs: fixed training data.
BLOCKED = """
http://spam-farm.example.com/win  http://spam-farm.example.net/offers/1  http://www.spam-farm.example.org/en/2
http://cheap-pills.example.com/buy  http://www.cheap-pills.example.net/en/3  http://cheap-pills.example.org/order
http://casino-win.example.net/en/41  http://blog.casino-win.example.com/en/6  http://casino-bonus.example.com/slots  http://free-casino.example.net/win-big  http://poker-bonus.example.org/jackpot
http://ads-track.example.com/en/5  http://free-bets.example.net/en/71  http://adult-x.example.com/en/9
http://adult-cams.example.com/live  http://xxx-videos.example.net/hot  http://sexy-cams.example.org/watch
http://malware-host.example.com/download.exe  http://phish-login.example.net/verify-account  http://warez-crack.example.org/keygen
http://click-bait.example.com/you-wont-believe  http://payday-loans.example.net/apply  http://replica-watches.example.com/sale
http://fake-news.example.net/shocking  http://seo-links.example.com/backlinks  http://diet-pills.example.net/lose-weight
http://spam-blog.example.com/spam/1  http://pills-online.example.com/cheap/viagra  http://lottery-winner.example.net/claim
"""
ALLOWED = """
http://news.example.com/en/12  http://www.library.example.net/books/history  http://blog.garden.example.com/en/33.html
http://docs.example.com/guide/start  http://wiki.example.net/page/river  http://www.school.example.org/lessons/4
http://m.weather.example.com/en/today  http://city.example.net/council/minutes  http://museum.example.com/collection/77
http://research.example.net/papers/2019  http://forum.example.com/thread/5521  http://recipes.example.net/bread
http://travel.example.com/fr/alpes  http://sport.example.net/en/results  http://music.example.com/albums/9
http://www.hospital.example.net/contact  http://science.example.com/en/410  http://maps.example.net/region/north
http://www.trees.example.net/en/301.html  http://the.anything.example.com/en/66/  http://blog.others.example.net/es/7  http://theatre.example.com/season  http://blog.river.example.net/en/853  http://m.street.example.com/en/25
http://support.example.net/en/faq  http://jobs.example.com/list?page=2  http://static.example.net/css/site
"""


def host_of(url: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), upper, upper.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=None, verdict: bool = False) -> Column:
    """The longest rule that fits, like ``net/``, or its verdict; null if none does."""
    out = F.lit(None).cast("string")
    for kind, name, start in sorted(RULES if rules is None else rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        out = F.when(fits, F.lit(kind if verdict else name + start)).otherwise(out)
    return out


def features(host: Column, path: Column) -> Column:
    """Buckets of the n-grams of host and path, each with marks at its ends."""

    def bucket(name: str, n: int, value: Column):
        return lambda i: F.pmod(F.xxhash64(F.lit(f"{name}{n}"), F.substring(value, i, F.lit(n))), F.lit(BUCKETS)).cast("int")

    parts = []
    for name, value in (("h", F.concat(F.lit("^"), host, F.lit("$"))), ("p", F.concat(F.lit("^"), path, F.lit("$")))):
        for n in ORDERS:
            last = F.length(value) - (n - 1)
            grams = F.transform(F.sequence(F.lit(1), last), bucket(name, n, value))
            parts.append(F.when(last >= 1, grams).otherwise(F.array().cast("array<int>")))
    return F.concat(*parts)


def train(spark: SparkSession, epochs: int = 60, rate: float = 0.5, l2: float = 1e-4) -> tuple[list[float], float]:
    """(a weight per bucket, the bias), from the labelled URLs; the score of a URL is over its number of n-grams' root."""
    labelled = F.array(*(F.struct(F.lit(u).alias("url"), F.lit(y).alias("y")) for y, text in ((1, BLOCKED), (0, ALLOWED)) for u in text.split()))
    table = spark.range(1).select(F.inline(labelled))
    rows = sorted(((sorted(r.f), r.y) for r in table.select(features(host_of(F.col("url")), path_of(F.col("url"))).alias("f"), "y").collect()))
    w, bias = [0.0] * BUCKETS, 0.0
    for _ in range(epochs):
        for f, y in rows:
            scale = 1 / math.sqrt(max(1, len(f)))
            p = 1 / (1 + math.exp(-(bias + scale * sum(w[k] for k in f))))
            g = rate * (p - y)
            bias -= 0.1 * g
            for k in f:
                w[k] -= g * scale + rate * l2 * w[k]
    return w, bias


def judge(pages: DataFrame, weights: list[float], bias: float, rules=None, url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` and ``score`` (the regression's chance of ``block``)."""
    host, path = host_of(F.col(url)), path_of(F.col(url))
    table = F.split(F.lit(",".join(f"{x:.9g}" for x in weights)), ",").cast("array<double>")  # folds to a constant
    f = features(host, path)
    total = F.aggregate(f, F.lit(0.0), lambda a, k: a + F.element_at(table, k + 1))
    score = 1 / (1 + F.exp(-(F.lit(bias) + total / F.sqrt(F.greatest(F.size(f), F.lit(1))))))
    verdict = F.coalesce(rule_of(host, path, rules, verdict=True), F.when(score >= 0.5, "block").otherwise("allow"))
    new = {"host": host, "path": path, "rule": rule_of(host, path, rules), "verdict": verdict, "score": score}
    return pages.select(*(F.col(f"`{c}`") for c in pages.columns if c not in new), *(v.alias(k) for k, v in new.items()))
