"""URL filters: rules first, else logistic regression on hashed character
n-grams of host and path.

All work on the pages is column expressions: the URL is split, its n-grams
are hashed into BUCKETS features, and the score sums the features' weights,
which stand in the plan as one constant. The weights come from a small
labelled table of URLs (at most LABELLED rows are read): its features are
made by the same expressions, and the few rows are fitted by gradient descent.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased; path: then up to ``?``, ``#`` or the end. A rule ``host/path``
fits its host and all subdomains if the URL's path starts with the rule's;
the longest rule that fits wins, of equally long ones a blocking one.

Defined cases: a null URL, or one without ``://``: host and path empty, no
rule fits, the model decides from the bias alone; URLs of any length are read
whole; repeated rows are judged alike; an empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dbpulse.llm.common import pick

BUCKETS = 1 << 15
LENGTHS = (3, 4, 5)
LABELLED = 10_000   # rows of the labelled table that are read at most
CUTOFF = 0.5

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

_UNWANTED = ("casino-win", "best-casino", "royal-casino", "casino-slots", "free-bets", "sport-bets", "bets-online",
             "poker-bets", "cheap-pills", "pills-online", "buy-pills", "diet-pills", "spam-farm", "link-spam",
             "spam-links", "mail-spam", "ads-track", "ads-serve", "click-track", "pop-ads", "adult-x", "adult-cams",
             "x-adult", "adult-video", "win-prize", "free-prize", "payday-loans", "replica-bags", "warez-farm",
             "casinowin", "freebets", "spamfarm", "cheappills", "adultcams", "adstrack", "slotscasino", "betspoker")
_WANTED = ("library", "museum", "weather", "recipes", "garden", "history", "science", "travel", "theatre", "river",
           "ththen", "therin", "tionble", "thther", "ononth", "reandin", "esthing", "shwhere", "hereand", "therred",
           "blog", "journal", "school", "council", "archive", "stories", "ththat", "tiontion", "therble", "morning",
           "science-daily", "garden-club", "river-walks", "ththen-blog", "city-library", "history-notes", "the-theatre",
           "school-news", "ththhe", "therre", "therst", "ththea")


def labelled_urls() -> list[tuple[str, int]]:
    """The labelled table: (URL, 1 if unwanted), made from two lists of site names."""
    rows = []
    paired = tuple(f"{a}-{b}" for a, b in zip(_WANTED[::2], _WANTED[1::2]) if "-" not in a + b)
    for label, names in ((1, _UNWANTED), (0, _WANTED + paired)):
        for i, name in enumerate(names):
            host = f"{('', 'www.', 'm.', 'blog.')[i % 4]}{name}.example.{('com', 'org', 'net')[i % 3]}"
            path = (f"/en/{i * 37 % 900}", f"/{('fr', 'de', 'es')[i % 3]}/{i * 53 % 700}.html", f"/{i}/", "/")[i % 4]
            rows += [(f"https://{host}{path}", label), (f"http://{host}/en/{i * 91 % 800}?page=2", label)]
    return rows


def labelled_table(spark: SparkSession) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(u).alias("url"), F.lit(y).alias("label")) for u, y in labelled_urls()])
    return spark.range(1).select(F.inline(rows))


def host_and_path(url: Column) -> tuple[Column, Column]:
    text = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(text, "(?s)^.*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), F.regexp_extract(text, "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def ngrams(text: Column, kind: str) -> Column:
    """Hashed features of all character runs of the marked text, with repeats."""
    marked = F.concat(F.lit("^"), text, F.lit("$"))
    some = [F.when((F.length(text) > 0) & (F.length(marked) >= n), F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(marked) - (n - 1), F.lit(1))),
        lambda i, n=n: F.pmod(F.xxhash64(F.lit(kind), marked.substr(i, F.lit(n))), F.lit(BUCKETS)).cast("int")))
        .otherwise(F.array().cast("array<int>")) for n in LENGTHS]
    return F.flatten(F.array(*some))


def features(host: Column, path: Column) -> Column:
    return F.array_distinct(F.concat(ngrams(host, "host"), ngrams(path, "path")))


def fit(rows: list[tuple[int, list[int]]], steps: int = 1500, rate: float = 4.0, l2: float = 1e-5) -> np.ndarray:
    """Weights of the features, the bias last, from (label, features) rows."""
    w = np.zeros(BUCKETS + 1)
    if not rows:
        return w
    y = np.array([r[0] for r in rows], float)
    used = sorted({f for _, found in rows for f in found})
    column = {f: i for i, f in enumerate(used)}
    x = np.zeros((len(rows), len(used) + 1))
    for i, (_, found) in enumerate(rows):
        x[i, [column[f] for f in found]] = 1 / np.sqrt(max(len(found), 1))
    x[:, -1] = 1
    v = np.zeros(len(used) + 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ v))
        v -= rate * (x.T @ (p - y) / len(y) + l2 * np.append(v[:-1], 0))
    w[[*used, BUCKETS]] = v
    return w


def fit_urls(labelled: DataFrame) -> np.ndarray:
    """Weights from a table of (url, label), label 1 for unwanted URLs."""
    host, path = host_and_path(F.col("url"))
    rows = (pick(labelled, "url", "label").where("url is not null and label is not null")
            .select(F.col("label").cast("int").alias("label"), features(host, path).alias("f"), F.col("url"))
            .orderBy("url", "label").limit(LABELLED).collect())
    return fit([(r["label"], r["f"]) for r in rows])


def unwanted_score(found: Column, weights: np.ndarray) -> Column:
    """Probability that a URL with these features is unwanted."""
    table = F.split(F.lit(",".join(f"{w:.9g}" for w in weights[:-1])), ",").cast("array<double>")
    total = F.aggregate(found, F.lit(0.0), lambda a, i: a + F.element_at(table, i + 1))
    z = total / F.sqrt(F.greatest(F.size(found), F.lit(1))) + float(weights[-1])
    return 1 / (1 + F.exp(-z))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the rule that decides; nulls where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block")):  # the last to fit decides
        own_host, slash, own_path = text.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(slash + own_path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def judge_urls(pages: DataFrame, labelled: DataFrame | None = None, rules: Sequence[tuple[str, str]] = RULES,
               id_column: str = "page_id", url_column: str = "url", cutoff: float = CUTOFF) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's score of every row."""
    weights = fit_urls(labelled_table(pages.sparkSession) if labelled is None else labelled)
    host, path = host_and_path(F.col("url"))
    split = (pick(pages, id_column, url_column).toDF("page_id", "url")
             .select("page_id", host.alias("host"), path.alias("path")))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    scored = split.withColumn("score", unwanted_score(features(F.col("host"), F.col("path")), weights))
    model = F.when(F.col("score") >= cutoff, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, model).alias("verdict"),
                         "score")
