import re

import pytest

from dbpulse.llm.url_filter import RULES, host_and_path, judge_urls, labelled_table, labelled_urls
from pyspark.sql import functions as F

URLS = [None, "", "no scheme", "http://", "://", "http://A.EXAMPLE.NET/en/x", "http://example.net/en", "http://example.net/en/",
        "http://notexample.net/en/1", "http://x.net", "http://x.net/", "http://x.net?y=/", "http://example.com/de/", "ftp://m.Example.com/de/1#z",
        "http://example.com/DE/1", "http://fr.org/fr/é", "http://org/fr/", "http://xorg/fr/", "http://casino-win.example.com/en/4",
        "http://cheap-pills.example.org/en/4", "http://therin.example.com/en/4", "http://a/" + "b" * 50_000, "a://b://c/d", "http://ünï.example/ß",
        "http://h#://x/y", "HTTP://UP.NET/en/"]


def expect(url):
    at = (url or "").find("://")
    rest = url[at + 3:] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    best = None
    for kind, rule in RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (kind, rule)
    return host, path, best


@pytest.fixture(scope="module")
def judged(spark):
    table = spark.createDataFrame([(i, u, "x", 2.0) for i, u in enumerate(URLS)], "page_id long, url string, host string, score double")
    return judge_urls(table)


def test_split_and_rules(judged):
    rows = {r.page_id: r for r in judged.collect()}
    assert len(rows) == len(URLS)
    for i, url in enumerate(URLS):
        host, path, best = expect(url)
        r = rows[i]
        assert (r.host, r.path, r.rule) == (host, path, best[1] if best else None), url
        assert r.verdict == (best[0] if best else "block" if r.score >= 0.5 else "allow")
    by_url = {URLS[i]: r for i, r in rows.items()}
    assert by_url["http://casino-win.example.com/en/4"].verdict == "block"
    assert by_url["http://cheap-pills.example.org/en/4"].verdict == "block"
    assert by_url["http://therin.example.com/en/4"].verdict == "allow"


def test_native_plan(judged):
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_model_fits_its_table_and_names_it_has_not_seen(spark):
    seen = labelled_table(spark).select(F.monotonically_increasing_id().alias("page_id"), "url")
    verdict = {r.page_id: r.score for r in judge_urls(seen, rules=()).collect()}
    truth = {r.page_id: y for r, (_, y) in zip(seen.collect(), labelled_urls())}
    assert sum((verdict[i] >= 0.5) == bool(y) for i, y in truth.items()) / len(truth) > 0.97
    fresh = [("http://casino-bets.example.com/en/1", 1), ("http://spam-pills.example.com/en/1", 1), ("http://ads-click.example.org/en/9", 1),
             ("http://science-journal.example.com/en/1", 0), ("http://therblog.example.org/fr/3", 0), ("http://historytravel.example.com/en/2", 0)]
    table = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(fresh)], "page_id long, url string")
    score = {r.page_id: r.score for r in judge_urls(table, rules=()).collect()}
    assert all((score[i] >= 0.5) == bool(y) for i, (_, y) in enumerate(fresh)), score


def test_no_pages_and_no_labels(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert judge_urls(empty).count() == 0
    none = spark.createDataFrame([], "url string, label int")
    rows = judge_urls(spark.createDataFrame([(1, "http://x/")], "page_id long, url string"), labelled=none).collect()
    assert rows[0].score == 0.5


def test_host_and_path_are_columns(spark):
    host, path = host_and_path(F.lit("http://A.b/c?d"))
    assert tuple(spark.range(1).select(host, path).first()) == ("a.b", "/c")
