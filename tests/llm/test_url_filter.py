import random

from fablespark.llm import url_filter

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def judge(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        tail = url.split("://", 1)[1]
        cut = min([tail.find(c) for c in "/?#" if c in tail] or [len(tail)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in tail[:cut])
        path = tail[cut:].split("?")[0].split("#")[0]
    fits = [(len(h) + len(p), len(h), p, v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[4] if best else None, best[3] if best else default


URLS = [
    "http://a.example.net/en/x", "https://EXAMPLE.NET/en", "http://example.net/de/", "http://badexample.net/en/", "http://net/", "http://net", "http://x.org/fr/a?b=/en/#c", "http://x.org/fr", "http://example.com/de/?q", "http://sub.example.com#/de/",
    "http://notexample.com/de/", "no scheme example.net/en/", "", None, "://", "http://", "ftp://u:p@example.net:80/en/", "http://example.net./en/", "http://.net/", "http://a..net/", "http://ÄÖ.org/fr/é", "http://a.b://c.net/", "http://x.net/" + "y" * 100_000,
]


def test_against_plain_rules(spark):
    df = spark.createDataFrame([(i, u, "h", "k", 1) for i, u in enumerate(URLS)] + [(0, URLS[0], "h", "k", 1), (None, None, None, None, None)], "page_id long, url string, host string, key string, kind int")
    out = url_filter.filter_urls(df)
    assert out.columns == ["page_id", "url", "key", "kind", "host", "path", "rule", "verdict"]
    rows = out.collect()
    assert len(rows) == len(URLS) + 2
    for r in rows:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == judge(r["url"], RULES), r["url"]
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_deeply_nested_and_random_rules(spark):
    rnd = random.Random(4)
    labels = ["a", "b", "ab", "c-1", "z"]
    name = lambda n: ".".join(rnd.choice(labels) for _ in range(n))
    rules = {(name(rnd.randint(1, 4)), rnd.choice(["/", "/x", "/x/", "/x/y", ""])): rnd.choice(["allow", "block"]) for _ in range(60)}
    rules = [(h, p, v) for (h, p), v in rules.items()]
    urls = [f"http://{name(rnd.randint(1, 5))}{rnd.choice(['', '/', '/x', '/x/y/z', '/q'])}" for _ in range(400)]
    table = spark.createDataFrame(rules + rules[:5] + [(None, "/", "block"), ("a", None, "block")], "host string, path string, verdict string")
    rows = url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), table, "unknown").collect()
    assert len(rows) == 400
    for r in rows:
        host, path, rule, verdict = judge(r["url"], rules, "unknown")
        assert (r["host"], r["path"], r["verdict"]) == (host, path, verdict) and (r["rule"] or "") == (rule or "")


def test_no_rules_gives_the_default(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    rows = url_filter.filter_urls(spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string"), none).collect()
    assert [(r["rule"], r["verdict"]) for r in rows] == [(None, "allow")]


def test_parts_and_more_rules_than_pages(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "PART_ROWS", 7)
    rules = [(f"h{i % 50}.d{i % 7}.net", f"/{i}", "block") for i in range(500)] + RULES
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    urls = [f"http://x.h{i % 60}.d{i % 7}.net/{i}/q" for i in range(90)]
    df = spark.createDataFrame([(i, u, 1, 2, 3, 4) for i, u in enumerate(urls)], "page_id long, url string, _best int, page int, slot0 int, `k.k` int")
    for some in (table, None):
        out = url_filter.filter_urls(df, some)
        assert out.columns == ["page_id", "url", "_best", "page", "slot0", "k.k", "host", "path", "rule", "verdict"]
        for r in out.collect():
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == judge(r["url"], rules if some is not None else RULES) and (r["_best"], r["k.k"]) == (1, 4)


def test_start_events_do_not_carry_enclosing_rules(spark):
    rules = [("net", f"/{i}", "block") for i in range(40)] + [(f"h{i}.net", "/", "allow") for i in range(30)]
    events = url_filter.rule_events(spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert sum(len(e["own"]) for e in events) == len(rules) and {e["level"] for e in events} == {1, 2}


def test_sweep_runs_no_python_and_spreads_a_hot_host(spark):
    df = spark.range(1000).selectExpr("id as page_id", "'http://hot.example.net/en/' || id as url")
    plan = url_filter.filter_urls(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
