from __future__ import annotations

import os
import random

import duckdb
import pytest

from reabasto.llm import queries, url_rules

FOLDER = os.environ.get("REABASTO_TEST_TABLES", "/root/testdata/sf0.001")
URLS = "page_id long, url string, host string, verdict string"
RULES = [*queries.URL_RULES, ("a.com", "/x", "block"), ("com", "/x/y", "allow"), ("b.org", "", "block"), ("org", "/q", "block")]


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [
        (len(h + p), len(h), v == "block", h + p, v)
        for h, p, v in rules
        if host and (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=(0, 0, 0, None, "allow"))
    return host, path, best[3], best[4]


HAND = [
    "http://Example.COM/en/x?q", "https://www.example.com/en/", "http://xexample.com/en/", "ftp://net/es/a#b", "http://a.net/fr", "http://a.net/fr/",
    "no scheme", "", None, "://com/", "http://", "http://com", "http://com?x=/", "a://b://c.com/d", "http://.com/", "http://a..com/", "http://ÄÉ.com/é",
    "http://user@host.com:80/en/", "http://sub.b.org", "http://b.org/q/r", "http://A.com/x/y/z", "x" * 5000 + "://" + "s." * 2000 + "com/" + "p" * 5000,
    "http://a\nb.com/c\nd",
]


@pytest.mark.parametrize("rules", [RULES, [], [("com", "/", "block")]])
def test_against_every_rule(spark, rules):
    random.seed(4)
    part = ["com", "net", "org", "a", "b", "example", "www"]
    made = [f"http://{'.'.join(random.choices(part, k=random.randint(1, 5)))}{random.choice(['', '/', '/x', '/x/y', '/en/', '/es/e', '/q'])}" for _ in range(300)]
    urls = [(i, u, "other", None) for i, u in enumerate(HAND + made)] + [(None, made[0], "o", "o")] * 2
    df = spark.createDataFrame(urls, URLS)
    table = url_rules.rules_frame(spark, rules) if rules else spark.createDataFrame([], "host string, path string, verdict string")
    want = sorted((str(i), *map(str, brute(u, rules))) for i, u, _, _ in urls)
    assert sorted(tuple(map(str, r)) for r in url_rules.judge(df, table).collect()) == want


def test_colliding_short_hashes(spark, monkeypatch):
    monkeypatch.setattr(url_rules, "SHORT", 1)
    urls = [(i, u, None, None) for i, u in enumerate(HAND)]
    made = url_rules.judge(spark.createDataFrame(urls, URLS), url_rules.rules_frame(spark, RULES)).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in made) == sorted(((i, *brute(u, RULES)) for i, u, _, _ in urls), key=lambda x: x[0])


def test_empty_table(spark):
    assert url_rules.judge(spark.createDataFrame([], URLS), url_rules.rules_frame(spark, RULES)).collect() == []


def test_native_plan(spark):
    df = spark.createDataFrame([(1, "http://a.com/", None, None)], URLS)
    plan = url_rules.judge(df, url_rules.rules_frame(spark, RULES))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
def test_sql_answer(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{FOLDER}/pages.parquet'")
    answer = con.execute(queries.oracles()["op7_url_rules"]).fetchall()
    made = queries.op7_url_rules(spark, FOLDER).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(str, answer)) == sorted(str(tuple(r)) for r in made)
