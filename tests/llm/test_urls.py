"""Url rules against SQL and against a plain check of every rule."""

import duckdb
import pandas as pd

from plotweave.llm import urls

ODD = [
    None, "", "no scheme", "http://", "://x", "http://EXAMPLE.org/es/1", "http://a.example.org/en/12?x", "ftp://org/", "http://org", "http://.org/",
    "http://notexample.org/es/", "http://www.a.COM/de/x#y", "http://com/fr/", "http://x.com?/de/", "http://x.com#/de/", "http://x.com/fr", "a://b://c.org/d",
    "http://example.org./es/", "http://user@example.org/en/1", "http://example.org:80/es/", "http://ÄÖ.org/é", "http://a.com/de/\nx", "http://x.com/" + "de/" * 2000,
]
COLUMNS = "page_id long, url string, html string, host string, path string, rule string, expr string"


def pages(spark, listed):
    return spark.createDataFrame([(i, u, "h", "a", "b", "c", "d") for i, u in listed], COLUMNS)


def test_equals_sql(spark):
    listed = [(i, u) for i, u in enumerate(ODD)] + [(None, ODD[5]), (1, ODD[5]), (1, ODD[5])]
    found = [tuple(r) for r in urls.filter_urls(pages(spark, listed), urls.rule_table(spark, urls.RULES)).collect()]
    con = duckdb.connect()
    frame = pd.DataFrame({"page_id": pd.array([i for i, _ in listed], "Int64"), "url": pd.array([u for _, u in listed], "string")})  # noqa: F841
    con.execute("create view pages as select * from frame")
    want = con.execute("select page_id, host, path, rule, verdict from (" + urls.OP8_SQL + ")").fetchall()
    assert sorted(found, key=str) == sorted(want, key=str)


def test_own_rules_ties_and_empty(spark):
    rules = [("allow", "a.b", "/x"), ("block", "a.b", "/x"), ("allow", "b", "/x/y/z"), ("block", "", "/q"), ("block", "c", "")]
    listed = [(1, "s://a.b/x"), (2, "s://z.a.b/x/y/z1"), (3, "s://b/x"), (4, "s://c"), (5, "s://d.c/k")]
    got = {r.page_id: (r.rule, r.verdict) for r in urls.filter_urls(pages(spark, listed), urls.rule_table(spark, rules), "none").collect()}
    assert got == {1: ("a.b/x", "block"), 2: ("b/x/y/z", "allow"), 3: (None, "none"), 4: ("c", "block"), 5: ("c", "block")}
    assert urls.filter_urls(pages(spark, []), urls.rule_table(spark, rules)).count() == 0
    alone = urls.filter_urls(pages(spark, listed), urls.rule_table(spark, [])).collect()
    assert len(alone) == 5 and all(r.rule is None and r.verdict == "allow" for r in alone)


def test_no_python_in_the_plan(spark):
    plan = urls.filter_urls(pages(spark, [(1, "s://a")]), urls.rule_table(spark, urls.RULES))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
