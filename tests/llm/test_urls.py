import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspan.llm import urls


def both(spark, pages, labels):
    p = spark.createDataFrame(pages, "page_id long, url string, host string")
    o = spark.createDataFrame(labels, "page_id long, bad int")
    got = urls.judge(p, o).collect()
    c = duckdb.connect()
    c.sql("create table pages (page_id bigint, url varchar, host varchar)")
    c.sql("create table labels (doc_id bigint, quality int, toxic int)")
    if pages:
        c.executemany("insert into pages values (?, ?, ?)", pages)
    if labels:
        c.executemany("insert into labels values (?, ?, 0)", [(i, None if b is None else 1 - b) for i, b in labels if b is not None])
    return sorted((tuple(r) for r in got), key=repr), sorted(c.sql(urls.ORACLE_SQL).fetchall(), key=repr)


def test_like_sql(spark):
    pages = [
        (1, "http://A.Example.COM/en/7x?q#f", "clash"),
        (2, "https://x.example.net/de/8/1", ""),
        (3, "https://net/de/", ""),
        (4, "ftp://wikinet/de/", ""),
        (5, "http://a.org/es/#x", ""),
        (6, "no scheme", ""),
        (7, None, ""),
        (8, "://", ""),
        (9, "http://b.org/en/es/", ""),
        (10, "http://com/en/7", ""),
        (None, "http://bad.example.org/x", ""),
        (1, "http://A.Example.COM/en/7x?q#f", ""),
        (11, "javascript:x\nhttp://q.com://z/", ""),
        (12, "http://..com/a", ""),
        (13, "HTTP://Ünï.COM/en/\n", ""),
        (14, "x://http://y.com/en/1", ""),
    ]
    pages += [(100 + i, f"http://{'bad' if i % 2 else 'good'}.site.net/p{i}", "") for i in range(200)]
    labels = [(100 + i, int(i % 2 == 1)) for i in range(0, 200)] + [(1, 1), (1, 0), (None, 1), (2, None)]
    mine, theirs = both(spark, pages, labels)
    assert mine == theirs
    verdict = {r[0]: r[4] for r in mine}
    assert verdict[101] == "block" and verdict[100] == "allow"
    rule = {r[0]: r[3] for r in mine}
    assert rule[1] == "example.com/en/7" and rule[2] == "example.net/de/8" and rule[3] == "net/de/" and rule[4] is None and rule[9] is None


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 0)]])
def test_few_outcomes(spark, labels):
    mine, theirs = both(spark, [(1, "http://a.com/x", ""), (2, None, "")], labels)
    assert mine == theirs and all(r[4] == "allow" for r in mine if r[3] is None)


def test_planted_bad_hosts_are_blocked(spark):
    """Reputation decides: bad hosts go, by their own pages or their domain's; good and average ones and those in doubt stay."""
    r = random.Random(1)
    pages, labels = [], []

    def host(name, n, rate, labelled=True):
        for _ in range(n):
            i = len(pages)
            pages.append((i, f"https://user@{name}:8080/p{i}", ""))
            if labelled:
                labels.append((i, int(r.random() < rate)))

    for i in range(60):
        host(f"h{i}.site{i % 12}.net", 20, 0.05)
    for i in range(4):
        host(f"h{i}.spam.com", 25, 0.9)
    host("new.spam.com", 5, 0, labelled=False)
    host("www.farm.co.uk", 40, 0.95)
    host("www.shop.co.uk", 40, 0.02)
    host("once.site1.net", 1, 1.0)
    host("10.0.0.7", 30, 0.9)
    host("10.0.1.7", 30, 0.02)
    mine, theirs = both(spark, pages, labels)
    assert mine == theirs
    blocked = {x[1].split("@")[1].split(":")[0] for x in mine if x[4] == "block"}
    assert blocked == {f"h{i}.spam.com" for i in range(4)} | {"new.spam.com", "www.farm.co.uk", "10.0.0.7"}
    assert {x[1] for x in mine if "shop" in x[1]} == {"user@www.shop.co.uk:8080"}


def test_hosts_that_differ_by_chance_only(spark):
    r = random.Random(2)
    pages = [(i, f"http://h{i % 50}.d{i % 5}.org/{i}", "") for i in range(1000)]
    mine, theirs = both(spark, pages, [(i, int(r.random() < 0.26)) for i in range(1000)])
    assert mine == theirs and all(x[4] == "allow" for x in mine)


def test_posterior_bound_like_its_integral(spark):
    """The incomplete beta function against the sum of the density."""
    cases = [(0.3, 5.0, 0.2), (2.5, 2.5, 0.5), (40.0, 60.0, 0.45), (9.0, 1.2, 0.7), (900.0, 2000.0, 0.29), (1.5, 700.0, 0.01), (0.02, 0.4, 0.3)]
    df = spark.createDataFrame(cases, "a double, b double, x double")
    got = [x.s for x in df.select(F.expr(urls._sure("a", "b", "x", urls._FOLD)).alias("s")).collect()]
    for (a, b, x), s in zip(cases, got):
        u = (np.arange(400000) + 0.5) / 400000

        def part(a, b, x):
            if a >= 1:
                top = (a - 1) * np.log(a / (a + b)) + (b - 1) * np.log(b / (a + b)) if b >= 1 else 0  # keeps it in range
                return float(np.exp((a - 1) * np.log(x * u) + (b - 1) * np.log1p(-x * u) - top).mean() * x)
            return float(((1 - (x**a * u) ** (1 / a)) ** (b - 1)).mean() * x**a / a)  # t = v ** (1 / a) takes out the pole at 0

        low, high = (part(a, b, x), part(b, a, 1 - x))
        assert abs(high / (low + high) - s) < 1e-4


def test_no_rows(spark):
    p = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(p, spark.createDataFrame([(1, 1)], "page_id long, bad int")).count() == 0


def test_plan_has_no_python(spark, sf):
    from veilspan.llm.queries import op4_url_reputation

    plan = op4_url_reputation(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_large_posteriors_are_judged_alike_on_both_sides_of_the_switch(spark, monkeypatch):
    """Just under and over NORMAL pages the beta bound and the normal one decide alike, but for a narrow band around the limit."""
    cases = []
    for pages in (19_990.0, 20_010.0):
        for rate in (0.02, 0.1, 0.4):
            sd = (rate * (1 - rate) / (pages + 1)) ** 0.5
            cases += [(pages * rate, pages * (1 - rate), rate - d * sd, d) for d in (-1.0, 0.5, 1.0, 1.55, 1.75, 2.5, 4.0)]
    df = spark.createDataFrame(cases, "a double, b double, x double, d double")
    switched = [x.s for x in df.select(F.expr(urls._sure("a", "b", "x", urls._FOLD)).alias("s")).collect()]
    monkeypatch.setattr(urls, "NORMAL", 10**9)
    exact = [x.s for x in df.select(F.expr(urls._sure("a", "b", "x", urls._FOLD)).alias("s")).collect()]
    for (a, b, _, d), s, e in zip(cases, switched, exact):
        assert (s > urls.SURE) == (e > urls.SURE) == (d > 1.645), (a, b, d, s, e)
        assert a + b > 20_000 or abs(s - e) < 1e-12
