"""URL filters: rules, host and path by hand, and both native queries against SQL."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from quire.llm import mixing, url_filters

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
URLS = [
    ("https://www.Example.NET/en/12?q=1", "www.example.net", "/en/12", "example.net/en/", "allow"),
    ("http://a.example.net/fr/1", "a.example.net", "/fr/1", "net/", "block"),
    ("http://example.com/de/x#f", "example.com", "/de/x", "example.com/de/", "block"),
    ("http://notexample.com/de/x", "notexample.com", "/de/x", None, None),
    ("http://b.org/fr/", "b.org", "/fr/", "org/fr/", "allow"),
    ("http://net", "net", "", None, None),
    ("http://net/", "net", "/", "net/", "block"),
    ("no scheme.net/en/", "", "", None, None),
    ("x://Ü.ORG?fr/", "Ü.org", "", None, None),
    (None, "", "", None, None),
    ("http://h://x.net/a", "h:", "//x.net/a", None, None),
]


def test_host_path_and_rules(spark):
    df = spark.createDataFrame([(i, u[0], "mine", "mine") for i, u in enumerate(URLS)] * 2, "page_id long, url string, host string, verdict string")
    labels = spark.createDataFrame([(3, None), (None, 1)], "page_id long, bad int")
    out = url_filters.judge(df, labels)
    assert out.columns == ["page_id", "url", "host", "verdict", "_host", "path", "rule", "template", "purity", "_verdict"]
    got = out.collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        _, host, path, rule, verdict = URLS[r.page_id]
        assert (r._host, r.path, r.rule) == (host, path, rule) and r._verdict == (verdict or "allow")
    assert url_filters.judge(df.limit(0), labels).count() == 0


def test_templates_merge_alike_and_reject_bad(spark):
    rows = [(f"http://a.com/news/{i}", i, 0) for i in range(60)] + [(f"http://a.com/spam/{i}", 100 + i, 1) for i in range(60)]
    rows += [(f"http://b.com/{w}/{i}", 200 + 10 * k + i, i % 2 if i < 2 else 0) for k, w in enumerate(["x", "y", "z"]) for i in range(10)]
    rows += [(f"http://c.com/s{'abcdefghijklmnopqrstuvwxyzABCDEFGH'[i]}", 400 + i, 0) for i in range(34)]
    rows += [(f"http://e.com/{'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMN'[k]}/{i}", 600 + 10 * k + i, int(k == 39)) for k in range(40) for i in range(10)]
    deep, long = "http://f.com/" + "p/" * 7, "http://g.com/" + "n" * 41
    rows += [(f"{deep}{w}/{i}", 2000 + 100 * k + i, k) for k, w in enumerate(["good", "bad"]) for i in range(60)]
    rows += [(f"{long}/{i}", 3000 + i, 1) for i in range(60)] + [(f"http://g.com/{'m' * 41}/{i}", 3100 + i, 0) for i in range(60)]
    rows += [("http://d.com/" + "/".join(["p"] * 3000 + [w]), 500 + k, k) for k, w in enumerate("xy")]
    pages = spark.createDataFrame([(i, u) for u, i, _ in rows], "page_id long, url string")
    labels = spark.createDataFrame([(i, b) for _, i, b in rows], "page_id long, bad int")
    got = {r.url: r for r in url_filters.judge(pages, labels).collect()}
    assert all(got[u].verdict == ("block" if "/spam/" in u else "allow") for u, i, _ in rows if i < 200)
    assert len({got[u].template for u in got if "b.com" in u}) == 1  # branches of like purity
    assert {got[u].template for u in got if "c.com" in u} == {"/*"}  # very many children, all alike
    assert {got[u].verdict for u in got if "e.com/N/" in u} == {"block"}  # one that differs among forty stays apart
    assert {got[u].verdict for u in got if "e.com/" in u and "/N/" not in u} == {"allow"}
    for part in ("f.com", "g.com"):  # at any depth and length
        assert {(b, got[u].verdict) for u, _, b in rows if part in u} == {(0, "allow"), (1, "block")}
    assert got[rows[-1][0]].template == "/" + "p/" * 3000 + "*"


@pytest.mark.parametrize(("query", "sql"), [(mixing.op2_poisson_mixing, mixing.ORACLE), (url_filters.op8_path_templates, url_filters.ORACLE)])
def test_native_queries_equal_sql(spark, query, sql):
    c = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = query(spark, SF)
    found = c.execute(sql)
    names = [d[0] for d in found.description]
    key = lambda row: tuple(map(str, row))
    assert sorted((key(r[n] for n in names) for r in df.collect())) == sorted(map(key, found.fetchall()))


def test_poisson_distribution_sums_to_one(spark):
    for rate in (0.0, 0.3, 2.5, 40.0, 900.0):
        cdf = spark.sql(f"SELECT {mixing.distribution(f'cast({rate} as double)')} AS c").first().c
        assert all(a <= b for a, b in zip(cdf, cdf[1:], strict=False)) and abs(cdf[-1] - 1) < 1e-9


def test_uniform_numbers_are_even(spark):
    u = spark.range(4000).select(mixing.uniform(F.col("id"), "s").alias("u"))
    assert 0.45 < u.agg(F.avg("u")).first()[0] < 0.55 and u.where("u >= 1 OR u < 0").count() == 0
