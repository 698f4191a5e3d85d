import random

import duckdb
import pytest

from dagframe.llm.url_filter import OP1_SQL, TWO_LABEL_SUFFIXES, Rule, domain_of, filter_urls, host_reputation, op1_url_filter, suffix_of, url_host, url_path
from pyspark.sql import functions as F


def test_url_parts(spark):
    urls = ["http://A.b.COM/x?y#z", "https://h.net#f", "x://h?q=http://no", "no scheme", None, "a://b://c/d", "http://É.com/É?", "http:///p", ""]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select(url_host(F.col("u")), url_path(F.col("u")))
    assert [tuple(r) for r in df.collect()] == [("a.b.com", "/x"), ("h.net", ""), ("h", ""), ("", ""), ("", ""), ("b:", "//c/d"), ("É.com", "/É"), ("", "/p"), ("", "")]


def test_domains(spark):
    df = spark.createDataFrame([("a.b.co.uk",), ("x.y.com",), ("com",), ("",)], "h string").select(domain_of(F.col("h")), suffix_of(F.col("h")))
    assert [tuple(r) for r in df.collect()] == [("b.co.uk", "co.uk"), ("y.com", "com"), ("com", "com"), ("", "")]
    odd = ["me:pw@a.b.co.uk:8080", "a.org:80", "10.0.0.1", "10.0.0.1:99", "[::1]:80", "x.y.com.", "10.0.0.256.com", "u@"]
    df = spark.createDataFrame([(h,) for h in odd], "h string").select(domain_of(F.col("h")), suffix_of(F.col("h")))
    assert [tuple(r) for r in df.collect()] == [("b.co.uk", "co.uk"), ("a.org", "org"), ("10.0.0.1",) * 2, ("10.0.0.1",) * 2, ("[::1]",) * 2, ("y.com", "com"), ("256.com", "com"), ("", "")]


def test_query_against_sql(spark, tmp_path):
    r = random.Random(6)
    hosts = [f"h{k % 5}.d{k}.{s}" for k, s in enumerate([*TWO_LABEL_SUFFIXES, "com", "net", "org", "de"] * 2)]
    hosts += ["co.uk", "d1.co.uk", "me@a.d1.co.uk:81", "10.0.0.1", "10.0.0.1:8", "[::1]", "x.org.", "", "www.example.com", "m.example.com"]
    urls = [None if r.random() < 0.02 else f"http://{r.choice(hosts)}{r.choice(['', '/en/', '/es/x', '/fr/', '/a?b'])}" for _ in range(1500)]
    urls += ["no scheme", "", "HTTP://A.B.Co.Uk/" + "x" * 100_000]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    labels = [(k, None if r.random() < 0.05 else int(r.random() < 0.6), 0) for k in range(0, 1500, 2)] + [(4, 1, 0), (9999, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    c = duckdb.connect()
    for t in ("pages", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = c.sql(OP1_SQL)
    got = op1_url_filter(spark, str(tmp_path)).select(*want.columns)
    near = lambda rows: sorted([tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in rows], key=repr)
    assert near(got.collect()) == near(want.fetchall()) and {r['verdict'] for r in got.collect()} == {'allow', 'block'}


def judged(spark, urls, outcomes=(), **options):
    pages = spark.createDataFrame([(k, u, "old", "old") for k, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    out = spark.createDataFrame(list(outcomes), "url string, bad int")
    return {r["page_id"]: r for r in filter_urls(pages, out, **options).collect()}


def test_longest_rule_wins(spark):
    got = judged(spark, ["http://www.example.com/en/1", "http://m.www.example.com/en/", "http://m.example.com/en/x", "http://example.com/fr", "http://notexample.com/en/", "http://a.net/es/1", "http://a.net/esx", "http://b.com", None])
    assert [got[k]["rule"] for k in range(9)] == ["www.example.com/en/", "www.example.com/en/", "example.com/en/", "com/", "com/", "net/es/", None, None, None]
    assert [got[k]["verdict"] for k in range(9)] == ["allow", "allow", "block", "allow", "allow", "block", "allow", "allow", "allow"]


def test_reputation_is_shrunk_and_bounded(spark):
    outcomes = [(f"http://bad.x.org/{k}", 1) for k in range(60)] + [(f"http://good{k % 20}.y.org/{k}", 0) for k in range(400)] + [("http://once.y.org/", 1), (None, 1), ("http://bad.x.org/", None)]
    got = judged(spark, ["http://bad.x.org/", "http://new.x.org/", "http://once.y.org/", "http://new.y.org/", "http://z.info/"], outcomes)
    rate = [got[k]["bad_rate"] for k in range(5)]
    assert got[0]["verdict"] == "block" and all(got[k]["verdict"] == "allow" for k in (2, 3, 4))
    assert rate[0] > rate[1] > rate[4] > rate[3] and rate[3] < rate[2] < 0.9 and got[0]["n_labelled"] == 60 and got[1]["n_labelled"] == 0
    assert all(got[k]["bad_bound"] < rate[k] for k in range(5))


def test_repeats_and_empty_tables(spark):
    assert judged(spark, []) == {}
    got = judged(spark, ["http://a.org/"] * 3)
    assert len(got) == 3 and {r["verdict"] for r in got.values()} == {"allow"}
    none = spark.createDataFrame([], "host string, bad int")
    assert host_reputation(spark.createDataFrame([("h",)], "host string"), none).first()["bad_rate"] == pytest.approx(0.5)


def test_too_many_rules(spark):
    with pytest.raises(ValueError):
        judged(spark, ["http://a.org/"], rules=(Rule("allow", "x", "/"),) * 1001)
