from pyspark.sql import functions as F

from quire.llm import hosts
from quire.llm.queries import URL_RULES


def test_hosts_paths_and_rules(spark):
    cases = {
        "http://A.Example.COM/en/x?q=/es/#f": ("a.example.com", "/en/x", "example.com/en/", "block"),
        "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://x.www.example.com/en/1": ("x.www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "http://badexample.com/en/1": ("badexample.com", "/en/1", "com/", "allow"),
        "http://x.net/es/#a://b": ("x.net", "/es/", "net/es/", "block"),
        "http://x.net/de/": ("x.net", "/de/", None, "allow"),
        "http://example.com?x": ("example.com", "", None, "allow"),
        "no scheme": ("", "", None, "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow"),
        "a\nb://H/p\nq": ("h", "/p\nq", None, "allow"),
    }
    rows = spark.createDataFrame([(k, u, "old") for k, u in enumerate(cases)] + [(0, next(iter(cases)), "old")], "page_id long, url string, rule string")
    none = spark.createDataFrame([], "host string, bad int")
    found = hosts.judge(rows, none, URL_RULES).collect()
    assert len(found) == len(cases) + 1
    expected = list(cases.values())
    assert all((r["host"], r["path"], r["rule"], r["verdict"]) == expected[r["page_id"]] for r in found)
    assert hosts.judge(rows.limit(0), none, URL_RULES).count() == 0


def test_domains(spark):
    rows = spark.createDataFrame([("a.b.example.co.uk",), ("example.co.uk",), ("x.example.com",), ("com",), ("",), ("a.b.de",)], "h string")
    found = {r["h"]: (r["d"], r["s"]) for r in rows.select("h", hosts.domain_of(F.col("h")).alias("d"), hosts.suffix_of(F.col("h")).alias("s")).collect()}
    assert found["a.b.example.co.uk"] == ("example.co.uk", "co.uk") and found["x.example.com"] == ("example.com", "com")
    assert found["com"] == ("com", "com") and found[""] == ("", "") and found["a.b.de"] == ("b.de", "de")


def test_reputation_shrinks_and_blocks(spark):
    outcomes = [("bad.example.org", 1)] * 60 + [("good.example.org", 0)] * 60 + [("few.example.org", 1)] * 2 + [("null.example.org", None)]
    pages = spark.createDataFrame([(h,) for h in ["bad.example.org", "good.example.org", "few.example.org", "none.example.org", "null.example.org"]], "host string")
    found = {r["host"]: r for r in hosts.reputation(spark.createDataFrame(outcomes, "host string, bad int"), pages).collect()}
    assert found["bad.example.org"]["posterior_bound"] > 0.5 > found["few.example.org"]["posterior_bound"]
    assert found["good.example.org"]["posterior_mean"] < 0.1
    assert found["good.example.org"]["posterior_mean"] < found["none.example.org"]["posterior_mean"] < found["few.example.org"]["posterior_mean"] < 1
    assert found["none.example.org"]["posterior_mean"] == found["null.example.org"]["posterior_mean"]
    urls = pages.select(F.concat(F.lit("http://"), "host", F.lit("/x")).alias("url"))
    judged = {r["host"]: r["verdict"] for r in hosts.judge(urls, spark.createDataFrame(outcomes, "host string, bad int"), URL_RULES).collect()}
    assert [h for h, v in judged.items() if v == "block"] == ["bad.example.org"]
