import math
import re

import pytest
from oracle import same
from pyspark.sql import functions as F

from textloom.llm import queries, url_filter

SCHEMA = "page_id bigint, url string, html string, host string, a bigint"


def frame(spark, urls):
    return spark.createDataFrame([(i, u, "x", "old", 1) for i, u in enumerate(urls)], SCHEMA)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_same_as_sql(spark, folder):
    same(queries.op10_url_filter(spark, folder), url_filter.ORACLE, folder)


def test_hosts_paths_and_rules(spark):
    cases = {
        "http://A.Example.ORG/en/12?q=/es/": ("a.example.org", "/en/12", "example.org/en/1", "block"),
        "https://example.org/es/x": ("example.org", "/es/x", "example.org/es/", "block"),
        "https://example.org/EN/1": ("example.org", "/EN/1", "org/", "allow"),
        "https://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "http://x.org": ("x.org", "", None, None),
        "http://x.org?a=/b": ("x.org", "", None, None),
        "http://b.com/fr/1#x": ("b.com", "/fr/1", "com/fr/", "allow"),
        "http://b.com/de/": ("b.com", "/de/", "com/de/", "block"),
        "a://b.com://c.org/fr/": ("b.com:", "//c.org/fr/", None, None),
        "no scheme": ("", "", None, None), "": ("", "", None, None), None: ("", "", None, None),
        "://É.COM/fr/É\n2": ("É.com", "/fr/É\n2", "com/fr/", "allow"),
    }
    rows = url_filter.judge(frame(spark, list(cases))).orderBy("page_id").collect()
    assert len(rows) == len(cases)
    for r, (url, (host, path, rule, verdict)) in zip(rows, cases.items(), strict=True):
        assert (r.host, r.path, r.rule) == (host, path, rule), url
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


def test_learns_from_ruled_urls(spark):
    urls = [f"http://good{i}.org/news/{i}" for i in range(30)] + [f"http://spam{i}.com/de/win-{i}" for i in range(30)] + ["http://good99.net/news/7", "http://spam99.net/de/win-7"]
    rows = url_filter.judge(frame(spark, urls)).orderBy("page_id").collect()
    assert [x.verdict for x in rows] == ["allow"] * 30 + ["block"] * 30 + ["allow", "block"]


def test_one_kind_none_and_repeats(spark):
    assert {x.verdict for x in url_filter.judge(frame(spark, ["http://a.net/", "http://b.org/"])).collect()} == {"allow"}
    assert url_filter.judge(frame(spark, [])).count() == 0
    got = url_filter.judge(frame(spark, ["http://a.net/x", None, "http://a.org/y", "http://b.com/de/z"] * 5))
    assert got.count() == 20 and got.select("url", "verdict").distinct().count() == 4


def test_long_url(spark):
    assert url_filter.judge(frame(spark, ["http://a.net/" + "ab" * 20_000, "http://a.org/", "http://a.com/de/"])).count() == 3


def test_long_random_urls_take_time_by_their_length(spark):
    """A URL of a million random characters, none of whose grams is hot."""
    import random
    import string
    import time

    rng = random.Random(3)
    long = "http://a.org/" + "".join(rng.choices(string.ascii_letters + string.digits + "é中\U0001f600", k=1_000_000))
    began = time.perf_counter()
    rows = url_filter.judge(frame(spark, [long, *(f"http://b{i}.com/{'fr' if i % 2 else 'de'}/{i}" for i in range(250))])).collect()
    assert time.perf_counter() - began < 120 and len(rows) == 251 and [r.verdict for r in rows if r.page_id == 0] == ["allow"]


def test_probabilities_sum_to_less_than_one(spark):
    """Smoothing leaves mass to unseen characters; the seen ones of a context hold the rest."""
    texts = spark.createDataFrame([("abcab", 3, 1), ("abd", 1, 2)], "text string, accepted bigint, rejected bigint")
    grams = [x.gram for x in url_filter.ratios(texts, 2).collect()]
    assert len(grams) == len(set(grams)) and all(re.fullmatch(r".{3}", g) for g in grams)
    assert url_filter.ratios(texts, 2).where(F.isnan("ratio") | F.col("ratio").isNull()).count() == 0


def test_query_and_scheme_count(spark):
    """URLs that differ behind ``?`` only, or hold no ``://``, are told apart by what they hold."""
    urls = [f"http://a{i}.org/x?from=reader{i}" for i in range(60)] + [f"http://b{i}.com/de/x?from=casino{i}" for i in range(60)] + ["http://c.net/x?from=reader7", "http://c.net/x?from=casino7", "reader8", "casino8"]
    rows = url_filter.judge(frame(spark, urls)).orderBy("page_id").collect()
    assert [x.verdict for x in rows[120:]] == ["allow", "block", "allow", "block"]
    assert [(x.host, x.path) for x in rows[122:]] == [("", "")] * 2


def test_calibration_of_left_out_urls(spark):
    rows = [("a", 3, 0, False, 1.0), ("b", 1, 0, False, 2.0), ("c", 0, 2, False, -1.0), ("d", 0, 2, True, 50.0), ("e", 5, 0, True, -50.0)]
    base, slope = url_filter.calibration(spark.createDataFrame(rows, "text string, accepted bigint, rejected bigint, taught boolean, score double"))
    ma, mr, var = 1.25, -1.0, (3 * 0.25**2 + 0.75**2) / 6
    assert slope == pytest.approx((ma - mr) / var) and base == pytest.approx(math.log(4 / 2) - slope * (ma + mr) / 2)


def test_clashing_names_and_one_hot_url(spark):
    rows = [(i, "http://hot.net/same" if i % 3 else f"http://x{i}.org/", "t", "r", 1) for i in range(300)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, text string, ruled string, Score int")
    got = url_filter.judge(df)
    assert got.columns == ["page_id", "url", "text", "ruled", "host", "path", "rule", "verdict", "score"]
    assert sorted((x.page_id, x.url, x.text, x.ruled) for x in got.collect()) == [x[:4] for x in rows]
