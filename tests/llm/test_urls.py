"""op13 against all rules on all URLs, in Python and in DuckDB."""

import re

import duckdb
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import SF_SMALL
from trackyard.llm import op13_urls as urls

HARD = [None, "", "no scheme", "://", "://x", "HTTP://WWW.Example.COM/en/x", "http://example.com/en/", "http://example.com",
        "http://com/", "http://xcom/en/", "http://www.example.com/en/a?u=http://b.net/es/", "http://a.net/fr/?q#f",
        "http://a.net/FR/x", "http://a.org/x#/cgi-bin/", "http://a.org/cgi-bin/index.html", "http://ads.a.org/",
        "http://loads.a.org/", "http://a.org/ads.", "http://a.org/?x=1&sessionid=4", "http://a.org/?xsessionid=4",
        "http://a.org/setup.EXE", "http://a.org/setup.exe?x", "http://a.org/tag/b/page/2", "a://b://c.net/es/d",
        "http://best-casino.org/\nnext", "http://a.org/" + "x" * 20000 + "/viagra/", "http://é.org/porn", "İ://İ.org/",
        "http://spam-farm.org", "http://my.spam-farm.org/", "http://myspam-farm.org/", "http://a.org/report-spam/cgi-bin/"]


def plain(url):
    """(host, path, rule, verdict, pattern) with every rule tried."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(h + p, v) for h, p, v in urls.HOST_RULES if ("." + host).endswith("." + h) and path.startswith(p)]
    if fits:
        return host, path, *max(fits, key=lambda x: len(x[0])), None
    low = "".join(c.lower() if c.isascii() else c for c in url or "")
    hit = [p for p in urls.PATTERNS if re.search(urls.expression(p.removeprefix("@@")), low)]
    if not hit or any(p.startswith("@@") for p in hit):
        return host, path, None, "allow", None
    return host, path, None, "block", hit[0]


@pytest.fixture(scope="module")
def pages(spark):
    got = [(r.page_id, r.url) for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()]
    got += [(1000 + i, u) for i, u in enumerate(HARD)] + [(None, HARD[5]), (7, HARD[5]), (7, HARD[5])]
    return got


def test_all_rules_on_all_urls(spark, pages):
    df = spark.createDataFrame([(i, u, "h", "r", "t") for i, u in pages],
                               "page_id long, url string, host string, rule string, token string").repartition(4)
    got = sorted(map(str, map(tuple, urls.judge(df).collect())))
    assert got == sorted(str((i, *plain(u))) for i, u in pages)


def test_oracle_sql(pages):
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(pages, columns=["page_id", "url"]).astype({"page_id": "Int64"}))
    rows = con.sql(urls.oracle()).fetchall()
    assert sorted(map(str, rows)) == sorted(str((i, *plain(u))) for i, u in pages)


def test_empty_table(spark):
    df = urls.judge(spark.createDataFrame([], "page_id int, url string, html string"))
    assert df.columns == ["page_id", "host", "path", "rule", "verdict", "pattern"] and df.count() == 0


def test_no_rules(spark):
    df = spark.createDataFrame([(1, "http://a.com/cgi-bin/")], "page_id long, url string")
    assert [tuple(r) for r in urls.judge(df, (), ()).collect()] == [(1, "a.com", "/cgi-bin/", None, "allow", None)]


text = st.text(st.sampled_from("ab1-_.%/?*^|:"), max_size=9)


@settings(max_examples=600, deadline=None)
@given(text, text, text)
def test_tokens_are_mandatory(pattern, before, after):
    """Whatever a pattern matches holds all of its tokens."""
    for url in (before, before + after, before + pattern.strip("|").replace("*", after).replace("^", "/") + after):
        if re.search(urls.expression(pattern), url):
            assert set(urls.tokens(pattern)) <= urls.url_tokens(url)


def test_rarest_token_stands_in_the_index(spark):
    rows = [(i, f"http://host{i}.org/shop/{'rare' if i == 3 else 'x'}/") for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    counts = urls.token_counts(df, {"shop", "rare", "none"})
    assert counts == {"shop": 20, "rare": 1}
    by_token, free = urls.index(["/shop/*/rare/", "/shop/", "*shop*"], counts)
    assert by_token == {"rare": [0], "shop": [1]} and free == [2]
    matcher = urls.Matcher(["/shop/*/rare/", "/gone/"], counts)
    assert matcher.blocking("http://host1.org/shop/x/") is None and matcher.runs == 0


def test_rule_list_is_bounded():
    with pytest.raises(ValueError):
        urls.parts(["x" * (urls.RULE_BYTES + 1)])
