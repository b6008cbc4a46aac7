"""Every registered query against its DuckDB oracle on the sf0.001 tables."""

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from tools.oracle_check import TABLES, canon
from trackyard.plans.registry import load_all

REGISTRY = load_all()
NAMES = sorted(REGISTRY)
SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_registry_has_oracles():
    assert len(NAMES) >= 87 and not [n for n in NAMES if n not in SQL]


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    df = REGISTRY[name].build(spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    cur = duck.execute(SQL[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    sc, sv = canon(df.columns, rows)
    dc, dv = canon(dcols, drows)
    assert sc == dc
    assert sv == dv, (list((sv - dv).items())[:3], list((dv - sv).items())[:3])


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["route_code", "from_en", "to_en", "total_trips", "total_passengers",
                          "total_revenue", "avg_load_pct"]


@pytest.mark.parametrize("name", ["stream_revenue_daily", "stream_rate_limit", "activity_by_shift",
                                  "revenue_daily_refresh", "live_sessions", "seat_admission"])
def test_results_do_not_depend_on_session_time_zone(spark, duck, name):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        df = REGISTRY[name].build(spark, SF_SMALL)
        rows = [tuple(r) for r in df.collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    cur = duck.execute(SQL[name])
    assert canon(df.columns, rows) == canon([d[0] for d in cur.description], cur.fetchall())
