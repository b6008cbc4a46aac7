"""The booking flow's steps that decide whether it scales: compiled reference numbers, and the last reference found by ranges."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from trackyard.functions import expr as X
from trackyard.operators import references as R

T0 = dt.datetime(2026, 1, 1)


@pytest.fixture
def compiled(spark):
    """Code that Spark cannot compile is an error, not run row by row."""
    conf = "spark.sql.codegen.fallback"
    old = spark.conf.get(conf)
    spark.conf.set(conf, "false")
    yield spark
    spark.conf.set(conf, old)


def _derived(spark, n):
    """References that are made as they are scanned, some of them of the drawn form."""
    i = F.col("id")
    parts = [F.when(i % 7 < k, F.lit("-")).otherwise("").cast("string") for k in range(3)]
    text = F.concat(F.lit("BK-"), *[x for k in range(3) for x in (i.cast("string"), F.lit("-"), (i * k).cast("string"), parts[k])])
    drawn = F.concat(F.lit("BK-"), *[F.substring(F.lit(X.BOOKING_REF_ALPHABET), (F.shiftright(i, 5 * k).bitwiseAND(
        F.lit(31).cast("long")) + 1).cast("int"), F.lit(1)) for k in range(X.BOOKING_REF_LEN)])
    return spark.range(n).select(F.when(i % 3 == 0, drawn).otherwise(text).alias("booking_ref"))


def test_stored_numbers_and_references_are_compiled(compiled):
    stored = _derived(compiled, 900)
    numbers = [r.number for r in R.stored_numbers(stored, X.BOOKING_REF_LEN).collect()]
    assert len(numbers) == len(set(numbers)) == 300
    rows = compiled.range(50).select(F.col("id").cast("string").alias("request_id"))
    got = {r.booking_ref for r in R.assign_booking_refs(rows, stored).collect()}
    assert len(got) == 50 and all(len(r) == 3 + X.BOOKING_REF_LEN for r in got)
    assert not got & {r.booking_ref for r in stored.collect()}


@pytest.mark.parametrize("length", [1, 4, 5, 7])
def test_rounds_as_columns_are_the_permutation(spark, length):
    df = spark.range(500).select("id", (F.col("id") * 7 % 32 ** length).alias("x"))
    df = R.with_permuted(df.withColumns({"to": R.permuted(F.col("x"), length), "on": F.col("x")}), "on", length)
    df = R.with_permuted(df.withColumn("back", F.col("on")), "back", length, inverse=True)
    assert df.where("on <> to OR back <> x").isEmpty() and df.columns == ["id", "x", "to", "on", "back"]


def _order(r):
    return tuple((v is not None, v or "") for v in r) if r[0] is None else ((True, r[0]), (r[1] is not None, r[1] or ""))


@pytest.mark.parametrize("kind", ["spread", "one moment", "nearly all equal", "odd"])
def test_nth_by_ranges(spark, kind, monkeypatch):
    monkeypatch.setattr(R, "RANGES", 4)
    monkeypatch.setattr(R, "FEW", 3)
    rnd = random.Random(kind)
    if kind == "spread":
        rows = [(T0 + dt.timedelta(microseconds=rnd.randrange(10 ** 6)), f"r{k}") for k in range(200)]
    elif kind == "one moment":
        rows = [(T0, f"r{k}") for k in range(200)]
    elif kind == "nearly all equal":
        rows = [(T0 + dt.timedelta(1), "b")] * 190 + [(T0, "a"), (T0, "c")] * 3
    else:
        rows = [(rnd.choice([None, T0, T0 + dt.timedelta(1)]), rnd.choice([None, "", "a", "b"])) for _ in range(80)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, request_id string")
    want = sorted(rows, key=_order)
    for n in (0, 5, 6, 41, len(rows) - 1):
        assert tuple(R._nth(df, n)) == want[n]
