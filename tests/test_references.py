"""References by permutation, and the booking flow when they run out."""

import random

import pytest
from pyspark.sql import functions as F

from test_properties import _world
from trackyard.functions import expr as X
from trackyard.operators import references as R


@pytest.mark.parametrize("length", [1, 2, 3])
def test_permutation_is_a_bijection(spark, length):
    n = 32 ** length
    df = spark.range(n).select("id", R.permuted(F.col("id"), length).alias("p"), R.to_reference(F.col("id"), length).alias("ref"))
    df = df.withColumns({"back": R.permuted(F.col("p"), length, inverse=True), "number": R.to_number(F.col("ref"), length)})
    r = df.agg(F.countDistinct("p").alias("p"), F.min("p").alias("low"), F.max("p").alias("high"), F.countDistinct("ref").alias("refs"),
               F.count_if(F.col("back") != F.col("id")).alias("bad"), F.count_if(~F.col("number").eqNullSafe(F.col("id"))).alias("odd")
               ).first()
    assert (r.p, r.low, r.high, r.refs, r.bad, r.odd) == (n, 0, n - 1, n, 0, 0)


def test_long_references(spark):
    df = spark.range(1000).select((F.col("id") * 1_000_003_000_001).alias("id"))
    df = df.select("id", R.to_reference(F.col("id"), 12).alias("ref"))
    assert df.where(~R.to_number(F.col("ref"), 12).eqNullSafe(F.col("id"))).isEmpty()
    assert df.select("ref").distinct().count() == 1000
    odd = spark.createDataFrame([("BK-IIIII",), ("BK-AAAA",), ("XX-AAAAA",), (None,), ("BK-AAAAA ",)], "booking_ref string")
    assert R.stored_numbers(odd, 5).isEmpty()


def test_symbols_are_spread(spark):
    rows = spark.range(64000).select(F.substring(R.to_reference(F.col("id"), 5), 4, 1).alias("c")).groupBy("c").count().collect()
    assert len(rows) == 32 and all(1500 < r["count"] < 2500 for r in rows)


def _assigned(spark, n, stored, length, extra=()):
    rows = spark.range(n).select(F.concat(F.lit("q"), F.col("id").cast("string")).alias("request_id"), F.lit(1).alias("at"))
    existing = spark.createDataFrame([(i,) for i in stored], "id long").select(
        R.to_reference(F.col("id"), length).alias("booking_ref")).unionByName(
        spark.createDataFrame([(e,) for e in extra], "booking_ref string"))
    got = R.assign_booking_refs(rows, existing, length=length)
    assert got.columns == ["request_id", "at", "booking_ref"]
    got = got.withColumn("number", R.to_number(F.col("booking_ref"), length)).collect()
    assert len(got) == n == len({r.request_id for r in got})
    return [r.number for r in got]


@pytest.mark.parametrize("seed", range(2))
def test_rows_take_the_first_free_numbers(spark, seed, monkeypatch):
    monkeypatch.setattr(R, "CELLS", 7)
    rnd = random.Random(seed)
    stored = set(rnd.sample(range(1024), rnd.choice([0, 40, 400]))) | set(range(rnd.choice([0, 100])))
    stored |= {x + 1 for x in list(stored)[:50] if x < 1023}
    got = _assigned(spark, 300, stored, 2, extra=["BK-1-2-3", "BK-AAAAAA"])
    assert sorted(got) == [i for i in range(1024) if i not in stored][:300]


def test_space_is_used_up_to_the_last_reference(spark):
    stored = set(range(0, 1024, 3))
    got = _assigned(spark, 900, stored, 2)
    assert sorted(x for x in got if x is not None) == [i for i in range(1024) if i % 3]
    assert got.count(None) == 900 - (1024 - len(stored))
    assert _assigned(spark, 5, range(1024), 2) == [None] * 5


def test_accepted_is_booked_and_holds_a_seat(spark):
    """With few references left for more requests: one by one in request order."""
    sdf, rdf, hdf, qdf, scheds, _routes, hist, reqs = _world(spark, 11, n_req=300)
    users = spark.createDataFrame([(1, "A", "B")], "id long, first_name string, last_name string")
    used = [f"{X.BOOKING_REF_PREFIX}{c}" for c in X.BOOKING_REF_ALPHABET[6:]]
    gone = hdf.limit(1).drop("booking_ref").crossJoin(spark.createDataFrame([(u,) for u in used], "booking_ref string")) \
        .withColumn("booking_status", F.lit("cancelled"))
    got = R.book(qdf, sdf, hdf.unionByName(gone), rdf, users, length=1)
    free = {s[0]: s[7] for s in scheds}
    status = {s[0]: s[9] for s in scheds}
    held = {(h[2], h[3].rstrip().upper()) for h in hist if h[7] in ("confirmed", "pending")}
    codes, want = 6, {}
    for r in sorted(reqs, key=lambda r: (r[1], r[0])):
        rid, sid, seat = r[0], r[3], r[4].rstrip().upper()
        if sid not in free:
            want[rid] = "not_found"
        elif status[sid] == "cancelled":
            want[rid] = "schedule_cancelled"
        elif free[sid] <= 0:
            want[rid] = "no_seats"
        elif (sid, seat) in held:
            want[rid] = "seat_taken"
        elif not codes:
            want[rid] = "no_reference"
        else:
            want[rid], codes = "accepted", codes - 1
            free[sid] -= 1
            held.add((sid, seat))
    rows = got.outcomes.collect()
    assert {r.request_id: r.outcome for r in rows} == want
    assert {"no_reference", "accepted", "seat_taken", "no_seats"} <= set(want.values())
    booked = got.bookings.collect()
    accepted = [r for r in rows if r.outcome == "accepted"]
    assert len(accepted) == len(booked) == 6 == -sum(r.delta for r in got.deltas.collect())
    assert {r.booking_ref for r in accepted} == {r.booking_ref for r in booked} == {
        f"{X.BOOKING_REF_PREFIX}{c}" for c in X.BOOKING_REF_ALPHABET[:6]}
    assert all((r.booking_ref is None) == (r.amount_paid is None) == (r.outcome != "accepted") for r in rows)
    # with references enough nothing changes
    many = R.book(qdf, sdf, hdf, rdf, users)
    assert many.outcomes.where("outcome = 'no_reference'").isEmpty()
    assert many.bookings.count() == -many.deltas.agg(F.sum("delta")).first()[0] > 6
