"""Operators stay exact when one key holds a third of all rows."""

import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from trackyard.operators import metrics as M
from trackyard.operators import mutate as MU
from trackyard.operators import seats as S
from trackyard.sources import schema as SC

from test_properties import _replay

T0 = dt.datetime(2026, 1, 1)


def test_admission_with_one_hot_schedule(spark):
    rnd = random.Random(3)
    scheds = [(i, f"T{i}", 1, "08:00:00", "09:00:00", dt.date(2026, 1, 2), 40, rnd.randint(0, 40),
               "Economy", "active", 0) for i in range(1, 21)]
    routes = [(1, "RT-1", 1, 2, Decimal("1.00"), 60, Decimal("3.00"), Decimal("2.00"),
               Decimal("1.00"), 1)]
    seats = [f"{r}{c}" for r in range(1, 11) for c in "ABCD"]
    reqs = []
    for k in range(3000):
        sid = 7 if k % 3 == 0 else rnd.randint(1, 20)      # schedule 7 gets a third
        reqs.append((f"R{k:05d}", T0 + dt.timedelta(seconds=rnd.randint(0, 500)), 1, sid,
                     rnd.choice(seats), "cash"))
    hist = [(f"H{k}", 1, 7, seats[k], Decimal("1.00"), "cash", "paid", "confirmed", T0)
            for k in range(5)]
    adm = S.admit_bookings(spark.createDataFrame(reqs, SC.REQUESTS),
                           spark.createDataFrame(scheds, SC.SCHEDULES),
                           spark.createDataFrame(hist, SC.BOOKINGS),
                           spark.createDataFrame(routes, SC.ROUTES), salt_buckets=16)
    got = {r.request_id: (r.outcome, None if r.amount_paid is None else float(r.amount_paid))
           for r in S.admission_result(adm).collect()}
    assert got == _replay(scheds, routes, hist, reqs)


def test_recent_bookings_with_one_hot_user(spark):
    rnd = random.Random(5)
    rows = [(f"B{k:05d}", 0 if k % 3 == 0 else rnd.randint(1, 50), 1, "1A", Decimal("1.00"),
             "cash", "paid", "confirmed", T0 + dt.timedelta(minutes=rnd.randint(0, 100)))
            for k in range(3000)]
    b = spark.createDataFrame(rows, SC.BOOKINGS)
    got = {(r.user_id, r.rank): r.booking_ref for r in M.recent_bookings(b, 3).collect()}
    for u in {r[1] for r in rows}:
        mine = sorted([r for r in rows if r[1] == u], key=lambda r: (r[8], r[0]), reverse=True)[:3]
        for i, r in enumerate(mine):
            assert got[(u, i + 1)] == r[0]


def test_upsert_and_cancel_with_hot_key(spark):
    target = spark.createDataFrame([(1, 0), (2, 0)], "user_id long, flag int")
    rows = spark.createDataFrame([(1, k % 2, k) for k in range(999)] + [(2, 1, 0)],
                                 "user_id long, flag int, ts int")
    out = {r.user_id: r.flag for r in MU.upsert(target, rows, ["user_id"], ["flag"], ["ts"]).collect()}
    assert out == {1: 0, 2: 1}      # ts 998 is even -> flag 0
    b = spark.createDataFrame([("B1", 1, 1, "1A", Decimal("1.00"), "cash", "paid", "confirmed", T0)],
                              SC.BOOKINGS)
    req = spark.createDataFrame([(f"r{k:04d}", "B1", T0 + dt.timedelta(seconds=k), None)
                                 for k in range(1000)],
                                "request_id string, booking_ref string, ts timestamp_ntz, reason string")
    c = MU.cancel_bookings(b, req)
    counts = {r.outcome: r["count"] for r in c.outcomes.groupBy("outcome").count().collect()}
    assert counts == {"cancelled": 1, "already_cancelled": 999}
    assert c.deltas.first().delta == 1


def test_admission_splits_a_hot_schedule(spark):
    """The first window runs on (schedule, salt): no task ranks a whole hot schedule."""
    import contextlib
    import io
    reqs = spark.range(20000).select(
        F.format_string("R%06d", F.col("id")).alias("request_id"),
        F.expr("timestamp_ntz'2026-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id)").alias("ts"),
        F.lit(1).cast("long").alias("user_id"), F.when(F.col("id") % 5 < 4, 1).otherwise(F.col("id") % 50 + 2).alias("schedule_id"),
        F.format_string("S%d", F.col("id")).alias("seat_number"), F.lit("visa").alias("payment_method"))
    sched = spark.range(1, 60).select(F.col("id"), F.lit(1).cast("long").alias("route_id"), F.lit("active").alias("status"),
                                      F.lit("Economy").alias("class"), F.lit(50).alias("available_seats"))
    routes = spark.createDataFrame([(1, 3.0, 2.0, 1.0)], "id long, price_first_class double, price_economy double, price_student double")
    held = spark.createDataFrame([], "schedule_id long, seat_number string, booking_status string")
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        adm = S.admit_bookings(reqs, sched, held, routes, salt_buckets=16)
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            adm.outcomes.explain()
        plan = buf.getvalue()
        assert "hashpartitioning(schedule_id" in plan and "_salt" in plan
        import re
        ranked = re.findall(r"Window \[row_number.*?\[schedule_id#\d+L?, _salt#\d+\]", plan)
        assert len(ranked) == 1 and re.search(r"hashpartitioning\(schedule_id#\d+L, _salt#\d+, \d+\)", plan)
        got = {r.outcome: r["count"] for r in adm.outcomes.groupBy("outcome").count().collect()}
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got["accepted"] == 50 * 11 and got["no_seats"] == 20000 - 50 * 11
