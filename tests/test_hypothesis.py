"""Randomised seat admission against the sequential replay (Hypothesis)."""

import datetime as dt
from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from trackyard.operators import seats as S
from trackyard.sources import schema as SC

from test_properties import _replay

T0 = dt.datetime(2026, 1, 1)
SEATS = ["1A", "1a", " 1A", "1B", "2C", "2D"]

sched_st = st.lists(st.tuples(st.integers(-1, 4), st.sampled_from(SC.TRAIN_CLASSES),
                              st.sampled_from(["active", "cancelled", "delayed"])),
                    min_size=1, max_size=4)
req_st = st.lists(st.tuples(st.integers(0, 30), st.integers(1, 5), st.sampled_from(SEATS)),
                  min_size=1, max_size=40)
hist_st = st.lists(st.tuples(st.integers(1, 4), st.sampled_from(SEATS),
                             st.sampled_from(SC.BOOKING_STATUSES)), max_size=6)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(sched_st, req_st, hist_st, st.integers(1, 4))
def test_admission_matches_replay(spark, scheds_in, reqs_in, hist_in, buckets):
    scheds = [(i + 1, f"T{i}", 1, "08:00:00", "09:00:00", dt.date(2026, 1, 2), 4, avail, cls,
               status, 0) for i, (avail, cls, status) in enumerate(scheds_in)]
    routes = [(1, "RT-1", 1, 2, Decimal("1.00"), 60, Decimal("30.00"), Decimal("0.00"),
               Decimal("10.00"), 1)]
    reqs = [(f"R{k:03d}", T0 + dt.timedelta(seconds=s), 1, sid, seat, "cash")
            for k, (s, sid, seat) in enumerate(reqs_in)]
    hist = [(f"H{k}", 1, sid, seat, Decimal("1.00"), "cash", "paid", bs, T0)
            for k, (sid, seat, bs) in enumerate(hist_in)]
    adm = S.admit_bookings(spark.createDataFrame(reqs, SC.REQUESTS),
                           spark.createDataFrame(scheds, SC.SCHEDULES),
                           spark.createDataFrame(hist, SC.BOOKINGS),
                           spark.createDataFrame(routes, SC.ROUTES), salt_buckets=buckets)
    got = {r.request_id: (r.outcome, None if r.amount_paid is None else float(r.amount_paid))
           for r in S.admission_result(adm).collect()}
    assert got == _replay(scheds, routes, hist, reqs)
