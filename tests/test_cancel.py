"""Cancels by reference: exact on odd rows, requests exchanged once."""

import contextlib
import datetime as dt
import io
import random

import pytest

from trackyard.operators import mutate as MU

T0 = dt.datetime(2026, 1, 1)
BOOKINGS = ("booking_ref string, user_id long, schedule_id long, booking_status string, payment_status string, "
            "cancelled_at timestamp_ntz, cancel_reason string")
REQUESTS = "request_id string, booking_ref string, ts timestamp_ntz, reason string"
ACTORS = ", actor_id long, actor_role string"


@pytest.fixture
def shuffled(spark):
    """Plans as a cluster makes them of large tables, with reused exchanges shown."""
    new = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _bookings(rnd):
    states = ["confirmed", "pending", "completed", "cancelled", None]
    rows = [(f"B{i}", rnd.randrange(4), i % 5, rnd.choice(states), "paid", None, None) for i in range(30)]
    rows += [(r[0], rnd.choice([0, 1, None]), 9, rnd.choice(states), "paid", None, None) for r in rows[::4]]
    return rows + [(None, 1, 1, "confirmed", "paid", None, None), ("", 1, 1, "confirmed", "paid", None, None)]


def _requests(rnd, acts):
    rows = []
    for k in range(300):
        ref = rnd.choice([None, "", "gone", "B7", f"B{rnd.randrange(30)}"])
        ask = (f"r{k:03d}", ref, T0 + dt.timedelta(rnd.randrange(4)), rnd.choice([None, "", "why"]))
        rows.append(ask + ((rnd.choice([0, 1, 2, 3, None]), rnd.choice(["passenger", "passenger", "staff", None])) if acts else ()))
    return rows + rows[:5]


def _model(bookings, requests, acts):
    out = []
    for b in bookings:
        by = [r for r in requests if b[0] is not None and r[1] == b[0] and b[3] in ("confirmed", "pending")
              and (not acts or r[5] != "passenger" or (r[4] is not None and r[4] == b[1]))]
        first = min(((r[2], r[0]) for r in by), default=None)
        for r in requests:
            if b[0] is None or r[1] != b[0]:
                continue
            if acts and r[5] == "passenger" and r[4] != b[1]:
                o = "access_denied"
            elif b[3] == "completed":
                o = "refused_completed"
            else:
                o = "cancelled" if first == (r[2], r[0]) else "already_cancelled"
            out.append((r[0], r[1], r[2], b[2], o))
    known = {b[0] for b in bookings if b[0] is not None}
    return out + [(r[0], r[1], r[2], None, "not_found") for r in requests if r[1] not in known]


@pytest.mark.parametrize("acts", [False, True])
def test_outcomes_on_odd_rows(shuffled, acts):
    rnd = random.Random(5)
    b, r = _bookings(rnd), _requests(rnd, acts)
    got = MU.cancel_bookings(shuffled.createDataFrame(b, BOOKINGS),
                             shuffled.createDataFrame(r, REQUESTS + (ACTORS if acts else ""))).outcomes
    assert got.columns == ["request_id", "booking_ref", "ts", "schedule_id", "outcome"]
    want = _model(b, r, acts)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert {"not_found", "cancelled", "already_cancelled", "refused_completed"} <= {w[4] for w in want}


@pytest.mark.parametrize("acts", [False, True])
def test_requests_and_bookings_are_exchanged_once(shuffled, acts):
    rnd = random.Random(5)
    c = MU.cancel_bookings(shuffled.createDataFrame(_bookings(rnd), BOOKINGS),
                           shuffled.createDataFrame(_requests(rnd, acts), REQUESTS + (ACTORS if acts else "")))
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        c.outcomes.explain()
    made = [line for line in buf.getvalue().splitlines() if "Exchange " in line and "ReusedExchange" not in line]
    assert len(made) == 2, made
