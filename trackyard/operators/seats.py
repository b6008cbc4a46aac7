"""Seat maps, car split, trip stats and batch seat admission (GEN1-3, ADM1)."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackyard.functions import expr as X
from trackyard.operators.skew import DEFAULT_SALT_BUCKETS
from trackyard.sources.schema import SEAT_HOLDING


def taken_seats(bookings: DataFrame, normalise: bool = False) -> DataFrame:
    """Distinct (schedule_id, seat) held by confirmed/pending bookings.

    The distinct is an aggregation, so a hot schedule is reduced map-side.
    ``normalise`` compares labels case/space-insensitively (database rule);
    the seat map page compares exact strings.
    """
    seat = X.seat_key("seat_number") if normalise else F.col("seat_number")
    return (bookings.where(F.col("booking_status").isin(*SEAT_HOLDING))
            .select("schedule_id", seat.alias("seat")).distinct())


def _seat_numbers(total) -> F.Column:
    return F.when(total >= 1, F.sequence(F.lit(1), total)).otherwise(
        F.array().cast("array<int>"))


# GEN1
def seat_map(schedules: DataFrame, bookings: DataFrame) -> DataFrame:
    """One row per seat 1..total_seats of every schedule, 'taken' or 'available'.

    A seat is taken when a confirmed or pending booking holds its label;
    completed bookings free the seat (source behaviour).
    """
    seats = schedules.select(F.col("id").alias("schedule_id"),
                             F.explode(_seat_numbers(F.col("total_seats"))).alias("seat_no"))
    seats = seats.withColumn("seat_id", X.seat_label("seat_no"))
    taken = taken_seats(bookings).withColumn("_t", F.lit(1))
    out = seats.join(taken, (seats.schedule_id == taken.schedule_id)
                     & (seats.seat_id == taken.seat), "left")
    return out.select(seats.schedule_id, "seat_no", "seat_id",
                      F.when(F.col("_t").isNotNull(), "taken").otherwise("available")
                       .alias("status"))


def seat_summary(schedules: DataFrame, bookings: DataFrame) -> DataFrame:
    """total and available = total - distinct taken labels (labels outside the
    map count too, as in the source)."""
    n = taken_seats(bookings).groupBy(F.col("schedule_id").alias("_sid")).agg(
        F.count(F.lit(1)).alias("_n"))
    s = schedules.select("id", "total_seats")
    out = s.join(n, s.id == n["_sid"], "left")
    return out.select(F.col("id").alias("schedule_id"), F.col("total_seats").alias("total"),
                      (F.col("total_seats") - F.coalesce("_n", F.lit(0))).alias("available"))


# GEN2
def car_occupancy(trips: DataFrame, cars: int | str = 3, premium_seats: int = 8) -> DataFrame:
    """Split each trip into cars of floor(total / cars) seats (remainder
    seats are dropped) and count occupied seats per car.

    Deterministic part of the source's map: seat ``sn`` is occupied when
    ``sn <= occupied`` or the trip is cancelled.  ``premium_free`` counts
    the first ``premium_seats`` seats of car 1 that are not occupied.
    Input columns: schedule_id, total_seats, occupied, status.
    """
    ncars = F.col(cars) if isinstance(cars, str) else F.lit(cars)
    spc = F.floor(F.col("total_seats") / ncars).cast("int")
    t = trips.select("schedule_id", "total_seats", "occupied", "status",
                     spc.alias("seats_per_car"),
                     F.explode(F.sequence(F.lit(0), ncars - 1)).alias("car"))
    start = F.col("car") * F.col("seats_per_car") + 1
    end = F.least(start + F.col("seats_per_car") - 1, F.col("total_seats"))
    t = t.select("*", start.alias("first_seat"), end.alias("last_seat"))
    seats = F.greatest(F.col("last_seat") - F.col("first_seat") + 1, F.lit(0))
    cancelled = F.col("status") == "cancelled"
    occ = F.when(cancelled, seats).otherwise(
        F.greatest(F.least(F.col("last_seat"), F.col("occupied")) - F.col("first_seat") + 1,
                   F.lit(0)))
    prem_hi = F.least(F.col("last_seat"), F.lit(premium_seats))
    prem = F.when(F.col("car") == 0, F.greatest(prem_hi - F.col("first_seat") + 1, F.lit(0))) \
        .otherwise(0)
    prem_occ = F.when(F.col("car") == 0, F.when(cancelled, prem).otherwise(
        F.greatest(F.least(prem_hi, F.col("occupied")) - F.col("first_seat") + 1, F.lit(0)))) \
        .otherwise(0)
    return t.select("schedule_id", (F.col("car") + 1).alias("car_no"), "first_seat",
                    "last_seat", seats.alias("seats"), occ.alias("occupied_seats"),
                    F.round(F.try_divide(occ.cast("double"), seats.cast("double")) * 100, 0)
                     .cast("int").alias("car_pct"),
                    (prem - prem_occ).alias("premium_free"))


# GEN3 (counts from bookings: occupied = confirmed + completed, reserved = pending)
def trip_stats(schedules: DataFrame, bookings: DataFrame) -> DataFrame:
    st = F.col("booking_status")
    per = bookings.groupBy(F.col("schedule_id").alias("_sid")).agg(
        F.count(F.when(st.isin("confirmed", "completed"), 1)).alias("_occ"),
        F.count(F.when(st == "pending", 1)).alias("_res"))
    s = schedules.select("id", "total_seats")
    j = s.join(per, s.id == per["_sid"], "left")
    occ = F.coalesce("_occ", F.lit(0))
    res = F.coalesce("_res", F.lit(0))
    pct = F.round(F.try_divide(occ.cast("double"), F.col("total_seats").cast("double")) * 100, 0)
    return j.select(F.col("id").alias("schedule_id"), F.col("total_seats"),
                    occ.alias("occupied"), res.alias("reserved"),
                    F.greatest(F.col("total_seats") - occ - res, F.lit(0)).alias("available"),
                    pct.cast("int").alias("occupancy_pct"),
                    X.occupancy_band(pct).alias("band"))


class Admission(NamedTuple):
    outcomes: DataFrame      # one row per request with its outcome
    accepted: DataFrame      # accepted requests as new booking rows
    deltas: DataFrame        # (schedule_id, delta) seat changes


OUTCOMES = ("not_found", "schedule_cancelled", "no_seats", "seat_taken", "accepted")


# ADM1
def admit_bookings(requests: DataFrame, schedules: DataFrame, bookings: DataFrame,
                   routes: DataFrame, salt_buckets: int = DEFAULT_SALT_BUCKETS,
                   keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> Admission:
    """Exact first-come seat admission for a batch of booking requests.

    Checks in source order: schedule missing -> cancelled -> no seats left
    -> seat already held (confirmed/pending, labels compared upper/trimmed)
    -> accepted at the class fare (SC1), which takes one seat.

    Set form, equal to a sequential replay ordered by (ts, request_id):
    a *candidate* is the first request for a (schedule, seat) whose seat is
    not held by a stored booking.  Non-candidates are never accepted, and
    the k-th candidate of a schedule is accepted iff k <= available_seats.
    So a request gets ``no_seats`` iff the schedule's available-th
    candidate comes before it.  That threshold is found per schedule by a
    top-k over candidates joined and ranked by (schedule, salt) (at most
    available_seats kept per salt); raw requests only pass through partial
    aggregations and two joins whose sides are exchanged for them alone, so
    AQE can split a hot schedule there.  The candidates are used three times;
    ``keep`` may store them, else each use derives them from the tables.
    """
    ordk = F.struct(F.col("ts"), F.col("request_id"))
    req = requests.withColumn("_seat", X.seat_key("seat_number"))

    held = taken_seats(bookings, normalise=True).select(
        F.col("schedule_id").alias("_hs"), F.col("seat").alias("_hseat"))
    # first request per (schedule, seat) whose seat is not held: the candidates
    first = req.groupBy("schedule_id", "_seat").agg(F.min(ordk).alias("_k"))
    free = keep(first.join(held, (first.schedule_id == held["_hs"]) & (first["_seat"] == held["_hseat"]),
                           "left_anti"))

    # the available-th candidate of each live schedule that has as many candidates
    # as seats, or more; its row is repeated per salt, so the join and the first
    # window are on (schedule, salt) and no task gets a whole schedule
    cand = free.select("schedule_id", F.col("_k.ts").alias("ts"),
                       F.col("_k.request_id").alias("request_id"))
    wanted = cand.groupBy(F.col("schedule_id").alias("_ws")).agg(F.count(F.lit(1)).alias("_wanted"))
    live = schedules.where((F.col("status") != "cancelled") & (F.col("available_seats") > 0))
    full = (live.join(wanted, live.id == wanted["_ws"], "inner")
            .where(F.col("_wanted") >= F.col("available_seats"))
            .select(F.col("id").alias("_lid"), F.col("available_seats").alias("_avail"),
                    F.explode(F.sequence(F.lit(0), F.lit(salt_buckets - 1))).alias("_lsalt")))
    c2 = cand.withColumn("_salt", F.pmod(F.xxhash64("request_id"), F.lit(salt_buckets)).cast("int"))
    c2 = c2.join(full, (c2.schedule_id == full["_lid"]) & (c2["_salt"] == full["_lsalt"]), "inner")
    w1 = Window.partitionBy("schedule_id", "_salt").orderBy("ts", "request_id")
    pruned = c2.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= F.col("_avail"))
    w2 = Window.partitionBy("schedule_id").orderBy("ts", "request_id")
    ranked = pruned.withColumn("_rank", F.row_number().over(w2))
    threshold = (ranked.where(F.col("_rank") == F.col("_avail"))
                 .select(F.col("schedule_id").alias("_ts_sid"), F.col("ts").alias("_t_ts"),
                         F.col("request_id").alias("_t_id")))

    # one row per schedule with everything the outcome needs (fare and threshold
    # included): requests are joined with schedules once
    prices = routes.select(F.col("id").alias("_prid"), "price_first_class", "price_economy",
                           "price_student")
    sched = (schedules.join(prices, schedules.route_id == prices["_prid"], "left")
             .select(F.col("id").alias("_sid"), F.col("status").alias("_status"),
                     F.col("available_seats").alias("_avail"),
                     X.fare_for_class("class", "price_first_class", "price_economy",
                                      "price_student").alias("_fare")))
    sched = sched.join(threshold, sched["_sid"] == threshold["_ts_sid"], "left")

    # candidate flag per request: it is the first free request of its seat
    f2 = free.select(F.col("schedule_id").alias("_fs"), F.col("_seat").alias("_fseat"),
                     F.col("_k").alias("_fk"))
    r = req.join(f2, (req.schedule_id == f2["_fs"]) & (req["_seat"] == f2["_fseat"]), "left")
    r = r.withColumn("_cand", F.coalesce(F.col("_fk") == ordk, F.lit(False)))
    r = r.join(sched, r.schedule_id == sched["_sid"], "left")
    after_t = F.col("_t_ts").isNotNull() & (
        (F.col("ts") > F.col("_t_ts")) | ((F.col("ts") == F.col("_t_ts"))
                                          & (F.col("request_id") > F.col("_t_id"))))
    outcome = (F.when(F.col("_sid").isNull(), "not_found")
               .when(F.col("_status") == "cancelled", "schedule_cancelled")
               .when((F.col("_avail") <= 0) | after_t, "no_seats")
               .when(~F.col("_cand"), "seat_taken")
               .otherwise("accepted"))
    r = r.withColumn("outcome", outcome)
    outcomes = r.select("request_id", "ts", "user_id", "schedule_id", "seat_number",
                        "payment_method", "outcome",
                        F.when(F.col("outcome") == "accepted", F.col("_fare")).alias("amount_paid"))
    return admission_parts(outcomes)


def admission_parts(outcomes: DataFrame) -> Admission:
    """Accepted rows and seat deltas derived from an outcome table (which may
    be a written table, cutting lineage)."""
    acc = outcomes.where(F.col("outcome") == "accepted").select(
        "request_id", "ts", "user_id", "schedule_id", "seat_number", "payment_method",
        "amount_paid")
    deltas = acc.groupBy("schedule_id").agg((-F.count(F.lit(1))).alias("delta"))
    return Admission(outcomes, acc, deltas)


def admission_result(adm: Admission) -> DataFrame:
    """Outcome per request with the fare of accepted ones (NULL otherwise)."""
    return adm.outcomes.select("request_id", "schedule_id", "seat_number", "outcome",
                               "amount_paid")
