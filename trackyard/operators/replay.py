"""Bookings and cancellations decided one after the other (ADM1 with SNK12).

Freed seats can be sold again at once, so the order of requests decides
and no set form exists: each schedule's requests are replayed in (ts,
request_id) order.  Rows are dealt by schedule and sorted; a task streams
over them and holds the seat state of one schedule at a time, never its
requests.  Schedules are independent; one schedule is sequential by
definition.  Requests of cancelled or unknown schedules and cancels of
unknown references are decided by joins alone and not replayed.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackyard.functions import expr as X
from trackyard.session import tell_workers
from trackyard.sources.schema import SEAT_HOLDING

RESULT = ("request_id string, kind string, schedule_id long, seat_number string, booking_ref string, "
          "outcome string, amount_paid decimal(10,2)")


class Trip:
    """Seat state of one schedule."""

    def __init__(self, schedule_id: int, free: int):
        self.schedule_id, self.free = schedule_id, free
        self.held: Counter = Counter()
        self.refs: dict[str, tuple[str, str]] = {}          # reference -> (status, seat)

    def store(self, ref: str, status: str, seat: str) -> None:
        self.refs[ref] = (status, seat)
        if status in SEAT_HOLDING:
            self.held[seat] += 1

    def book(self, ref: str, seat: str) -> str:
        if self.free <= 0:
            return "no_seats"
        if self.held[seat]:
            return "seat_taken"
        self.free -= 1
        self.store(ref, "confirmed", seat)
        return "accepted"

    def cancel(self, ref: str) -> str:
        status, seat = self.refs.get(ref, (None, None))
        if status is None:
            return "not_found"
        if status in ("cancelled", "completed"):
            return "already_cancelled" if status == "cancelled" else "refused_completed"
        if status in SEAT_HOLDING:
            self.held[seat] -= 1
        self.refs[ref] = ("cancelled", seat)
        self.free += 1
        return "cancelled"


def replay(requests: DataFrame, schedules: DataFrame, bookings: DataFrame, routes: DataFrame) -> DataFrame:
    """Outcome of each request (``RESULT``).

    requests: kind, request_id, ts, schedule_id, seat_number (book), booking_ref
    (cancel); bookings: booking_ref, schedule_id, seat_number, booking_status.
    """
    tell_workers(requests.sparkSession)
    prices = routes.select(F.col("id").alias("_rid"), "price_first_class", "price_economy", "price_student")
    trips = (schedules.join(prices, schedules.route_id == prices["_rid"], "left")
             .select(F.col("id").alias("_sid"), F.col("status").alias("_status"),
                     F.col("available_seats").alias("_free"),
                     X.fare_for_class("class", "price_first_class", "price_economy", "price_student")
                     .cast("decimal(10,2)").alias("_fare")))
    seat = X.seat_key("seat_number").alias("_seat")
    books = requests.where("kind = 'book'")
    known = bookings.select(F.col("booking_ref").alias("_ref"), F.col("schedule_id").alias("_ref_sid")).unionByName(
        books.select(F.col("request_id").alias("_ref"), F.col("schedule_id").alias("_ref_sid"))).dropDuplicates(["_ref"])
    cancels = requests.where("kind = 'cancel'").drop("schedule_id", "seat_number")
    cancels = (cancels.join(known, cancels.booking_ref == known["_ref"], "left")
               .select("request_id", "ts", "kind", F.col("_ref_sid").alias("schedule_id"),
                       F.lit(None).cast("string").alias("seat_number"), F.lit(None).cast("string").alias("_seat"),
                       "booking_ref"))
    asked = books.select("request_id", "ts", "kind", "schedule_id", "seat_number", seat,
                         F.lit(None).cast("string").alias("booking_ref")).unionByName(cancels)
    asked = asked.join(trips, asked.schedule_id == trips["_sid"], "left")
    early = (F.when(F.col("_sid").isNull(), "not_found")
             .when((F.col("_status") == "cancelled") & (F.col("kind") == "book"), "schedule_cancelled"))
    asked = asked.withColumn("outcome", early)
    decided = asked.where(F.col("outcome").isNotNull()).select(
        "request_id", "kind", "schedule_id", "seat_number", "booking_ref", "outcome",
        F.lit(None).cast("decimal(10,2)").alias("amount_paid"))

    open_ = asked.where(F.col("outcome").isNull()).select(
        F.lit(1).alias("step"), "ts", "request_id", "kind", "schedule_id", "seat_number", "_seat", "booking_ref",
        F.lit(None).cast("string").alias("status"), "_free", "_fare")
    stored = bookings.join(open_.select("schedule_id").distinct(), "schedule_id", "left_semi").select(
        F.lit(0).alias("step"), F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit("").alias("request_id"),
        F.lit("stored").alias("kind"), "schedule_id", "seat_number", seat, "booking_ref",
        F.col("booking_status").alias("status"), F.lit(None).cast("int").alias("_free"),
        F.lit(None).cast("decimal(10,2)").alias("_fare"))
    rows = open_.unionByName(stored)
    parts = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a hash of the key: a plain key could pass for the joins' own partitioning, and the exchange
    # be left out, though adaptive execution may change that partitioning afterwards
    rows = rows.repartition(parts, F.xxhash64("schedule_id")).sortWithinPartitions("schedule_id", "step", "ts", "request_id")

    def run(batches):
        trip = None
        for pdf in batches:
            out = []
            for step, rid, kind, sid, label, key, ref, status, free, fare in zip(
                    pdf["step"], pdf["request_id"], pdf["kind"], pdf["schedule_id"], pdf["seat_number"],
                    pdf["_seat"], pdf["booking_ref"], pdf["status"], pdf["_free"], pdf["_fare"]):
                if trip is None or trip.schedule_id != sid:
                    trip = Trip(sid, None)
                if step == 0:
                    trip.store(ref, status, key)
                    continue
                if trip.free is None:
                    trip.free = int(free)
                outcome = trip.book(rid, key) if kind == "book" else trip.cancel(ref)
                out.append((rid, kind, sid, label, ref, outcome, fare if outcome == "accepted" else None))
            yield pd.DataFrame(out, columns=["request_id", "kind", "schedule_id", "seat_number", "booking_ref",
                                             "outcome", "amount_paid"])

    return decided.unionByName(rows.mapInPandas(run, RESULT))
