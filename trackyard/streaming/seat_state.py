"""STR2: bookings and cancellations decided as they arrive, with seat state per schedule.

One stream of requests, keyed by groups of about ``GROUP`` schedules (a call into Python costs
milliseconds, so a key is worth several trips).  The state store holds for each schedule that was asked for: free seats, held seats, what the stream did to its bookings, and the requests that
wait for their turn.  A request waits until the watermark has passed its time; an event-time
timer then releases a schedule's requests in (ts, request_id) order, so the answer depends
neither on files nor on batches nor on arrival times within the watermark's delay.  A request
that comes later than that is decided on arrival, after everything released before; none is lost (``never_late``).

A schedule's state begins with the stored tables as they are when the stream first starts
(``trips``, one row per schedule; ``refs``, one per stored booking, for cancels), written once
beside the checkpoint.  From then on the state alone decides: no earlier outcome is read back.
State ends ``retention`` after departure; requests for such a trip are 'departed'.

Memory: the state and waiting requests of one group at a time.  One schedule is sequential by
definition; groups run in parallel over ``spark.sql.shuffle.partitions`` state stores.  Requests and outcomes
cross into Python as one JSON column each.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trackyard.functions import expr as X
from trackyard.operators.replay import Trip
from trackyard.session import tell_workers
from trackyard.sources.schema import SEAT_HOLDING
from trackyard.sources.tables import Storage
from trackyard.streaming.batches import run_batches

# of pandas, about how Spark joins the frames that a stateful operator yields
warnings.filterwarnings("ignore", message="The behavior of DataFrame concatenation", category=FutureWarning)

REQUEST = ("kind string, request_id string, ts timestamp_ntz, schedule_id long, seat_number string, booking_ref string")
OUTCOME = ("request_id string, kind string, schedule_id long, seat_number string, booking_ref string, outcome string, "
           "amount_paid decimal(10,2)")
COLUMNS = [c.split()[0] for c in OUTCOME.split(", ")]
GROUP = 128            # schedules that share a key of the state store
SPREAD = 64           # keys that requests without a schedule are dealt to
#: "everything has arrived": the last instant that a finite stream can name
END = "2199-01-01 00:00:00"


def never_late() -> Column:
    """Spark drops late rows before a stateful operator by the column that carries the watermark; behind
    the watermark's own column this one carries it on, and no row is late by it."""
    return F.lit("2261-01-01 00:00:00").cast("timestamp").alias("clock", metadata={"spark.watermarkDelayMs": 0})


def trips(schedules: DataFrame, bookings: DataFrame, routes: DataFrame, retention_days: int | None) -> DataFrame:
    """What a schedule's state begins with: status, free seats, fare, held seats and when its state may go."""
    prices = routes.select(F.col("id").alias("_rid"), "price_first_class", "price_economy", "price_student")
    seats = (bookings.where(F.col("booking_status").isin(*SEAT_HOLDING))
             .groupBy(F.col("schedule_id").alias("_hid"), X.seat_key("seat_number").alias("seat"))
             .agg(F.count(F.lit(1)).alias("n")))
    # one entry per seat of the trip, as JSON
    held = seats.groupBy("_hid").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("seat", "n")))).alias("held"))
    departure = F.concat(F.col("travel_date").cast("string"), F.lit(" "), F.col("departure_time")).cast("timestamp_ntz")
    end = F.lit(None).cast("long") if retention_days is None else \
        F.unix_micros(X.utc_instant(departure)) + retention_days * 86_400_000_000
    rows = (schedules.join(prices, schedules.route_id == prices["_rid"], "left")
            .join(held, schedules.id == held["_hid"], "left"))
    return rows.select(F.col("id").alias("trip"), F.col("status").alias("trip_status"), F.col("available_seats").alias("free"),
                       X.fare_for_class("class", "price_first_class", "price_economy", "price_student")
                       .cast("decimal(10,2)").alias("fare"), "held", end.alias("ends"))


def refs(bookings: DataFrame) -> DataFrame:
    """Where a cancel finds a stored booking."""
    return bookings.select(F.col("booking_ref").alias("ref"), F.col("schedule_id").alias("ref_trip"),
                           F.col("booking_status").alias("ref_status"),
                           X.seat_key("seat_number").alias("ref_seat")).dropDuplicates(["ref"])


class Seats:
    """State of one schedule: its trip, the requests that wait, when the state may go."""

    def __init__(self, trip: Trip, waiting: list, ends: int | None):
        self.trip, self.waiting, self.ends = trip, waiting, ends

    def dump(self) -> list:
        t = self.trip
        return [t.schedule_id, t.free, {k: n for k, n in t.held.items() if n}, t.refs, self.waiting, self.ends]

    @classmethod
    def load(cls, sid: int, free: int, held: dict, known: dict, waiting: list, ends: int | None) -> Seats:
        trip = Trip(sid, free)
        trip.held.update(held)
        trip.refs = {k: tuple(v) for k, v in known.items()}
        return cls(trip, waiting, ends)

    def timer(self) -> int | None:
        """When there is something to do next."""
        return min((w[0] for w in self.waiting), default=self.ends)

    def release(self, before: int) -> Iterator[tuple]:
        """Decide the waiting requests of times before ``before`` (microseconds), in request order."""
        self.waiting.sort(key=lambda w: (w[0], w[1]))
        while self.waiting and self.waiting[0][0] < before:
            at, rid, kind, label, seat, ref, status, old_seat, fare = self.waiting.pop(0)
            if self.ends is not None and at > self.ends:
                outcome = "departed"
            elif kind == "book":
                outcome = self.trip.book(rid, seat)
            else:
                if ref not in self.trip.refs and status is not None:
                    self.trip.refs[ref] = (status, old_seat)      # held seats of stored bookings are counted already
                outcome = self.trip.cancel(ref)
            yield rid, kind, self.trip.schedule_id, label, ref, outcome, fare if outcome == "accepted" else None


def decide(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Take in the new requests of a group of schedules, release those whose time has come, set the next timer."""
    held = {v[0]: Seats.load(*v) for v in json.loads(state.get[0])} if state.exists else {}
    now = max(0, state.getCurrentWatermarkMs())
    out: list[tuple] = []
    for pdf in frames:
        for r in map(json.loads, pdf["request"]):
            kind, rid, sid, label, ref = (r.get(c) for c in ("kind", "request_id", "schedule_id", "seat_number", "booking_ref"))
            ends = r.get("ends")
            early = None
            if kind == "tick":
                continue
            if r.get("trip_status") is None:
                early = "not_found"
            elif r["trip_status"] == "cancelled" and kind == "book":
                early = "schedule_cancelled"
            elif sid not in held and ends is not None and ends < now * 1000:
                early = "departed"
            if early:
                out.append((rid, kind, sid, label, ref, early, None))
                continue
            if sid not in held:
                held[sid] = Seats.load(sid, r["free"], json.loads(r.get("held", "{}")), {}, [], ends)
            held[sid].waiting.append([r["at"], rid, kind, label, r.get("seat"), ref, r.get("ref_status"), r.get("ref_seat"),
                                      r.get("fare")])
    for sid, mine in list(held.items()):
        out += mine.release(now * 1000)
        if not mine.waiting and mine.ends is not None and mine.ends < now * 1000:
            del held[sid]
    if held:
        state.update((json.dumps([s.dump() for s in held.values()]),))
        if timers := [t for s in held.values() if (t := s.timer()) is not None]:
            state.setTimeoutTimestamp(max(now + 1, min(timers) // 1000))
    elif state.exists:
        state.remove()
    if out:
        yield pd.DataFrame({"outcome": [json.dumps(dict(zip(COLUMNS, o))) for o in out]})


def find_refs(asked: DataFrame, ref_rows: DataFrame) -> DataFrame:
    """Cancels with their stored booking; requests without a reference meet none, and are spread by their own id."""
    spread = F.coalesce(asked.booking_ref, asked.request_id)
    return asked.join(ref_rows, (asked.kind == "cancel") & (asked.booking_ref == ref_rows.ref) & (spread == ref_rows.ref), "left")


def outcomes(requests: DataFrame, trip_rows: DataFrame, ref_rows: DataFrame | None, groups: int, delay: str) -> DataFrame:
    """The streaming decision on ``requests`` (``REQUEST``): a streaming DataFrame of ``OUTCOME``."""
    asked = (requests.withColumn("_at", X.utc_instant("ts")).withWatermark("_at", delay)
             .select("kind", "request_id", "schedule_id", "seat_number", "booking_ref", X.seat_key("seat_number").alias("seat"),
                     F.coalesce(F.unix_micros("_at"), F.lit(-(1 << 62))).alias("at"), never_late()))
    if ref_rows is not None:
        asked = find_refs(asked, ref_rows)
        asked = asked.withColumn("schedule_id", F.coalesce("ref_trip", "schedule_id")).drop("ref", "ref_trip")
    asked = asked.join(trip_rows, asked.schedule_id == trip_rows.trip, "left").drop("trip")
    key = F.when(F.col("trip_status").isNotNull(), F.pmod(F.xxhash64("schedule_id"), F.lit(groups))) \
        .otherwise(-1 - F.pmod(F.xxhash64("request_id"), F.lit(SPREAD)))
    rows = asked.select(key.alias("key"), "clock", F.to_json(F.struct(
        *[c for c in asked.columns if c not in ("clock", "fare")], F.col("fare").cast("string").alias("fare"))).alias("request"))
    done = rows.groupBy("key").applyInPandasWithState(decide, "outcome string", "state string", "append",
                                                      GroupStateTimeout.EventTimeTimeout)
    text = OUTCOME.replace("decimal(10,2)", "string")
    return done.select(F.from_json("outcome", text).alias("o")).select("o.*").withColumn(
        "amount_paid", F.col("amount_paid").cast("decimal(10,2)"))


def _once(df: DataFrame, path: str) -> DataFrame:
    """Written by the first start of a stream; later starts read what it wrote."""
    df.write.mode("ignore").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run(spark: SparkSession, requests: DataFrame, schedules: DataFrame, bookings: DataFrame, routes: DataFrame, out: str,
        cancels: bool = True, upto: str | None = END, delay: str = "0 seconds", retention_days: int | None = None) -> DataFrame:
    """Run the stream over what has arrived and return all outcomes so far.

    requests: a streaming DataFrame with the columns of ``REQUEST``.  A book request's id is the
    reference of its booking.  A cancel of a stored booking needs only the reference; one of a
    booking made on this stream also names its schedule.  ``cancels``: False where the
    stream holds book requests only.

    ``upto``: all requests up to then have arrived; they are decided even if no later request moves
    the watermark (a tick row does).  None: what the watermark has not passed keeps waiting in
    the state for the next run.  ``delay``: how long a request is waited for.  ``retention_days`` after
    departure a trip's state ends (None: never).
    """
    tell_workers(spark)
    trip_rows = _once(trips(schedules, bookings, routes, retention_days), f"{out}/trips")
    ref_rows = _once(refs(bookings), f"{out}/refs") if cancels else None
    # fixed by the first start, as the keys of the state are
    groups = int(Storage(spark).read_marker(f"{out}/groups") or Storage(spark).write_marker(
        f"{out}/groups", str(max(1, -(-trip_rows.count() // GROUP)))))
    blank = spark.createDataFrame([], REQUEST)
    blank.write.mode("ignore").parquet(f"{out}/ticks/none")
    names = blank.columns
    missing = {c: F.lit(None).cast(blank.schema[c].dataType) for c in names if c not in requests.columns}

    def start() -> None:
        ticks = spark.readStream.schema(REQUEST).option("recursiveFileLookup", "true").parquet(f"{out}/ticks")
        both = requests.withColumns(missing).select(*names).unionByName(ticks)
        run_batches(outcomes(both, trip_rows, ref_rows, groups, delay), f"{out}/outcomes")

    start()
    if upto is not None:
        tick = spark.createDataFrame([("tick", f"tick-{upto}")], "kind string, request_id string").select(
            *[F.col(c) if c in ("kind", "request_id") else F.lit(None).cast(blank.schema[c].dataType).alias(c) for c in names])
        at = X.ntz(upto) + F.expr(f"INTERVAL {delay}") + F.expr("INTERVAL 1 SECOND")
        tick.withColumn("ts", at).coalesce(1).write.mode("ignore").parquet(f"{out}/ticks/upto={upto.replace(':', '-')}")
        start()
    return spark.read.schema(OUTCOME).parquet(f"{out}/outcomes").select(*COLUMNS)
