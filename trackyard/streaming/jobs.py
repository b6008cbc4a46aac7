"""Structured Streaming variants (STR1-STR5).

Sources are file streams over the driver tables (the rail stand-in views
are built on the streaming scan, so the same projections apply).  Sinks
are ``foreachBatch`` writers that put micro-batch ``N`` into
``<out>/batch_id=N`` with overwrite: a retried batch rewrites its own
folder, so output stays exactly-once with the checkpoint.  All folders live
under the shared ``spark.checkpoint.dir``.

No answer depends on how rows are dealt to files, batches or arrival times:

* Running totals (STR1, STR3, STR4) are additive: a batch writes its own
  sums per key, the reader adds them up, and ``COMPACT_EVERY`` batches are
  folded into one.  There is no watermark, so no row is ever too late.
* The outbox (STR5) drops repeated references: recent ones by the state store, older ones by the
  messages already written.
* Bookings and cancels (STR2) are decided by keyed state in event-time order: ``seat_state``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackyard.functions import expr as X
from trackyard.operators.skew import pick_per_key
from trackyard.operators.views import route_dim
from trackyard.session import scratch_path
from trackyard.sources.tables import RailTables, declared
from trackyard.streaming.batches import read_batches, read_totals, run_batches


class StreamingRail(RailTables):
    """Rail views whose ``stream`` tables are read with ``readStream``."""

    def __init__(self, spark: SparkSession, sf_dir: str, stream: Sequence[str],
                 max_files_per_trigger: int = 1, materialize: bool = False):
        super().__init__(spark, sf_dir, materialize)
        self.stream = set(stream)
        self.max_files = max_files_per_trigger

    def _stored(self, name: str, build) -> DataFrame:
        # views over a streamed table stay streaming; the rest use the stored tables
        if set(self.SOURCES[name]) & self.stream:
            return declared(name, build())
        return super()._stored(name, build)

    def raw(self, name: str) -> DataFrame:
        if name not in self.stream:
            return super().raw(name)
        path = f"{self.sf_dir.rstrip('/')}/{name}.parquet"
        schema = self.spark.read.parquet(path).schema
        # a one-character glob lets the file source watch this single file
        return (self.spark.readStream.schema(schema)
                .option("maxFilesPerTrigger", self.max_files)
                .parquet(path[:-1] + "[" + path[-1] + "]"))


COMPACT_EVERY = 50      # batches whose sums are folded into one


def run_totals(spark: SparkSession, stream: DataFrame, out: str, keys: Sequence[str],
               sums: Callable[[DataFrame], DataFrame], compact_every: int = COMPACT_EVERY) -> DataFrame:
    """Write ``sums`` (additive columns per key) of each batch; returns the totals."""
    def fold(batch_id: int) -> None:
        upto = batch_id + 1
        if upto % compact_every == 0:
            read_totals(spark, out, keys, upto).write.mode("overwrite").parquet(f"{out}-folds/upto={upto}")

    run_batches(stream, out, lambda df, _: sums(df), after=fold)
    return read_totals(spark, out, keys)


def _day(col: str):
    return F.to_date(F.col(col).cast("timestamp_ntz"))


# STR1: running occupancy per schedule, as changes that add up.
def occupancy_changes(events: DataFrame) -> DataFrame:
    """events: schedule_id, booking_status and optionally ``sign`` (1: a booking, -1: it was
    cancelled while in that status)."""
    sign = F.col("sign") if "sign" in events.columns else F.lit(1)
    st = F.col("booking_status")
    return events.groupBy("schedule_id").agg(
        F.sum(F.when(st.isin("confirmed", "completed"), sign).otherwise(0)).cast("bigint").alias("occupied"),
        F.sum(F.when(st == "pending", sign).otherwise(0)).cast("bigint").alias("reserved"))


def booking_events(bookings: DataFrame) -> DataFrame:
    """Stand-in events: every booking as made, and a cancel event for those that ended cancelled
    (they had been confirmed)."""
    cancelled = F.col("booking_status") == "cancelled"
    steps = F.when(cancelled, F.array(F.struct(F.lit("confirmed").alias("booking_status"), F.lit(1).alias("sign")),
                                      F.struct(F.lit("confirmed").alias("booking_status"), F.lit(-1).alias("sign")))) \
        .otherwise(F.array(F.struct("booking_status", F.lit(1).alias("sign"))))
    return bookings.select("schedule_id", F.explode(steps).alias("_e")).select("schedule_id", "_e.*")


def run_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = StreamingRail(spark, sf_dir, ["lineitem"])
    out = scratch_path(spark, "occupancy_stream")
    return run_totals(spark, booking_events(t.bookings), out, ["schedule_id"], occupancy_changes)


# STR3: request counts per user in 15-minute tumbling windows.
def window_counts(events: DataFrame, auth_types: Sequence[str] = ("signup",)) -> DataFrame:
    # windows over an instant align to UTC whatever the session zone
    e = events.withColumn("_ts", X.utc_instant("ts"))
    g = e.groupBy(F.window("_ts", "15 minutes").alias("w"), "user_id").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count(F.when(F.col("event_type").isin(*auth_types), 1)).alias("auth_requests"))
    return g.select(X.utc_wall("w.start").alias("window_start"), "user_id", "requests", "auth_requests")


def over_limits(counts: DataFrame, limit: int = 100, auth_limit: int = 10) -> DataFrame:
    return counts.select("*", (F.col("requests") > limit).alias("over_limit"),
                         (F.col("auth_requests") > auth_limit).alias("auth_over_limit"))


def rate_windows(events: DataFrame, limit: int = 100, auth_limit: int = 10,
                 auth_types: Sequence[str] = ("signup",)) -> DataFrame:
    return over_limits(window_counts(events, auth_types), limit, auth_limit)


def run_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = StreamingRail(spark, sf_dir, ["events"])
    out = scratch_path(spark, "rate_limit_stream")
    return over_limits(run_totals(spark, t.events, out, ["window_start", "user_id"], window_counts))


# STR4: paid revenue per day as bookings arrive.
def revenue_sums(bookings: DataFrame) -> DataFrame:
    b = bookings.where(F.col("payment_status") == "paid")
    return b.groupBy(_day("created_at").alias("report_date")).agg(
        F.count(F.lit(1)).alias("bookings"), F.sum("amount_paid").alias("revenue"))


def run_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = StreamingRail(spark, sf_dir, ["lineitem"])
    out = scratch_path(spark, "revenue_stream")
    return run_totals(spark, t.bookings, out, ["report_date"], revenue_sums).withColumn(
        "revenue", F.col("revenue").cast("double"))


# STR5: notification outbox for confirmed bookings (one set of messages per reference).
def outbox(bookings: DataFrame, schedules: DataFrame, routes: DataFrame, stations: DataFrame,
           users: DataFrame) -> DataFrame:
    """Messages of confirmed bookings, to the contacts that the booking names, else to the user's own."""
    b = bookings.where(F.col("booking_status") == "confirmed").dropDuplicates(["booking_ref"])
    rd = route_dim(routes, stations, ("name_en",)).select(
        F.col("id").alias("_rid"), "from_name_en", "to_name_en")
    s = schedules.select(F.col("id").alias("_sid"), F.col("route_id").alias("_srid"),
                         "travel_date", "departure_time").join(rd, F.col("_srid") == rd["_rid"])
    u = users.select(F.col("id").alias("_uid"), F.col("phone").alias("_phone"), F.col("email").alias("_email"))
    j = (b.join(s, b.schedule_id == s["_sid"], "inner")
         .join(u, b.user_id == u["_uid"], "left"))
    j = j.withColumns({c: F.coalesce(*([X.empty_to_null(c)] if c in b.columns else []), F.col(f"_{c}"))
                       for c in ("phone", "email")})
    amount = F.regexp_replace(F.col("amount_paid").cast("string"), r"\.?0+$", "")
    sms = F.struct(F.lit("sms").alias("type"), X.phone_e164("phone").alias("channel"),
                   F.lit(None).cast("string").alias("subject"),
                   X.confirmation_sms("booking_ref", "from_name_en", "to_name_en", "travel_date",
                                      "departure_time", "seat_number", amount).alias("message"))
    mail = F.struct(F.lit("email").alias("type"), F.col("email").alias("channel"),
                    X.confirmation_subject("booking_ref").alias("subject"),
                    F.concat(F.lit("Booking confirmation for "), F.col("booking_ref")).alias("message"))
    return X.notices(j, sms, mail, ["booking_ref", "created_at"]).withColumn("status", F.lit("pending"))


REPEATS = "7 days"      # of arrival, within which a repeated reference is known from the state store


def first_deliveries(bookings: DataFrame, repeats: str = REPEATS) -> DataFrame:
    """Confirmed bookings of a stream, each reference once within ``repeats`` of arrival.

    The clock is the arrival (the micro-batch's time, which a retried batch keeps), so no row is late
    however old its booking is; the state store forgets a reference after the horizon.
    """
    seen = bookings.where(F.col("booking_status") == "confirmed").withColumn("arrived", F.current_timestamp())
    return seen.withWatermark("arrived", repeats).dropDuplicatesWithinWatermark(["booking_ref"]).drop("arrived")


def run_outbox_stream(spark: SparkSession, bookings: DataFrame, schedules: DataFrame, routes: DataFrame,
                      stations: DataFrame, users: DataFrame, out: str, repeats: str = REPEATS) -> DataFrame:
    """Messages of new references per micro-batch.

    Repeats within the horizon end in the state store.  Older ones are looked up among the written
    messages: a repeated delivery carries the booking's own creation time, and the messages are stored in
    ranges of it, so only files of the batch's own span are read.  A batch writes at most
    ``spark.sql.shuffle.partitions`` files.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held: list[DataFrame] = []

    def release(_: int) -> None:
        while held:
            held.pop().unpersist()

    def process(df: DataFrame, batch_id: int) -> DataFrame:
        earlier = read_batches(spark, out)
        if earlier is not None:
            df = df.persist(StorageLevel.MEMORY_AND_DISK)      # the state is asked once for both uses
            held.append(df)
            span = df.agg(F.min("created_at").alias("low"), F.max("created_at").alias("high")).first()
            if span.low is not None:
                known = earlier.where((F.col("batch_id") < batch_id)
                                      & F.col("created_at").between(X.ntz(span.low), X.ntz(span.high)))
                df = df.join(known.select("booking_ref").distinct(), "booking_ref", "left_anti")
        return (outbox(df, schedules, routes, stations, users)
                .repartitionByRange(parts, "created_at").sortWithinPartitions("created_at"))

    run_batches(first_deliveries(bookings, repeats), out, process, after=release)
    return spark.read.parquet(out).drop("batch_id", "created_at")


def run_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = StreamingRail(spark, sf_dir, ["lineitem"])
    static = RailTables(spark, sf_dir)
    out = scratch_path(spark, "outbox_stream")
    return run_outbox_stream(spark, t.bookings, static.schedules, static.routes, static.stations,
                             static.users, out)


# SC11: notification log rows from outbox rows and delivery receipts.
def notification_log(outbox_rows: DataFrame, receipts: DataFrame) -> DataFrame:
    """outbox_rows: booking_ref, type, channel, subject, message (STR5);
    receipts: booking_ref, type, ts, ok, error.

    status 'sent' / 'failed' / 'pending' (no receipt); sent_at only when
    sent; a failed row carries the error as its message and error_msg, and
    a failed e-mail the generic subject, as the source logs them.  A
    receipt per (booking_ref, type) is expected; the latest one counts.
    """
    last = pick_per_key(receipts, ["booking_ref", "type"], ["ts"], last=True) \
        .select(F.col("booking_ref").alias("_rr"), F.col("type").alias("_rt"),
                F.col("ts").alias("_ts"), F.col("ok").alias("_ok"), F.col("error").alias("_err"))
    j = outbox_rows.join(last, (outbox_rows.booking_ref == last["_rr"])
                         & (outbox_rows.type == last["_rt"]), "left")
    status = (F.when(F.col("_ok").isNull(), "pending").when(F.col("_ok"), "sent")
              .otherwise("failed"))
    failed = status == "failed"
    return j.select(
        "booking_ref", "type", "channel",
        F.when(failed & (F.col("type") == "email"), F.lit("Booking confirmation"))
         .otherwise(F.col("subject")).alias("subject"),
        F.when(failed, F.col("_err")).otherwise(F.col("message")).alias("message"),
        status.alias("status"),
        F.when(status == "sent", F.col("_ts")).alias("sent_at"),
        F.when(failed, F.col("_err")).alias("error_msg"))


def notification_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("type", "status").agg(F.count(F.lit(1)).alias("notifications"))
