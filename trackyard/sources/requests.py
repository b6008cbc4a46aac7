"""Stand-in request tables derived from the driver tables.

These only produce rows in the schema an operator expects (booking
attempts, cancel requests, patches, new rows); the operators do all the
work and rely on nothing about how these rows are made.  Every builder
reads whole tables, so the request volume grows with the data.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackyard.functions import expr as X
from trackyard.sources.tables import AS_OF, RailTables

AS_OF_TS = dt.datetime(AS_OF.year, AS_OF.month, AS_OF.day)


def history_and_requests(t: RailTables) -> tuple[DataFrame, DataFrame]:
    """Split bookings in time: rows created before ``AS_OF`` are the stored
    history; rows created from ``AS_OF`` on arrive as booking requests."""
    b = t.bookings
    history = b.where(F.col("created_at") < X.ntz(AS_OF_TS))
    reqs = b.where(F.col("created_at") >= X.ntz(AS_OF_TS)).select(
        F.col("booking_ref").alias("request_id"),
        F.col("created_at").alias("ts"),
        "user_id", "schedule_id", "seat_number", "payment_method")
    return history, reqs


def cancel_requests(t: RailTables) -> DataFrame:
    """One cancel request per booking a day after creation, a repeat request
    for cash bookings, and requests for references that do not exist (one
    per event)."""
    b = t.bookings
    first = b.select(F.concat(F.lit("C1-"), "booking_ref").alias("request_id"), "booking_ref",
                     (F.col("created_at") + F.expr("INTERVAL 1 DAY")).alias("ts"),
                     F.lit(None).cast("string").alias("reason"))
    again = (b.where(F.col("payment_method") == "cash")
             .select(F.concat(F.lit("C2-"), "booking_ref").alias("request_id"), "booking_ref",
                     (F.col("created_at") + F.expr("INTERVAL 2 DAY")).alias("ts"),
                     F.lit("repeat").alias("reason")))
    unknown = t.events.select(
        F.concat(F.lit("CE-"), F.col("event_id").cast("string")).alias("request_id"),
        F.concat(F.lit("BK-E"), F.col("event_id").cast("string")).alias("booking_ref"),
        F.col("ts"), F.col("event_type").alias("reason"))
    return first.unionByName(again).unionByName(unknown)


def owner_cancel_requests(t: RailTables) -> DataFrame:
    """Two cancel requests per booking with their actor: the first by another
    passenger (visa), a staff member (cash) or the owner, the second by the owner."""
    b = t.bookings
    method = F.col("payment_method")
    none = F.lit(None).cast("string").alias("reason")
    first = b.select(F.concat(F.lit("A-"), "booking_ref").alias("request_id"), "booking_ref",
                     (F.col("created_at") + F.expr("INTERVAL 1 DAY")).alias("ts"), none,
                     (F.col("user_id") + F.when(method == "visa", 1).otherwise(0)).alias("actor_id"),
                     F.when(method == "cash", "staff").otherwise("passenger").alias("actor_role"))
    again = b.select(F.concat(F.lit("B-"), "booking_ref").alias("request_id"), "booking_ref",
                     (F.col("created_at") + F.expr("INTERVAL 2 DAY")).alias("ts"), none,
                     F.col("user_id").alias("actor_id"), F.lit("passenger").alias("actor_role"))
    return first.unionByName(again)


def permission_rows(t: RailTables) -> DataFrame:
    """New permission rows: staff get reports access, admins everything;
    several rows per user (one per event of the user), last one wins."""
    e = t.events.select(F.col("user_id"), "ts", "event_id", "event_type")
    u = t.users.select(F.col("id").alias("user_id"), "role")
    j = e.join(u, "user_id", "inner")
    adm = F.col("role") == "admin"
    # permission flags arrive as booleans and are stored 0/1 (SC18)
    return j.select(
        "user_id",
        X.flag01(adm | (F.col("role") == "staff")).alias("can_schedules"),
        X.flag01(F.lit(True)).alias("can_bookings"),
        X.flag01(adm).alias("can_routes"), X.flag01(adm).alias("can_users"),
        X.flag01(F.col("event_type") == "purchase").alias("can_reports"),
        X.flag01(adm & (F.col("event_type") != "error")).alias("can_pricing"),
        "ts", "event_id")


def route_rows(t: RailTables) -> DataFrame:
    """New routes, one per supplier, some of them not valid."""
    k = F.col("s_suppkey")
    price = F.col("s_acctbal").cast("decimal(10,2)")
    return t.raw("supplier").select(
        k.alias("id"), F.when(k % 9 == 0, "").otherwise(F.concat(F.lit("NR-"), k.cast("string"))).alias("route_code"),
        F.col("s_nationkey").alias("from_station_id"), (F.col("s_nationkey") + 1).alias("to_station_id"),
        (k % 5).cast("decimal(8,2)").alias("distance_km"), (k % 4).cast("int").alias("duration_minutes"),
        price.alias("price_first_class"), price.alias("price_economy"),
        F.lit(None).cast("decimal(10,2)").alias("price_student"))


def user_rows(t: RailTables) -> DataFrame:
    """New users, one per event, some of them not valid."""
    k, kind = F.col("event_id"), F.col("event_type")
    return t.events.select(
        k.alias("id"), F.when(kind == "click", "no address").otherwise(
            F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@example.com"))).alias("email"),
        F.substring(F.concat(F.lit("pw"), k.cast("string")), F.lit(1), (5 + k % 3).cast("int")).alias("password"),
        F.when(kind == "error", "").otherwise("New").alias("first_name"), F.lit("User").alias("last_name"),
        F.when(kind == "view", "guest").otherwise("staff").alias("role"),
        F.when(k % 2 == 0, F.concat(F.lit("+9665"), (k + 10000000).cast("string"))).otherwise("none").alias("phone"),
        F.when(k % 3 != 0, F.substring((k + 10000000000).cast("string"), F.lit(1), (9 + k % 2).cast("int")))
         .alias("national_id"))


def tokens(t: RailTables) -> DataFrame:
    """Refresh tokens: one per event, valid 30 days."""
    return t.events.select(
        F.concat(F.lit("tok-"), F.col("event_id").cast("string")).alias("token"),
        "user_id", F.col("ts").alias("created_at"),
        (F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("expires_at"))


def notifications(t: RailTables) -> DataFrame:
    """Logged notifications: one per event, some of a type or status that is not declared or without a channel."""
    kind, k = F.col("event_type"), F.col("event_id")
    return t.events.select(
        k.alias("id"), "user_id", F.when(kind == "purchase", F.floor(k / 2) * 8 + 1).cast("long").alias("booking_id"),
        F.when(kind == "click", "sms").when(kind == "view", "email").when(kind == "error", "fax").otherwise("push").alias("type"),
        F.when(kind != "signup", F.concat(F.lit("channel-"), F.col("user_id").cast("string"))).alias("channel"),
        F.when(kind == "view", F.repeat(F.lit("subject "), (k % 40).cast("int"))).alias("subject"),
        F.concat(F.lit("message "), k.cast("string")).alias("message"),
        F.when(kind == "purchase", "queued").when(kind == "error", "failed").otherwise("sent").alias("status"),
        F.col("ts").alias("created_at"))
