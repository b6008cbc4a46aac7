"""Star-schema views (joins and projections).

Join order is written dimension-first: routes are enriched with their two
role-played stations before the fact side joins them once, so the large
side (schedules, bookings) meets one join per step.  No broadcast hints:
the planner broadcasts a side only when its size estimate (file stats, or
AQE's runtime shuffle size) is under ``autoBroadcastJoinThreshold``; above
that it falls back to a shuffle join, and AQE splits skewed partitions.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackyard.sources.schema import TRAVELLED


def _station_role(stations: DataFrame, role: str, cols=("code", "name_en", "name_ar")) -> DataFrame:
    return stations.select(F.col("id").alias(f"_{role}_sid"),
                           *[F.col(c).alias(f"{role}_{c}") for c in cols])


def route_dim(routes: DataFrame, stations: DataFrame,
              station_cols=("code", "name_en", "name_ar")) -> DataFrame:
    """Routes with from/to station attributes (``from_code``, ``to_name_en`` ...)."""
    f = _station_role(stations, "from", station_cols)
    t = _station_role(stations, "to", station_cols)
    return (routes.join(f, routes.from_station_id == f["_from_sid"], "inner")
            .join(t, routes.to_station_id == t["_to_sid"], "inner")
            .drop("_from_sid", "_to_sid"))


# JN1 / PRJ1
def schedule_view(schedules: DataFrame, routes: DataFrame, stations: DataFrame) -> DataFrame:
    """Schedules joined to their route and both stations (inner joins), with the declared
    notes and times where the snapshot carries them."""
    rest = [c for c in ("notes", "created_at", "updated_at") if c in schedules.columns]
    rd = route_dim(routes, stations).select(
        F.col("id").alias("_rid"), "route_code", "distance_km", "duration_minutes",
        "price_first_class", "price_economy", "price_student",
        F.col("from_name_en").alias("from_name_en"), "from_name_ar", "from_code",
        "to_name_en", "to_name_ar", "to_code")
    return (schedules.join(rd, schedules.route_id == rd["_rid"], "inner")
            .select("id", "train_id", "departure_time", "arrival_time", "travel_date",
                    "total_seats", "available_seats", "class", "status", "delay_minutes",
                    "route_id", "route_code", "distance_km", "duration_minutes",
                    "price_first_class", "price_economy", "price_student",
                    "from_name_en", "from_name_ar", "from_code",
                    "to_name_en", "to_name_ar", "to_code", *rest))


# JN2 / PRJ2
def booking_view(bookings: DataFrame, schedules: DataFrame, routes: DataFrame,
                 stations: DataFrame) -> DataFrame:
    """Bookings with trip, route and station columns (5-way inner join), with the declared
    passenger, QR and cancel columns where the snapshot carries them."""
    rest = [c for c in ("id", "passenger_first", "passenger_last", "national_id", "phone", "email", "qr_ref",
                        "cancelled_at") if c in bookings.columns]
    rd = route_dim(routes, stations).select(
        F.col("id").alias("_rid"), "from_name_en", "from_name_ar", "from_code",
        "to_name_en", "to_name_ar", "to_code")
    trip = (schedules.select(F.col("id").alias("_sid"), F.col("route_id").alias("_srid"),
                             "train_id", "departure_time", "arrival_time", "travel_date",
                             "class")
            .join(rd, F.col("_srid") == rd["_rid"], "inner"))
    v = bookings.join(trip, bookings.schedule_id == trip["_sid"], "inner")
    return v.select(
        "booking_ref", "user_id", "schedule_id", "seat_number", "amount_paid",
        "payment_method", "payment_status", "booking_status", "created_at",
        "train_id", "departure_time", "arrival_time", "travel_date", "class",
        F.col("from_name_en").alias("from_en"), F.col("from_name_ar").alias("from_ar"),
        "from_code", F.col("to_name_en").alias("to_en"), F.col("to_name_ar").alias("to_ar"),
        "to_code", *rest)


# JN3 + JN8
def user_view(users: DataFrame, permissions: DataFrame, bookings: DataFrame) -> DataFrame:
    """Users, their permission row (left join) and booking totals.

    total_bookings counts bookings whose status is not 'cancelled';
    total_spent sums amount_paid of paid bookings (0 when none).  The
    bookings side is aggregated per user first (partial aggregation absorbs a
    hot user), so the join is one-row-per-user on both sides.
    """
    per_user = bookings.groupBy(F.col("user_id").alias("_uid")).agg(
        F.count(F.when(F.col("booking_status") != "cancelled", 1)).alias("_nb"),
        F.sum(F.when(F.col("payment_status") == "paid", F.col("amount_paid"))).alias("_spent"))
    p = permissions.withColumnRenamed("user_id", "_puid")
    v = (users.join(p, users.id == p["_puid"], "left")
         .join(per_user, users.id == per_user["_uid"], "left"))
    perm_cols = [c for c in permissions.columns if c != "user_id"]
    return v.select(
        *users.columns, *perm_cols,
        F.coalesce(F.col("_nb"), F.lit(0)).cast("bigint").alias("total_bookings"),
        F.coalesce(F.col("_spent"), F.lit(0)).cast("double").alias("total_spent"))


# JN5: station touch -- one row per (route, station) whether the station is
# the route's origin or destination; a route with from = to yields one row.
def station_touch(routes: DataFrame) -> DataFrame:
    return routes.select(
        F.col("id").alias("route_id"),
        F.explode(F.array_distinct(F.array("from_station_id", "to_station_id")))
         .alias("station_id"))


# JN6 + JN7
def route_view(routes: DataFrame, stations: DataFrame, schedules: DataFrame,
               bookings: DataFrame, as_of: dt.date) -> DataFrame:
    """Routes with both stations, upcoming trip count and confirmed bookings.

    upcoming_trips = schedules of the route with travel_date >= as_of (any
    status); total_bookings = bookings with status 'confirmed' on any trip of
    the route.  Both are pre-aggregated (the correlated-subquery form), so no
    join fans out.
    """
    rd = route_dim(routes, stations, ("id", "code", "name_en", "name_ar", "city_en", "city_ar"))
    upcoming = (schedules.where(F.col("travel_date") >= F.lit(as_of))
                .groupBy(F.col("route_id").alias("_ur")).agg(F.count(F.lit(1)).alias("_up")))
    per_sched = (bookings.where(F.col("booking_status") == "confirmed")
                 .groupBy(F.col("schedule_id").alias("_bs")).agg(F.count(F.lit(1)).alias("_n")))
    per_route = (schedules.select(F.col("id").alias("_sid"), F.col("route_id").alias("_br"))
                 .join(per_sched, F.col("_sid") == F.col("_bs"), "inner")
                 .groupBy("_br").agg(F.sum("_n").alias("_tb")))
    v = (rd.join(upcoming, rd.id == upcoming["_ur"], "left")
         .join(per_route, rd.id == per_route["_br"], "left"))
    return v.select(
        "id", "route_code", "distance_km", "duration_minutes", "price_first_class",
        "price_economy", "price_student", "active",
        F.col("from_id"), "from_code", F.col("from_name_en").alias("from_en"),
        F.col("from_name_ar").alias("from_ar"), "from_city_en", "from_city_ar",
        F.col("to_id"), "to_code", F.col("to_name_en").alias("to_en"),
        F.col("to_name_ar").alias("to_ar"), "to_city_en", "to_city_ar",
        F.coalesce(F.col("_up"), F.lit(0)).cast("bigint").alias("upcoming_trips"),
        F.coalesce(F.col("_tb"), F.lit(0)).cast("bigint").alias("total_bookings"))


# SRC2: keyed lookup of many keys at once; found = 0 marks not-found keys.
def lookup(view: DataFrame, key_col: str, keys: DataFrame, keys_key: str | None = None) -> DataFrame:
    keys_key = keys_key or key_col
    v = view.withColumn("_found", F.lit(1))
    if keys_key == key_col:
        out = keys.join(v, key_col, "left")
    else:
        out = keys.join(v, keys[keys_key] == v[key_col], "left").drop(v[key_col])
    return out.withColumn("found", F.coalesce(F.col("_found"), F.lit(0))).drop("_found")


def booking_lookup(keys: DataFrame, bookings: DataFrame, schedules: DataFrame, routes: DataFrame,
                   stations: DataFrame, columns: Sequence[str]) -> DataFrame:
    """SRC2 over the booking star: the keys (booking_ref) meet the bookings first, and only bookings
    that were asked for meet trips, routes and stations."""
    asked = bookings.join(keys.select("booking_ref").distinct(), "booking_ref", "left_semi")
    return lookup(booking_view(asked, schedules, routes, stations).select("booking_ref", *columns), "booking_ref", keys)


FEW = 100       # references that are put into the scan's filter


def find_bookings(refs: Sequence[str], bookings: DataFrame, schedules: DataFrame, routes: DataFrame,
                  stations: DataFrame) -> DataFrame:
    """SRC2 for references at hand (one request of the application asks for one): the booking view of those
    that exist.  Up to ``FEW`` go into the scan as equalities, which the row groups' bloom filters answer
    without reading them; more meet the bookings as a table."""
    refs = sorted(set(refs))
    ref = F.col("booking_ref")
    if len(refs) <= FEW:
        asked = F.lit(False)
        for r in refs:
            asked = asked | (ref == r)
        found = bookings.where(asked)
    else:
        keys = bookings.sparkSession.createDataFrame([(r,) for r in refs], "booking_ref string")
        found = bookings.join(keys, "booking_ref", "left_semi")
    return booking_view(found, schedules, routes, stations)


def travelled(bookings: DataFrame) -> DataFrame:
    """Bookings that count as passengers (confirmed or completed)."""
    return bookings.where(F.col("booking_status").isin(*TRAVELLED))
