"""Dashboard aggregations (AGG1-AGG15, LIM2-LIM4, SET1).

Pattern used throughout: aggregate the big fact table to one row per
schedule first (partial aggregation absorbs hot schedules), then join the
much smaller aggregates to the dimensions.  Conditional aggregation keeps
several KPIs in one scan.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackyard.functions import expr as X
from trackyard.operators import skew
from trackyard.operators.views import route_dim, station_touch, travelled


def _day(col: str):
    return F.to_date(F.col(col))


def _cnt(cond):
    return F.count(F.when(cond, 1))


def _sum_if(cond, val):
    return F.sum(F.when(cond, val).otherwise(0))


# AGG1
def overview_trips(schedules: DataFrame, as_of: dt.date) -> DataFrame:
    """Trips of the day: counts by status, occupied seats and capacity.

    Cancelled trips count in occupied/capacity (as in the source).
    """
    s = schedules.where(F.col("travel_date") == F.lit(as_of))
    st = F.col("status")
    return s.agg(
        F.countDistinct("id").alias("trips_today"),
        F.coalesce(_sum_if(st == "active", 1), F.lit(0)).cast("bigint").alias("on_time"),
        F.coalesce(_sum_if(st == "delayed", 1), F.lit(0)).cast("bigint").alias("delayed"),
        F.coalesce(_sum_if(st == "cancelled", 1), F.lit(0)).cast("bigint").alias("cancelled"),
        F.coalesce(F.sum(F.col("total_seats") - F.col("available_seats")), F.lit(0))
         .cast("bigint").alias("total_occupied"),
        F.coalesce(F.sum("total_seats"), F.lit(0)).cast("bigint").alias("total_capacity"))


# AGG2
def overview_revenue(bookings: DataFrame, as_of: dt.date, same_year: bool = False) -> DataFrame:
    """Revenue KPIs of paid bookings.

    revenue_month compares only the month number (any year) by default, as
    the source does; ``same_year=True`` gives the calendar month.
    """
    b = bookings.where(F.col("payment_status") == "paid")
    today = _day("created_at") == F.lit(as_of)
    month = F.month("created_at") == F.lit(as_of.month)
    if same_year:
        month = month & (F.year("created_at") == F.lit(as_of.year))
    amt = F.col("amount_paid")
    return b.agg(
        F.coalesce(_sum_if(today, amt), F.lit(0)).cast("double").alias("revenue_today"),
        F.coalesce(_sum_if(month, amt), F.lit(0)).cast("double").alias("revenue_month"),
        _cnt(F.col("booking_status") == "confirmed").alias("active_bookings"),
        _cnt(today).alias("bookings_today"))


# AGG3
def overview_users(users: DataFrame, as_of: dt.date) -> DataFrame:
    u = users.where(F.col("status") == "active")
    r = F.col("role")
    return u.agg(
        F.count(F.lit(1)).alias("total_users"),
        _cnt(r == "passenger").alias("passengers"),
        _cnt(r == "staff").alias("staff"),
        _cnt(r == "admin").alias("admins"),
        _cnt(_day("created_at") == F.lit(as_of)).alias("new_today"))


# AGG4
def overview(schedules: DataFrame, bookings: DataFrame, users: DataFrame,
             as_of: dt.date, same_year: bool = False) -> DataFrame:
    """One flat row with all day KPIs and the occupancy percentage.

    The three one-row aggregates are stacked (unionByName) and folded with
    ``max`` per column -- three rows in, one row out, no join.
    """
    parts = [overview_trips(schedules, as_of), overview_revenue(bookings, as_of, same_year),
             overview_users(users, as_of)]
    stacked = parts[0].unionByName(parts[1], allowMissingColumns=True) \
        .unionByName(parts[2], allowMissingColumns=True)
    cols = [c for p in parts for c in p.columns]
    one = stacked.agg(*[F.max(c).alias(c) for c in cols])
    occ = F.when(F.col("total_capacity") > 0,
                 X.pct("total_occupied", "total_capacity")).otherwise(F.lit(0.0))
    return one.withColumn("occupancy_pct", occ)


# AGG5
def revenue_trend(bookings: DataFrame, as_of: dt.date, days: int = 7,
                  fill: bool = False) -> DataFrame:
    """Paid bookings per creation day from ``as_of - days`` on (no upper bound).

    Days without bookings are absent unless ``fill``; then a calendar from
    the window start to the last booking day supplies zero rows.
    """
    start = X.trailing_start(as_of, days)
    b = bookings.where((F.col("payment_status") == "paid")
                       & (F.col("created_at") >= start.cast("timestamp_ntz")))
    per_day = b.groupBy(_day("created_at").alias("report_date")).agg(
        F.count(F.lit(1)).alias("bookings"),
        F.coalesce(F.sum("amount_paid"), F.lit(0)).cast("double").alias("revenue"))
    if fill:
        last = per_day.select(F.max("report_date")).scalar()
        cal = per_day.sparkSession.range(1).select(
            F.explode(F.sequence(start, F.greatest(start, F.coalesce(last, start))))
             .alias("report_date"))
        per_day = (cal.join(per_day, "report_date", "left")
                   .select("report_date",
                           F.coalesce("bookings", F.lit(0)).cast("bigint").alias("bookings"),
                           F.coalesce("revenue", F.lit(0.0)).alias("revenue")))
    return per_day.orderBy("report_date")


def _per_schedule_travelled(bookings: DataFrame) -> DataFrame:
    return travelled(bookings).groupBy("schedule_id").agg(
        F.count(F.lit(1)).alias("n_pax"),
        F.sum("amount_paid").alias("revenue"))


# AGG6 / AGG15
def route_performance(routes: DataFrame, stations: DataFrame, schedules: DataFrame,
                      bookings: DataFrame) -> DataFrame:
    """Per route: trips, passengers, revenue and the fan-out load average.

    Source semantics: routes LEFT JOIN schedules LEFT JOIN travelled
    bookings, AVG(load%) over the joined rows -- a trip with k bookings weighs
    max(k, 1); a route without trips has NULL load.  Computed without the
    fan-out: bookings -> one row per schedule, schedules -> one row per route
    with sum(load * w) / sum(w).
    """
    per_s = _per_schedule_travelled(bookings)
    load = F.try_divide((F.col("total_seats") - F.col("available_seats")).cast("double"),
                        F.col("total_seats").cast("double")) * 100
    s = (schedules.select(F.col("id").alias("_sid"), "route_id", load.alias("_load"))
         .join(per_s, F.col("_sid") == per_s.schedule_id, "left")
         .select("_sid", "route_id", "_load",
                 F.coalesce("n_pax", F.lit(0)).alias("_k"), F.col("revenue").alias("_rev")))
    w = F.greatest(F.col("_k"), F.lit(1))
    per_route = s.groupBy(F.col("route_id").alias("_rr")).agg(
        F.count(F.lit(1)).alias("_trips"),
        F.sum("_k").alias("_pax"),
        F.sum("_rev").alias("_revenue"),
        F.sum(F.when(F.col("_load").isNotNull(), F.col("_load") * w)).alias("_lw"),
        F.sum(F.when(F.col("_load").isNotNull(), w)).alias("_w"))
    rd = route_dim(routes, stations, ("name_en",))
    out = rd.join(per_route, rd.id == per_route["_rr"], "left")
    return out.select(
        "route_code",
        F.col("from_name_en").alias("from_en"), F.col("to_name_en").alias("to_en"),
        F.coalesce("_trips", F.lit(0)).cast("bigint").alias("total_trips"),
        F.coalesce("_pax", F.lit(0)).cast("bigint").alias("total_passengers"),
        F.coalesce("_revenue", F.lit(0)).cast("double").alias("total_revenue"),
        F.round(F.try_divide(F.col("_lw"), F.col("_w")), 1).alias("avg_load_pct"),
    ).orderBy(F.desc("total_revenue"), "route_code")


# AGG7 / PRJ3 (+ SC14 band)
def occupancy_live(schedules: DataFrame, routes: DataFrame, stations: DataFrame,
                   as_of: dt.date) -> DataFrame:
    s = schedules.where(F.col("travel_date") == F.lit(as_of))
    rd = route_dim(routes, stations, ("name_en", "name_ar")).select(
        F.col("id").alias("_rid"), "from_name_en", "from_name_ar", "to_name_en", "to_name_ar")
    occ = F.col("total_seats") - F.col("available_seats")
    v = s.join(rd, s.route_id == rd["_rid"], "inner").select(
        "id", "train_id", "departure_time", "arrival_time", "status", "class",
        "total_seats", "available_seats", occ.alias("occupied"),
        X.pct(occ, "total_seats").alias("occupancy_pct"),
        F.col("from_name_en").alias("from_en"), F.col("from_name_ar").alias("from_ar"),
        F.col("to_name_en").alias("to_en"), F.col("to_name_ar").alias("to_ar"))
    return v.withColumn("band", X.occupancy_band("occupancy_pct")) \
            .orderBy("departure_time", "id")


# AGG8 / JN5 / LIM2
def top_stations(stations: DataFrame, routes: DataFrame, schedules: DataFrame,
                 bookings: DataFrame, n: int = 10) -> DataFrame:
    """Stations by travelled bookings on routes touching them (from or to).

    A route whose from and to are the same station counts once, as the OR
    join does.  Ties are broken by station code.
    """
    per_s = travelled(bookings).groupBy("schedule_id").agg(F.count(F.lit(1)).alias("_n"))
    per_r = (schedules.select(F.col("id").alias("_sid"), "route_id")
             .join(per_s, F.col("_sid") == per_s.schedule_id, "inner")
             .groupBy("route_id").agg(F.sum("_n").alias("_n")))
    per_st = (station_touch(routes).join(per_r, "route_id", "inner")
              .groupBy("station_id").agg(F.sum("_n").alias("total_passengers")))
    out = stations.join(per_st, stations.id == per_st.station_id, "inner").select(
        "code", "name_en", "name_ar", F.col("total_passengers").cast("bigint"))
    return out.orderBy(F.desc("total_passengers"), "code").limit(n)


# AGG9
def page_info(df: DataFrame, page: int = 1, limit: int = 20) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        F.lit(page).alias("page"), F.lit(limit).alias("limit"), "total",
        F.ceil(F.col("total") / F.lit(limit)).cast("bigint").alias("pages"))


# AGG10
def booking_summary(bookings: DataFrame) -> DataFrame:
    st = F.col("booking_status")
    return bookings.agg(
        F.count(F.lit(1)).alias("total"),
        _cnt(st == "confirmed").alias("confirmed"),
        _cnt(st == "cancelled").alias("cancelled"),
        F.coalesce(F.sum(F.when(F.col("payment_status") == "paid", F.col("amount_paid"))),
                   F.lit(0)).cast("double").alias("revenue"))


# AGG11
def passenger_summary(bookings: DataFrame, schedules: DataFrame, as_of: dt.date) -> DataFrame:
    """Per passenger: bookings not cancelled, confirmed, upcoming confirmed, spent.

    Bookings are aggregated per user without a join; only confirmed ones meet
    the schedules on or after ``as_of``, for the upcoming count."""
    st = F.col("booking_status")
    mine = bookings.groupBy("user_id").agg(
        _cnt(st != "cancelled").alias("total"), _cnt(st == "confirmed").alias("confirmed"),
        F.coalesce(F.sum(F.when(F.col("payment_status") == "paid", F.col("amount_paid"))),
                   F.lit(0)).cast("double").alias("spent"))
    ahead = schedules.where(F.col("travel_date") >= F.lit(as_of)).select(F.col("id").alias("_sid"))
    b = bookings.where(st == "confirmed").select(F.col("user_id").alias("_uid"), "schedule_id")
    up = (b.join(ahead, b.schedule_id == ahead["_sid"]).groupBy("_uid")
          .agg(F.count(F.lit(1)).alias("_up")))
    j = mine.join(up, mine.user_id.eqNullSafe(up["_uid"]), "left")
    return j.select("user_id", "total", "confirmed", F.coalesce("_up", F.lit(0)).cast("bigint").alias("upcoming"), "spent")


# AGG12
def occupancy_by_class(schedules: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    s = schedules if as_of is None else schedules.where(F.col("travel_date") == F.lit(as_of))
    g = s.groupBy("class").agg(
        F.count(F.lit(1)).alias("trips"),
        F.sum(F.col("total_seats") - F.col("available_seats")).cast("bigint").alias("occupied"),
        F.sum("total_seats").cast("bigint").alias("capacity"))
    return g.withColumn("occupancy_pct", X.pct("occupied", "capacity"))


# AGG13
def station_route_counts(stations: DataFrame, routes: DataFrame) -> DataFrame:
    per = station_touch(routes).groupBy("station_id").agg(F.count(F.lit(1)).alias("_n"))
    out = stations.join(per, stations.id == per.station_id, "left")
    return out.select("id", "code", "name_en",
                      F.coalesce("_n", F.lit(0)).cast("bigint").alias("route_count"))


# AGG14
def period_change(bookings: DataFrame, as_of: dt.date, days: int = 7) -> DataFrame:
    """Paid revenue and bookings of the last ``days`` days (ending ``as_of``)
    against the ``days`` days before, with percentage change (NULL if the
    previous period is empty)."""
    d = _day("created_at")
    cur_lo = F.date_sub(F.lit(as_of), days - 1)
    prev_lo = F.date_sub(F.lit(as_of), 2 * days - 1)
    b = bookings.where((F.col("payment_status") == "paid")
                       & (F.col("created_at") >= prev_lo.cast("timestamp_ntz"))
                       & (F.col("created_at") < F.date_add(F.lit(as_of), 1).cast("timestamp_ntz")))
    cur = d >= cur_lo
    g = b.agg(
        F.coalesce(_sum_if(cur, F.col("amount_paid")), F.lit(0)).cast("double").alias("revenue_current"),
        F.coalesce(_sum_if(~cur, F.col("amount_paid")), F.lit(0)).cast("double").alias("revenue_previous"),
        _cnt(cur).alias("bookings_current"),
        _cnt(~cur).alias("bookings_previous"))
    return g.select("*",
                    X.pct(F.col("revenue_current") - F.col("revenue_previous"),
                          "revenue_previous").alias("revenue_change_pct"),
                    X.pct(F.col("bookings_current") - F.col("bookings_previous"),
                          "bookings_previous").alias("bookings_change_pct"))


# LIM3
def departure_board(schedule_view_df: DataFrame, as_of: dt.date, n: int = 5) -> DataFrame:
    s = schedule_view_df.where(F.col("travel_date") == F.lit(as_of))
    return s.select(
        "id", "departure_time", "train_id", "from_name_en", "to_name_en", "status",
        X.route_label("from_name_en", "to_name_en").alias("route_label"),
        X.delay_label("status", "delay_minutes").alias("status_label"),
        X.train_status_label("status", "ar").alias("status_ar"),
    ).orderBy("departure_time", "id").limit(n)


# LIM4
def recent_bookings(bookings: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` newest bookings of every user (ties by reference)."""
    b = bookings.select("user_id", "booking_ref", "schedule_id", "seat_number",
                        "booking_status", "created_at")
    return skew.top_n_per_group(b, ["user_id"],
                                [F.desc("created_at"), F.desc("booking_ref")], n,
                                salt_on=["booking_ref"])


# SET1
def activity_feed(bookings: DataFrame, schedules: DataFrame, users: DataFrame,
                  as_of: dt.date, n: int = 20) -> DataFrame:
    """Newest ``n`` activities up to ``as_of``: new bookings, cancellations,
    delayed/cancelled trips (at their travel date) and new users."""
    end = F.date_add(F.lit(as_of), 1).cast("timestamp_ntz")
    bk = bookings.select(F.col("created_at").alias("ts"),
                         F.when(F.col("booking_status") == "cancelled", "booking_cancelled")
                          .otherwise("booking_created").alias("kind"),
                         F.col("booking_ref").alias("ref"))
    if "cancelled_at" in bookings.columns:      # a cancellation counts at its own time
        bk = bk.withColumn("kind", F.lit("booking_created")).unionByName(
            bookings.where(F.col("cancelled_at").isNotNull()).select(
                F.col("cancelled_at").alias("ts"), F.lit("booking_cancelled").alias("kind"),
                F.col("booking_ref").alias("ref")))
    sc = (schedules.where(F.col("status").isin("delayed", "cancelled"))
          .select(F.col("travel_date").cast("timestamp_ntz").alias("ts"),
                  F.concat(F.lit("schedule_"), F.col("status")).alias("kind"),
                  F.col("id").cast("string").alias("ref")))
    us = users.select(F.col("created_at").cast("timestamp_ntz").alias("ts"),
                      F.lit("user_created").alias("kind"), F.col("email").alias("ref"))
    feed = bk.unionByName(sc).unionByName(us).where(F.col("ts") < end)
    return feed.orderBy(F.desc("ts"), "kind", "ref").limit(n)


# AGG15 / SC15 / SC17: route cards (load, trips, tier, labels).
def route_cards(perf: DataFrame, routes: DataFrame, high: float = 70, med: float = 50) -> DataFrame:
    r = routes.select("route_code", "duration_minutes", "active")
    j = perf.join(r, "route_code", "left")
    return j.select(
        "route_code", X.route_label("from_en", "to_en").alias("route_label"),
        "total_trips", "avg_load_pct",
        X.tier("avg_load_pct", high, med).alias("tier"),
        X.thousands("total_revenue", 0).alias("revenue_label"),
        X.minutes_to_hours("duration_minutes").alias("duration_hours"),
        X.short_code("from_en").alias("from_short"), X.short_code("to_en").alias("to_short"),
        F.when(F.col("active") == 1, "Active").otherwise("Inactive").alias("active_label"))


# SC19: staff alerts for the day's cancelled and delayed trips.
def staff_alerts(schedule_view_df: DataFrame, as_of: dt.date) -> DataFrame:
    s = schedule_view_df.where((F.col("travel_date") == F.lit(as_of))
                               & F.col("status").isin("cancelled", "delayed"))
    msg = (F.when(F.col("status") == "cancelled",
                  F.concat(F.col("train_id"), F.lit(" cancelled")))
           .otherwise(F.concat(F.col("train_id"), F.lit(" delayed "),
                               F.col("delay_minutes").cast("string"), F.lit("min"))))
    return s.select("id", "train_id", "departure_time", X.alert_level("status").alias("level"),
                    msg.alias("message"),
                    F.concat(X.route_label("from_name_en", "to_name_en"), F.lit(" "),
                             F.substring("departure_time", 1, 5)).alias("detail"),
                    X.delay_label("status", "delay_minutes").alias("status_label"))


# SC16: activity per shift of day (local time).
def activity_by_shift(events: DataFrame, lang: str = "en") -> DataFrame:
    return (events.groupBy(X.shift_of_day("ts", lang).alias("shift"), "event_type")
            .agg(F.count(F.lit(1)).alias("events")))
