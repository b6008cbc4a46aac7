"""Registered streaming queries (STR1-STR5).  Each runs its stream to
completion (availableNow) and returns the sink table; the oracle is the
batch answer the stream must converge to."""

import datetime as dt

from pyspark.sql import functions as F

from trackyard.functions import expr as X
from trackyard.operators.replay import replay
from trackyard.plans.q_seats import ADMISSION_SQL
from trackyard.plans.registry import REGISTRY, Query, output
from trackyard.plans.rail_sql import with_rail
from trackyard.session import scratch_path
from trackyard.streaming import jobs as J
from trackyard.streaming import seat_state as SS


def _register(name, fn, sql, doc):
    REGISTRY[name] = Query(name, lambda spark, d: output(fn(spark, d)),
                           None if sql is None else with_rail(sql), doc)


_register("stream_occupancy", J.run_occupancy, """
SELECT schedule_id, COUNT(CASE WHEN booking_status IN ('confirmed', 'completed') THEN 1 END) AS occupied,
       COUNT(CASE WHEN booking_status = 'pending' THEN 1 END) AS reserved
FROM bookings GROUP BY schedule_id
""", "STR1: running occupancy per schedule from booking and cancel events (additive changes).")

_register("stream_rate_limit", J.run_rate_limit, """
SELECT CAST(time_bucket(INTERVAL 15 MINUTE, ts) AS TIMESTAMP) AS window_start, user_id,
       COUNT(*) AS requests, COUNT(CASE WHEN event_type = 'signup' THEN 1 END) AS auth_requests,
       COUNT(*) > 100 AS over_limit, COUNT(CASE WHEN event_type = 'signup' THEN 1 END) > 10 AS auth_over_limit
FROM events GROUP BY 1, 2
""", "STR3: requests per user in 15-minute tumbling windows with limit flags.")

_register("stream_revenue_daily", J.run_revenue, """
SELECT CAST(created_at AS DATE) AS report_date, COUNT(*) AS bookings, CAST(SUM(amount_paid) AS DOUBLE) AS revenue
FROM bookings WHERE payment_status = 'paid' GROUP BY 1
""", "STR4: paid revenue per day from additive sums of every micro-batch.")

_OUTBOX_SQL = """
, b AS (SELECT DISTINCT ON (booking_ref) * FROM bookings WHERE booking_status = 'confirmed'),
j AS (
  SELECT b.booking_ref, b.seat_number, b.amount_paid, s.travel_date, s.departure_time,
         st1.name_en AS from_en, st2.name_en AS to_en, coalesce(b.phone, u.phone) AS phone, coalesce(b.email, u.email) AS email
  FROM b JOIN schedules s ON s.id = b.schedule_id JOIN routes r ON r.id = s.route_id
  JOIN stations st1 ON st1.id = r.from_station_id JOIN stations st2 ON st2.id = r.to_station_id
  LEFT JOIN users u ON u.id = b.user_id
)
SELECT booking_ref, 'sms' AS type,
       CASE WHEN phone LIKE '+%' THEN phone ELSE concat('+966', substring(phone, 2)) END AS channel,
       CAST(NULL AS VARCHAR) AS subject,
       concat('RailWay SA: Booking confirmed ✅', chr(10), 'Ref: ', booking_ref, chr(10), from_en, ' → ', to_en,
              chr(10), 'Date: ', CAST(travel_date AS VARCHAR), ' at ', departure_time, chr(10), 'Seat: ', seat_number,
              chr(10), 'SAR ', regexp_replace(CAST(amount_paid AS VARCHAR), '\\.?0+$', ''), chr(10), 'تم تأكيد حجزك') AS message,
       'pending' AS status
FROM j WHERE phone IS NOT NULL
UNION ALL
SELECT booking_ref, 'email', email, concat('Booking Confirmed — ', booking_ref, ' | تأكيد الحجز'),
       concat('Booking confirmation for ', booking_ref), 'pending'
FROM j WHERE email IS NOT NULL
"""

_register("stream_outbox", J.run_outbox, _OUTBOX_SQL,
          "STR5/SC9/SC10: SMS and e-mail outbox rows per confirmed booking, deduplicated.")


START = dt.datetime(1998, 6, 15)
# the stand-in requests come in any order, and years before or after the trip
TIMES = {"delay": "3650 days", "retention_days": 3650}


def _split(t):
    """(stored bookings, bookings that arrive as requests)."""
    return t.where(F.col("created_at") < X.ntz(START)), t.where(F.col("created_at") >= X.ntz(START))


def _book_requests(bookings):
    return _split(bookings)[1].select(F.lit("book").alias("kind"), F.col("booking_ref").alias("request_id"),
                                      F.col("created_at").alias("ts"), "schedule_id", "seat_number",
                                      F.lit(None).cast("string").alias("booking_ref"))


def _cancel_requests(bookings):
    """Bookings that ended cancelled are cancelled a day after they were made; stored bookings of the
    last week get a cancel request too."""
    made, week = F.col("created_at"), X.ntz(START - dt.timedelta(days=7))
    asked = bookings.where(((made >= X.ntz(START)) & (F.col("booking_status") == "cancelled"))
                           | ((made >= week) & (made < X.ntz(START))))
    return asked.select(F.lit("cancel").alias("kind"), F.concat(F.lit("X-"), "booking_ref").alias("request_id"),
                        (made + F.expr("INTERVAL 1 DAY")).alias("ts"), "schedule_id",
                        F.lit(None).cast("string").alias("seat_number"), "booking_ref")


def _run_admission(spark, sf_dir):
    t = J.StreamingRail(spark, sf_dir, ["lineitem"])
    static = J.RailTables(spark, sf_dir)
    done = SS.run(spark, _book_requests(t.bookings), static.schedules, _split(static.bookings)[0], static.routes,
                  scratch_path(spark, "admission_stream"), cancels=False, **TIMES)
    return done.select("request_id", "schedule_id", "seat_number", "outcome", "amount_paid")


_register("stream_admission", _run_admission, ADMISSION_SQL + """
SELECT request_id, schedule_id, seat_number, outcome,
       CASE WHEN outcome = 'accepted' THEN fare END AS amount_paid
FROM res
""", "STR2: seat admission of a request stream, decided by keyed state as requests arrive.")


def _rate_limit_batch(spark, sf_dir):
    return J.rate_windows(J.RailTables(spark, sf_dir).events)


_register("rate_limit", _rate_limit_batch, """
SELECT CAST(time_bucket(INTERVAL 15 MINUTE, ts) AS TIMESTAMP) AS window_start, user_id,
       COUNT(*) AS requests, COUNT(CASE WHEN event_type = 'signup' THEN 1 END) AS auth_requests,
       COUNT(*) > 100 AS over_limit, COUNT(CASE WHEN event_type = 'signup' THEN 1 END) > 10 AS auth_over_limit
FROM events GROUP BY 1, 2
""", "STR3 (batch): requests per user in 15-minute tumbling windows with limit flags.")


def _run_booking_stream(spark, sf_dir):
    t = J.StreamingRail(spark, sf_dir, ["lineitem"])
    static = J.RailTables(spark, sf_dir)
    asked = _book_requests(t.bookings).unionByName(_cancel_requests(t.bookings))
    return SS.run(spark, asked, static.schedules, _split(static.bookings)[0], static.routes,
                  scratch_path(spark, "booking_stream"), **TIMES)


def _bookings_cancels(spark, sf_dir):
    t = J.RailTables(spark, sf_dir)
    asked = _book_requests(t.bookings).unionByName(_cancel_requests(t.bookings).withColumn(
        "schedule_id", F.lit(None).cast("long")))
    return replay(asked, t.schedules, _split(t.bookings)[0], t.routes)


_BOOKINGS_CANCELS_SQL = """
, ask AS (
  SELECT 'book' AS kind, booking_ref AS request_id, created_at AS ts, booking_ref AS ref, schedule_id AS sid, seat_number
  FROM bookings WHERE created_at >= TIMESTAMP '1998-06-15'
  UNION ALL
  SELECT 'cancel', concat('X-', booking_ref), created_at + INTERVAL 1 DAY, booking_ref, schedule_id, NULL
  FROM bookings WHERE created_at >= TIMESTAMP '1998-06-08'
                  AND (created_at < TIMESTAMP '1998-06-15' OR booking_status = 'cancelled')
), ev AS (
  SELECT ask.*, upper(rtrim(b.seat_number)) AS seat, b.created_at < TIMESTAMP '1998-06-15' AS old, b.booking_status AS old_status,
         row_number() OVER (PARTITION BY ask.sid ORDER BY ask.ts, ask.request_id) AS k
  FROM ask JOIN (SELECT DISTINCT ON (booking_ref) * FROM bookings ORDER BY booking_ref, created_at) b ON b.booking_ref = ask.ref
), st AS (
  SELECT s.id AS sid, CAST(0 AS BIGINT) AS k, s.available_seats AS free,
         COALESCE((SELECT list(upper(rtrim(b.seat_number))) FROM bookings b
                   WHERE b.schedule_id = s.id AND b.created_at < TIMESTAMP '1998-06-15'
                     AND b.booking_status IN ('confirmed', 'pending')), CAST([] AS VARCHAR[])) AS held,
         CAST([] AS VARCHAR[]) AS sold, CAST([] AS VARCHAR[]) AS gone, CAST(NULL AS VARCHAR) AS request_id,
         CAST(NULL AS VARCHAR) AS outcome
  FROM schedules s WHERE s.id IN (SELECT sid FROM ev)
  UNION ALL
  SELECT sid, k, free + CASE outcome WHEN 'accepted' THEN -1 WHEN 'cancelled' THEN 1 ELSE 0 END,
         CASE WHEN outcome = 'accepted' THEN list_append(held, seat)
              WHEN outcome = 'cancelled' AND list_contains(held, seat)
                THEN list_concat(held[:list_position(held, seat) - 1], held[list_position(held, seat) + 1:])
              ELSE held END,
         CASE WHEN outcome = 'accepted' THEN list_append(sold, ref) ELSE sold END,
         CASE WHEN outcome = 'cancelled' THEN list_append(gone, ref) ELSE gone END, request_id, outcome
  FROM (SELECT st.sid, ev.k, st.free, st.held, st.sold, st.gone, ev.seat, ev.ref, ev.request_id,
               CASE WHEN ev.kind = 'book' THEN
                      CASE WHEN s.status = 'cancelled' THEN 'schedule_cancelled' WHEN st.free <= 0 THEN 'no_seats'
                           WHEN list_contains(st.held, ev.seat) THEN 'seat_taken' ELSE 'accepted' END
                    WHEN NOT ev.old AND NOT list_contains(st.sold, ev.ref) THEN 'not_found'
                    WHEN list_contains(st.gone, ev.ref) OR (ev.old AND ev.old_status = 'cancelled') THEN 'already_cancelled'
                    WHEN ev.old AND ev.old_status = 'completed' THEN 'refused_completed' ELSE 'cancelled' END AS outcome
        FROM st JOIN ev ON ev.sid = st.sid AND ev.k = st.k + 1 JOIN schedules s ON s.id = st.sid)
)
SELECT ev.request_id, ev.kind, ev.sid AS schedule_id, ev.seat_number,
       CASE WHEN ev.kind = 'cancel' THEN ev.ref END AS booking_ref, COALESCE(st.outcome, 'not_found') AS outcome,
       CASE WHEN st.outcome = 'accepted' THEN CAST(COALESCE(NULLIF(
         CASE s.class WHEN 'First Class' THEN r.price_first_class WHEN 'Economy' THEN r.price_economy
                      WHEN 'Student' THEN r.price_student END, 0), r.price_economy) AS DOUBLE) END AS amount_paid
FROM ev LEFT JOIN st ON st.request_id = ev.request_id LEFT JOIN schedules s ON s.id = ev.sid LEFT JOIN routes r ON r.id = s.route_id
"""

_register("stream_bookings_cancels", _run_booking_stream, _BOOKINGS_CANCELS_SQL,
          "STR2: bookings and cancellations on one request stream, decided in request order by keyed state.")
_register("bookings_cancels", _bookings_cancels, _BOOKINGS_CANCELS_SQL,
          "ADM1 with SNK12 (batch): bookings and cancellations replayed in request order.")


def _notification_log(spark, sf_dir):
    """Outbox rows with delivery receipts: by payment method sent, failed, or none yet."""
    t = J.RailTables(spark, sf_dir)
    rows = J.outbox(t.bookings, t.schedules, t.routes, t.stations, t.users)
    method = F.col("payment_method")
    receipts = t.bookings.where(method.isin("visa", "mada", "cash")).select(
        "booking_ref", F.explode(F.array(F.lit("sms"), F.lit("email"))).alias("type"),
        (F.col("created_at") + F.expr("INTERVAL 5 MINUTES")).alias("ts"), (method != "cash").alias("ok"),
        F.when(method == "cash", "No route to host").alias("error")).dropDuplicates(["booking_ref", "type"])
    return J.notification_log(rows.drop("created_at"), receipts)


_register("notification_log", _notification_log, _OUTBOX_SQL.replace("SELECT booking_ref, 'sms'", ", o AS (SELECT booking_ref, 'sms'", 1) + """
), l AS (SELECT o.* EXCLUDE (status), b.payment_method AS m, b.created_at AS c FROM o JOIN b USING (booking_ref))
SELECT booking_ref, type, channel, if(m = 'cash' AND type = 'email', 'Booking confirmation', subject) AS subject,
       if(m = 'cash', 'No route to host', message) AS message,
       CASE WHEN m IN ('visa', 'mada') THEN 'sent' WHEN m = 'cash' THEN 'failed' ELSE 'pending' END AS status,
       CASE WHEN m IN ('visa', 'mada') THEN c + INTERVAL 5 MINUTE END AS sent_at,
       CASE WHEN m = 'cash' THEN 'No route to host' END AS error_msg
FROM l
""", "SC11: notification log from outbox rows and delivery receipts.")
