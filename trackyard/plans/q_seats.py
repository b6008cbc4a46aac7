"""Registered seat queries (GEN1-3, ADM1, SNK8 after admission)."""

from pyspark.sql import functions as F

from trackyard.operators import mutate as MU
from trackyard.operators import references as R
from trackyard.operators import seats as S
from trackyard.plans.registry import query
from trackyard.sources import requests as RQ


@query("seat_map", """
, taken AS (SELECT DISTINCT schedule_id, seat_number FROM bookings WHERE booking_status IN ('confirmed', 'pending')),
seats AS (SELECT id AS schedule_id, unnest(CASE WHEN total_seats >= 1 THEN range(1, total_seats + 1) ELSE [] END) AS seat_no FROM schedules),
labelled AS (SELECT schedule_id, CAST(seat_no AS INT) AS seat_no,
                    concat(CAST(CAST(floor((seat_no - 1) / 4) AS BIGINT) + 1 AS VARCHAR), chr(CAST(65 + (seat_no - 1) % 4 AS INT))) AS seat_id
             FROM seats)
SELECT l.schedule_id, l.seat_no, l.seat_id,
       CASE WHEN t.seat_number IS NOT NULL THEN 'taken' ELSE 'available' END AS status
FROM labelled l LEFT JOIN taken t ON t.schedule_id = l.schedule_id AND t.seat_number = l.seat_id
""")
def seat_map(t):
    """GEN1/SC3: every seat of every schedule, taken (confirmed/pending) or available."""
    return S.seat_map(t.schedules, t.bookings)


@query("seat_summary", """
SELECT s.id AS schedule_id, s.total_seats AS total,
       s.total_seats - (SELECT COUNT(DISTINCT b.seat_number) FROM bookings b
                        WHERE b.schedule_id = s.id AND b.booking_status IN ('confirmed', 'pending')) AS available
FROM schedules s
""")
def seat_summary(t):
    """GEN1: total seats and available = total - distinct held seat labels."""
    return S.seat_summary(t.schedules, t.bookings)


@query("car_occupancy", """
, trips AS (SELECT id AS schedule_id, total_seats, total_seats - available_seats AS occupied, status,
                   CAST(floor(total_seats / 3) AS INT) AS spc FROM schedules),
cars AS (SELECT *, unnest(range(0, 3)) AS car FROM trips),
b AS (SELECT *, car * spc + 1 AS first_seat, LEAST(car * spc + 1 + spc - 1, total_seats) AS last_seat FROM cars),
c AS (SELECT *, GREATEST(last_seat - first_seat + 1, 0) AS seats,
             LEAST(last_seat, 8) AS prem_hi FROM b),
d AS (SELECT *, CASE WHEN status = 'cancelled' THEN seats ELSE GREATEST(LEAST(last_seat, occupied) - first_seat + 1, 0) END AS occ,
             CASE WHEN car = 0 THEN GREATEST(prem_hi - first_seat + 1, 0) ELSE 0 END AS prem,
             CASE WHEN car = 0 THEN (CASE WHEN status = 'cancelled' THEN GREATEST(prem_hi - first_seat + 1, 0)
                                          ELSE GREATEST(LEAST(prem_hi, occupied) - first_seat + 1, 0) END) ELSE 0 END AS prem_occ
      FROM c)
SELECT schedule_id, CAST(car + 1 AS INT) AS car_no, CAST(first_seat AS INT) AS first_seat,
       CAST(last_seat AS INT) AS last_seat, CAST(seats AS INT) AS seats, CAST(occ AS INT) AS occupied_seats,
       CAST(ROUND(CAST(occ AS DOUBLE) / NULLIF(seats, 0) * 100, 0) AS INT) AS car_pct,
       CAST(prem - prem_occ AS INT) AS premium_free
FROM d
""")
def car_occupancy(t):
    """GEN2: 3 cars per trip, floor(total/3) seats each, occupied seats per car."""
    trips = t.schedules.select(F.col("id").alias("schedule_id"), "total_seats",
                               (F.col("total_seats") - F.col("available_seats")).alias("occupied"),
                               "status")
    return S.car_occupancy(trips, cars=3)


@query("trip_stats", """
, per AS (SELECT schedule_id, COUNT(CASE WHEN booking_status IN ('confirmed', 'completed') THEN 1 END) AS occ,
                 COUNT(CASE WHEN booking_status = 'pending' THEN 1 END) AS res
          FROM bookings GROUP BY schedule_id)
SELECT s.id AS schedule_id, s.total_seats, COALESCE(per.occ, 0) AS occupied, COALESCE(per.res, 0) AS reserved,
       GREATEST(s.total_seats - COALESCE(per.occ, 0) - COALESCE(per.res, 0), 0) AS available,
       CAST(ROUND(CAST(COALESCE(per.occ, 0) AS DOUBLE) / NULLIF(s.total_seats, 0) * 100, 0) AS INT) AS occupancy_pct,
       CASE WHEN ROUND(ROUND(CAST(COALESCE(per.occ, 0) AS DOUBLE) / NULLIF(s.total_seats, 0) * 100, 0), 0) > 85 THEN 'red'
            WHEN ROUND(ROUND(CAST(COALESCE(per.occ, 0) AS DOUBLE) / NULLIF(s.total_seats, 0) * 100, 0), 0) > 60 THEN 'amber'
            ELSE 'green' END AS band
FROM schedules s LEFT JOIN per ON per.schedule_id = s.id
""")
def trip_stats(t):
    """GEN3/SC14: occupied, reserved, available (>= 0) and occupancy band per trip."""
    return S.trip_stats(t.schedules, t.bookings)


ADMISSION_SQL = """
, req AS (SELECT booking_ref AS request_id, created_at AS ts, user_id, schedule_id, seat_number,
                 upper(rtrim(seat_number)) AS sk FROM bookings WHERE created_at >= TIMESTAMP '1998-06-15'),
taken AS (SELECT DISTINCT schedule_id, upper(rtrim(seat_number)) AS sk FROM bookings
          WHERE created_at < TIMESTAMP '1998-06-15' AND booking_status IN ('confirmed', 'pending')),
r2 AS (SELECT req.*, row_number() OVER (PARTITION BY req.schedule_id, req.sk ORDER BY ts, request_id) AS rn,
              t.sk IS NULL AS free
       FROM req LEFT JOIN taken t ON t.schedule_id = req.schedule_id AND t.sk = req.sk),
r3 AS (SELECT *, (rn = 1 AND free) AS cand FROM r2),
r4 AS (SELECT *, COALESCE(SUM(CASE WHEN cand THEN 1 ELSE 0 END) OVER (
                   PARTITION BY schedule_id ORDER BY ts, request_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r3),
res AS (
  SELECT r4.request_id, r4.schedule_id, r4.seat_number,
         CASE WHEN s.id IS NULL THEN 'not_found'
              WHEN s.status = 'cancelled' THEN 'schedule_cancelled'
              WHEN r4.before >= s.available_seats THEN 'no_seats'
              WHEN NOT r4.cand THEN 'seat_taken'
              ELSE 'accepted' END AS outcome,
         CAST(COALESCE(NULLIF(CASE s.class WHEN 'First Class' THEN r.price_first_class WHEN 'Economy' THEN r.price_economy
                                         WHEN 'Student' THEN r.price_student END, 0), r.price_economy) AS DOUBLE) AS fare
  FROM r4 LEFT JOIN schedules s ON s.id = r4.schedule_id LEFT JOIN routes r ON r.id = s.route_id
)
"""


def _admission(t):
    history, reqs = RQ.history_and_requests(t)
    return S.admit_bookings(reqs, t.schedules, history, t.routes)


@query("seat_admission", ADMISSION_SQL + """
SELECT request_id, schedule_id, seat_number, outcome,
       CASE WHEN outcome = 'accepted' THEN fare END AS amount_paid
FROM res
""")
def seat_admission(t):
    """ADM1: requests from as_of on against history before it; outcome and fare per request."""
    return S.admission_result(_admission(t))


@query("seat_admission_counts", ADMISSION_SQL + """
SELECT outcome, COUNT(*) AS requests FROM res GROUP BY outcome
""")
def seat_admission_counts(t):
    """ADM1: number of requests per outcome."""
    return _admission(t).outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("requests"))


@query("schedules_after_admission", ADMISSION_SQL + """
, d AS (SELECT schedule_id, COUNT(*) AS n FROM res WHERE outcome = 'accepted' GROUP BY schedule_id)
SELECT s.id, s.total_seats, CAST(s.available_seats - COALESCE(d.n, 0) AS INT) AS available_seats
FROM schedules s LEFT JOIN d ON d.schedule_id = s.id
""")
def schedules_after_admission(t):
    """SNK8: seat counters after applying the admission's -1 per accepted booking."""
    history, requests = RQ.history_and_requests(t)
    out = MU.apply_deltas(t.schedules, R.book(requests, t.schedules, history, t.routes, t.users).deltas)
    return out.select("id", "total_seats", "available_seats")
