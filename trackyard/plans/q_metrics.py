"""Registered dashboard queries (AGG*, LIM2-4, SET1)."""

from trackyard.functions.expr import TRAIN_STATUS_LABELS
from trackyard.operators import metrics as M
from trackyard.plans.rail_sql import TRIPS as _TRIPS
from trackyard.plans.registry import query
from trackyard.sources.tables import AS_OF

# Per route: a trip counts in the load average once for each of its travelled
# bookings, and once if it has none.
_FANOUT = _TRIPS + """
, travelled AS (
  SELECT schedule_id, count(*) AS n, sum(amount_paid) AS paid FROM bookings
  WHERE booking_status IN ('confirmed', 'completed') GROUP BY schedule_id
), per_trip AS (
  SELECT s.route_id, coalesce(n, 0) AS n, coalesce(paid, 0) AS paid, greatest(coalesce(n, 0), 1) AS weight,
         100 * (1 - available_seats / nullif(total_seats, 0)) AS load
  FROM schedules s LEFT JOIN travelled ON schedule_id = s.id
), per_route AS (
  SELECT route_id, count(*) AS trips, sum(n) AS pax, sum(paid) AS paid,
         round(sum(weight * load) / sum(weight) FILTER (load IS NOT NULL), 1) AS load
  FROM per_trip GROUP BY route_id
), performance AS (
  SELECT route_code, from_name_en AS from_en, to_name_en AS to_en, duration_minutes, active,
         coalesce(trips, 0) AS total_trips, CAST(coalesce(pax, 0) AS BIGINT) AS total_passengers,
         CAST(coalesce(paid, 0) AS DOUBLE) AS total_revenue, load AS avg_load_pct
  FROM leg LEFT JOIN per_route USING (route_id)
)
"""


@query("route_performance", _FANOUT + """
SELECT route_code, from_en, to_en, total_trips, total_passengers, total_revenue, avg_load_pct
FROM performance ORDER BY total_revenue DESC, route_code
""")
def route_performance(t):
    """AGG6: per-route trips, passengers, revenue and fan-out load average."""
    return M.route_performance(t.routes, t.stations, t.schedules, t.bookings)


@query("overview", """
, trips_by_status AS (
  SELECT status, count(*) AS n, sum(total_seats) AS seats, sum(available_seats) AS free
  FROM schedules WHERE travel_date = DATE '1998-06-15' GROUP BY status
), paid_by_day AS (
  SELECT created_at::DATE AS day, booking_status, count(*) AS n, sum(amount_paid) AS amount
  FROM bookings WHERE payment_status = 'paid' GROUP BY ALL
), users_by_role AS (
  SELECT role, created_at AS day, count(*) AS n FROM users WHERE status = 'active' GROUP BY ALL
), seats AS (
  SELECT coalesce(sum(seats), 0) AS capacity, coalesce(sum(seats - free), 0) AS occupied FROM trips_by_status
)
SELECT (SELECT coalesce(sum(n), 0)::BIGINT FROM trips_by_status) AS trips_today,
       (SELECT coalesce(sum(n), 0)::BIGINT FROM trips_by_status WHERE status = 'active') AS on_time,
       (SELECT coalesce(sum(n), 0)::BIGINT FROM trips_by_status WHERE status = 'delayed') AS delayed,
       (SELECT coalesce(sum(n), 0)::BIGINT FROM trips_by_status WHERE status = 'cancelled') AS cancelled,
       occupied::BIGINT AS total_occupied, capacity::BIGINT AS total_capacity,
       (SELECT coalesce(sum(amount), 0)::DOUBLE FROM paid_by_day WHERE day = DATE '1998-06-15') AS revenue_today,
       (SELECT coalesce(sum(amount), 0)::DOUBLE FROM paid_by_day WHERE month(day) = 6) AS revenue_month,
       (SELECT coalesce(sum(n), 0)::BIGINT FROM paid_by_day WHERE booking_status = 'confirmed') AS active_bookings,
       (SELECT coalesce(sum(n), 0)::BIGINT FROM paid_by_day WHERE day = DATE '1998-06-15') AS bookings_today,
       (SELECT coalesce(sum(n), 0)::BIGINT FROM users_by_role) AS total_users,
       (SELECT coalesce(sum(n), 0)::BIGINT FROM users_by_role WHERE role = 'passenger') AS passengers,
       (SELECT coalesce(sum(n), 0)::BIGINT FROM users_by_role WHERE role = 'staff') AS staff,
       (SELECT coalesce(sum(n), 0)::BIGINT FROM users_by_role WHERE role = 'admin') AS admins,
       (SELECT coalesce(sum(n), 0)::BIGINT FROM users_by_role WHERE day = DATE '1998-06-15') AS new_today,
       CASE WHEN capacity > 0 THEN round(100.0 * occupied / capacity, 1) ELSE 0 END::DOUBLE AS occupancy_pct
FROM seats
""")
def overview(t):
    """AGG1-AGG4: one-row day overview (trips, occupancy, revenue, users)."""
    return M.overview(t.schedules, t.bookings, t.users, AS_OF)


@query("overview_calendar_month", """
, paid AS (SELECT amount_paid, booking_status, created_at::DATE AS d FROM bookings WHERE payment_status = 'paid'),
per_day AS (SELECT d, sum(amount_paid) AS s, count(*) AS n, count(*) FILTER (booking_status = 'confirmed') AS c FROM paid GROUP BY d)
SELECT (SELECT CAST(coalesce(sum(s), 0) AS DOUBLE) FROM per_day WHERE d = DATE '1998-06-15') AS revenue_today,
       (SELECT CAST(coalesce(sum(s), 0) AS DOUBLE) FROM per_day WHERE d BETWEEN DATE '1998-06-01' AND DATE '1998-06-30') AS revenue_month,
       (SELECT CAST(coalesce(sum(c), 0) AS BIGINT) FROM per_day) AS active_bookings,
       (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM per_day WHERE d = DATE '1998-06-15') AS bookings_today
""")
def overview_calendar_month(t):
    """AGG2 with the calendar-month option (month and year must match)."""
    return M.overview_revenue(t.bookings, AS_OF, same_year=True)


@query("revenue_trend", """
, paid AS (SELECT date_trunc('day', created_at)::DATE AS report_date, amount_paid FROM bookings WHERE payment_status = 'paid')
SELECT report_date, count(amount_paid) AS bookings, CAST(sum(amount_paid) AS DOUBLE) AS revenue
FROM paid GROUP BY report_date HAVING report_date >= DATE '1998-06-08' ORDER BY report_date
""")
def revenue_trend(t):
    """AGG5: paid bookings and revenue per day since as_of - 7 days (no upper bound)."""
    return M.revenue_trend(t.bookings, AS_OF, days=7)


@query("revenue_trend_filled", """
, d AS (
  SELECT CAST(created_at AS DATE) AS report_date, COUNT(*) AS bookings, SUM(amount_paid) AS revenue
  FROM bookings
  WHERE payment_status = 'paid' AND created_at >= DATE '1998-06-15' - INTERVAL 30 DAY
  GROUP BY 1
), cal AS (
  SELECT CAST(unnest(generate_series(TIMESTAMP '1998-05-16',
              CAST(GREATEST(DATE '1998-05-16', COALESCE((SELECT max(report_date) FROM d), DATE '1998-05-16')) AS TIMESTAMP),
              INTERVAL 1 DAY)) AS DATE) AS report_date
)
SELECT cal.report_date, COALESCE(d.bookings, 0) AS bookings,
       CAST(COALESCE(d.revenue, 0) AS DOUBLE) AS revenue
FROM cal LEFT JOIN d ON d.report_date = cal.report_date
ORDER BY 1
""")
def revenue_trend_filled(t):
    """AGG5 with fill: every calendar day from as_of - 30 to the last booking day."""
    return M.revenue_trend(t.bookings, AS_OF, days=30, fill=True)


@query("occupancy_live", _TRIPS + """
, today AS (
  SELECT *, total_seats - available_seats AS occupied,
         round(100 * (1 - available_seats / nullif(total_seats, 0)), 1) AS occupancy_pct
  FROM trip WHERE travel_date = DATE '1998-06-15'
)
SELECT id, train_id, departure_time, arrival_time, status, class, total_seats, available_seats, occupied, occupancy_pct,
       from_name_en AS from_en, from_name_ar AS from_ar, to_name_en AS to_en, to_name_ar AS to_ar,
       coalesce((SELECT band FROM (VALUES ('red', 85), ('amber', 60)) b(band, above)
                 WHERE round(occupancy_pct) > above ORDER BY above DESC LIMIT 1), 'green') AS band
FROM today ORDER BY departure_time, id
""")
def occupancy_live(t):
    """AGG7/PRJ3/SC14: trips of the day with occupied seats, percentage and band."""
    return M.occupancy_live(t.schedules, t.routes, t.stations, AS_OF)


@query("top_stations", """
, pax AS (
  SELECT s.route_id, count(*) AS n FROM bookings b JOIN schedules s ON b.schedule_id = s.id
  WHERE b.booking_status IN ('confirmed', 'completed') GROUP BY s.route_id
), touch AS (
  SELECT DISTINCT id AS route_id, unnest([from_station_id, to_station_id]) AS station_id FROM routes
)
SELECT code, name_en, name_ar, CAST(sum(n) AS BIGINT) AS total_passengers
FROM touch JOIN pax USING (route_id) JOIN stations ON stations.id = station_id
GROUP BY station_id, code, name_en, name_ar ORDER BY total_passengers DESC, code LIMIT 10
""")
def top_stations(t):
    """AGG8/JN5/LIM2: top 10 stations by passengers of routes touching them."""
    return M.top_stations(t.stations, t.routes, t.schedules, t.bookings, n=10)


@query("booking_summary", """
SELECT COUNT(*) AS total,
       COUNT(CASE WHEN booking_status = 'confirmed' THEN 1 END) AS confirmed,
       COUNT(CASE WHEN booking_status = 'cancelled' THEN 1 END) AS cancelled,
       CAST(COALESCE(SUM(CASE WHEN payment_status = 'paid' THEN amount_paid END), 0) AS DOUBLE) AS revenue
FROM bookings
""")
def booking_summary(t):
    """AGG10: booking tiles (total, confirmed, cancelled, paid revenue)."""
    return M.booking_summary(t.bookings)


@query("passenger_summary", """
SELECT b.user_id,
       COUNT(CASE WHEN b.booking_status <> 'cancelled' THEN 1 END) AS total,
       COUNT(CASE WHEN b.booking_status = 'confirmed' THEN 1 END) AS confirmed,
       COUNT(CASE WHEN b.booking_status = 'confirmed' AND s.travel_date >= DATE '1998-06-15' THEN 1 END) AS upcoming,
       CAST(COALESCE(SUM(CASE WHEN b.payment_status = 'paid' THEN b.amount_paid END), 0) AS DOUBLE) AS spent
FROM bookings b LEFT JOIN schedules s ON s.id = b.schedule_id
GROUP BY b.user_id
""")
def passenger_summary(t):
    """AGG11: per-passenger tiles (bookings, confirmed, upcoming, spent)."""
    return M.passenger_summary(t.bookings, t.schedules, AS_OF)


@query("occupancy_by_class", """
SELECT class, COUNT(*) AS trips,
       CAST(SUM(total_seats - available_seats) AS BIGINT) AS occupied,
       CAST(SUM(total_seats) AS BIGINT) AS capacity,
       ROUND(CAST(SUM(total_seats - available_seats) AS DOUBLE) / NULLIF(SUM(total_seats), 0) * 100, 1) AS occupancy_pct
FROM schedules GROUP BY class
""")
def occupancy_by_class(t):
    """AGG12: occupancy per travel class over all trips."""
    return M.occupancy_by_class(t.schedules)


@query("station_route_counts", """
SELECT st.id, st.code, st.name_en,
       (SELECT COUNT(*) FROM routes r WHERE r.from_station_id = st.id OR r.to_station_id = st.id) AS route_count
FROM stations st
""")
def station_route_counts(t):
    """AGG13: routes starting or ending at each station (0 when none)."""
    return M.station_route_counts(t.stations, t.routes)


@query("period_change", """
, p AS (
  SELECT CAST(COALESCE(SUM(CASE WHEN CAST(created_at AS DATE) >= DATE '1998-06-09' THEN amount_paid ELSE 0 END), 0) AS DOUBLE) AS revenue_current,
         CAST(COALESCE(SUM(CASE WHEN CAST(created_at AS DATE) < DATE '1998-06-09' THEN amount_paid ELSE 0 END), 0) AS DOUBLE) AS revenue_previous,
         COUNT(CASE WHEN CAST(created_at AS DATE) >= DATE '1998-06-09' THEN 1 END) AS bookings_current,
         COUNT(CASE WHEN CAST(created_at AS DATE) < DATE '1998-06-09' THEN 1 END) AS bookings_previous
  FROM bookings
  WHERE payment_status = 'paid' AND created_at >= TIMESTAMP '1998-06-02' AND created_at < TIMESTAMP '1998-06-16'
)
SELECT *,
       ROUND((revenue_current - revenue_previous) / NULLIF(revenue_previous, 0) * 100, 1) AS revenue_change_pct,
       ROUND(CAST(bookings_current - bookings_previous AS DOUBLE) / NULLIF(bookings_previous, 0) * 100, 1) AS bookings_change_pct
FROM p
""")
def period_change(t):
    """AGG14: last 7 days vs the 7 days before (paid revenue and bookings)."""
    return M.period_change(t.bookings, AS_OF, days=7)


@query("departure_board", _TRIPS + """
SELECT id, departure_time, train_id, from_name_en, to_name_en, status, from_name_en || ' → ' || to_name_en AS route_label,
       CASE status WHEN 'cancelled' THEN 'Cancelled' WHEN 'delayed' THEN 'Delayed +' || delay_minutes || 'm' ELSE 'On Time' END AS status_label,
       (MAP {""" + ", ".join(f"'{k}': '{v}'" for k, v in TRAIN_STATUS_LABELS["ar"].items()) + """})[status] AS status_ar
FROM trip WHERE travel_date = DATE '1998-06-15' ORDER BY departure_time, id LIMIT 5
""")
def departure_board(t):
    """LIM3/SC19: next 5 departures of the day with a status label."""
    from trackyard.operators.views import schedule_view
    return M.departure_board(schedule_view(t.schedules, t.routes, t.stations), AS_OF, n=5)


@query("recent_bookings", """
SELECT * FROM (
  SELECT user_id, booking_ref, schedule_id, seat_number, booking_status, created_at,
         row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, booking_ref DESC) AS rank
  FROM bookings
) WHERE rank <= 3
""")
def recent_bookings(t):
    """LIM4: the 3 newest bookings of every user (salted top-n, exact)."""
    return M.recent_bookings(t.bookings, n=3)


@query("activity_feed", """
SELECT * FROM (
  SELECT created_at AS ts, 'booking_created' AS kind, booking_ref AS ref FROM bookings
  UNION ALL
  SELECT cancelled_at, 'booking_cancelled', booking_ref FROM bookings WHERE cancelled_at IS NOT NULL
  UNION ALL
  SELECT CAST(travel_date AS TIMESTAMP), concat('schedule_', status), CAST(id AS VARCHAR)
  FROM schedules WHERE status IN ('delayed', 'cancelled')
  UNION ALL
  SELECT CAST(created_at AS TIMESTAMP), 'user_created', email FROM users
) WHERE ts < TIMESTAMP '1998-06-16'
ORDER BY ts DESC, kind, ref
LIMIT 20
""")
def activity_feed(t):
    """SET1: newest 20 activities (bookings, cancellations, trip alerts, sign-ups)."""
    return M.activity_feed(t.bookings, t.schedules, t.users, AS_OF, n=20)


@query("route_cards", _FANOUT + """
SELECT route_code, from_en || ' → ' || to_en AS route_label, total_trips, avg_load_pct,
       (SELECT tier FROM (VALUES ('high', 70), ('med', 50), ('low', -1)) t(tier, least)
        WHERE avg_load_pct >= least ORDER BY least DESC LIMIT 1) AS tier,
       format('{:,.0f}', total_revenue) AS revenue_label, duration_minutes / 60 AS duration_hours,
       upper(left(from_en, 3)) AS from_short, upper(left(to_en, 3)) AS to_short,
       if(active = 1, 'Active', 'Inactive') AS active_label
FROM performance
""")
def route_cards(t):
    """AGG15/SC15/SC17: route cards with load tier (70/50), revenue and duration labels."""
    perf = M.route_performance(t.routes, t.stations, t.schedules, t.bookings)
    return M.route_cards(perf, t.routes)


@query("staff_alerts", """
SELECT s.id, s.train_id, s.departure_time,
       CASE WHEN s.status = 'cancelled' THEN 'error' WHEN s.status = 'delayed' THEN 'warning' END AS level,
       CASE WHEN s.status = 'cancelled' THEN concat(s.train_id, ' cancelled')
            ELSE concat(s.train_id, ' delayed ', CAST(s.delay_minutes AS VARCHAR), 'min') END AS message,
       concat(st1.name_en, ' → ', st2.name_en, ' ', substring(s.departure_time, 1, 5)) AS detail,
       CASE WHEN s.status = 'cancelled' THEN 'Cancelled'
            WHEN s.status = 'delayed' THEN concat('Delayed +', CAST(s.delay_minutes AS VARCHAR), 'm')
            ELSE 'On Time' END AS status_label
FROM schedules s JOIN routes r ON r.id = s.route_id
JOIN stations st1 ON st1.id = r.from_station_id JOIN stations st2 ON st2.id = r.to_station_id
WHERE s.travel_date = DATE '1998-06-15' AND s.status IN ('cancelled', 'delayed')
""")
def staff_alerts(t):
    """SC19: error/warning alerts for the day's cancelled and delayed trips."""
    from trackyard.operators.views import schedule_view
    return M.staff_alerts(schedule_view(t.schedules, t.routes, t.stations), AS_OF)


@query("activity_by_shift", """
SELECT CASE WHEN hour(timezone('Asia/Riyadh', CAST(ts AS TIMESTAMP) AT TIME ZONE 'UTC')) < 12 THEN 'Morning Shift'
            WHEN hour(timezone('Asia/Riyadh', CAST(ts AS TIMESTAMP) AT TIME ZONE 'UTC')) < 18 THEN 'Afternoon Shift'
            ELSE 'Evening Shift' END AS shift,
       event_type, COUNT(*) AS events
FROM events GROUP BY 1, 2
""", rail_sql=False)
def activity_by_shift(t):
    """SC16: events per shift of day in Riyadh local time."""
    return M.activity_by_shift(t.events)
