"""Registered view, filter, paging and lookup queries (JN*, PRJ*, FLT*, LIM1, SRC2)."""

import datetime as dt
import decimal

from pyspark.sql import functions as F

from trackyard.functions import expr as X
from trackyard.operators import collation as CO
from trackyard.operators import filters as FL
from trackyard.operators import metrics as M
from trackyard.operators import views as V
from trackyard.plans.rail_sql import TRIPS
from trackyard.plans.registry import query
from trackyard.session import scratch_path
from trackyard.sources.layout import PageIndex, TextIndex
from trackyard.sources import requests as RQ
from trackyard.sources.tables import AS_OF, rail

_TRIP_COLUMNS = """SELECT id, train_id, route_id, travel_date, departure_time, arrival_time, class, status, delay_minutes,
       total_seats, available_seats, route_code, duration_minutes, distance_km::DOUBLE AS distance_km,
       price_first_class::DOUBLE AS price_first_class, price_economy::DOUBLE AS price_economy,
       price_student::DOUBLE AS price_student, from_code, from_name_en, from_name_ar, to_code, to_name_en, to_name_ar,
       notes, created_at, updated_at
"""
_SALE_COLUMNS = """SELECT booking_ref, user_id, schedule_id, seat_number, amount_paid::DOUBLE AS amount_paid, payment_method,
       payment_status, booking_status, created_at, train_id, travel_date, departure_time, arrival_time, class,
       from_code, from_name_en AS from_en, from_name_ar AS from_ar, to_code, to_name_en AS to_en, to_name_ar AS to_ar,
       id, passenger_first, passenger_last, national_id, phone, email, qr_ref, cancelled_at
"""
_SCHEDULES = TRIPS + _TRIP_COLUMNS + "FROM trip"
_BOOKINGS = TRIPS + _SALE_COLUMNS + "FROM sale"

_SEARCH_WHERE = """
WHERE status = 'active' AND class = 'Economy' AND (from_code = 'ATION_1' OR from_name_en ILIKE '%ATION_1%')
"""


def _schedule_search(t):
    v = V.schedule_view(t.schedules, t.routes, t.stations)
    v = FL.filter_where(v, status="active", **{"class": "Economy"})
    return FL.match_station(v, from_="ATION_1")


@query("schedule_view", _SCHEDULES)
def schedule_view(t):
    """JN1/PRJ1: every schedule with route and both stations."""
    return V.schedule_view(t.schedules, t.routes, t.stations)


@query("booking_view", _BOOKINGS)
def booking_view(t):
    """JN2/PRJ2: every booking with trip, route and stations (5-way join)."""
    return V.booking_view(t.bookings, t.schedules, t.routes, t.stations)


@query("user_view", """
, spend AS (
  SELECT user_id, count(*) FILTER (booking_status <> 'cancelled') AS kept, sum(amount_paid) FILTER (payment_status = 'paid') AS paid
  FROM bookings GROUP BY user_id
)
SELECT users.*, can_schedules, can_bookings, can_routes, can_users, can_reports, can_pricing, coalesce(kept, 0) AS total_bookings,
       coalesce(paid, 0)::DOUBLE AS total_spent
FROM users LEFT JOIN user_permissions p ON p.user_id = users.id LEFT JOIN spend ON spend.user_id = users.id
""")
def user_view(t):
    """JN3/JN8: users, permissions (left join) and correlated booking totals."""
    return V.user_view(t.users, t.user_permissions, t.bookings)


@query("route_view", TRIPS + """
, ahead AS (SELECT route_id, count(*) AS n FROM schedules WHERE travel_date >= DATE '1998-06-15' GROUP BY route_id),
sold AS (SELECT route_id, count(*) AS n FROM sale WHERE booking_status = 'confirmed' GROUP BY route_id)
SELECT route_id AS id, route_code, duration_minutes, active, distance_km::DOUBLE AS distance_km,
       price_first_class::DOUBLE AS price_first_class, price_economy::DOUBLE AS price_economy,
       price_student::DOUBLE AS price_student, from_station_id AS from_id, origin.code AS from_code,
       origin.name_en AS from_en, origin.name_ar AS from_ar, origin.city_en AS from_city_en, origin.city_ar AS from_city_ar,
       to_station_id AS to_id, target.code AS to_code, target.name_en AS to_en, target.name_ar AS to_ar,
       target.city_en AS to_city_en, target.city_ar AS to_city_ar,
       coalesce(ahead.n, 0) AS upcoming_trips, coalesce(sold.n, 0) AS total_bookings
FROM leg LEFT JOIN ahead USING (route_id) LEFT JOIN sold USING (route_id)
""")
def route_view(t):
    """JN6/JN7: routes with stations, upcoming trips and confirmed bookings."""
    return V.route_view(t.routes, t.stations, t.schedules, t.bookings, AS_OF)


@query("active_routes", """
SELECT r.id, r.route_code FROM routes r WHERE r.active = 1 ORDER BY r.route_code
""")
def active_routes(t):
    """FLT6: route list with active=true parsed to 1."""
    return FL.bool_filter(t.routes, "active", "true").select("id", "route_code") \
        .orderBy("route_code")


@query("active_stations", """
SELECT id, code, name_en, name_ar, city_en, city_ar FROM stations WHERE active = 1 ORDER BY name_en
""")
def active_stations(t):
    """FLT12: active stations by English name."""
    return FL.active(t.stations).select("id", "code", "name_en", "name_ar", "city_en",
                                        "city_ar").orderBy("name_en")


@query("schedule_search", _SCHEDULES + _SEARCH_WHERE + "ORDER BY travel_date, departure_time, id")
def schedule_search(t):
    """FLT1/FLT2/FLT5/SRT1: status, class and from-station (code or name ILIKE) filters."""
    return _schedule_search(t).orderBy("travel_date", "departure_time", "id")


@query("schedule_search_wildcards", _SCHEDULES + """
WHERE (from_code = 'n_ti%n' OR from_name_en ILIKE '%n_ti%n%') AND (to_code = '__2' OR to_name_en ILIKE '%__2%')
""")
def schedule_search_wildcards(t):
    """FLT2: wildcards that the user types act as wildcards."""
    return FL.match_station(V.schedule_view(t.schedules, t.routes, t.stations), from_="n_ti%n", to="__2")


@query("schedule_page", _SCHEDULES + _SEARCH_WHERE
       + "ORDER BY travel_date, departure_time, id LIMIT 20 OFFSET 40")
def schedule_page(t):
    """LIM1: page 3 (20 per page) of the schedule search."""
    return FL.paginate(_schedule_search(t), ["travel_date", "departure_time", "id"], page=3, limit=20)


@query("schedule_page_info", TRIPS + """
SELECT 3 AS page, 20 AS "limit", count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages FROM trip
""" + _SEARCH_WHERE)
def schedule_page_info(t):
    """AGG9: total rows and page count of the schedule search."""
    return M.page_info(_schedule_search(t), page=3, limit=20)


@query("booking_page", _BOOKINGS + """
WHERE booking_status = 'confirmed' ORDER BY created_at DESC, booking_ref DESC LIMIT 20 OFFSET 20
""")
def booking_page(t):
    """FLT5/SRT2/LIM1: confirmed bookings, newest first, page 2."""
    v = FL.filter_where(V.booking_view(t.bookings, t.schedules, t.routes, t.stations),
                        booking_status="confirmed")
    return FL.paginate(v, [F.desc("created_at"), F.desc("booking_ref")], page=2, limit=20)


_USER_WHERE = """
WHERE u.role = 'passenger' AND u.verified = 1
  AND (u.email ILIKE '%0001%' OR u.first_name ILIKE '%0001%' OR u.last_name ILIKE '%0001%'
       OR u.national_id ILIKE '%0001%' OR u.phone ILIKE '%0001%')
"""


def _user_search(t):
    u = FL.filter_where(t.users, role="passenger")
    u = FL.bool_filter(u, "verified", "true")
    return FL.search(u, ["email", "first_name", "last_name", "national_id", "phone"], "0001")


@query("user_search", "SELECT u.* FROM users u" + _USER_WHERE)
def user_search(t):
    """FLT3/FLT5/FLT6: role, verified flag and 5-column substring search."""
    return _user_search(t)


@query("user_page", "SELECT u.* FROM users u" + _USER_WHERE
       + " ORDER BY u.created_at DESC, u.id DESC LIMIT 20 OFFSET 0")
def user_page(t):
    """SRT2/LIM1: first page of the user search, newest first."""
    return FL.paginate(_user_search(t), [F.desc("created_at"), F.desc("id")], 1, 20)


@query("booking_search_concat", _BOOKINGS + """
WHERE position('nation_17nation' IN lower(booking_ref || from_name_en || to_name_en)) > 0
""")
def booking_search_concat(t):
    """FLT4: text search over the concatenation ref+from+to (crosses column borders)."""
    v = V.booking_view(t.bookings, t.schedules, t.routes, t.stations)
    return FL.search_concat(v, ["booking_ref", "from_en", "to_en"], "NATION_17nation")


@query("upcoming_trips", """
SELECT s.id, s.route_id, s.travel_date FROM schedules s WHERE s.travel_date >= DATE '1998-06-15'
""")
def upcoming_trips(t):
    """FLT9: schedules travelling on or after as_of."""
    return FL.upcoming(t.schedules, AS_OF).select("id", "route_id", "travel_date")


@query("booking_lookup", """
, req AS (
  SELECT concat('C1-', booking_ref) AS request_id, booking_ref FROM bookings
  UNION ALL SELECT concat('C2-', booking_ref), booking_ref FROM bookings WHERE payment_method = 'cash'
  UNION ALL SELECT concat('CE-', CAST(event_id AS VARCHAR)), concat('BK-E', CAST(event_id AS VARCHAR)) FROM events
)
""" + TRIPS + """
SELECT request_id, req.booking_ref, sale.schedule_id, booking_status, train_id, from_code, to_code,
       CAST(sale.booking_ref IS NOT NULL AS INT) AS found
FROM req LEFT JOIN sale ON sale.booking_ref = req.booking_ref
""")
def booking_lookup(t):
    """SRC2: many keyed lookups at once (left join; found = 0 when missing)."""
    keys = RQ.cancel_requests(t).select("request_id", "booking_ref")
    return V.booking_lookup(keys, t.bookings, t.schedules, t.routes, t.stations,
                            ["schedule_id", "booking_status", "train_id", "from_code", "to_code"])


@query("booking_find", _BOOKINGS + " WHERE user_id = 11 AND payment_method <> 'visa'")
def booking_find(t):
    """SRC2: the bookings of some references (here those of passenger 11), found by the row groups' bloom filters."""
    stored = rail(t.spark, t.sf_dir, materialize=True).bookings
    mine = stored.where("user_id = 11 AND payment_method <> 'visa'").select("booking_ref").collect()
    return V.find_bookings([r.booking_ref for r in mine], stored, t.schedules, t.routes, t.stations)


@query("booking_cards", """
SELECT b.booking_ref,
       concat(st1.name_en, ' → ', st2.name_en) AS route_en,
       concat(st1.name_ar, ' ← ', st2.name_ar) AS route_ar,
       CASE b.booking_status WHEN 'confirmed' THEN 'Confirmed' WHEN 'completed' THEN 'Completed'
            WHEN 'cancelled' THEN 'Cancelled' WHEN 'pending' THEN 'Pending' END AS status_en,
       CASE b.booking_status WHEN 'confirmed' THEN 'مؤكد' WHEN 'completed' THEN 'مكتمل'
            WHEN 'cancelled' THEN 'ملغى' WHEN 'pending' THEN 'معلق' END AS status_ar,
       concat('SAR ', CAST(b.amount_paid AS VARCHAR)) AS price_label,
       upper(substring(st1.name_en, 1, 3)) AS from_short, upper(substring(st2.name_en, 1, 3)) AS to_short,
       CAST(r.duration_minutes AS DOUBLE) / 60.0 AS duration_hours,
       concat_ws('|', 'RWSA', b.booking_ref, s.train_id, concat(st1.code, '-', st2.code),
                 CAST(s.travel_date AS VARCHAR), b.seat_number, u.first_name || ' ' || u.last_name) AS boarding_pass
FROM bookings b
JOIN schedules s ON s.id = b.schedule_id
JOIN routes r ON r.id = s.route_id
JOIN stations st1 ON st1.id = r.from_station_id
JOIN stations st2 ON st2.id = r.to_station_id
JOIN users u ON u.id = b.user_id
""")
def booking_cards(t):
    """SC6/SC12/SC13/SC17: localised labels, price text, short codes and boarding-pass payload."""
    rd = V.route_dim(t.routes, t.stations).select(
        F.col("id").alias("_rid"), "from_name_en", "from_name_ar", "to_name_en", "to_name_ar",
        "from_code", "to_code", "duration_minutes")
    s = t.schedules.select(F.col("id").alias("_sid"), F.col("route_id").alias("_srid"),
                           "train_id", "travel_date").join(rd, F.col("_srid") == rd["_rid"])
    u = t.users.select(F.col("id").alias("_uid"),
                       F.concat_ws(" ", "first_name", "last_name").alias("_name"))
    b = (t.bookings.join(s, t.bookings.schedule_id == s["_sid"])
         .join(u, F.col("user_id") == u["_uid"]))
    return b.select(
        "booking_ref",
        X.route_label("from_name_en", "to_name_en", "en").alias("route_en"),
        X.route_label("from_name_ar", "to_name_ar", "ar").alias("route_ar"),
        X.booking_status_label("booking_status", "en").alias("status_en"),
        X.booking_status_label("booking_status", "ar").alias("status_ar"),
        X.sar("amount_paid").alias("price_label"),
        X.short_code("from_name_en").alias("from_short"),
        X.short_code("to_name_en").alias("to_short"),
        X.minutes_to_hours("duration_minutes").alias("duration_hours"),
        X.boarding_pass("booking_ref", "train_id", "from_code", "to_code", "travel_date",
                        "seat_number", "_name").alias("boarding_pass"))


@query("booking_visibility", """
SELECT u.id, u.role, COALESCE(o.n, 0) AS own_bookings,
       CASE WHEN u.role = 'passenger' THEN COALESCE(o.n, 0) ELSE (SELECT COUNT(*) FROM bookings) END AS visible_bookings
FROM users u LEFT JOIN (SELECT user_id, COUNT(*) AS n FROM bookings GROUP BY user_id) o ON o.user_id = u.id
""")
def booking_visibility(t):
    """FLT11: bookings each user may see (own for passengers, all for other roles)."""
    return FL.visibility_counts(t.users, t.bookings)


_NEWEST = [("created_at", False), ("booking_ref", False), ("amount_paid", True), ("user_id", True)]
_NEWEST_SQL = "SELECT * REPLACE (CAST(amount_paid AS DOUBLE) AS amount_paid) FROM bookings %s ORDER BY created_at DESC, booking_ref DESC, amount_paid, user_id LIMIT 20 %s"


def _page_index(t):
    return PageIndex.build(t.bookings, scratch_path(t.spark, "booking_pages"), _NEWEST, rows_per_part=20_000)


@query("booking_deep_page", _NEWEST_SQL % ("", "OFFSET 30000"))
def booking_deep_page(t):
    """LIM1: page 1501 of all bookings, newest first, from the page index (only the parts that hold it are read)."""
    return _page_index(t).page(1501, 20)


@query("booking_next_page", _NEWEST_SQL % ("WHERE created_at < TIMESTAMP '1998-06-15'", ""))
def booking_next_page(t):
    """LIM1: the 20 bookings after a given key, newest first, from the page index."""
    # the key just before all bookings of earlier days
    return _page_index(t).after([dt.datetime(1998, 6, 15), "", decimal.Decimal("1e9"), 1 << 60], 20)


def _spelled(t):
    """One address per event: a user's own in capitals with blanks behind it, or one that nobody has."""
    odd = F.col("event_type") == "error"
    return t.events.select("event_id", F.concat(F.lit("CUSTOMER#"), F.lpad(F.col("user_id").cast("string"), 9, "0"),
                                                F.when(odd, "@else.example  ").otherwise("@Example.COM  ")).alias("email"))


_SPELLED_SQL = """
, asked AS (SELECT event_id, concat('CUSTOMER#', lpad(CAST(user_id AS VARCHAR), 9, '0'),
                                    if(event_type = 'error', '@else.example  ', '@Example.COM  ')) AS email FROM events),
keyed AS (SELECT *, lower(rtrim(email)) AS k FROM asked)
"""


@query("emails_taken", _SPELLED_SQL + "SELECT event_id, email FROM keyed WHERE k IN (SELECT email FROM users)")
def emails_taken(t):
    """JN9 under the source's collation: addresses that a user has, whatever their spelling."""
    return CO.text_join(_spelled(t), t.users.select("email"), "email", "left_semi")


@query("emails_inserted", _SPELLED_SQL + """
SELECT event_id, email, if(k NOT IN (SELECT email FROM users) AND event_id = min(event_id) OVER (PARTITION BY k), 'inserted', 'ignored') AS outcome
FROM keyed
""")
def emails_inserted(t):
    """SNK2 under the source's collation: insert-ignore of addresses, the first spelling wins."""
    return CO.insert_ignore_text(t.users.select("email"), _spelled(t), "email", ["event_id"])


@query("emails_repeated", _SPELLED_SQL + """
SELECT 'unique' AS "check", 'users' AS table_name, 'email' AS column_name, min(email) AS value, count(*) AS rows
FROM (SELECT email, k FROM keyed UNION ALL SELECT email, email FROM users) GROUP BY k HAVING count(*) > 1
""")
def emails_repeated(t):
    """DQ1 under the source's collation: addresses that several rows hold."""
    return CO.duplicate_texts(_spelled(t).select("email").unionByName(t.users.select("email")), "users", ["email"])


@query("user_search_collated", """
SELECT id, email, last_name FROM users
WHERE contains(lower(email), 'ustomer#00000001') OR contains(lower(last_name), 'ustomer#00000001') OR contains(phone, 'ustomer#00000001')
""")
def user_search_collated(t):
    """FLT3 under the source's collation: substring search without case and accents."""
    return CO.search_text(t.users, ["email", "last_name", "phone"], "ÜSTOMER#00000001").select("id", "email", "last_name")


@query("user_search_indexed", """
SELECT id, email, first_name, last_name, national_id, phone FROM users
WHERE email ILIKE '%r#0000001_3%' OR first_name ILIKE '%r#0000001_3%' OR last_name ILIKE '%r#0000001_3%'
   OR national_id ILIKE '%r#0000001_3%' OR phone ILIKE '%r#0000001_3%'
""")
def user_search_indexed(t):
    """FLT3 with trigram postings: the five-column search, a wildcard in the text, on the parts that can match."""
    cols = ["email", "first_name", "last_name", "national_id", "phone"]
    index = TextIndex.build(t.users, scratch_path(t.spark, "user_text"), cols, ["last_name", "id"], rows_per_part=500)
    return index.search("R#0000001_3").select("id", *cols)


def _visible(t, viewer, role):
    v = FL.visible_to(V.booking_view(t.bookings, t.schedules, t.routes, t.stations), viewer, role)
    return FL.filter_where(v, booking_status="pending")


_MINE = _BOOKINGS + " WHERE booking_status = 'pending' AND user_id = 11"


@query("visible_bookings", _MINE + " ORDER BY created_at DESC, booking_ref DESC LIMIT 10")
def visible_bookings(t):
    """FLT11/LIM1: first page of the pending bookings that passenger 11 may see."""
    return FL.paginate(_visible(t, 11, "passenger"), [F.desc("created_at"), F.desc("booking_ref")], 1, 10)


@query("visible_bookings_info", "".join((TRIPS, """
SELECT 1 AS page, 10 AS "limit", count(*) AS total, CAST(ceil(count(*) / 10.0) AS BIGINT) AS pages
FROM sale WHERE booking_status = 'pending' AND travel_date = DATE '1998-06-15'
""")))
def visible_bookings_info(t):
    """FLT11/FLT8/AGG9: pages of a staff member's list of the day's pending bookings."""
    v = _visible(t, 1, "staff").where(F.col("travel_date") == F.lit(AS_OF))
    return M.page_info(v, page=1, limit=10)


@query("booking_export", "SELECT booking_ref, seat_number, booking_status, amount_paid::DOUBLE AS amount_paid FROM bookings")
def booking_export(t):
    """SNK14: bookings written as CSV and read back."""
    from trackyard.session import scratch_path
    from trackyard.sources.sinks import export_csv
    df = t.bookings.select("booking_ref", "seat_number", "booking_status", "amount_paid")
    path = export_csv(df, scratch_path(t.spark, "export"))
    return t.spark.read.schema(df.schema).option("header", True).csv(path)
