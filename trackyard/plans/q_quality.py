"""Registered data-quality queries (DQ1-DQ9)."""

from pyspark.sql import functions as F

from trackyard.operators import integrity as I
from trackyard.operators import materialize as MT
from trackyard.operators import quality as Q
from trackyard.plans.registry import query
from trackyard.session import scratch_path
from trackyard.sources import requests as RQ
from trackyard.sources.requests import AS_OF_TS
from trackyard.sources.schema import (DOMAINS, FOREIGN_KEYS, MAX_LENGTH, NOT_NULL, ROLES, SCHEDULE_STATUSES,
                                      UNIQUE_KEYS)


_STORED = """
, refresh_tokens AS (SELECT concat('tok-', CAST(event_id AS VARCHAR)) AS token, user_id, ts AS created_at, ts AS expires_at FROM events),
notifications AS (
  SELECT event_id AS id, user_id, CASE event_type WHEN 'purchase' THEN event_id // 2 * 8 + 1 END AS booking_id,
         CASE event_type WHEN 'click' THEN 'sms' WHEN 'view' THEN 'email' WHEN 'error' THEN 'fax' ELSE 'push' END AS type,
         CASE WHEN event_type <> 'signup' THEN concat('channel-', CAST(user_id AS VARCHAR)) END AS channel,
         CASE event_type WHEN 'view' THEN repeat('subject ', event_id % 40) END AS subject,
         concat('message ', CAST(event_id AS VARCHAR)) AS message,
         CASE event_type WHEN 'purchase' THEN 'queued' WHEN 'error' THEN 'failed' ELSE 'sent' END AS status, ts AS created_at FROM events),
occupancy_snapshots AS (SELECT id AS schedule_id FROM schedules),
revenue_daily AS (SELECT CAST(created_at AS DATE) AS report_date FROM bookings
                  UNION SELECT CAST(cancelled_at AS DATE) FROM bookings WHERE booking_status = 'cancelled')
"""
_COLUMNS = {"users": "email national_id role status first_name last_name phone verified auth_method created_at updated_at",
            "user_permissions": "user_id can_schedules can_bookings can_routes can_users can_reports can_pricing",
            "refresh_tokens": "token user_id created_at expires_at",
            "notifications": "user_id booking_id type channel subject message status created_at", "stations": "code name_en name_ar city_en city_ar",
            "routes": "route_code from_station_id to_station_id distance_km duration_minutes price_first_class "
                      "price_economy price_student active created_by created_at updated_at",
            "schedules": "route_id train_id departure_time arrival_time travel_date total_seats available_seats class status "
                         "delay_minutes created_by created_at updated_at",
            "bookings": "booking_ref user_id schedule_id seat_number amount_paid payment_method payment_status booking_status "
                        "passenger_first passenger_last national_id phone email qr_ref created_at updated_at",
            "revenue_daily": "report_date", "occupancy_snapshots": "schedule_id"}
_COLUMNS = {k: v.split() for k, v in _COLUMNS.items()}


def _tables(t):
    """The declared tables that the data can supply."""
    return {"users": t.users, "user_permissions": t.user_permissions, "refresh_tokens": RQ.tokens(t),
            "stations": t.stations, "routes": t.routes, "schedules": t.schedules, "bookings": t.bookings,
            "notifications": RQ.notifications(t),
            "revenue_daily": MT.revenue_daily(t.bookings),
            "occupancy_snapshots": MT.occupancy_snapshot(t.schedules, t.bookings, AS_OF_TS)}


def _each(parts):
    return _STORED + "\nUNION ALL ".join(parts)


def _listed(values):
    return ", ".join(f"'{v}'" for v in values)


@query("dq_unique", _each(
    f"""SELECT 'unique' AS "check", '{n}' AS table_name, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS rows
        FROM {n} WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) > 1"""
    for n, cols in UNIQUE_KEYS.items() for c in cols if c in _COLUMNS.get(n, ())))
def dq_unique(t):
    """DQ1: duplicate values of every declared unique key."""
    return Q.declared_unique(_tables(t))


def _fk_sql(users="users"):
    return _each(
        f"""SELECT 'foreign_key' AS "check", '{n}' AS table_name, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS rows
            FROM {n} ANTI JOIN {users if p == 'users' else p} parent ON parent.{pc} = {n}.{c} WHERE {c} IS NOT NULL GROUP BY {c}"""
        for n, c, p, pc, _ in FOREIGN_KEYS if c in _COLUMNS.get(n, ()))


@query("dq_foreign_keys", _fk_sql())
def dq_foreign_keys(t):
    """DQ2: child keys without a parent, for every declared foreign key."""
    return Q.declared_foreign_keys(_tables(t))


@query("dq_foreign_keys_after_purge", _fk_sql("(SELECT * FROM users WHERE status = 'active')"))
def dq_foreign_keys_after_purge(t):
    """DQ2: the rows that deleting all users who are not active would orphan."""
    return Q.declared_foreign_keys(_tables(t) | {"users": t.users.where(F.col("status") == "active")})


@query("fk_cascade_permissions", """
SELECT p.* FROM user_permissions p WHERE p.user_id NOT IN (SELECT id FROM users WHERE status = 'inactive')
""")
def fk_cascade_permissions(t):
    """DQ2: ON DELETE CASCADE of permissions when inactive users are deleted."""
    gone = t.users.where(F.col("status") == "inactive")
    return Q.fk_effects(gone, t.user_permissions, "user_id", "cascade")


@query("fk_restrict_bookings", """
SELECT COUNT(*) AS blocking_bookings, COUNT(DISTINCT user_id) AS blocked_users
FROM bookings WHERE user_id IN (SELECT id FROM users WHERE status = 'inactive')
""")
def fk_restrict_bookings(t):
    """DQ2: bookings that RESTRICT deleting inactive users."""
    gone = t.users.where(F.col("status") == "inactive")
    r = Q.fk_effects(gone, t.bookings, "user_id", "restrict")
    return r.agg(F.count(F.lit(1)).alias("blocking_bookings"),
                 F.countDistinct("user_id").alias("blocked_users"))


def _purge(t):
    """The declared tables with stand-in notifications and audit logs, and a batch of deletes over six of them:
    accounts that are inactive, everything stored for the verified ones, and what is cancelled or out of use."""
    path = scratch_path(t.spark, "purge_bookings")           # made distinct once, not by each use
    t.bookings.dropDuplicates(["booking_ref"]).select(F.col("booking_ref").alias("id"), "user_id", "schedule_id",
                                                      "payment_method").write.parquet(path)
    bookings = t.spark.read.parquet(path)
    tables = {"users": t.users, "user_permissions": t.user_permissions, "refresh_tokens": RQ.tokens(t),
              "stations": t.stations, "routes": t.routes.withColumn("created_by", F.col("id")),
              "schedules": t.schedules.withColumn("created_by", F.col("route_id")), "bookings": bookings,
              "notifications": bookings.where("payment_method = 'visa'").select("id", "user_id", F.col("id").alias("booking_id")),
              "audit_logs": t.events.select(F.col("event_id").alias("id"), "user_id"),
              "occupancy_snapshots": t.schedules.select(F.col("id").alias("schedule_id"), "travel_date")}
    left = t.users.where("status = 'inactive'")
    verified = left.where("verified = 1").select(F.col("id").alias("user_id"))
    mine = tables["bookings"].join(verified, "user_id", "left_semi").select("id")
    told = tables["notifications"].join(left.where("verified = 1 AND phone IS NOT NULL").select(F.col("id").alias("user_id")),
                                        "user_id", "left_semi").select("id")
    trips = t.schedules.where("status = 'cancelled'").select("id")
    of_trips = bookings.join(trips.select(F.col("id").alias("schedule_id")), "schedule_id", "left_semi").where("user_id % 4 > 0")
    return tables, {"users": left, "bookings": mine.unionByName(of_trips.select("id")), "notifications": told,
                    "schedules": trips, "routes": t.routes.where("active = 0"), "stations": t.stations.where("active = 0")}


_PURGE_SQL = """
, b AS (SELECT DISTINCT ON (booking_ref) booking_ref AS id, user_id, schedule_id, payment_method FROM bookings),
n AS (SELECT id, user_id, id AS booking_id FROM b WHERE payment_method = 'visa'),
off AS (SELECT id, verified, phone FROM users WHERE status = 'inactive'),
asked(t, k) AS (
  SELECT 'users', CAST(id AS VARCHAR) FROM off
  UNION SELECT 'bookings', id FROM b WHERE user_id IN (SELECT id FROM off WHERE verified = 1)
     OR (user_id % 4 > 0 AND schedule_id IN (SELECT id FROM schedules WHERE status = 'cancelled'))
  UNION SELECT 'notifications', id FROM n WHERE user_id IN (SELECT id FROM off WHERE verified = 1 AND phone IS NOT NULL)
  UNION SELECT 'schedules', CAST(id AS VARCHAR) FROM schedules WHERE status = 'cancelled'
  UNION SELECT 'routes', CAST(id AS VARCHAR) FROM routes WHERE active = 0
  UNION SELECT 'stations', CAST(id AS VARCHAR) FROM stations WHERE active = 0),
held(ct, ck, t, k) AS (
  SELECT 'bookings', id, 'users', CAST(user_id AS VARCHAR) FROM b
  UNION ALL SELECT 'bookings', id, 'schedules', CAST(schedule_id AS VARCHAR) FROM b
  UNION ALL SELECT 'notifications', id, 'users', CAST(user_id AS VARCHAR) FROM n
  UNION ALL SELECT 'schedules', CAST(id AS VARCHAR), 'routes', CAST(route_id AS VARCHAR) FROM schedules
  UNION ALL SELECT 'routes', CAST(id AS VARCHAR), 'stations', CAST(from_station_id AS VARCHAR) FROM routes
  UNION ALL SELECT 'routes', CAST(id AS VARCHAR), 'stations', CAST(to_station_id AS VARCHAR) FROM routes),
e AS (SELECT held.* FROM held SEMI JOIN asked USING (t, k)),
refused(t, k) AS (
  SELECT t, k FROM e WHERE NOT EXISTS (FROM asked a WHERE a.t = e.ct AND a.k = e.ck)
  UNION
  SELECT e.t, e.k FROM refused r JOIN e ON e.ct = r.t AND e.ck = r.k),
gone AS (SELECT * FROM asked ANTI JOIN refused USING (t, k)),
gone_users AS (SELECT CAST(k AS BIGINT) AS id FROM gone WHERE t = 'users'),
gone_trips AS (SELECT CAST(k AS BIGINT) AS id FROM gone WHERE t = 'schedules')
"""

_PURGE_EFFECTS = _PURGE_SQL + """
SELECT t AS table_name, CAST(NULL AS VARCHAR) AS column_name, 'deleted' AS effect, count(*) AS rows FROM gone GROUP BY t
UNION ALL SELECT t, NULL, 'restricted', count(*) FROM refused SEMI JOIN asked USING (t, k) GROUP BY t
UNION ALL SELECT 'user_permissions', 'user_id', 'cascade', count(*) FROM user_permissions WHERE user_id IN (FROM gone_users)
UNION ALL SELECT 'refresh_tokens', 'user_id', 'cascade', count(*) FROM events WHERE user_id IN (FROM gone_users)
UNION ALL SELECT 'audit_logs', 'user_id', 'set_null', count(*) FROM events WHERE user_id IN (FROM gone_users)
UNION ALL SELECT 'occupancy_snapshots', 'schedule_id', 'cascade', count(*) FROM gone_trips
UNION ALL SELECT 'routes', 'created_by', 'set_null', count(*) FROM routes
  WHERE id IN (FROM gone_users) AND CAST(id AS VARCHAR) NOT IN (SELECT k FROM gone WHERE t = 'routes')
UNION ALL SELECT 'schedules', 'created_by', 'set_null', count(*) FROM schedules
  WHERE route_id IN (FROM gone_users) AND id NOT IN (FROM gone_trips)
UNION ALL SELECT 'notifications', 'booking_id', 'set_null', count(*) FROM n
  WHERE booking_id IN (SELECT k FROM gone WHERE t = 'bookings') AND id NOT IN (SELECT k FROM gone WHERE t = 'notifications')
"""


@query("delete_effects", _PURGE_EFFECTS)
def delete_effects(t):
    """DQ2: a batch of deletes over the whole key graph, rows per table and effect."""
    return I.delete_rows(*_purge(t)).effects


@query("delete_outcomes", _PURGE_SQL + """
SELECT t AS table_name, k AS key, if((t, k) IN (SELECT (t, k) FROM gone), 'deleted', 'restricted') AS outcome FROM asked
""")
def delete_outcomes(t):
    """DQ2: what became of each requested delete."""
    return I.delete_rows(*_purge(t)).outcomes


@query("audit_logs_after_delete", _PURGE_SQL + """
SELECT event_id AS id, if(user_id IN (FROM gone_users), NULL, user_id) AS user_id FROM events
""")
def audit_logs_after_delete(t):
    """DQ2: audit logs once the deletes are done: ON DELETE SET NULL."""
    return I.delete_rows(*_purge(t)).tables["audit_logs"]


@query("dq_domains", _each(
    f"""SELECT 'domain' AS "check", '{n}' AS table_name, '{c}' AS column_name, {c} AS value, count(*) AS rows
        FROM {n} WHERE {c} NOT IN ({_listed(domain)}) GROUP BY {c}"""
    for n, cols in DOMAINS.items() for c, domain in cols.items() if c in _COLUMNS.get(n, ())))
def dq_domains(t):
    """DQ3: values outside every declared enum domain."""
    return Q.declared_domains(_tables(t))


@query("dq_nulls_lengths", _each(
    [f"""SELECT 'not_null' AS "check", '{n}' AS table_name, '{c}' AS column_name, CAST(NULL AS VARCHAR) AS value,
                count(*) FILTER ({c} IS NULL) AS rows FROM {n}"""
     for n, cols in NOT_NULL.items() for c in cols if c in _COLUMNS.get(n, ())]
    + [f"SELECT 'max_length', '{n}', '{c}', '{most}', count(*) FILTER (length({c}) > {most}) FROM {n}"
       for n, cols in MAX_LENGTH.items() for c, most in cols.items() if c in _COLUMNS.get(n, ())]))
def dq_nulls_lengths(t):
    """DQ4: NULLs in NOT NULL columns and over-long strings, for every declared one."""
    return Q.declared_nulls_lengths(_tables(t))


def _broken(key, rules):
    return "SELECT %s, field, 'Invalid value' AS message FROM (%s)" % (key, " UNION ALL ".join(
        f"SELECT {key}, '{field}' AS field FROM rows WHERE NOT coalesce({ok}, false)" for field, ok in rules))


@query("dq_route_rules", """
, rows AS (SELECT s_suppkey AS id, if(s_suppkey % 9 = 0, '', concat('NR-', CAST(s_suppkey AS VARCHAR))) AS route_code,
                  s_nationkey AS from_station_id, s_nationkey + 1 AS to_station_id, CAST(s_suppkey % 5 AS DECIMAL(8,2)) AS distance_km,
                  CAST(s_suppkey % 4 AS INT) AS duration_minutes, CAST(s_acctbal AS DECIMAL(10,2)) AS price_first_class,
                  CAST(s_acctbal AS DECIMAL(10,2)) AS price_economy, CAST(NULL AS DECIMAL(10,2)) AS price_student FROM supplier)
""" + _broken("id", [("routeCode", "length(route_code) BETWEEN 1 AND 20"), ("fromStationId", "from_station_id >= 1"),
                     ("toStationId", "to_station_id >= 1"), ("distanceKm", "distance_km >= 1"),
                     ("durationMinutes", "duration_minutes >= 1"), ("priceFirstClass", "price_first_class >= 0"),
                     ("priceEconomy", "price_economy >= 0"), ("priceStudent", "price_student >= 0")]))
def dq_route_rules(t):
    """DQ5: validator rules on new routes."""
    return Q.validate(RQ.route_rows(t), "id", Q.route_rules())


@query("dq_user_rules", """
, rows AS (SELECT event_id AS id, if(event_type = 'click', 'no address', concat('u', CAST(user_id AS VARCHAR), '@example.com')) AS email,
                  left(concat('pw', CAST(event_id AS VARCHAR)), 5 + event_id % 3) AS password, if(event_type = 'error', '', 'New') AS first_name,
                  'User' AS last_name, if(event_type = 'view', 'guest', 'staff') AS role,
                  if(event_id % 2 = 0, concat('+9665', CAST(10000000 + event_id AS VARCHAR)), 'none') AS phone,
                  if(event_id % 3 = 0, NULL, left(CAST(10000000000 + event_id AS VARCHAR), 9 + event_id % 2)) AS national_id FROM events)
""" + _broken("id", [("email", "regexp_matches(email, '^[^@[:space:]]+@[^@[:space:].]+([.][^@[:space:].]+)+$')"),
                     ("password", "length(password) >= 6"), ("firstName", "length(first_name) BETWEEN 1 AND 100"),
                     ("lastName", "length(last_name) BETWEEN 1 AND 100"), ("role", f"role IN ({_listed(ROLES)})"),
                     ("phone", "phone IS NULL OR regexp_matches(phone, '^[+]?[0-9]{7,15}$')"),
                     ("nationalId", "national_id IS NULL OR length(national_id) = 10")]))
def dq_user_rules(t):
    """DQ5: validator rules on new users."""
    return Q.validate(RQ.user_rows(t), "id", Q.user_rules())


@query("dq_patch_rules", """
, rows AS (SELECT event_id AS id, if(event_type = 'error', 'lost', NULL) AS status FROM events)
""" + _broken("id", [("status", f"status IS NULL OR status IN ({_listed(SCHEDULE_STATUSES)})")]))
def dq_patch_rules(t):
    """DQ5: validator rules on schedule patches."""
    rows = t.events.select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "error", "lost").alias("status"))
    return Q.validate(rows, "id", Q.schedule_patch_rules())


@query("dq_request_rules", """
SELECT request_id, field, 'Invalid value' AS message FROM (
  SELECT booking_ref AS request_id, 'scheduleId' AS field FROM bookings
  WHERE created_at >= TIMESTAMP '1998-06-15' AND NOT (schedule_id >= 1)
  UNION ALL SELECT booking_ref, 'seatNumber' FROM bookings
  WHERE created_at >= TIMESTAMP '1998-06-15' AND NOT (seat_number IS NOT NULL AND length(seat_number) > 0 AND length(seat_number) <= 10)
  UNION ALL SELECT booking_ref, 'paymentMethod' FROM bookings
  WHERE created_at >= TIMESTAMP '1998-06-15' AND payment_method NOT IN ('mada', 'visa', 'mastercard', 'apple_pay', 'cash')
)
""")
def dq_request_rules(t):
    """DQ5: validator rules on incoming booking requests -> (request, field, message)."""
    _, reqs = RQ.history_and_requests(t)
    return Q.validate(reqs, "request_id", Q.booking_request_rules())


@query("dq_schedule_rules", """
, rows AS (
  SELECT 1000000 + event_id AS id, concat('IR-N', CAST(event_id AS VARCHAR)) AS train_id, user_id AS route_id,
         '08:00:00' AS departure_time, '11:00' AS arrival_time, CAST(ts AS DATE) AS travel_date,
         CAST(8 + 4 * (event_id % 5) AS INT) AS total_seats, 'Economy' AS class
  FROM events WHERE event_type = 'signup'
)
SELECT id, field, 'Invalid value' AS message FROM (
  SELECT id, 'trainId' AS field FROM rows WHERE NOT COALESCE(train_id IS NOT NULL AND length(train_id) > 0, FALSE)
  UNION ALL SELECT id, 'routeId' FROM rows WHERE NOT COALESCE(route_id >= 1, FALSE)
  UNION ALL SELECT id, 'departureTime' FROM rows WHERE NOT COALESCE(regexp_matches(departure_time, '^\\d{2}:\\d{2}(:\\d{2})?$'), FALSE)
  UNION ALL SELECT id, 'arrivalTime' FROM rows WHERE NOT COALESCE(regexp_matches(arrival_time, '^\\d{2}:\\d{2}(:\\d{2})?$'), FALSE)
  UNION ALL SELECT id, 'travelDate' FROM rows WHERE travel_date IS NULL
  UNION ALL SELECT id, 'totalSeats' FROM rows WHERE NOT COALESCE(total_seats BETWEEN 1 AND 1000, FALSE)
  UNION ALL SELECT id, 'class' FROM rows WHERE NOT COALESCE(class IN ('First Class', 'Economy', 'Student'), FALSE)
)
""")
def dq_schedule_rules(t):
    """DQ5: validator rules on new schedule rows (time pattern, seats 1..1000, class ...)."""
    e = t.events.where(F.col("event_type") == "signup")
    rows = e.select((F.col("event_id") + 1000000).alias("id"),
                    F.concat(F.lit("IR-N"), F.col("event_id").cast("string")).alias("train_id"),
                    F.col("user_id").alias("route_id"),
                    F.lit("08:00:00").alias("departure_time"), F.lit("11:00").alias("arrival_time"),
                    F.to_date("ts").alias("travel_date"),
                    (8 + 4 * (F.col("event_id") % 5)).cast("int").alias("total_seats"),
                    F.lit("Economy").alias("class"))
    return Q.validate(rows, "id", Q.schedule_rules())


@query("dq_cross_column", """
SELECT 'from_equals_to' AS "check", 'routes' AS table_name, 'to_station_id' AS column_name, CAST(NULL AS VARCHAR) AS value,
       COUNT(*) AS rows FROM routes WHERE from_station_id = to_station_id
UNION ALL SELECT 'seats_out_of_range', 'schedules', 'available_seats', NULL, COUNT(*) FROM schedules
WHERE available_seats < 0 OR available_seats > total_seats
""")
def dq_cross_column(t):
    """DQ6: from = to stations; available seats outside 0..total."""
    return Q.cross_column(t.routes, t.schedules)


@query("seat_drift", """
SELECT * FROM (
  SELECT s.id AS schedule_id, s.total_seats, s.available_seats,
         CAST(s.total_seats - COALESCE(n.c, 0) AS BIGINT) AS expected_available,
         CAST(s.available_seats - (s.total_seats - COALESCE(n.c, 0)) AS BIGINT) AS drift
  FROM schedules s LEFT JOIN (SELECT schedule_id, COUNT(*) AS c FROM bookings WHERE booking_status <> 'cancelled' GROUP BY 1) n
    ON n.schedule_id = s.id
) WHERE drift <> 0
""")
def seat_drift(t):
    """DQ7: stored available seats vs total - bookings that hold a seat."""
    return Q.seat_drift(t.schedules, t.bookings)


@query("double_sold", """
SELECT schedule_id, seat_number, COUNT(*) AS bookings FROM bookings
WHERE booking_status IN ('confirmed', 'pending') GROUP BY 1, 2 HAVING COUNT(*) > 1
""")
def double_sold(t):
    """DQ8: seats held by more than one live booking."""
    return Q.double_sold(t.bookings)


@query("double_sold_rows", """
SELECT b.* REPLACE (CAST(b.amount_paid AS DOUBLE) AS amount_paid) FROM bookings b
WHERE b.booking_status IN ('confirmed', 'pending')
  AND (b.schedule_id, b.seat_number) IN (SELECT schedule_id, seat_number FROM bookings
       WHERE booking_status IN ('confirmed', 'pending') GROUP BY 1, 2 HAVING COUNT(*) > 1)
""")
def double_sold_rows(t):
    """DQ8: the live bookings in double-sold seat groups."""
    return Q.double_sold_rows(t.bookings)
