"""The rail stand-in views as one SQL prefix, for the DuckDB oracle.

Same definitions as ``trackyard.sources.tables.RailTables``; every oracle
query is ``RAIL_CTES + <query>`` so both engines start from identical rows.
"""

RAIL_CTES = """
WITH RECURSIVE stations AS (
  SELECT CAST(n_nationkey + 1 AS BIGINT) AS id,
         concat('N', lpad(CAST(n_nationkey AS VARCHAR), 2, '0')) AS code,
         n_name AS name_en, concat('AR_', n_name) AS name_ar,
         r_name AS city_en, concat('AR_', r_name) AS city_ar,
         CASE WHEN n_nationkey % 12 = 11 THEN 0 ELSE 1 END AS active,
         CAST(16 + n_nationkey % 16 AS DECIMAL(9,6)) AS latitude, CAST(34 + n_nationkey % 22 AS DECIMAL(9,6)) AS longitude,
         CAST(DATE '1995-01-01' + n_nationkey AS TIMESTAMP) AS created_at
  FROM nation JOIN region ON r_regionkey = n_regionkey
), routes AS (
  SELECT s_suppkey + 1 AS id, concat('RT-', lpad(CAST(s_suppkey + 1 AS VARCHAR), 5, '0')) AS route_code,
         CAST(s_nationkey + 1 AS BIGINT) AS from_station_id,
         CAST((s_nationkey + 1 + s_suppkey % 24) % 25 + 1 AS BIGINT) AS to_station_id,
         CAST(80 + (s_suppkey * 53) % 1200 AS DECIMAL(8,2)) AS distance_km,
         CAST(60 + (s_suppkey * 17) % 300 AS INT) AS duration_minutes,
         CAST(2 * (50 + (s_suppkey * 37) % 400) AS DECIMAL(10,2)) AS price_first_class,
         CAST(50 + (s_suppkey * 37) % 400 AS DECIMAL(10,2)) AS price_economy,
         CAST(CASE WHEN s_suppkey % 7 = 0 THEN 0 ELSE 25 + (s_suppkey * 11) % 100 END AS DECIMAL(10,2)) AS price_student,
         CASE WHEN s_suppkey % 10 = 9 THEN 0 ELSE 1 END AS active,
         CASE WHEN s_suppkey % 6 <> 5 THEN s_suppkey + 1 END AS created_by,
         CAST(DATE '1995-01-01' + CAST(s_suppkey % 700 AS INT) AS TIMESTAMP) AS created_at,
         CAST(DATE '1995-01-01' + CAST(s_suppkey % 700 + s_suppkey % 30 AS INT) AS TIMESTAMP) AS updated_at
  FROM supplier
), schedules AS (
  SELECT o_orderkey AS id, concat('IR-', lpad(CAST(o_orderkey % 500 AS VARCHAR), 3, '0')) AS train_id,
         o_orderkey % (SELECT count(*) FROM supplier) + 1 AS route_id,
         concat(lpad(CAST(o_orderkey % 20 AS VARCHAR), 2, '0'), ':', lpad(CAST((o_orderkey % 4) * 15 AS VARCHAR), 2, '0'), ':00') AS departure_time,
         concat(lpad(CAST(o_orderkey % 20 + 3 AS VARCHAR), 2, '0'), ':', lpad(CAST((o_orderkey % 4) * 15 AS VARCHAR), 2, '0'), ':00') AS arrival_time,
         CAST(o_orderdate AS DATE) AS travel_date,
         CAST(8 + 4 * (o_orderkey % 5) AS INT) AS total_seats,
         CAST((o_orderkey * 7) % (9 + 4 * (o_orderkey % 5)) AS INT) AS available_seats,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'First Class' WHEN '5-LOW' THEN 'Student' ELSE 'Economy' END AS class,
         CASE WHEN o_orderstatus = 'F' THEN 'delayed' WHEN o_orderstatus = 'P' THEN 'cancelled'
              WHEN o_orderkey % 2 = 0 THEN 'active' ELSE 'scheduled' END AS status,
         CAST(CASE WHEN o_orderstatus = 'F' THEN 5 + o_orderkey % 40 ELSE 0 END AS INT) AS delay_minutes,
         CASE WHEN o_orderkey % 4 = 0 THEN concat('Platform ', CAST(o_orderkey % 8 AS VARCHAR)) END AS notes,
         CASE WHEN o_orderkey % 6 <> 5 THEN o_custkey END AS created_by,
         CAST(CAST(o_orderdate AS DATE) - CAST(30 + o_orderkey % 60 AS INT) AS TIMESTAMP) AS created_at,
         CAST(CAST(o_orderdate AS DATE) - CAST(30 + o_orderkey % 60 - o_orderkey % 20 AS INT) AS TIMESTAMP) AS updated_at
  FROM orders
), bookings AS (
  SELECT concat('BK-', CAST(l_orderkey AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR), '-', CAST(l_partkey AS VARCHAR), '-', CAST(l_suppkey AS VARCHAR)) AS booking_ref,
         l_partkey % (SELECT count(*) FROM customer) AS user_id, l_orderkey AS schedule_id,
         concat(CAST(CAST(floor((l_partkey % (8 + 4 * (l_orderkey % 5))) / 4) AS INT) + 1 AS VARCHAR),
                chr(CAST(65 + (l_partkey % (8 + 4 * (l_orderkey % 5))) % 4 AS INT))) AS seat_number,
         CAST(l_extendedprice AS DECIMAL(12,2)) AS amount_paid,
         CASE l_linenumber % 5 WHEN 0 THEN 'mada' WHEN 1 THEN 'visa' WHEN 2 THEN 'mastercard' WHEN 3 THEN 'apple_pay' ELSE 'cash' END AS payment_method,
         CASE WHEN l_returnflag = 'R' THEN 'refunded' ELSE 'paid' END AS payment_status,
         CASE WHEN l_returnflag = 'R' THEN 'cancelled' WHEN l_returnflag = 'A' THEN 'completed'
              WHEN l_linestatus = 'O' THEN 'pending' ELSE 'confirmed' END AS booking_status,
         l_shipdate AS created_at, l_orderkey * 8 + l_linenumber AS id,
         concat('Guest', CAST(l_partkey % 50 AS VARCHAR)) AS passenger_first, concat('No', CAST(l_suppkey AS VARCHAR)) AS passenger_last,
         CASE WHEN l_partkey % 5 <> 0 THEN concat('10', lpad(CAST(l_partkey AS VARCHAR), 8, '0')) END AS national_id,
         CASE WHEN l_linenumber % 3 <> 0 THEN concat('05', lpad(CAST(l_partkey AS VARCHAR), 8, '0')) END AS phone,
         CASE WHEN l_linenumber % 2 = 0 THEN concat('guest', CAST(l_partkey AS VARCHAR), '@example.com') END AS email,
         CASE WHEN l_returnflag IN ('R', 'A') OR l_linestatus <> 'O'
              THEN concat('RWSA-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR)) END AS qr_ref,
         CASE WHEN l_returnflag = 'R' THEN l_shipdate + to_days(l_linenumber % 4) END AS cancelled_at,
         CASE WHEN l_returnflag = 'R' AND l_linenumber % 2 = 0 THEN 'Changed plans' END AS cancel_reason,
         CASE WHEN l_returnflag = 'R' THEN l_shipdate + to_days(l_linenumber % 4) ELSE l_shipdate END AS updated_at
  FROM lineitem
), users AS (
  SELECT c_custkey AS id, concat(lower(c_name), '@example.com') AS email, c_mktsegment AS first_name, c_name AS last_name,
         CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE concat('05', lpad(CAST(c_custkey AS VARCHAR), 8, '0')) END AS phone,
         CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE concat('10', lpad(CAST(c_custkey AS VARCHAR), 8, '0')) END AS national_id,
         CASE WHEN c_custkey % 50 = 0 THEN 'admin' WHEN c_custkey % 10 = 1 THEN 'staff' ELSE 'passenger' END AS role,
         CASE WHEN c_custkey % 9 = 0 THEN 'inactive' ELSE 'active' END AS status,
         CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS verified,
         DATE '1995-01-01' + CAST(c_custkey % 2400 AS INT) AS created_at,
         CASE WHEN c_custkey % 5 = 0 THEN 'email' WHEN c_custkey % 3 = 0 THEN 'both' WHEN c_custkey % 2 = 0 THEN 'nafath' ELSE 'email' END AS auth_method,
         CASE WHEN c_custkey % 4 <> 0 THEN CAST(DATE '1995-01-01' + CAST(c_custkey % 2400 + c_custkey % 900 AS INT) AS TIMESTAMP) END AS last_login,
         CAST(DATE '1995-01-01' + CAST(c_custkey % 2400 + c_custkey % 300 AS INT) AS TIMESTAMP) AS updated_at
  FROM customer
), user_permissions AS (
  SELECT c_custkey AS user_id, CASE WHEN c_custkey % 50 = 0 OR c_custkey % 10 = 1 THEN 1 ELSE 0 END AS can_schedules,
         1 AS can_bookings, CASE WHEN c_custkey % 50 = 0 THEN 1 ELSE 0 END AS can_routes,
         CASE WHEN c_custkey % 50 = 0 THEN 1 ELSE 0 END AS can_users,
         CASE WHEN c_custkey % 50 = 0 OR c_custkey % 10 = 1 THEN 1 ELSE 0 END AS can_reports,
         CASE WHEN c_custkey % 50 = 0 OR c_custkey % 30 = 1 THEN 1 ELSE 0 END AS can_pricing
  FROM customer WHERE c_custkey % 3 <> 0
)
"""


# Routes with both ends (leg), schedules on them (trip) and bookings of those (sale).
TRIPS = """
, ends AS (
  SELECT id, {'code': code, 'name_en': name_en, 'name_ar': name_ar, 'city_en': city_en, 'city_ar': city_ar} AS st FROM stations
), leg AS (
  SELECT routes.id AS route_id, routes.* EXCLUDE (id, created_by, created_at, updated_at), o.st.name_en AS from_name_en, o.st.name_ar AS from_name_ar,
         o.st.code AS from_code, d.st.name_en AS to_name_en, d.st.name_ar AS to_name_ar, d.st.code AS to_code,
         o.st AS origin, d.st AS target
  FROM routes, ends o, ends d WHERE o.id = from_station_id AND d.id = to_station_id
), trip AS (
  SELECT * FROM schedules JOIN leg USING (route_id)
), sale AS (
  SELECT bookings.*, trip.* EXCLUDE (id, notes, created_by, created_at, updated_at) FROM bookings JOIN trip ON trip.id = schedule_id
)
"""


def with_rail(sql: str) -> str:
    """Prefix a query over the rail views with their definitions."""
    return RAIL_CTES + sql
