"""Declared rail schema: Spark types, keys and value domains.

Fixed values (must equal the studied application's declared schema):
enum domains, unique keys and foreign keys as declared for its MySQL tables.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values: enum domains -------------------------------------------
ROLES = ("admin", "staff", "passenger")
USER_STATUSES = ("active", "inactive", "pending")
AUTH_METHODS = ("email", "nafath", "both")
TRAIN_CLASSES = ("First Class", "Economy", "Student")
SCHEDULE_STATUSES = ("scheduled", "active", "delayed", "cancelled")
PAYMENT_METHODS = ("mada", "visa", "mastercard", "apple_pay", "cash")
PAYMENT_STATUSES = ("pending", "paid", "refunded", "failed")
BOOKING_STATUSES = ("confirmed", "completed", "cancelled", "pending")
NOTIFICATION_TYPES = ("sms", "email", "push")
NOTIFICATION_STATUSES = ("sent", "failed", "pending")

# booking states that hold a seat (seat map, seat-taken check)
SEAT_HOLDING = ("confirmed", "pending")
# booking states counted as passengers in dashboard metrics
TRAVELLED = ("confirmed", "completed")

# ---- fixed values: keys ------------------------------------------------------
UNIQUE_KEYS = {
    "users": ("email", "national_id"),
    "user_permissions": ("user_id",),
    "refresh_tokens": ("token",),
    "stations": ("code",),
    "routes": ("route_code",),
    "bookings": ("booking_ref", "qr_ref"),
    "revenue_daily": ("report_date",),
}

# child table, child column, parent table, parent column, on delete
FOREIGN_KEYS = (
    ("user_permissions", "user_id", "users", "id", "cascade"),
    ("refresh_tokens", "user_id", "users", "id", "cascade"),
    ("routes", "from_station_id", "stations", "id", "restrict"),
    ("routes", "to_station_id", "stations", "id", "restrict"),
    ("routes", "created_by", "users", "id", "set_null"),
    ("schedules", "route_id", "routes", "id", "restrict"),
    ("schedules", "created_by", "users", "id", "set_null"),
    ("bookings", "user_id", "users", "id", "restrict"),
    ("bookings", "schedule_id", "schedules", "id", "restrict"),
    ("notifications", "user_id", "users", "id", "restrict"),
    ("notifications", "booking_id", "bookings", "id", "set_null"),
    ("audit_logs", "user_id", "users", "id", "set_null"),
    ("occupancy_snapshots", "schedule_id", "schedules", "id", "cascade"),
)

DOMAINS = {
    "users": {"role": ROLES, "status": USER_STATUSES, "auth_method": AUTH_METHODS},
    "schedules": {"class": TRAIN_CLASSES, "status": SCHEDULE_STATUSES},
    "bookings": {"payment_method": PAYMENT_METHODS, "payment_status": PAYMENT_STATUSES,
                 "booking_status": BOOKING_STATUSES},
    "notifications": {"type": NOTIFICATION_TYPES, "status": NOTIFICATION_STATUSES},
}

# NOT NULL columns and VARCHAR limits of the declared tables (those that the
# rail views carry).
NOT_NULL = {
    "users": ("email", "first_name", "last_name", "role", "status", "verified", "auth_method", "created_at",
              "updated_at"),
    "user_permissions": ("user_id", "can_schedules", "can_bookings", "can_routes", "can_users", "can_reports",
                         "can_pricing"),
    "refresh_tokens": ("user_id", "token", "expires_at", "created_at"),
    "stations": ("code", "name_en", "name_ar", "city_en", "city_ar"),
    "routes": ("route_code", "from_station_id", "to_station_id", "distance_km",
               "duration_minutes", "price_first_class", "price_economy", "price_student", "active", "created_at",
               "updated_at"),
    "schedules": ("train_id", "route_id", "departure_time", "arrival_time", "travel_date",
                  "total_seats", "available_seats", "class", "status", "delay_minutes", "created_at", "updated_at"),
    "bookings": ("booking_ref", "user_id", "schedule_id", "seat_number", "passenger_first", "passenger_last",
                 "amount_paid", "payment_method", "payment_status", "booking_status", "created_at", "updated_at"),
    "notifications": ("user_id", "type", "channel", "message", "status", "created_at"),
}
MAX_LENGTH = {
    "users": {"email": 255, "first_name": 100, "last_name": 100, "phone": 20, "national_id": 20},
    "stations": {"code": 10, "name_en": 100, "name_ar": 100, "city_en": 100, "city_ar": 100},
    "routes": {"route_code": 20},
    "schedules": {"train_id": 20},
    "bookings": {"booking_ref": 20, "seat_number": 10, "passenger_first": 100, "passenger_last": 100,
                 "national_id": 20, "phone": 20, "email": 255, "qr_ref": 50},
    "refresh_tokens": {"token": 512},
    "notifications": {"channel": 100, "subject": 255},
}

_TS = T.TimestampNTZType()

STATIONS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("code", T.StringType(), False),
    T.StructField("name_en", T.StringType(), False),
    T.StructField("name_ar", T.StringType(), False),
    T.StructField("city_en", T.StringType(), False),
    T.StructField("city_ar", T.StringType(), False),
    T.StructField("latitude", T.DecimalType(9, 6), True),
    T.StructField("longitude", T.DecimalType(9, 6), True),
    T.StructField("active", T.IntegerType(), False),
])

ROUTES = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("route_code", T.StringType(), False),
    T.StructField("from_station_id", T.LongType(), False),
    T.StructField("to_station_id", T.LongType(), False),
    T.StructField("distance_km", T.DecimalType(8, 2), False),
    T.StructField("duration_minutes", T.IntegerType(), False),
    T.StructField("price_first_class", T.DecimalType(10, 2), False),
    T.StructField("price_economy", T.DecimalType(10, 2), False),
    T.StructField("price_student", T.DecimalType(10, 2), False),
    T.StructField("active", T.IntegerType(), False),
])

USERS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("email", T.StringType(), False),
    T.StructField("first_name", T.StringType(), False),
    T.StructField("last_name", T.StringType(), False),
    T.StructField("phone", T.StringType(), True),
    T.StructField("national_id", T.StringType(), True),
    T.StructField("role", T.StringType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("verified", T.IntegerType(), False),
    T.StructField("created_at", T.DateType(), False),
])

PERMISSIONS = T.StructType([
    T.StructField("user_id", T.LongType(), False),
    T.StructField("can_schedules", T.IntegerType(), False),
    T.StructField("can_bookings", T.IntegerType(), False),
    T.StructField("can_routes", T.IntegerType(), False),
])

SCHEDULES = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("train_id", T.StringType(), False),
    T.StructField("route_id", T.LongType(), False),
    T.StructField("departure_time", T.StringType(), False),
    T.StructField("arrival_time", T.StringType(), False),
    T.StructField("travel_date", T.DateType(), False),
    T.StructField("total_seats", T.IntegerType(), False),
    T.StructField("available_seats", T.IntegerType(), False),
    T.StructField("class", T.StringType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("delay_minutes", T.IntegerType(), False),
])

BOOKINGS = T.StructType([
    T.StructField("booking_ref", T.StringType(), False),
    T.StructField("user_id", T.LongType(), False),
    T.StructField("schedule_id", T.LongType(), False),
    T.StructField("seat_number", T.StringType(), False),
    T.StructField("amount_paid", T.DecimalType(12, 2), False),
    T.StructField("payment_method", T.StringType(), False),
    T.StructField("payment_status", T.StringType(), False),
    T.StructField("booking_status", T.StringType(), False),
    T.StructField("created_at", _TS, False),
])

# The declared tables as they are stored and read: the columns above, which the operators need, and the rest.
_INT, _LONG, _STRING = T.IntegerType(), T.LongType(), T.StringType()
_REST = {
    "stations": (STATIONS, {"created_at": _TS}),
    "routes": (ROUTES, {"created_by": _LONG, "created_at": _TS, "updated_at": _TS}),
    "schedules": (SCHEDULES, {"notes": _STRING, "created_by": _LONG, "created_at": _TS, "updated_at": _TS}),
    "bookings": (BOOKINGS, {"id": _LONG, "passenger_first": _STRING, "passenger_last": _STRING, "national_id": _STRING,
                            "phone": _STRING, "email": _STRING, "qr_ref": _STRING, "cancelled_at": _TS,
                            "cancel_reason": _STRING, "updated_at": _TS}),
    "users": (USERS, {"auth_method": _STRING, "last_login": _TS, "updated_at": _TS}),
    "user_permissions": (PERMISSIONS, {"can_users": _INT, "can_reports": _INT, "can_pricing": _INT}),
}
DECLARED = {name: T.StructType([*core.fields, *[T.StructField(c, t) for c, t in rest.items()]])
            for name, (core, rest) in _REST.items()}

# Seat-admission request (one row per booking attempt).
REQUESTS = T.StructType([
    T.StructField("request_id", T.StringType(), False),
    T.StructField("ts", _TS, False),
    T.StructField("user_id", T.LongType(), True),
    T.StructField("schedule_id", T.LongType(), False),
    T.StructField("seat_number", T.StringType(), False),
    T.StructField("payment_method", T.StringType(), True),
])
