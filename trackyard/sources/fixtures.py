"""The seed fixture (SRC3): the studied application's seed rows as DataFrames.

Fixed values: the seed rows below equal the application's seed script, in
its order; ids are assigned 1..n in that order as AUTO_INCREMENT would.
The seed's INSERT ... SELECT rows (permissions by e-mail, bookings by
e-mail and train id with LIMIT 1) are resolved with joins (SNK3).
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from trackyard.sources import schema as S

# ---- fixed values: seed rows -------------------------------------------------
STATIONS = [
    ("RUH", "Riyadh Central", "الرياض المركزية", "Riyadh", "الرياض", "24.7136", "46.6753"),
    ("JED", "Jeddah North", "جدة الشمالية", "Jeddah", "جدة", "21.4858", "39.1925"),
    ("MKK", "Makkah Station", "محطة مكة", "Makkah", "مكة", "21.3891", "39.8579"),
    ("MED", "Madinah Station", "محطة المدينة", "Madinah", "المدينة", "24.4672", "39.6151"),
    ("DMM", "Dammam Port", "ميناء الدمام", "Dammam", "الدمام", "26.4207", "50.0888"),
    ("JBL", "Jubail Industrial", "الجبيل الصناعية", "Jubail", "الجبيل", "27.0174", "49.6581"),
]
ROUTES = [
    ("RT-001", 1, 2, 980, 300, "350.00", "180.00", "90.00", 1),
    ("RT-002", 1, 5, 400, 150, "220.00", "120.00", "60.00", 1),
    ("RT-003", 2, 3, 80, 60, "120.00", "50.00", "30.00", 1),
    ("RT-004", 1, 4, 1200, 360, "420.00", "250.00", "120.00", 1),
    ("RT-005", 5, 6, 100, 60, "150.00", "80.00", "40.00", 1),
    ("RT-006", 2, 1, 980, 300, "350.00", "180.00", "90.00", 1),
]
USERS = [
    ("admin@railwaysa.com", "Abdullah", "Al-Rashidi", "0551234567", "admin", "active", 1),
    ("staff@railwaysa.com", "Sara", "Al-Qahtani", "0559876543", "staff", "active", 1),
    ("user@railwaysa.com", "Mohammed", "Al-Ghamdi", "0508765432", "passenger", "active", 1),
]
# (e-mail, can_schedules, can_bookings, can_routes, can_users, can_reports, can_pricing)
PERMISSIONS = [
    ("admin@railwaysa.com", 1, 1, 1, 1, 1, 1),
    ("staff@railwaysa.com", 1, 1, 0, 0, 1, 0),
    ("user@railwaysa.com", 0, 1, 0, 0, 0, 0),
]
# travel_date = the day the seed runs (as_of)
SCHEDULES = [
    ("IR-401", 1, "08:30:00", "13:30:00", 200, 24, "First Class", "active"),
    ("IR-205", 2, "09:15:00", "11:45:00", 150, 8, "Economy", "active"),
    ("HR-103", 3, "10:00:00", "11:00:00", 300, 0, "Economy", "delayed"),
    ("IR-302", 4, "10:45:00", "16:45:00", 200, 41, "First Class", "active"),
    ("IR-210", 2, "11:30:00", "14:00:00", 150, 0, "Economy", "cancelled"),
    ("HR-201", 3, "12:00:00", "13:00:00", 300, 55, "Student", "active"),
    ("IR-403", 1, "14:00:00", "19:00:00", 200, 90, "Economy", "scheduled"),
    ("IR-306", 4, "15:30:00", "21:30:00", 200, 12, "First Class", "active"),
]
# (ref, user e-mail, train id, seat, first, last, national id, phone, e-mail,
#  amount, method, payment status, booking status, qr ref)
BOOKINGS = [
    ("BK-9182", "user@railwaysa.com", "IR-401", "14A", "Mohammed", "Al-Ghamdi", "1093847261",
     "0508765432", "user@railwaysa.com", "350.00", "mada", "paid", "confirmed", "RWSA-BK9182"),
    ("BK-9155", "user@railwaysa.com", "HR-103", "22B", "Mohammed", "Al-Ghamdi", "1093847261",
     "0508765432", "user@railwaysa.com", "50.00", "apple_pay", "paid", "completed", "RWSA-BK9155"),
]


class Seed:
    """Seed tables in the rail-view schema, dated ``as_of``."""

    def __init__(self, spark: SparkSession, as_of: dt.date):
        self.spark = spark
        self.as_of = as_of
        ts = dt.datetime(as_of.year, as_of.month, as_of.day, 9, 0, 0)
        self.ts = ts
        self.stations = spark.createDataFrame(
            [(i + 1, c, ne, na, ce, ca, D(lat), D(lon), 1)
             for i, (c, ne, na, ce, ca, lat, lon) in enumerate(STATIONS)], S.STATIONS)
        self.routes = spark.createDataFrame(
            [(i + 1, rc, f, t, D(dk), dm, D(p1), D(p2), D(p3), a)
             for i, (rc, f, t, dk, dm, p1, p2, p3, a) in enumerate(ROUTES)], S.ROUTES)
        self.users = spark.createDataFrame(
            [(i + 1, e, fn, ln, ph, None, r, st, v, as_of)
             for i, (e, fn, ln, ph, r, st, v) in enumerate(USERS)], S.USERS)
        perm_rows = spark.createDataFrame(PERMISSIONS, "email string, can_schedules int, "
                                          "can_bookings int, can_routes int, can_users int, "
                                          "can_reports int, can_pricing int")
        # INSERT ... SELECT id FROM users WHERE email = ... (join, not a loop)
        self.user_permissions = (perm_rows.join(self.users.select("id", "email"), "email")
                                 .select(F.col("id").alias("user_id"), "can_schedules", "can_bookings", "can_routes",
                                         "can_users", "can_reports", "can_pricing"))
        self.schedules = spark.createDataFrame(
            [(i + 1, tr, r, dep, arr, as_of, tot, av, cl, st, 0)
             for i, (tr, r, dep, arr, tot, av, cl, st) in enumerate(SCHEDULES)], S.SCHEDULES)
        rows = spark.createDataFrame(
            [(ref, em, tr, seat, D(amt), pm, ps, bs, ts)
             for (ref, em, tr, seat, _f, _l, _n, _p, _e, amt, pm, ps, bs, _q) in BOOKINGS],
            "booking_ref string, email string, train_id string, seat_number string, "
            "amount_paid decimal(12,2), payment_method string, payment_status string, "
            "booking_status string, created_at timestamp_ntz")
        # FROM users u, schedules s WHERE u.email = ? AND s.train_id = ? LIMIT 1:
        # an equi join on both keys, first schedule id per booking.
        sched = self.schedules.select(F.col("id").alias("schedule_id"), "train_id")
        j = (rows.join(self.users.select(F.col("id").alias("user_id"), "email"), "email")
             .join(sched, "train_id"))
        first = j.groupBy("booking_ref").agg(F.min("schedule_id").alias("schedule_id"))
        self.bookings = (j.join(first, ["booking_ref", "schedule_id"])
                         .select("booking_ref", "user_id", "schedule_id", "seat_number",
                                 "amount_paid", "payment_method", "payment_status",
                                 "booking_status", "created_at"))


def seed(spark: SparkSession, as_of: dt.date) -> Seed:
    return Seed(spark, as_of)
