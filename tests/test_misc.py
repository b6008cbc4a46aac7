"""Foreign-key effects, sinks and visibility."""

from pyspark.sql import functions as F

from trackyard.operators import filters as FL
from trackyard.operators import quality as Q
from trackyard.session import scratch_path
from trackyard.sources import sinks


def test_fk_effects(spark):
    parent = spark.createDataFrame([(1,), (2,)], "id long")
    child = spark.createDataFrame([(10, 1), (11, 2), (12, 3), (13, None)], "cid long, pid long")
    gone = parent.where(F.col("id") == 1)
    cas = sorted(r.cid for r in Q.fk_effects(gone, child, "pid", "cascade").collect())
    sn = {r.cid: r.pid for r in Q.fk_effects(gone, child, "pid", "set_null").collect()}
    rs = [r.cid for r in Q.fk_effects(gone, child, "pid", "restrict").collect()]
    assert cas == [11, 12, 13]
    assert sn == {10: None, 11: 2, 12: 3, 13: None}
    assert rs == [10]


def test_rules_of_requests(spark):
    users = spark.createDataFrame(
        [(1, "a@b.cd", "secret", "A", "B", "staff", "+966512345678", "1234567890"),
         (2, "a@b", "short", "", "B", "guest", "12", "123"), (3, None, None, None, "x" * 101, None, None, None)],
        "id long, email string, password string, first_name string, last_name string, role string, phone string, national_id string")
    bad = {i: sorted(r.field for r in Q.validate(users, "id", Q.user_rules()).collect() if r.id == i) for i in (1, 2, 3)}
    assert bad == {1: [], 2: ["email", "firstName", "nationalId", "password", "phone", "role"],
                   3: ["email", "firstName", "lastName", "password", "role"]}
    on = spark.createDataFrame([(1, "1234567890", "staff"), (2, "12345678a0", "boss")], "id long, national_id string, role string")
    assert sorted((r.id, r.field) for r in Q.validate(on, "id", Q.sign_on_rules()).collect()) == [(2, "nationalId"), (2, "role")]
    patch = spark.createDataFrame([(1, None, "lost", "x"), (2, -1.0, None, None)],
                                  "id long, price_economy double, status string, role string") \
        .withColumns({"price_first_class": F.lit(None).cast("double"), "price_student": F.lit(0.0),
                      "email": F.lit(None).cast("string")})
    assert [(r.id, r.field) for r in Q.validate(patch, "id", Q.route_patch_rules()).collect()] == [(2, "priceEconomy")]
    assert [(r.id, r.field) for r in Q.validate(patch, "id", Q.schedule_patch_rules()).collect()] == [(1, "status")]
    assert sorted((r.id, r.field) for r in Q.validate(patch, "id", Q.user_patch_rules()).collect()) == [(1, "role"), (1, "status")]


def test_double_sold_compares_labels_as_admission_does(spark):
    b = spark.createDataFrame([(1, "1a ", "confirmed"), (1, "1A", "pending"), (1, " 1A", "confirmed"), (2, "1A", "cancelled")],
                              "schedule_id long, seat_number string, booking_status string")
    assert [(r.schedule_id, r.seat_number, r.bookings) for r in Q.double_sold(b).collect()] == [(1, "1A", 2)]
    assert Q.double_sold_rows(b).count() == 2


def test_refresh_takes_whole_days(spark):
    import datetime as dt
    from trackyard.operators import materialize as MT
    d = lambda n: dt.datetime(2026, 1, n)
    rows = [("a", d(1), "confirmed", "paid", 5.0, None), ("b", d(1), "cancelled", "refunded", 7.0, d(3)),
            ("c", d(3), "confirmed", "paid", 2.0, None)]
    b = spark.createDataFrame(rows, "booking_ref string, created_at timestamp_ntz, booking_status string, "
                                    "payment_status string, amount_paid double, cancelled_at timestamp_ntz")
    stored = MT.revenue_daily(b.where("created_at < '2026-01-03'").withColumn("cancelled_at", F.lit(None).cast("timestamp_ntz")))
    days = spark.createDataFrame([(dt.date(2026, 1, 3),)], "report_date date")
    got = {str(r.report_date): (float(r.total_revenue), r.total_bookings, r.cancelled, float(r.refunded))
           for r in MT.refresh_revenue_daily(stored, b, days).collect() if r.report_date}
    assert got == {"2026-01-01": (5.0, 2, 0, 0.0), "2026-01-03": (2.0, 1, 1, 7.0)}


def test_export_csv_and_snapshots(spark):
    df = spark.createDataFrame([("BK-1", 1.5), ("BK-2", None)], "ref string, amount double")
    path = sinks.export_csv(df, scratch_path(spark, "export"))
    back = spark.read.option("header", True).csv(path)
    assert back.columns == ["ref", "amount"]
    assert sorted(r.ref for r in back.collect()) == ["BK-1", "BK-2"]
    base = scratch_path(spark, "snap")
    p1 = sinks.write_snapshot(df, base)
    p2 = sinks.write_snapshot(spark.read.parquet(p1).where(F.col("ref") == "BK-1"), base)
    assert p1 != p2 and spark.read.parquet(p1).count() == 2 and spark.read.parquet(p2).count() == 1


def test_visible_to(spark):
    b = spark.createDataFrame([("a", 1), ("b", 2), ("c", 1)], "ref string, user_id long")
    assert FL.visible_to(b, 1, "passenger").count() == 2
    assert FL.visible_to(b, 1, "staff").count() == 3


def test_paginate_clamps_low_pages(spark):
    df = spark.range(25).withColumnRenamed("id", "k")
    assert [r.k for r in FL.paginate(df, ["k"], page=0, limit=10).collect()] == list(range(10))
    assert [r.k for r in FL.paginate(df, ["k"], page=3, limit=10).collect()] == list(range(20, 25))


def test_rail_store_is_published_once(spark):
    """The stored tables have the views' rows; a second reader finds the copy; the layout follows
    the bytes of a folder of part files; new source files make a new store."""
    import uuid
    from trackyard.sources.tables import RailTables
    src = scratch_path(spark, "parts")
    for t in ("nation", "region", "supplier", "orders", "customer"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(f"{src}/{t}.parquet")
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    lines.repartition(5).write.parquet(f"{src}/lineitem.parquet")
    a = RailTables(spark, src, materialize=True)
    a.store_salt = uuid.uuid4().hex
    b = RailTables(spark, "/root/testdata/sf0.001", materialize=False)
    got = a.bookings
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, b.bookings.collect()))
    assert sum(n for _, n, _ in a._listing("lineitem")) > 50_000
    c = RailTables(spark, src, materialize=True)
    c.store_salt = a.store_salt
    assert c.bookings.inputFiles() == got.inputFiles()
    assert a.storage.write_marker(f"{a._store_dir()}/bookings.done", "other") != "other"
    small = RailTables(spark, src, materialize=True)
    small.store_salt, small.FILE_BYTES = uuid.uuid4().hex, 2000
    assert len(small.bookings.inputFiles()) > len(got.inputFiles())
    before = c._store_dir()
    lines.limit(1).write.mode("append").parquet(f"{src}/lineitem.parquet")
    assert c._store_dir() != before


def test_rate_limit_flags(spark):
    import datetime as dt
    from trackyard.streaming.jobs import rate_windows
    t0 = dt.datetime(2026, 1, 1, 10, 0)
    rows = [(k, t0 + dt.timedelta(seconds=k), 1, "signup" if k < 11 else "view", 1.0, "{}")
            for k in range(101)]
    rows += [(1000, t0, 2, "view", 1.0, "{}"), (1001, t0 + dt.timedelta(minutes=20), 1, "view", 1.0, "{}")]
    ev = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, "
                                     "event_type string, value double, props string")
    got = {(str(r.window_start), r.user_id): (r.requests, r.auth_requests, r.over_limit,
                                               r.auth_over_limit)
           for r in rate_windows(ev).collect()}
    assert got == {("2026-01-01 10:00:00", 1): (101, 11, True, True),
                   ("2026-01-01 10:00:00", 2): (1, 0, False, False),
                   ("2026-01-01 10:15:00", 1): (1, 0, False, False)}


def test_notification_log(spark):
    import datetime as dt
    from trackyard.streaming.jobs import notification_counts, notification_log
    t0 = dt.datetime(2026, 1, 1, 9)
    outbox = spark.createDataFrame(
        [("B1", "sms", "+9665", None, "body1"), ("B1", "email", "a@x", "Subj B1", "conf B1"),
         ("B2", "email", "b@x", "Subj B2", "conf B2")],
        "booking_ref string, type string, channel string, subject string, message string")
    receipts = spark.createDataFrame(
        [("B1", "sms", t0, True, None), ("B1", "email", t0, False, "smtp down"),
         ("B1", "email", t0 - dt.timedelta(hours=1), True, None)],
        "booking_ref string, type string, ts timestamp_ntz, ok boolean, error string")
    log = {(r.booking_ref, r.type): r for r in notification_log(outbox, receipts).collect()}
    assert log[("B1", "sms")].status == "sent" and log[("B1", "sms")].sent_at == t0
    f = log[("B1", "email")]
    assert (f.status, f.sent_at, f.error_msg, f.message, f.subject) == \
        ("failed", None, "smtp down", "smtp down", "Booking confirmation")
    assert log[("B2", "email")].status == "pending"
    counts = {(r.type, r.status): r.notifications
              for r in notification_counts(notification_log(outbox, receipts)).collect()}
    assert counts == {("sms", "sent"): 1, ("email", "failed"): 1, ("email", "pending"): 1}


def test_validation_errors_array_and_long_form(spark):
    df = spark.createDataFrame([("r1", 0, "1A", "visa"), ("r2", 5, "", "bitcoin"), ("r3", 5, "2B", "cash")],
                               "request_id string, schedule_id long, seat_number string, payment_method string")
    arr = {r.request_id: [(e.field, e.message) for e in r.errors]
           for r in Q.validation_errors(df, "request_id", Q.booking_request_rules()).collect()}
    assert arr == {"r1": [("scheduleId", "Invalid value")],
                   "r2": [("seatNumber", "Invalid value"), ("paymentMethod", "Invalid value")]}
    long = sorted((r.request_id, r.field) for r in
                  Q.validate(df, "request_id", Q.booking_request_rules()).collect())
    assert long == [("r1", "scheduleId"), ("r2", "paymentMethod"), ("r2", "seatNumber")]


def test_queries_read_the_driver_tables(spark):
    """No query first shuffles and writes whole rail tables."""
    from conftest import SF_SMALL
    from trackyard.plans.registry import load_all
    for name in ("booking_summary", "visible_bookings_info", "overview"):
        files = load_all()[name].build(spark, SF_SMALL).inputFiles()
        assert files and all(SF_SMALL in f for f in files), files


def test_orphans_without_a_join(spark):
    parent = spark.createDataFrame([(1,), (1,), (2,), (None,)], "id long")
    child = spark.createDataFrame([(1,), (3,), (3,), (None,), (-4,)], "pid long")
    found = Q.orphan_rows(child, "c", "pid", parent)
    assert sorted((r.value, r.rows) for r in found.collect()) == [("-4", 1), ("3", 2)]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    other = Q.orphan_rows(child.select(F.col("pid").cast("int")), "c", "pid", parent)     # keys of another type
    assert sorted((r.value, r.rows) for r in other.collect()) == [("-4", 1), ("3", 2)]


def test_unique_keys_are_grouped_one_by_one(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (2, None), (3, None), (None, "3")], "id long, code string")
    found = Q.unique_violations(df, "t", ["id", "code"])
    assert sorted((r.column_name, r.value, r.rows) for r in found.collect()) == [("code", "a", 2), ("id", "2", 2)]
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
