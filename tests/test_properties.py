"""Set-based operators against brute-force sequential replays."""

import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from trackyard.functions import expr as X
from trackyard.operators import mutate as MU
from trackyard.operators import seats as S
from trackyard.operators import skew
from trackyard.sources import schema as SC

T0 = dt.datetime(2026, 1, 1)


def _world(spark, seed, n_sched=12, n_req=400):
    rnd = random.Random(seed)
    scheds = []
    for i in range(1, n_sched + 1):
        total = rnd.choice([4, 8, 12])
        scheds.append((i, f"T{i}", 1 + i % 3, "08:00:00", "09:00:00", dt.date(2026, 1, 2),
                       total, rnd.choice([-1, 0, 1, 2, 3, total]),
                       rnd.choice(SC.TRAIN_CLASSES),
                       "cancelled" if i % 7 == 0 else "active", 0))
    routes = [(r, f"RT-{r}", 1, 2, Decimal("10.00"), 60, Decimal("200.00"),
               Decimal("100.00"), Decimal(rnd.choice(["0.00", "40.00"])), 1) for r in (1, 2, 3)]
    seats = ["1A", "1a ", "1B", "2C", "3D", "4A", "2c"]
    hist = []
    for k in range(30):
        hist.append((f"H{k}", 1, rnd.randint(1, n_sched), rnd.choice(seats), Decimal("1.00"),
                     "mada", "paid", rnd.choice(SC.BOOKING_STATUSES), T0))
    reqs = []
    for k in range(n_req):
        reqs.append((f"R{k:04d}", T0 + dt.timedelta(seconds=rnd.randint(0, 50)), 7,
                     rnd.randint(1, n_sched + 2), rnd.choice(seats), "visa"))
    return (spark.createDataFrame(scheds, SC.SCHEDULES), spark.createDataFrame(routes, SC.ROUTES),
            spark.createDataFrame(hist, SC.BOOKINGS), spark.createDataFrame(reqs, SC.REQUESTS),
            scheds, routes, hist, reqs)


def _replay(scheds, routes, hist, reqs):
    sched = {s[0]: dict(status=s[9], avail=s[7], cls=s[8], route=s[2]) for s in scheds}
    price = {r[0]: (r[6], r[7], r[8]) for r in routes}
    held = {(h[2], h[3].rstrip().upper()) for h in hist if h[7] in ("confirmed", "pending")}
    out = {}
    for rid, ts, _u, sid, seat, _pm in sorted(reqs, key=lambda r: (r[1], r[0])):
        s = sched.get(sid)
        key = (sid, seat.rstrip().upper())
        if s is None:
            out[rid] = ("not_found", None)
        elif s["status"] == "cancelled":
            out[rid] = ("schedule_cancelled", None)
        elif s["avail"] <= 0:
            out[rid] = ("no_seats", None)
        elif key in held:
            out[rid] = ("seat_taken", None)
        else:
            held.add(key)
            s["avail"] -= 1
            p1, p2, p3 = price[s["route"]]
            fare = {"First Class": p1, "Economy": p2, "Student": p3}[s["cls"]]
            out[rid] = ("accepted", float(fare or p2))
    return out


def test_admission_equals_sequential_replay(spark):
    for seed in (1, 2, 3):
        sdf, rdf, hdf, qdf, scheds, routes, hist, reqs = _world(spark, seed)
        adm = S.admit_bookings(qdf, sdf, hdf, rdf, salt_buckets=3)
        got = {r.request_id: (r.outcome, None if r.amount_paid is None else float(r.amount_paid))
               for r in S.admission_result(adm).collect()}
        assert got == _replay(scheds, routes, hist, reqs)
        outs = {v[0] for v in got.values()}
        assert {"not_found", "schedule_cancelled", "no_seats", "seat_taken", "accepted"} <= outs


def test_admission_deltas_conserve_seats(spark):
    sdf, rdf, hdf, qdf, *_ = _world(spark, 5)
    adm = S.admit_bookings(qdf, sdf, hdf, rdf)
    after = MU.apply_deltas(sdf, adm.deltas)
    before = sdf.agg(F.sum("available_seats")).first()[0]
    n_acc = adm.accepted.count()
    assert after.agg(F.sum("available_seats")).first()[0] == before - n_acc
    per = adm.accepted.groupBy("schedule_id", X.seat_key("seat_number")).count()
    assert per.where(F.col("count") > 1).count() == 0      # one accepted per seat


def test_top_n_per_group_matches_brute_force(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice([1, 1, 1, 1, 2, 3]), rnd.randint(0, 20), f"k{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "g int, v int, k string")
    got = skew.top_n_per_group(df, ["g"], [F.desc("v"), F.asc("k")], 4, salt_buckets=5)
    got = sorted((r.g, r.rank, r.k) for r in got.collect())
    exp = []
    for g in sorted({r[0] for r in rows}):
        grp = sorted([r for r in rows if r[0] == g], key=lambda r: (-r[1], r[2]))[:4]
        exp += [(g, i + 1, r[2]) for i, r in enumerate(grp)]
    assert got == sorted(exp)


def test_pick_per_key(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (2, 1, "c"), (1, 7, "a")],
                               "k int, t int, v string")
    last = {r.k: r.v for r in skew.pick_per_key(df, ["k"], ["t", "v"]).collect()}
    first = {r.k: r.v for r in skew.pick_per_key(df, ["k"], ["t", "v"], last=False).collect()}
    assert last == {1: "b", 2: "c"} and first == {1: "a", 2: "c"}


def test_patch_equals_sequential(spark):
    target = spark.createDataFrame([(1, "active", 10, 0), (2, "delayed", 12, 5)],
                                   "id long, status string, total_seats int, delay_minutes int")
    patches = [(1, "cancelled", 0, None, False, 1), (1, "", 20, 0, True, 2),
               (2, "", None, None, True, 1), (3, "active", 5, 1, True, 1)]
    p = spark.createDataFrame(patches, "id long, status string, total_seats int, "
                                       "delay_minutes int, has_delay_minutes boolean, ts int")
    m = MU.patch(target, p, ["id"], ["status", "total_seats"], ["delay_minutes"], ["ts"])
    state = {1: ["active", 10, 0], 2: ["delayed", 12, 5]}
    for pid, st, tot, dl, has, _ in sorted(patches, key=lambda r: r[5]):
        if pid not in state:
            continue
        s = state[pid]
        s[0] = st or s[0]
        s[1] = tot or s[1]
        s[2] = dl if has else s[2]
    got = {r.id: [r.status, r.total_seats, r.delay_minutes] for r in m.table.collect()}
    assert got == state
    assert {r.id: r.outcome for r in m.outcomes.collect()} == \
        {1: "updated", 2: "updated", 3: "not_found"}


def test_upsert_key_unique_last_wins(spark):
    target = spark.createDataFrame([(1, 0, 0), (2, 1, 1)], "user_id long, a int, b int")
    rows = spark.createDataFrame([(1, 1, 1, 1), (1, 0, 1, 2), (3, 1, 0, 1)],
                                 "user_id long, a int, b int, ts int")
    out = {r.user_id: (r.a, r.b) for r in MU.upsert(target, rows, ["user_id"], ["a", "b"],
                                                    ["ts"]).collect()}
    assert out == {1: (0, 1), 2: (1, 1), 3: (1, 0)}


def test_insert_ignore(spark):
    target = spark.createDataFrame([("a@x", 1)], "email string, n int")
    rows = spark.createDataFrame([("a@x", 5, 1), ("b@x", 6, 2), ("b@x", 7, 1)],
                                 "email string, n int, ts int")
    m = MU.insert_ignore(target, rows, ["email"], ["ts", "n"])
    assert sorted(tuple(r) for r in m.table.collect()) == [("a@x", 1), ("b@x", 7)]
    assert sorted((r.n, r.outcome) for r in m.outcomes.collect()) == \
        [(5, "ignored"), (6, "ignored"), (7, "inserted")]


def test_insert_ignore_null_keys_and_several_unique_keys(spark):
    target = spark.createDataFrame([("a@x", "n1"), (None, None)], "email string, nid string")
    rows = [("b@x", None, 1), (None, None, 2), (None, None, 3), ("c@x", "n1", 4), ("d@x", "n2", 5),
            ("d@x", "n3", 6), ("e@x", "n3", 7), ("f@x", "n3", 8), ("a@x", "n9", 9), ("g@x", "n9", 10)]
    emails, nids, want = {"a@x"}, {"n1"}, {}
    for e, n, k in rows:                      # one by one, as the database does
        ok = e not in emails and n not in nids
        want[k] = "inserted" if ok else "ignored"
        if ok:
            emails |= {e} - {None}
            nids |= {n} - {None}
    m = MU.insert_ignore(target, spark.createDataFrame(rows, "email string, nid string, ts int"),
                         ["email", "nid"], ["ts"])
    assert {r.ts: r.outcome for r in m.outcomes.collect()} == want
    assert m.table.count() == 2 + sum(v == "inserted" for v in want.values())
    one = MU.insert_ignore(target, spark.createDataFrame(rows, "email string, nid string, ts int"),
                           ["email"], ["ts"])
    got = {r.ts: r.outcome for r in one.outcomes.collect()}
    assert got[2] == got[3] == "inserted" and got[9] == "ignored" and got[6] == "ignored"


def test_cancel_on_the_declared_schema(spark):
    b = spark.createDataFrame(
        [("B1", 1, 10, "confirmed", "paid", None, None), ("B2", 2, 10, "confirmed", "paid", None, None),
         ("B3", 3, 11, "cancelled", "refunded", T0, "old")],
        "booking_ref string, user_id long, schedule_id long, booking_status string, "
        "payment_status string, cancelled_at timestamp_ntz, cancel_reason string")
    day = dt.timedelta(1)
    r = spark.createDataFrame(
        [("r1", "B1", T0, "mine", 2, "passenger"), ("r2", "B1", T0 + day, "own", 1, "passenger"),
         ("r3", "B1", T0 + 2 * day, "late", 9, "staff"), ("r4", "B2", T0, "", 9, "admin"),
         ("r5", "B3", T0, "x", 1, "passenger"), ("r6", "B3", T0, "x", 3, "passenger"),
         ("r7", "B9", T0, "x", 3, "passenger")],
        "request_id string, booking_ref string, ts timestamp_ntz, reason string, actor_id long, actor_role string")
    c = MU.cancel_bookings(b, r)
    assert {x.request_id: x.outcome for x in c.outcomes.collect()} == {
        "r1": "access_denied", "r2": "cancelled", "r3": "already_cancelled", "r4": "cancelled",
        "r5": "access_denied", "r6": "already_cancelled", "r7": "not_found"}
    t = {x.booking_ref: (x.booking_status, x.payment_status, x.cancelled_at, x.cancel_reason)
         for x in c.table.collect()}
    assert c.table.columns == b.columns
    assert t == {"B1": ("cancelled", "refunded", T0 + day, "own"), "B2": ("cancelled", "refunded", T0, None),
                 "B3": ("cancelled", "refunded", T0, "old")}


def test_cancel_state_machine(spark):
    b = spark.createDataFrame(
        [("B1", 1, 10, "1A", Decimal("5.00"), "mada", "paid", "confirmed", T0),
         ("B2", 1, 10, "1B", Decimal("5.00"), "mada", "paid", "completed", T0),
         ("B3", 1, 11, "1C", Decimal("5.00"), "mada", "refunded", "cancelled", T0),
         ("B4", 1, 11, "1D", Decimal("5.00"), "mada", "pending", "pending", T0)], SC.BOOKINGS)
    r = spark.createDataFrame(
        [("r1", "B1", T0, ""), ("r2", "B1", T0 + dt.timedelta(1), "x"), ("r3", "B2", T0, None),
         ("r4", "B3", T0, None), ("r5", "B9", T0, None), ("r6", "B4", T0, "why")],
        "request_id string, booking_ref string, ts timestamp_ntz, reason string")
    c = MU.cancel_bookings(b, r)
    got = {x.request_id: x.outcome for x in c.outcomes.collect()}
    assert got == {"r1": "cancelled", "r2": "already_cancelled", "r3": "refused_completed",
                   "r4": "already_cancelled", "r5": "not_found", "r6": "cancelled"}
    t = {x.booking_ref: (x.booking_status, x.payment_status, x.cancel_reason)
         for x in c.table.collect()}
    assert t["B1"] == ("cancelled", "refunded", None) and t["B4"] == ("cancelled", "refunded", "why")
    assert {x.schedule_id: x.delta for x in c.deltas.collect()} == {10: 1, 11: 1}


def test_station_touch_equals_or_join(spark):
    st = spark.createDataFrame([(i,) for i in range(1, 6)], "id long")
    routes = spark.createDataFrame([(1, 1, 2), (2, 2, 2), (3, 3, 1), (4, 5, 4)],
                                   "id long, from_station_id long, to_station_id long")
    from trackyard.operators.views import station_touch
    a = station_touch(routes).groupBy("station_id").count()
    b = (st.join(routes, (routes.from_station_id == st.id) | (routes.to_station_id == st.id))
         .groupBy(st.id.alias("station_id")).count())
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_car_occupancy_matches_seat_simulation(spark):
    trips = [(1, 200, 168, "active"), (2, 150, 0, "cancelled"), (3, 10, 9, "active"),
             (4, 2, 1, "active")]
    df = spark.createDataFrame(trips, "schedule_id long, total_seats int, occupied int, status string")
    got = {(r.schedule_id, r.car_no): (r.seats, r.occupied_seats, r.car_pct, r.premium_free)
           for r in S.car_occupancy(df, cars=3).collect()}
    for sid, total, occ, st in trips:
        spc = total // 3
        for car in range(3):
            start = car * spc + 1
            end = min(start + spc - 1, total)
            sn = list(range(start, end + 1))
            o = [n for n in sn if st == "cancelled" or n <= occ]
            prem = [n for n in sn if car == 0 and n <= 8 and n not in o]
            pct = None if not sn else int(len(o) / len(sn) * 100 + 0.5)
            assert got[(sid, car + 1)] == (len(sn), len(o), pct, len(prem))


def test_scalar_expressions(spark):
    df = spark.createDataFrame([(1, "0551234567", 86.4, dt.datetime(2026, 1, 1, 5, 0)),
                                (6, "+15550001", 60.4, dt.datetime(2026, 1, 1, 16, 0))],
                               "i int, p string, pct double, ts timestamp_ntz")
    r = df.select(X.seat_label("i").alias("s"), X.phone_e164("p").alias("e"),
                  X.occupancy_band("pct").alias("b"), X.shift_of_day("ts").alias("sh"),
                  X.qr_ref("ts").alias("q")).collect()
    assert [x.s for x in r] == ["1A", "2B"]
    assert [x.e for x in r] == ["+966551234567", "+15550001"]
    assert [x.b for x in r] == ["red", "green"]
    assert [x.sh for x in r] == ["Morning Shift", "Evening Shift"]   # UTC+3
    millis = int(dt.datetime(2026, 1, 1, 5, 0, tzinfo=dt.timezone.utc).timestamp() * 1000)
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    b36 = ""
    while millis:
        millis, d = divmod(millis, 36)
        b36 = digits[d] + b36
    assert r[0].q == "RWSA-" + b36


def test_route_performance_equals_direct_fan_out(spark):
    """AGG6: the pre-aggregated form equals the source's join-then-AVG form."""
    from trackyard.operators import metrics as M
    from trackyard.sources.tables import rail
    t = rail(spark, "/root/testdata/sf0.001", materialize=False)
    fast = {r.route_code: tuple(r)[3:] for r in
            M.route_performance(t.routes, t.stations, t.schedules, t.bookings).collect()}
    r, s, b = t.routes.alias("r"), t.schedules.alias("s"), t.bookings.alias("b")
    travelled = b.where(F.col("b.booking_status").isin("confirmed", "completed"))
    j = (r.join(s, F.col("s.route_id") == F.col("r.id"), "left")
         .join(travelled, F.col("b.schedule_id") == F.col("s.id"), "left"))
    load = ((F.col("s.total_seats") - F.col("s.available_seats")) / F.col("s.total_seats") * 100)
    direct = j.groupBy("r.id", "r.route_code").agg(
        F.countDistinct("s.id").alias("trips"), F.count("b.booking_ref").alias("pax"),
        F.coalesce(F.sum("b.amount_paid"), F.lit(0)).cast("double").alias("rev"),
        F.round(F.avg(load), 1).alias("load"))
    slow = {x.route_code: (x.trips, x.pax, x.rev, x.load) for x in direct.collect()}
    assert fast == slow


def test_patch_is_idempotent(spark):
    target = spark.createDataFrame([(1, "active", 10, 0), (2, "delayed", 12, 5)],
                                   "id long, status string, total_seats int, delay_minutes int")
    p = spark.createDataFrame([(1, "cancelled", 0, 3, True, 1), (2, "", 20, None, False, 1)],
                              "id long, status string, total_seats int, delay_minutes int, "
                              "has_delay_minutes boolean, ts int")
    once = MU.patch(target, p, ["id"], ["status", "total_seats"], ["delay_minutes"], ["ts"]).table
    twice = MU.patch(once, p, ["id"], ["status", "total_seats"], ["delay_minutes"], ["ts"]).table
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
