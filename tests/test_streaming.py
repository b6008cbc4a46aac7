"""Streaming jobs: multi-batch results equal the batch answer; reruns are no-ops."""

import pytest
from pyspark.sql import functions as F

from trackyard.operators import seats as S
from trackyard.session import scratch_path
from trackyard.sources import schema as SC
from trackyard.streaming import jobs as J
from trackyard.streaming import seat_state as SS
from trackyard.streaming.batches import read_batches

from test_properties import _world


def _layouts(spark, sf_dir, names):
    """The small tables again, ``names`` cut into four files in shuffled order."""
    out = scratch_path(spark, "layout")
    import os
    for f in os.listdir(sf_dir):
        t = f.removesuffix(".parquet")
        df = spark.read.parquet(f"{sf_dir}/{f}")
        df = df.orderBy(F.xxhash64(*df.columns)).repartition(4) if t in names else df.coalesce(1)
        if t in (*names, "orders", "supplier", "customer", "nation", "region"):
            df.write.parquet(f"{out}/{f}")
    return out


def test_streams_do_not_depend_on_the_files(spark):
    """Every stream gives the same rows for one file and for four shuffled ones."""
    from trackyard.plans.registry import load_all
    other = _layouts(spark, "/root/testdata/sf0.001", ["lineitem", "events"])
    for name in ("stream_revenue_daily", "stream_outbox", "stream_admission", "stream_bookings_cancels",
                 "stream_occupancy", "stream_rate_limit"):
        q = load_all()[name]
        one = sorted(map(str, q.build(spark, "/root/testdata/sf0.001").collect()))
        many = sorted(map(str, q.build(spark, other).collect()))
        assert one == many and one, name


def test_rerun_from_checkpoint_adds_nothing(spark):
    out = scratch_path(spark, "rev-rerun")
    got = []
    for _ in range(2):
        t = J.StreamingRail(spark, "/root/testdata/sf0.001", ["lineitem"])
        got.append(sorted(map(tuple, J.run_totals(spark, t.bookings, out, ["report_date"], J.revenue_sums).collect())))
    assert spark.read.parquet(out).select("batch_id").distinct().count() == 1
    assert got[0] == got[1]


def test_folded_totals_equal_plain_ones(spark):
    rows = [(f"s{i % 3}", i, i % 7) for i in range(70)]
    stream = _file_stream(spark, rows, "k string, n int", "fold")
    totals = J.run_totals(spark, stream, scratch_path(spark, "fold-out"), ["k"],
                          lambda df: df.groupBy("k").agg(F.sum("n").alias("n")), compact_every=3)
    assert {r.k: r.n for r in totals.collect()} == {f"s{j}": sum(i for i in range(70) if i % 3 == j) for j in range(3)}


def _replay_in_order(scheds, hist, requests):
    """One request after the other; a cancel frees its seat at once."""
    sched = {s[0]: dict(status=s[9], avail=s[7]) for s in scheds}
    refs = {h[0]: [h[7], h[2], h[3].rstrip().upper()] for h in hist}
    out = {}
    for kind, rid, ts, sid, seat, ref in sorted(requests, key=lambda r: (r[2], r[1])):
        held = {(x[1], x[2]) for x in refs.values() if x[0] in ("confirmed", "pending")}
        if kind == "book":
            s = sched.get(sid)
            if s is None:
                out[rid] = "not_found"
            elif s["status"] == "cancelled":
                out[rid] = "schedule_cancelled"
            elif s["avail"] <= 0:
                out[rid] = "no_seats"
            elif (sid, seat.rstrip().upper()) in held:
                out[rid] = "seat_taken"
            else:
                s["avail"] -= 1
                refs[rid] = ["confirmed", sid, seat.rstrip().upper()]
                out[rid] = "accepted"
        elif ref not in refs:
            out[rid] = "not_found"
        elif refs[ref][0] in ("cancelled", "completed"):
            out[rid] = "already_cancelled" if refs[ref][0] == "cancelled" else "refused_completed"
        else:
            refs[ref][0] = "cancelled"
            if refs[ref][1] in sched:
                sched[refs[ref][1]]["avail"] += 1
            out[rid] = "cancelled"
    return out


def _booking_events(spark, seed, n_req=240, n_cancel=120):
    """(static tables, events (kind, id, ts, schedule, seat, ref), outcomes of a replay)."""
    import datetime as dt
    import random
    sdf, rdf, hdf, _qdf, scheds, _routes, hist, reqs = _world(spark, seed, n_req=n_req)
    rnd = random.Random(4)
    reqs = sorted(reqs, key=lambda r: (r[1], r[0]))
    trip = dict([(r[0], r[3]) for r in reqs] + [(h[0], h[2]) for h in hist])
    known = {s[0] for s in scheds}
    pool = [p for p in trip if trip[p] in known] + ["NOPE"]
    events = [("book", r[0], r[1], r[3], r[4], None) for r in reqs]
    made = {r[0] for r in reqs}
    for k in range(n_cancel):
        ref = rnd.choice(pool)
        # a cancel of a booking made on the stream names its schedule, one of a stored booking need not
        events.append(("cancel", f"X{k}", rnd.choice(reqs)[1] + dt.timedelta(milliseconds=500),
                       trip[ref] if ref in made else None, None, ref))
    return (sdf, hdf, rdf), events, _replay_in_order(scheds, hist, events)


def _requests(spark, events, name, part):
    return _file_stream(spark, [(*e, part(k, e)) for k, e in enumerate(events)], SS.REQUEST, name)


def _decided(df):
    return {r.request_id: r.outcome for r in df.collect()}


def test_admission_is_free_of_file_layout(spark):
    sdf, rdf, hdf, qdf, *_ = _world(spark, 11, n_req=300)
    want = sorted((r.request_id, r.outcome, r.amount_paid)
                  for r in S.admission_result(S.admit_bookings(qdf, sdf, hdf, rdf)).collect())
    for name, files in (("one", qdf.coalesce(1)), ("many", qdf.repartition(5))):
        src = scratch_path(spark, f"req-{name}")
        files.write.parquet(src)
        stream = (spark.readStream.schema(SC.REQUESTS).option("maxFilesPerTrigger", 1).parquet(src)
                  .withColumn("kind", F.lit("book")))
        # files in any order: requests are waited for as long as all of them span
        got = SS.run(spark, stream, sdf, hdf, rdf, scratch_path(spark, "adm-out"), cancels=False, delay="1 hour")
        assert sorted((r.request_id, r.outcome, r.amount_paid) for r in got.collect()) == want


def test_bookings_and_cancels_in_request_order(spark):
    (sdf, hdf, rdf), events, want = _booking_events(spark, 21)
    assert {"cancelled", "not_found", "already_cancelled", "accepted", "seat_taken"} <= set(want.values())
    # in order of time over six files: the watermark releases requests while others still come
    ordered = sorted(events, key=lambda e: (e[2], e[1]))
    out = scratch_path(spark, "bc-out")
    stream = _requests(spark, ordered, "bc-src", lambda k, e: k * 6 // len(ordered))
    assert _decided(SS.run(spark, stream, sdf, hdf, rdf, out)) == want
    outcomes = spark.read.parquet(f"{out}/outcomes")
    assert outcomes.select("batch_id").distinct().count() > 3
    # out of order within the delay
    stream = _requests(spark, events, "bc-mixed", lambda k, e: k % 3)
    assert _decided(SS.run(spark, stream, sdf, hdf, rdf, scratch_path(spark, "bc-out2"), delay="1 hour")) == want


def test_restart_of_the_booking_stream(spark):
    """Requests that wait survive a restart in the state; a restart without new requests adds nothing."""
    (sdf, hdf, rdf), events, want = _booking_events(spark, 22, n_req=120, n_cancel=50)
    ordered = sorted(events, key=lambda e: (e[2], e[1]))
    out, src = scratch_path(spark, "bc-restart"), scratch_path(spark, "bc-restart-src")
    half = len(ordered) // 2

    def run(upto):
        stream = spark.readStream.schema(SS.REQUEST).option("maxFilesPerTrigger", 1).parquet(src)
        return _decided(SS.run(spark, stream, sdf, hdf, rdf, out, upto=upto))

    spark.createDataFrame(ordered[:half], SS.REQUEST).coalesce(1).write.mode("append").parquet(src)
    first = run(None)
    assert set(first.items()) < set(want.items())          # the last ones wait
    spark.createDataFrame(ordered[half:], SS.REQUEST).coalesce(1).write.mode("append").parquet(src)
    assert run(SS.END) == want
    rows = spark.read.parquet(f"{out}/outcomes").count()
    assert run(SS.END) == want and spark.read.parquet(f"{out}/outcomes").count() == rows


def test_late_requests_are_decided_and_none_is_lost(spark):
    """A request of an earlier time that lands after its time was released: decided on arrival."""
    import datetime as dt
    (sdf, hdf, rdf), events, _ = _booking_events(spark, 23, n_req=60, n_cancel=0)
    ordered = sorted(events, key=lambda e: (e[2], e[1]))
    late = ordered[5]
    rest = [e for e in ordered if e is not late]
    stream = _requests(spark, [*rest[:30], *rest[30:], late], "late-src", lambda k, e: 2 if e is late else k // 30)
    got = _decided(SS.run(spark, stream, sdf, hdf, rdf, scratch_path(spark, "late-out")))
    assert set(got) == {e[1] for e in events}
    # as if it had been made after all of the first 30
    moved = (*late[:2], rest[-1][2] + dt.timedelta(hours=1), *late[3:])
    _, _, _, _, scheds, _, hist, _ = _world(spark, 23, n_req=60)
    want = _replay_in_order(scheds, hist, [*rest, moved])
    assert {k for k in got if got[k] != want[k]} <= {e[1] for e in rest[30:]} | {late[1]}
    assert {k: got[k] for k in (e[1] for e in rest[:30])} == {k: want[k] for k in (e[1] for e in rest[:30])}


def test_state_of_departed_trips_ends(spark):
    """State goes after the trip; a request for it then is refused without a state of its own."""
    import datetime as dt
    (sdf, hdf, rdf), events, _ = _booking_events(spark, 24, n_req=40, n_cancel=0)
    sdf = sdf.withColumns({"travel_date": F.lit(dt.date(2026, 1, 2)), "departure_time": F.lit("08:00:00")})
    trip = sdf.where("status <> 'cancelled'").first().id
    after = ("book", "after", dt.datetime(2026, 3, 1), trip, "9Z", None)
    out = scratch_path(spark, "ends-out")
    stream = _requests(spark, [*events, after], "ends-src", lambda k, e: 1 if e is after else 0)
    got = _decided(SS.run(spark, stream, sdf, hdf, rdf, out, retention_days=1))
    assert got["after"] == "departed" and len(got) == len(events) + 1
    state = spark.read.format("statestore").load(f"{out}/outcomes/_checkpoint")
    assert state.count() == 0
    # without retention the state stays
    SS.run(spark, _requests(spark, [*events, after], "stays-src", lambda k, e: 0), sdf, hdf, rdf,
           keeps := scratch_path(spark, "stays-out"))
    assert spark.read.format("statestore").load(f"{keeps}/outcomes/_checkpoint").count() > 0


def test_a_read_error_is_no_empty_history(spark):
    from py4j.protocol import Py4JError
    from pyspark.errors import PySparkException
    out = scratch_path(spark, "broken")
    assert read_batches(spark, out) is None
    spark.range(3).selectExpr("CAST(id AS STRING) AS v").write.text(f"{out}/batch_id=0")
    with pytest.raises((PySparkException, Py4JError)):
        read_batches(spark, out)


def _file_stream(spark, rows, schema, name):
    src = scratch_path(spark, name)
    df = spark.createDataFrame(rows, schema + ", part int")
    for p in sorted({r[-1] for r in rows}):
        df.where(F.col("part") == p).drop("part").coalesce(1).write.parquet(f"{src}/p{p}")
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
            .option("recursiveFileLookup", "true").parquet(src))


def test_revenue_stream_counts_late_rows(spark):
    import datetime as dt
    from decimal import Decimal
    schema = ("booking_ref string, payment_status string, amount_paid decimal(12,2), "
              "created_at timestamp_ntz")
    d = lambda day, h=12: dt.datetime(2026, 1, day, h)
    rows = [("a", "paid", Decimal("10.00"), d(10), 0), ("b", "paid", Decimal("5.00"), d(10, 13), 0),
            ("c", "paid", Decimal("7.00"), d(12), 1), ("late", "paid", Decimal("99.00"), d(1), 1),
            ("e", "paid", Decimal("2.00"), d(11, 20), 1), ("d", "refunded", Decimal("1.00"), d(12), 1)]
    out = scratch_path(spark, "rev-late-out")
    totals = J.run_totals(spark, _file_stream(spark, rows, schema, "rev-late"), out, ["report_date"], J.revenue_sums)
    assert spark.read.parquet(out).select("batch_id").distinct().count() == 2
    assert {str(r.report_date): (r.bookings, float(r.revenue)) for r in totals.collect()} == {
        "2026-01-01": (1, 99.0), "2026-01-10": (2, 15.0), "2026-01-11": (1, 2.0), "2026-01-12": (1, 7.0)}


@pytest.mark.parametrize("repeats", ["7 days", "0 seconds"])
def test_outbox_deduplicates_across_batches(spark, seed, repeats):
    """With a horizon in the state store; without one, by the messages already written."""
    b = seed.bookings.where(F.col("booking_status") == "confirmed").first()
    row = tuple(b[c] for c in SC.BOOKINGS.fieldNames())
    other = ("BK-OTHER", *row[1:])
    rows = [(*row, 0), (*row, 1), (*row, 1), (*other, 2), (*row, 3), (*other, 3)]
    stream = _file_stream(spark, rows, SC.BOOKINGS.simpleString()[7:-1].replace(":", " "), "outbox-dup")
    out = scratch_path(spark, "outbox-dup-out")
    got = J.run_outbox_stream(spark, stream, seed.schedules, seed.routes, seed.stations, seed.users, out, repeats)
    assert got.select("booking_ref", "type").distinct().count() == got.count() == 4  # sms + email
    assert spark.read.parquet(out).select("batch_id").distinct().count() == 2


def test_outbox_files_are_bounded(spark):
    """Bookings of many days make no more files than there are shuffle partitions."""
    out = scratch_path(spark, "outbox-files")
    t = J.StreamingRail(spark, "/root/testdata/sf0.001", ["lineitem"])
    static = J.RailTables(spark, "/root/testdata/sf0.001", materialize=True)
    got = J.run_outbox_stream(spark, t.bookings, static.schedules, static.routes, static.stations, static.users, out)
    files = [f.split("/")[-2] for f in got.inputFiles()]
    assert files and all(files.count(batch) <= int(spark.conf.get("spark.sql.shuffle.partitions")) for batch in files)
    assert spark.read.parquet(out).selectExpr("count(DISTINCT to_date(created_at))").first()[0] > 100


def test_requests_without_a_reference_are_spread(spark):
    from trackyard.streaming.seat_state import find_refs
    rows = [("book", f"B{k}", None) for k in range(400)] + [
        ("cancel", "C1", "B1"), ("cancel", "B2", None), ("cancel", "C3", "B9999"), ("book", "B4", "B1")]
    asked = spark.createDataFrame(rows, "kind string, request_id string, booking_ref string")
    refs = spark.createDataFrame([(f"B{k}", k) for k in range(400)], "ref string, ref_trip int")
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = find_refs(asked, refs).withColumn("part", F.spark_partition_id()).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(got) == len(rows) and [(r.request_id, r.ref_trip) for r in got if r.ref_trip is not None] == [("C1", 1)]
    parts = [r.part for r in got]
    assert max(parts.count(p) for p in set(parts)) < len(rows) // 2
