"""Page index, touched partitions and summary deltas."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from trackyard.operators import materialize as MT
from trackyard.operators import mutate as MU
from trackyard.session import scratch_path
from trackyard.operators.filters import search
from trackyard.sources.layout import PageIndex, PartitionedTable, TextIndex


def _files(df):
    return len(df.inputFiles()) if df.head(1) else 0


def test_pages_equal_offset_and_read_as_little_anywhere(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.randrange(40), f"n{rnd.randrange(9)}") for i in range(5000)]
    df = spark.createDataFrame(rows, "id long, day int, name string").repartition(6)
    order = [("day", False), ("name", True), ("id", False)]
    index = PageIndex.build(df, scratch_path(spark, "pages"), order, rows_per_part=400)
    want = sorted(rows, key=lambda r: (-r[1], r[2], -r[0]))
    read = set()
    for page in (1, 2, 17, 100, 249, 250, 251, 0):
        got = index.page(page, 20)
        start = (max(1, page) - 1) * 20
        assert [tuple(r) for r in got.collect()] == want[start:start + 20], page
        read.add(_files(got))
    assert read <= {0, 1, 2}
    for at in (0, 7, 399, 400, 2500, 4985, 4999):
        i, day, name = want[at]
        got = index.after([day, name, i], 20)
        assert [tuple(r) for r in got.collect()] == want[at + 1:at + 21], at
        assert _files(got) <= 3
    assert [tuple(r) for r in index.after([99, "", 0], 3).collect()] == want[:3]


def test_empty_page_index(spark):
    df = spark.createDataFrame([], "id long")
    index = PageIndex.build(df, scratch_path(spark, "pages0"), [("id", True)])
    assert index.page(1).count() == 0


def _table(spark, n=600):
    day = dt.date(2026, 1, 1)
    rows = [(i, day + dt.timedelta(days=i % 30), "scheduled", 10) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, travel_date date, status string, total_seats int")
    path = scratch_path(spark, "parts")
    return df, path, PartitionedTable.build(df, path, "id", F.col("travel_date"))


def _stamps(spark, path):
    from trackyard.sources.tables import Storage
    s = Storage(spark)
    return {f: s.listing(f"{path}/rows/{f}") for f in s.folders(f"{path}/rows")}


def test_ten_patches_rewrite_at_most_ten_partitions(spark):
    df, path, table = _table(spark)
    before = _stamps(spark, path)
    ids = [3, 33, 63, 4, 5, 6, 100, 101, 599, 9999]
    p = spark.createDataFrame([(i, "cancelled", 1) for i in ids], "id long, status string, ts int")

    def change(rows):
        return MU.patch(rows, p, ["id"], ["status"], [], ["ts"]).table

    assert table.rewrite(p, change) == len({i % 30 for i in ids if i < 600})
    after = _stamps(spark, path)
    assert {f for f in before if before[f] != after[f]} == {f"_part=2026-01-{i % 30 + 1:02d}" for i in ids if i < 600}
    want = change(df)
    assert sorted(map(tuple, table.read().collect())) == sorted(map(tuple, want.collect()))
    assert table.read().dtypes == df.dtypes


def test_rows_move_appear_and_go(spark):
    df, path, table = _table(spark, 90)
    move = spark.createDataFrame([(0,)], "id long")
    to = F.when(F.col("id") == 0, F.lit(dt.date(2026, 5, 5))).otherwise(F.col("travel_date"))

    def shift(rows):
        return rows.withColumn("travel_date", to)

    with pytest.raises(ValueError):
        table.rewrite(move, shift)
    assert table.rewrite(move, shift, spark.createDataFrame([("2026-05-05",)], "_part string")) == 2
    assert table.read().where("id = 0").first().travel_date == dt.date(2026, 5, 5)
    # found again where it is now; and a partition that loses its last row goes
    assert table.rewrite(move, lambda rows: rows.where("id <> 0")) == 2
    assert "_part=2026-05-05" not in _stamps(spark, path)
    assert sorted(r.id for r in table.read().collect()) == list(range(1, 90))


def _rows(spark, rows):
    return spark.createDataFrame(rows, "booking_ref string, created_at timestamp_ntz, amount_paid decimal(12,2), payment_status string, "
                                       "booking_status string, cancelled_at timestamp_ntz")


@pytest.mark.parametrize("seed", range(3))
def test_deltas_equal_recomputation(spark, seed):
    rnd = random.Random(seed)

    def row(i):
        made = dt.datetime(2026, 1, rnd.randrange(1, 9), rnd.randrange(24))
        off = rnd.random() < .3
        return (f"b{i}", made, Decimal(rnd.randrange(1, 9999)) / 100, "refunded" if off else rnd.choice(["paid", "pending"]),
                "cancelled" if off else "confirmed", made + dt.timedelta(days=rnd.randrange(4)) if off else None)

    old = {i: row(i) for i in range(40)}
    new = {i: r for i, r in old.items() if rnd.random() < .7}           # the rest is deleted
    new |= {i: row(i) for i in list(new) if rnd.random() < .4}          # updated
    new |= {i: row(i) for i in range(100, 100 + rnd.choice([0, 15]))}   # inserted
    if seed == 2:
        new = {i: r for i, r in new.items() if r[1].day != 3 and (r[5] is None or r[5].day != 3)}   # a day goes
    before = [r for i, r in old.items() if new.get(i) != r]
    after = [r for i, r in new.items() if old.get(i) != r]
    got = MT.revenue_daily_deltas(MT.revenue_daily(_rows(spark, list(old.values()))),
                                  MT.booking_changes(_rows(spark, before), _rows(spark, after)))
    want = MT.revenue_daily(_rows(spark, list(new.values())))
    assert got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_refresh_reads_the_days_only(spark):
    rows = [("a", dt.datetime(2026, 1, 1), Decimal("1.00"), "refunded", "cancelled", dt.datetime(2026, 1, 2)),
            ("b", dt.datetime(2026, 1, 2), Decimal("2.00"), "paid", "confirmed", None),
            ("c", dt.datetime(2026, 1, 3), Decimal("4.00"), "paid", "confirmed", None)]
    b = _rows(spark, rows)
    stale = MT.revenue_daily(b).withColumn("total_bookings", F.lit(99).cast("bigint"))
    days = spark.createDataFrame([(dt.date(2026, 1, 2),)], "report_date date")
    got = {str(r.report_date): (r.total_bookings, r.cancelled) for r in MT.refresh_revenue_daily(stale, b, days).collect()}
    assert got == {"2026-01-01": (99, 0), "2026-01-02": (1, 1), "2026-01-03": (99, 0)}


def test_text_index_equals_the_scan(spark):
    rnd = random.Random(3)
    rows = [(i, f"Name{i:04d} {rnd.choice(['Ünal', 'O_Neil', '100%', 'back'])}", None if i % 7 == 0 else f"a{i % 50}@X.org")
            for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, name string, mail string").repartition(5)
    index = TextIndex.build(df, scratch_path(spark, "text"), ["name", "mail"], ["name"], rows_per_part=100)
    parts = index.spark.read.parquet(f"{index.path}/index").count()
    assert parts >= 15
    for text, few in (("name0123", True), ("AME01_4", True), ("me1%nal", False), ("ü", False), ("00", False), ("A7@x", False),
                      ("O\\_Ne", False), ("nowhere", True), ("%", False), ("xyz_", True)):
        got = index.search(text)
        want = sorted(map(tuple, search(df, ["name", "mail"], text).collect()), key=str)
        assert sorted(map(tuple, got.collect()), key=str) == want, text
        if few:
            assert len(index.parts(text)) <= 3, text
    assert TextIndex.required("ab_cd%efgh\\%ij") == sorted(["efg", "fgh", "gh%", "h%i", "%ij"])
