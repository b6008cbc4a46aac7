"""Declared columns are stored and read as declared; lookups by reference skip row groups."""

import pytest
from pyspark.sql import functions as F

from trackyard.operators import mutate as MU
from trackyard.operators import views as V
from trackyard.session import scratch_path
from trackyard.sources.schema import DECLARED
from trackyard.sources.tables import RailTables, rail

from conftest import SF_SMALL


@pytest.mark.parametrize("name", sorted(DECLARED))
def test_tables_are_read_as_declared(spark, name):
    df = getattr(rail(spark, SF_SMALL), name)
    want = [(f.name, f.dataType) for f in DECLARED[name].fields]
    assert [(f.name, f.dataType) for f in df.schema.fields] == want
    filled = df.select(*[F.count(c).alias(c) for c in df.columns]).first()
    assert all(filled), filled
    assert sorted(map(str, df.collect())) == sorted(map(str, getattr(rail(spark, SF_SMALL, materialize=False), name).collect()))


def _rows_read(df):
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_lookup_skips_row_groups(spark):
    refs = spark.range(64_000).select(F.concat(F.lit("BK-"), F.hex(F.xxhash64("id"))).alias("booking_ref"), "id")
    read = {}
    for name, options in (("plain", {}), ("bloom", RailTables.BLOOM["bookings"])):
        path = scratch_path(spark, f"refs-{name}")
        refs.repartition(16).write.options(**options).parquet(path)
        asked = [r.booking_ref for r in refs.where("id IN (7, 4711)").collect()]
        found = spark.read.parquet(path).where((F.col("booking_ref") == asked[0]) | (F.col("booking_ref") == asked[1]))
        assert found.count() == 2
        read[name] = _rows_read(found)
    assert read["plain"] == 64_000 and read["bloom"] <= 4 * 4_100


def test_few_and_many_references(spark, monkeypatch):
    t = rail(spark, SF_SMALL)
    refs = [r.booking_ref for r in t.bookings.where("user_id % 40 = 3").select("booking_ref").distinct().collect()] + ["BK-NONE"]
    want = sorted(map(str, V.booking_view(t.bookings.where("user_id % 40 = 3"), t.schedules, t.routes, t.stations).collect()))
    for few in (len(refs), 3):
        monkeypatch.setattr(V, "FEW", few)
        assert sorted(map(str, V.find_bookings(refs, t.bookings, t.schedules, t.routes, t.stations).collect())) == want
    assert V.find_bookings([], t.bookings, t.schedules, t.routes, t.stations).count() == 0


def test_snapshots_without_the_declared_columns(spark, seed):
    """The operators take what the snapshot carries."""
    v = V.booking_view(seed.bookings, seed.schedules, seed.routes, seed.stations)
    assert v.count() == seed.bookings.count() and "qr_ref" not in v.columns
    users, permissions, _ = MU.find_or_create(seed.users, seed.user_permissions, spark.createDataFrame([("1999",)], "national_id string"))
    assert "auth_method" not in users.columns
    new = permissions.join(seed.user_permissions, "user_id", "left_anti").first()
    assert new.can_bookings == 1 and not any(new[c] for c in permissions.columns if c.startswith("can_") and c != "can_bookings")


def test_cancel_keeps_earlier_cancellations(spark):
    t = rail(spark, SF_SMALL)
    one = t.bookings.where("booking_status = 'confirmed'").first()
    ask = spark.createDataFrame([("r", one.booking_ref, one.created_at, "late")],
                                "request_id string, booking_ref string, ts timestamp_ntz, reason string")
    after = MU.cancel_bookings(t.bookings, ask).table
    old = t.bookings.where("cancelled_at IS NOT NULL")
    assert after.where("cancelled_at IS NOT NULL").exceptAll(old).select("cancelled_at", "cancel_reason", "updated_at").distinct().collect() \
        == [(one.created_at, "late", one.created_at)]
    assert old.exceptAll(after).isEmpty()
