"""Scans of the driver tables and the rail stand-in views built on them.

The rail views only re-label the TPC-H-like driver tables into the rail
schema (stations, routes, schedules, bookings, users, user_permissions);
they do none of an operator's work.  Each is a projection (plus one tiny
dimension join for stations), so Catalyst prunes columns and pushes filters
through them into the Parquet scans.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import uuid
from functools import cached_property

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackyard.sources.schema import DECLARED

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations")

# Reference day used in place of CURDATE()/NOW() so results are deterministic.
AS_OF = dt.date(1998, 6, 15)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """SRC1: scan one driver table (Parquet, schema from the file footer)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str,
              lower: int, upper: int, num_partitions: int, properties: dict | None = None) -> DataFrame:
    """SRC1 (optional): read a table straight from the operational database.

    ``partition_column`` (a numeric key such as ``id``) splits the read into
    ``num_partitions`` parallel range queries instead of one connection.
    """
    return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower,
                           upperBound=upper, numPartitions=num_partitions,
                           properties=properties or {})


def declared(name: str, df: DataFrame) -> DataFrame:
    """The rail table's columns, all of them, in their declared types and order."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in DECLARED[name].fields])


def _day(start: dt.date, days: Column) -> Column:
    """Midnight some days after ``start``."""
    return F.date_add(F.lit(start), days.cast("int")).cast("timestamp_ntz")


def _lpad_str(c: Column, n: int) -> Column:
    return F.lpad(c.cast("string"), n, "0")


class Storage:
    """Paths through Spark's own file systems (local, HDFS, object stores, mounts alike)."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def listing(self, path: str) -> list[tuple[str, int, int]]:
        """(name, bytes, time) of a file, or of the files of a folder of part files."""
        p, fs = self._at(path)
        found = [s for s in fs.listStatus(p) if s.isFile()]
        return sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in found)

    def folders(self, path: str) -> list[str]:
        """Names of the folders in a folder; none if it does not exist."""
        p, fs = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []

    def remove(self, path: str) -> None:
        """Delete a file, or a folder with all it holds."""
        p, fs = self._at(path)
        fs.delete(p, True)

    def read_marker(self, path: str) -> str | None:
        p, fs = self._at(path)
        return self.spark.read.text(path).first()[0] if fs.exists(p) else None

    def write_marker(self, path: str, text: str) -> str:
        """Create the marker once; returns the text of whoever created it."""
        p, fs = self._at(path)
        try:
            out = fs.create(p, False)
        except Py4JJavaError:                      # another writer was first
            return self.read_marker(path)
        out.write(bytearray(text.encode()))
        out.close()
        return text


class RailTables:
    """Lazily built rail views over one driver data folder.

    The views are projections, so queries derive them as they scan; nothing is shuffled or written for it.
    With ``materialize=True`` each view is written once as Parquet under the
    shared ``spark.checkpoint.dir`` (folder keyed by the driver files' names,
    sizes and times and by this module's source) and read back from there, for
    what needs stored files (the bloom filters of ``booking_find``).  A marker file names the finished copy; of several writers one wins.
    Stored tables are written in their declared types and read with the declared
    schema (``schema.DECLARED``), without asking a file footer.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, materialize: bool = False):
        self.spark = spark
        self.sf_dir = sf_dir
        self.materialize = materialize
        self.store_salt = ""          # a new salt forces a fresh store (bench)
        self.storage = Storage(spark)

    def raw(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    def _listing(self, table: str) -> list[tuple[str, int, int]]:
        return self.storage.listing(f"{self.sf_dir.rstrip('/')}/{table}.parquet")

    def _store_dir(self) -> str:
        from trackyard.session import ensure_checkpoint_dir
        h = hashlib.sha1(__loader__.get_source(__name__).encode())
        h.update(repr(DECLARED).encode())
        for t in sorted(set(sum(self.SOURCES.values(), ()))):
            h.update(repr((t, self._listing(t))).encode())
        h.update(f"{self.sf_dir.rstrip('/')} {self.store_salt}".encode())
        return f"{ensure_checkpoint_dir(self.spark).rstrip('/')}/trackyard/rail/{h.hexdigest()[:16]}"

    def _stored(self, name: str, build) -> DataFrame:
        if not self.materialize:
            return declared(name, build())
        d = self._store_dir()
        target = self.storage.read_marker(f"{d}/{name}.done")
        if target is None:
            target = f"{d}/{name}-{uuid.uuid4().hex[:8]}"
            self._layout(name, declared(name, build())).write.options(**self.BLOOM.get(name, {})).parquet(target)
            target = self.storage.write_marker(f"{d}/{name}.done", target)
        return self.spark.read.schema(DECLARED[name]).parquet(target)

    # Stored layout: time-clustered files so date filters prune whole files
    # (Parquet min/max), about one file per 16 MB of source data (rows in a shuffle take some
    # eleven times their bytes) and at least one per core so scans run in parallel.
    CLUSTER = {"bookings": "created_at", "schedules": "travel_date"}
    # References lie in every file: a bloom filter per row group lets a lookup of a few skip the others.
    BLOOM = {"bookings": {"parquet.bloom.filter.enabled#booking_ref": "true", "parquet.bloom.filter.adaptive.enabled": "true"}}
    SOURCES = {"stations": ("nation", "region"), "routes": ("supplier",),
               "schedules": ("orders", "supplier"), "bookings": ("lineitem", "customer"),
               "users": ("customer",), "user_permissions": ("customer",)}
    FILE_BYTES = 16 << 20

    def _layout(self, name: str, df: DataFrame) -> DataFrame:
        size = sum(n for t in self.SOURCES[name] for _, n, _ in self._listing(t))
        n = max(self.spark.sparkContext.defaultParallelism, -(-size // self.FILE_BYTES))
        key = self.CLUSTER.get(name)
        if key:
            return df.repartitionByRange(n, key).sortWithinPartitions(key)
        return df.repartition(n)

    def materialize_all(self) -> None:
        """Store all six views, submitting the independent writes as
        concurrent Spark jobs (small dimensions do not wait behind the facts)."""
        from concurrent.futures import ThreadPoolExecutor
        names = ("bookings", "schedules", "users", "user_permissions", "routes", "stations")
        with ThreadPoolExecutor(max_workers=len(names)) as pool:
            list(pool.map(lambda n: getattr(self, n), names))

    @cached_property
    def stations(self) -> DataFrame:
        return self._stored("stations", self._build_stations)

    def _build_stations(self) -> DataFrame:
        n = self.raw("nation")
        r = self.raw("region")
        return (n.join(r, n.n_regionkey == r.r_regionkey, "inner")
                .select((F.col("n_nationkey") + 1).cast("bigint").alias("id"),
                        F.concat(F.lit("N"), _lpad_str(F.col("n_nationkey"), 2)).alias("code"),
                        F.col("n_name").alias("name_en"),
                        F.concat(F.lit("AR_"), F.col("n_name")).alias("name_ar"),
                        F.col("r_name").alias("city_en"),
                        F.concat(F.lit("AR_"), F.col("r_name")).alias("city_ar"),
                        (16 + F.col("n_nationkey") % 16).alias("latitude"), (34 + F.col("n_nationkey") % 22).alias("longitude"),
                        F.when(F.col("n_nationkey") % 12 == 11, 0).otherwise(1).alias("active"),
                        _day(dt.date(1995, 1, 1), F.col("n_nationkey")).alias("created_at")))

    @cached_property
    def routes(self) -> DataFrame:
        return self._stored("routes", self._build_routes)

    def _build_routes(self) -> DataFrame:
        k = F.col("s_suppkey")
        base = 50 + (k * 37) % 400
        return self.raw("supplier").select(
            (k + 1).alias("id"),
            F.concat(F.lit("RT-"), _lpad_str(k + 1, 5)).alias("route_code"),
            (F.col("s_nationkey") + 1).cast("bigint").alias("from_station_id"),
            ((F.col("s_nationkey") + 1 + k % 24) % 25 + 1).cast("bigint").alias("to_station_id"),
            (80 + (k * 53) % 1200).cast("decimal(8,2)").alias("distance_km"),
            (60 + (k * 17) % 300).cast("int").alias("duration_minutes"),
            (2 * base).cast("decimal(10,2)").alias("price_first_class"),
            base.cast("decimal(10,2)").alias("price_economy"),
            F.when(k % 7 == 0, 0).otherwise(25 + (k * 11) % 100)
             .cast("decimal(10,2)").alias("price_student"),
            F.when(k % 10 == 9, 0).otherwise(1).alias("active"),
            F.when(k % 6 != 5, k + 1).alias("created_by"),
            _day(dt.date(1995, 1, 1), k % 700).alias("created_at"),
            _day(dt.date(1995, 1, 1), k % 700 + k % 30).alias("updated_at"))

    @cached_property
    def schedules(self) -> DataFrame:
        return self._stored("schedules", self._build_schedules)

    def _build_schedules(self) -> DataFrame:
        k = F.col("o_orderkey")
        n_routes = self.raw("supplier").select(F.count(F.lit(1))).scalar()
        minute = _lpad_str((k % 4) * 15, 2)
        return self.raw("orders").select(
            k.alias("id"),
            F.concat(F.lit("IR-"), _lpad_str(k % 500, 3)).alias("train_id"),
            (k % n_routes + 1).alias("route_id"),
            F.concat(_lpad_str(k % 20, 2), F.lit(":"), minute, F.lit(":00")).alias("departure_time"),
            F.concat(_lpad_str(k % 20 + 3, 2), F.lit(":"), minute, F.lit(":00")).alias("arrival_time"),
            F.col("o_orderdate").cast("date").alias("travel_date"),
            (8 + 4 * (k % 5)).cast("int").alias("total_seats"),
            ((k * 7) % (9 + 4 * (k % 5))).cast("int").alias("available_seats"),
            F.when(F.col("o_orderpriority") == "1-URGENT", "First Class")
             .when(F.col("o_orderpriority") == "5-LOW", "Student")
             .otherwise("Economy").alias("class"),
            F.when(F.col("o_orderstatus") == "F", "delayed")
             .when(F.col("o_orderstatus") == "P", "cancelled")
             .when(k % 2 == 0, "active").otherwise("scheduled").alias("status"),
            F.when(F.col("o_orderstatus") == "F", 5 + k % 40).otherwise(0)
             .cast("int").alias("delay_minutes"),
            F.when(k % 4 == 0, F.concat(F.lit("Platform "), (k % 8).cast("string"))).alias("notes"),
            F.when(k % 6 != 5, F.col("o_custkey")).alias("created_by"),
            F.date_sub("o_orderdate", (30 + k % 60).cast("int")).cast("timestamp_ntz").alias("created_at"),
            F.date_sub("o_orderdate", (30 + k % 60 - k % 20).cast("int")).cast("timestamp_ntz").alias("updated_at"))

    @cached_property
    def bookings(self) -> DataFrame:
        return self._stored("bookings", self._build_bookings)

    def _build_bookings(self) -> DataFrame:
        n_users = self.raw("customer").select(F.count(F.lit(1))).scalar()
        seat_ix = F.col("l_partkey") % (8 + 4 * (F.col("l_orderkey") % 5))
        flag, lstat = F.col("l_returnflag"), F.col("l_linestatus")
        ln = F.col("l_linenumber") % 5
        n, part = F.col("l_linenumber"), F.col("l_partkey").cast("string")
        gone = F.when(flag == "R", F.col("l_shipdate") + F.expr("make_dt_interval(l_linenumber % 4)"))
        return self.raw("lineitem").select(
            F.concat(F.lit("BK-"), F.col("l_orderkey").cast("string"), F.lit("-"),
                     F.col("l_linenumber").cast("string"), F.lit("-"),
                     F.col("l_partkey").cast("string"), F.lit("-"),
                     F.col("l_suppkey").cast("string")).alias("booking_ref"),
            (F.col("l_partkey") % n_users).alias("user_id"),
            F.col("l_orderkey").alias("schedule_id"),
            F.concat((F.floor(seat_ix / 4).cast("int") + 1).cast("string"),
                     F.expr("chr(65 + (l_partkey % (8 + 4 * (l_orderkey % 5))) % 4)")
                     ).alias("seat_number"),
            F.col("l_extendedprice").cast("decimal(12,2)").alias("amount_paid"),
            F.when(ln == 0, "mada").when(ln == 1, "visa").when(ln == 2, "mastercard")
             .when(ln == 3, "apple_pay").otherwise("cash").alias("payment_method"),
            F.when(flag == "R", "refunded").otherwise("paid").alias("payment_status"),
            F.when(flag == "R", "cancelled").when(flag == "A", "completed")
             .when(lstat == "O", "pending").otherwise("confirmed").alias("booking_status"),
            F.col("l_shipdate").alias("created_at"),
            (F.col("l_orderkey") * 8 + n).alias("id"),
            F.concat(F.lit("Guest"), (F.col("l_partkey") % 50).cast("string")).alias("passenger_first"),
            F.concat(F.lit("No"), F.col("l_suppkey").cast("string")).alias("passenger_last"),
            F.when(F.col("l_partkey") % 5 != 0, F.concat(F.lit("10"), F.lpad(part, 8, "0"))).alias("national_id"),
            F.when(n % 3 != 0, F.concat(F.lit("05"), F.lpad(part, 8, "0"))).alias("phone"),
            F.when(n % 2 == 0, F.concat(F.lit("guest"), part, F.lit("@example.com"))).alias("email"),
            F.when((flag == "R") | (flag == "A") | (lstat != "O"), F.concat(
                F.lit("RWSA-"), F.col("l_orderkey").cast("string"), n.cast("string"), part)).alias("qr_ref"),
            gone.alias("cancelled_at"),
            F.when((flag == "R") & (n % 2 == 0), "Changed plans").alias("cancel_reason"),
            F.coalesce(gone, F.col("l_shipdate")).alias("updated_at"))

    @cached_property
    def users(self) -> DataFrame:
        return self._stored("users", self._build_users)

    def _build_users(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.raw("customer").select(
            k.alias("id"),
            F.concat(F.lower(F.col("c_name")), F.lit("@example.com")).alias("email"),
            F.col("c_mktsegment").alias("first_name"),
            F.col("c_name").alias("last_name"),
            F.when(k % 7 == 0, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("05"), _lpad_str(k, 8))).alias("phone"),
            F.when(k % 5 == 0, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("10"), _lpad_str(k, 8))).alias("national_id"),
            F.when(k % 50 == 0, "admin").when(k % 10 == 1, "staff")
             .otherwise("passenger").alias("role"),
            F.when(k % 9 == 0, "inactive").otherwise("active").alias("status"),
            F.when(k % 2 == 0, 1).otherwise(0).alias("verified"),
            F.date_add(F.lit(dt.date(1995, 1, 1)), (k % 2400).cast("int")).alias("created_at"),
            F.when(k % 5 == 0, "email").when(k % 3 == 0, "both").when(k % 2 == 0, "nafath").otherwise("email")
             .alias("auth_method"),
            F.when(k % 4 != 0, _day(dt.date(1995, 1, 1), k % 2400 + k % 900)).alias("last_login"),
            _day(dt.date(1995, 1, 1), k % 2400 + k % 300).alias("updated_at"))

    @cached_property
    def user_permissions(self) -> DataFrame:
        return self._stored("user_permissions", self._build_user_permissions)

    def _build_user_permissions(self) -> DataFrame:
        k = F.col("c_custkey")
        return (self.raw("customer").where(k % 3 != 0).select(
            k.alias("user_id"),
            F.when((k % 50 == 0) | (k % 10 == 1), 1).otherwise(0).alias("can_schedules"),
            F.lit(1).alias("can_bookings"),
            F.when(k % 50 == 0, 1).otherwise(0).alias("can_routes"),
            F.when(k % 50 == 0, 1).otherwise(0).alias("can_users"),
            F.when((k % 50 == 0) | (k % 10 == 1), 1).otherwise(0).alias("can_reports"),
            F.when((k % 50 == 0) | (k % 30 == 1), 1).otherwise(0).alias("can_pricing")))

    @cached_property
    def events(self) -> DataFrame:
        return self.raw("events")


def rail(spark: SparkSession, sf_dir: str, materialize: bool = False) -> RailTables:
    return RailTables(spark, sf_dir, materialize)
