"""Materialised tables the source declares but never fills (MAT1-MAT3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackyard.functions import expr as X


# MAT1
def revenue_daily(bookings: DataFrame, cancel_ts: str = "cancelled_at", days: DataFrame | None = None) -> DataFrame:
    """Per day: paid revenue and bookings by creation day; cancellations and
    refunded amount by cancellation day (creation day when the snapshot has
    no cancellation time).  Two aggregations joined by date (full outer).
    ``days`` (report_date): only those days; other bookings reach no aggregation."""
    ct = F.col(cancel_ts) if cancel_ts in bookings.columns else F.col("created_at")

    def on(df: DataFrame, ts) -> DataFrame:
        df = df.withColumn("report_date", F.to_date(ts))
        return df if days is None else df.join(days.select("report_date"), "report_date", "left_semi")

    made = on(bookings, "created_at").groupBy("report_date").agg(
        F.sum(F.when(F.col("payment_status") == "paid", F.col("amount_paid"))).alias("_rev"),
        F.count(F.lit(1)).alias("_n"))
    canc = on(bookings.where(F.col("booking_status") == "cancelled"), ct).groupBy("report_date").agg(
        F.count(F.lit(1)).alias("_c"),
        F.sum(F.when(F.col("payment_status") == "refunded", F.col("amount_paid"))).alias("_ref"))
    j = made.join(canc, "report_date", "full")
    return j.select(
        "report_date",
        F.coalesce("_rev", F.lit(0)).cast("decimal(14,2)").alias("total_revenue"),
        F.coalesce("_n", F.lit(0)).cast("bigint").alias("total_bookings"),
        F.coalesce("_c", F.lit(0)).cast("bigint").alias("cancelled"),
        F.coalesce("_ref", F.lit(0)).cast("decimal(14,2)").alias("refunded"))


def refresh_revenue_daily(existing: DataFrame, bookings: DataFrame, days: DataFrame) -> DataFrame:
    """Idempotent refresh of the given days (column report_date) from the full
    bookings: those days are recomputed from all bookings created or cancelled
    on them and replace the stored rows; other days stay."""
    d = days.select("report_date").distinct()
    kept = existing.join(d, "report_date", "left_anti")
    return kept.unionByName(revenue_daily(bookings, days=d).select(*existing.columns))


# MAT1, kept up by what changed
SUMS = {"total_revenue": "decimal(14,2)", "total_bookings": "bigint", "cancelled": "bigint", "refunded": "decimal(14,2)"}


def booking_changes(before: DataFrame | None, after: DataFrame | None) -> DataFrame:
    """Change rows (sign, and the columns that the daily sums read): the rows as they were count -1, as they are now +1.

    before: old images of updated and deleted rows; after: new images of updated and inserted rows.
    """
    def images(df: DataFrame, sign: int) -> DataFrame:
        gone = F.coalesce(*[F.col(c) for c in ("cancelled_at", "created_at") if c in df.columns])
        return df.select(F.lit(sign).alias("sign"), F.to_date("created_at").alias("made"), F.to_date(gone).alias("gone"),
                         "amount_paid", "payment_status", "booking_status")
    parts = [images(df, sign) for df, sign in ((before, -1), (after, 1)) if df is not None]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def revenue_daily_deltas(existing: DataFrame, changes: DataFrame) -> DataFrame:
    """The stored table after ``changes`` (``booking_changes``), read from nothing else.

    Each image adds its sums, with its sign, to the day it was made and to the day it was cancelled
    (``cancelled_at``, else the day it was made).  A day left without bookings and cancellations goes.
    """
    sign, amount = F.col("sign"), F.col("amount_paid")
    zero, none = F.lit(0), F.lit(0).cast("decimal(14,2)")
    money = (sign * amount).cast("decimal(14,2)")
    made = F.struct(F.col("made").alias("report_date"), F.when(F.col("payment_status") == "paid", money).otherwise(none).alias("total_revenue"),
                    sign.alias("total_bookings"), zero.alias("cancelled"), none.alias("refunded"))
    gone = F.struct(F.col("gone").alias("report_date"), none.alias("total_revenue"), zero.alias("total_bookings"),
                    sign.alias("cancelled"), F.when(F.col("payment_status") == "refunded", money).otherwise(none).alias("refunded"))
    cells = F.when(F.col("booking_status") == "cancelled", F.array(made, gone)).otherwise(F.array(made))
    deltas = (changes.select(F.explode(cells).alias("c")).select("c.*").groupBy("report_date")
              .agg(*[F.sum(c).alias(f"_d_{c}") for c in SUMS]))
    j = existing.join(deltas.withColumnRenamed("report_date", "_day"), F.col("report_date").eqNullSafe(F.col("_day")), "full")
    new = j.select(F.coalesce("report_date", "_day").alias("report_date"),
                   *[(F.coalesce(c, F.lit(0)) + F.coalesce(f"_d_{c}", F.lit(0))).cast(t).alias(c) for c, t in SUMS.items()])
    return new.where("total_bookings <> 0 OR cancelled <> 0")


# MAT2
def occupancy_snapshot(schedules: DataFrame, bookings: DataFrame, at) -> DataFrame:
    """occupied = confirmed + completed, reserved = pending, available =
    max(0, total - occupied - reserved), pct as DECIMAL(5,2)."""
    st = F.col("booking_status")
    per = bookings.groupBy(F.col("schedule_id").alias("_sid")).agg(
        F.count(F.when(st.isin("confirmed", "completed"), 1)).alias("_o"),
        F.count(F.when(st == "pending", 1)).alias("_r"))
    j = schedules.join(per, schedules.id == per["_sid"], "left")
    o = F.coalesce("_o", F.lit(0))
    r = F.coalesce("_r", F.lit(0))
    return j.select(
        F.col("id").alias("schedule_id"), X.ntz(at).alias("snapshot_time"),
        "total_seats", o.cast("int").alias("occupied"), r.cast("int").alias("reserved"),
        F.greatest(F.col("total_seats") - o - r, F.lit(0)).cast("int").alias("available"),
        F.round(F.try_divide(o.cast("decimal(20,4)"), F.col("total_seats").cast("decimal(20,4)"))
                * 100, 2).cast("decimal(5,2)").alias("occupancy_pct"))


# MAT3, without joining what is equal
def row_digests(df: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    """(bucket, n, x, s): per key bucket the rows' count and two order-free digests of all their columns."""
    cells = [c for name in sorted(df.columns) for c in (F.col(name), F.col(name).isNull())]     # a NULL leaves a hash as it is
    h = df.select(F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("bucket"), F.xxhash64(*cells).alias("h"))
    return h.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("h")).alias("x"),
                                   F.sum(F.col("h").cast("decimal(20,0)")).alias("s"))


def audit_diff_stored(old: DataFrame, new: DataFrame, keys: Sequence[str], entity_type: str,
                      buckets: int = 65_536) -> DataFrame:
    """``audit_diff`` of two stored snapshots (each is read twice): digests per key bucket are compared
    first, and only rows of buckets that differ are joined.  Equal snapshots shuffle no row."""
    a, b = row_digests(old, keys, buckets), row_digests(new.select(*old.columns), keys, buckets)
    b = b.select(*[F.col(c).alias(f"_{c}") for c in b.columns])
    same = F.lit(True)
    for c in ("n", "x", "s"):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    differ = (a.join(b, F.col("bucket") == F.col("_bucket"), "full").where(~same)
              .select(F.coalesce("bucket", "_bucket").alias("_differs")))

    def rows(df: DataFrame) -> DataFrame:
        own = F.pmod(F.xxhash64(*keys), F.lit(buckets))
        return df.join(F.broadcast(differ), own == F.col("_differs"), "left_semi")      # at most ``buckets`` rows

    return audit_diff(rows(old), rows(new), keys, entity_type)


# MAT3
def audit_diff(old: DataFrame, new: DataFrame, keys: Sequence[str],
               entity_type: str) -> DataFrame:
    """Row-level diff of two snapshots: inserted / updated / deleted rows with
    old and new values as JSON and the names of changed columns."""
    keys = list(keys)
    cols = [c for c in old.columns if c not in keys]
    o = old.select(*keys, F.struct(*cols).alias("_o"))
    n = new.select(*[F.col(k).alias("_n_" + k) for k in keys], F.struct(*cols).alias("_n"))
    cond = None
    for k in keys:
        e = o[k] == n["_n_" + k]
        cond = e if cond is None else cond & e
    j = o.join(n, cond, "full")
    changed = F.array_join(F.filter(
        F.array(*[F.when(~F.col(f"_o.{c}").eqNullSafe(F.col(f"_n.{c}")), F.lit(c))
                  for c in cols]), lambda x: x.isNotNull()), ",")
    action = (F.when(F.col("_o").isNull(), "inserted").when(F.col("_n").isNull(), "deleted")
              .when(changed != "", "updated"))
    out = j.select(*[F.coalesce(F.col(k), F.col("_n_" + k)).alias(k) for k in keys],
                   F.lit(entity_type).alias("entity_type"), action.alias("action"),
                   F.when(F.col("_o").isNotNull() & F.col("_n").isNotNull(), changed)
                    .alias("changed_columns"),
                   F.to_json("_o").alias("old_value"), F.to_json("_n").alias("new_value"))
    return out.where(F.col("action").isNotNull())
