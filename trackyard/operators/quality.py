"""Declared constraints as data-quality checks (DQ1-DQ9).

Violations come back as rows in one long format
``(check, table_name, column_name, value, rows)`` so several checks union
into one report.  Every check is an aggregation or an anti join: one scan
per table, no collect.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackyard.functions import expr as X
from trackyard.sources.schema import (DOMAINS, FOREIGN_KEYS, MAX_LENGTH, NOT_NULL, PAYMENT_METHODS, ROLES,
                                      SCHEDULE_STATUSES, SEAT_HOLDING, TRAIN_CLASSES, UNIQUE_KEYS, USER_STATUSES)

REPORT_COLS = ("check", "table_name", "column_name", "value", "rows")

# fixed value: the validator's default message
INVALID = "Invalid value"
TIME_PATTERN = r"^\d{2}:\d{2}(:\d{2})?$"


def _report(df: DataFrame, check: str, table: str, column: str, value: Column,
            rows: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), F.lit(table).alias("table_name"),
                     F.lit(column).alias("column_name"), value.cast("string").alias("value"),
                     rows.cast("bigint").alias("rows"))


def union_all(parts: Iterable[DataFrame]) -> DataFrame:
    parts = list(parts)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# DQ1: a unique key value held by more than one row (NULLs may repeat).
def unique_violations(df: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    """One aggregation per key column: nearly every value is a group of its own, and a task
    holds those of one column at a time."""
    parts = []
    for c in columns:
        g = (df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("_v"))
             .agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1))
        parts.append(_report(g, "unique", table, c, F.col("_v"), F.col("_n")))
    return union_all(parts)


# DQ2: child keys without a parent row.
def orphan_rows(child: DataFrame, child_table: str, col: str, parent: DataFrame,
                parent_col: str = "id") -> DataFrame:
    """Orphan keys and their rows, by one aggregation over child and parent keys: hot keys are
    reduced map-side, nothing is sorted.  Keys of another type than the parent's keep their
    own and meet it in an anti join, counted per key before."""
    p = parent.select(F.col(parent_col).alias("_pk"))
    if child.schema[col].dataType == parent.schema[parent_col].dataType:
        both = child.where(F.col(col).isNotNull()).select(F.col(col).alias("_pk"), F.lit(1).cast("bigint").alias("_n"))
        both = both.unionByName(p.withColumn("_n", F.lit(None).cast("bigint")))
        keys = both.groupBy("_pk").agg(F.count("_n").alias("_n"), F.count(F.lit(1)).alias("_all"))
        # rows beyond the child's are the parent's
        o = keys.where((F.col("_n") > 0) & (F.col("_all") == F.col("_n")))
        return _report(o, "foreign_key", child_table, col, F.col("_pk"), F.col("_n"))
    keys = child.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    o = keys.join(p, keys[col] == p["_pk"], "left_anti")
    return _report(o, "foreign_key", child_table, col, F.col(col), F.col("_n"))


# One runner over the declared keys, domains, NOT NULL columns and lengths
# (sources/schema.py) for whatever declared tables and columns are at hand.
Tables = Mapping[str, DataFrame]


def _declared(tables: Tables, declared: Mapping[str, Iterable[str]]):
    for name, cols in declared.items():
        have = [c for c in cols if name in tables and c in tables[name].columns]
        if have:
            yield name, tables[name], have


def declared_unique(tables: Tables) -> DataFrame:
    return union_all(unique_violations(df, name, cols) for name, df, cols in _declared(tables, UNIQUE_KEYS))


def declared_foreign_keys(tables: Tables) -> DataFrame:
    return union_all(orphan_rows(tables[child], child, col, tables[parent], pcol)
                     for child, col, parent, pcol, _ in FOREIGN_KEYS
                     if child in tables and parent in tables and col in tables[child].columns)


def declared_domains(tables: Tables) -> DataFrame:
    return union_all(domain_violations(df, name, {c: DOMAINS[name][c] for c in cols})
                     for name, df, cols in _declared(tables, DOMAINS))


def declared_nulls_lengths(tables: Tables) -> DataFrame:
    both = {n: dict.fromkeys([*NOT_NULL.get(n, ()), *MAX_LENGTH.get(n, ())]) for n in {**NOT_NULL, **MAX_LENGTH}}
    return union_all(null_and_length(df, name, [c for c in NOT_NULL.get(name, ()) if c in cols],
                                     {c: n for c, n in MAX_LENGTH.get(name, {}).items() if c in cols})
                     for name, df, cols in _declared(tables, both))


def fk_effects(parent_deleted: DataFrame, child: DataFrame, col: str, on_delete: str,
               parent_col: str = "id") -> DataFrame:
    """Effect of deleting ``parent_deleted`` rows on ``child``.

    cascade -> child rows removed; set_null -> key set to NULL; restrict ->
    the child rows that block the delete (returned, child unchanged).
    """
    d = parent_deleted.select(F.col(parent_col).alias("_dk")).distinct()
    if on_delete == "cascade":
        return child.join(d, child[col] == d["_dk"], "left_anti")
    if on_delete == "set_null":
        j = child.join(d, child[col] == d["_dk"], "left")
        return j.select(*[F.when(F.col("_dk").isNotNull(), F.lit(None)).otherwise(child[c])
                          .cast(child.schema[c].dataType).alias(c) if c == col else child[c]
                          for c in child.columns])
    if on_delete == "restrict":
        return child.join(d, child[col] == d["_dk"], "left_semi")
    raise ValueError(on_delete)


# DQ3: values outside an enum domain.
def domain_violations(df: DataFrame, table: str, domains: Mapping[str, Sequence[str]]) -> DataFrame:
    """All enum columns of a table in one scan: only violating (column,
    value) pairs leave the row, then one aggregation counts them."""
    bad = F.filter(F.array(*[F.when(F.col(c).isNotNull() & ~F.col(c).isin(*dom),
                                    F.struct(F.lit(c).alias("c"),
                                             F.col(c).cast("string").alias("v")))
                             for c, dom in domains.items()]), lambda x: x.isNotNull())
    g = (df.select(F.explode(bad).alias("p"))
         .groupBy(F.col("p.c").alias("_c"), F.col("p.v").alias("_v"))
         .agg(F.count(F.lit(1)).alias("_n")))
    return g.select(F.lit("domain").alias("check"), F.lit(table).alias("table_name"),
                    F.col("_c").alias("column_name"), F.col("_v").alias("value"),
                    F.col("_n").cast("bigint").alias("rows"))


# DQ4: NULL counts of NOT NULL columns and over-long strings, one scan.
def null_and_length(df: DataFrame, table: str, not_null: Sequence[str],
                    max_length: Mapping[str, int]) -> DataFrame:
    aggs = [F.count(F.when(F.col(c).isNull(), 1)).alias(f"n__{c}") for c in not_null]
    aggs += [F.count(F.when(F.length(F.col(c)) > n, 1)).alias(f"l__{c}")
             for c, n in max_length.items()]
    one = df.agg(*aggs)
    cells = [F.struct(F.lit("not_null").alias("check"), F.lit(c).alias("column_name"),
                      F.lit(None).cast("string").alias("value"), F.col(f"n__{c}").alias("rows"))
             for c in not_null]
    cells += [F.struct(F.lit("max_length").alias("check"), F.lit(c).alias("column_name"),
                       F.lit(str(n)).alias("value"), F.col(f"l__{c}").alias("rows"))
              for c, n in max_length.items()]
    x = one.select(F.explode(F.array(*cells)).alias("v"))
    return x.select(F.col("v.check").alias("check"), F.lit(table).alias("table_name"),
                    F.col("v.column_name").alias("column_name"), F.col("v.value").alias("value"),
                    F.col("v.rows").cast("bigint").alias("rows"))


# DQ5: value rules of incoming rows -> one (key, field, message) per failure.
def validate(df: DataFrame, key: str, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """``rules``: (field name, condition that holds for a valid row).  A NULL
    condition counts as a failure; optional fields write ``isNull() | ...``."""
    errs = F.array(*[F.when(~F.coalesce(ok, F.lit(False)),
                            F.struct(F.lit(field).alias("field"), F.lit(INVALID).alias("message")))
                     for field, ok in rules])
    e = df.select(key, F.explode(F.filter(errs, lambda x: x.isNotNull())).alias("e"))
    return e.select(key, F.col("e.field").alias("field"), F.col("e.message").alias("message"))


def validation_errors(df: DataFrame, key: str, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """DQ5 in the validator's response shape: one row per invalid input row with
    ``errors`` = array of {field, message}; built per row, no grouping."""
    errs = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)),
                                     F.struct(F.lit(field).alias("field"),
                                              F.lit(INVALID).alias("message")))
                              for field, ok in rules]), lambda x: x.isNotNull())
    return df.select(key, errs.alias("errors")).where(F.size("errors") > 0)


def booking_request_rules() -> list[tuple[str, Column]]:
    seat = F.col("seat_number")
    return [
        ("scheduleId", F.col("schedule_id") >= 1),
        ("seatNumber", seat.isNotNull() & (F.length(seat) > 0) & (F.length(seat) <= 10)),
        ("paymentMethod", F.col("payment_method").isin(*PAYMENT_METHODS)),
    ]


def schedule_rules() -> list[tuple[str, Column]]:
    return [
        ("trainId", F.col("train_id").isNotNull() & (F.length("train_id") > 0)),
        ("routeId", F.col("route_id") >= 1),
        ("departureTime", F.col("departure_time").rlike(TIME_PATTERN)),
        ("arrivalTime", F.col("arrival_time").rlike(TIME_PATTERN)),
        ("travelDate", F.col("travel_date").isNotNull()),
        ("totalSeats", F.col("total_seats").between(1, 1000)),
        ("class", F.col("class").isin(*TRAIN_CLASSES)),
    ]


def _text(col: str, most: int | None = None) -> Column:
    ok = F.col(col).isNotNull() & (F.length(col) > 0)
    return ok if most is None else ok & (F.length(col) <= most)


def _optional(col: str, ok: Column) -> Column:
    return F.col(col).isNull() | ok


# fixed value: shape of an address (one @, dotted domain)
EMAIL_PATTERN = r"^[^@\s]+@[^@\s.]+(\.[^@\s.]+)+$"
PHONE_PATTERN = r"^\+?[0-9]{7,15}$"


def route_rules() -> list[tuple[str, Column]]:
    """A new route."""
    return [("routeCode", _text("route_code", 20)),
            ("fromStationId", F.col("from_station_id") >= 1), ("toStationId", F.col("to_station_id") >= 1),
            ("distanceKm", F.col("distance_km") >= 1), ("durationMinutes", F.col("duration_minutes") >= 1),
            *((field, F.col(col) >= 0) for field, col in PRICES)]


PRICES = (("priceFirstClass", "price_first_class"), ("priceEconomy", "price_economy"),
          ("priceStudent", "price_student"))


def route_patch_rules() -> list[tuple[str, Column]]:
    return [(field, _optional(col, F.col(col) >= 0)) for field, col in PRICES]


def user_rules() -> list[tuple[str, Column]]:
    """A new user."""
    return [("email", F.col("email").rlike(EMAIL_PATTERN)), ("password", F.length("password") >= 6),
            ("firstName", _text("first_name", 100)), ("lastName", _text("last_name", 100)),
            ("role", F.col("role").isin(*ROLES)), ("phone", _optional("phone", F.col("phone").rlike(PHONE_PATTERN))),
            ("nationalId", _optional("national_id", F.length("national_id") == 10))]


def user_patch_rules() -> list[tuple[str, Column]]:
    return [("email", _optional("email", F.col("email").rlike(EMAIL_PATTERN))),
            ("role", _optional("role", F.col("role").isin(*ROLES))),
            ("status", _optional("status", F.col("status").isin(*USER_STATUSES)))]


def sign_on_rules() -> list[tuple[str, Column]]:
    return [("nationalId", F.col("national_id").rlike("^[0-9]{10}$")), ("role", F.col("role").isin(*ROLES))]


def schedule_patch_rules() -> list[tuple[str, Column]]:
    return [("status", _optional("status", F.col("status").isin(*SCHEDULE_STATUSES)))]


# DQ6: cross-column rules.
def cross_column(routes: DataFrame, schedules: DataFrame) -> DataFrame:
    same = (routes.where(F.col("from_station_id") == F.col("to_station_id"))
            .groupBy().agg(F.count(F.lit(1)).alias("_n")))
    bad = (schedules.where((F.col("available_seats") < 0)
                           | (F.col("available_seats") > F.col("total_seats")))
           .groupBy().agg(F.count(F.lit(1)).alias("_n")))
    return union_all([
        _report(same, "from_equals_to", "routes", "to_station_id", F.lit(None), F.col("_n")),
        _report(bad, "seats_out_of_range", "schedules", "available_seats", F.lit(None),
                F.col("_n"))])


# DQ7: stored available_seats vs total - bookings that took a seat
# (every booking not cancelled; completed ones keep their seat counted).
def seat_drift(schedules: DataFrame, bookings: DataFrame) -> DataFrame:
    per = (bookings.where(F.col("booking_status") != "cancelled")
           .groupBy(F.col("schedule_id").alias("_sid")).agg(F.count(F.lit(1)).alias("_n")))
    j = schedules.join(per, schedules.id == per["_sid"], "left")
    expected = F.col("total_seats") - F.coalesce(F.col("_n"), F.lit(0))
    return (j.select(F.col("id").alias("schedule_id"), "total_seats", "available_seats",
                     expected.cast("bigint").alias("expected_available"),
                     (F.col("available_seats") - expected).cast("bigint").alias("drift"))
            .where(F.col("drift") != 0))


# DQ8: seats held by more than one live booking (labels compared as admission does).
def double_sold(bookings: DataFrame) -> DataFrame:
    return (bookings.where(F.col("booking_status").isin(*SEAT_HOLDING))
            .groupBy("schedule_id", X.seat_key("seat_number").alias("seat_number"))
            .agg(F.count(F.lit(1)).alias("bookings"))
            .where(F.col("bookings") > 1))


def double_sold_rows(bookings: DataFrame) -> DataFrame:
    """The live bookings inside double-sold groups (semi join, no collect)."""
    g = double_sold(bookings).select(F.col("schedule_id").alias("_s"),
                                     F.col("seat_number").alias("_seat"))
    live = bookings.where(F.col("booking_status").isin(*SEAT_HOLDING))
    return live.join(g, (live.schedule_id == g["_s"]) & (X.seat_key(live.seat_number) == g["_seat"]),
                     "left_semi")
