"""SC8: booking references by a keyed permutation, and the booking flow that needs them (SNK1, ADM1).

The references of a given length are the numbers 0 .. 32^length - 1, shown through a keyed
permutation so that neighbours do not look alike.  A batch's rows take the free numbers in
order: a number is free unless a stored reference, of whatever origin, is its image.  References are
distinct by construction, every row gets one until the space is used up, and nothing is drawn twice.

Everything is plain columns, aggregations and windows over ``CELLS`` cells: rows are numbered
within hash cells, stored numbers within equal ranges of which only those below (rows + stored) matter, so
no cell holds more than a ``CELLS``-th of them; only the cells' sums pass through one task.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackyard.functions import expr as X
from trackyard.operators.seats import admit_bookings, taken_seats
from trackyard.session import scratch_path

CELLS = 4096
ROUNDS = 4
# The reference that is the last one left is looked for by ranges of the requests until so many remain.
RANGES = 256
FEW = 1 << 18


def _halves(number: Column, length: int) -> tuple[Column, Column]:
    low = 5 * length // 2
    return F.shiftright(number, low), number.bitwiseAND(F.lit((1 << low) - 1).cast("long"))


def _round(r: int, left: Column, right: Column, length: int) -> tuple[Column, Column]:
    low = 5 * length // 2
    if r % 2:
        return left, right.bitwiseXOR(F.xxhash64(F.lit("reference"), left, F.lit(r)).bitwiseAND(F.lit((1 << low) - 1).cast("long")))
    high = 5 * length - low
    return left.bitwiseXOR(F.xxhash64(F.lit("reference"), right, F.lit(r)).bitwiseAND(F.lit((1 << high) - 1).cast("long"))), right


def _rounds(inverse: bool):
    return reversed(range(ROUNDS)) if inverse else range(ROUNDS)


def permuted(number: Column, length: int, inverse: bool = False) -> Column:
    """A bijection of 0 .. 32^length - 1 (length up to 12): a Feistel network of two unequal halves."""
    left, right = _halves(number, length)
    for r in _rounds(inverse):
        left, right = _round(r, left, right, length)
    return F.shiftleft(left, 5 * length // 2).bitwiseOR(right)


def with_permuted(df: DataFrame, name: str, length: int, inverse: bool = False) -> DataFrame:
    """``df`` with the number in column ``name`` replaced by its image under ``permuted``.

    Each round is a column of its own.  As one expression the rounds are written out in each other,
    13 times the number in all, which with references grows beyond what Spark compiles.
    """
    left, right = _halves(F.col(name), length)
    df = df.withColumns({"_left": left, "_right": right})
    for r in _rounds(inverse):
        left, right = _round(r, F.col("_left"), F.col("_right"), length)
        df = df.withColumn(*(("_right", right) if r % 2 else ("_left", left)))
    return df.withColumn(name, F.shiftleft("_left", 5 * length // 2).bitwiseOR(F.col("_right"))).drop("_left", "_right")


def _symbols(code: Column, length: int) -> Column:
    digits = [F.substring(F.lit(X.BOOKING_REF_ALPHABET),
                          (F.shiftright(code, 5 * i).bitwiseAND(F.lit(31).cast("long")) + 1).cast("int"), F.lit(1))
              for i in range(length)]
    return F.concat(F.lit(X.BOOKING_REF_PREFIX), *digits)


def _code(reference: Column, length: int) -> Column:
    code, start = F.lit(0).cast("long"), len(X.BOOKING_REF_PREFIX)
    for i in range(length):
        digit = F.instr(F.lit(X.BOOKING_REF_ALPHABET), F.substring(reference, start + 1 + i, 1)) - 1
        code = code.bitwiseOR(F.shiftleft(digit.cast("long"), 5 * i))
    return code


def _is_reference(text: Column, length: int) -> Column:
    return text.rlike(f"^{X.BOOKING_REF_PREFIX}[{X.BOOKING_REF_ALPHABET}]{{{length}}}$")


def to_reference(number: Column, length: int) -> Column:
    """The reference of a number; NULL beyond the last one."""
    return F.when(number < 1 << 5 * length, _symbols(permuted(number, length), length))


def to_number(reference: Column, length: int) -> Column:
    """The number of a reference; NULL for text that is no reference of this length."""
    return F.when(_is_reference(reference, length), permuted(_code(reference, length), length, inverse=True))


def _offsets(df: DataFrame, cell: str, size: Column) -> DataFrame:
    """(cell, _before): sum of ``size`` over the cells before; at most about ``CELLS`` rows."""
    sums = df.groupBy(cell).agg(size.cast("long").alias("_sum"))
    w = Window.orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(sums.select(cell, F.coalesce(F.sum("_sum").over(w), F.lit(0).cast("long")).alias("_before")))


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """Rows numbered 0, 1, 2, ... in an order that depends on their keys alone."""
    celled = df.withColumn("_cell", F.pmod(F.xxhash64(key), F.lit(CELLS)))
    w = Window.partitionBy("_cell").orderBy(key)
    return (celled.withColumn("_own", F.row_number().over(w) - 1).join(_offsets(celled, "_cell", F.count(F.lit(1))), "_cell")
            .withColumn(name, (F.col("_before") + F.col("_own")).cast("long")).drop("_cell", "_own", "_before"))


def stored_numbers(existing: DataFrame, length: int) -> DataFrame:
    """(number) of the stored references of this length, once each."""
    codes = existing.where(_is_reference(F.col("booking_ref"), length)).select(
        _code(F.col("booking_ref"), length).alias("number")).distinct()
    return with_permuted(codes, "number", length, inverse=True)


def _kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once under the checkpoint folder and read back, by column: most readers want a few."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def assign_booking_refs(rows: DataFrame, existing: DataFrame, key: str = "request_id",
                        length: int = X.BOOKING_REF_LEN, taken: DataFrame | None = None) -> DataFrame:
    """Give rows a reference 'BK-' + ``length`` symbols that no stored booking and no other row has.

    Row number r (rows in the order of ``numbered``) takes the r-th free number.  With the blocked
    numbers b_0 < b_1 < ... the number of free ones before b_j is b_j - j, so that number is r plus the count
    of j with b_j - j <= r: a running count along one line of rows and blocked numbers.  Rows
    beyond the last free number get NULL.  ``taken``: the ``stored_numbers`` of ``existing`` as kept, where
    they are at hand; else they are kept when this is called.  They are read three times, and a filter on
    derived ones would be written out through all rounds of the permutation.
    """
    taken = _kept(stored_numbers(existing, length), "numbers") if taken is None else taken
    size = rows.select(F.count(F.lit(1))).scalar() + taken.select(F.count(F.lit(1))).scalar()
    width = F.greatest(F.lit(1).cast("long"), F.ceil(size / F.lit(CELLS)).cast("long"))

    def cell(value: str) -> Column:
        return F.floor(F.col(value) / width).cast("long")

    blocked = taken.where(F.col("number") < size).withColumn("_cell", cell("number"))
    rank = F.row_number().over(Window.partitionBy("_cell").orderBy("number")) - 1
    steps = (blocked.withColumn("_own", rank).join(_offsets(blocked, "_cell", F.count(F.lit(1))), "_cell")
             .groupBy((F.col("number") - F.col("_before") - F.col("_own")).cast("long").alias("at"))
             .agg(F.count(F.lit(1)).alias("n")))

    asked = numbered(rows.select(F.struct(*rows.columns).alias("row"), F.col(key).alias("_key")), "_key", "at")
    steps = steps.where(F.col("at") < size).withColumn("_cell", cell("at"))
    line = asked.select("at", F.lit(0).cast("long").alias("n"), "row", cell("at").alias("_cell")).unionByName(
        steps.withColumn("row", F.lit(None).cast(asked.schema["row"].dataType)))
    w = Window.partitionBy("_cell").orderBy("at", F.col("row").isNotNull())
    # rows count for nothing in the cells' sums: the steps and every cell, 0 to CELLS, are all they take
    cells = rows.sparkSession.range(CELLS + 1).select(F.col("id").alias("_cell"), F.lit(0).cast("long").alias("n"))
    placed = line.withColumn("_own", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))) \
        .join(_offsets(steps.select("_cell", "n").unionByName(cells), "_cell", F.sum("n")), "_cell").where(F.col("row").isNotNull())
    number = (F.col("at") + F.col("_before") + F.col("_own")).alias("_number")
    coded = with_permuted(placed.select("row.*", number, number.alias("_code")), "_code", length)
    return coded.withColumn("booking_ref", F.when(F.col("_number") < 1 << 5 * length, _symbols(F.col("_code"), length))) \
        .drop("_number", "_code")


class Booked(NamedTuple):
    outcomes: DataFrame      # one row per request; booking_ref and amount_paid of accepted ones
    bookings: DataFrame      # the accepted requests as rows of the bookings table
    deltas: DataFrame        # (schedule_id, delta) seat changes


def book(requests: DataFrame, schedules: DataFrame, bookings: DataFrame, routes: DataFrame, users: DataFrame,
         length: int = X.BOOKING_REF_LEN) -> Booked:
    """Admission (ADM1), references (SC8) and booking rows (SNK1) as one: accepted = booked = seats taken.

    Requests count in (ts, request_id) order.  From the request on for which no reference is left,
    whoever would be accepted is refused as 'no_reference' and takes no seat.  The admission's candidates and
    outcomes and the stored numbers are kept as files, and two counts decide whether the references suffice,
    when this is called.
    """
    admission = admit_bookings(requests, schedules, bookings, routes, keep=lambda df: _kept(df, "candidates"))
    outcomes = _kept(admission.outcomes, "outcomes")
    taken = _kept(stored_numbers(bookings, length), "numbers")
    left = (1 << 5 * length) - taken.count()
    accepted = outcomes.where("outcome = 'accepted'")
    if accepted.count() > left:
        outcomes = _kept(_cut(outcomes, left, schedules, bookings), "outcomes")
        accepted = outcomes.where("outcome = 'accepted'")
    coded = assign_booking_refs(accepted, bookings, length=length, taken=taken)
    result = outcomes.where("outcome <> 'accepted'").withColumn("booking_ref", F.lit(None).cast("string")).unionByName(coded)
    deltas = accepted.groupBy("schedule_id").agg((-F.count(F.lit(1))).alias("delta"))
    return Booked(result, booking_rows(coded, users), deltas)


def _moment(r) -> Column:
    ts, known = X.ntz(F.lit(None) if r.ts is None else r.ts), F.lit(r.request_id)
    return F.struct(ts, known.cast("string") if r.request_id is None else known)


def _nth(rows: DataFrame, n: int):
    """The (ts, request_id) that has n rows before it in this order.

    Rows are counted by ranges and the one range with the n-th row is looked into, until few rows
    are left: no task sorts or holds more than a range.
    """
    at = F.struct("ts", "request_id")
    rows, total = rows.select("ts", "request_id"), None
    while True:
        ranges = rows.repartitionByRange(RANGES, "ts", "request_id").groupBy(F.spark_partition_id().alias("part")).agg(
            F.count(F.lit(1)).alias("n"), F.min(at).alias("low"), F.max(at).alias("high")).sort("part").collect()
        for found in ranges:
            if n < found.n:
                break
            n -= found.n
        if found.low == found.high:
            return found.low
        if found.n == total:                       # nearly all are equal: the others, or those
            rows = rows.where(at < _moment(found.high))
            total = rows.count()
            if n >= total:
                return found.high
        else:
            rows, total = rows.where((at >= _moment(found.low)) & (at <= _moment(found.high))), found.n
        if total <= FEW:
            return rows.orderBy("ts", "request_id").offset(n).first()


def _cut(outcomes: DataFrame, left: int, schedules: DataFrame, bookings: DataFrame) -> DataFrame:
    """Outcomes when only the first ``left`` accepted requests get a reference: the seats stand still from there on."""
    accepted = outcomes.where("outcome = 'accepted'")
    when = F.struct("ts", "request_id") >= _moment(_nth(accepted, left))
    before = accepted.where(~when)
    sold = before.groupBy(F.col("schedule_id").alias("_s")).agg(F.count(F.lit(1)).alias("_sold"))
    seats = (schedules.select(F.col("id").alias("_id"), "available_seats").join(sold, F.col("_id") == F.col("_s"), "left")
             .select("_id", (F.col("available_seats") - F.coalesce("_sold", F.lit(0))).alias("_left")))
    held = taken_seats(bookings, normalise=True).unionByName(
        before.select("schedule_id", X.seat_key("seat_number").alias("seat"))).distinct() \
        .select(F.col("schedule_id").alias("_hs"), F.col("seat").alias("_hseat"))
    rows = outcomes.withColumns({"_late": when & F.col("outcome").isin("no_seats", "seat_taken", "accepted"),
                                 "_seat": X.seat_key("seat_number")})
    rows = (rows.join(seats, rows.schedule_id == seats["_id"], "left")
            .join(held, (F.col("schedule_id") == F.col("_hs")) & (F.col("_seat") == F.col("_hseat")), "left"))
    late = (F.when(F.col("_left") <= 0, "no_seats").when(F.col("_hs").isNotNull(), "seat_taken").otherwise("no_reference"))
    outcome = F.when(F.col("_late"), late).otherwise(F.col("outcome"))
    return rows.withColumn("outcome", outcome).withColumn(
        "amount_paid", F.when(F.col("outcome") == "accepted", F.col("amount_paid"))).select(*outcomes.columns)


def booking_rows(coded: DataFrame, users: DataFrame) -> DataFrame:
    """Accepted requests with their reference as rows of the bookings table: confirmed and paid, with a QR
    reference of the request time (SC7) and the user's name as passenger."""
    u = users.select(F.col("id").alias("_uid"), F.col("first_name").alias("passenger_first"),
                     F.col("last_name").alias("passenger_last"))
    return coded.join(u, coded.user_id == u["_uid"], "left").select(
        "request_id", "booking_ref", "user_id", "schedule_id", "seat_number", "amount_paid", "payment_method",
        F.lit("paid").alias("payment_status"), F.lit("confirmed").alias("booking_status"),
        F.col("ts").alias("created_at"), "passenger_first", "passenger_last", X.qr_ref("ts").alias("qr_ref"))
