"""Scalar column expressions (all built-in Spark functions, JVM side).

Fixed values below (labels, prefixes, alphabets, thresholds) must equal the
studied application's; they are listed together in natural order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values ------------------------------------------------------------
# booking-reference alphabet (32 symbols, no I, O, 0, 1) and length
BOOKING_REF_ALPHABET = "ABCDEFGHJKLMNPQRSTUVWXYZ23456789"
BOOKING_REF_LEN = 5
BOOKING_REF_PREFIX = "BK-"
QR_PREFIX = "RWSA-"
BOARDING_PASS_TAG = "RWSA"
PHONE_COUNTRY_PREFIX = "+966"
SIGN_ON_EMAIL_DOMAIN = "@nafath.sa"
# names and auth method given to users created by national sign-on
SIGN_ON_FIRST_NAME = "Nafath"
SIGN_ON_LAST_NAME = "User"
SIGN_ON_AUTH_METHOD = "nafath"
# auth method of users created with a password
PASSWORD_AUTH_METHOD = "email"
# booking status labels
BOOKING_STATUS_LABELS = {
    "en": {"confirmed": "Confirmed", "completed": "Completed", "cancelled": "Cancelled",
           "pending": "Pending"},
    "ar": {"confirmed": "مؤكد", "completed": "مكتمل", "cancelled": "ملغى", "pending": "معلق"},
}
# train status labels
TRAIN_STATUS_LABELS = {
    "en": {"active": "On Time", "delayed": "Delayed", "cancelled": "Cancelled"},
    "ar": {"active": "في الموعد", "delayed": "متأخر", "cancelled": "ملغى"},
}
# direction arrow per language
ROUTE_ARROW = {"en": "→", "ar": "←"}
# occupancy bands on the integer-rounded percentage
BAND_RED_ABOVE = 85
BAND_AMBER_ABOVE = 60
# shift of day by local hour
SHIFT_MORNING_BEFORE = 12
SHIFT_AFTERNOON_BEFORE = 18
SHIFT_TZ = "Asia/Riyadh"
SHIFT_LABELS = {"en": ("Morning Shift", "Afternoon Shift", "Evening Shift"),
                "ar": ("وردية الصباح", "وردية النهار", "وردية المساء")}
# message templates ({ref}, {from}, {to}, {date}, {dep}, {seat}, {amount} are filled in)
SMS_CONFIRMATION = ("RailWay SA: Booking confirmed ✅\nRef: {ref}\n{from} → {to}\n"
                    "Date: {date} at {dep}\nSeat: {seat}\nSAR {amount}\nتم تأكيد حجزك")
MAIL_CONFIRMATION_SUBJECT = "Booking Confirmed — {ref} | تأكيد الحجز"
SMS_CANCELLATION = "RailWay SA: Booking {ref} cancelled. Refund in 3-5 days. | تم إلغاء الحجز {ref}"
MAIL_CANCELLATION_SUBJECT = "Booking Cancelled — {ref} | تم الإلغاء"


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Time handling that does not depend on the session time zone: event times
# are TIMESTAMP_NTZ wall-clock values in UTC.
def ntz(value) -> Column:
    """A TIMESTAMP_NTZ literal (from text, so no zone is applied)."""
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    return F.lit(value.isoformat(sep=" ") if hasattr(value, "hour") else str(value)) \
        .cast("timestamp_ntz")


def utc_instant(ts) -> Column:
    """NTZ wall clock (UTC) -> TIMESTAMP instant, whatever the session zone."""
    # the cast reads the wall clock in the session zone; shift it back to UTC
    return F.from_utc_timestamp(c(ts).cast("timestamp"), F.current_timezone())


def utc_wall(ts) -> Column:
    """TIMESTAMP instant -> NTZ wall clock in UTC, whatever the session zone."""
    # the cast renders in the session zone; pre-shift so it renders the UTC clock
    return F.to_utc_timestamp(c(ts), F.current_timezone()).cast("timestamp_ntz")


def map_lookup(mapping: dict, key, default=None) -> Column:
    """Literal map lookup (a small fixed dictionary, no join)."""
    m = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
    out = F.try_element_at(m, c(key))
    return out if default is None else F.coalesce(out, c(default))


# SC1: fare by class; falsy (NULL or 0) falls back to the economy price.
def fare_for_class(cls, first, economy, student) -> Column:
    price = (F.when(c(cls) == "First Class", c(first))
             .when(c(cls) == "Economy", c(economy))
             .when(c(cls) == "Student", c(student)))
    return F.coalesce(F.nullif(price, F.lit(0)), c(economy))


# SC2: x / y * 100 rounded half-up to ``scale`` decimals; NULL when y is 0.
def pct(x, y, scale: int = 1) -> Column:
    return F.round(F.try_divide(c(x).cast("double"), c(y).cast("double")) * 100, scale)


# SC3: seat label of seat number i (1-based): row = (i-1) div 4 + 1, letter A..D.
def seat_label(i) -> Column:
    i0 = c(i) - 1
    return F.concat((F.floor(i0 / 4) + 1).cast("string"),
                    F.chr((F.lit(65) + i0 % 4).cast("bigint")))


# Seat labels compare case- and trailing-space-insensitively in the database.
def seat_key(seat) -> Column:
    return F.upper(F.rtrim(c(seat)))


# SC4/FLT10: the trailing window start, N days before ``as_of`` (N+1 days incl. today).
def trailing_start(as_of, days: int) -> Column:
    return F.date_sub(F.lit(as_of), days)


# SC5: empty string -> NULL.
def empty_to_null(x) -> Column:
    return F.nullif(c(x), F.lit(""))


# SC6: boarding-pass payload text.
def boarding_pass(ref, train, from_code, to_code, date, seat, name, tagged: bool = True) -> Column:
    parts = [c(ref), c(train), F.concat(c(from_code), F.lit("-"), c(to_code)),
             c(date).cast("string"), c(seat), c(name)]
    if tagged:
        parts = [F.lit(BOARDING_PASS_TAG)] + parts
    return F.concat_ws("|", *parts)


# SC7: QR reference = prefix + base-36 upper-case epoch milliseconds.
def qr_ref(ts) -> Column:
    millis = F.unix_millis(utc_instant(ts))
    return F.concat(F.lit(QR_PREFIX), F.upper(F.conv(millis.cast("string"), 10, 36)))


# SC9: phone to E.164: '+...' kept, else country prefix + number without its first char.
def phone_e164(p) -> Column:
    return (F.when(c(p).isNull(), F.lit(None).cast("string"))
            .when(c(p).startswith("+"), c(p))
            .otherwise(F.concat(F.lit(PHONE_COUNTRY_PREFIX), F.substr(c(p), F.lit(2)))))


# SC10: confirmation / cancellation texts, filled from columns.
def fill_template(template: str, **cols) -> Column:
    """Concatenate the template's literal pieces with the named columns."""
    import re
    parts = []
    for piece in re.split(r"(\{[a-z]+\})", template):
        if piece.startswith("{") and piece.endswith("}"):
            parts.append(c(cols[piece[1:-1]]).cast("string"))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def confirmation_sms(ref, from_, to, date, dep, seat, amount) -> Column:
    return fill_template(SMS_CONFIRMATION, ref=ref, to=to, date=date, dep=dep, seat=seat,
                         amount=amount, **{"from": from_})


def confirmation_subject(ref) -> Column:
    return fill_template(MAIL_CONFIRMATION_SUBJECT, ref=ref)


def cancellation_sms(ref) -> Column:
    return fill_template(SMS_CANCELLATION, ref=ref)


def cancellation_subject(ref) -> Column:
    return fill_template(MAIL_CANCELLATION_SUBJECT, ref=ref)


def notices(rows, sms: Column, mail: Column, keep: list[str]):
    """One row per message whose channel is known: both are built in one pass over ``rows``."""
    return (rows.select(*keep, F.explode(F.array(sms, mail)).alias("_n"))
            .where(F.col("_n.channel").isNotNull()).select(*keep, "_n.*"))


# SC12: localised station name with fallback to the key; arrow by language.
def route_label(from_name, to_name, lang: str = "en") -> Column:
    return F.concat(c(from_name), F.lit(f" {ROUTE_ARROW[lang]} "), c(to_name))


# SC13: localised status labels.
def booking_status_label(status, lang: str = "en") -> Column:
    return map_lookup(BOOKING_STATUS_LABELS[lang], status)


def train_status_label(status, lang: str = "en") -> Column:
    return map_lookup(TRAIN_STATUS_LABELS[lang], status)


# SC14: occupancy band on the integer-rounded percentage.
def occupancy_band(pct_col) -> Column:
    p = F.round(c(pct_col), 0)
    return (F.when(p > BAND_RED_ABOVE, "red").when(p > BAND_AMBER_ABOVE, "amber")
            .otherwise("green"))


# SC15: performance tier with caller-given thresholds (the source has no rule).
def tier(x, high: float = 70, med: float = 50) -> Column:
    return (F.when(c(x) >= high, "high").when(c(x) >= med, "med")
            .when(c(x).isNotNull(), "low"))


# SC16: shift of day from a UTC timestamp, in the local zone.
def shift_of_day(ts, lang: str = "en") -> Column:
    h = F.hour(F.convert_timezone(F.lit("UTC"), F.lit(SHIFT_TZ), c(ts).cast("timestamp_ntz")))
    m, a, e = SHIFT_LABELS[lang]
    return (F.when(h < SHIFT_MORNING_BEFORE, m).when(h < SHIFT_AFTERNOON_BEFORE, a)
            .otherwise(e))


# SC17: minutes -> hours, station short code, 'SAR n', thousands separator.
def minutes_to_hours(m) -> Column:
    return c(m) / 60.0


def short_code(name) -> Column:
    return F.upper(F.substring(c(name), 1, 3))


def sar(amount) -> Column:
    return F.concat(F.lit("SAR "), c(amount).cast("string"))


def thousands(x, decimals: int = 0) -> Column:
    return F.format_number(c(x), decimals)


# SC18: boolean flag -> 0/1.
def flag01(x) -> Column:
    return F.coalesce(c(x).cast("boolean"), F.lit(False)).cast("int")


# SC19: delay label of a train: cancelled / delayed +Nm / on time.
def delay_label(status, delay_minutes) -> Column:
    return (F.when(c(status) == "cancelled", F.lit("Cancelled"))
            .when(c(status) == "delayed",
                  F.concat(F.lit("Delayed +"), c(delay_minutes).cast("string"), F.lit("m")))
            .otherwise(F.lit("On Time")))


def alert_level(status) -> Column:
    return (F.when(c(status) == "cancelled", "error")
            .when(c(status) == "delayed", "warning"))


# SC20: e-mail normalisation (lower + trim) and synthetic national-sign-on e-mail.
def normalize_email(e) -> Column:
    return F.lower(F.trim(c(e)))


def sign_on_email(national_id) -> Column:
    return F.concat(c(national_id), F.lit(SIGN_ON_EMAIL_DOMAIN))
