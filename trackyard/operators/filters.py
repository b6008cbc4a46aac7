"""Filters, search, visibility, sorting and paging (FLT*, SRT*, LIM1).

All predicates are plain column expressions, so Catalyst pushes the ones on
base columns down into the Parquet scan (see PushedFilters in explain).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackyard.functions.expr import c, ntz


def conjunction(conds: Sequence[Column | None]) -> Column | None:
    conds = [x for x in conds if x is not None]
    return reduce(lambda a, b: a & b, conds) if conds else None


# FLT1 / FLT5: each given parameter adds one AND; none -> no filter.
def filter_where(df: DataFrame, **params) -> DataFrame:
    cond = conjunction([F.col(k) == F.lit(v) for k, v in params.items() if v not in (None, "")])
    return df if cond is None else df.where(cond)


def _station_match(code_col: str, name_col: str, text: str) -> Column:
    # user text is not escaped: % and _ typed by the user act as wildcards
    return (F.col(code_col) == F.lit(text)) | F.col(name_col).ilike(f"%{text}%")


# FLT2
def match_station(df: DataFrame, from_: str | None = None, to: str | None = None,
                  prefix_from: str = "from_", prefix_to: str = "to_") -> DataFrame:
    cond = conjunction([
        _station_match(f"{prefix_from}code", f"{prefix_from}name_en", from_) if from_ else None,
        _station_match(f"{prefix_to}code", f"{prefix_to}name_en", to) if to else None])
    return df if cond is None else df.where(cond)


# FLT3: substring search over several columns; NULL columns do not match.
def search(df: DataFrame, cols: Sequence[str], text: str | None) -> DataFrame:
    if not text:
        return df
    cond = reduce(lambda a, b: a | b, [F.coalesce(F.col(x).ilike(f"%{text}%"), F.lit(False))
                                       for x in cols])
    return df.where(cond)


# FLT4: lower-cased concatenation contains the text (may match across columns).
def search_concat(df: DataFrame, cols: Sequence[str], text: str | None) -> DataFrame:
    if not text:
        return df
    joined = F.lower(F.concat(*[F.coalesce(F.col(x).cast("string"), F.lit("")) for x in cols]))
    return df.where(joined.contains(text.lower()))


# FLT6: 'true' -> 1, anything else -> 0, absent -> no filter.
def bool_filter(df: DataFrame, col: str, raw: str | None) -> DataFrame:
    if raw is None:
        return df
    return df.where(F.col(col) == F.lit(1 if raw == "true" else 0))


# FLT9 (FLT7, FLT8 and FLT10 are plain predicates in the operators that use them)
def upcoming(df: DataFrame, as_of: dt.date, col: str = "travel_date") -> DataFrame:
    return df.where(F.col(col) >= F.lit(as_of))


# FLT11: passengers see only their own rows; other roles see all.
def visible_to(df: DataFrame, viewer_id: int, viewer_role: str, owner_col: str = "user_id") -> DataFrame:
    return df.where(F.col(owner_col) == F.lit(viewer_id)) if viewer_role == "passenger" else df


# FLT12
def active(df: DataFrame, col: str = "active") -> DataFrame:
    return df.where(F.col(col) == 1)


def live_sessions(tokens: DataFrame, users: DataFrame, as_of_ts) -> DataFrame:
    """Tokens not yet expired whose user is active (semi join, no fan-out)."""
    live = tokens.where(F.col("expires_at") > ntz(as_of_ts))
    act = users.where(F.col("status") == "active").select(F.col("id").alias("_uid"))
    return live.join(act, live.user_id == act["_uid"], "left_semi")


# SRT* + LIM1: ORDER BY ... LIMIT limit OFFSET (page-1)*limit.  The caller's
# order must be total (end it with a unique column) for stable pages.
def paginate(df: DataFrame, order: Sequence[Column | str], page: int = 1, limit: int = 20) -> DataFrame:
    page = max(1, int(page))
    return df.orderBy(*[c(o) for o in order]).offset((page - 1) * limit).limit(limit)


def visibility_counts(users: DataFrame, bookings: DataFrame, owner_col: str = "user_id") -> DataFrame:
    """FLT11 for every user at once: how many bookings each user may see.

    Passengers see their own rows, other roles all rows.  Computed from
    per-owner counts and one global count, never as viewers x bookings.
    """
    own = bookings.groupBy(F.col(owner_col).alias("_o")).agg(F.count(F.lit(1)).alias("_own"))
    total = bookings.select(F.count(F.lit(1))).scalar()
    j = users.join(own, users.id == own["_o"], "left")
    own_n = F.coalesce(F.col("_own"), F.lit(0))
    return j.select("id", "role", own_n.alias("own_bookings"),
                    F.when(F.col("role") == "passenger", own_n).otherwise(total)
                     .alias("visible_bookings"))
