"""Table mutations as snapshot transforms (SNK1-SNK14).

Each operator takes the current table snapshot(s) and a batch of requests
and returns the new snapshot plus one outcome row per request.  Nothing is
updated in place: writers put a new snapshot in a fresh folder
(``trackyard.sources.sinks``), so a job never reads and overwrites the same
path.  Per-key choices use aggregations (``max_by``/``min_by``) rather than
windows, so a hot key is reduced map-side.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackyard.functions import expr as X
from trackyard.operators.skew import pick_per_key


class Mutation(NamedTuple):
    table: DataFrame       # new snapshot
    outcomes: DataFrame    # one row per request


def _key_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str,
              prefix: str = "_r_") -> DataFrame:
    r = right.select(*[F.col(k).alias(prefix + k) for k in keys],
                     *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        e = left[k].eqNullSafe(r[prefix + k]) if how == "full" else left[k] == r[prefix + k]
        cond = e if cond is None else cond & e
    return left.join(r, cond, how)


# SNK1: append with defaults (new trip: available = total, status 'scheduled').
def append(target: DataFrame, rows: DataFrame, defaults: dict[str, Column] | None = None) -> DataFrame:
    defaults = defaults or {}
    out = rows
    for c, expr in defaults.items():
        out = out.withColumn(c, F.coalesce(F.col(c), expr) if c in out.columns else expr)
    out = out.select(*[F.col(c).cast(target.schema[c].dataType) if c in out.columns
                       else F.lit(None).cast(target.schema[c].dataType).alias(c)
                       for c in target.columns])
    return target.unionByName(out)


def append_schedules(schedules: DataFrame, routes: DataFrame, rows: DataFrame) -> Mutation:
    """New trips; the route must exist and be active (DQ9), else rejected."""
    live = routes.where(F.col("active") == 1).select(F.col("id").alias("_rid"))
    chk = rows.join(live, rows.route_id == live["_rid"], "left")
    ok = F.col("_rid").isNotNull()
    outcomes = chk.select("id", "route_id",
                          F.when(ok, "created").otherwise("route_not_found_or_inactive")
                           .alias("outcome"))
    new = chk.where(ok).drop("_rid")
    made = {"updated_at": F.col("created_at")} if "created_at" in rows.columns else {}
    table = append(schedules, new, {"available_seats": F.col("total_seats"),
                                    "status": F.lit("scheduled"),
                                    "delay_minutes": F.lit(0), **made})
    return Mutation(table, outcomes)


def append_routes(routes: DataFrame, rows: DataFrame, order: Sequence[Column | str]) -> Mutation:
    """New routes (DQ9): both ends must differ ('same_station') and the route
    code be unused, also by an earlier row ('route_code_exists')."""
    same = F.col("from_station_id") == F.col("to_station_id")
    ins = insert_ignore(routes.select("route_code"), rows.where(~same), ["route_code"], order).outcomes
    created = ins.where(F.col("outcome") == "inserted").drop("outcome")
    outcomes = (rows.where(same).select("id", "route_code", F.lit("same_station").alias("outcome"))
                .unionByName(ins.select("id", "route_code", F.when(F.col("outcome") == "inserted", "created")
                                        .otherwise("route_code_exists").alias("outcome"))))
    return Mutation(append(routes, created, {"active": F.lit(1)}), outcomes)


# SNK2 (+SNK3): INSERT IGNORE -- a row that meets a stored row, or an earlier
# inserted row, in any unique key is skipped; a key with a NULL meets nothing.
def insert_ignore(target: DataFrame, rows: DataFrame, keys: Sequence[str | Sequence[str]],
                  order: Sequence[Column | str]) -> Mutation:
    """``keys``: the unique keys, each a column or several; ``order`` is total.

    With one unique key the first row of each key value is inserted.  With
    several, rounds of the same rule are needed (a row may be skipped
    because of a row that is itself skipped): in each round the rows that
    come first in all their keys are inserted and the rows that meet them
    are ignored.  Each round's undecided rows are checkpointed.
    """
    uniques = [(k,) if isinstance(k, str) else tuple(k) for k in keys]
    ordk = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    left = rows.withColumn("_ord", ordk).withColumn("_met", F.lit(False))
    for u in uniques:
        left = _meet(left, target.where(_filled(u)).select(*u).distinct(), u)
    done = left.where("_met").withColumn("_in", F.lit(False))
    left = left.where("not _met")
    while True:
        for n, u in enumerate(uniques):
            firsts = left.where(_filled(u)).groupBy(*[F.col(k).alias(f"_k_{k}") for k in u]).agg(
                F.min("_ord").alias(f"_first{n}"))
            left = left.join(firsts, [left[k] == firsts[f"_k_{k}"] for k in u], "left") \
                .drop(*[f"_k_{k}" for k in u])
        first = F.lit(True)
        for n, u in enumerate(uniques):
            first = first & (~_filled(u) | (F.col("_ord") == F.col(f"_first{n}")))
        left = left.withColumn("_in", first).drop(*[f"_first{n}" for n in range(len(uniques))])
        if len(uniques) == 1:
            done = done.unionByName(left)
            break
        left = left.checkpoint(eager=True)
        won = left.where("_in")
        done = done.unionByName(won)
        left = left.where("not _in")
        for u in uniques:
            left = _meet(left, won.where(_filled(u)).select(*u).distinct(), u)
        done = done.unionByName(left.where("_met"))
        left = left.where("not _met").drop("_in")
        if left.isEmpty():
            break
    outcomes = done.select(*rows.columns, F.when(F.col("_in"), "inserted").otherwise("ignored")
                           .alias("outcome"))
    new = done.where("_in").select(*[c for c in target.columns if c in rows.columns])
    return Mutation(target.unionByName(new, allowMissingColumns=True), outcomes)


def _filled(cols: Sequence[str]) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull()
    return cond


def _meet(rows: DataFrame, taken: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Set ``_met`` where the row's key is among the distinct ``taken`` keys."""
    t = taken.select(*[F.col(c).alias(f"_t_{c}") for c in cols]).withColumn("_hit", F.lit(True))
    j = rows.join(t, [rows[c] == t[f"_t_{c}"] for c in cols], "left")
    return j.withColumn("_met", F.col("_met") | F.col("_hit").isNotNull()) \
        .drop("_hit", *[f"_t_{c}" for c in cols])


# SNK4: upsert (ON DUPLICATE KEY UPDATE cols); last row per key by ``order`` wins.
def upsert(target: DataFrame, rows: DataFrame, keys: Sequence[str], cols: Sequence[str],
           order: Sequence[Column | str]) -> DataFrame:
    keys, cols = list(keys), list(cols)
    src = pick_per_key(rows.select(*keys, *cols, *[o for o in order if isinstance(o, str)
                                                   and o not in keys + cols]),
                       keys, order, last=True).withColumn("_src", F.lit(1))
    j = _key_join(target.withColumn("_tgt", F.lit(1)), src, keys, "full")
    out = []
    for c in target.columns:
        if c in keys:
            out.append(F.coalesce(F.col(c), F.col("_r_" + c)).alias(c))
        elif c in cols:
            out.append(F.when(F.col("_src").isNotNull(), src[c]).otherwise(target[c])
                       .cast(target.schema[c].dataType).alias(c))
        else:
            out.append(target[c])
    return j.select(*out)


# SNK5: find-or-create users by national id (+ default permission row).
def find_or_create(users: DataFrame, permissions: DataFrame, national_ids: DataFrame) -> tuple:
    """Returns (users, permissions, mapping national_id -> user id, created flag, role).

    New users get the sign-on e-mail ('<id>' + SIGN_ON_EMAIL_DOMAIN) and
    names and method (expr fixed values), role passenger, status active, verified 1,
    a deterministic id derived from the national id (xxhash64,
    non-negative), so reruns give the same ids, and a permission row with
    bookings only.
    """
    ids = national_ids.select("national_id").where(F.col("national_id").isNotNull()).distinct()
    existing = users.where(F.col("national_id").isNotNull()).select(
        F.col("national_id").alias("_nid"), F.col("id").alias("_uid"),
        F.col("role").alias("_urole"))
    j = ids.join(existing, ids.national_id == existing["_nid"], "left")
    new = j.where(F.col("_uid").isNull()).select("national_id")
    new_id = F.abs(F.xxhash64(F.lit("sign_on"), F.col("national_id")))
    new_users = new.select(
        new_id.alias("id"), X.sign_on_email("national_id").alias("email"),
        F.lit(X.SIGN_ON_FIRST_NAME).alias("first_name"),
        F.lit(X.SIGN_ON_LAST_NAME).alias("last_name"),
        F.lit(None).cast("string").alias("phone"), "national_id",
        F.lit("passenger").alias("role"), F.lit("active").alias("status"),
        F.lit(1).alias("verified"), F.lit(X.SIGN_ON_AUTH_METHOD).alias("auth_method"))
    users2 = _with_new(users, new_users)
    perm_new = new_users.select(F.col("id").alias("user_id"),
                                *[F.lit(int(c == "can_bookings")).alias(c) for c in _flags(permissions)])
    perms2 = permissions.unionByName(perm_new, allowMissingColumns=True)
    mapping = j.select("national_id", F.coalesce(F.col("_uid"), new_id).alias("user_id"),
                       F.col("_uid").isNull().alias("created"),
                       F.coalesce(F.col("_urole"), F.lit("passenger")).alias("user_role"))
    return users2, perms2, mapping


def _flags(permissions: DataFrame) -> list[str]:
    return [c for c in permissions.columns if c.startswith("can_")]


def _with_new(users: DataFrame, new: DataFrame) -> DataFrame:
    """Users with new rows; declared columns that the snapshot does not carry are left out."""
    return users.unionByName(new.select(*[c for c in new.columns if c in users.columns]), allowMissingColumns=True)


def sign_on_checks(mapping: DataFrame, requests: DataFrame) -> DataFrame:
    """Role check of a national sign-on request: refused when the requested
    role differs from the user's and is not 'passenger'.
    requests: national_id, requested_role."""
    m = mapping.select(F.col("national_id").alias("_n"), "user_id", "created", "user_role")
    j = requests.join(m, requests.national_id == m["_n"], "left").drop("_n")
    ok = (F.col("requested_role") == "passenger") | (F.col("requested_role") == F.col("user_role"))
    return j.withColumn("role_ok", F.coalesce(ok, F.lit(False)))


def _truthy(col: Column, dtype: str) -> Column:
    if dtype == "string":
        return col.isNotNull() & (col != "")
    if dtype in ("boolean",):
        return F.coalesce(col, F.lit(False))
    return col.isNotNull() & (col != 0)


# SNK6 + SNK7: patch update with both source flavours.
def patch(target: DataFrame, patches: DataFrame, keys: Sequence[str],
          falsy_keeps: Sequence[str] = (), present_wins: Sequence[str] = (),
          order: Sequence[Column | str] = ("ts",)) -> Mutation:
    """Apply a batch of patches, equal to applying them one by one in order.

    falsy_keeps: ``new || old`` -- NULL, 0 and '' keep the old value, so the
    result is the last truthy patch value, else the old value.
    present_wins: ``new !== undefined ? new : old`` -- a patch row sets the
    column iff its ``has_<col>`` flag is true, even to NULL or 0.
    """
    keys = list(keys)
    ordk = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    types = dict(patches.dtypes)
    aggs = []
    for c in falsy_keeps:
        aggs.append(F.max_by(F.struct(F.col(c).alias("v")),
                             F.when(_truthy(F.col(c), types[c]), ordk)).alias("_p_" + c))
    for c in present_wins:
        aggs.append(F.max_by(F.struct(F.col(c).alias("v")),
                             F.when(F.coalesce(F.col("has_" + c), F.lit(False)), ordk))
                    .alias("_p_" + c))
    agg = patches.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n_patches"), *aggs)
    j = _key_join(target, agg, keys, "left")
    out = []
    for c in target.columns:
        if c in falsy_keeps:
            out.append(F.coalesce(F.col(f"_p_{c}.v"), target[c])
                       .cast(target.schema[c].dataType).alias(c))
        elif c in present_wins:
            out.append(F.when(F.col("_p_" + c).isNotNull(), F.col(f"_p_{c}.v"))
                       .otherwise(target[c]).cast(target.schema[c].dataType).alias(c))
        else:
            out.append(target[c])
    table = j.select(*out)
    found = target.select(*[F.col(k).alias("_f_" + k) for k in keys]).withColumn("_hit", F.lit(1))
    cond = None
    for k in keys:
        e = agg[k] == found["_f_" + k]
        cond = e if cond is None else cond & e
    outcomes = agg.join(found, cond, "left").select(
        *keys, "_n_patches",
        F.when(F.col("_hit").isNotNull(), "updated").otherwise("not_found").alias("outcome")) \
        .withColumnRenamed("_n_patches", "patches")
    return Mutation(table, outcomes)


# SNK8: counter deltas.
def apply_deltas(schedules: DataFrame, deltas: DataFrame, key: str = "schedule_id",
                 delta: str = "delta", col: str = "available_seats") -> DataFrame:
    d = deltas.groupBy(F.col(key).alias("_dk")).agg(F.sum(delta).alias("_d"))
    j = schedules.join(d, schedules.id == d["_dk"], "left")
    return j.select(*[(F.col(c) + F.coalesce(F.col("_d"), F.lit(0))).cast(
        schedules.schema[c].dataType).alias(c) if c == col else F.col(c)
        for c in schedules.columns])


# SNK9: guarded hard delete of schedules.
def delete_schedules(schedules: DataFrame, bookings: DataFrame, ids: DataFrame) -> Mutation:
    """Outcome per requested id: not_found; has_active_bookings (a booking
    whose status is not cancelled); fk_restricted (only cancelled bookings --
    the foreign key without cascade still blocks); deleted."""
    s = schedules.select(F.col("id").alias("_sid"))
    req = ids.select(F.col("id")).distinct()
    asked = bookings.join(req, bookings.schedule_id == req.id, "left_semi")
    per = asked.groupBy(F.col("schedule_id").alias("_bs")).agg(
        F.count(F.when(F.col("booking_status") != "cancelled", 1)).alias("_active"),
        F.count(F.lit(1)).alias("_any"))
    j = req.join(s, req.id == s["_sid"], "left").join(per, req.id == per["_bs"], "left")
    outcome = (F.when(F.col("_sid").isNull(), "not_found")
               .when(F.coalesce(F.col("_active"), F.lit(0)) > 0, "has_active_bookings")
               .when(F.coalesce(F.col("_any"), F.lit(0)) > 0, "fk_restricted")
               .otherwise("deleted"))
    outcomes = j.select("id", outcome.alias("outcome"))
    gone = outcomes.where(F.col("outcome") == "deleted").select(F.col("id").alias("_del"))
    table = schedules.join(gone, schedules.id == gone["_del"], "left_anti")
    return Mutation(table, outcomes)


# SNK10: guarded soft delete of routes.
def deactivate_routes(routes: DataFrame, schedules: DataFrame, ids: DataFrame, as_of) -> Mutation:
    """Refuse when the route has any schedule on/after as_of (any status)."""
    up = (schedules.where(F.col("travel_date") >= F.lit(as_of))
          .select(F.col("route_id").alias("_ur")).distinct())
    r = routes.select(F.col("id").alias("_rid"))
    req = ids.select("id").distinct()
    j = req.join(r, req.id == r["_rid"], "left").join(up, req.id == up["_ur"], "left")
    outcome = (F.when(F.col("_rid").isNull(), "not_found")
               .when(F.col("_ur").isNotNull(), "has_upcoming_schedules")
               .otherwise("deactivated"))
    outcomes = j.select("id", outcome.alias("outcome"))
    off = outcomes.where(F.col("outcome") == "deactivated").select(F.col("id").alias("_off"))
    t = routes.join(off, routes.id == off["_off"], "left")
    table = t.select(*[F.when(F.col("_off").isNotNull(), F.lit(0)).otherwise(F.col(c))
                       .cast(routes.schema[c].dataType).alias(c) if c == "active" else routes[c]
                       for c in routes.columns])
    return Mutation(table, outcomes)


# SNK11: soft delete of users, never oneself.
def deactivate_users(users: DataFrame, requests: DataFrame) -> Mutation:
    """requests: (id, actor_id).  Outcomes: refused_self / not_found / deactivated."""
    u = users.select(F.col("id").alias("_uid"))
    j = requests.join(u, requests.id == u["_uid"], "left")
    outcome = (F.when(F.col("id") == F.col("actor_id"), "refused_self")
               .when(F.col("_uid").isNull(), "not_found").otherwise("deactivated"))
    outcomes = j.select("id", "actor_id", outcome.alias("outcome"))
    off = outcomes.where(F.col("outcome") == "deactivated").select(F.col("id").alias("_off")) \
        .distinct()
    t = users.join(off, users.id == off["_off"], "left")
    table = t.select(*[F.when(F.col("_off").isNotNull(), F.lit("inactive")).otherwise(F.col(c))
                       .alias(c) if c == "status" else users[c] for c in users.columns])
    return Mutation(table, outcomes)


class Cancellation(NamedTuple):
    table: DataFrame
    outcomes: DataFrame
    deltas: DataFrame


# SNK12: cancel transition.
def cancel_bookings(bookings: DataFrame, requests: DataFrame) -> Cancellation:
    """requests: (request_id, booking_ref, ts, reason[, actor_id, actor_role]).

    Per request, in (ts, request_id) order per reference: not_found;
    access_denied (a passenger who does not own the booking; only with the
    actor columns); already_cancelled; refused_completed; else cancelled --
    status 'cancelled', payment 'refunded', cancelled_at = request ts,
    cancel_reason = reason (empty -> NULL), updated_at with them -- and the trip gets one seat
    back.  Only the first permitted request of a live reference cancels;
    later ones see it cancelled.

    The new snapshot takes one row per booking from the requests, which are
    reduced to the first per reference (and actor) before the join.  The
    outcomes need every request again, so there the requests are shuffled
    once, by reference, and that one exchange serves the reductions and the
    join alike: all three take the same columns of it, filters stay out of
    it, and nothing is exchanged by another key.  Requests without a
    reference meet no booking and are not shuffled; those of one reference
    are sorted and streamed by one task, however many.
    """
    acts = "actor_id" in requests.columns
    ask = F.struct("ts", "request_id", X.empty_to_null("reason").alias("reason"))
    who = _who(acts)
    marked = _mark_first(bookings, requests.select("booking_ref", ask.alias("_ask"), who), acts)

    hit = F.col("_by").isNotNull()
    new = {"booking_status": F.lit("cancelled"), "payment_status": F.lit("refunded"),
           "cancelled_at": F.col("_by.ts"), "cancel_reason": F.col("_by.reason"), "updated_at": F.col("_by.ts")}
    table = marked.select(
        *[F.when(hit, new[c]).otherwise(F.col(c)).cast(bookings.schema[c].dataType).alias(c)
          if c in new else F.col(c) for c in bookings.columns],
        *[F.when(hit, new[c]).alias(c) for c in ("cancelled_at", "cancel_reason")
          if c not in bookings.columns])

    named = F.col("booking_ref").isNotNull()
    asked = requests.where(named).select("booking_ref", F.struct("ts", "request_id").alias("_ask"), who) \
        .repartition("booking_ref")
    b = _mark_first(bookings.where(named), asked, acts).select(
        F.col("booking_ref").alias("_bref"), F.col("booking_status").alias("_bst"), F.col("schedule_id").alias("_bsid"),
        "_by", *([F.col("user_id").alias("_buser")] if acts else []))
    j = asked.join(b, asked.booking_ref == b["_bref"], "left")
    outcome = F.when(F.col("_bref").isNull(), "not_found")
    if acts:
        outcome = outcome.when(F.col("_who").isNotNull() & ~F.col("_who.actor_id").eqNullSafe(F.col("_buser")),
                               "access_denied")
    outcome = (outcome.when(F.col("_bst") == "cancelled", "already_cancelled")
               .when(F.col("_bst") == "completed", "refused_completed")
               .when(F.col("_by") == F.col("_ask"), "cancelled")
               .otherwise("already_cancelled"))
    outcomes = j.select("_ask.request_id", "booking_ref", "_ask.ts", F.col("_bsid").alias("schedule_id"),
                        outcome.alias("outcome"))
    nameless = requests.where(~named).select(
        "request_id", "booking_ref", "ts", F.lit(None).cast(bookings.schema["schedule_id"].dataType).alias("schedule_id"),
        F.lit("not_found").alias("outcome"))
    deltas = marked.where(hit).groupBy("schedule_id").agg(F.count(F.lit(1)).alias("delta"))
    return Cancellation(table, outcomes.unionByName(nameless), deltas)


def _who(acts: bool) -> Column:
    """The passenger who asks, as a struct of the actor's id; NULL for those who may cancel any booking."""
    if not acts:
        return F.lit(None).cast("struct<actor_id:bigint>").alias("_who")
    return F.when(F.col("actor_role") == "passenger", F.struct("actor_id")).alias("_who")


def _mark_first(bookings: DataFrame, asked: DataFrame, acts: bool) -> DataFrame:
    """Bookings with ``_by``, the first permitted request (booking_ref, _ask, _who) of a live one.

    The owner's match stands in a coalesce: a plain equality would be one more
    key of the join, and both sides would be exchanged again for it.
    """
    anyone = asked.groupBy(F.col("booking_ref").alias("_fref")).agg(
        F.min(F.when(F.col("_who").isNull(), F.col("_ask"))).alias("_any"))
    marked = bookings.join(anyone, bookings.booking_ref == anyone["_fref"], "left").drop("_fref")
    first = F.col("_any")
    if acts:
        own = asked.groupBy(F.col("booking_ref").alias("_oref"), F.col("_who").alias("_owner")).agg(
            F.min("_ask").alias("_own"))
        mine = F.coalesce(F.col("_owner.actor_id") == F.col("user_id"), F.lit(False))
        marked = marked.join(own, (marked.booking_ref == own["_oref"]) & mine, "left").drop("_oref", "_owner")
        first = F.least(F.col("_any"), F.col("_own"))
    live = ~F.col("booking_status").isin("cancelled", "completed")
    return marked.withColumn("_by", F.when(live, first)).drop("_any", "_own")


# SNK13
def delete_by_key(df: DataFrame, keys_df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _key_join(df, keys_df.select(*keys).distinct(), keys, "left_anti")


def purge_expired(tokens: DataFrame, as_of_ts) -> DataFrame:
    return tokens.where(F.col("expires_at") > X.ntz(as_of_ts))


class UserCreation(NamedTuple):
    users: DataFrame
    permissions: DataFrame
    outcomes: DataFrame


# SNK1 (users) + DQ9: create users with a permission row; e-mail must be new.
def create_users(users: DataFrame, permissions: DataFrame, rows: DataFrame,
                 order: Sequence[Column | str] = ("ts",)) -> UserCreation:
    """rows: email, first_name, last_name, role, [status], can_* booleans, ts.

    An e-mail already registered (or taken by an earlier row of the batch)
    is rejected with 'email_exists'; created users get verified = 0,
    auth_method 'email', status default 'active', an id derived from the
    e-mail, and one permission row with the flags as 0/1.
    """
    rows = rows.withColumn("email", X.normalize_email("email"))
    ins = insert_ignore(users.select("email"), rows, ["email"], order)
    outcomes = ins.outcomes.select(
        "email", F.when(F.col("outcome") == "inserted", "created").otherwise("email_exists")
        .alias("outcome"))
    new = ins.outcomes.where(F.col("outcome") == "inserted")
    new_id = F.abs(F.xxhash64(F.lit("user"), F.col("email")))
    status = F.coalesce(F.col("status"), F.lit("active")) if "status" in rows.columns \
        else F.lit("active")
    new_users = new.select(new_id.alias("id"), "email", "first_name", "last_name",
                           F.lit(None).cast("string").alias("phone"),
                           F.lit(None).cast("string").alias("national_id"), "role",
                           status.alias("status"), F.lit(0).alias("verified"),
                           F.lit(X.PASSWORD_AUTH_METHOD).alias("auth_method"))
    users2 = _with_new(users, new_users)
    perm_new = new.select(new_id.alias("user_id"),
                          *[X.flag01(F.col(f) if f in rows.columns else F.lit(False)).alias(f)
                            for f in _flags(permissions)])
    perms2 = permissions.unionByName(perm_new, allowMissingColumns=True)
    return UserCreation(users2, perms2, outcomes)
