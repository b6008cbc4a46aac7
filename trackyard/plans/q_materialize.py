"""Registered materialisation queries (MAT1-MAT3)."""

import datetime as dt

from pyspark.sql import functions as F

from trackyard.functions import expr as X
from trackyard.operators import materialize as MT
from trackyard.plans.q_mutate import _CANCEL_REQ, _cancel, _new_trips, _patch
from trackyard.operators import mutate as MU
from trackyard.plans.registry import query
from trackyard.session import scratch_path
from trackyard.sources.requests import AS_OF_TS
from trackyard.sources.tables import AS_OF

SNAPSHOT_AT = dt.datetime(1998, 6, 15, 12, 0, 0)


@query("revenue_daily", """
, made AS (SELECT CAST(created_at AS DATE) AS report_date,
                  SUM(CASE WHEN payment_status = 'paid' THEN amount_paid END) AS rev, COUNT(*) AS n
           FROM bookings GROUP BY 1),
canc AS (SELECT CAST(cancelled_at AS DATE) AS report_date, COUNT(*) AS c,
                SUM(CASE WHEN payment_status = 'refunded' THEN amount_paid END) AS ref
         FROM bookings WHERE booking_status = 'cancelled' GROUP BY 1)
SELECT COALESCE(made.report_date, canc.report_date) AS report_date,
       CAST(COALESCE(rev, 0) AS DOUBLE) AS total_revenue, COALESCE(n, 0) AS total_bookings,
       COALESCE(c, 0) AS cancelled, CAST(COALESCE(ref, 0) AS DOUBLE) AS refunded
FROM made FULL OUTER JOIN canc ON made.report_date = canc.report_date
""")
def revenue_daily(t):
    """MAT1: daily revenue, bookings, cancellations and refunds."""
    return MT.revenue_daily(t.bookings)


@query("revenue_daily_refresh", _CANCEL_REQ + """
, done AS (SELECT DISTINCT booking_ref, ts FROM res WHERE outcome = 'cancelled'),
b AS (SELECT bookings.created_at::DATE AS made, coalesce(done.ts, bookings.cancelled_at)::DATE AS gone, amount_paid,
             payment_status = 'paid' AND done.booking_ref IS NULL AS paid,
             booking_status = 'cancelled' OR done.booking_ref IS NOT NULL AS cancelled,
             payment_status = 'refunded' OR done.booking_ref IS NOT NULL AS refunded
      FROM bookings LEFT JOIN done USING (booking_ref)),
days AS (SELECT made AS report_date, (sum(amount_paid) FILTER (paid))::DECIMAL(18,2) AS rev, count(*) AS n, 0 AS c, 0::DECIMAL(18,2) AS ref FROM b GROUP BY ALL
         UNION ALL
         SELECT gone, 0::DECIMAL(18,2), 0, count(*), (sum(amount_paid) FILTER (refunded))::DECIMAL(18,2) FROM b WHERE cancelled AND gone IS NOT NULL GROUP BY ALL),
fresh AS (SELECT report_date, sum(rev) AS rev, sum(n) AS n, sum(c) AS c, sum(ref) AS ref FROM days GROUP BY report_date),
stored AS (SELECT created_at::DATE AS report_date, sum(amount_paid) FILTER (payment_status = 'paid') AS rev, count(*) AS n, 0 AS c,
                  0::DECIMAL(18,2) AS ref FROM bookings GROUP BY ALL
           UNION ALL
           SELECT cancelled_at::DATE, 0::DECIMAL(18,2), 0, count(*), sum(amount_paid) FILTER (payment_status = 'refunded')
           FROM bookings WHERE booking_status = 'cancelled' GROUP BY ALL),
old AS (SELECT report_date, sum(rev) AS rev, sum(n) AS n, sum(c) AS c, sum(ref) AS ref FROM stored GROUP BY report_date),
chosen AS (SELECT * FROM old WHERE report_date < DATE '1998-06-15'
           UNION ALL SELECT * FROM fresh WHERE report_date >= DATE '1998-06-15')
SELECT report_date, CAST(coalesce(rev, 0) AS DOUBLE) AS total_revenue, CAST(n AS BIGINT) AS total_bookings,
       CAST(c AS BIGINT) AS cancelled, CAST(coalesce(ref, 0) AS DOUBLE) AS refunded
FROM chosen
""")
def revenue_daily_refresh(t):
    """MAT1 refresh: the table of the stored bookings, refreshed for the days from 1998-06-15 on
    after the cancel requests were applied; cancellations count on their own day."""
    after = _cancel(t).table
    day = F.to_date("created_at").alias("report_date")
    days = after.select(day).unionByName(after.select(F.to_date("cancelled_at").alias("report_date")))
    days = days.where(F.col("report_date") >= F.lit(AS_OF))
    return MT.refresh_revenue_daily(MT.revenue_daily(t.bookings), after, days)


@query("revenue_daily_deltas", _CANCEL_REQ + """
, b AS (SELECT bookings.*, done.ts AS gone FROM bookings
        LEFT JOIN (SELECT DISTINCT booking_ref, ts FROM res WHERE outcome = 'cancelled') done USING (booking_ref)),
cells AS (
  SELECT CAST(created_at AS DATE) AS report_date, if(payment_status = 'paid' AND gone IS NULL, amount_paid, 0) AS rev, 1 AS n, 0 AS c, 0::DECIMAL(18,2) AS ref FROM b
  UNION ALL
  SELECT CAST(coalesce(gone, cancelled_at) AS DATE), 0::DECIMAL(18,2), 0, 1, if(payment_status = 'refunded' OR gone IS NOT NULL, amount_paid, 0)
  FROM b WHERE booking_status = 'cancelled' OR gone IS NOT NULL)
SELECT report_date, CAST(sum(rev) AS DOUBLE) AS total_revenue, CAST(sum(n) AS BIGINT) AS total_bookings,
       CAST(sum(c) AS BIGINT) AS cancelled, CAST(sum(ref) AS DOUBLE) AS refunded
FROM cells GROUP BY report_date
""")
def revenue_daily_deltas(t):
    """MAT1 by deltas: the table of the bookings made before 1998-06-15, kept up by the bookings made
    since and by the cancellations (old and new row of each), without reading the bookings again."""
    history, later = t.bookings.where(F.col("created_at") < X.ntz(AS_OF_TS)), t.bookings.where(F.col("created_at") >= X.ntz(AS_OF_TS))
    done = _cancel(t)
    changed = done.outcomes.where("outcome = 'cancelled'").select("booking_ref")
    before, after = (df.join(changed, "booking_ref", "left_semi") for df in (t.bookings, done.table))
    stored = MT.revenue_daily_deltas(MT.revenue_daily(history), MT.booking_changes(None, later))
    return MT.revenue_daily_deltas(stored, MT.booking_changes(before, after))


@query("occupancy_snapshot", """
, per AS (SELECT schedule_id, COUNT(CASE WHEN booking_status IN ('confirmed', 'completed') THEN 1 END) AS o,
                 COUNT(CASE WHEN booking_status = 'pending' THEN 1 END) AS r FROM bookings GROUP BY 1)
SELECT s.id AS schedule_id, TIMESTAMP '1998-06-15 12:00:00' AS snapshot_time, s.total_seats,
       CAST(COALESCE(o, 0) AS INT) AS occupied, CAST(COALESCE(r, 0) AS INT) AS reserved,
       CAST(GREATEST(s.total_seats - COALESCE(o, 0) - COALESCE(r, 0), 0) AS INT) AS available,
       CAST(ROUND(CAST(COALESCE(o, 0) AS DECIMAL(20,4)) / NULLIF(s.total_seats, 0) * 100, 2) AS DOUBLE) AS occupancy_pct
FROM schedules s LEFT JOIN per ON per.schedule_id = s.id
""")
def occupancy_snapshot(t):
    """MAT2: occupancy snapshot of every trip at a given time."""
    return MT.occupancy_snapshot(t.schedules, t.bookings, SNAPSHOT_AT)


_AUDIT_SQL = """
, p AS (
  SELECT event_id // 2 AS id,
         CASE WHEN event_type = 'error' THEN 'cancelled' WHEN event_type = 'purchase' THEN 'active' ELSE '' END AS status,
         CAST(CASE WHEN event_type = 'view' THEN 0 END AS INT) AS total_seats,
         CASE WHEN event_type IN ('click', 'error') THEN CAST(floor(value) AS INT) END AS delay_minutes,
         event_type IN ('click', 'error') AS has_delay_minutes, ts, event_id
  FROM events
), ls AS (SELECT id, status FROM (SELECT id, status, row_number() OVER (PARTITION BY id ORDER BY ts DESC, event_id DESC) rn
                                  FROM p WHERE status IS NOT NULL AND status <> '') WHERE rn = 1),
ld AS (SELECT id, delay_minutes FROM (SELECT id, delay_minutes, row_number() OVER (PARTITION BY id ORDER BY ts DESC, event_id DESC) rn
                                      FROM p WHERE has_delay_minutes) WHERE rn = 1),
patched AS (SELECT s.id, COALESCE(ls.status, s.status) AS status,
                   CASE WHEN ld.id IS NOT NULL THEN ld.delay_minutes ELSE s.delay_minutes END AS delay_minutes, s.status AS old_status,
                   s.delay_minutes AS old_delay
            FROM schedules s LEFT JOIN ls ON ls.id = s.id LEFT JOIN ld ON ld.id = s.id),
upd AS (SELECT id, 'schedules' AS entity_type, 'updated' AS action,
               concat_ws(',', CASE WHEN status IS DISTINCT FROM old_status THEN 'status' END,
                              CASE WHEN delay_minutes IS DISTINCT FROM old_delay THEN 'delay_minutes' END) AS changed_columns,
               {'status': old_status, 'delay_minutes': old_delay}::JSON::VARCHAR AS old_value,
               {'status': status, 'delay_minutes': delay_minutes}::JSON::VARCHAR AS new_value
        FROM patched WHERE status IS DISTINCT FROM old_status OR delay_minutes IS DISTINCT FROM old_delay),
ins AS (SELECT 1000000 + event_id AS id, 'schedules' AS entity_type, 'inserted' AS action, CAST(NULL AS VARCHAR) AS changed_columns,
               CAST(NULL AS VARCHAR) AS old_value, {'status': 'scheduled', 'delay_minutes': 0}::JSON::VARCHAR AS new_value
        FROM events e WHERE event_type = 'signup' AND EXISTS (SELECT 1 FROM routes r WHERE r.id = e.user_id AND r.active = 1)),
del AS (SELECT id, 'schedules' AS entity_type, 'deleted' AS action, CAST(NULL AS VARCHAR) AS changed_columns,
               {'status': status, 'delay_minutes': delay_minutes}::JSON::VARCHAR AS old_value, CAST(NULL AS VARCHAR) AS new_value
        FROM schedules s WHERE NOT EXISTS (SELECT 1 FROM bookings b WHERE b.schedule_id = s.id))
SELECT * FROM upd WHERE id NOT IN (SELECT id FROM del)
UNION ALL SELECT * FROM ins UNION ALL SELECT * FROM del
"""


def _audited(t):
    """The schedules before and after patches, appended trips and guarded deletes."""
    cols = ["id", "status", "delay_minutes"]
    patched = _patch(t).table
    appended = MU.append_schedules(patched, t.routes, _new_trips(t)).table
    new = MU.delete_schedules(appended, t.bookings, t.schedules.select("id")).table
    return t.schedules.select(*cols), new.select(*cols)


@query("audit_schedules", _AUDIT_SQL)
def audit_schedules(t):
    """MAT3/SC21: audit rows, with old and new values as JSON, between the schedules
    table and its state after patches, appended trips and guarded deletes."""
    return MT.audit_diff(*_audited(t), ["id"], "schedules")


@query("audit_schedules_digests", _AUDIT_SQL)
def audit_schedules_digests(t):
    """MAT3: the same audit of two stored snapshots, joined only where their digests differ."""
    old, new = _audited(t)
    path = scratch_path(t.spark, "schedules_after")
    new.write.parquet(path)
    return MT.audit_diff_stored(old, t.spark.read.parquet(path), ["id"], "schedules")
