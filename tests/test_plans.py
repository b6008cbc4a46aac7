"""Plan-shape guards for every registered batch query (cluster shape)."""

import contextlib
import io
import re

import pytest

from conftest import SF_SMALL
from trackyard.plans.registry import load_all

QUERIES = {n: q.build for n, q in load_all().items()}
BATCH = sorted(n for n in QUERIES if not n.startswith("stream_"))
# windows are allowed only where they run on salted, pre-pruned candidate sets
WINDOWED = {"recent_bookings", "seat_admission", "seat_admission_counts",
            "schedules_after_admission", "new_booking_codes", "bookings_after_admission"}


@pytest.fixture(scope="module")
def no_broadcast(spark):
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold",
                                                "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    for k in old:
        spark.conf.set(k, "-1")
    yield spark
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


@pytest.mark.parametrize("name", BATCH)
def test_plan_shape(no_broadcast, name):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        QUERIES[name](no_broadcast, SF_SMALL).explain()
    plan = buf.getvalue()
    assert not re.search(r"NestedLoop|Cartesian|EvalPython|FlatMapGroupsInPandas", plan)
    if name not in WINDOWED:
        assert "Window [" not in plan
