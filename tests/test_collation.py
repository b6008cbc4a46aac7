"""Text compared without case, accents and trailing blanks; audits by digests."""

import random

from trackyard.operators import collation as CO
from trackyard.operators import materialize as MT
from trackyard.session import scratch_path


def test_pairs_meet_everywhere(spark):
    left = spark.createDataFrame([(1, "José"), (2, "JOSE  "), (3, "Josef"), (4, None), (5, " jose")], "id int, name string")
    right = spark.createDataFrame([("jose", 7), ("ÉVA ", 8)], "name string, n int")
    assert [(r.id, r.n) for r in CO.text_join(left, right, "name", "inner").orderBy("id").collect()] == [(1, 7), (2, 7)]
    assert [r.id for r in CO.text_join(left, right, "name", "left_anti").orderBy("id").collect()] == [3, 4, 5]
    assert CO.text_join(left, right, "name", "left_semi").columns == ["id", "name"]
    assert [r.id for r in CO.search_text(left, ["name"], "OSÉ").orderBy("id").collect()] == [1, 2, 3, 5]
    assert CO.search_text(left, ["name"], "").count() == 5
    dup = CO.duplicate_texts(left, "users", ["name"]).collect()
    assert [(r.column_name, r.rows) for r in dup] == [("name", 2)] and dup[0].value in ("José", "JOSE  ")
    got = CO.insert_ignore_text(right, left, "name", ["id"]).orderBy("id").collect()
    assert [r.outcome for r in got] == ["ignored", "ignored", "inserted", "inserted", "inserted"]
    assert [r.id for r in CO.match_text(left, "name", "name", "jose").orderBy("id").collect()] == [1, 2, 3, 5]


def _rows(rnd, n):
    return {i: (i, rnd.choice(["a", "b", None]), rnd.choice([1, 2, None])) for i in range(n)}


def test_audit_by_digests_equals_the_join(spark):
    rnd = random.Random(8)
    old = _rows(rnd, 300)
    new = {i: r for i, r in old.items() if i % 50}
    for i in rnd.sample(sorted(new), 9):
        new[i] = (i, new[i][2] and "c", new[i][2])
    new[7] = (7, None, 1)
    old[7] = (7, "1", None)
    new |= {i: (i, "x", 0) for i in range(400, 405)}
    schema = "id int, name string, n int"
    frames = []
    for rows in (old, new):
        path = scratch_path(spark, "digests")
        spark.createDataFrame(list(rows.values()), schema).write.parquet(path)
        frames.append(spark.read.parquet(path))
    want = sorted(map(str, MT.audit_diff(*frames, ["id"], "t").collect()))
    assert len(want) > 10
    for buckets in (1, 64, 65_536):
        assert sorted(map(str, MT.audit_diff_stored(*frames, ["id"], "t", buckets).collect())) == want
    assert MT.audit_diff_stored(frames[0], frames[0].repartition(3), ["id"], "t").isEmpty()


def test_digests_see_nulls_that_change_places(spark):
    a = spark.createDataFrame([(1, None, "x")], "id int, p string, q string")
    b = spark.createDataFrame([(1, "x", None)], "id int, p string, q string")
    assert MT.audit_diff_stored(a, b, ["id"], "t").count() == 1


def test_inserted_texts_by_one_collated_join(spark):
    rows = spark.createDataFrame([(1, "Ana"), (2, "ANA "), (3, "bob"), (4, None), (5, None), (6, "B\u00f3b"), (6, "BOB"),
                                  (3, "BOB "), (7, "zo\u00eb"), (9, "eva"), (8, "EVA")], "id int, name string")
    target = spark.createDataFrame([("ZOE ",), ("ZOE ",), (None,)], "name string")
    found = CO.insert_ignore_text(target, rows, "name", ["id"])
    won = sorted((r.id, r.name or "") for r in found.collect() if r.outcome == "inserted")
    assert won == [(1, "Ana"), (3, "BOB "), (3, "bob"), (4, ""), (5, ""), (8, "EVA")] and found.count() == rows.count()
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
