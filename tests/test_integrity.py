"""Deletes over a foreign-key graph against a row-by-row model."""

import random

import pytest

from trackyard.operators.integrity import delete_rows, parents_first

FKS = (("b", "a1", "a", "id", "cascade"), ("b", "a2", "a", "id", "cascade"), ("c", "b_id", "b", "id", "cascade"),
       ("d", "c_id", "c", "id", "restrict"), ("d", "a_id", "a", "id", "restrict"), ("e", "d_id", "d", "id", "set_null"),
       ("e", "c_id", "c", "id", "restrict"), ("f", "b_id", "b", "id", "cascade"), ("f", "d_id", "d", "id", "set_null"))
SCHEMA = {"a": "id long, v string", "b": "id long, a1 long, a2 long", "c": "id long, b_id long",
          "d": "id long, c_id long, a_id long", "e": "id long, d_id long, c_id long", "f": "b_id long, d_id long, w string"}


def model(tables, requests):
    """The largest set of requests that can go: drop a request whose rows are restricted until none is."""
    def closure(asked):
        gone = set(asked)
        while True:
            more = {(child, r["id"]) for child, col, parent, _, kind in FKS if kind == "cascade" and child != "f"
                    for r in tables[child] if (parent, r[col]) in gone} - gone
            if not more:
                return gone
            gone |= more

    asked = {(t, k) for t, ks in requests.items() for k in ks if any(r["id"] == k for r in tables[t])}
    while True:
        gone = closure(asked)
        held = {(parent, r[col]) for child, col, parent, _, kind in FKS if kind == "restrict"
                for r in tables[child] if r[col] is not None and (child, r["id"]) not in gone}
        bad = {q for q in asked if closure({q}) & held}
        if not bad:
            break
        asked -= bad
    after = {}
    for t, rows in tables.items():
        after[t] = []
        for r in rows:
            cascaded = any(c == t and kind == "cascade" and (p, r[col]) in gone for c, col, p, _, kind in FKS)
            if cascaded or (t, r.get("id")) in gone:
                continue
            nulls = {col: None for c, col, p, _, kind in FKS if c == t and kind == "set_null" and (p, r[col]) in gone}
            after[t].append(tuple((r | nulls).values()))
    return asked, after


def check(spark, tables, requests):
    frames = {t: spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA[t]) for t, rows in tables.items()}
    asked = {t: spark.createDataFrame([(k,) for k in ks], "id long") for t, ks in requests.items()}
    got = delete_rows(frames, asked, FKS)
    done, after = model(tables, requests)
    outcome = {(r.table_name, int(r.key)): r.outcome for r in got.outcomes.collect()}
    stored = {(t, r["id"]) for t in requests for r in tables[t]}
    assert outcome == {(t, k): "deleted" if (t, k) in done else "restricted" if (t, k) in stored else "not_found"
                       for t, ks in requests.items() for k in ks if k is not None}
    for t, rows in after.items():
        assert sorted(map(str, map(tuple, got.tables[t].collect()))) == sorted(map(str, rows)), t
    return got


@pytest.mark.parametrize("seed", range(2))
def test_random_graphs(spark, seed):
    rnd = random.Random(seed)

    def some(n):
        return rnd.choice([None, *range(n)]) if rnd.random() < .9 else n + 50

    size = 14
    tables = {"a": [{"id": i, "v": f"v{i}"} for i in range(size)],
              "b": [{"id": i, "a1": some(size), "a2": some(size)} for i in range(size)],
              "c": [{"id": i, "b_id": some(size)} for i in range(size)],
              "d": [{"id": i, "c_id": some(4 * size), "a_id": some(4 * size)} for i in range(size)],
              "e": [{"id": i, "d_id": some(size), "c_id": some(6 * size)} for i in range(size)],
              "f": [{"b_id": some(size), "d_id": some(size), "w": f"w{i}"} for i in range(size)]}
    requests = {"a": rnd.sample(range(size + 2), 9), "d": rnd.sample(range(size), 5), "e": rnd.sample(range(size), 6),
                "c": [3, 5, 5, None]}
    check(spark, tables, requests)


def test_chain_of_three_and_a_blocked_root(spark):
    """a1 goes with b and c; a2 stays because a row two cascades below it is restricted, and so keeps its whole chain."""
    tables = {"a": [{"id": 1, "v": "x"}, {"id": 2, "v": "y"}],
              "b": [{"id": 10, "a1": 1, "a2": None}, {"id": 20, "a1": 2, "a2": None}],
              "c": [{"id": 100, "b_id": 10}, {"id": 200, "b_id": 20}, {"id": 201, "b_id": 20}],
              "d": [{"id": 1000, "c_id": 201, "a_id": None}], "e": [{"id": 5, "d_id": 1000, "c_id": None}],
              "f": [{"b_id": 10, "d_id": None, "w": "w"}, {"b_id": 20, "d_id": 1000, "w": "w"}]}
    got = check(spark, tables, {"a": [1, 2, 3]})
    assert {(r.table_name, r.column_name, r.effect): r.rows for r in got.effects.collect() if r.rows} == {
        ("a", None, "deleted"): 1, ("a", None, "restricted"): 1, ("b", "a1", "cascade"): 1, ("c", "b_id", "cascade"): 1,
        ("f", "b_id", "cascade"): 1}
    # with the restricting row in the batch too, both chains go; its own child is set to NULL
    got = check(spark, tables, {"a": [1, 2], "d": [1000]})
    assert got.tables["c"].isEmpty() and got.tables["e"].first().d_id is None


def test_a_fallen_request_blocks_others(spark):
    """Undoing a cascade brings back a row that restricts another request: a second pass is needed."""
    tables = {"a": [{"id": 1, "v": "x"}], "b": [{"id": 10, "a1": 1, "a2": None}],
              "c": [{"id": 100, "b_id": 10}, {"id": 101, "b_id": 10}], "d": [{"id": 7, "c_id": 101, "a_id": 1}],
              "e": [{"id": 8, "d_id": 7, "c_id": 100}], "f": []}
    check(spark, tables, {"a": [1], "d": [7]})
    check(spark, tables, {"a": [1], "d": [7], "e": [8]})


def test_order_and_cycles():
    assert parents_first(["f", "e", "d", "c", "b", "a"], FKS)[0] == "a"
    with pytest.raises(ValueError):
        parents_first(["a", "b"], (("a", "x", "b", "id", "cascade"), ("b", "x", "a", "id", "cascade")))


def test_empty_tables(spark):
    tables = {t: [] for t in SCHEMA}
    check(spark, tables, {"a": [1], "d": []})


def test_purged_bookings_are_made_distinct_once(spark):
    from conftest import SF_SMALL
    from trackyard.plans.q_quality import _purge
    from trackyard.sources.tables import rail
    t = rail(spark, SF_SMALL)
    bookings = _purge(t)[0]["bookings"]
    assert "Aggregate" not in bookings._jdf.queryExecution().optimizedPlan().toString()
    assert bookings.count() == t.bookings.select("booking_ref").distinct().count()
