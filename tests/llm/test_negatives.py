"""op12 against all scores of all anchors, and its bounds against exact scores."""

from math import floor, isfinite

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from trackyard.llm import op12_negatives as neg


def plain(rows, anchor, positives=5, negatives=5, lowest=80):
    """Every row (id, vector, label) against every other."""
    left = []
    for i, v, label in rows:
        if v is None or label is None or any(c is None or not isfinite(c) for c in v):
            continue
        x = [max(neg.LONG.min, min(neg.LONG.max, floor(256 * float(np.float32(c))))) for c in v]
        left.append((i, x, label))
    out = []

    def first(found, k):
        return sorted(found, key=lambda f: (-f[0], f[1] is None, f[1] or 0))[:k]

    def clip(s):
        return max(neg.LONG.min, min(neg.LONG.max, s))

    for at, (i, x, label) in enumerate(left):
        if i is None or not anchor(i):
            continue
        scored = [(sum(int(p) * int(q) for p, q in zip(x, y)), j, other) for k, (j, y, other) in enumerate(left) if k != at]
        for p, j, _ in first([f for f in scored if f[2] == label], positives):
            window = [f for f in scored if f[2] != label and lowest * p <= 100 * f[0] <= 100 * p]
            out += [(i, j, r + 1, f[1], clip(p), clip(f[0])) for r, f in enumerate(first(window, negatives))]
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, y, 1, "s", b"x") for i, v, y in rows],
                                 "vec_id long, embedding array<float>, label int, rid int, score string, x binary").repartition(5)


def compare(spark, rows, every=100, **more):
    got = neg.mine(table(spark, rows), F.col("vec_id") % every == 0, **more)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    mine = sorted(map(str, map(tuple, got.collect())))
    assert mine == sorted(str(r) for r in plain(rows, lambda i: i % every == 0, **more))
    return mine


@pytest.fixture(scope="module")
def small(spark):
    return [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]


def test_whole_small_table(spark, small):
    assert len(compare(spark, small)) > 50


def test_other_numbers(spark, small):
    compare(spark, small, every=37, positives=2, negatives=9, lowest=50)


def test_hard_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=4)], int(i % 3)) for i in range(120)]
    rows += [(i, [1.0, 0.5, 0.0, 0.0], i % 2) for i in range(200, 240)]                    # ties
    rows += [(300, None, 1), (301, [1.0] * 4, None), (302, [None, 1.0], 1), (303, [float("nan")] * 4, 0),
             (304, [float("inf"), 0.0, 0.0, 0.0], 1), (None, [1.0, 0.5, 0.0, 0.0], 1), (None, [1.0, 0.4, 0.0, 0.0], 0),
             (20, rows[20][1], 2), (20, rows[20][1], 2), (20, rows[20][1], 1), (305, [], 1), (306, [2.0], 0),
             (310, [0.0] * 4, 1), (311, [0.0] * 4, 0), (312, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], 1), (-20, [0.1] * 4, -5)]
    compare(spark, rows, every=10)


def test_groups_of_anchors(spark, small, monkeypatch):
    monkeypatch.setattr(neg, "GROUP", 3)
    compare(spark, small, every=50)


def test_hot_label_and_vector(spark):
    """A third of the rows share one label, another third one vector."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=3)], 0 if i % 3 == 0 else i % 17) for i in range(900)]
    rows = [(i, [0.5, 0.25, -1.0] if i % 3 == 1 else v, y) for i, v, y in rows]
    compare(spark, rows, every=60)


def test_huge_entries(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(c * 10.0 ** (i % 25))) for c in rng.normal(size=3)], i % 2) for i in range(60)]
    compare(spark, rows, every=5)


@pytest.mark.parametrize("rows", [[], [(1, [1.0], 0)], [(100, [1.0], 0)], [(100, None, 0)], [(100, [1.0], 0), (1, [1.0], 0)]])
def test_no_result(spark, rows):
    assert compare(spark, rows) == []


vector = st.lists(st.integers(-300, 300), min_size=3, max_size=3)


@settings(max_examples=300, deadline=None)
@given(st.lists(vector, min_size=1, max_size=6), st.lists(vector, min_size=1, max_size=12),
       st.lists(vector.filter(any), max_size=4))
def test_bounds_hold(a, b, refs):
    """No exact score lies outside its block's bounds, whatever the references."""
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    refs = np.array(refs, float).reshape(-1, 3)
    refs = refs / np.linalg.norm(refs, axis=1, keepdims=True)
    t, n = neg.angles(b, refs), neg.norms(b)
    low, high = neg.block_bounds(neg.angles(a, refs), neg.norms(a), t.min(0), t.max(0), n.min(), n.max())
    exact = a @ b.T
    assert (exact.min(1) >= low).all() and (exact.max(1) <= high).all()


def test_bounds_prune():
    """Blocks in other directions are not scored."""
    refs = np.eye(2)
    b = np.array([[100, 1], [90, 2]])
    t, n = neg.angles(b, refs), neg.norms(b)
    low, high = neg.block_bounds(neg.angles(np.array([[0, 50], [50, 0]]), refs), np.array([50.0, 50.0]), t.min(0), t.max(0),
                                 n.min(), n.max())
    assert high[0] < 200 and low[1] > 4000


def test_exact_products():
    big = np.array([[neg.LONG.max, 3], [neg.LONG.min, -1]])
    assert neg.dots(big, big).tolist() == (big.astype(object) @ big.astype(object).T).tolist()
    mid = np.array([[1 << 30, 5], [-(1 << 30), 7]])
    assert neg.dots(mid, mid).dtype == np.int64 and neg.dots(mid, mid)[0, 1] == -(1 << 60) + 35
