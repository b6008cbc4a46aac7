"""op11 against fractions, numpy's eigenvectors and a plain formulation."""

from collections import defaultdict
from fractions import Fraction
from math import floor, isfinite

import numpy as np
import pytest

from tests.conftest import SF_SMALL
from trackyard.llm import op11_whitening as white


def plain(rows):
    """vec_id -> (deviation, coordinates up to sign) with numpy's eigenvectors; n; eigenvalues; trace."""
    left = [(i, [floor(256 * float(np.float32(c)) if isinstance(c, float) else c) for c in v]) for i, v in rows
            if v is not None and all(c is not None and isfinite(c) for c in v)]
    d = max(len(v) for _, v in left)
    left = [(i, v + [0] * (d - len(v))) for i, v in left]
    fit = sorted({tuple(v) for _, v in left})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    x = np.array(fit, float)
    e, q = np.linalg.eigh(np.cov(x.T, bias=True).reshape(d, d))
    e, q = e[::-1], q[:, ::-1]
    k = min(4, int((e > 1e-9 * e[0]).sum()))
    out = [(i, sum((n * c - s) ** 2 for c, s in zip(v, sums)),
            (np.array(v) - np.array(sums) / n) @ q[:, :k] / np.sqrt(e[:k])) for i, v in left]
    return out, n, e, k


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows],
                                 "vec_id long, embedding array<float>, label int, x string, component string").repartition(5)


def compare(spark, rows):
    want, n, e, k = plain(rows)
    got = white.whiten(table(spark, rows)).collect()
    assert len(got) == k * len(want)
    assert {(r.n, r.component) for r in got} == {(n, c) for c in range(1, k + 1)}
    for r in got:
        assert r.explained == pytest.approx(e[r.component - 1] / e.sum(), rel=1e-9)
        assert r.eigenvalue == pytest.approx(e[r.component - 1], rel=1e-9)
        assert 0 <= r.identity_error < 1e-9
    mine = defaultdict(lambda: [0.0] * k)
    seen = defaultdict(list)
    for r in got:
        mine[r.vec_id][r.component - 1] = r.whitened
        seen[r.vec_id].append(int(r.deviation))
    theirs = {i: w for i, _, w in want}
    ids = sorted((i for i in theirs if i is not None))
    a, b = np.array([mine[i] for i in ids]), np.array([theirs[i] for i in ids])
    sign = np.sign((a * b).sum(0))
    assert np.abs(a - b * sign).max() < 1e-7
    dev = defaultdict(list)
    for i, v, _ in want:
        dev[i] += [v] * k
    assert {i: sorted(v) for i, v in seen.items()} == {i: sorted(v) for i, v in dev.items()}


def test_whole_small_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    compare(spark, rows)


def test_hard_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=6) * [5, 3, 2, 1.5, 1, .5]]) for i in range(60)]
    rows += [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (102, [float("nan")] * 6), (103, [float("inf")] * 6),
             (104, rows[0][1]), (104, rows[0][1]), (None, rows[1][1]), (105, [0.5, -0.25]), (106, []), (107, [-0.0] * 6),
             (108, [0.5, -0.25, 0.0, 0.0, 0.0, 0.0])]
    compare(spark, rows)


def test_rank_is_exact(spark):
    """Constant and dependent dimensions give no further components."""
    rows = [(i, [float(i), 2.0 * i, 7.0, float(i * i)]) for i in range(20)]
    compare(spark, rows)
    got = white.whiten(table(spark, rows)).collect()
    assert {r.component for r in got} == {1, 2}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]])
def test_no_components(spark, rows):
    df = white.whiten(table(spark, rows))
    assert df.columns[:3] == ["vec_id", "component", "n"] and df.count() == 0


def test_equal_eigenvalues(spark):
    """A cross of unit vectors has one eigenvalue of multiplicity three; any orthonormal basis will do."""
    rows = [(2 * i + s, [float((1 - 2 * s) * (i == j)) for j in range(3)]) for i in range(3) for s in range(2)]
    got = white.whiten(table(spark, rows)).collect()
    assert len(got) == 18 and all(r.identity_error < 1e-12 and r.explained == pytest.approx(1 / 3) for r in got)
    w = np.zeros((6, 3))
    for r in got:
        w[r.vec_id, r.component - 1] = r.whitened
    assert np.abs(w.T @ w / 6 - np.eye(3)).max() < 1e-12


def test_huge_entries(spark):
    """Entries whose sums leave 64 bits, and entries beyond a long, stay exact."""
    rows = [(0, [1e30, 1.0]), (1, [-1e30, 2.0]), (2, [3e15, 3.0]), (3, [0.0, 5.5])]
    x = [[white.LONG.max, 256], [white.LONG.min, 512], [256 * int(np.float32(3e15)), 768], [0, 1408]]
    sums = [sum(c) for c in zip(*x)]
    want = {i: sum((4 * c - s) ** 2 for c, s in zip(v, sums)) for i, v in enumerate(x)}
    g = white.exact_sums(white.vectors(table(spark, rows)).select("x"))
    assert g[0] == [4, *sums] and g[1][1] == sum(v[0] ** 2 for v in x) and g[1][2] == sum(v[0] * v[1] for v in x)
    got = white.whiten(table(spark, rows)).collect()
    assert all(r.deviation is None if want[r.vec_id] >= 10 ** 38 else int(r.deviation) == want[r.vec_id] for r in got)
    assert all(r.identity_error < 1e-6 for r in got)


def faddeev(m):
    """Coefficients of det(t I - m), lowest first, in fractions."""
    d = len(m)
    coeffs, work = [Fraction(1)], [[Fraction(0)] * d for _ in range(d)]
    for k in range(1, d + 1):
        work = [[sum(m[i][l] * work[l][j] for l in range(d)) + (coeffs[-1] if i == j else 0) for j in range(d)] for i in range(d)]
        am = [[sum(m[i][l] * work[l][j] for l in range(d)) for j in range(d)] for i in range(d)]
        coeffs.append(-sum(am[i][i] for i in range(d)) / k)
    return [int(c) for c in coeffs[::-1]]


@pytest.mark.parametrize("d,rank,seed", [(1, 1, 0), (2, 2, 1), (5, 5, 2), (7, 4, 3), (9, 9, 4), (6, 1, 5)])
def test_polynomial(spark, d, rank, seed):
    rng = np.random.default_rng(seed)
    b = rng.integers(-50, 50, (rank, d)).astype(object)
    m = (b.T @ b).tolist()
    poly = white.polynomial(spark, m)
    assert poly == faddeev(m)
    assert max(map(abs, poly)) <= white.coefficient_bound(m)
    for p in (2147483647, 7):                          # a small prime meets vanishing pivots
        assert white.polynomial_mod(np.array([[v % p for v in r] for r in m], np.int64), p).tolist() == [c % p for c in poly]


def test_polynomial_of_sparse_matrices():
    """Zero columns and blocks: pivots must be searched, blocks end early."""
    for m in ([[0, 0, 1], [0, 2, 0], [1, 0, 0]], [[2, 0, 0, 1], [0, 3, 0, 0], [0, 0, 4, 0], [1, 0, 0, 5]], [[0] * 4] * 4):
        got = white.polynomial_mod(np.array(m, np.int64), 101).tolist()
        assert got == [c % 101 for c in faddeev(m)]


def test_roots():
    """(t-3)^2 (t-5) t^2 (t-1): counts with multiplicity, zeros left out."""
    poly = [1]
    for r in (3, 3, 5, 0, 0, 1):
        poly = [(poly[k - 1] if k else 0) - r * (poly[k] if k < len(poly) else 0) for k in range(len(poly) + 1)]
    assert [white.roots_above(poly[2:], a) for a in (0, 1, 2, 3, 4, 5)] == [4, 3, 3, 1, 1, 0]
    found = white.top_roots(poly, 6, 40)
    assert [r.count for r in found] == [1, 2, 1]
    assert [round(float(r.value), 9) for r in found] == [5, 3, 1]
    assert [r.count for r in white.top_roots(poly, 1, 40)] == [1]


def test_close_roots_are_told_apart():
    big = 10 ** 12
    m = [[big, 1], [1, big]]
    found = white.top_roots(faddeev(m), 2)
    assert [r.count for r in found] == [1, 1]
    v = [[float(e) for e in white.null_space(m, r)[0]] for r in found]
    assert v[0] == pytest.approx([2 ** -.5] * 2, abs=1e-15) and abs(v[1][0] + v[1][1]) < 1e-15


def test_packing_round_trip():
    rows = [np.array(v, np.int64) for v in ([], [0, 0], [1, -128, 0], [300, 0, -5], [1 << 40], [white.LONG.min, white.LONG.max])]
    ends = np.cumsum([len(r) for r in rows])
    packed = white.pack(np.concatenate(rows), ends - [len(r) for r in rows], ends)
    assert packed[0] == packed[1] and len(packed[2]) == 3
    assert white.unpack(packed, 3).tolist() == [[*r, *[0] * (3 - len(r))] for r in rows]
    assert white.to_integers(np.array([1e300, -1e300, 2.0 ** 54, -0.001, -0.0])).tolist() == \
        [white.LONG.max, white.LONG.min, 2 ** 62, -1, 0]


def test_gram_in_limbs():
    rng = np.random.default_rng(1)
    x = rng.integers(white.LONG.min, white.LONG.max, (1100, 3))
    assert (white.gram(x) == x.astype(object).T @ x.astype(object)).all()


def test_primes():
    got = white.primes(50)
    assert got[0] == 2 ** 31 - 1 and len(set(got)) == 50 and all(pow(2, p - 1, p) == 1 for p in got)
