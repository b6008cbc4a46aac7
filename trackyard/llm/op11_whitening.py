"""op11: embedding whitening by the exact characteristic polynomial.

Every component c of a vector becomes the integer x = floor(256 c).  The distinct x vectors
are the fit list: n vectors with sums S and Gram matrix G.  M = n G - S S' is an integer matrix
and n^2 times their covariance, so all of its spectrum is exact integer work:

1. Spark tasks add up the Gram matrix (column 0 is constant 1, which gives n and S) exactly,
   and one aggregation adds the tasks' sums.
2. The characteristic polynomial of M is computed modulo enough 31-bit primes, each prime in a
   Spark task, by reduction to Hessenberg form; Chinese remaindering gives the integer
   coefficients.  Maclaurin's inequality bounds them: e_k <= C(d, k) (trace / d)^k.
3. All roots are real, so Descartes' rule is exact: the polynomial shifted by a has as many sign
   changes as there are roots above a, with multiplicity.  Bisection over such counts isolates
   each wanted root to ``BITS`` bits.
4. Null-space inverse iteration in decimal arithmetic of ``DIGITS`` digits, with the isolated root as shift,
   gives the components; roots that are equal to ``BITS`` bits share an orthonormal basis.
5. One pass projects every row; the identity error is measured on the fit list.

What reaches the driver is bounded by the dimension d, not by the rows: the Gram matrix
(d^2 / 2 entries), about d log2(trace) / 31 polynomials of d + 1 residues, ten sums of the
identity error.  Tasks hold one batch and the Gram matrix.

Hard rows: rows whose vector is NULL or holds NULL or non-finite entries are dropped; repeated
rows and equal vectors count once in the fit list and each get their own rows in the result.
Vectors of different lengths: missing entries count as x = 0.  An x beyond a long is the nearest
long; a deviation beyond a long is a decimal in ``whiten`` and NULL in the query.  Components
with eigenvalue 0 are not returned (one distinct vector, or an empty table: no rows).  Ties:
equal eigenvalues have an arbitrary but fixed basis.  Extra columns do no harm; a NULL vec_id stays NULL.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackyard.llm.common import read, stored
from trackyard.session import tell_workers

SCALE = 256
COMPONENTS = 4
BITS = 128            # bits of an isolated root
DIGITS = 120          # decimal digits of the inverse iteration
LIMB = 40             # bits of a limb of the sums that Spark adds up
LIMBS = 6
EXACT = 1 << 53       # integers below are exact as doubles
LONG = np.iinfo(np.int64)


# ---------------------------------------------------------------- vectors

def to_integers(values: np.ndarray) -> np.ndarray:
    """floor(256 c) as longs; beyond a long: the nearest one."""
    y = np.floor(values.astype(np.float64) * SCALE)
    x = np.clip(y, -2.0 ** 62, 2.0 ** 62).astype(np.int64)
    x[y >= 2.0 ** 63] = LONG.max
    x[y <= -2.0 ** 63] = LONG.min
    between = (np.abs(y) > 2.0 ** 62) & (np.abs(y) < 2.0 ** 63)
    x[between] = [int(v) for v in y[between]]
    return x


def list_values(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values as double, NaN for NULL; offsets from 0; True where the list is there and wholly finite)."""
    offs = np.asarray(column.offsets).astype(np.int64)
    values = column.values.slice(offs[0], offs[-1] - offs[0]).cast(pa.float64())
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64)
    offs = offs - offs[0]
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    ok = (bad[offs[1:]] == bad[offs[:-1]]) & ~np.asarray(column.is_null())
    return flat, offs, ok


def widths(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Bytes (1, 2, 4 or 8) that hold every integer from lo to hi."""
    out = np.full(len(lo), 8)
    for w in (4, 2, 1):
        out[(lo >= -(1 << 8 * w - 1)) & (hi < 1 << 8 * w - 1)] = w
    return out


def pack(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """One byte string per x vector flat[start:end]: a byte with the width, then the entries without zeros at the end.

    Equal vectors (up to zeros at the end) have equal strings, in a quarter of the longs' bytes as a rule.
    """
    out: list[bytes] = [b"\x01"] * len(starts)
    marks = np.concatenate([[0], np.cumsum(flat != 0)])
    filled = np.searchsorted(marks, marks[ends])         # behind the last entry that is not zero
    lengths = np.maximum(filled - starts, 0)
    for d in np.unique(lengths[lengths > 0]):
        which = np.flatnonzero(lengths == d)
        x = flat[starts[which][:, None] + np.arange(d)]
        width = widths(x.min(1), x.max(1))
        for w in np.unique(width):
            some = np.flatnonzero(width == w)
            raw = np.ascontiguousarray(x[some].astype(f"<i{w}")).view(np.uint8).reshape(len(some), -1)
            head = np.full((len(some), 1), w, np.uint8)
            for k, r in zip(which[some], np.hstack([head, raw])):
                out[k] = r.tobytes()
    return out


def unpack(packed: list[bytes], d: int | None = None) -> np.ndarray:
    """Matrix of longs, padded with zeros up to the longest vector or to ``d`` columns."""
    size = np.array([len(p) for p in packed], np.int64)
    width = np.array([p[0] for p in packed], np.int64)
    lengths = (size - 1) // np.maximum(width, 1)
    out = np.zeros((len(packed), max([d or 0, *lengths.tolist()])), np.int64)
    kinds = size * 16 + width
    for kind in np.unique(kinds):
        which = np.flatnonzero(kinds == kind)
        n, w = int(size[which[0]]), int(width[which[0]])
        raw = np.frombuffer(b"".join([packed[k] for k in which]), np.uint8).reshape(-1, n)[:, 1:]
        out[which, :(n - 1) // w] = np.ascontiguousarray(raw).view(f"<i{w}")
    return out


def integer_rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of the rows that remain, all x of the batch, where each remaining row's begin and end)."""
    flat, offs, ok = list_values(batch.column("embedding"))
    keep = np.flatnonzero(ok)
    return keep, to_integers(np.where(np.isfinite(flat), flat, 0.0)), offs[:-1][keep], offs[1:][keep]


def vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows that remain, x packed."""
    tell_workers(embeddings.sparkSession)
    some = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    kind = dict(some.dtypes)["vec_id"]

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            keep, *where = integer_rows(b)
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(keep)), pa.array(pack(*where), pa.binary())],
                                             ["vec_id", "x"])

    return some.mapInArrow(run, f"vec_id {kind}, x binary")


# ---------------------------------------------------------------- 1. Gram matrix

def gram(x: np.ndarray) -> np.ndarray:
    """x' x as Python integers, exactly."""
    top = max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0
    if top * top * len(x) <= EXACT:
        f = x.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    total = np.zeros((x.shape[1],) * 2, object)
    for s in range(0, len(x), 512):                 # limbs of 21 bits: 512 products stay below 2^53
        rest, limbs = x[s:s + 512], []
        for k in range(3):
            limbs.append((rest & 0x1FFFFF if k < 2 else rest).astype(np.float64))
            rest = rest >> 21
        for a, f in enumerate(limbs):
            for b, g in enumerate(limbs):
                total += (f.T @ g).astype(np.int64).astype(object) << 21 * (a + b)
    return total


def limbs(value: int) -> list[int]:
    sign, value = (-1, -value) if value < 0 else (1, value)
    return [sign * (value >> LIMB * k & (1 << LIMB) - 1) for k in range(LIMBS)]


def exact_sums(fit: DataFrame) -> list[list[int]]:
    """Gram matrix of the fit list with a leading constant 1: [0][0] is n, [0][1:] are the sums."""
    names = [f"l{k}" for k in range(LIMBS)]

    def run(batches: Iterator[pa.RecordBatch]):
        total = np.zeros((1, 1), object)
        for b in batches:
            packed = b.column("x").to_pylist()
            for s in range(0, len(packed), 4096):
                x = unpack(packed[s:s + 4096])
                g = gram(np.hstack([np.ones((len(x), 1), np.int64), x]))
                if len(g) > len(total):
                    total, small = np.zeros(g.shape, object), total
                    total[:len(small), :len(small)] += small
                total[:len(g), :len(g)] += g
        i, j = np.triu_indices(len(total))
        parts = np.array([limbs(int(v)) for v in total[i, j]], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
                                          *(pa.array(parts[:, k]) for k in range(LIMBS))], ["i", "j", *names])

    found = (fit.mapInArrow(run, "i int, j int, " + ", ".join(f"{n} long" for n in names))
             .groupBy("i", "j").agg(*[F.sum(n).alias(n) for n in names]).collect())
    d = 1 + max((r.j for r in found), default=0)
    g = [[0] * d for _ in range(d)]
    for r in found:
        g[r.i][r.j] = g[r.j][r.i] = sum(r[n] << LIMB * k for k, n in enumerate(names))
    return g


# ---------------------------------------------------------------- 2. characteristic polynomial

def primes(count: int) -> list[int]:
    """The ``count`` largest primes below 2^31."""
    small = np.ones(46342, bool)
    small[:2] = False
    for p in range(2, 216):
        if small[p]:
            small[p * p::p] = False
    divisors, found, high = np.flatnonzero(small), [], 1 << 31
    while len(found) < count:
        low = high - 65536
        ok = np.ones(65536, bool)
        for p in divisors:
            ok[-low % p::p] = False
        found += [low + int(k) for k in np.flatnonzero(ok)[::-1]]
        high = low
    return found[:count]


def polynomial_mod(m: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(t I - m) modulo the prime p, lowest power first (m: longs in 0..p-1)."""
    h, d = m.copy(), len(m)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1:, k])
        if not len(below):
            continue
        at = k + 1 + below[0]
        if at != k + 1:
            h[[k + 1, at]] = h[[at, k + 1]]
            h[:, [k + 1, at]] = h[:, [at, k + 1]]
        u = h[k + 2:, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2:, k:] = (h[k + 2:, k:] - u[:, None] * h[k + 1, k:] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2:] * u % p).sum(1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)       # polys[k]: of the leading k x k block
    polys[0, 0] = 1
    for k in range(1, d + 1):
        new = np.zeros(d + 1, np.int64)
        new[1:] = polys[k - 1, :-1]
        new = (new - h[k - 1, k - 1] * polys[k - 1]) % p
        below = 1
        for i in range(k - 1, 0, -1):                # product of the subdiagonal from row i to k - 1
            below = below * int(h[i, i - 1]) % p
            if not below:
                break
            new = (new - int(h[i - 1, k - 1]) * below % p * polys[i - 1]) % p
        polys[k] = new
    return polys[d]


def coefficient_bound(m: list[list[int]]) -> int:
    """No coefficient of the polynomial of a positive semidefinite integer matrix is larger."""
    d, trace = len(m), sum(m[i][i] for i in range(len(m)))
    return max(math.comb(d, k) * trace ** k // d ** k + 1 for k in range(d + 1))


def polynomial(spark: SparkSession, m: list[list[int]]) -> list[int]:
    """Integer coefficients of det(t I - m), lowest power first; m is positive semidefinite."""
    d, bound = len(m), 2 * coefficient_bound(m) + 1
    moduli = primes(bound.bit_length() // 30 + 1)
    flat = [str(v) for row in m for v in row]

    def run(batches: Iterator[pa.RecordBatch]):
        entries = np.array([int(v) for v in flat], object).reshape(d, d)
        for b in batches:
            for k in b.column("id").to_pylist():
                p = moduli[k]
                found = polynomial_mod((entries % p).astype(np.int64), p)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([found.tolist()], pa.list_(pa.int64()))],
                                                 ["id", "residues"])

    parts = min(len(moduli), max(1, spark.sparkContext.defaultParallelism))
    rows = spark.range(0, len(moduli), 1, parts).mapInArrow(run, "id long, residues array<long>").collect()
    product = math.prod(moduli)
    out = [0] * (d + 1)
    for r in rows:
        p = moduli[r.id]
        rest = product // p
        lift = rest * pow(rest, -1, p)
        for k, v in enumerate(r.residues):
            out[k] += v * lift
    out = [v % product for v in out]
    return [v - product if 2 * v > product else v for v in out]


# ---------------------------------------------------------------- 3. roots

def roots_above(poly: list[int], a: int) -> int:
    """How many roots exceed the integer a, with multiplicity; all roots must be real."""
    c = list(poly)
    for k in range(len(c) - 1):                       # Taylor shift by Horner's scheme
        for i in range(len(c) - 2, k - 1, -1):
            c[i] += a * c[i + 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:]))


@dataclass
class Root:
    """A root lies in (low, low + 1] / 2^shift, together with ``count`` in all."""
    low: int
    shift: int
    count: int

    @property
    def value(self) -> Fraction:
        """The middle of the interval."""
        return Fraction(2 * self.low + 1, 1 << self.shift + 1)


def top_roots(poly: list[int], wanted: int, bits: int = BITS) -> list[Root]:
    """The largest positive roots, until ``wanted`` are found with multiplicity; each to ``bits`` bits."""
    zeros = next(k for k, v in enumerate(poly) if v)
    poly = poly[zeros:]
    degree, found, have = len(poly) - 1, [], 0
    if degree < 1:
        return []
    top = -poly[-2]                                   # the trace bounds every root
    while have < min(wanted, degree):
        low, high = 0, top                            # roots above low: over have; above high: have at most
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if roots_above(poly, mid) > have else (low, mid)
        shift = max(0, bits - low.bit_length())
        fine = [v << shift * (degree - k) for k, v in enumerate(poly)]
        low, high = low << shift, high << shift
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if roots_above(fine, mid) > have else (low, mid)
        count = roots_above(fine, low) - have
        found.append(Root(low, shift, count))
        have += count
    return found


# ---------------------------------------------------------------- 4. components

def null_space(m: list[list[int]], root: Root) -> list[list[Decimal]]:
    """Orthonormal vectors of the root's eigenspace by block inverse iteration."""
    with decimal.localcontext(decimal.Context(prec=DIGITS, Emax=decimal.MAX_EMAX, Emin=decimal.MIN_EMIN)):
        d, count = len(m), root.count
        shift = Decimal(root.value.numerator) / Decimal(root.value.denominator)
        a = np.array([[Decimal(v) for v in row] for row in m], object)
        for i in range(d):
            a[i, i] -= shift
        rng = np.random.default_rng(11)
        block = np.array([[Decimal(int(v)) for v in row] for row in rng.integers(1, 1000, (d, count))], object)
        order = np.arange(d)
        least = shift.scaleb(-DIGITS + 8)              # stands in for a pivot that vanishes
        for k in range(d):                             # LU with row exchanges
            at = k + max(range(d - k), key=lambda r: abs(a[k + r, k]))
            if at != k:
                a[[k, at]], order[[k, at]] = a[[at, k]], order[[at, k]]
            if abs(a[k, k]) < least:
                a[k, k] = least
            if k + 1 < d:
                a[k + 1:, k] = a[k + 1:, k] / a[k, k]
                a[k + 1:, k + 1:] -= a[k + 1:, k, None] * a[k, k + 1:]
        for _ in range(4):
            x = block[order].copy()
            for k in range(d):
                x[k] -= a[k, :k] @ x[:k] if k else 0
            for k in range(d - 1, -1, -1):
                x[k] = (x[k] - (a[k, k + 1:] @ x[k + 1:] if k + 1 < d else 0)) / a[k, k]
            for c in range(count):                     # Gram-Schmidt, twice
                for _ in range(2):
                    for b in range(c):
                        x[:, c] -= (x[:, b] @ x[:, c]) * x[:, b]
                    x[:, c] = x[:, c] / (x[:, c] @ x[:, c]).sqrt()
            block = x
        out = []
        for c in range(count):
            v = list(block[:, c])
            largest = max(range(d), key=lambda i: (round(abs(v[i]), 12), -i))
            out.append([-e for e in v] if v[largest] < 0 else v)
        return out


@dataclass
class Model:
    """n, sums, and for each component its unit vector (d x k), eigenvalue and share of the trace."""
    n: int
    sums: list[int]
    matrix: list[list[int]]
    vectors: np.ndarray
    eigenvalues: list[float]
    explained: list[float]
    roots: list[float]                                # square roots of the eigenvalues of n^2 V


def fit_model(spark: SparkSession, g: list[list[int]], components: int = COMPONENTS) -> Model:
    """The components of the covariance whose exact sums are g."""
    n, sums, d = g[0][0], g[0][1:], len(g) - 1
    m = [[n * g[i + 1][j + 1] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    trace = sum(m[i][i] for i in range(d))
    model = Model(n, sums, m, np.zeros((d, 0)), [], [], [])
    if not trace:
        return model
    columns: list[list[float]] = []
    for root in top_roots(polynomial(spark, m), components):
        for v in null_space(m, root)[:components - len(columns)]:
            columns.append([float(e) for e in v])
            model.eigenvalues.append(float(root.value / n ** 2))
            model.explained.append(float(root.value / trace))
            with decimal.localcontext(decimal.Context(prec=50)):
                model.roots.append(float((Decimal(root.value.numerator) / Decimal(root.value.denominator)).sqrt()))
    model.vectors = np.array(columns).T.reshape(d, -1)
    return model


# ---------------------------------------------------------------- 5. projection

def deviations(x: np.ndarray, model: Model) -> np.ndarray:
    """n x - S: longs where they fit, else Python integers."""
    top = model.n * max(abs(int(x.min())), abs(int(x.max())), 1) + max(map(abs, model.sums)) if x.size else 0
    if top < 1 << 62:
        return model.n * x - np.array(model.sums, np.int64)
    return model.n * x.astype(object) - np.array(model.sums, object)


def squared(dev: np.ndarray) -> pa.Array:
    """Sum over the dimensions of the squared deviations, as decimal(38,0); beyond that NULL."""
    if dev.dtype != object and dev.size and max(abs(int(dev.min())), abs(int(dev.max()))) ** 2 * dev.shape[1] < 1 << 63:
        return pa.array((dev * dev).sum(1), pa.int64()).cast(pa.decimal128(38, 0))
    wide = dev.astype(object)
    sums = (wide * wide).sum(1) if dev.size else np.zeros(len(dev), object)
    return pa.array([Decimal(int(v)) if int(v) < 10 ** 38 else None for v in sums], pa.decimal128(38, 0))


def scores(dev: np.ndarray, model: Model) -> np.ndarray:
    """Whitened coordinates, one column per component."""
    return dev.astype(np.float64) @ model.vectors / np.array(model.roots)


def identity_error(fit: DataFrame, model: Model) -> float | None:
    """Largest absolute entry of the fit list's whitened covariance minus the identity; None without components.

    Each task merges the centred sums of its batches; the tasks' sums are added in Spark.
    """
    k = len(model.roots)
    if not k:
        return None
    i, j = np.triu_indices(k)
    d = len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]):
        n, mean, spread = 0, np.zeros(k), np.zeros((k, k))
        for b in batches:
            packed = b.column("x").to_pylist()
            for s in range(0, len(packed), 4096):
                w = scores(deviations(unpack(packed[s:s + 4096], d), model), model)
                own, size = w.mean(0), len(w)
                apart = own - mean
                spread += (w - own).T @ (w - own) + np.outer(apart, apart) * (n * size / (n + size))
                mean += apart * (size / (n + size))
                n += size
        if n:
            values = [n, *(n * mean), *(spread + n * np.outer(mean, mean))[i, j]]
            yield pa.RecordBatch.from_arrays([pa.array([float(v)]) for v in values], [f"s{q}" for q in range(len(values))])

    names = [f"s{q}" for q in range(1 + k + len(i))]
    got = fit.mapInArrow(run, ", ".join(f"{c} double" for c in names)).agg(*[F.sum(c).alias(c) for c in names]).first()
    total = np.array([got[c] for c in names])
    mean, second = total[1:1 + k] / total[0], total[1 + k:] / total[0]
    return float(np.abs(second - mean[i] * mean[j] - (i == j)).max())


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, eigenvalue, explained, identity_error) of each remaining row.

    The model is fitted when this is called (jobs over the fit list); the projection is lazy.
    """
    spark = embeddings.sparkSession
    rows = vectors(embeddings)
    fit = stored(rows.select("x").distinct(), "fit")
    model = fit_model(spark, exact_sums(fit), components)
    error = identity_error(fit, model)
    d, k = len(model.sums), len(model.roots)
    names = ["vec_id", "component", "n", "deviation", "whitened", "eigenvalue", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            packed = b.column("x").to_pylist()
            for s in range(0, len(packed) if k else 0, 4096):
                dev = deviations(unpack(packed[s:s + 4096], d), model)
                m = len(dev)
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays([
                    b.column("vec_id").slice(s, m).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n, np.int64)), squared(dev).take(each),
                    pa.array(scores(dev, model).ravel()), pa.array(np.tile(model.eigenvalues, m)),
                    pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, error))], names)

    kind = dict(rows.dtypes)["vec_id"]
    return rows.mapInArrow(run, f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, "
                                "eigenvalue double, explained double, identity_error double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: the first four whitened coordinates of every embedding."""
    found = whiten(read(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS long)"))
