"""Helpers shared by the corpus operators: stored intermediates and vectorised word hashing.

Inputs of every operator are normalised by ``pick``: only the id and the text column are
taken, so extra columns of any name do no harm.  A NULL text is handled as an empty text.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackyard.session import tell_workers

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1          # odd multiplier of the polynomial hashes (mod 2^64)
INVERSE = pow(BASE, -1, 1 << 64)
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SLICE_BYTES = (4 << 20) - 16                  # text handled by one round of numpy calls


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a scratch folder only for an unset local session."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        d = tempfile.mkdtemp(prefix="trackyard-llm-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once under the shared folder and return a scan of it.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation.  The
    folder is removed when the driver's JVM ends.
    """
    return stored_at(df, name)[0]


def stored_at(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> tuple[DataFrame, str]:
    """``stored``, and the folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex[:12]}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    # the rows are on shared disk now: their shuffle files need not wait for garbage collection
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Remove a stored folder that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt to ``spark.sql.shuffle.partitions`` tasks by key and sorted by it, for a task that streams over keys.

    Dealt by a hash of the keys: by plain keys, the exchange could be left out in favour of a
    join's own partitioning, which adaptive execution may still change.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, F.xxhash64(*keys)).sortWithinPartitions(*keys)


#: Columns by which a document row is found again: the id (a NULL id has a place of its own) and a hash of its text.
KEY = ["kid", "th"]
NULL_ID = -(1 << 63)


def pick(docs: DataFrame, keep_row: bool = False) -> DataFrame:
    """(doc_id, text, kid, th[, row]): ``KEY`` columns are never NULL, ``row`` is the whole input row."""
    tell_workers(docs.sparkSession)
    doc_id = F.col("doc_id").cast("long")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    cols = [doc_id.alias("doc_id"), text.alias("text"), F.coalesce(doc_id, F.lit(NULL_ID)).alias("kid"),
            F.hash(text).alias("th")]
    if keep_row:
        cols.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return docs.select(*cols)


def unpick(df: DataFrame, columns: list[str]) -> DataFrame:
    """The input rows back from their ``row`` struct."""
    return df.select(*[F.col("row").getField(c).alias(c) for c in columns])


def appended(batch: pa.RecordBatch, keep: list[str], **more: pa.Array) -> pa.RecordBatch:
    """The kept columns of a batch with new ones after them."""
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *more.values()], [*keep, *more])


def ddl(df: DataFrame, keep: list[str], more: str) -> str:
    """Schema text of the kept columns followed by ``more``."""
    return ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [more])


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets from 0) of a string column; NULL counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offs = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32,
                         count=column.offset + len(column) + 1)[column.offset:].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offs[0]:offs[-1]], offs - offs[0]


def text_slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each has at most ``limit`` bytes of ``text`` (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = column_bytes(batch.column("text"))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_POWERS = {BASE: np.ones(1, U), INVERSE: np.ones(1, U)}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) mod 2^64."""
    have = _POWERS[base]
    while len(have) < n:
        have = np.concatenate([have, have * U(pow(base, len(have), 1 << 64))])
    if len(have) <= 4 << 20:           # keep no tables of the longest texts
        _POWERS[base] = have
    return have[:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``range_hash`` takes the hash of any range."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(BASE, len(values)), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end], independent of where the range lies."""
    sums = (prefix[end] - prefix[start]) * powers(INVERSE, len(prefix))[start]
    return mix(sums + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def separators(*allowed: int, within: range = range(256)) -> np.ndarray:
    """Byte table: True where the byte separates words."""
    table = np.zeros(256, bool)
    table[list(allowed)] = True
    return table


#: words [^\x20\x09-\x0D]+
SPACES = separators(0x20, *range(0x09, 0x0E))
#: words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text
NOT_ALNUM = separators(*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80))
#: A-Z to a-z
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


class Words:
    """Words of the texts of one batch as numpy arrays.

    data, offs: bytes and text offsets; start, end: byte range of each word; row: its
    text; first: index of each text's first word (one more entry at the end); hash: 64 bits.
    """

    def __init__(self, data: np.ndarray, offs: np.ndarray, sep: np.ndarray = SPACES):
        inside = np.zeros(len(data) + 1, bool)
        inside[:-1] = ~sep[data]
        before = np.zeros(len(data) + 1, bool)
        before[1:] = inside[:-1]
        before[offs] = False                       # a text's first byte starts a word
        self.start = np.flatnonzero(inside & ~before)
        after = inside.copy()
        after[offs[1:]] = False                    # and its end ends one
        self.end = np.flatnonzero(before_end(inside, after)) + 1
        self.data, self.offs = data, offs
        self.first = np.searchsorted(self.start, offs)
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(len(offs) - 1), self.counts)

    @property
    def hash(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, U)
        return range_hash(prefix_hash(self.data.astype(U) + U(1)), self.start, self.end)


def before_end(inside: np.ndarray, after: np.ndarray) -> np.ndarray:
    """True at the last byte of each word (``after``: inside, and False where a text begins)."""
    last = np.zeros(len(inside), bool)
    last[:-1] = inside[:-1] & ~after[1:]
    return last


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of h[i:i+n] for every i, by doubling."""
    if len(h) < n:
        return np.zeros(0, U)
    out, done, step, size = None, 0, h, 1
    while True:
        if n & size:
            if out is None:
                out, done = step, size
            else:
                m = len(h) - done - size + 1
                out = out[:m] * U(pow(BASE, size, 1 << 64)) + step[done:done + m]
                done += size
        if 2 * size > n:
            return mix(out)
        m = len(h) - 2 * size + 1
        step = step[:m] * U(pow(BASE, size, 1 << 64)) + step[size:size + m]
        size *= 2


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of x[i:i+w] for every i."""
    size = 1
    while 2 * size <= w:
        x = np.minimum(x[:len(x) - size], x[size:])
        size *= 2
    return np.minimum(x[:len(x) - (w - size)], x[w - size:]) if w > size else x


def cover(n: int, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Boolean array of n places: True inside any [start, start+length)."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:-1]) > 0


def span_digest(spans: list[tuple[str, int, int]], order: dict[str, int]) -> str:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], order[x[0]], x[2])))


def held_out(doc_id, divisor: int, rest: int):
    """True where crc32 of the id as text leaves ``rest``; a NULL id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % divisor == rest, F.lit(False))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 40) -> np.ndarray:
    """Weights (last: intercept) of a ridge-penalised logistic regression, by damped Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], l2)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty * w
        hess = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))
