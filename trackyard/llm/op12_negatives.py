"""op12: hard-negative mining with angular triangle filtering.

Vectors are mapped to integers (x = floor(256 c)) and scored by integer inner products.  Every
row is stored with its angles to a few reference directions.  If two rows make the angles s and t with
one reference, their own angle lies between |s - t| and min(s + t, 2 pi - s - t); the narrowest interval
over all references, as cosines times the norms, bounds their score.  Rows are stored in blocks of
``BLOCK`` neighbours (ordered by label and angles) with the ranges of their angles and norms, so
the bounds hold for a block at once, and an anchor scores a block's rows only if the score window
it still looks for overlaps the block's bounds:

- positives: from the fifth best score found so far upwards, in blocks with the anchor's label;
- negatives of a positive with score p: 80 p <= 100 s <= 100 p, and from the fifth best found so
  far within that window upwards, in blocks with another label.

The bounds are widened (``SLACK`` radians, then outward rounding) by more than doubles can be off,
so nothing is lost, whatever the references are: they steer the work, not the result.

Work: rows are laid out once (range partitioning by label, angle cells and a hash of the id, so
equal labels or vectors are split too) and stored.  The anchors, a stated query set, meet them in groups of at
most ``GROUP`` anchors and ``GROUP_BYTES``: one pass over the stored blocks for the positives and one for
the negatives, without a shuffle of rows.  A task keeps its best partners per anchor and window,
whose number does not depend on the rows; the tasks' finds meet in a top-k per anchor.  The driver
holds one group and its positives at a time.  All rows are laid out and all anchors asked.

Hard rows: rows with a NULL label or vector, or with NULL or non-finite components, take no part.
A row with a NULL vec_id is no anchor; as a partner it comes after all ids of equal score and its id is NULL.
Repeated rows are rows of their own: each is a partner, and each repeated anchor has its results (and the
other as a partner).  Ties go to the smaller vec_id.  Missing entries of shorter vectors count as 0; x beyond a
long is the nearest long, a score beyond a long is ranked exactly and returned as the nearest long.
Empty tables and tables without anchors give no rows; extra columns do no harm.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackyard.llm.common import read, shared_dir, stored
from trackyard.llm.op11_whitening import integer_rows, pack, unpack
from trackyard.session import tell_workers

POSITIVES = 5
NEGATIVES = 5
LOWEST = 80            # per cent of the positive's score that a negative must reach
REFERENCES = 8
SAMPLE = 2000          # rows from which the reference directions are taken
BLOCK = 256            # rows whose bounds are kept together
GROUP = 4096           # anchors that are asked at a time
GROUP_BYTES = 32 << 20
SLACK = 1e-6           # radians; arccos of a cosine that is off by 1e-14 is off by less
LONG = np.iinfo(np.int64)
EXACT = 1 << 53


# ---------------------------------------------------------------- scores and bounds

def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a with all of b, exactly: longs, or Python integers where they may not fit."""
    top = [max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0 for x in (a, b)]
    bound = top[0] * top[1] * max(1, a.shape[1])
    if bound <= EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 1 << 63:
        return a @ b.T
    return a.astype(object) @ b.astype(object).T


def norms(x: np.ndarray) -> np.ndarray:
    f = x.astype(np.float64)
    top = np.abs(f).max(1, initial=0)
    scale = np.where(top > 0, top, 1.0)
    return np.sqrt(((f / scale[:, None]) ** 2).sum(1)) * scale


def angles(x: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Angle of every row to every reference (unit rows); a zero row has angle 0: its scores are 0 by its norm."""
    n = norms(x)
    cos = (x / np.where(n > 0, n, 1.0)[:, None]) @ refs.T
    return np.where(n[:, None] > 0, np.arccos(np.clip(cos, -1, 1)), 0.0)


def block_bounds(own: np.ndarray, own_norm: np.ndarray, low: np.ndarray, high: np.ndarray,
                 norm_low: float, norm_high: float) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) score that each anchor can have with any row of a block.

    own: anchors' angles; low, high: range of the block's angles to each reference.
    """
    apart = np.maximum(0.0, np.maximum(low - own, own - high)).max(1, initial=0.0) - SLACK
    reach = np.minimum(own + high, 2 * math.pi - own - low).min(1, initial=math.pi) + SLACK
    near = np.cos(np.clip(apart, 0, math.pi))
    far = np.cos(np.clip(reach, 0, math.pi))
    top = own_norm * np.where(near > 0, near * norm_high, near * norm_low)
    bottom = own_norm * np.where(far > 0, far * norm_low, far * norm_high)
    wide = own_norm * norm_high * 1e-9 + 1
    return np.floor(bottom - wide), np.ceil(top + wide)


class Best:
    """The k best partners of each of ``size`` keys: score, id (NULL last) and row number, for ties in that order."""

    def __init__(self, size: int, k: int):
        self.k = k
        self.kept: list[list[tuple]] = [[] for _ in range(size)]
        self.floor = np.full(size, -math.inf)          # a score below cannot enter any more

    def offer(self, key: int, scores: np.ndarray, fits: np.ndarray, block: Block) -> None:
        some = np.flatnonzero(fits)
        if len(some) > self.k:                         # the k best scores, and all that tie with the last
            own = scores[some]
            last = (sorted(own)[-self.k] if own.dtype == object else np.partition(own, len(own) - self.k)[-self.k])
            some = some[own >= last]
        new = [(-int(scores[i]), bool(block.no_id[i]), int(block.ids[i]), int(block.rids[i])) for i in some]
        self.kept[key] = sorted(self.kept[key] + new)[:self.k]
        if len(self.kept[key]) == self.k:
            # as a double, never above the exact score
            self.floor[key] = np.nextafter(float(-self.kept[key][-1][0]), -math.inf)

    def batch(self) -> pa.RecordBatch:
        rows = [(key, ordered(-s), nearest_long(-s), None if no else i, r)
                for key, kept in enumerate(self.kept) for s, no, i, r in kept]
        kinds = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        cols = list(zip(*rows)) or [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)],
                                          ["key", "exact", "score", "id", "rid"])


#: exact: the score as bytes that sort as the scores do; score: the nearest long
FOUND = "key int, exact binary, score long, id long, rid long"
WIDTH = 24


def ordered(score: int) -> bytes:
    return (score + (1 << 8 * WIDTH - 1)).to_bytes(WIDTH, "big")


def from_ordered(data: bytes) -> int:
    return int.from_bytes(data, "big") - (1 << 8 * WIDTH - 1)


def nearest_long(score: int) -> int:
    return max(LONG.min, min(LONG.max, score))


# ---------------------------------------------------------------- layout

def references(rows: DataFrame, count: int = REFERENCES, sample: int = SAMPLE) -> np.ndarray:
    """Unit directions of the largest spread in a bounded sample (the ``sample`` rows of smallest id hash)."""
    some = rows.orderBy(F.xxhash64("vec_id"), "rid").limit(sample).select("x").toPandas()["x"]
    if not len(some):
        return np.zeros((0, 0))
    x = unpack([bytes(p) for p in some])
    n = norms(x)
    x = x[n > 0] / n[n > 0][:, None]
    _, _, directions = np.linalg.svd(x, full_matrices=False)
    return directions[:count]


def fitted(x: np.ndarray, d: int) -> np.ndarray:
    """Matrix with d columns: the entries behind them are no part of the references' space."""
    return x[:, :d] if x.shape[1] >= d else np.pad(x, ((0, 0), (0, d - x.shape[1])))


def all_angles(x: np.ndarray, refs: np.ndarray) -> np.ndarray:
    d = max(x.shape[1], refs.shape[1])
    return angles(fitted(x, d), np.pad(refs, ((0, 0), (0, d - refs.shape[1]))))


def numbered(embeddings: DataFrame) -> DataFrame:
    """(rid, vec_id, label, x) of the rows that take part, stored; rid numbers them."""
    tell_workers(embeddings.sparkSession)
    some = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                             F.col("embedding").cast("array<double>").alias("embedding")).where("label IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            keep, *where = integer_rows(b)
            at = pa.array(keep)
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(at), b.column("label").take(at),
                                              pa.array(pack(*where), pa.binary())], ["vec_id", "label", "x"])

    rows = some.mapInArrow(run, "vec_id long, label long, x binary")
    # fixed by the write: the numbers are read back, never made again
    return stored(rows.select(F.monotonically_increasing_id().alias("rid"), "*"), "vectors")


BLOCK_SCHEMA = ("label_low long, label_high long, norm_low double, norm_high double, low array<double>, high array<double>, "
                "rids array<long>, ids array<long>, labels array<long>, xs array<binary>")


def blocks(rows: DataFrame, refs: np.ndarray, parts: int) -> DataFrame:
    """Rows packed into blocks of neighbours with the ranges of their labels, norms and angles, stored."""
    cells = min(2, len(refs))

    def measure(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            if not b.num_rows:
                continue
            t = all_angles(unpack(b.column("x").to_pylist()), refs)
            cell = (t[:, :cells] * (12 / math.pi)).astype(np.int32)
            key = cell @ np.array([100, 1], np.int32)[:cells] if cells else np.zeros(b.num_rows, np.int32)
            fine = t[:, cells] if t.shape[1] > cells else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(key.astype(np.int32)), pa.array(fine)],
                                             [*b.schema.names, "cell", "fine"])

    measured = rows.mapInArrow(measure, "rid long, vec_id long, label long, x binary, cell int, fine double")
    order = ["label", "cell", "fine", "spread"]
    dealt = (measured.withColumn("spread", F.xxhash64("rid")).repartitionByRange(parts, *order).sortWithinPartitions(*order))

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for s in range(0, b.num_rows, BLOCK):
                part = b.slice(s, BLOCK)
                packed = part.column("x").to_pylist()
                x = unpack(packed)
                t, n = all_angles(x, refs), norms(x)
                labels = part.column("label").to_numpy()
                values = [int(labels.min()), int(labels.max()), float(n.min()), float(n.max()), t.min(0).tolist(),
                          t.max(0).tolist(), part.column("rid").to_pylist(), part.column("vec_id").to_pylist(),
                          labels.tolist(), packed]
                kinds = [pa.int64()] * 2 + [pa.float64()] * 2 + [pa.list_(pa.float64())] * 2 + [pa.list_(pa.int64())] * 3
                kinds.append(pa.list_(pa.binary()))
                names = ["label_low", "label_high", "norm_low", "norm_high", "low", "high", "rids", "ids", "labels", "xs"]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

    return stored(dealt.mapInArrow(run, BLOCK_SCHEMA), "blocks")


class Block:
    """One stored block, its vectors unpacked on demand."""

    def __init__(self, batch: pa.RecordBatch, k: int):
        def value(name):
            return batch.column(name)[k]

        self.labels_low, self.labels_high = value("label_low").as_py(), value("label_high").as_py()
        self.norm_low, self.norm_high = value("norm_low").as_py(), value("norm_high").as_py()
        self.low, self.high = (np.array(value(c).as_py()) for c in ("low", "high"))
        self._value = value

    def load(self) -> None:
        ids = self._value("ids").values
        self.no_id = np.asarray(ids.is_null())
        self.ids = ids.fill_null(0).to_numpy()
        self.rids = self._value("rids").values.to_numpy()
        self.labels = self._value("labels").values.to_numpy()
        self.x = unpack(self._value("xs").as_py())


def each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for b in batches:
        for k in range(b.num_rows):
            yield Block(b, k)


# ---------------------------------------------------------------- search

class Anchors:
    """One group of anchors with their angles and norms."""

    def __init__(self, rids: list[int], ids: list[int], labels: list[int], packed: list[bytes], refs: np.ndarray):
        self.rids, self.ids, self.labels = (np.array(v, np.int64) for v in (rids, ids, labels))
        self.x = unpack(packed)
        self.angles, self.norms = all_angles(self.x, refs), norms(self.x)

    def bounds(self, block: Block, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return block_bounds(self.angles[some], self.norms[some], block.low, block.high, block.norm_low, block.norm_high)

    def scores(self, block: Block, some: np.ndarray) -> np.ndarray:
        d = max(self.x.shape[1], block.x.shape[1])
        return dots(fitted(self.x[some], d), fitted(block.x, d))


def find_positives(batches: Iterator[pa.RecordBatch], anchors: Anchors, k: int) -> Iterator[pa.RecordBatch]:
    """The k best partners of each anchor with its label, among the task's blocks."""
    best = Best(len(anchors.rids), k)
    for block in each_block(batches):
        some = np.flatnonzero((anchors.labels >= block.labels_low) & (anchors.labels <= block.labels_high))
        if len(some):
            some = some[anchors.bounds(block, some)[1] >= best.floor[some]]
        if not len(some):
            continue
        block.load()
        s = anchors.scores(block, some)
        fits = ((block.labels == anchors.labels[some, None]) & (block.rids != anchors.rids[some, None])
                & (s >= best.floor[some, None]))
        for k in np.flatnonzero(fits.any(1)):
            best.offer(some[k], s[k], fits[k], block)
    yield best.batch()


def find_negatives(batches: Iterator[pa.RecordBatch], anchors: Anchors, owner: np.ndarray, low: np.ndarray,
                   high: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The k best partners with another label for each window low..high of the anchor ``owner``, among the task's blocks."""
    best = Best(len(owner), k)
    near, far = low.astype(np.float64), high.astype(np.float64)        # next double outward
    near, far = np.nextafter(near, -math.inf), np.nextafter(far, math.inf)
    for block in each_block(batches):
        # all windows of an anchor share its bounds
        asked = np.unique(owner)
        asked = asked[(block.labels_low != block.labels_high) | (anchors.labels[asked] != block.labels_low)]
        if not len(asked):
            continue
        bottom, top = (np.zeros(len(anchors.rids)) for _ in range(2))
        bottom[asked], top[asked] = anchors.bounds(block, asked)
        here = np.zeros(len(anchors.rids), bool)
        here[asked] = True
        windows = np.flatnonzero(here[owner] & (top[owner] >= np.maximum(near, best.floor)) & (bottom[owner] <= far))
        if not len(windows):
            continue
        block.load()
        some, row = np.unique(owner[windows], return_inverse=True)
        s = anchors.scores(block, some)
        other = block.labels != anchors.labels[some, None]
        for at in range(0, len(windows), 1024):
            w, r = windows[at:at + 1024], row[at:at + 1024]
            fits = (s[r] >= low[w, None]) & (s[r] <= high[w, None]) & (s[r] >= best.floor[w, None]) & other[r]
            for k in np.flatnonzero(fits.any(1)):
                best.offer(w[k], s[r[k]], fits[k], block)
    yield best.batch()


def top(found: DataFrame, k: int) -> DataFrame:
    """The k best finds of each key over all tasks, with their rank."""
    w = Window.partitionBy("key").orderBy(F.col("exact").desc(), F.col("id").asc_nulls_last(), "rid")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(embeddings: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
         lowest: int = LOWEST) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where ``anchor`` holds.

    embeddings: vec_id, embedding, label.  The search runs when this is called, group by group,
    each group's rows being written to the shared folder; the result reads them.
    """
    spark = embeddings.sparkSession
    rows = numbered(embeddings)
    refs = references(rows)
    n = rows.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // (64 * BLOCK)))
    table = blocks(rows, refs, min(parts, max(1, -(-n // BLOCK))))
    asked = rows.where(anchor & F.col("vec_id").isNotNull())
    path = f"{shared_dir(spark)}/llm/negatives-{uuid.uuid4().hex[:12]}"
    spark.createDataFrame([], RESULT).write.parquet(path)
    for group in groups(asked):
        answer(table, group, refs, positives, negatives, lowest).write.mode("append").parquet(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(RESULT).parquet(path)


def groups(asked: DataFrame) -> Iterator[list]:
    """The anchors in groups of at most ``GROUP`` rows and ``GROUP_BYTES`` (or one row), one group on the driver at a time."""
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.length("x")).alias("widest")).first()
    if not size.n:
        return
    rows = max(1, min(GROUP, GROUP_BYTES // (9 * size.widest)))        # unpacked: up to 8 bytes an entry of one
    chunks = -(-size.n // rows)
    if chunks == 1:
        yield asked.collect()
        return
    # a hash deals the rows unevenly: twice the chunks, and a chunk that is too large is asked in pieces
    chunks *= 2
    dealt = stored(asked.withColumn("chunk", F.pmod(F.xxhash64("rid"), F.lit(chunks)))
                   .repartitionByRange(F.col("chunk")).sortWithinPartitions("chunk"), "anchors")
    for c in range(chunks):
        held = []
        for r in dealt.where(F.col("chunk") == c).drop("chunk").toLocalIterator():
            held.append(r)
            if len(held) == rows:
                yield held
                held = []
        if held:
            yield held


def answer(table: DataFrame, group: list, refs: np.ndarray, positives: int, negatives: int, lowest: int) -> DataFrame:
    """The result rows of one group of anchors."""
    spark = table.sparkSession
    args = ([r.rid for r in group], [r.vec_id for r in group], [r.label for r in group], [bytes(r.x) for r in group], refs)

    def first(batches):
        return find_positives(batches, Anchors(*args), positives)

    # at most GROUP * positives rows
    found = top(table.mapInArrow(first, FOUND), positives).orderBy("key", "rank").collect()
    owner = np.array([r.key for r in found], np.int64)
    high = [from_ordered(bytes(r.exact)) for r in found]
    low = [-(-lowest * p // 100) for p in high]
    fits = all(LONG.min <= v <= LONG.max for v in high + low)
    low, high = (np.array(v, np.int64 if fits else object) for v in (low, high))

    def second(batches):
        return find_negatives(batches, Anchors(*args), owner, low, high, negatives)

    ids = [(k, group[r.key].vec_id, r.id, r.score) for k, r in enumerate(found)]
    known = spark.createDataFrame(ids, "key int, anchor_id long, positive_id long, positive_score long")
    best = top(table.mapInArrow(second, FOUND), negatives)
    return best.join(known, "key").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"),
                                          F.col("id").alias("negative_id"), "positive_score",
                                          F.col("score").alias("negative_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: five hard negatives for each of five positives of every anchor (vec_id divisible by 100)."""
    rows = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


ORACLE_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
ints AS (
  SELECT vec_id, label, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x FROM rows),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
  FROM ints a JOIN ints b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score
  FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank,
       s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same
WHERE 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) <= 5
"""
