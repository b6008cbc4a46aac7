"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint has 64 bits, each set if more than half of the document's shingle hashes
(XXH64, seed 42) have it.  Fingerprints at ``distance`` or fewer differing bits are linked.

If the bits are dealt to partitions with thresholds t_i whose sum of (t_i + 1) is
distance + 1, two linked fingerprints differ in at most t_i bits of some partition i.
Correlated bits go to one partition; a dynamic programme gives out unequal thresholds (-1:
not probed) at the least estimated number of probes and candidates, estimated from a bounded
sample that only steers cost, never the result.  Distinct fingerprints are then probed:
each goes to the buckets of its partition values and of all values within the threshold.
A bucket's members are verified against each other; only a spanning forest of its links
leaves the task.  Buckets above ``BUCKET`` members are cut into chunks, and every pair of
chunks becomes a bucket of its own, so no link is lost and no task grows.

Documents of one fingerprint are represented once.  Without words the fingerprint is zero
and linked like any other.  NULL texts are empty; a NULL doc_id takes part, but never names
a component that has another id.  Repeated rows get a result each; empty tables give none.
Very long texts are read whole, their shingles in blocks.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackyard.llm.common import KEY, U, appended, ddl, dealt, pick, read, stored, text_slices, unpick
from trackyard.llm.components import components

SHINGLE = 4
DISTANCE = 4
SAMPLE = 20_000        # fingerprints that the estimates look at
BUCKET = 20_000        # members of a bucket that one task compares at a time
PROBE_COST = 300.0     # of sending a probe, in comparisons


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()
    if not words:
        return 0
    n = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    ones, total = np.zeros(64, np.int64), len(words) - n + 1
    for k in range(0, total, 1 << 16):
        m = min(total, k + (1 << 16))
        hashes = np.array([digest(joined[s:e], 42) for s, e in
                           zip(starts[k:m].tolist(), ends[k + n - 1:m + n - 1].tolist())], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, keep: list[str], shingle: int = SHINGLE) -> DataFrame:
    """The kept columns of ``df`` (which has ``text``) with ``fp``, the fingerprint as a signed long."""

    def run(batches):
        for b in text_slices(batches):
            fps = np.array([fingerprint((t or "").encode(), shingle) for t in b.column("text").to_pylist()], U)
            yield appended(b, keep, fp=pa.array(fps.view(np.int64)))

    return df.mapInArrow(run, ddl(df, keep, "fp long"))


def bit_matrix(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def group_bits(bits: np.ndarray, parts: int) -> list[list[int]]:
    """Deal the 64 bits into partitions of nearly equal width, correlated bits together."""
    with np.errstate(invalid="ignore", divide="ignore"):
        corr = np.nan_to_num(np.abs(np.corrcoef(bits.T.astype(float)))) if len(bits) > 1 else np.zeros((64, 64))
    left, out = set(range(64)), []
    for k in range(parts):
        width = -(-len(left) // (parts - k))
        mine = [max(left, key=lambda i: (corr[i, sorted(left)].sum(), -i))]
        left.remove(mine[0])
        while len(mine) < width:
            mine.append(max(left, key=lambda i: (corr[i, mine].sum(), -i)))
            left.remove(mine[-1])
        out.append(sorted(mine))
    return out


def ball(width: int, t: int) -> int:
    """Probes of one fingerprint in a partition of this width with threshold t."""
    return sum(len(list(combinations(range(width), k))) for k in range(t + 1)) if t >= 0 else 0


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds -1.. of least cost whose sum of (t + 1) is ``total``; costs[i][t + 1] is that of t."""
    best: list[tuple[float, list[int]] | None] = [(0.0, [])] + [None] * total
    for cost in costs:
        nxt: list[tuple[float, list[int]] | None] = [None] * (total + 1)
        for used, got in enumerate(best):
            if got is None:
                continue
            for step, c in enumerate(cost[:total - used + 1]):
                new = (got[0] + c, [*got[1], step - 1])
                if nxt[used + step] is None or new < nxt[used + step]:
                    nxt[used + step] = new
        best = nxt
    return best[total] or (float("inf"), [])


def plan(sample: np.ndarray, n: int, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition that is probed, for ``n`` distinct fingerprints like the sample."""
    if distance < 0:
        raise ValueError("distance must be 0 or more")
    bits = bit_matrix(sample)
    some = sample[:2000]
    best: tuple[float, list] = (float("inf"), [])
    for parts in range(1 if distance < 2 else 2, distance + 2):
        groups = group_bits(bits, parts)
        costs = []
        for g in groups:
            mask = U(sum(1 << i for i in g))
            far = np.bitwise_count((some[:, None] ^ some[None, :]) & mask)
            share = np.array([(far <= t).sum() - len(some) for t in range(distance + 1)]) / max(1, len(some) ** 2)
            # pairs that a sample cannot see are taken to lie like random bits
            rand = [ball(len(g), min(t, 3)) / 2.0 ** len(g) for t in range(distance + 1)]
            costs.append([0.0] + [n * ball(len(g), t) * PROBE_COST + n * n * max(share[t], rand[t])
                                  if t <= 3 else float("inf") for t in range(distance + 1)])
        cost, ts = allocate(costs, distance + 1)
        if cost < best[0]:
            best = (cost, [(g, t) for g, t in zip(groups, ts) if t >= 0])
    return best[1]


def masks(bits: list[int], t: int) -> np.ndarray:
    """XOR masks that reach every value within t bits."""
    return np.array([sum(1 << i for i in c) for k in range(t + 1) for c in combinations(bits, k)], U)


def probes(fps: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """(bucket, fp): the buckets of each fingerprint.

    With threshold 1 the one of a pair that lacks the differing bit meets the other's value;
    so only probes that set a bit are sent.  Larger thresholds send the whole ball.
    """
    def run(batches):
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False).view(U)
            for k, (bits, t) in enumerate(parts):
                own = U(sum(1 << i for i in bits))
                for m in masks(bits, t):
                    mine = fp[(fp & m) == 0] if t == 1 else fp
                    value = (mine & own) ^ m
                    # a bucket's name is a hash of partition and value; equal names only join candidates
                    name = (value + U((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) * U(0xD6E8FEB86659FD93)
                    name ^= name >> U(32)
                    yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(mine.view(np.int64))],
                                                     ["bucket", "fp"])

    return fps.select("fp").mapInArrow(run, "bucket long, fp long")


def forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that join the fingerprints of one bucket as all its links do."""
    left, out = np.unique(fps), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= distance
            if near.any():
                found = left[near]
                out += [(at, x) for x in found]
                queue += list(found)
                left = left[~near]
    return out


def links(fps: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """(u, v): links between distinct fingerprints (column fp), enough to connect what all links connect."""
    n = fps.count()
    share = max(1, n // SAMPLE)
    # about SAMPLE fingerprints; the limit only guards the driver
    sample = fps.where(F.pmod(F.xxhash64("fp"), F.lit(share)) == 0).limit(2 * SAMPLE).toPandas()["fp"]
    parts = plan(sample.to_numpy(np.int64).view(U), n, distance)
    sent = probes(fps, parts)
    large = (sent.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket)
             .select("bucket", F.ceil(2 * F.col("n") / bucket).cast("int").alias("chunks")))
    large = stored(large, "large")
    if large.isEmpty():
        buckets = sent.withColumn("i", F.lit(0)).withColumn("j", F.lit(0))
    else:
        mine = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1))
        buckets = (sent.join(large, "bucket", "left").withColumn("mine", F.coalesce(mine, F.lit(0)))
                   .withColumn("other", other)
                   .select("bucket", "fp", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")))
    buckets = dealt(buckets, "bucket", "i", "j")

    def verify(batches):
        held, name = [], None                      # the bucket that may go on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "i", "j", "fp")]
            cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)) + 1
            fp, out = cols[3].view(U), []
            edges = [0, *cut.tolist(), b.num_rows]
            for s, e in zip(edges, edges[1:]):
                if (this := tuple(c[s] for c in cols[:3])) != name:
                    out += forest(np.concatenate(held), distance) if held else []
                    held, name = [], this
                held.append(fp[s:e])
            yield _pairs(out)
        if held:
            yield _pairs(forest(np.concatenate(held), distance))

    return buckets.mapInArrow(verify, "u long, v long")


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(found, U).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], ["u", "v"])


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, kid, th, fp, component_id) of every row; the component's smallest doc_id names it."""
    marked = stored(fingerprints(pick(docs), ["doc_id", *KEY], shingle), "fingerprints")
    fps = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(fps, distance)).withColumnRenamed("node", "fp")
    named = fps.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(named.join(smallest, "root").select("fp", "root", "component_id"), "fp")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The rows of ``docs``, one for each component: that of the smallest id (then text hash)."""
    found = near_duplicates(docs, shingle, distance)
    kept = (found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), *KEY)).alias("k"))
            .select("k.kid", "k.th"))
    rows = pick(docs, keep_row=True).join(kept, KEY)
    return unpick(rows.dropDuplicates(KEY), docs.columns)       # equal rows may repeat


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: fingerprint and component of every document."""
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
