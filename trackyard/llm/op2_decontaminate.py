"""Benchmark decontamination: a broadcast set of normalised test n-grams against every token window.

Words are runs of letters and digits (and all non-ASCII characters) after lower-casing
A-Z.  A window is ``n`` consecutive words of a benchmark item; an item of fewer words is one
window.  Each task hashes all windows of its texts, looks the hashes up in the broadcast set
and verifies each hit word by word.  The benchmark goes out in blocks of bounded size: one
in practice, several passes (each stored) for a benchmark of any size.

NULL texts have no words.  Equal item rows count once; an item with a NULL item_id hits but
is not listed.  Every document row, also repeated ones, gets its own result; empty tables
give no rows or no hits.  Other columns pass through untouched.
Very long texts are read whole; a task needs memory in proportion to the longest one.  Ties: none possible,
as every window is judged by itself.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackyard.llm.common import (LOWER, NOT_ALNUM, U, Words, appended, column_bytes, cover, ddl, grams, pick, read,
                                  stored, text_slices, unpick)

N = 10
BLOCK_CHARS = 8 << 20          # characters of benchmark text in one broadcast: by reckoning at most some 30 bytes of memory each


def words_of(column: pa.Array) -> Words:
    data, offs = column_bytes(column)
    return Words(LOWER[data], offs, NOT_ALNUM)


class WindowSet:
    """The windows of some benchmark items as arrays: about 16 bytes each, beside the words themselves.

    sets: for each window size the sorted hashes, each one's first word, its item's row and the hashes that
    windows of different words share (next to never any).
    """

    def __init__(self, items: list[tuple[str | None, str]], n: int):
        w = words_of(pa.array([text for _, text in items], pa.string()))
        self.data, self.start, self.end = w.data, w.start.astype(np.uint32), w.end.astype(np.uint32)
        self.names = [item_id for item_id, _ in items]
        sizes = np.minimum(w.counts, n)
        self.sets = {}
        for size in np.unique(sizes[sizes > 0]).tolist():
            rows = np.flatnonzero(sizes == size)
            many = w.counts[rows] - size + 1
            at = np.repeat(w.first[rows] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            row, h = np.repeat(rows, many), grams(w.hash, size)[at]
            order = np.lexsort((row, h))
            h, at, row = h[order], at[order], row[order]
            # windows of equal hash are compared with the first of them
            new = np.append(True, h[1:] != h[:-1])
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            mixed = {int(h[i]) for i in np.flatnonzero(~new).tolist()
                     if self.words(int(at[i]), size) != self.words(int(at[first[i]]), size)}
            self.sets[size] = (h, at.astype(np.uint32), row.astype(np.uint32), mixed)
        total = sum(len(x[0]) for x in self.sets.values())
        self.bits = 0
        while total and (1 << self.bits) < 16 * total:
            self.bits += 1

    def words(self, at: int, size: int) -> bytes:
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.start[at:at + size], self.end[at:at + size]))

    def filters(self) -> dict[int, np.ndarray]:
        """For each window size a table that sorts out nearly all other hashes at one look."""
        out = {}
        for size, (keys, *_) in self.sets.items():
            out[size] = np.zeros(1 << self.bits, bool)
            out[size][keys & U((1 << self.bits) - 1)] = True
        return out

    def items(self, size: int, lo: int, hi: int, words: bytes) -> set:
        """Ids of the items among entries lo..hi of one hash whose window is ``words``."""
        keys, at, row, mixed = self.sets[size]
        if int(keys[lo]) in mixed:
            return {self.names[row[i]] for i in range(lo, hi) if self.words(int(at[i]), size) == words}
        return {self.names[i] for i in row[lo:hi].tolist()} if self.words(int(at[lo]), size) == words else set()


def find(w: Words, windows: WindowSet, filters: dict[int, np.ndarray]) -> dict[int, list]:
    """row -> [(first word in the row, words, ids)] of every verified window."""
    found = defaultdict(list)
    h = w.hash
    for size, table in filters.items():
        g = grams(h, size)
        at = np.flatnonzero(table[g & U(len(table) - 1)])
        at = at[w.row[at] == w.row[at + size - 1]]
        keys = windows.sets[size][0]
        at = at[keys[np.minimum(np.searchsorted(keys, g[at]), len(keys) - 1)] == g[at]]
        low, high = np.searchsorted(keys, g[at]), np.searchsorted(keys, g[at], side="right")
        for i, lo, hi in zip(at.tolist(), low.tolist(), high.tolist()):
            words = b" ".join(w.data[s:e].tobytes() for s, e in zip(w.start[i:i + size], w.end[i:i + size]))
            if ids := windows.items(size, lo, hi, words):
                found[int(w.row[i])].append((i - int(w.first[w.row[i]]), size, ids))
    return found


SCANNED = "n_words long, hits array<struct<start: long, length: long>>, items array<string>"
_HITS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))


def scan(df: DataFrame, benchmark: DataFrame, keep: list[str], n: int = N,
         block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The kept columns of ``df`` (which has ``text``) with n_words, hit windows and the items they come from."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"),
                             F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 if total <= block_chars else 2 * -(-total // block_chars)
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    for k in range(blocks):
        last = k == blocks - 1
        windows = WindowSet([(r.item_id, r.text) for r in items.where(F.col("block") == k).collect()], n)
        df = _pass(df, windows, keep if last else list(dict.fromkeys([*keep, "text"])), first=k == 0)
        if not last:
            df = stored(df, "scan")
    return df


def _pass(df: DataFrame, windows: WindowSet, keep: list[str], first: bool) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(windows)

    def run(batches):
        windows = shared.value
        filters = windows.filters()
        for b in text_slices(batches):
            w = words_of(b.column("text"))
            hits = [[] for _ in range(b.num_rows)] if first else b.column("hits").to_pylist()
            ids = [[] for _ in range(b.num_rows)] if first else b.column("items").to_pylist()
            for row, got in find(w, windows, filters).items():
                hits[row] += [{"start": s, "length": k} for s, k, _ in got]
                ids[row] = sorted({*ids[row], *(i for _, _, x in got for i in x if i is not None)})
            yield appended(b, keep, n_words=pa.array(w.counts, pa.int64()), hits=pa.array(hits, _HITS),
                           items=pa.array(ids, pa.list_(pa.string())))

    return df.mapInArrow(run, ddl(df, keep, SCANNED))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", n: int = N) -> DataFrame:
    """The rows of ``docs`` without contaminated documents, or (``remove="spans"``) without the words hit.

    Kept words of a cut document are joined by one space; untouched documents stay as they are.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove must be 'documents' or 'spans'")
    found = scan(pick(docs, keep_row=True), benchmark, ["row", "text"] if remove == "spans" else ["row"], n)
    if remove == "documents":
        return unpick(found.where(F.size("hits") == 0), docs.columns)

    def cut(batches):
        for b in text_slices(batches):
            w, texts = words_of(b.column("text")), b.column("text").to_pylist()
            raw = column_bytes(b.column("text"))[0]
            for i, hits in enumerate(b.column("hits").to_pylist()):
                if hits:
                    lo, hi = int(w.first[i]), int(w.first[i + 1])
                    gone = cover(hi - lo, np.array([x["start"] for x in hits]), np.array([x["length"] for x in hits]))
                    texts[i] = " ".join(raw[s:e].tobytes().decode() for s, e, g in
                                        zip(w.start[lo:hi], w.end[lo:hi], gone) if not g)
            yield appended(b, ["row"], cleaned=pa.array(texts, pa.string()))

    cleaned = found.mapInArrow(cut, ddl(found, ["row"], "cleaned string"))
    row = F.col("row")
    return cleaned.select(*[F.when(row.getField(c).isNotNull(), F.col("cleaned")).alias(c) if c == "text"
                            else row.getField(c).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: words of every document that lie in a window of the benchmark."""
    found = scan(pick(read(spark, sf_dir, "documents")), read(spark, sf_dir, "benchmark"), ["doc_id"])

    def digest(batches):
        for b in batches:
            n_hit, shas = [], []
            for n, hits, ids in zip(*(b.column(c).to_pylist() for c in ("n_words", "hits", "items"))):
                n_hit.append(int(cover(n, np.array([x["start"] for x in hits]),
                                       np.array([x["length"] for x in hits])).sum()) if hits else 0)
                shas.append(hashlib.sha256(",".join(ids).encode()).hexdigest())
            yield appended(b, ["doc_id", "n_words"], n_hit=pa.array(n_hit, pa.int64()),
                           n_items=pa.array([len(x) for x in b.column("items")], pa.int64()),
                           items_sha256=pa.array(shas, pa.string()))

    return (found.mapInArrow(digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string")
            .withColumn("contaminated", F.col("n_hit") > 0))
