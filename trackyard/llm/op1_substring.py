"""Substring dedup with suffix automata of reference shards.

A window is ``WINDOW`` consecutive words.  A word is removed if it lies in a window whose
word sequence also starts in a document with a smaller doc_id.

Every window chooses an anchor: its ``GRAM``-word sequence of smallest hash, leftmost on
ties.  Equal windows choose equal anchors, so only stretches around one anchor need to be
compared.  A stretch is the maximal run of windows that chose the same anchor place; per
document there are a few for every hundred words.

- An anchor that occurs in one document only is dropped.
- If all stretches of an anchor are the same (compared by 128 bits), all but the smallest
  document lose them.
- For the others one copy of each different stretch is fetched with its smallest doc_id.
  They are dealt to reference shards by anchor; a task builds a suffix automaton over the
  stretches of an anchor, whose states carry the smallest doc_id of their occurrences, and
  streams the stretches through it: the matching statistics give, for each window, the
  smallest document that has it.  An anchor with more than ``SHARD`` different stretches is
  too large for one automaton; its windows are counted by hash over all tasks instead.

Shards are routed by anchor and not broadcast: every document would have to stream through
every shard, which is quadratic in the corpus.

NULL texts have no words.  A row without doc_id neither loses words nor is a reference.
Rows of one doc_id are one document for the comparison; repeated rows get a result each.  An
empty table gives no rows; other columns are not read.
Very long texts are read whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackyard.llm.common import (KEY, U, Words, appended, column_bytes, cover, ddl, dealt, grams, pick, prefix_hash,
                                  range_hash, read, sliding_min, stored, text_slices, unpick)

WINDOW = 50
GRAM = 20
SHARD = 1_000


class SuffixAutomaton:
    """Generalised suffix automaton; each state keeps the smallest owner of its strings."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.len, self.owner = [-1], [0], [None]

    def _state(self, length: int, arcs: dict, link: int) -> int:
        self.next.append(arcs)
        self.link.append(link)
        self.len.append(length)
        self.owner.append(None)
        return len(self.len) - 1

    def _clone(self, p: int, q: int, c) -> int:
        new = self._state(self.len[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, c) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, q, c)
        new = self._state(self.len[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._clone(p, q, c)
        return new

    def add(self, tokens, owner) -> None:
        last = 0
        for c in tokens:
            last = self._extend(last, c)
            if self.owner[last] is None or owner < self.owner[last]:
                self.owner[last] = owner

    def finish(self) -> None:
        """Give every state the smallest owner of the strings that end in it."""
        for s in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            p, mine = self.link[s], self.owner[s]
            if p > 0 and mine is not None and (self.owner[p] is None or mine < self.owner[p]):
                self.owner[p] = mine

    def statistics(self, tokens, cap: int | None = None):
        """For each place: (length of the longest match that ends there, smallest owner of that match).

        With ``cap`` matches are cut to their last ``cap`` tokens.
        """
        state = length = 0
        for c in tokens:
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.len[state]
            if c in self.next[state]:
                state = self.next[state][c]
                length += 1
            if cap is not None and length >= cap:
                length = cap
                while self.len[self.link[state]] >= cap:
                    state = self.link[state]
            yield length, self.owner[state] if state else None


STRETCH = "anchor long, body long, doc_id long, th int, start int, n int"


def stretches(w: Words, window: int = WINDOW, gram: int = GRAM):
    """Arrays (anchor, body, row, start in the text, words) of the stretches of a batch."""
    h = w.hash
    empty = np.zeros(0, np.int64)
    if len(h) < window:
        return empty, empty, empty, empty, empty
    g = grams(h, gram)
    # the upper half of the hash decides, then the place
    ranked = (g & ~U(0xFFFFFFFF)) | np.arange(len(g)).astype(U)
    place = (sliding_min(ranked, window - gram + 1) & U(0xFFFFFFFF)).astype(np.int64)
    valid = w.row[:len(place)] == w.row[window - 1:]
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (place[1:] != place[:-1])
    start = np.flatnonzero(new)
    bounds = np.flatnonzero(np.append(new | ~valid, True))
    n = bounds[np.searchsorted(bounds, start, side="right")] - start + window - 1
    body = range_hash(prefix_hash(h), start, start + n)
    row = w.row[start]
    return g[place[start]].view(np.int64), body.view(np.int64), row, start - w.first[row], n


def find_stretches(rows: DataFrame) -> DataFrame:
    def run(batches):
        for b in text_slices(batches):
            anchor, body, row, start, n = stretches(Words(*column_bytes(b.column("text"))))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor), pa.array(body), b.column("doc_id").take(take), b.column("th").take(take),
                 pa.array(start, pa.int32()), pa.array(n, pa.int32())],
                ["anchor", "body", "doc_id", "th", "start", "n"])

    return rows.select("doc_id", "th", "text").mapInArrow(run, STRETCH)


def fetch(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(anchor, body, low, words): word hashes of the wanted stretches (anchor, body, low, ref)."""
    lists = (wanted.select("anchor", "body", "low", "ref.*")
             .groupBy(F.col("doc_id").alias("kid"), "th")
             .agg(F.collect_list(F.struct("anchor", "body", "low", "start", "n")).alias("wanted")))

    def run(batches):
        for b in text_slices(batches):
            w = Words(*column_bytes(b.column("text")))
            h, out = w.hash.view(np.int64), []
            for i, got in enumerate(b.column("wanted").to_pylist()):
                first = int(w.first[i])
                out += [(x["anchor"], x["body"], x["low"], h[first + x["start"]:first + x["start"] + x["n"]])
                        for x in got]
            cols = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.list_(pa.int64()))],
                ["anchor", "body", "low", "words"])

    # a row that repeats would give its stretches again: equal rows are one
    return (rows.select(*KEY, "text").join(lists, KEY)
            .mapInArrow(run, "anchor long, body long, low long, words array<long>").dropDuplicates(["anchor", "body"]))


RESOLVED = "anchor long, body long, runs array<struct<at: int, n: int, low: long>>"
_RUNS = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32()), ("low", pa.int64())]))


def _runs(lows: list, window: int) -> list[dict]:
    """Runs of windows with the same smallest document: words at.. n and that document."""
    out = []
    for i, low in enumerate(lows):
        if out and out[-1]["low"] == low:
            out[-1]["n"] += 1
        else:
            out.append({"at": i, "n": window, "low": low})
    return out


def by_automaton(refs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Smallest documents of the windows of each stretch, anchor by anchor."""
    def solve(held: list[dict]) -> list[tuple]:
        automaton = SuffixAutomaton()
        for x in held:
            automaton.add(x["words"], x["low"])
        automaton.finish()
        return [(x["anchor"], x["body"], _runs([low for _, low in list(automaton.statistics(x["words"], window))
                                                [window - 1:]], window)) for x in held]

    def run(batches):
        held, out = [], []
        for b in batches:
            for x in b.to_pylist():
                if held and held[0]["anchor"] != x["anchor"]:
                    out += solve(held)
                    held = []
                held.append(x)
            yield _resolved(out)
            out = []
        if held:
            yield _resolved(solve(held))

    return dealt(refs, "anchor").mapInArrow(run, RESOLVED)


def _resolved(found: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*found)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                                       pa.array(cols[2], _RUNS)], ["anchor", "body", "runs"])


def by_counting(refs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The same for anchors with many stretches: windows by hash (beside the anchor's own 64 bits)."""

    def run(batches):
        for b in batches:
            for x in b.to_pylist():
                g = grams(np.array(x["words"], np.int64).view(U), window).view(np.int64)
                n = len(g)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[c]] * n, pa.int64()) for c in ("anchor", "body", "low")]
                    + [pa.array(np.arange(n), pa.int32()), pa.array(g)], ["anchor", "body", "low", "at", "key"])

    each = refs.mapInArrow(run, "anchor long, body long, low long, at int, key long")
    least = each.groupBy("anchor", "key").agg(F.min("low").alias("least"))
    return (each.drop("low").join(least, ["anchor", "key"])
            .select("anchor", "body", F.array(F.struct("at", F.lit(window).alias("n"), F.col("least").alias("low")))
                    .cast("array<struct<at: int, n: int, low: long>>").alias("runs")))


def duplicate_spans(rows: DataFrame, shard: int = SHARD) -> DataFrame:
    """(kid, th, spans): word ranges (start, n) of each document that an earlier document has."""
    found = stored(find_stretches(rows.where("doc_id is not null")), "stretches")
    anchors = (found.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"),
                                           F.min("body").alias("b1"), F.max("body").alias("b2"))
               .where("lo < hi").select("anchor", "lo", (F.col("b1") == F.col("b2")).alias("one")))
    anchors = stored(anchors, "anchors")       # so that a hot anchor's rows can be split in the join
    shared = stored(found.join(anchors, "anchor"), "shared")
    same = shared.where("one and doc_id > lo").select("doc_id", "th", "start", "n")
    several = shared.where("not one")
    bodies = several.groupBy("anchor", "body").agg(
        F.min("doc_id").alias("low"), F.min(F.struct("doc_id", "th", "start", "n")).alias("ref"))
    refs = stored(fetch(rows, bodies), "references")
    large = refs.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > shard).select("anchor")
    large = stored(large, "large")
    solved = by_automaton(refs.join(large, "anchor", "left_anti"))
    if not large.isEmpty():
        solved = solved.unionByName(by_counting(refs.join(large, "anchor", "left_semi")))
    runs = solved.select("anchor", "body", F.explode("runs").alias("r")).select("anchor", "body", "r.*")
    parts = (several.select("anchor", "body", "doc_id", "th", "start")
             .join(runs, ["anchor", "body"]).where("low < doc_id")
             .select("doc_id", "th", (F.col("start") + F.col("at")).alias("start"), "n"))
    return (same.unionByName(parts).groupBy(F.col("doc_id").alias("kid"), "th")
            .agg(F.collect_list(F.struct("start", "n")).alias("spans")))


def _kept(b: pa.RecordBatch):
    """For each text of a batch: its words as bytes and which of them stay."""
    w = Words(*column_bytes(b.column("text")))
    raw = w.data.tobytes()
    starts, ends = w.start.tolist(), w.end.tolist()
    for i, spans in enumerate(b.column("spans").to_pylist()):
        lo, hi = int(w.first[i]), int(w.first[i + 1])
        words = [raw[s:e] for s, e in zip(starts[lo:hi], ends[lo:hi])]
        if spans:
            gone = cover(hi - lo, np.array([x["start"] for x in spans]), np.array([x["n"] for x in spans]))
            yield len(words), [x for x, g in zip(words, gone.tolist()) if not g]
        else:
            yield len(words), words


def remove_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without the words of repeated passages; what stays is joined by one space."""
    rows = pick(docs)
    joined = pick(docs, keep_row=True).join(duplicate_spans(rows), KEY, "left")

    def run(batches):
        for b in text_slices(batches):
            texts = b.column("text").to_pylist()
            texts = [b" ".join(kept).decode() if len(kept) < n else t for (n, kept), t in zip(_kept(b), texts)]
            yield appended(b, ["row"], cleaned=pa.array(texts, pa.string()))

    cleaned = joined.select("row", "text", "spans").mapInArrow(run, ddl(joined, ["row"], "cleaned string"))
    row = F.col("row")
    return cleaned.select(*[F.when(row.getField(c).isNotNull(), F.col("cleaned")).alias(c) if c == "text"
                            else row.getField(c).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: words removed from every document, and a digest of those kept."""
    rows = pick(read(spark, sf_dir, "documents"))
    joined = rows.join(duplicate_spans(rows), KEY, "left").select("doc_id", "text", "spans")

    def run(batches):
        for b in text_slices(batches):
            total, removed, shas = [], [], []
            for n, kept in _kept(b):
                total.append(n)
                removed.append(n - len(kept))
                shas.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield appended(b, ["doc_id"], n_words=pa.array(total, pa.int64()), n_removed=pa.array(removed, pa.int64()),
                           kept_sha256=pa.array(shas, pa.string()))

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")
