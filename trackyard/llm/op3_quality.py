"""Quality by hierarchical empirical Bayes over sites.

A logistic classifier on measures of form (shares of symbols, capitals, repeated words and
lines, lengths) gives each document's evidence.  Documents lie on paths of hosts.  Host and
path means of the evidence are shrunk: a path's Beta prior is its host's posterior, a host's
is the global mean, and the strengths of both priors are estimated from the spread of the
group means (method of moments), so sparse sites move toward the level above.  A document's
score adds its own evidence (log odds against the base rate) to the log odds of its path,
in which its own part is left out.

In the ``documents`` table ``source`` is the host and ``lang`` the path below it.  The
classifier is fitted on at most ``TRAIN_ROWS`` labelled rows (first in hash order) whose
crc32 of the id mod 5 is not 0; all statistics of sites cover all rows.

NULL texts are empty; NULL hosts and paths are a group of their own; NULL ids and labels are
no evidence, and several labels of an id count as their minimum.  Without labels of both kinds
every document's evidence is the base rate.  Repeated rows each count and get a result;
empty tables give no rows.
Very long texts are read whole.  Ties: every row is scored by itself; of several texts of one training id an arbitrary
one is learned from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackyard.llm.common import (U, Words, appended, column_bytes, ddl, held_out, logistic, mix, pick, read, sigmoid,
                                  stored, text_slices)

TRAIN_ROWS = 30_000

FORM = ["log_words", "word_length", "symbol_share", "bar_share", "bang_share", "capital_share", "digit_share",
        "other_share", "short_share", "repeat_share", "distinct_share", "stop_share", "line_words", "dup_line_share"]

_CLASS = np.zeros((256, 6), bool)      # symbol, bar, bang, capital, digit, letter
_CLASS[list(b"#*$%&<>@^~=_{}[]\\"), 0] = True
_CLASS[ord("|"), 1] = True
_CLASS[ord("!"), 2] = True
_CLASS[0x41:0x5B, 3] = True
_CLASS[0x30:0x3A, 4] = True
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)], 5] = True


def form(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Values of ``FORM`` of each text of a batch."""
    rows, w = len(offs) - 1, Words(data, offs)
    span = np.maximum(np.diff(offs), 1)
    per = lambda x: (np.concatenate(([0], np.cumsum(x)))[offs[1:]] - np.concatenate(([0], np.cumsum(x)))[offs[:-1]])
    symbol, bar, bang, capital, digit, letter = (per(_CLASS[data, k]) for k in range(6))
    words = np.maximum(w.counts, 1)
    length = w.end - w.start
    sums = lambda at, x=None: np.bincount(at, x, rows)
    h = w.hash
    twice = np.zeros(len(h), bool)
    twice[1:] = (h[1:] == h[:-1]) & (w.row[1:] == w.row[:-1])
    pair = mix(h + w.row.astype(U) * U(0x9E3779B97F4A7C15))
    distinct = sums(w.row[np.unique(pair, return_index=True)[1]])
    last = w.data[np.maximum(w.end - 1, 0)] if len(w.end) else np.zeros(0, np.uint8)
    lines = per(data == 0x0A) + 1
    # lines by the hash of their first words: equal starts are nearly always equal lines
    begins = np.ones(len(h), bool)
    breaks = np.concatenate(([0], np.cumsum(data == 0x0A)))
    begins[1:] = (breaks[w.start[1:]] != breaks[w.start[:-1]]) | (w.row[1:] != w.row[:-1])
    at = np.flatnonzero(begins)
    after = np.append(at[1:], len(h))
    key = pair[at] + mix(pair[np.minimum(at + 1, np.maximum(after - 1, 0))]) if len(at) else pair[:0]
    first = np.zeros(len(at), bool)
    first[np.unique(key, return_index=True)[1]] = True
    again = sums(w.row[at[~first]], (after - at)[~first])
    return np.column_stack([
        np.log1p(w.counts), sums(w.row, length) / words, symbol / words, bar / words, bang / words,
        capital / np.maximum(letter, 1), digit / span, (span - letter) / span, sums(w.row[length <= 3]) / words,
        sums(w.row[twice]) / words, distinct / words, sums(w.row[(last == 0x2E) | (last == 0x2C)]) / words,
        w.counts / lines / 50, again / words])


class Classifier:
    def __init__(self, weights: np.ndarray, mean: np.ndarray, scale: np.ndarray, base: float):
        self.weights, self.mean, self.scale, self.base = weights, mean, scale, base

    def evidence(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(x), self.base)
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        return sigmoid(self._terms(x) @ self.weights[:-1] + self.weights[-1])

    @staticmethod
    def _terms(x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.minimum(x * x, 16)])

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> "Classifier":
        if not len(y) or y.min() == y.max():
            return cls(np.zeros(0), np.zeros(0), np.ones(0), float(np.mean(y)) if len(y) else 0.5)
        mean, scale = x.mean(0), x.std(0) + 1e-6
        z = np.clip((x - mean) / scale, -8, 8)
        return cls(logistic(cls._terms(z), y), mean, scale, float(y.mean()))


def training(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> Classifier:
    ids = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
           .where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out("doc_id", 5, 0))
           .groupBy("doc_id").agg(F.min("quality").alias("quality"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound))

    def run(batches):
        for b in text_slices(batches):
            x = form(*column_bytes(b.column("text")))
            yield appended(b, ["doc_id", "quality"], x=pa.array(x.tolist(), pa.list_(pa.float64())))

    rows = pick(docs).select("doc_id", "text").join(F.broadcast(ids), "doc_id")      # at most `bound` short rows
    # measures of at most `bound` documents (more only if ids repeat)
    got = rows.mapInArrow(run, ddl(rows, ["doc_id", "quality"], "x array<double>")).dropDuplicates(["doc_id"]) \
              .orderBy("doc_id").collect()
    return Classifier.fit(np.array([r["x"] for r in got]).reshape(-1, len(FORM)), np.array([r["quality"] for r in got], float))


def with_evidence(df: DataFrame, model: Classifier, keep: list[str]) -> DataFrame:
    """The kept columns of ``df`` (which has ``text``) with ``p``, the classifier's probability."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in text_slices(batches):
            p = shared.value.evidence(form(*column_bytes(b.column("text"))))
            yield appended(b, keep, p=pa.array(np.clip(p, 1e-6, 1 - 1e-6)))

    return df.mapInArrow(run, ddl(df, keep, "p double"))


def _strength(groups: DataFrame, mean) -> float:
    """Strength of a Beta prior from the spread of group means around ``mean`` (method of moments)."""
    n, s = F.col("n").cast("double"), F.col("k") / F.col("n")
    r = groups.agg(F.sum(n).alias("n"), F.sum(n * (s - mean) * (s - mean)).alias("between"),
                   F.sum(n * mean * (1 - mean)).alias("within"), F.count(F.lit(1)).alias("groups")).first()
    if not r["n"] or r["groups"] < 2 or not r["between"]:
        return 1e6
    # weighted variance of means = q (1/n_avg + 1/(1 + strength)), solved for the strength
    ratio = r["between"] / r["within"] if r["within"] else 1.0
    rho = ratio - r["groups"] / r["n"]
    return float(min(1e6, max(1.0, 1 / rho - 1))) if rho > 1e-6 else 1e6


def posteriors(scored: DataFrame) -> tuple[DataFrame, float]:
    """((host, path, n, k, prior, strength, host_posterior, path_posterior), global mean) by grouped aggregation."""
    paths = scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("k"))
    paths = stored(paths, "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = hosts.agg(F.sum("k").alias("k"), F.sum("n").alias("n")).first()
    mean = float(total["k"] / total["n"]) if total["n"] else 0.5
    m = _strength(hosts, F.lit(mean))
    hosts = hosts.select(F.col("host").alias("h"),
                         ((F.col("k") + m * mean) / (F.col("n") + m)).alias("host_posterior"))
    paths = stored(paths.join(hosts, paths["host"].eqNullSafe(hosts["h"])).drop("h"), "paths")
    m2 = _strength(paths, F.col("host_posterior"))
    return paths.select("host", "path", "n", "k", "host_posterior", F.lit(m2).alias("strength"),
                        ((F.col("k") + m2 * F.col("host_posterior")) / (F.col("n") + m2)).alias("path_posterior")), mean


def _logit(p):
    p = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))
    return F.log(p / (1 - p))


def quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """(doc_id, evidence, host_posterior, path_posterior, score) of every row."""
    model = training(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                       F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"))
    scored = stored(with_evidence(rows, model, ["doc_id", "host", "path"]), "evidence")
    sites, mean = posteriors(scored)
    sites = sites.select(F.col("host").alias("h"), F.col("path").alias("q"), "n", "k", "strength", "host_posterior",
                         "path_posterior")
    joined = scored.join(sites, scored["host"].eqNullSafe(sites["h"]) & scored["path"].eqNullSafe(sites["q"]))
    others = ((F.col("k") - F.col("p") + F.col("strength") * F.col("host_posterior"))
              / (F.col("n") - 1 + F.col("strength")))
    z = _logit(F.col("p")) - _logit(F.lit(mean)) + _logit(others)
    return joined.select("doc_id", F.col("p").alias("evidence"), "host_posterior", "path_posterior",
                         (1 / (1 + F.exp(-z))).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: quality score of every document; ``kept`` if it is 0.5 or more."""
    found = quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "evidence", "host_posterior",
                        "path_posterior", "score", (F.col("score") >= 0.5).alias("kept"))
