"""Toxicity by a weighted finite-state pattern grammar.

A text is cut into clauses and each word gets a class: insult, threat, target, negation,
reported speech or other.  Small transducers mark insults and threats that stand under a
negation, in reported speech or near a target; they are composed into one, which reads each
clause that has an insult or a threat.  A document is scored from the weighted sums and
maxima of its matched clauses, not from isolated words.

The function words are fixed; the insult lexicon (whole words and stems that end in ``*``)
and all weights are learned from labelled rows: those of the ``TRAIN_ROWS`` training ids
that come first in hash order, near copies among them taken once.  Labels of held-out rows
(crc32 of the id mod 5 is 0) are never read, and only the text enters a score.

NULL texts are empty and get a score like any text without matches.  Several labels of an id
count as their maximum; NULL labels and ids are no evidence.  With no labelled row of either
kind every score is the share of toxic rows (0 without labels).  Repeated rows are each
scored; empty tables give no rows; other columns are not read.
Very long texts are read whole.  At most the ``LEXICON`` strongest entries of the training sample are kept.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackyard.llm.common import (Words, appended, column_bytes, ddl, grams, held_out, logistic, pick, read, sigmoid,
                                  stored, text_slices, unpick)

TRAIN_ROWS = 30_000
LEXICON = 50_000        # entries at most; the strongest are kept
STEMS = (4, 5, 6, 7)    # letters of a stem
TOKEN = re.compile(r"[^\W\d_]+|[.!?;:,\n\"“”«»]")
ENDS = frozenset(".!?;:,\n")
QUOTES = frozenset("\"“”«»")

# Function words of the grammar (fixed values: English, German, French, Spanish).
TARGET = frozenset("""you your yours u he him his she her they them du dich dir dein ihr euch er sie tu toi vous vos
il elle ils tú ti usted ustedes él ella ellos""".split())
NEGATION = frozenset("not no never nor without nicht kein keine nie ohne pas jamais ni sans nunca ni sin tampoco".split())
REPORT = frozenset("""said says say called calls claimed quote quoted wrote sagte sagt nannte schrieb dit disait écrit
appelé dijo dice llamó escribió""".split())
THREAT = frozenset("""kill kills murder hurt beat destroy burn shoot strangle töten umbringen schlagen vernichten
tuer frapper détruire brûler matar golpear destruir quemar""".split())


class Transducer:
    """A finite-state transducer: (state, symbol) -> (state, symbol); state 0 is the first.

    Symbols are (base, marks): the word's class and the marks that earlier transducers set.
    """

    def __init__(self, arcs: dict, states: int):
        self.arcs, self.states = arcs, states

    def then(self, other: "Transducer") -> "Transducer":
        """Composition: ``other`` reads what this one writes."""
        arcs = {}
        for (s, symbol), (s2, mid) in self.arcs.items():
            for t in range(other.states):
                if (t, mid) in other.arcs:
                    t2, out = other.arcs[t, mid]
                    arcs[s * other.states + t, symbol] = (s2 * other.states + t2, out)
        return Transducer(arcs, self.states * other.states)

    def read(self, symbols: list) -> list:
        state, out = 0, []
        for s in symbols:
            state, o = self.arcs[state, s]
            out.append(o)
        return out


BASES = "OITYNR"        # other, insult, threat, target, negation, report


def _marker(trigger: str, mark: str, reach: int | None) -> Transducer:
    """Marks insults and threats up to ``reach`` words (None: to the clause's end) after a trigger."""
    states, arcs = (reach or 1) + 1, {}
    marks = ["".join(m) for m in ("", "n", "r", "t", "nr", "nt", "rt", "nrt")]
    for s in range(states):
        for base in BASES:
            for m in marks:
                out = "".join(sorted({*m, mark})) if s and base in "IT" else m
                nxt = states - 1 if base == trigger else (s if reach is None else max(0, s - 1))
                arcs[s, (base, m)] = (nxt, (base, out))
    return Transducer(arcs, states)


GRAMMAR = _marker("N", "n", 3).then(_marker("R", "r", None)).then(_marker("Y", "t", 5))

FEATURES = ["best", "sum", "count", "targeted", "negated", "reported", "threats", "threat_at_target"]


class Lexicon:
    """Learned insult weights of words and stems; classes of words through a bounded memo."""

    def __init__(self, weights: dict[str, float]):
        self.weights, self.memo = weights, {}
        self.lengths = sorted({len(k) - 1 for k in weights if k.endswith("*")}, reverse=True)

    def __getstate__(self):
        return self.weights

    def __setstate__(self, weights):
        self.__init__(weights)

    def classify(self, word: str) -> tuple[str, float]:
        got = self.memo.get(word)
        if got is None:
            got = self._classify(word)
            if len(self.memo) >= 300_000:
                self.memo.clear()
            self.memo[word] = got
        return got

    def _classify(self, word: str) -> tuple[str, float]:
        if (w := self.weights.get(word)) is not None:
            return "I", w
        for base, words in (("T", THREAT), ("Y", TARGET), ("N", NEGATION), ("R", REPORT)):
            if word in words:
                return base, 0.0
        for k in self.lengths:
            if len(word) > k and (w := self.weights.get(word[:k] + "*")) is not None:
                return "I", w
        return ("E" if word in ENDS else "Q" if word in QUOTES else "O"), 0.0


def features(text: str, lexicon: Lexicon) -> list[float]:
    """Values of ``FEATURES`` for one text."""
    tokens = list(map(lexicon.classify, TOKEN.findall(text.lower())))
    out = dict.fromkeys(FEATURES, 0.0)
    if not any(base in "IT" for base, _ in tokens):
        return list(out.values())
    clause, quoted = [], False
    for token in [*tokens, ("E", 0.0)]:
        base = token[0]
        if base == "Q":
            quoted = not quoted
            token = ("R", 0.0) if quoted else ("O", 0.0)
        if base != "E":
            clause.append(token)
            continue
        if any(b in "IT" for b, _ in clause):
            read = GRAMMAR.read([(b, "") for b, _ in clause])
            # targets after the word: the same grammar from the right
            back = GRAMMAR.read([(b, "") for b, _ in reversed(clause)])[::-1]
            for (b, marks), (_, after), (_, weight) in zip(read, back, clause):
                near = "t" in marks or "t" in after
                if b == "I":
                    kind = "negated" if "n" in marks else "reported" if "r" in marks else "sum"
                    out[kind] += weight
                    out["count"] += 1
                    out["best"] = max(out["best"], weight)
                    out["targeted"] += weight * near
                elif b == "T" and "n" not in marks and "r" not in marks:
                    out["threats"] += 1
                    out["threat_at_target"] += near
        clause = []
    return [float(np.log1p(v)) for v in out.values()]


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray, share: float = 0.0):
        self.lexicon, self.weights, self.share = lexicon, weights, share

    def score(self, texts: list[str]) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(texts), self.share)
        x = np.array([features(t, self.lexicon) for t in texts]).reshape(len(texts), len(FEATURES))
        return sigmoid(x @ self.weights[:-1] + self.weights[-1])


def _terms(text: str) -> set[str]:
    words = {w for w in TOKEN.findall(text.lower()) if w not in ENDS and w not in QUOTES}
    return words | {w[:k] + "*" for w in words for k in STEMS if len(w) > k}


def _counts(rows: DataFrame, label: int, only: set[str] | None = None) -> DataFrame:
    """(term, n): documents of one label that have the term; combined in each task before the shuffle."""
    shared = rows.sparkSession.sparkContext.broadcast(only)

    def run(batches):
        known, n = shared.value, {}
        for b in batches:
            for text in b.column("text").to_pylist():
                terms = _terms(text)
                for t in terms if known is None else terms & known:
                    n[t] = n.get(t, 0) + 1
            if len(n) > 500_000:
                yield pa.RecordBatch.from_pydict({"term": list(n), "n": list(n.values())})
                n = {}
        yield pa.RecordBatch.from_pydict({"term": pa.array(n.keys(), pa.string()), "n": pa.array(n.values(), pa.int64())})

    return (rows.where(F.col("toxic") == label).select("text").mapInArrow(run, "term string, n long")
            .groupBy("term").agg(F.sum("n").alias("n")))


def training_rows(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> DataFrame:
    """(text, toxic) of at most ``bound`` labelled rows outside the held-out part, near copies once."""
    ids = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
           .where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id", 5, 0))
           .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound))

    def sketch(batches):
        for b in text_slices(batches):
            w = Words(*column_bytes(b.column("text")))
            g = grams(w.hash, 3)
            mins = np.zeros((3, b.num_rows), np.int64)
            for i, (lo, hi) in enumerate(zip(w.first[:-1], w.first[1:])):
                mine = g[lo:max(lo, hi - 2)]
                for k in range(3):
                    x = np.sort(mine * np.uint64((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)[k]))
                    mins[k, i] = x[:1].view(np.int64)[0] if len(x) else zlib.crc32(b.column("text")[i].as_py().encode())
            yield appended(b, ["doc_id", "text", "toxic"], **{f"m{k}": pa.array(m) for k, m in enumerate(mins)})

    # at most `bound` short rows
    rows = pick(docs).select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    rows = stored(rows.mapInArrow(sketch, ddl(rows, ["doc_id", "text", "toxic"], "m0 long, m1 long, m2 long")), "sample")
    kept = rows.select("doc_id", "m0", "m1", "m2")
    for k in ("m0", "m1", "m2"):
        kept = kept.groupBy(k).agg(F.min(F.struct("doc_id", *[m for m in ("m0", "m1", "m2") if m != k])).alias("r")) \
                   .select(k, "r.*")
    return rows.join(F.broadcast(kept.select("doc_id").distinct()), "doc_id").select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> Model:
    rows = stored(training_rows(docs, labels, bound), "training")
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    if not pos or not neg:
        return Model(Lexicon({}), np.zeros(0), pos / max(1, pos + neg))
    base = pos / (pos + neg)
    # terms of three toxic rows at least: bounded by the sample
    often = {r["term"]: r["n"] for r in _counts(rows, 1).where(F.col("n") >= 3).collect()}
    clean = {r["term"]: r["n"] for r in _counts(rows, 0, set(often)).collect()}
    found, whole = [], {}
    for word, a in often.items():
        if not word.endswith("*"):
            for k in STEMS:
                whole[word[:k] + "*"] = max(a, whole.get(word[:k] + "*", 0))
    for term, a in often.items():
        b = clean.get(term, 0)
        share = a / (a + b)
        # a stem that stands for one word only says nothing about other words
        if share < 0.8 or term.endswith("*") and whole.get(term, 0) > 0.8 * a:
            continue
        # log likelihood ratio against the base rate, beyond what so many tries give by chance
        gain = a * np.log(share / base) + (b * np.log((1 - share) / (1 - base)) if b else 0.0)
        if gain > np.log(20 * len(often)):
            found.append((gain, term, float(np.log((a + 0.5) / (pos + 1)) - np.log((b + 0.5) / (neg + 1)))))
    found = sorted(found, reverse=True)[:LEXICON]
    lexicon = Lexicon({term: weight for _, term, weight in found})
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def table(batches):
        for b in batches:
            x = np.array([features(t, shared.value) for t in b.column("text").to_pylist()]).reshape(-1, len(FEATURES))
            # equal feature rows are summed: most rows have no match
            u, inv = np.unique(np.column_stack([x, b.column("toxic").to_numpy(zero_copy_only=False)]), axis=0,
                               return_inverse=True)
            yield pa.RecordBatch.from_pydict({"x": u.tolist(), "n": np.bincount(inv.ravel(), minlength=len(u))})

    got = (rows.mapInArrow(table, "x array<double>, n long").groupBy("x").agg(F.sum("n").alias("n"))
           .orderBy("x").collect())                       # at most `bound` rows of a few numbers
    x = np.repeat(np.array([r["x"] for r in got]), [r["n"] for r in got], axis=0)
    return Model(lexicon, logistic(x[:, :-1], x[:, -1]))


def scored(df: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The kept columns of ``df`` (which has ``text``) with ``score`` (0 to 1)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in text_slices(batches):
            yield appended(b, keep, score=pa.array(shared.value.score([t or "" for t in b.column("text").to_pylist()])))

    return df.mapInArrow(run, ddl(df, keep, "score double"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold."""
    found = scored(pick(docs, keep_row=True), fit(docs, labels), ["row"])
    return unpick(found.where(F.col("score") < threshold), docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: toxicity score of every document."""
    docs = read(spark, sf_dir, "documents")
    found = scored(pick(docs), fit(docs, read(spark, sf_dir, "labels")), ["doc_id"])
    return found.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score",
                        (F.col("score") >= 0.5).cast("int").alias("predicted"))
