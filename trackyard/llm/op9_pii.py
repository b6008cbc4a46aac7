"""PII: patterns, and an information-theoretic test of the terms around them.

E-mail addresses, IP addresses, card and phone numbers are found by pattern; each value is a
protected entity e.  A term t near a mention of e discloses it as far as t's presence makes
e likelier: PMI(t; e) = log2 P(e | t) / P(e), of at most IC(e) = -log2 P(e).  Probabilities
are document frequencies over the whole corpus.  A term seen with e in ``SUPPORT`` or more
different contexts whose PMI reaches ``DISCLOSED`` of IC(e) is protected as well, wherever
it stands in a context of e.  ``sanitise`` generalises spans to their kind or removes them.

Copies of one context are one piece of evidence, so copied documents alone disclose nothing.

NULL texts are empty.  Every row counts as a document, and repeated rows get a result each.
A NULL doc_id stays NULL.  Empty tables give no rows.  Very long texts and words are read whole.  Ties: none
are possible, as every entity and term is judged by itself.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackyard.llm.common import (KEY, LOWER, U, Words, appended, column_bytes, ddl, pick, range_hash, prefix_hash, read,
                                  separators, span_digest, stored, text_slices, unpick)

CONTEXT = 8            # words on either side of a mention
SUPPORT = 2            # different contexts that term and entity must share
DISCLOSED = 0.9        # share of the entity's information that a term may not reach
SLOTS = 1 << 20        # places of the table that sorts out terms near no entity

KINDS = ("email", "ip", "card", "phone")
ORDER = {k: i for i, k in enumerate((*KINDS, "term"))}

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: terms are runs of ASCII letters and non-ASCII characters
TERM_ENDS = separators(*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80))
_TERM = re.compile(r"[A-Za-z\x80-\U0010ffff]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str):
    """Leftmost matches of the address pattern, found from their @ so that long runs cost no retries."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.fullmatch(text, start - 1, start):
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(end, at + 1))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points of all personal data found by pattern."""
    out = [("email", s, e) for s, e in emails(text)]
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(_byte(p) for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return sorted(out, key=lambda x: (x[1], ORDER[x[0]], x[2]))


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def term_hash(words: list[str]) -> np.ndarray:
    """The hashes that ``Words`` gives these words (lower-cased A-Z)."""
    if not words:
        return np.zeros(0, np.int64)
    raw = [LOWER[np.frombuffer(w.encode(), np.uint8)] for w in words]
    end = np.cumsum([len(r) for r in raw])
    start = end - [len(r) for r in raw]
    return range_hash(prefix_hash(np.concatenate(raw).astype(U) + U(1)), start, end).view(np.int64)


def contexts(text: str, spans: list[tuple[str, int, int]], width: int = CONTEXT) -> list[dict]:
    """For each mention: the entity, a hash of its context, and the terms in it with their places.

    The context is the last ``width`` terms before the mention and the first after it, however long they
    are; a term that the mention cuts counts as far as it lies outside, and one inside a mention not at all.
    """
    places = np.fromiter((x for m in _TERM.finditer(text) for x in m.span()), np.int64).reshape(-1, 2) if spans else None
    masked: list[list[int]] = []                       # the mentions, overlapping ones joined
    for s, e in sorted((s, e) for _, s, e in spans):
        if masked and s <= masked[-1][1]:
            masked[-1][1] = max(masked[-1][1], e)
        else:
            masked.append([s, e])
    begins = [s for s, _ in masked]
    hashes: dict[tuple[int, int], int] = {}

    def outside(a: int, b: int) -> bool:
        k = bisect.bisect_left(begins, b)              # the last mention that begins before b
        return not k or masked[k - 1][1] <= a

    out = []
    for kind, s, e in spans:
        before, after = np.searchsorted(places[:, 0], s, "left"), np.searchsorted(places[:, 1], e, "right")
        left = [(a, min(b, s)) for a, b in places[max(0, before - width):before].tolist()]
        right = [(max(a, e), b) for a, b in places[after:after + width].tolist()]
        terms = [(a, b) for a, b in left + right if outside(a, b)]
        if new := [t for t in terms if t not in hashes]:
            hashes.update(zip(new, term_hash([text[a:b] for a, b in new]).tolist()))
        h = np.array([hashes[t] for t in terms], np.int64)
        value = "".join(c for c in text[s:e].lower() if c.isalnum() or c in "@.")
        out.append({"entity": xxhash.xxh64_intdigest(f"{kind}:{value}".encode()) - (1 << 63),
                    "context": xxhash.xxh64_intdigest(h.tobytes()) - (1 << 63),
                    "terms": [{"term": int(t), "start": a, "end": b} for t, (a, b) in zip(h, terms)]})
    return out


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_PLACES = pa.list_(pa.struct([("term", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
_CONTEXTS = pa.list_(pa.struct([("entity", pa.int64()), ("context", pa.int64()), ("terms", _PLACES)]))
SPANS = "array<struct<kind: string, start: long, end: long>>"
FOUND = (f"base {SPANS}, contexts array<struct<entity: long, context: long, "
         "terms: array<struct<term: long, start: long, end: long>>>>")


def find_base(df: DataFrame, keep: list[str]) -> DataFrame:
    def run(batches):
        for b in text_slices(batches):
            base, near = [], []
            for text in b.column("text").to_pylist():
                spans = base_spans(text or "")
                base.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
                near.append(contexts(text, spans) if spans else [])
            yield appended(b, keep, base=pa.array(base, _SPANS), contexts=pa.array(near, _CONTEXTS))

    return df.mapInArrow(run, ddl(df, keep, FOUND))


def document_frequencies(docs: DataFrame, slots: np.ndarray) -> DataFrame:
    """(term, n): documents with the term, for terms whose slot is set; combined in each task."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(slots))

    def run(batches):
        wanted = np.unpackbits(shared.value).astype(bool)
        for b in text_slices(batches, 16 << 20):
            parts = []
            for c in text_slices([b]):
                data, offs = column_bytes(c.column("text"))
                w = Words(LOWER[data], offs, TERM_ENDS)
                h = w.hash
                hit = wanted[h & U(SLOTS - 1)]
                pairs = np.unique(np.rec.fromarrays([w.row[hit], h[hit]]))
                parts.append(pairs["f1"])
            terms, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n)], ["term", "n"])

    return docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def disclosing(found: DataFrame, docs: DataFrame, support: int = SUPPORT, share: float = DISCLOSED) -> DataFrame:
    """(entity, term) pairs whose PMI reaches ``share`` of the entity's information."""
    mentions = (found.select("rid", F.explode("contexts").alias("c"))
                .select("rid", "c.entity", "c.context", F.explode("c.terms.term").alias("term")))
    pairs = (mentions.groupBy("entity", "term", "context").agg(F.count(F.lit(1)))
             .groupBy("entity", "term").agg(F.count(F.lit(1)).alias("contexts"))
             .where(F.col("contexts") >= support).select("entity", "term"))
    pairs = stored(pairs, "pairs")
    slots = np.zeros(SLOTS, bool)
    # at most SLOTS numbers
    slots[[r[0] for r in pairs.select(F.col("term").bitwiseAND(SLOTS - 1).alias("s")).distinct().collect()]] = True
    term_n = document_frequencies(docs, slots)
    both_n = (mentions.join(pairs, ["entity", "term"]).groupBy("entity", "term", "rid").agg(F.count(F.lit(1)))
              .groupBy("entity", "term").agg(F.count(F.lit(1)).alias("both")))
    entity_n = (found.select("rid", F.explode("contexts.entity").alias("entity")).groupBy("entity", "rid")
                .agg(F.count(F.lit(1))).groupBy("entity").agg(F.count(F.lit(1)).alias("e")))
    total = max(2, found.count())
    pmi = F.log2(F.lit(float(total)) * F.col("both") / (F.col("n") * F.col("e")))
    ic = -F.log2(F.col("e") / F.lit(float(total)))
    return (both_n.join(entity_n, "entity").join(term_n, "term")
            .where((ic > 0) & (pmi >= share * ic)).select("entity", "term"))


def protected(docs: DataFrame, keep_row: bool = False) -> tuple[DataFrame, DataFrame]:
    """(base findings per row, term spans per row key) of all documents."""
    rows = pick(docs)
    found = stored(find_base(rows, ["doc_id", *KEY]).withColumn("rid", F.monotonically_increasing_id()), "pii")
    pairs = stored(disclosing(found, rows.select("text")), "disclosing")
    places = (found.select(*KEY, F.explode("contexts").alias("c"))
              .select(*KEY, "c.entity", F.explode("c.terms").alias("t"))
              .select(*KEY, "entity", "t.term", "t.start", "t.end"))
    added = (places.join(pairs, ["entity", "term"])
             .groupBy(*KEY).agg(F.collect_set(F.struct(F.lit("term").alias("kind"), "start", "end")).alias("added")))
    return found, added


def sanitise(docs: DataFrame, how: str = "generalise") -> DataFrame:
    """The rows of ``docs`` with every protected span replaced by its kind in brackets, or removed."""
    if how not in ("generalise", "remove"):
        raise ValueError("how must be 'generalise' or 'remove'")
    found, added = protected(docs)
    spans = (found.dropDuplicates(KEY).join(added, KEY, "left")
             .select(*KEY, F.concat("base", F.coalesce("added", F.array().cast(SPANS))).alias("spans"))
             .where(F.size("spans") > 0))
    joined = pick(docs, keep_row=True).join(spans, KEY, "left")

    def run(batches):
        for b in text_slices(batches):
            texts = b.column("text").to_pylist()
            for i, got in enumerate(b.column("spans").to_pylist()):
                if not got:
                    continue
                out, end = [], 0
                for x in sorted(got, key=lambda x: (x["start"], -x["end"], ORDER[x["kind"]])):
                    if x["start"] >= end:
                        out += [texts[i][end:x["start"]], f"[{x['kind']}]" if how == "generalise" else ""]
                    end = max(end, x["end"])
                texts[i] = "".join(out) + texts[i][end:]
            yield appended(b, ["row"], cleaned=pa.array(texts, pa.string()))

    cleaned = joined.select("row", "text", "spans").mapInArrow(run, ddl(joined, ["row"], "cleaned string"))
    row = F.col("row")
    return cleaned.select(*[F.when(row.getField(c).isNotNull(), F.col("cleaned")).alias(c) if c == "text"
                            else row.getField(c).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: personal data in every document."""
    found, added = protected(read(spark, sf_dir, "documents"))
    rows = found.join(added, KEY, "left").select("doc_id", "base", "added")

    def run(batches):
        for b in batches:
            counts, shas, spans = {k: [] for k in KINDS}, [], []
            for base, more in zip(b.column("base").to_pylist(), b.column("added").to_pylist()):
                base = [(x["kind"], x["start"], x["end"]) for x in base]
                for k in KINDS:
                    counts[k].append(sum(x[0] == k for x in base))
                shas.append(hashlib.sha256(span_digest(base, ORDER).encode()).hexdigest())
                spans.append(span_digest(base + [(x["kind"], x["start"], x["end"]) for x in more or []], ORDER))
            yield appended(b, ["doc_id"], **{f"n_{k}": pa.array(v, pa.int64()) for k, v in counts.items()},
                           base_sha256=pa.array(shas, pa.string()), spans=pa.array(spans, pa.string()))

    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS)
                           + ", base_sha256 string, spans string")
