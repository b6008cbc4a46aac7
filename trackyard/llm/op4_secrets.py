"""Secret scan through a trigram index.

Each rule is a regular expression.  From its parse tree a Boolean query over trigrams is
derived that every text with a match satisfies.  A segment of documents (one slice of a
task's batch) is indexed: the trigrams that any query names get postings, the ids of the
segment's texts that have them, in lower case.  A rule's query is evaluated by intersecting
and uniting postings; only candidates are verified with the rule itself.  Rules without a
mandatory trigram scan the whole segment.  Nothing is shuffled.

Matches are leftmost and non-overlapping per rule; those that fail the rule's length test
are dropped.  NULL texts are empty; a NULL doc_id stays NULL; repeated rows get a result
each; an empty table gives no rows; other columns are not read.
Very long texts are read whole; a task needs memory in proportion to the longest one.  Ties: spans that begin
together are listed in the order of their kinds.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product
from re import _constants as C
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from trackyard.llm.common import LOWER, appended, column_bytes, ddl, pick, read, span_digest, text_slices


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    flags: int = re.ASCII
    holds: Callable[[re.Match], bool] | None = None
    group: int = 0          # the part of a match that is the secret


def _long(n: int, group: int = 0) -> Callable[[re.Match], bool]:
    def test(m: re.Match) -> bool:
        return m.end(group) - m.start(group) >= n
    return test


BASE_KINDS = ("assign", "access", "hex")
#: The three base rules (fixed), then those that the scan adds.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         re.ASCII | re.IGNORECASE, _long(6, 2)),
    Rule("access", r"AKIA[A-Z0-9]+", holds=_long(20)),
    Rule("hex", r"[0-9a-f]+", holds=_long(24)),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("hosting_token", r"gh[pousr]_[A-Za-z0-9]+", holds=_long(40)),
    # the first eyJ of a run of token characters decides; runs are entered at their start only, so each is read once
    Rule("web_token", r"(?<![A-Za-z0-9_-])(?:(?!eyJ)[A-Za-z0-9_-])*+"
                      r"(eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]++)", group=1),
)
ORDER = {r.kind: i for i, r in enumerate(RULES)}

# Boolean queries: a trigram, ("and", ...), ("or", ...); ANY holds for every text.
ANY = ("and",)
MOST = 64              # strings in a set before it is given up


def both(*queries):
    parts = []
    for q in queries:
        for p in (q[1:] if q[0] == "and" else (q,)):
            if p not in parts:
                parts.append(p)
    return parts[0] if len(parts) == 1 else ("and", *parts)


def either(*queries):
    if any(q == ANY for q in queries):
        return ANY
    parts = list(dict.fromkeys(queries))
    return parts[0] if len(parts) == 1 else ("or", *parts)


def contains(strings: set[str]):
    """Texts with one of the strings in them."""
    if not strings or min(map(len, strings)) < 3:
        return ANY
    return either(*(both(*(("tri", s[i:i + 3]) for i in range(len(s) - 2))) for s in sorted(strings)))


@dataclass
class Info:
    """Of a part of a pattern: all its strings if few, else what they begin and end with; and a query."""

    exact: set[str] | None
    prefix: set[str]
    suffix: set[str]
    query: tuple

    def inexact(self) -> "Info":
        if self.exact is None:
            return self
        return Info(None, {s[:4] for s in self.exact}, {s[-4:] for s in self.exact}, contains(self.exact))


UNKNOWN = Info(None, {""}, {""}, ANY)


def _cross(a: set[str], b: set[str]) -> set[str] | None:
    return {x + y for x, y in product(a, b)} if len(a) * len(b) <= MOST else None


def _concat(a: Info, b: Info) -> Info:
    if a.exact is not None and b.exact is not None and (all_ := _cross(a.exact, b.exact)) is not None:
        return Info(all_, all_, all_, ANY)
    bridge = _cross(a.exact or a.suffix, b.exact or b.prefix)
    prefix = _cross(a.exact, b.exact or b.prefix) if a.exact else a.prefix
    suffix = _cross(a.exact or a.suffix, b.exact) if b.exact else b.suffix
    query = both(a.inexact().query, b.inexact().query, contains(bridge) if bridge else ANY)
    return Info(None, {s[:4] for s in prefix or {""}}, {s[-4:] for s in suffix or {""}}, query)


def _union(a: Info, b: Info) -> Info:
    if a.exact is not None and b.exact is not None and len(a.exact | b.exact) <= MOST:
        return Info(a.exact | b.exact, a.exact | b.exact, a.exact | b.exact, ANY)
    a, b = a.inexact(), b.inexact()
    return Info(None, a.prefix | b.prefix, a.suffix | b.suffix, either(a.query, b.query))


def _exactly(strings: set[str]) -> Info:
    return Info(strings, strings, strings, ANY)


def _members(items) -> set[str] | None:
    out = set()
    for op, value in items:
        if op is C.LITERAL:
            out.add(chr(value).lower())
        elif op is C.RANGE and value[1] - value[0] < 16:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= 16 else None


def _analyse(tree) -> Info:
    info = _exactly({""})
    for op, arg in tree:
        if op is C.LITERAL:
            part = _exactly({chr(arg).lower()})
        elif op is C.IN:
            chars = _members(arg)
            part = _exactly(chars) if chars else UNKNOWN
        elif op is C.BRANCH:
            part = _analyse(arg[1][0])
            for other in arg[1][1:]:
                part = _union(part, _analyse(other))
        elif op is C.SUBPATTERN:
            part = _analyse(arg[-1])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, inner = arg
            one = _analyse(inner)
            part = _exactly({""})
            for _ in range(min(low, 4)):
                part = _concat(part, one)
            if high == 1 and low == 0:
                part = _union(part, one)
            elif high != low or low > 4:
                part = _concat(part, UNKNOWN)
        elif op is C.ATOMIC_GROUP:
            part = _analyse(arg)
        elif op is C.AT or op in (C.ASSERT, C.ASSERT_NOT):
            part = _exactly({""})
        else:
            part = UNKNOWN
        info = _concat(info, part)
    return info


def trigram_query(pattern: str, flags: int = 0):
    """A Boolean query over lower-case trigrams that every text with a match satisfies.

    Case is folded by A-Z alone, so non-ASCII patterns and Unicode case matching give no query.
    """
    flags = re.compile(pattern, flags).flags
    if not pattern.isascii() or flags & re.IGNORECASE and not flags & re.ASCII:
        return ANY
    return _analyse(parser.parse(pattern, flags)).inexact().query


def trigrams_of(query) -> set[str]:
    return {query[1]} if query[0] == "tri" else set().union(*map(trigrams_of, query[1:]))


def code(trigram: str) -> int:
    a, b, c = trigram.encode()
    return a << 16 | b << 8 | c


class Segment:
    """Postings of the wanted trigrams over the texts of one slice."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, wanted: np.ndarray):
        self.rows = len(offs) - 1
        self.postings: dict[int, np.ndarray] = {}
        if len(data) < 3 or not wanted.any():
            return
        low = LOWER[data]
        codes = low[:-2].astype(np.uint32) << np.uint32(16)
        codes |= low[1:-1].astype(np.uint32) << np.uint32(8)
        codes |= low[2:]
        at = np.flatnonzero(wanted[codes])
        row = np.searchsorted(offs, at, side="right") - 1
        inside = at + 2 < offs[row + 1]
        codes, row = codes[at[inside]], row[inside]
        order = np.argsort(codes, kind="stable")
        codes, row = codes[order], row[order]
        cut = np.flatnonzero(codes[1:] != codes[:-1]) + 1
        for mine, which in zip(np.split(row, cut), codes[np.concatenate(([0], cut))] if len(codes) else ()):
            self.postings[int(which)] = np.unique(mine)

    def find(self, query) -> np.ndarray:
        if query == ANY:
            return np.arange(self.rows)
        if query[0] == "tri":
            return self.postings.get(code(query[1]), np.zeros(0, np.int64))
        found = [self.find(q) for q in query[1:]]
        out = found[0]
        for other in found[1:]:
            out = np.intersect1d(out, other, assume_unique=True) if query[0] == "and" else np.union1d(out, other)
        return out


def _spans(rule: Rule, compiled: re.Pattern, text: str) -> list[tuple[str, int, int]]:
    return [(rule.kind, *m.span(rule.group)) for m in compiled.finditer(text) if rule.holds is None or rule.holds(m)]


def scan(df: DataFrame, keep: list[str], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The kept columns of ``df`` (which has ``text``) with the spans (code points) of all rules."""
    queries = [trigram_query(r.pattern, r.flags) for r in rules]

    def run(batches):
        compiled = [re.compile(r.pattern, r.flags) for r in rules]
        wanted = np.zeros(1 << 24, bool)
        wanted[[code(t) for q in queries for t in trigrams_of(q)]] = True
        for b in text_slices(batches):
            data, offs = column_bytes(b.column("text"))
            segment = Segment(data, offs, wanted)
            texts: dict[int, str] = {}
            found: list[list] = [[] for _ in range(b.num_rows)]
            for rule, pattern, query in zip(rules, compiled, queries):
                for i in segment.find(query).tolist():
                    if i not in texts:
                        texts[i] = data[offs[i]:offs[i + 1]].tobytes().decode()
                    found[i] += _spans(rule, pattern, texts[i])
            yield appended(b, keep, spans=pa.array(
                [[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in found],
                pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))))

    return df.mapInArrow(run, ddl(df, keep, "spans array<struct<kind: string, start: long, end: long>>"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: secrets in every document."""
    found = scan(pick(read(spark, sf_dir, "documents")), ["doc_id"])

    def run(batches):
        for b in batches:
            counts, shas, spans = {k: [] for k in BASE_KINDS}, [], []
            for got in b.column("spans").to_pylist():
                got = [(x["kind"], x["start"], x["end"]) for x in got]
                base = [x for x in got if x[0] in BASE_KINDS]
                for k in BASE_KINDS:
                    counts[k].append(sum(x[0] == k for x in base))
                shas.append(hashlib.sha256(span_digest(base, ORDER).encode()).hexdigest())
                spans.append(span_digest(got, ORDER))
            yield appended(b, ["doc_id"], **{f"n_{k}": pa.array(v, pa.int64()) for k, v in counts.items()},
                           base_sha256=pa.array(shas, pa.string()), spans=pa.array(spans, pa.string()))

    return found.mapInArrow(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE_KINDS)
                            + ", base_sha256 string, spans string")
