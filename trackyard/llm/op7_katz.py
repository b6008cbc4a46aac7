"""Katz back-off language model of any order: training, stored tables and scores of all documents.

p(w) = (c(w) + 1) / (N + V + 1) over the V training tokens and one unknown token.  For a
context h of one word or more with training followers,

    p(w | h) = d(c) * c(hw) / c(h)            if c(hw) > 0
    p(w | h) = a(h) * p(w | h')               else, h' being h without its first word (recursion),

with Good-Turing discounts d(c) of each order for c <= ``K`` and a(h) = the mass left over by
the discounts / the mass that the lower order gives to the tokens unseen after h, both from
exact integer sums, so that every p(. | h) sums to 1.  A context that no discount touches uses
c / (c(h) + 1); an unseen context is scored by p(w | h').  If an order's counts of counts give
no valid discount, d(c) is (c - D) / c with D = n1 / (n1 + 2 n2).  Before a document's first
word stand start marks.

How it runs: texts are encoded once into blocks of token codes (stored).  Each block asks the
owners of its distinct tokens, dealt by hash, for ids and corpus counts, and is stored again with
these, its codes in the order of the ids; what it was made of is removed.  Then it sends its
distinct n-grams of the highest order, with their training counts, to the owner of the word
before the last.  An owner so holds all orders of its contexts: it merges the blocks' counts
and stores its share of the model.  A word with many followers is split over several owners by
follower; sums of contexts that several owners have go in letters, dealt by context, to be added up and given back.  Once the discounts are
known, shares are evaluated and answer the blocks, which add up their documents.  A letter from
a block to an owner is one row of numbers, written and read for all owners at once and only
packed one by one; there are never more letters than n-grams.  No owner, block or collected result grows with the corpus.

Documents for which ``held`` is true are only scored.  NULL texts are empty (one end token);
a NULL doc_id stays NULL; repeated rows count and are scored each; an empty table gives no
rows; other columns are not read.  Words are told apart by 64 hash bits.
Very long texts are read whole.  Ties: none possible, as counts and scores depend on no order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackyard.llm.common import LOWER, U, Words, column_bytes, discard, held_out, mix, pick, read, stored_at, text_slices

ORDER = 3                      # words of the longest n-grams
K = 5                          # counts up to K are discounted
BLOCK_BYTES = 2 << 20          # text of one block
OWNED = 400_000                # entries that an owner gets on average
END = np.array([0x7F4A7C159E3779B9], U)    # stands for the end token; a word's hash equals it by chance only
START = 0                      # id of the start mark; tokens have ids from 1 on
SLICES = 1 << 20               # parts of the token space that are dealt to owners
MANY = 20                      # bits of a word's number of owners
PART = 1 << 18                 # numbers that are turned into bytes, or back, at once
SUMS = 3 + 2 * K               # of a context, see ``Level.sums``

ENCODED = ("kind string, block long, doc_ids array<long>, counts array<int>, held array<boolean>, n_tokens long, "
           "n_words long, slices binary, codes binary, words binary, seen binary")
NAMED = ("block long, doc_ids array<long>, counts array<int>, held array<boolean>, codes binary, ids binary, "
         "total binary")
SENT = ("kind string, bucket int, block long, body binary, rest binary, parts array<binary>, split boolean, level int, "
        "sums array<long>")
SCORED = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
          "score double")
MODEL = "order int, context array<long>, word long, count long, log_prob double, log_backoff double"


def packed(values: np.ndarray) -> bytes:
    """Non-negative integers in the narrowest type, compressed."""
    top = int(values.max()) if len(values) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w))
    return bytes([width]) + zstandard.ZstdCompressor(3).compress(values.astype(f"<u{width}").tobytes())


def unpacked(raw: bytes, dtype=np.int64) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), f"<u{raw[0]}").astype(dtype)


def encode(docs: DataFrame) -> DataFrame:
    """Blocks of documents (doc_id, text, held): a row of token codes (those of frequent tokens are
    small) and one of the block's distinct words with their training counts."""

    def run(batches):
        part, seq, size, held = TaskContext.get().partitionId(), 0, 0, []
        for b in text_slices(batches, BLOCK_BYTES):
            data, offs = column_bytes(b.column("text"))
            w = Words(LOWER[data], offs)
            tokens = np.insert(w.hash, w.first[1:], END[0])
            held.append((b.column("doc_id"), w.counts + 1, b.column("held"), tokens))
            size += len(data)
            if size >= BLOCK_BYTES:
                yield _block(part << 24 | seq, held)
                seq, size, held = seq + 1, 0, []
        if held:
            yield _block(part << 24 | seq, held)

    return docs.select("doc_id", "text", "held").mapInArrow(run, ENCODED)


def _block(name: int, held: list) -> pa.RecordBatch:
    ids, counts, flags, tokens = zip(*held)
    words, codes, n = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    words, codes = words[order], place[codes.ravel()]
    counts, flags = np.concatenate(counts), [x for c in flags for x in c.to_pylist()]
    train = np.repeat(~np.array(flags, bool), counts)
    slices = packed((mix(words) % U(SLICES)).astype(np.int64))
    body = {"kind": "codes", "doc_ids": [x for c in ids for x in c.to_pylist()], "counts": counts, "held": flags,
            "n_tokens": int(n.sum()), "n_words": len(words), "slices": slices, "codes": packed(codes)}
    asked = {"kind": "words", "slices": slices, "words": packed(words),
             "seen": packed(np.bincount(codes[train], minlength=len(words)))}
    types = {"kind": pa.string(), "block": pa.int64(), "doc_ids": pa.list_(pa.int64()), "counts": pa.list_(pa.int32()),
             "held": pa.list_(pa.bool_()), "n_tokens": pa.int64(), "n_words": pa.int64(), "slices": pa.binary(),
             "codes": pa.binary(), "words": pa.binary(), "seen": pa.binary()}
    return pa.RecordBatch.from_arrays(
        [pa.array([{"block": name, **row}.get(k) for row in (body, asked)], t) for k, t in types.items()], list(types))


_SENT = {"kind": pa.string(), "bucket": pa.int32(), "block": pa.int64(), "body": pa.binary(), "rest": pa.binary(),
         "parts": pa.list_(pa.binary()), "split": pa.bool_(), "level": pa.int32(),
         "sums": pa.list_(pa.int64())}


def sent(n: int, **columns) -> pa.Table:
    """``n`` rows of ``SENT``; a column is an array, or one value for all rows."""
    return pa.table({c: x if isinstance(x := columns.get(c), pa.Array) else
                     pa.array(x, t) if isinstance(x, np.ndarray) else pa.array([x] * n, t) for c, t in _SENT.items()})


def lists(rows: np.ndarray) -> pa.Array:
    """The rows of a table of numbers as lists."""
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(rows.ravel(), pa.int64()))


def varints(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where the bytes of each number end): seven bits a byte, a number's last byte is below 128."""
    out, ends, done = [], np.empty(len(x), np.int64), 0
    for i in range(0, len(x), PART):
        data, stops = _varints(x[i:i + PART])
        out.append(data)
        ends[i:i + PART] = stops + done
        done += len(data)
    return np.concatenate(out) if out else np.empty(0, np.uint8), ends


def _varints(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.ones(len(x), np.int64)
    for bits in range(7, 64, 7):
        more = x >= U(1 << bits)
        if not more.any():
            break
        size += more
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]), np.uint8)
    at = ends - size
    while len(x):
        more = x >= U(128)
        out[at] = (x & U(127)).astype(np.uint8) | more.astype(np.uint8) << np.uint8(7)
        at, x = at[more] + 1, x[more] >> U(7)
    return out, ends


def numbers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, where the last byte of each lies) of ``varints``."""
    last = np.flatnonzero(data < 128)
    values = np.empty(len(last), U)
    for i in range(0, len(last), PART):
        end = last[i:i + PART]
        first = np.append(last[i - 1] + 1 if i else 0, end[:-1] + 1)
        some, left, j = (data[first] & np.uint8(127)).astype(U), np.flatnonzero(first < end), 1
        while len(left):
            some[left] |= (data[first[left] + j] & np.uint8(127)).astype(U) << U(7 * j)
            j += 1
            left = left[first[left] + j <= end[left]]
        values[i:i + PART] = some
    return values.view(np.int64), last


def compact(values: np.ndarray, near: bool = False) -> bytes:
    """Non-negative integers as compressed varints; ``near``: as differences, for neighbours that are alike."""
    x = np.asarray(values, np.int64)
    if near:
        x = np.diff(x, prepend=0)
        x = x << 1 ^ x >> 63
    return bytes([near]) + zstandard.ZstdCompressor(3).compress(varints(x.astype(U))[0].tobytes())


def expanded(raw: bytes) -> np.ndarray:
    x, _ = numbers(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), np.uint8))
    return np.cumsum(x >> 1 ^ -(x & 1)) if raw[0] else x


def letters(*streams: tuple[np.ndarray, np.ndarray]) -> pa.Array:
    """Letters of several streams of numbers: letter m has the next ``lengths[m]`` of each (values, lengths)."""
    lengths = np.array([n for _, n in streams], np.int64)
    total = len(streams) + lengths.sum(axis=0)
    ends = np.cumsum(total)
    start = ends - total
    values = np.empty(int(ends[-1]) if len(ends) else 0, U)
    values[start[:, None] + np.arange(len(streams))] = lengths.T
    at = start + len(streams)
    for (x, _), n in zip(streams, lengths):
        values[np.repeat(at - (np.cumsum(n) - n), n) + np.arange(len(x))] = x
        at = at + n
    data, stops = varints(values)
    stops, raw, pack = np.append(0, stops[ends - 1]).tolist(), memoryview(data), zstandard.ZstdCompressor(3).compress
    return pa.array([pack(raw[a:b]) for a, b in zip(stops, stops[1:])], pa.binary())


def opened(body: pa.ChunkedArray, kinds: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The streams of ``letters``, each over all letters in turn: (values, lengths)."""
    raw = list(map(zstandard.ZstdDecompressor().decompress, body.to_pylist()))
    data, begins = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])[:-1]
    values, last = numbers(data)
    start = np.searchsorted(last, begins)
    lengths = values[start[:, None] + np.arange(kinds)].T
    at, out = start + kinds, []
    for n in lengths:
        out.append((values[np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())], n))
        at = at + n
    return out


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b) of the distinct pairs in order, and which of them each row is; numbers from 0 on."""
    names, m = None, int(b.max(initial=0)) + 1
    if (int(a.max(initial=0)) + 1) * m >= 1 << 63:
        names, b = np.unique(b, return_inverse=True)
        m = len(names)
    keys, at = np.unique(a * m + b, return_inverse=True)
    a, b = np.divmod(keys, m)
    return a, b if names is None else names[b], at


def named(blocks: DataFrame, tokens: DataFrame, buckets: int) -> DataFrame:
    """Blocks with the ids and corpus counts of their words (``NAMED``); codes in the order of the ids."""

    def tell(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        (told, _), (counts, _) = opened(right.sort_by("bucket").column("body"), 2)
        order = np.argsort(unpacked(row["slices"]) % buckets, kind="stable")
        by = np.argsort(told)
        place = np.empty(len(by), np.int64)
        place[order[by]] = np.arange(len(by))
        row |= {"codes": packed(place[unpacked(row["codes"])]), "ids": compact(told[by], near=True),
                "total": compact(counts[by])}
        return pa.table({c: pa.array([row[c]], t) for c, t in _NAMED.items()})

    return blocks.groupBy("block").cogroup(tokens.groupBy("block")).applyInArrow(tell, NAMED)


_NAMED = {"block": pa.int64(), "doc_ids": pa.list_(pa.int64()), "counts": pa.list_(pa.int32()),
          "held": pa.list_(pa.bool_()), "codes": pa.binary(), "ids": pa.binary(), "total": pa.binary()}


class Block:
    """One named block; the start mark has the last place of its words."""

    def __init__(self, row: dict, train_docs: int):
        self.name, self.doc_ids, self.held = row["block"], row["doc_ids"], row["held"]
        self.counts, self.codes = np.array(row["counts"], np.int64), unpacked(row["codes"])
        self.ids, self.total = np.append(expanded(row["ids"]), START), np.append(expanded(row["total"]), train_docs)
        self.n_words = len(self.ids) - 1
        self.train = np.repeat(~np.array(self.held, bool), self.counts)

    @classmethod
    def each(cls, batches: Iterator[pa.RecordBatch], train_docs: int) -> Iterator["Block"]:
        for b in batches:
            for i in range(b.num_rows):
                yield cls(b.slice(i, 1).to_pylist()[0], train_docs)

    def grams(self, order: int, buckets: int, hot: int) -> None:
        """Distinct n-grams as a tree: pairs (v, w) by owner, then for each word further back (parent, word);
        the gram of each token and the grams' training counts.  A v seen over ``hot`` times is split by w."""
        place = np.arange(len(self.codes)) - np.repeat(np.cumsum(self.counts) - self.counts, self.counts)

        def back(j: int) -> np.ndarray:
            out = np.full(len(self.codes), self.n_words)
            out[j:] = self.codes[:-j]
            out[place < j] = self.n_words
            return out

        v, w, gram = distinct_pairs(back(1), self.codes)
        split = np.clip(-(-self.total // hot), 1, min(buckets, (1 << MANY) - 1))
        part = (mix(self.ids[w].astype(U) + U(1)) % split[v].astype(U)).astype(np.int64)
        bucket = ((mix(self.ids[v].astype(U)) % U(buckets)).astype(np.int64) + part) % buckets
        by = np.argsort(bucket, kind="stable")
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        self.v, self.w, self.bucket, self.split, gram = v[by], w[by], bucket[by], split, rank[gram]
        self.steps = []
        for j in range(2, order):
            parent, code, gram = distinct_pairs(gram, back(j))
            self.steps.append((parent, code))
        self.gram_of = gram
        self.seen = np.bincount(gram[self.train], minlength=len(self.steps[-1][0] if self.steps else by))

    def asks(self) -> pa.Table:
        """A letter to each owner of some of the block's n-grams (see ``Share.merged``)."""
        present, first = np.unique(self.bucket, return_index=True)
        new = np.ones(len(self.v), bool)
        new[1:] = (self.v[1:] != self.v[:-1]) | (self.bucket[1:] != self.bucket[:-1])
        heads, bounds = np.flatnonzero(new), np.append(first, len(self.v))
        n_heads, n = np.add.reduceat(new.astype(np.int64), first), np.diff(bounds)
        v = self.v[heads]
        # a split word's head says over how many owners
        head = np.where(self.split[v] > 1, (self.ids[v] << MANY | self.split[v]) << 1 | 1, self.ids[v] << 1)
        streams = [(head, n_heads), (np.diff(np.append(heads, len(self.v))), n_heads),
                   (self.ids[self.w], n), (self.total[self.w], n)]
        size = len(self.v)
        for parent, code in self.steps:
            kids = np.bincount(parent, minlength=size)
            bounds, size = np.concatenate([[0], np.cumsum(kids)])[bounds], len(parent)
            streams += [(kids, n), (self.ids[code], n := np.diff(bounds))]
        return sent(len(present), kind="ask", bucket=present, block=self.name, body=letters(*streams, (self.seen, n)))


def token_answers(words: DataFrame, buckets: int) -> DataFrame:
    """Token owners: ids and counts for each block, the unigram table and its sums (``SENT``)."""

    def ask(batches):
        for b in batches:
            for row in b.to_pylist():
                where, words, seen = unpacked(row["slices"]) % buckets, unpacked(row["words"], U), unpacked(row["seen"])
                order = np.argsort(where, kind="stable")
                present, n = np.unique(where, return_counts=True)
                yield from sent(len(present), kind="ask", bucket=present, block=row["block"],
                                body=letters((words[order], n), (seen[order], n))).to_batches()

    def own(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        (words, n), (seen, _) = opened(table.column("body"), 2)
        all_, inv = np.unique(words.view(U), return_inverse=True)
        total, ids = np.bincount(inv, seen, len(all_)).astype(np.int64), np.empty(len(all_), np.int64)
        ids[np.argsort(-total, kind="stable")] = np.arange(len(all_)) * buckets + bucket + 1      # frequent: small
        return pa.concat_tables([
            sent(len(n), kind="tokens", bucket=bucket, block=table.column("block").combine_chunks(),
                 body=letters((ids[inv], n), (total[inv], n))),
            sent(1, kind="unigrams", bucket=bucket, parts=[packed(all_), packed(ids), packed(total)]),
            sent(1, kind="sums", bucket=bucket, level=1, sums=[total.sum(), (total > 0).sum()])])

    return words.mapInArrow(ask, SENT).groupBy("bucket").applyInArrow(own, SENT)


class Level:
    """N-grams of one order in a share.

    parent: index of each one's shorter gram; ctx, n: its context, and how many there are;
    up, context: each context's shorter one, and its words (nearest first); count; low: count
    of the shorter gram (of the word itself for pairs); split: owners of each context's followers.
    """

    def __init__(self, **fields):
        self.__dict__.update(fields)

    def sums(self, pairs: bool) -> np.ndarray:
        """Per context over its seen followers: their tokens, their number, how many were seen 1..K times,
        and of their lower counts: the sum of those above K (of all, for pairs), how many are 1..K."""
        seen = self.count > 0
        at, count, low = self.ctx[seen], self.count[seen], self.low[seen]
        many = lambda x: np.bincount(x, minlength=self.n)
        add = lambda x: np.bincount(at, x, self.n).astype(np.int64)
        some = range(1, K + 1)
        return np.stack([add(count), many(at), *[many(at[count == r]) for r in some],
                         add(low if pairs else np.where(low > K, low, 0)),
                         *[many(at[(low == r) & (not pairs)]) for r in some]], axis=1)

    def shared(self, k: int, bucket: int) -> pa.Table:
        """Letters with the sums of split contexts of ``k`` - 1 words; a word's contexts are dealt over as many
        adders as it has owners, so that an adder has no more contexts than an owner."""
        at = np.flatnonzero(self.split > 1)
        part = np.zeros(len(at), U)
        for x in self.context[at, 1:].T:
            part = mix(part + x.astype(U) + U(1))
        key = self.context[at, 0] << MANY | (part % self.split[at].astype(U)).astype(np.int64)
        order = np.argsort(key, kind="stable")
        at, (keys, n) = at[order], np.unique(key, return_counts=True)
        streams = [at, *self.context[at, 1:].T, *self.sums(k == 2)[at].T]
        return sent(len(keys), kind="split", bucket=bucket, block=keys, level=k, body=letters(*[(x, n) for x in streams]))


def added(table: pa.Table) -> pa.Table:
    """The letters of an adder (see ``Level.shared``) answered with the sums over all owners of a context; one that
    only one owner has is whole there."""
    k = table.column("level")[0].as_py()
    (at, n), *streams = opened(table.column("body"), k - 1 + SUMS)
    same = np.zeros(len(at), np.int64)
    for x, _ in streams[:k - 2]:
        same = distinct_pairs(same, x)[2]
    keep = np.bincount(same)[same] > 1
    n = np.bincount(np.repeat(np.arange(len(n)), n)[keep], minlength=len(n))
    total = [np.bincount(same, x).astype(np.int64)[same[keep]] for x, _ in streams[k - 2:]]
    return sent(len(n), kind="total", bucket=table.column("bucket").combine_chunks(), level=k,
                body=letters((at[keep], n), *[(x, n) for x in total]))


class Share:
    """An owner's part of the model: all n-grams whose word before the last is among its ``heads``."""

    def __init__(self, heads, head_of, words, c1, counts, *steps):
        self.heads, self.head_of, self.words, self.c1, self.steps = heads, head_of, words, c1, list(zip(steps[::2], steps[1::2]))
        hot = heads % 2 > 0
        level = Level(parent=None, ctx=head_of, n=len(heads), up=None,
                      context=np.where(hot, heads >> MANY + 1, heads >> 1)[:, None],
                      split=np.where(hot, heads >> 1 & (1 << MANY) - 1, 1))
        self.levels = [level]
        for parent, word in self.steps:
            up, word, ctx = distinct_pairs(level.ctx[parent], word)
            level = Level(parent=parent, ctx=ctx, n=len(up), up=up, split=level.split[up],
                          context=np.column_stack([level.context[up], word]))
            self.levels.append(level)
        self.levels[-1].count = counts
        for low, level in zip(self.levels[-2::-1], self.levels[:0:-1]):
            low.count = np.bincount(level.parent, level.count, len(low.ctx)).astype(np.int64)
            level.low = low.count[level.parent]
        self.levels[0].low = c1

    @classmethod
    def merged(cls, streams: list) -> tuple["Share", np.ndarray, np.ndarray]:
        """(share, gram of each entry of the letters, entries of each letter).  Streams: heads, pairs of each,
        words, their counts; for each word further back: children of each gram, words; training counts."""
        (v, _), (runs, _), (w, _), (c1, _), *more, (seen, n) = streams
        heads, at = np.unique(v, return_inverse=True)
        head_of, words, gram = distinct_pairs(np.repeat(at, runs), w)
        count = np.zeros(len(words), np.int64)
        count[gram] = c1
        parts, steps, size = (heads, head_of, words, count), [], len(words)
        for (kids, _), (h, _) in zip(more[::2], more[1::2]):
            parent, word, gram = distinct_pairs(np.repeat(gram, kids), h)
            steps += [parent, word]
            size = len(word)
        return cls(*parts, np.bincount(gram, seen, size).astype(np.int64), *steps), gram, n

    def parts(self) -> list[bytes]:
        """What ``__init__`` takes, packed: all but counts and the words further back rise, or nearly so."""
        rising = [compact(x, near=True) for x in (self.heads, self.head_of, self.words)]
        steps = [compact(x, near=k == 0) for s in self.steps for k, x in enumerate(s)]
        return [*rising, compact(self.c1), compact(self.levels[-1].count), *steps]

    def evaluate(self, sums: list[np.ndarray], mass: int, discounts: list["Discounts"]) -> None:
        """Sets each level's ``p`` of its n-grams, and ``base`` and ``back`` (the back-off weight) of its contexts."""
        lower, low_d, low_base = (self.c1 + 1) / mass, None, None
        for level, s, d in zip(self.levels, sums, discounts):
            tokens, types, ones, most, few = s[:, 0], s[:, 1], s[:, 2:2 + K].T, s[:, 2 + K], s[:, 3 + K:].T
            left = d.left(types, ones)
            untouched = (tokens > 0) & (left <= 0)
            level.base = np.where(untouched, tokens + 1, np.maximum(tokens, 1))
            if level.up is None:
                unseen = (mass - most - types) / mass
            else:        # integers first: what the lower order counted elsewhere, then what it discounted here
                base = low_base[level.up]
                rest = base - most - sum(r * x for r, x in enumerate(few, 1))
                unseen = (rest + low_d.left(types, few)) / base
            level.back = np.where(tokens > 0, np.where(untouched, 1.0, left) / level.base / unseen, 1.0)
            level.p = np.where(level.count > 0, d.seen(level.count) / level.base[level.ctx], level.back[level.ctx] * lower)
            lower, low_d, low_base = level.p, d, level.base
            if (after := self.levels.index(level) + 1) < len(self.levels):
                lower = lower[self.levels[after].parent]


def shares(blocks: DataFrame, order: int, pair_buckets: int, hot: int, train_docs: int) -> DataFrame:
    """N-gram owners (``SENT``): their shares of the model with the letters to answer, sums of split contexts, and
    counts of counts of each order."""

    def ask(batches):
        for block in Block.each(batches, train_docs):
            block.grams(order, pair_buckets, hot)
            yield from block.asks().to_batches()

    def own(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        share, index, sizes = Share.merged(opened(table.column("body"), 2 * order + 1))
        blocks = table.column("block").to_numpy()
        out = [sent(1, kind="share", bucket=bucket, split=bool((share.levels[0].split > 1).any()),
                    parts=[compact(blocks, near=True), compact(sizes), compact(index, near=True), *share.parts()])]
        for k, level in enumerate(share.levels, 2):
            counts = np.bincount(np.minimum(level.count, K + 2), minlength=K + 3)
            out.append(sent(1, kind="counts", bucket=bucket, level=k, sums=counts.tolist()))
            if (level.split > 1).any():
                out.append(level.shared(k, bucket))
        return pa.concat_tables(out)

    return blocks.mapInArrow(ask, SENT).groupBy("bucket").applyInArrow(own, SENT)


class Discounts:
    """Good-Turing discounts from counts of counts n[0..K+1]; absolute ones where those are not valid."""

    def __init__(self, n: np.ndarray):
        n = np.asarray(n, float)
        self.d = np.ones(K + 1)
        self.absolute = None
        common = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
        if common < 1 and (n[1:K + 1] > 0).all():
            r = np.arange(1, K + 1)
            self.d[1:] = ((r + 1) * n[2:K + 2] / n[1:K + 1] / r - common) / (1 - common)
        if not ((self.d[1:] > 0) & (self.d[1:] < 1)).all():
            self.absolute = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5

    def seen(self, c: np.ndarray) -> np.ndarray:
        """c after discounting."""
        if self.absolute is not None:
            return c - self.absolute
        return np.where(c <= K, self.d[np.minimum(c, K)], 1.0) * c

    def left(self, types: np.ndarray, singles: list[np.ndarray]) -> np.ndarray:
        """Count mass that the discounts leave over in a context."""
        if self.absolute is not None:
            return self.absolute * types
        return sum(s * (1 - self.d[r]) * r for r, s in enumerate(singles, 1))


class Model:
    """The stored shares, and what it takes to evaluate them."""

    def __init__(self, found: DataFrame, unigrams: DataFrame, order: int, mass: int):
        self.shares, self.unigrams, self.order, self.mass = found.where("kind = 'share'"), unigrams, order, mass
        counts = found.where("kind = 'counts'").groupBy("level").agg(
            *[F.sum(F.col("sums")[r]).alias(f"n{r}") for r in range(K + 3)])       # a row for each order
        counts = {r.level: np.array(r[1:]) for r in counts.collect()}
        self.discounts = [Discounts(counts.get(k, np.zeros(K + 3))) for k in range(2, order + 1)]
        parts = found.where("kind = 'split'").select("bucket", "block", "level", "body")
        self.totals = parts.groupBy("block", "level").applyInArrow(added, SENT).select(
            F.col("bucket").alias("owner"), "level", "body")

    def each(self, run, schema: str) -> DataFrame:
        """``run(share, bucket, blocks, sizes, index)`` -> tables, over all evaluated shares."""
        mass, discounts = self.mass, self.discounts

        def evaluated(row: dict, totals: pa.Table | None) -> Iterator[pa.Table]:
            blocks, sizes, index, *parts = map(expanded, row["parts"])
            share = Share(*parts)
            sums = [level.sums(k == 0) for k, level in enumerate(share.levels)]
            if totals is not None:
                levels = totals.column("level").to_numpy()
                for k in np.unique(levels):
                    (at, _), *total = opened(totals.column("body").filter(pa.array(levels == k)), 1 + SUMS)
                    sums[k - 2][at] = np.stack([x for x, _ in total], axis=1)
            share.evaluate(sums, mass, discounts)
            yield from run(share, row["bucket"], blocks, sizes, index)

        def alone(batches):
            for b in batches:
                for i in range(b.num_rows):
                    for t in evaluated(b.slice(i, 1).to_pylist()[0], None):
                        yield from t.to_batches()

        def split(left: pa.Table, right: pa.Table) -> pa.Table:
            return pa.concat_tables(evaluated(left.to_pylist()[0], right))

        found = self.shares.select("bucket", "split", "parts")
        joined = found.where("split").groupBy("bucket").cogroup(self.totals.groupBy("owner")).applyInArrow(split, schema)
        return found.where("NOT split").mapInArrow(alone, schema).unionByName(joined)

    def answers(self) -> DataFrame:
        """To each block's letter: counts of its n-grams; of seen ones the tokens of their context, of others p."""

        def run(share, bucket, blocks, sizes, index):
            top = share.levels[-1]
            count, base = top.count[index], top.base[top.ctx][index]
            seen = count > 0
            n = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[seen], minlength=len(sizes))
            offs = np.concatenate([[0], np.cumsum(8 * (sizes - n))]).astype(np.int32)
            rest = pa.Array.from_buffers(pa.binary(), len(sizes), [
                None, pa.py_buffer(offs.tobytes()), pa.py_buffer(top.p[index][~seen].tobytes())])
            yield sent(len(sizes), kind="grams", bucket=bucket, block=blocks, body=letters((count, sizes), (base[seen], n)),
                       rest=rest)

        return self.each(run, SENT)

    def table(self) -> DataFrame:
        """The model as rows (``MODEL``) of ids: an n-gram's context (nearest word first) and word, its count and
        log10 probability, and its context's log10 back-off weight.  Order 1 has all tokens that were ever asked for."""
        mass = self.mass

        def run(share, *_):
            words, seen = share.words, None
            for k, level in enumerate(share.levels, 2):
                if level.parent is not None:
                    words = words[level.parent]
                seen = level.count > 0
                ctx = level.ctx[seen]
                yield pa.table({"order": pa.array(np.full(len(ctx), k), pa.int32()), "context": lists(level.context[ctx]),
                                "word": words[seen], "count": level.count[seen], "log_prob": np.log10(level.p[seen]),
                                "log_backoff": np.log10(level.back[ctx])})

        def ones(batches):
            for b in batches:
                for parts in b.column("parts").to_pylist():
                    _, ids, total = (unpacked(x) for x in parts)
                    yield pa.RecordBatch.from_pydict({
                        "order": pa.array(np.ones(len(ids)), pa.int32()), "context": lists(np.zeros((len(ids), 0), np.int64)),
                        "word": ids, "count": total, "log_prob": np.log10((total + 1) / mass), "log_backoff": np.zeros(len(ids))})

        low = self.unigrams.select("parts").mapInArrow(ones, MODEL)
        return low if self.order == 1 else low.unionByName(self.each(run, MODEL))


def scores(blocks: DataFrame, answers: DataFrame | None, order: int, pair_buckets: int, hot: int, train_docs: int,
           n: int, mass: int, top: Discounts | None) -> DataFrame:
    def scored(block: Block, told: pa.Table | None) -> pa.Table:
        low = ((block.total[:-1] + 1) / mass)[block.codes]
        p = low
        if told is not None:
            block.grams(order, pair_buckets, hot)
            told = told.sort_by("bucket")
            (count, _), (base, _) = opened(told.column("body"), 2)
            seen, of = count > 0, np.empty(len(count))
            of[seen] = top.seen(count[seen]) / base
            of[~seen] = np.frombuffer(column_bytes(told.column("rest").combine_chunks())[0].tobytes(), float)
            p = of[block.gram_of]
        doc = np.repeat(np.arange(len(block.counts)), block.counts)
        total = lambda x: np.bincount(doc, x, len(block.counts))
        return pa.table({
            "doc_id": pa.array(block.doc_ids, pa.int64()), "held_out": pa.array(block.held, pa.bool_()),
            "n_tokens": pa.array(block.counts, pa.int64()),
            "n_known": pa.array(total(block.total[block.codes] > 0).astype(np.int64)),
            "train_tokens": pa.array(np.full(len(block.counts), n, np.int64)),
            "base_score": pa.array(total(np.log10(low))), "score": pa.array(total(np.log10(p)))})

    def alone(batches):
        for block in Block.each(batches, train_docs):
            yield from scored(block, None).to_batches()

    def told(left: pa.Table, right: pa.Table) -> pa.Table:
        return scored(Block(left.to_pylist()[0], train_docs), right)

    if answers is None:
        return blocks.mapInArrow(alone, SCORED)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(told, SCORED)


def train_and_score(docs: DataFrame, held: Column, order: int = ORDER, owned: int = OWNED) -> tuple[DataFrame, Model]:
    """(``SCORED`` rows of all documents, the model of the others)."""
    encoded, path = stored_at(encode(pick(docs).withColumn("held", held)), "blocks", ("kind",))
    blocks = encoded.where("kind = 'codes'").drop("kind", "words", "seen")
    size = blocks.agg(F.sum("n_tokens").alias("tokens"), F.sum("n_words").alias("words"),
                      F.sum(F.aggregate("held", F.lit(0).cast("long"), lambda a, h: a + F.when(h, 0).otherwise(1)))
                      .alias("docs")).first()
    buckets, pair_buckets = (max(1, -(-(x or 0) // owned)) for x in (size.words, size.tokens))
    buckets = min(buckets, SLICES)
    train_docs, hot = size.docs or 0, owned
    words = encoded.where("kind = 'words'").select("block", "slices", "words", "seen")
    tokens, told = stored_at(token_answers(words, buckets), "tokens", ("kind",))
    discard(docs.sparkSession, f"{path}/kind=words")      # from here on tokens go by their ids
    found = tokens.where("kind = 'sums'").agg(F.sum(F.col("sums")[0]), F.sum(F.col("sums")[1])).first()
    n, v = (int(x or 0) for x in found)
    mass = n + v + 1
    known, unigrams = tokens.where("kind = 'tokens'"), tokens.where("kind = 'unigrams'")
    blocks, _ = stored_at(named(blocks, known, buckets), "named")
    for done in (path, f"{told}/kind=tokens"):
        discard(docs.sparkSession, done)
    if order == 1:
        model = Model(tokens.limit(0), unigrams, order, mass)
        return scores(blocks, None, order, pair_buckets, hot, train_docs, n, mass, None), model
    stored, _ = stored_at(shares(blocks, order, pair_buckets, hot, train_docs), "shares", ("kind",))
    model = Model(stored, unigrams, order, mass)
    return scores(blocks, model.answers(), order, pair_buckets, hot, train_docs, n, mass, model.discounts[-1]), model


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: log probability of every document."""
    return train_and_score(read(spark, sf_dir, "documents"), held_out("doc_id", 7, 2))[0]
