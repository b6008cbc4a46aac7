"""Best-fit packing of tokenised documents after Martello-Toth dominance reduction.

Documents are tokenised in tasks and cut into pieces of at most ``capacity`` tokens.  Only
the number of pieces of each length (at most ``capacity`` numbers, whatever the input) goes
to the driver.  There, sets of lengths that provably dominate every alternative are fixed
for all their copies at once, and the remaining copies are placed best-fit decreasing, run
by run.  The plan says which ranks of a length go to which sequences; every piece then
finds its place from its rank within its length, which tasks and a join provide.

NULL texts are empty documents (only the closing id).  Equal rows are packed separately; a
NULL doc_id stays NULL.  An empty table gives no rows.  Other columns are not read.
Very long texts are tokenised whole.  Ties: pieces of equal length are interchangeable; which of them goes to which
sequence is arbitrary, the number of sequences is not.
"""

from __future__ import annotations

import bisect
import codecs
import itertools
import os
import re
import struct
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackyard.llm.common import LOWER, SPACES, column_bytes, pick, read, stored, text_slices

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 2048
END_ID = 0

PIECES = ("doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long")
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


#: What a byte of a word is: letters (ASCII, and from \xc3 on those of À to ÿ), digits and marks need no normaliser:
#: each is its own composed form, and nothing among them makes a contraction or a special token.  Others are odd.
SPACE, LETTER, DIGIT, MARK, ODD = range(5)
KIND = np.full(256, ODD, np.uint8)
KIND[SPACES] = SPACE
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3]] = LETTER
KIND[range(0x30, 0x3A)] = DIGIT
KIND[[*b"!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"]] = MARK
PLAIN = re.compile(rb"(?:[!-&(-;=-~]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


def runs_apart(data: np.ndarray, offs: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The texts with a space between the runs of letters or marks and the digits of each word, in lower case,
    and the new offsets.  Words with an odd byte stay as they are."""
    kind, low = KIND[data], LOWER[data]
    at = np.flatnonzero(data == 0xC3) + 1
    second = data[at]
    kind[at] = np.where((second == 0x97) | (second == 0xB7), ODD, LETTER)     # signs between the letters
    low[at] = second + np.uint8(0x20) * ((second < 0x9F) & (second != 0x97))
    if (kind == ODD).any():
        begins = kind != SPACE
        begins[1:] &= kind[:-1] == SPACE
        first = offs[:-1][np.diff(offs) > 0]
        begins[first] = True                         # spaces count with the word before, or as a word of their own
        word = np.cumsum(begins, dtype=np.int32)
        odd = np.zeros(int(word[-1]) + 1, bool)
        odd[word[kind == ODD]] = True
        odd = odd[word] & (kind != SPACE)
        kind[odd], low[odd] = ODD, data[odd]
    a, b = kind[:-1], kind[1:]
    cuts = np.flatnonzero(((a != b) | (b == DIGIT)) & (a != SPACE) & (b != SPACE)) + 1
    return np.insert(low, cuts, 0x20).tobytes(), offs + np.searchsorted(cuts, offs)


class WordTokenizer:
    """Token ids of whole texts as little-endian uint32 bytes, through a bounded cache.

    The vocabulary drops white space and tokenises each word alone, so a text's ids are its
    words' ids in a row, and a word's those of its runs of letters or marks and its digits.  These
    pieces go straight to the model; words with odd bytes through its normaliser and splitter
    first; what may hold a special token goes through the whole.
    """

    def __init__(self, name: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        if not os.path.isabs(name):
            import public_tokenizers
            name = public_tokenizers.path(name)
        self.tokenizer = Tokenizer.from_file(name)
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        table = [chr(b) for b in range(256)]             # bytes as the model has them
        for c in range(0xC0, 0x100):
            for b, x in zip(chr(c).encode(), split(chr(c))[0][0]):
                table[b] = x
        self.table, self.seen = "".join(table), _Seen(self.piece)

    def piece(self, piece: bytes) -> bytes:
        tok = self.tokenizer
        if piece.isalpha() or PLAIN.fullmatch(piece):    # of bytes: ASCII letters only
            ids = [t.id for t in tok.model.tokenize(codecs.charmap_decode(piece, "strict", self.table)[0])]
        elif b"<|" in piece:
            ids = tok.encode(piece.decode(), add_special_tokens=False).ids
        else:
            plain = tok.normalizer.normalize_str(piece.decode())
            ids = [t.id for run, _ in tok.pre_tokenizer.pre_tokenize_str(plain) for t in tok.model.tokenize(run)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def each(self, data: np.ndarray, offs: np.ndarray) -> Iterator[bytes]:
        """Ids of the texts whose UTF-8 bytes lie between the offsets."""
        apart, offs = runs_apart(data, offs)
        for a, b in itertools.pairwise(offs.tolist()):
            yield b"".join(map(self.seen.__getitem__, apart[a:b].split()))

    def ids(self, text: bytes) -> bytes:
        return next(self.each(np.frombuffer(text, np.uint8), np.array([0, len(text)])))


class _Seen(dict):
    """Ids of pieces seen lately: at most two generations of ``MOST``."""

    MOST = 350_000

    def __init__(self, make: Callable[[bytes], bytes]):
        self.make, self.before = make, {}

    def __missing__(self, word: bytes) -> bytes:
        got = self.before.get(word)
        if got is None:
            got = self.make(word)
        if len(word) <= 40:
            if len(self) >= self.MOST:
                self.before = dict(self)
                self.clear()
            self[word] = got
        return got


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(name: str) -> WordTokenizer:
    if name not in _TOKENIZERS:
        _TOKENIZERS[name] = WordTokenizer(name)
    return _TOKENIZERS[name]


def token_pieces(docs: DataFrame, name: str = TOKENIZER, capacity: int = CAPACITY,
                 end_id: int = END_ID) -> DataFrame:
    """One row per piece; ``nth`` counts the pieces of this length that task ``part`` cut before it."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        tok, part, nth = tokenizer(name), TaskContext.get().partitionId(), Counter()
        for b in text_slices(batches):
            out = []
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), tok.each(*column_bytes(b.column("text")))):
                ids += end
                for k in range(0, len(ids), 4 * capacity):
                    piece = ids[k:k + 4 * capacity]
                    n = len(piece) // 4
                    out.append((doc_id, k // (4 * capacity), k // 4, n, zlib.crc32(piece), part, nth[n]))
                    nth[n] += 1
            cols = list(zip(*out))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return pick(docs).select("doc_id", "text").mapInArrow(cut, PIECES)


class Plan:
    """Places for runs of equal pieces: rank lo.. of ``length`` goes to ``bins`` sequences from
    ``seq``, ``each`` pieces in a row per sequence, from ``offset`` on."""

    def __init__(self):
        self.runs: list[tuple[int, int, int, int, int, int]] = []   # length, lo, bins, each, seq, offset
        self.used: Counter = Counter()
        self.sequences = 0

    def put(self, length: int, bins: int, each: int, seq: int, offset: int) -> None:
        self.runs.append((length, self.used[length], bins, each, seq, offset))
        self.used[length] += bins * each

    def new(self, bins: int) -> int:
        self.sequences += bins
        return self.sequences - bins


def _dominating(length: int, have: dict[int, int], sizes: list[int], capacity: int) -> list[int] | None:
    """Lengths which, together with ``length``, dominate every other set with it; None if none is proven.

    ``have`` and ascending ``sizes`` describe the other pieces.  A set dominates another one
    if the other's pieces can be spread under its pieces without exceeding any of them.
    """
    room = capacity - length
    fit = bisect.bisect_right(sizes, room)
    if not fit:
        return []                                     # nothing else fits
    best = sizes[fit - 1]
    if best == room:
        return [best]                                 # an exact pair
    small = []
    for s in sizes[:3]:
        small += [s] * min(3, have[s])
    if len(small) < 2 or small[0] + small[1] > room:
        return [best]                                 # only one other can fit
    if len(small) >= 3 and sum(small[:3]) <= room:
        return None                                   # three others fit: nothing is proven here
    most, low = 0, 0                                  # best sum of a pair; largest smaller half of a pair
    for i, a in enumerate(sizes[:fit]):
        j = bisect.bisect_right(sizes, room - a) - 1
        if j > i or j == i and have[a] >= 2:
            most, low = max(most, a + sizes[j]), a
    if best >= most:
        return [best]
    rest = bisect.bisect_right(sizes, room - best) - 1
    if rest >= 0 and (sizes[rest] != best or have[best] >= 2) and sizes[rest] >= low:
        return [best, sizes[rest]]
    return None


def reduce_dominated(counts: dict[int, int], capacity: int, plan: Plan) -> dict[int, int]:
    """Fix dominating sets of one, two or three pieces for all copies; returns the copies left.

    A proof asks which lengths there are and whether they have one, two or at least three copies besides
    the piece itself: a set is fixed at once as often as all its lengths keep three.
    """
    left = {k: n for k, n in counts.items() if n}
    for length in sorted(left, reverse=True):
        while left.get(length):
            others = dict(left)
            others[length] -= 1
            if not others[length]:
                del others[length]
            found = _dominating(length, others, sorted(others), capacity)
            if found is None:
                break
            use = Counter([length, *found])
            bins = min(left[k] // n for k, n in use.items())
            if len(found) == 2:
                spare = min((others.get(k, 0) - 3) // n for k, n in use.items())
                bins = min(bins, max(1, spare + 1))
            seq, offset = plan.new(bins), 0
            for k, n in use.items():
                plan.put(k, bins, n, seq, offset)
                offset += k * n
                left[k] -= bins * n
                if not left[k]:
                    del left[k]
    return left


def best_fit(counts: dict[int, int], capacity: int, plan: Plan) -> None:
    """Best-fit decreasing over runs of equal lengths: each piece goes where it leaves least room."""
    free: dict[int, list[tuple[int, int]]] = {}       # room -> runs (seq, bins) of sequences
    rooms: list[int] = []

    def give(room: int, seq: int, bins: int) -> None:
        if room and bins:
            if room not in free:
                free[room] = []
                bisect.insort(rooms, room)
            free[room].append((seq, bins))

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                seq, bins = free[room].pop()
                if not free[room]:
                    del free[room]
                    rooms.pop(at)
            else:
                room = capacity
                bins = -(-n // (capacity // length))
                seq = plan.new(bins)
            each = room // length
            full = min(bins, n // each)
            if full:
                plan.put(length, full, each, seq, capacity - room)
                give(room - each * length, seq, full)
                n -= full * each
            if full < bins:
                if n and n < each:
                    plan.put(length, 1, n, seq + full, capacity - room)
                    give(room - n * length, seq + full, 1)
                    n, full = 0, full + 1
                give(room, seq + full, bins - full)


def pack_lengths(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    plan = Plan()
    best_fit(reduce_dominated(counts, capacity, plan), capacity, plan)
    return plan


def pack(docs: DataFrame, name: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pack all documents; one row per piece (``PACKED``)."""
    pieces = stored(token_pieces(docs, name, capacity, end_id), "pieces")
    each = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    # at most `capacity` rows, one for each length
    counts = {r["length"]: r["n"] for r in
              each.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = sorted(pack_lengths(counts, capacity).runs)
    table = np.array(runs, np.int64).reshape(-1, 6)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    base = each.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def place(batches):
        length, lo, bins, per, seq, offset = shared.value.T
        first = dict(zip(*np.unique(length, return_index=True))) if len(length) else {}
        count = Counter(length.tolist())
        for b in batches:
            if not b.num_rows:
                continue
            n = b.column("length").to_numpy(zero_copy_only=False)
            rank = b.column("rank").to_numpy(zero_copy_only=False)
            at = np.empty(len(n), np.int64)
            for k in np.unique(n):
                mine, f = n == k, first[k]
                at[mine] = f + np.searchsorted(lo[f:f + count[int(k)]], rank[mine], side="right") - 1
            step = rank - lo[at]
            keep = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(seq[at] + step // per[at]), pa.array(offset[at] + step % per[at] * n)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = (pieces.join(base, ["part", "length"])
              .select("doc_id", "piece", "start", "length", "ids_crc32",
                      (F.col("base") + F.col("nth")).alias("rank")))
    return ranked.mapInArrow(place, PACKED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: all documents packed into sequences of at most 2048 tokens."""
    return pack(read(spark, sf_dir, "documents"))
