import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trackyard.llm import op10_packing as P


def unfold(plan):
    bins = defaultdict(list)
    for length, lo, n, each, seq, offset in plan.runs:
        for i in range(n):
            bins[seq + i] += [(offset + k * length, length) for k in range(each)]
    return bins


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_plan_places_every_piece_once_without_gaps(lengths):
    plan = P.pack_lengths(Counter(lengths), 40)
    bins = unfold(plan)
    assert Counter(k for b in bins.values() for _, k in b) == Counter(lengths)
    for b in bins.values():
        at = 0
        for offset, k in sorted(b):
            assert offset == at
            at += k
        assert at <= 40
    assert len(bins) == plan.sequences


def fewest(lengths, capacity):
    best = [len(lengths)]
    lengths = sorted(lengths, reverse=True)

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for r in set(rooms):
            if r >= lengths[i]:
                rest = list(rooms)
                rest.remove(r)
                go(i + 1, [*rest, r - lengths[i]])
        go(i + 1, [*rooms, capacity - lengths[i]])
    go(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_reduction_loses_no_optimum(lengths):
    """Fixed sets plus an optimal packing of what is left need as few bins as the whole."""
    plan = P.Plan()
    left = P.reduce_dominated(Counter(lengths), 20, plan)
    rest = [k for k, n in left.items() for _ in range(n)]
    assert plan.sequences + (fewest(rest, 20) if rest else 0) == fewest(lengths, 20)


def one_by_one(counts, capacity):
    """Sets fixed with a proof for each copy: (copies left, sequences)."""
    left, sequences = dict(counts), 0
    for length in sorted(left, reverse=True):
        while left.get(length):
            others = {k: n - (k == length) for k, n in left.items() if n - (k == length)}
            found = P._dominating(length, others, sorted(others), capacity)
            if found is None:
                break
            sequences += 1
            for k in [length, *found]:
                left[k] -= 1
    return {k: n for k, n in left.items() if n}, sequences


@settings(max_examples=400, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=7))
def test_sets_fixed_at_once_equal_those_fixed_one_by_one(counts):
    plan = P.Plan()
    left = P.reduce_dominated(counts, 40, plan)
    assert (left, plan.sequences) == one_by_one(counts, 40)


def test_runs_of_triples_are_few():
    plan = P.pack_lengths({1100: 1_000_000, 500: 1_000_000, 445: 1_000_000})
    assert len(plan.runs) < 50 and plan.sequences == 1_000_000


def test_word_cache_equals_whole_text():
    tok = P.WordTokenizer(P.TOKENIZER)
    for text in ("Hello, World. it's I'LL  12 345\tq\x1cz", "Straße ΟΔΟΣ é, é. 　w", "a<|endoftext|>b",
                 "", " \n", "the. the., x.y don't.", "résumé. naïve, ñ.", "x" * 500):
        want = tok.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(tok.ids(text.encode()), "<u4").tolist() == want


class Counting:
    """The tokenizer, noting what its model is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.given = tokenizer, []

    def __getattr__(self, name):
        return getattr(self.tokenizer, name)

    @property
    def model(self):
        return self

    def tokenize(self, piece):
        self.given.append(piece)
        return self.tokenizer.model.tokenize(piece)


def test_runs_of_letters_are_tokenised_once_in_any_case_and_with_any_marks():
    tok = P.WordTokenizer(P.TOKENIZER)
    text = "canción Canción, (CANCIÓN) canción!! train Train, TRAIN. \"train\" ß7ß don't <b> ÷ª"
    want = tok.tokenizer.encode(text, add_special_tokens=False).ids
    tok.tokenizer = count = Counting(tok.tokenizer)
    assert np.frombuffer(tok.ids(text.encode()), "<u4").tolist() == want
    assert count.given.count("train") == 1
    assert sum(p.startswith("canci") for p in count.given) == 1


def test_words_are_kept_as_their_pieces():
    """The cache has one entry for a run of letters, however the words with it are written."""
    tok = P.WordTokenizer(P.TOKENIZER)
    text = "train Train, TRAIN. (train) train7 7train! élan, Élan."
    want = tok.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(tok.ids(text.encode()), "<u4").tolist() == want
    assert set(tok.seen) == {b"train", b",", b".", b"(", b")", b"7", b"!", "élan".encode()}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAbZ éÉßÿÀ×÷ª'<|>.,!?s \t\n019²\u0301\u00a0\u3000ΣςİK\x1c\x00日"), max_size=14), max_size=5))
def test_texts_of_a_batch_keep_apart(texts):
    tok = P.tokenizer(P.TOKENIZER)
    raw = [t.encode() for t in texts]
    data, offs = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    got = [np.frombuffer(x, "<u4").tolist() for x in tok.each(data, offs)]
    assert got == [tok.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_pack_documents(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice(["alpha", "beta", "x1"]) for _ in range(rnd.randrange(60))), "e") for i in range(80)]
    rows += [(80, None, "e"), (81, "", "e"), (None, "alpha", "e"), (5, rows[5][1], "e"), (90, "beta " * 700, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rank string").repartition(5)
    got = P.pack(docs, capacity=64).collect()
    tok = P.WordTokenizer(P.TOKENIZER).tokenizer
    want = Counter()
    for i, text, _ in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 64):
            part = np.array(ids[k:k + 64], "<u4")
            want[(i, k // 64, k, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 64
    assert len(bins) <= 1.05 * sum(r.length for r in got) / 64 + 1


def test_pack_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert P.pack(docs).count() == 0
