"""Operators over whole corpora against brute-force versions."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import words
from trackyard.llm import components as C
from trackyard.llm import op1_substring as O
from trackyard.llm import op3_quality as Q
from trackyard.llm import op5_toxicity as T
from trackyard.llm import op7_katz as K
from trackyard.llm import op8_simhash as H
from trackyard.llm.common import pick


@pytest.fixture()
def use(monkeypatch, docs):
    def put(module, **tables):
        tables = {"documents": docs, **tables}
        monkeypatch.setattr(module, "read", lambda spark, sf_dir, name: tables[name])
    return put


# --- substring dedup ---------------------------------------------------------------------------

def brute_substring(rows, window=50):
    least = {}
    for i, t in rows:
        w = words(t)
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k:k + window])
                least[key] = min(i, least.get(key, i))
    out = Counter()
    for i, t in rows:
        w = words(t)
        gone = {j for k in range(len(w) - window + 1) if i is not None and least[tuple(w[k:k + window])] < i
                for j in range(k, k + window)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        out[(i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())] += 1
    return out


@pytest.mark.parametrize("shard", [O.SHARD, 2])
def test_substring_query(spark, rows, use, monkeypatch, shard):
    use(O)
    monkeypatch.setattr(O.duplicate_spans, "__defaults__", (shard,))
    want = brute_substring(rows)
    assert sum(r[2] for r in want) > 1000
    assert Counter(tuple(r) for r in O.query(spark, "").collect()) == want


def test_substring_rows(docs, rows, empty):
    got = O.remove_duplicates(docs)
    assert got.columns == docs.columns
    clean = {(i, n - r) for (i, n, r, _), c in brute_substring(rows).items()}
    assert {(r.doc_id, len(words(r.text))) for r in got.collect()} == clean
    assert O.remove_duplicates(empty).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=1, max_size=14), min_size=1, max_size=5), st.text(alphabet="abc", max_size=14))
def test_matching_statistics(texts, query):
    a = O.SuffixAutomaton()
    for i, t in enumerate(texts):
        a.add(t, 10 - i)
    a.finish()
    for cap in (None, 3):
        for end, (n, owner) in enumerate(a.statistics(query, cap), 1):
            want = max(k for k in range(min(end, cap or end) + 1) if any(query[end - k:end] in t for t in texts))
            assert n == want
            if n:
                assert owner == min(10 - i for i, t in enumerate(texts) if query[end - n:end] in t)


# --- SimHash -------------------------------------------------------------------------------------

def brute_fp(text, shingle=4):
    w = [x.lower() for x in words(text)]
    if not w:
        return 0
    k = min(shingle, len(w))
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + k]), 42) for i in range(len(w) - k + 1)]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def brute_components(fps, distance=4, groups=False):
    """component_id of each (doc_id, fp), or with ``groups`` of each component"""
    fps = list(fps)
    group = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i][1] ^ fps[j][1]).count("1") <= distance and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    ids = defaultdict(list)
    for g, (i, _) in zip(group, fps):
        ids[g].append(i)
    name = {g: min((x for x in own if x is not None), default=None) for g, own in ids.items()}
    return list(name.values()) if groups else [name[g] for g in group]


def test_simhash_query(spark, rows, use):
    use(H)
    fps = [(i, brute_fp(t)) for i, t in rows]
    want = Counter((i, f"{f:016x}", c) for (i, f), c in zip(fps, brute_components(fps)))
    assert Counter(tuple(r) for r in H.query(spark, "").collect()) == want


def test_one_of_each(docs, rows, empty):
    comps = brute_components([(i, brute_fp(t)) for i, t in rows], groups=True)
    got = H.one_of_each(docs)
    assert got.columns == docs.columns
    assert Counter(r.doc_id for r in got.collect()) == Counter(comps)
    assert H.one_of_each(empty).count() == 0


@pytest.mark.parametrize("bucket,distance", [(H.BUCKET, 4), (8, 4), (H.BUCKET, 1)])
def test_links_lose_nothing(spark, bucket, distance):
    rnd = random.Random(bucket + distance)
    fps = {rnd.getrandbits(64) for _ in range(200)}
    for f in list(fps)[:40]:
        for _ in range(6):
            for b in rnd.sample(range(64), rnd.randrange(1, distance + 3)):
                f ^= 1 << b
            fps.add(f)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(s,) for s in signed], "fp long").repartition(3).cache()
    roots = {r.node: r.root for r in C.components(H.links(df, distance, bucket)).collect()}
    comp = brute_components(list(zip(signed, fps)), distance)
    by_root, by_comp = defaultdict(set), defaultdict(set)
    for s, c in zip(signed, comp):
        by_root[roots.get(s, s)].add(s)
        by_comp[c].add(s)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, by_comp.values()))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 9), st.integers(0, 6), st.integers(10, 10 ** 8))
def test_plan_keeps_the_pigeonhole(seed, distance, n):
    rng = np.random.default_rng(seed)
    sample = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    parts = H.plan(sample, n, distance)
    assert sum(t + 1 for _, t in parts) == distance + 1
    bits = [b for g, _ in parts for b in g]
    assert len(bits) == len(set(bits))


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(300)] + [(500, 501), (502, 501), (9, 9), (7, 6)]
    got = {r.node: r.root for r in C.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert len({got[i] for i in range(301)}) == 1 and len({got[i] for i in (500, 501, 502)}) == 1
    assert got[0] != got[500] and set(got) == {*range(301), 500, 501, 502}


# --- Katz back-off ---------------------------------------------------------------------------------

class BruteKatz:
    """Katz back-off of any order by dictionaries; contexts are tuples, the nearest word last, None before the text."""

    def __init__(self, rows, order, held=None):
        self.order, self.held = order, held or self.of_query
        self.count = [Counter() for _ in range(order + 1)]
        for i, t in rows:
            if not self.held(i):
                for k in range(1, order + 1):
                    self.count[k].update(self.grams(t, k))
        self.n, self.v = sum(self.count[1].values()), len(self.count[1])
        self.after = [defaultdict(dict) for _ in range(order + 1)]
        self.d = [None, None]
        for k in range(1, order + 1):
            for g, c in self.count[k].items():
                self.after[k][g[:-1]][g[-1]] = c
            n = Counter(self.count[k].values())
            if k > 1:
                self.d.append(K.Discounts(np.array([0] + [n[r] for r in range(1, K.K + 2)] + [0])))

    @staticmethod
    def of_query(i):
        return i is not None and zlib.crc32(str(i).encode()) % 7 == 2

    @staticmethod
    def tokens(t):
        return [w.lower() for w in words(t)] + ["end"]     # words are bytes, so the end is no word

    def grams(self, t, k):
        x = [None] * (k - 1) + self.tokens(t)
        return [tuple(x[j:j + k]) for j in range(len(x) - k + 1)]

    def p(self, g):
        k, (*context, w) = len(g), g
        if k == 1:
            return (self.count[1][g] + 1) / (self.n + self.v + 1)
        seen = self.after[k].get(tuple(context))
        if not seen:
            return self.p(g[1:])
        known, total = (lambda c: float(self.d[k].seen(np.array(c)))), sum(seen.values())
        left = 1 - sum(map(known, seen.values())) / total
        if left < 1e-12:
            total, left = total + 1, 1 / (total + 1)
        if w in seen:
            return known(seen[w]) / total
        return left / (1 - sum(self.p((*context[1:], x)) for x in seen)) * self.p(g[1:])


@pytest.mark.parametrize("order,owned", [(1, 3000), (2, 3000), (3, K.OWNED), (3, 2000), (4, 5000)])
def test_katz_query(spark, rows, use, monkeypatch, order, owned):
    use(K)
    monkeypatch.setattr(K, "BLOCK_BYTES", 60_000)
    monkeypatch.setattr(K.train_and_score, "__defaults__", (order, owned))
    m = BruteKatz(rows, order)
    memo = {}
    log = lambda g: memo[g] if g in memo else memo.setdefault(g, math.log10(m.p(g)))
    want = sorted([(i if i is not None else -99, m.held(i), len(x := m.grams(t, 1)), sum(m.count[1][g] > 0 for g in x), m.n,
                    sum(map(log, x)), sum(map(log, m.grams(t, order)))) for i, t in rows])
    got = sorted([(r[0] if r[0] is not None else -99, *r[1:]) for r in K.query(spark, "").collect()])
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("owned", [K.OWNED, 500])
def test_katz_table(spark, rows, monkeypatch, owned):
    """The stored model as rows: counts of all orders, and p(. | context) sums to 1 in every context."""
    from pyspark.sql import functions as F
    some = [r for r in rows[:40] if r[1]] + [(9000 + i, "a b c a b d " * (i + 1)) for i in range(6)]
    docs = spark.createDataFrame(some, "doc_id long, text string").repartition(3)
    _, model = K.train_and_score(docs, F.col("doc_id") % 5 == 1, 3, owned)
    table = defaultdict(dict)
    back = {(): 0.0}
    for r in model.table().collect():
        h = tuple(r.context)
        assert r.word not in table[h] and back.setdefault(h, r.log_backoff) == pytest.approx(r.log_backoff, abs=1e-12)
        table[h][r.word] = (r["count"], 10 ** r.log_prob)
    m = BruteKatz(some, 3, lambda i: i % 5 == 1)
    for k in (1, 2, 3):
        assert Counter(c for h, x in table.items() if len(h) == k - 1 for c, _ in x.values() if c) == Counter(m.count[k].values())
    unknown = 1 / model.mass
    vocabulary = [w for w, (c, _) in table[()].items() if c]

    def p(w, h):
        if not h:
            return table[()][w][1] if w in table[()] else unknown
        return table[h][w][1] if w in table.get(h, {}) else 10 ** back.get(h, 0.0) * p(w, h[:-1])     # nearest word first

    assert any(len(h) == 2 for h in table)
    for h in random.Random(1).sample(sorted(table), 250) + sorted((h for h in table if len(h) < 2), key=lambda h: -len(table[h]))[:20]:
        assert sum(p(w, h) for w in [*vocabulary, -1]) == pytest.approx(1, abs=1e-9)


def test_katz_keeps_on_disk_what_it_reads_again(spark, rows):
    """Blocks go once they are stored with their ids, and letters to them; a share's rising numbers take few bytes."""
    import os

    from pyspark.sql import functions as F

    from trackyard.llm.common import shared_dir
    at = f"{shared_dir(spark)}/llm"
    before = set(os.listdir(at)) if os.path.isdir(at) else set()
    docs = spark.createDataFrame([r for r in rows if r[0] is not None], "doc_id long, text string")
    scored, _ = K.train_and_score(docs, F.col("doc_id") % 5 == 1, 3, 2000)
    assert scored.count() == docs.count()
    new = {d.split("-")[0]: sorted(f for f in os.listdir(f"{at}/{d}") if f.startswith("kind="))
           for d in set(os.listdir(at)) - before}
    assert set(new) == {"tokens", "named", "shares"} and new["tokens"] == ["kind=sums", "kind=unigrams"]


def test_katz_sums_of_split_contexts_are_few_letters(spark):
    """A word of several owners with many contexts: a letter for each owner and adder, not a row for each context."""
    import os

    from pyspark.sql import functions as F

    from trackyard.llm.common import shared_dir
    at = f"{shared_dir(spark)}/llm"
    before = set(os.listdir(at)) if os.path.isdir(at) else set()
    docs = spark.createDataFrame([(i, f"w{i % 400} a x w{i % 7} a y") for i in range(1200)], "doc_id long, text string")
    _, model = K.train_and_score(docs, F.lit(False), 3, 1000)
    new, = (d for d in set(os.listdir(at)) - before if d.startswith("shares-"))
    letters = spark.read.parquet(f"{at}/{new}/kind=split")
    assert 0 < letters.where("level = 3").count() <= 3 * 3 * 3      # of three words at most, by owner and adder
    contexts = {tuple(r.context): r.log_backoff for r in model.table().where("order = 3").collect()}
    assert len(contexts) > 400


def test_numbers_take_little_memory():
    import tracemalloc
    x = np.arange(1_500_000) % 70_000
    tracemalloc.start()
    data, _ = K.varints(x.astype(K.U))
    wrote = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    values, _ = K.numbers(data)
    read = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (values == x).all() and max(wrote, read) < 50 * len(x)      # bytes, 8 of them the input


@pytest.mark.parametrize("x", [[], [0], [5, 3, 1 << 62, 0, 0], list(range(0, 9000, 7))])
def test_compact_numbers(x):
    x = np.array(x, np.int64)
    for near in (False, True):
        assert K.expanded(K.compact(x, near)).tolist() == x.tolist()
    assert len(x) < 99 or 10 * len(K.compact(x, near=True)) < len(K.packed(x))


def test_katz_empty(spark, docs, empty):
    from pyspark.sql import functions as F
    assert K.train_and_score(empty, F.lit(False))[0].count() == 0
    unseen, model = K.train_and_score(docs, F.lit(True))
    assert {(r.train_tokens, r.score) for r in unseen.collect()} == {(0, 0.0)}
    assert model.table().where("order > 1").count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2 ** 63 - 1), max_size=4), st.lists(st.integers(0, 300), max_size=5)),
                min_size=1, max_size=6))
def test_letters_round_trip(parts):
    streams = [(np.array([x for p in parts for x in p[k]], np.int64), np.array([len(p[k]) for p in parts])) for k in (0, 1)]
    got = K.opened(K.pa.chunked_array([K.letters(*streams)]), 2)
    for (x, n), (y, m) in zip(streams, got):
        assert x.tolist() == y.tolist() and n.tolist() == m.tolist()


def test_discounts():
    good = K.Discounts(np.array([0, 1000, 400, 200, 120, 80, 60, 0]))
    assert good.absolute is None and ((0 < good.d[1:]) & (good.d[1:] < 1)).all()
    total = sum(r * n * (1 - good.d[r]) for r, n in zip(range(1, 6), (1000, 400, 200, 120, 80)))
    assert total == pytest.approx(1000)         # Katz: the discounts free the mass of the singletons
    assert K.Discounts(np.array([0, 10, 0, 0, 0, 0, 0, 0])).absolute == 0.5


# --- toxicity and quality -----------------------------------------------------------------------------

def test_grammar_marks():
    read = lambda s: [m for _, m in T.GRAMMAR.read([(c, "") for c in s])]
    assert read("OI") == ["", ""]
    assert read("NOI") == ["", "", "n"] and read("NOOOI")[-1] == ""
    assert read("ROOOOOOI")[-1] == "r"
    assert read("YI")[-1] == "t" and read("NYI")[-1] == "nt"
    assert read("YNRI")[-1] == "nrt"


def test_clauses_change_the_features():
    lexicon = T.Lexicon({"fool": 3.0, "vequ*": 2.0})
    f = lambda t: dict(zip(T.FEATURES, T.features(t, lexicon)))
    assert f("nothing here") == dict.fromkeys(T.FEATURES, 0.0)
    assert f("you fool")["targeted"] > 0 and f("some fool")["targeted"] == 0
    assert f("not a fool")["sum"] == 0 and f("not a fool")["negated"] > 0
    assert f("not now. a fool")["negated"] == 0
    assert f("he said fool")["reported"] > 0 and f('a "fool" there')["reported"] > 0
    assert f("vequxyz")["sum"] > 0 and f("vequ")["sum"] == 0
    assert f("i kill you")["threat_at_target"] > 0 and f("never kill you")["threats"] == 0
    assert f("") == dict.fromkeys(T.FEATURES, 0.0)


def site(spark, n=600, seed=4):
    rnd = random.Random(seed)
    vocab = [f"{a}{b}{c}" for a in "klmnprst" for b in "aeiou" for c in "klmnprst"]
    rows, labels = [], []
    for i in range(n):
        text = [rnd.choice(vocab) for _ in range(rnd.randrange(20, 60))]
        toxic, low = rnd.random() < 0.2, rnd.random() < 0.25
        if toxic:
            text[rnd.randrange(len(text))] = rnd.choice(["grobian", "zorplak", "zorplen", "zorplus", "zorpla"])
        if low:
            text = [f"{w}%%% ###" for w in text]
        rows.append((i, " ".join(text), "en", f"src{i % 3}"))
        labels.append((i, int(not low), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out(spark, use):
    docs, labels = site(spark)
    use(T, documents=docs, labels=labels)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = T.query(spark, "").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    # held-out labels are never read
    from pyspark.sql import functions as F
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic"))
                               .otherwise(F.col("toxic")))
    use(T, documents=docs, labels=turned)
    assert {r.doc_id: r.score for r in T.query(spark, "").collect()} == {r.doc_id: r.score for r in got}
    kept = T.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.score < 0.5}


def test_toxicity_hard_rows(spark, docs, rows, use, empty):
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (2, 1, None), (None, 0, 1), (9999, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    use(T, labels=labels)
    got = T.query(spark, "").collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows) and all(0 <= r.score <= 1 for r in got)
    use(T, labels=labels.limit(0))
    assert {r.score for r in T.query(spark, "").collect()} == {0.0}
    use(T, documents=empty, labels=labels)
    assert T.query(spark, "").count() == 0


def test_quality_held_out(spark, use, docs, rows, empty):
    few, labels = site(spark)
    use(Q, documents=few, labels=labels)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in Q.query(spark, "").collect() if r.held_out]
    assert sum(int(r.kept) == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    use(Q, labels=labels.limit(0))
    got = Q.query(spark, "").collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    use(Q, documents=empty, labels=labels)
    assert Q.query(spark, "").count() == 0


def test_posteriors_shrink(spark):
    data = [("big", "x", 0.9)] * 400 + [("big", "y", 0.8)] * 400 + [("low", "x", 0.1)] * 400 + [("tiny", "x", 0.1)]
    sites, mean = Q.posteriors(spark.createDataFrame(data, "host string, path string, p double"))
    got = {(r.host, r.path): r for r in sites.collect()}
    assert mean == pytest.approx(sum(p for *_, p in data) / len(data))
    assert abs(got["big", "x"].path_posterior - 0.9) < 0.06
    assert got["low", "x"].path_posterior < 0.15
    tiny = got["tiny", "x"]
    assert 0.3 < tiny.host_posterior < mean and tiny.path_posterior > 0.25      # one document moves little


# --- quality and toxicity by plain Python ----------------------------------------------------------------

def brute_form(text):
    data = text.encode()
    w, lines, n = data.split(), data.split(b"\n"), max(1, len(data.split()))
    chars = lambda allowed: sum(data.count(bytes([c])) for c in allowed)
    capital, digit = chars(range(0x41, 0x5B)), chars(b"0123456789")
    letter, span = capital + chars([*range(0x61, 0x7B), *range(0x80, 0x100)]), max(1, len(data))
    starts, again = set(), 0
    for x in (line.split() for line in lines):
        if x:
            key = (x[0], x[1] if len(x) > 1 else x[0])
            again += len(x) * (key in starts)
            starts.add(key)
    return [math.log1p(len(w)), sum(map(len, w)) / n, chars(b"#*$%&<>@^~=_{}[]\\") / n, data.count(b"|") / n, data.count(b"!") / n,
            capital / max(1, letter), digit / span, (span - letter) / span, sum(len(x) <= 3 for x in w) / n,
            sum(a == b for a, b in zip(w, w[1:])) / n, len(set(w)) / n, sum(x[-1:] in b".," for x in w) / n,
            len(w) / len(lines) / 50, again / n]


def brute_strength(groups):
    """groups: (n, k, mean that the group is drawn to)"""
    n = sum(g[0] for g in groups)
    between = sum(a * (k / a - m) ** 2 for a, k, m in groups)
    within = sum(a * m * (1 - m) for a, k, m in groups)
    rho = between / within - len(groups) / n
    return 1e6 if len(groups) < 2 or not between or rho <= 1e-6 else min(1e6, max(1.0, 1 / rho - 1))


def test_quality_by_brute_force(spark):
    docs, labels = site(spark, 300)
    from pyspark.sql import functions as F
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 7 > 0, F.col("source"))) \
        .withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "de").otherwise("en")) \
        .withColumn("text", F.when(F.col("doc_id") % 50 == 3, "").otherwise(F.concat("text", F.lit("\nÜber | A! 12, x x\nÜber |"))))
    rows = [(r.doc_id, r.text, r.source, r.lang) for r in docs.collect()]
    truth = {r.doc_id: r.quality for r in labels.collect()}
    forms = {i: brute_form(t) for i, t, *_ in rows}
    train = sorted(i for i in truth if zlib.crc32(str(i).encode()) % 5)
    model = Q.Classifier.fit(np.array([forms[i] for i in train]), np.array([truth[i] for i in train], float))
    p = {i: float(min(max(model.evidence(np.array([forms[i]]))[0], 1e-6), 1 - 1e-6)) for i in forms}
    host, path = defaultdict(list), defaultdict(list)
    for i, _, h, q in rows:
        host[h].append(p[i])
        path[h, q].append(p[i])
    mean = sum(p.values()) / len(p)
    m = brute_strength([(len(x), sum(x), mean) for x in host.values()])
    above = {h: (sum(x) + m * mean) / (len(x) + m) for h, x in host.items()}
    m2 = brute_strength([(len(x), sum(x), above[h]) for (h, _), x in path.items()])
    logit = lambda x: math.log(x / (1 - x))
    want = {}
    for i, _, h, q in rows:
        n, k = len(path[h, q]), sum(path[h, q])
        z = logit(p[i]) - logit(mean) + logit(min(max((k - p[i] + m2 * above[h]) / (n - 1 + m2), 1e-9), 1 - 1e-9))
        want[i] = (p[i], above[h], (k + m2 * above[h]) / (n + m2), 1 / (1 + math.exp(-z)))
    got = {r.doc_id: r[1:] for r in Q.quality(docs, labels).collect()}
    assert got.keys() == want.keys()
    for i in want:
        assert got[i] == pytest.approx(want[i], rel=1e-6, abs=1e-7)


def brute_terms(text):
    words = {w for w in T.TOKEN.findall(text.lower()) if w.isalpha()}
    return words | {w[:k] + "*" for w in words for k in T.STEMS if len(w) > k}


def brute_marks(text, weights):
    """The values of ``features`` without transducers: every clause is searched around each insult and threat."""
    fixed = [("T", T.THREAT), ("Y", T.TARGET), ("N", T.NEGATION), ("R", T.REPORT)]
    out, clause, quoted = Counter(), [], False
    for word in [*T.TOKEN.findall(text.lower()), "."]:
        stems = [word[:k] + "*" for k in sorted(T.STEMS, reverse=True) if len(word) > k and word[:k] + "*" in weights]
        if word in T.QUOTES and word not in weights:
            quoted = not quoted
            clause.append(("R" if quoted else "O", 0))
        elif word not in T.ENDS:
            base = next((b for b, ws in fixed if word in ws), None)
            clause.append(("I", weights[word]) if word in weights else (base, 0) if base else
                          ("I", weights[stems[0]]) if stems else ("O", 0))
        else:
            bases = [b for b, _ in clause]
            for i, (b, x) in enumerate(clause):
                negated, reported = "N" in bases[max(0, i - 3):i], "R" in bases[:i]
                near = "Y" in bases[max(0, i - 5):i] + bases[i + 1:i + 6]
                if b == "I":
                    out["negated" if negated else "reported" if reported else "sum"] += x
                    out["count"] += 1
                    out["best"] = max(out["best"], x)
                    out["targeted"] += x * near
                elif b == "T" and not negated and not reported:
                    out["threats"] += 1
                    out["threat_at_target"] += near
            clause = []
    return [math.log1p(out[f]) for f in T.FEATURES]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("fool vequxyz kill you not he said . , and the \" ; tú x".split() + ["\n"]), max_size=25))
def test_features_by_brute_force(parts):
    weights = {"fool": 3.0, "vequ*": 2.0, "tú": 1.5}
    assert T.features(" ".join(parts), T.Lexicon(weights)) == pytest.approx(brute_marks(" ".join(parts), weights))


def test_toxicity_by_brute_force(spark, use):
    from pyspark.sql import functions as F
    docs, labels = site(spark)
    docs = docs.withColumn("text", F.regexp_replace("text", "%%% ###", ""))       # no near copies, which count once
    use(T, documents=docs, labels=labels)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    train = [i for i in sorted(texts) if zlib.crc32(str(i).encode()) % 5]
    with_term = [Counter(t for i in train if truth[i] == y for t in brute_terms(texts[i])) for y in (0, 1)]
    neg, pos = (sum(truth[i] == y for i in train) for y in (0, 1))
    often = {t: a for t, a in with_term[1].items() if a >= 3}
    weights = {}
    for t, a in often.items():
        b = with_term[0][t]
        one = t.endswith("*") and max([n for w, n in often.items() if not w.endswith("*") and w.startswith(t[:-1])], default=0) > 0.8 * a
        share, base = a / (a + b), pos / (pos + neg)
        gain = a * math.log(share / base) + (b * math.log((1 - share) / (1 - base)) if b else 0)
        if share >= 0.8 and not one and gain > math.log(20 * len(often)):
            weights[t] = math.log((a + 0.5) / (pos + 1)) - math.log((b + 0.5) / (neg + 1))
    assert "grobian" in weights and "zorpl*" in weights
    x = {i: brute_marks(t, weights) for i, t in texts.items()}
    w = T.logistic(np.array([x[i] for i in train]), np.array([truth[i] for i in train], float))
    for r in T.query(spark, "").collect():
        assert r.score == pytest.approx(1 / (1 + math.exp(-(np.dot(x[r.doc_id], w[:-1]) + w[-1]))), rel=1e-5, abs=1e-7)
