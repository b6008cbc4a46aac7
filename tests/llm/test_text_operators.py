"""Operators on single texts against brute-force versions."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import words
from trackyard.llm import op2_decontaminate as D
from trackyard.llm import op4_secrets as S
from trackyard.llm import op6_repetition as R
from trackyard.llm import op9_pii as P
from trackyard.llm.common import Words, column_bytes, grams, pick, sliding_min


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture()
def use(monkeypatch, docs):
    """Let an operator's query read the fixture instead of the stored tables."""
    def put(module, **tables):
        tables = {"documents": docs, **tables}
        monkeypatch.setattr(module, "read", lambda spark, sf_dir, name: tables[name])
    return put


# --- helpers -------------------------------------------------------------------------------

@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=" \n\tabé　", max_size=12), min_size=1, max_size=5))
def test_words(texts):
    import pyarrow as pa
    w = Words(*column_bytes(pa.array(texts)))
    got = [w.data[s:e].tobytes() for s, e in zip(w.start, w.end)]
    assert got == [x for t in texts for x in words(t)]
    assert w.row.tolist() == [i for i, t in enumerate(texts) for _ in words(t)]
    by = defaultdict(set)
    for x, h in zip(got, w.hash.tolist()):
        by[x].add(h)
    assert all(len(v) == 1 for v in by.values()) and len(set().union(*by.values())) == len(by)


def test_rolling():
    x = np.random.default_rng(1).integers(0, 3, 300).astype(np.uint64)
    for n in (1, 2, 3, 7, 31, 50):
        g = grams(x, n).tolist()
        want = [tuple(x[i:i + n]) for i in range(len(x) - n + 1)]
        assert len(set(zip(g, want))) == len(set(g)) == len(set(want))
        assert (sliding_min(x, n) == [min(v) for v in want]).all()


# --- benchmark decontamination ---------------------------------------------------------------

NORMAL = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(text, items, n=10):
    w = NORMAL.findall((text or "").encode().lower())
    hit, found = set(), set()
    for item_id, item in items:
        x = NORMAL.findall((item or "").encode().lower())
        k = min(n, len(x))
        wins = {tuple(x[i:i + k]) for i in range(len(x) - k + 1)} if k else set()
        for i in range(len(w) - k + 1):
            if tuple(w[i:i + k]) in wins:
                hit |= set(range(i, i + k))
                found.add(item_id)
    return len(w), len(hit), {str(i) for i in found if i is not None}


@pytest.fixture(scope="module")
def items(rows):
    out = [(i, " ".join((rows[i][1] or "").split()[5:5 + 8 + i])) for i in range(12)]
    return out + [(50, "One"), (50, "One"), (51, None), (52, "!!"), (None, "two, words"), (53, "Edit3"), (54, "a b c a b c a b c a")]


@pytest.mark.parametrize("block", [D.BLOCK_CHARS, 60])
def test_decontaminate_query(spark, rows, items, use, monkeypatch, block):
    bench = spark.createDataFrame(items, "item_id long, text string")
    use(D, benchmark=bench)
    monkeypatch.setattr(D.scan, "__defaults__", (D.N, block))
    want = Counter()
    for i, t in rows:
        n, hit, found = brute_hits(t, items)
        want[(i, n, hit, len(found), sha(",".join(sorted(found))), hit > 0)] += 1
    assert Counter(tuple(r) for r in D.query(spark, "").collect()) == want


def test_decontaminate_rows(spark, docs, rows, items, empty):
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = D.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(x for x in rows if not brute_hits(x[1], items)[1])
    cut = {(r.doc_id, r.text) for r in D.decontaminate(docs, bench, "spans").collect()}
    assert all(brute_hits(t, items)[1] == 0 or brute_hits(t, items)[0] < 400 for _, t in cut)
    assert {x for x in rows if not brute_hits(x[1], items)[1]} <= cut
    assert D.decontaminate(empty, bench).count() == 0
    assert D.decontaminate(docs, bench.limit(0)).count() == len(rows)


def test_windows_of_equal_hash_and_memory(monkeypatch):
    rnd = random.Random(5)
    items = [(f"i{k}", " ".join(f"w{rnd.randrange(4000)}" for _ in range(1000))) for k in range(300)]
    items += [("again", items[0][1]), (None, items[1][1]), ("short", "only three words")]
    s = D.WindowSet(items, 10)
    size = sum(x.nbytes for got in s.sets.values() for x in got[:3]) + s.data.nbytes + s.start.nbytes + s.end.nbytes
    assert size < 6 * sum(len(t) for _, t in items)
    texts = [items[0][1], items[1][1], "x only three words y", " ".join(items[2][1].split()[5:16])]
    look = lambda: D.find(D.words_of(D.pa.array(texts)), s, s.filters())
    names = lambda got: {r: {i for *_, x in hits for i in x} for r, hits in got.items()}
    want = {0: {"i0", "again"}, 1: {"i1", None}, 2: {"short"}, 3: {"i2"}}
    assert names(look()) == want and len(look()[3]) == 2
    # all hashes equal: the words decide
    monkeypatch.setattr(D, "grams", lambda h, n: np.full(max(0, len(h) - n + 1), 7, np.uint64))
    few = [(a, t[:200]) for a, t in items[:3]] + items[-1:]
    s, texts = D.WindowSet(few, 10), [few[0][1], "x only three words y", "nothing of that at all, and none of the other ten words"]
    assert names(look()) == {0: {"i0"}, 1: {"short"}}


# --- secrets -----------------------------------------------------------------------------------

def brute_secrets(text):
    text = text or ""
    rules = [("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
              lambda m: len(m[2]) >= 6),
             ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24)]
    return [(k, *m.span()) for k, p, ok in rules for m in re.finditer(p, text, re.ASCII) if ok(m)]


def test_secrets_query(spark, rows, use, empty):
    use(S)
    got = S.query(spark, "").collect()
    want = Counter()
    for i, t in rows:
        found = brute_secrets(t)
        n = Counter(k for k, _, _ in found)
        want[(i, n["assign"], n["access"], n["hex"], sha(S.span_digest(found, S.ORDER)))] += 1
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == want
    assert sum(r.n_assign for r in got) and sum(r.n_access for r in got) and sum(r.n_hex for r in got)
    assert S.scan(pick(empty), ["doc_id"]).count() == 0


def test_added_rules():
    text = "é -----BEGIN RSA PRIVATE KEY----- ghp_" + "aZ" * 20 + " eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + ".sig"
    kinds = [k for r in S.RULES for k, _, _ in S._spans(r, re.compile(r.pattern, r.flags), text)]
    assert kinds == ["private_key", "hosting_token", "web_token"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["eyJ", "a" * 10, ".", "x", " ", "-", "é", "eyJ" + "b" * 11, ".eyJ" + "c" * 10 + ".d"]), max_size=14))
def test_web_tokens(parts):
    """Where the plain pattern, tried at every place, finds them."""
    text, rule = "".join(parts), S.RULES[-1]
    plain = [("web_token", *m.span()) for m in re.finditer(r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+", text)]
    assert S._spans(rule, re.compile(rule.pattern, rule.flags), text) == plain


def test_web_token_is_linear():
    rule, text = S.RULES[-1], "eyJ" * 700_000 + "." + "eyJ" * 700_000          # quadratic: hours
    began = time.time()
    assert S._spans(rule, re.compile(rule.pattern, rule.flags), text) == [] and time.time() - began < 20


def holds(query, text):
    if query[0] == "tri":
        return query[1] in text
    return (all if query[0] == "and" else any)(holds(q, text) for q in query[1:])


PARTS = ["abc", "a", "[ab]c", "(ab|cd)", "x?", "(abc)+", "b*", "[a-z]", "(a|bcd)?", "a{3}", "(ab){2,}", "d", "."]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), min_size=1, max_size=6), st.text(alphabet="abcdxA", max_size=20))
def test_trigram_query_is_necessary(parts, text):
    pattern = "".join(parts)
    if re.search(pattern, text, re.ASCII | re.IGNORECASE):
        assert holds(S.trigram_query(pattern, re.ASCII | re.IGNORECASE), text.lower())


def test_trigram_queries_of_rules():
    assert S.trigram_query("[0-9a-f]+") == S.ANY
    assert S.trigram_query("AKIA[A-Z0-9]+") == ("and", ("tri", "aki"), ("tri", "kia"))
    assert S.trigram_query("kelvin", re.IGNORECASE) == S.ANY


# --- repetition ----------------------------------------------------------------------------------

def brute_repetition(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = [len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>")]
    seen, dup = set(), []
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += [line] if line in seen else []
            seen.add(line)
    out.append(len(dup))

    def covered(n, first_too):
        at = defaultdict(list)
        for i in range(len(w) - n + 1):
            at[tuple(w[i:i + n])].append(i)
        return {j for v in at.values() if len(v) > 1 for i in v[0 if first_too else 1:] for j in range(i, i + n)}
    out.append(len(covered(3, True)))
    base = max(1, out[1])
    shares = [sum(len(w[j]) for j in covered(n, False)) / base for n in R.GRAM_SHARES]
    shares.append(sum(len(x) for line in dup for x in re.findall(r"[^\x20\x09-\x0D]+", line)) / base)
    failed = out[0] < 50 or 100 * out[4] > 50 * out[0]
    kept = (not failed and all(s <= m for s, m in zip(shares, R.GRAM_SHARES.values())) and shares[-1] <= R.LINE_SHARE
            and out[2] <= R.SYMBOLS_PER_WORD * out[0])
    return tuple(out), failed, kept, tuple(round(s, 9) for s in shares)


def test_repetition_query(spark, rows, use, empty):
    use(R)
    got = Counter((r[0], tuple(r[1:6]), r.base_failed, r.kept, tuple(round(x, 9) for x in r[8:]))
                  for r in R.query(spark, "").collect())
    assert got == Counter((i, *brute_repetition(t)) for i, t in rows)
    assert R.rules(pick(empty), ["doc_id"]).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab \n", max_size=40), min_size=1, max_size=4))
def test_repetition_measures(texts):
    import pyarrow as pa
    m = R.measures(*column_bytes(pa.array(texts)))
    for i, t in enumerate(texts):
        counts, _, _, shares = brute_repetition(t)
        assert tuple(int(m[c][i]) for c in R.COLUMNS) == counts
        assert tuple(round(float(m[c][i]), 9) for c in R.SHARES) == shares


# --- personal data -----------------------------------------------------------------------------------

def brute_pii(text):
    text = text or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda x: (x[1], P.ORDER[x[0]]))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a@.1+- (9é", max_size=40))
def test_pii_patterns(text):
    assert P.base_spans(text) == brute_pii(text)


def test_pii_query(spark, rows, use):
    use(P)
    got = Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in P.query(spark, "").collect())
    want = Counter()
    for i, t in rows:
        if i == 2009:       # the plain patterns take minutes there
            found = []
        else:
            found = brute_pii(t)
        n = Counter(k for k, _, _ in found)
        want[(i, n["email"], n["ip"], n["card"], n["phone"], sha(P.span_digest(found, P.ORDER)))] += 1
    assert got == want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab@.1+- é", max_size=60))
def test_pii_contexts(text):
    """The eight terms on either side, whatever their length."""
    spans = P.base_spans(text)
    inside = {i for _, s, e in spans for i in range(s, e)}
    term = re.compile(r"[A-Za-z\x80-\U0010ffff]+")
    for found, (_, s, e) in zip(P.contexts(text, spans, 3), spans):
        near = [m.span() for m in term.finditer(text, 0, s)][-3:] + [m.span() for m in term.finditer(text, e)][:3]
        assert [(t["start"], t["end"]) for t in found["terms"]] == [(a, b) for a, b in near if not inside & set(range(a, b))]
    assert len(P.contexts(text, spans)) == len(spans)


def test_pii_contexts_of_long_words():
    words = ["supercalifragilisticexpialidociousabcdefghijk" + chr(97 + i) * 50 for i in range(16)]
    text = " ".join([*words[:8], "a.b@c.de", *words[8:]])
    (found,) = P.contexts(text, P.base_spans(text))
    assert [text[t["start"]:t["end"]] for t in found["terms"]] == words


def pii_corpus():
    rnd = random.Random(5)
    noise = [f"n{c}{d}{e}" for c in "abcdefgh" for d in "klmnop" for e in "uvwxyz"]
    noise = [x.replace("1", "") for x in noise]
    out = []
    for i in range(120):
        text = [rnd.choice(noise) for _ in range(30)]
        if i < 6:
            text[10:10] = ["Zorblatt", "wrote", "from", "z.blatt@mail.example"]     # a name only seen with the address
        elif i < 12:
            text[10:10] = ["wrote", "from", f"u{i}@mail.example"]
        out.append((i, " ".join(text)))
    return out + [(200 + i, "copied hapaxword near same.person@mail.example again") for i in range(5)]


def brute_terms(corpus):
    """(entity, term) pairs by the definition."""
    both, contexts, with_e, with_t = (defaultdict(set) for _ in range(4))
    for i, (_, text) in enumerate(corpus):
        text = text or ""
        spans = brute_pii(text)
        for t in re.findall(r"[A-Za-z\x80-\U0010ffff]+", text):
            with_t[t.lower()].add(i)
        for k, s, e in spans:
            near = re.findall(r"[A-Za-z\x80-\U0010ffff]+", text[:s])[-P.CONTEXT:] + \
                re.findall(r"[A-Za-z\x80-\U0010ffff]+", text[e:])[:P.CONTEXT]
            ent = (k, text[s:e])
            with_e[ent].add(i)
            for t in near:
                both[ent, t.lower()].add(i)
                contexts[ent, t.lower()].add(tuple(near))
    n, out = len(corpus), set()
    for (ent, t), d in both.items():
        pmi = np.log2(n * len(d) / (len(with_t[t]) * len(with_e[ent])))
        if len(contexts[ent, t]) >= P.SUPPORT and pmi >= P.DISCLOSED * -np.log2(len(with_e[ent]) / n):
            out.add((ent, t))
    return out


def test_disclosing_terms(spark):
    corpus = pii_corpus()
    want = brute_terms(corpus)
    assert (("email", "z.blatt@mail.example"), "zorblatt") in want and "hapaxword" not in {t for _, t in want}
    assert "wrote" not in {t for _, t in want}
    docs = spark.createDataFrame(corpus, "doc_id long, text string").repartition(4)
    found, added = P.protected(docs)
    text = dict(corpus)
    got = {(r.kid, text[r.kid][s.start:s.end].lower()) for r in added.collect() for s in r.added}
    expected = {(i, t) for (k, v), t in want for i, x in corpus if v in x and t in x.lower().split()}
    assert got == expected
    clean = {r.doc_id: r.text for r in P.sanitise(docs).collect()}
    assert all("Zorblatt [" not in t and "z.blatt@" not in t for t in clean.values())
    assert "[term] wrote from [email]" in clean[0]
    assert all(clean[i] == t for i, t in corpus if not brute_pii(t))
    assert "@" not in " ".join(r.text for r in P.sanitise(docs, "remove").collect())


def test_sanitise_rows(docs, rows, empty):
    got = P.sanitise(docs)
    assert got.columns == docs.columns
    got = got.collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    assert sum(r.text is None for r in got) == 2 and all(not brute_pii(r.text) for r in got if r.doc_id != 2009)
    assert P.sanitise(empty).count() == 0
