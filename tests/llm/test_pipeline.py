"""The pipeline against a brute-force version, and the registry of corpus queries."""

import zlib
from collections import Counter

import numpy as np

import __spark_entry__ as E
import corpus_pipeline as CP
from tests.conftest import SF_SMALL
from tests.llm.test_corpus_operators import brute_components, brute_fp
from tests.llm.test_text_operators import brute_hits, brute_pii, brute_terms
from trackyard.llm import op5_toxicity as T
from trackyard.llm import op9_pii as P
from trackyard.llm import op10_packing as B
from trackyard.llm.common import shared_dir


def test_registry():
    names = [n for n in E.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in E.queries() and [n for n, _ in CP.STAGES] == [
        "toxicity", "near_dedup", "decontaminate", "pii", "packing"]


def generalised(corpus):
    """Texts with personal data and disclosing terms replaced by their kind."""
    secret = brute_terms(corpus)
    out = []
    for i, text in corpus:
        if text is None:
            out.append((i, text))
            continue
        spans = brute_pii(text)
        added = {("term", s, e) for s, e in
                 ((t["start"], t["end"]) for c, (k, s0, e0) in zip(P.contexts(text, spans), spans) for t in c["terms"]
                  if ((k, text[s0:e0]), text[t["start"]:t["end"]].lower()) in secret)}
        done, end = "", 0
        for k, s, e in sorted({*spans, *added}, key=lambda x: (x[1], -x[2], P.ORDER[x[0]])):
            if s >= end:
                done += text[end:s] + f"[{k}]"
            end = max(end, e)
        out.append((i, done + text[end:]))
    return out


def test_pipeline(spark, rows):
    rows = [r for r in rows if r[0] != 2009]          # the plain patterns take minutes there
    base = f"{shared_dir(spark)}/pipeline-input-{zlib.crc32(repr(rows).encode())}"
    data = [(i, t, "en", "src1", len(t or "")) for i, t in rows]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(4) \
        .write.mode("overwrite").parquet(f"{base}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF_SMALL}/{t}.parquet").write.mode("overwrite").parquet(f"{base}/{t}.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{base}/benchmark.parquet").collect()]

    docs, stages = spark.read.parquet(f"{base}/documents.parquet"), []
    for name, stage in CP.STAGES[:-1]:
        docs = CP.stored(stage(spark, docs, base), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        stages.append(Counter((r.doc_id, r.text) for r in docs.collect()))

    scores = {r.doc_id: r.score for r in T.query(spark, base).collect()}
    left = [(i, t) for i, t in rows if scores[i] < 0.5]
    assert stages[0] == Counter(left)
    fps = [(i, brute_fp(t)) for i, t in left]
    comp = brute_components(fps)
    assert Counter(i for i, _ in stages[1].elements()) == Counter(brute_components(fps, groups=True))
    assert all((i, t) in set(left) for i, t in stages[1]) and {c for c in comp} == {i for i, _ in stages[1]}
    kept = list(stages[1].elements())
    clean = [(i, t) for i, t in kept if not brute_hits(t, items)[1]]
    assert stages[2] == Counter(clean)
    final = generalised(clean)
    assert stages[3] == Counter(final)

    tok = B.WordTokenizer(B.TOKENIZER).tokenizer
    want = Counter()
    for i, t in final:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        for k in range(0, len(ids), 2048):
            want[(i, k // 2048, k, len(ids[k:k + 2048]), zlib.crc32(ids[k:k + 2048].tobytes()))] += 1
    got = CP.run(spark, base).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    total = Counter()
    for r in got:
        total[r.sequence_id] += r.length
    assert max(total.values()) <= 2048
