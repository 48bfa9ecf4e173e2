"""Registered queries, the top-k search and the pipeline against brute force."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.compare import compare, duck
from tests.llm.conftest import INNER
from tests.llm.test_text_operators import slow_components, slow_fingerprint, slow_mix
from tracewright.llm import hamming, langid
from tracewright.llm.queries import ORACLES, QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_registered(spark, name):
    if name in ORACLES:
        assert compare(spark, duck(SF), QUERIES[name], ORACLES[name], SF) is None
    else:
        df = QUERIES[name](spark, SF)
        assert df.count() == spark.read.parquet(f"{SF}/documents.parquet").count() and "doc_id" in df.columns


def slow_top_k(rows, queries, k):
    out = []
    for q, c in queries:
        near = sorted((sum(((x ^ y) % (1 << 64)).bit_count() for x, y in zip(c, d)), v) for v, d in rows)[:k]
        out += [(q, n + 1, v, d) for n, (d, v) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("n,k,words", [(3, 10, 1), (60, 5, 2), (400, 10, 1), (150, 3, 3)])
def test_top_k(spark, n, k, words):
    """Clusters, copies in their hundreds, ties, negative codes; fewer rows than k; codes of several words."""
    rng = np.random.default_rng(n)
    number = lambda: [int(x) for x in rng.integers(-(1 << 63), (1 << 63) - 1, words)]
    centres = [number() for _ in range(5)]
    codes = [[c ^ int(sum(1 << int(b) for b in set(rng.integers(0, 62, rng.integers(0, 6))))) for c in centres[i % 5]] for i in range(n)]
    codes += [centres[0]] * (n // 2) + [number() for _ in range(n // 3)]
    rows = list(enumerate(codes))
    df = spark.createDataFrame(rows, "vec_id long, code array<long>").selectExpr("*", "1 as first", "2 as w0", "3 as q0", "4 as seg")
    got = sorted(tuple(r) for r in hamming.top_k(df, df.where("vec_id % 7 = 0"), k).collect())
    assert got == slow_top_k(rows, [r for r in rows if r[0] % 7 == 0], k)


def test_codes(spark):
    wide = [1.0 if i in (0, 64, 129) else -1.0 for i in range(130)]
    rows = [(1, [1.0, -1.0, 0.0, 2.0]), (2, None), (3, []), (4, [float(i % 2) for i in range(70)]), (5, [1.0] * 64), (6, wide)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert {r.vec_id: r.code for r in hamming.codes(df).collect()} == {
        1: [0b1001], 4: [-6148914691236517206, 0b101010], 5: [-1], 6: [1, 1, 2]}
    none = hamming.codes(df.limit(0))
    assert hamming.top_k(none, none).count() == 0


def test_every_element_counts(spark):
    """Vectors that differ beyond their first 64 elements only, and narrower ones, which end in zeros."""
    vectors = [[1.0] * 64 + [1.0 if j < i else -1.0 for j in range(64)] for i in (0, 3, 40)] + [[1.0] * 64]
    df = hamming.codes(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>"))
    got = sorted((r.query_id, r.vec_id, r.distance) for r in hamming.top_k(df, df.where("vec_id in (0, 1)")).collect())
    assert got == [(0, 0, 0), (0, 1, 3), (0, 2, 40), (0, 3, 0), (1, 0, 3), (1, 1, 0), (1, 2, 37), (1, 3, 3)]


def slow_kept(rows, length=100):
    """Texts of what suffix removal leaves."""
    seen, out = set(), []
    for row in sorted(rows):
        data = row[1].encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - length + 1):
            if data[p:p + length] in seen:
                gone[p:p + length] = True
            seen.add(data[p:p + length])
        left = bytes(np.frombuffer(data, np.uint8)[~gone]).decode("utf-8", "ignore")
        if not gone.any() or left.strip(" "):
            out.append((row[0], left if gone.any() else row[1], row[2]))
    return out


def test_pipeline_against_brute_force(spark):
    import sentencepiece
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs, F.lit(True))
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    rows = [r for r in rows if (x := langid.best_language(model, r[1]))[0] != "und" and x[1] >= 0.5]
    of = slow_components([slow_fingerprint(t) for _, t, _ in rows])
    least = {}
    for i, t, _ in rows:
        c = of[slow_fingerprint(t)]
        least[c] = min(i, least.get(c, i))
    rows = slow_kept([r for r in rows if least[of[slow_fingerprint(r[1])]] == r[0]])
    source = {i: s for i, _, s in rows}
    text = {i: t for i, t, _ in rows}
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    want = Counter()
    for _, i, size, _, _, taken in slow_mix(rows):
        if size:
            want[i, source[i], text[i], tuple(library.encode(text[i])), library.decode(library.encode(text[i]))] += taken // size
    got = Counter((r.doc_id, r.source, r.text, tuple(r.ids), r.decoded) for r in corpus_pipeline.run(spark, SF).collect() if r.text.strip())
    assert got == +want


def test_stages_on_odd_rows(spark, odd, nothing):
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, odd, SF)
        assert out.count() > 0 and stage(spark, nothing, SF).count() == 0
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.schema == odd.schema, name
            inner = {tuple(r[-len(INNER):]) for r in out.collect()}  # columns of any name are carried, not used
            assert inner == {tuple(range(len(INNER)))}, name
