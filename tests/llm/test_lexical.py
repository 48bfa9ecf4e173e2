"""Lexical search against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_text_operators import SMALL, lower
from tracewright.llm import lexical

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def slow_search(docs, items, k):
    """Rows of (item_id, rank, doc_id, score), one list per item."""
    found = [(i, Counter(re.findall(TERM, lower(t)))) for i, t in docs]
    found = [(i, c, sum(c.values())) for i, c in found if c]
    n_docs, n_terms = len(found), sum(n for _, _, n in found)
    df = Counter(t for _, c, _ in found for t in c)
    out = []
    for item_id, text in items:
        scores = []
        asked = re.findall(TERM, lower(text))
        for i, c, n in found:
            m = 100 - 75 + 75 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
                        for t in asked if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item_id, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def random_corpus(seed, n):
    """Common and rare terms, empty texts, many copies of one text, ids that repeat or are missing."""
    rng = np.random.default_rng(seed)
    words = [f"t{int(x)}" for x in rng.zipf(1.4, 4000) % 700]
    texts = [" ".join(rng.choice(words, int(rng.integers(0, 60)))) for _ in range(n)] + ["same old text t1 t2 zebra"] * (n // 3)
    docs = [(int(i), t) for i, t in enumerate(texts)] + [(3, texts[5]), (None, texts[6]), (None, None), (7777, "...")]
    items = [(i, " ".join(rng.choice(words, int(rng.integers(1, 15))))) for i in range(12)]
    items += [(0, items[0][1]), (50, ""), (51, None), (52, "zebra zebra T1"), (None, "t2"), (53, "nowhere")]
    return docs, items


@pytest.mark.parametrize("seed,n,k", [(0, 30, 10), (1, 400, 10), (2, 400, 3)])
def test_search(spark, monkeypatch, seed, n, k):
    """Several rounds, buckets and blocks of items."""
    monkeypatch.setattr(lexical, "HEAD", 40)
    monkeypatch.setattr(lexical, "GROWTH", 3)
    docs, items = random_corpus(seed, n)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    q = spark.createDataFrame(items, "item_id long, text string")
    want = slow_search(docs, items, k)
    assert sorted(map(tuple, lexical.search(d, q, k).collect()), key=repr) == want
    if n > 100 and k == 10:
        assert sorted(map(tuple, lexical.search(d, q, k, block_terms=30).collect()), key=repr) == want


def test_bounds_lose_nothing_and_save_work(monkeypatch):
    """A bucket whose norm is too small is not scored; one with a likely document is."""
    items = lexical.Items(pa.table({"item": [5, 5, 9], "term": [b"a", b"b", b"c"], "times": [1, 2, 1]}))
    items.weigh(1000, np.array([3, 5, 900]))
    batch = pa.RecordBatch.from_pydict({
        "doc_id": pa.array([1, 2], pa.int64()), "n": pa.array([4, 4], pa.int64()),
        "terms": pa.array([[0, 1], [2]], pa.list_(pa.int32())), "tf": pa.array([[1, 1], [2]], pa.list_(pa.int32())),
        "norm": pa.array([1e7, 1e5])})
    best = lexical.Best(items, np.zeros(2), 10)
    best.bucket(batch, 1000, 4000)
    assert {q: x[2].tolist() for q, x in best.held.items()} == {0: [1], 1: [2]}
    asked = []
    monkeypatch.setattr(lexical, "_entries", lambda *a: asked.append(a))
    lexical.Best(items, np.full(2, 10 ** 9), 10).bucket(batch, 1000, 4000)
    assert not asked


def test_terms():
    assert lexical.terms_of("The CAT's 2nd—Éa ſ_x\u0000y") == [x.encode() for x in ("the", "cat", "s", "2nd—Éa", "ſ", "x", "y")]
    assert lexical.terms_of(None) == [] == lexical.terms_of("!! -- ")


@pytest.mark.parametrize("case", ["odd", "real"])
def test_tables(spark, odd, case):
    docs = odd if case == "odd" else spark.read.parquet(SMALL)
    items = docs.where("doc_id < 9").selectExpr("doc_id as item_id", "text", "5 as rank", "'x' as item") if case == "odd" else \
        spark.read.parquet(SMALL.replace("documents", "benchmark"))
    got = lexical.search(docs, items)
    want = slow_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 10)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and sorted(map(tuple, got.collect()), key=repr) == want


def test_no_rows(spark, odd, nothing):
    none = nothing.selectExpr("doc_id as item_id", "text")
    some = odd.selectExpr("doc_id as item_id", "text")
    assert [lexical.search(*x).count() for x in ((nothing, some), (odd, none), (nothing, none))] == [0, 0, 0]
