"""Periodic runs against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_text_operators import SMALL
from tracewright.llm import runs
from tracewright.llm.queries import QUERIES


def slow_runs(words, least=runs.LEAST):
    """Every maximal stretch of every period, the smallest period of each, by start and period."""
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    at, best = np.array([number[w] for w in words]), {}
    for q in range(len(words) // 2, 0, -1):
        edges = np.diff(np.concatenate([[0], (at[:-q] == at[q:]).astype(int), [0]]))
        for i, j in zip(np.flatnonzero(edges > 0).tolist(), np.flatnonzero(edges < 0).tolist()):
            if j + q - i >= max(least, 2 * q):
                best[i, j + q - i] = q
    return sorted((s, q, n) for (s, n), q in best.items())


def slow_collapse(words, found):
    gone = {k for s, q, n in found for k in range(s + q, s + n)}
    return b" ".join(w for k, w in enumerate(words) if k not in gone)


def slow_planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def slow_row(doc_id, text):
    words = slow_planted(doc_id, (text or "").encode("utf-8", "surrogatepass").split())
    found = slow_runs(words)
    s, q, n = min(found, key=lambda r: (-r[2], r[0], r[1]), default=(None, None, None))
    lines = "".join(f"{s},{n},{q}\n" for s, q, n in found)
    return (doc_id, len(found), s, n, q, 1000 * n // q if found else None, hashlib.sha256(lines.encode()).hexdigest(),
            hashlib.sha256(slow_collapse(words, found)).hexdigest())


def random_texts(seed, count):
    rng = random.Random(seed)
    out = []
    for _ in range(count):
        n, k = rng.choice([0, 1, 11, 12, 13, 60, 200]), rng.choice([1, 2, 3, 40])
        words = [f"w{rng.randrange(k)}" for _ in range(n)]
        if n and rng.random() < 0.6:
            a = rng.randrange(n)
            p = 1 + (n - a) // rng.randint(2, 10)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        out.append(rng.choice([" ", "\n", " \t"]).join(words))
    return out


def test_cover_meets_every_pair():
    assert (runs.SYNC >= 0).all() and runs.SYNC.shape == (runs.MODULUS, runs.MODULUS)


@pytest.mark.parametrize("kinds,seed", [(1, 0), (2, 1), (3, 2), (60, 3)])
def test_extensions(kinds, seed):
    """Every pair of places of a text, plain and with a long repeat inside."""
    rng = np.random.default_rng(seed)
    words = rng.integers(0, kinds, 150)
    words = np.append(np.concatenate([words[:60], words[:90], words[10:80]]), kinds + 7).astype(np.int32)
    n = len(words)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(n), indexing="ij"))
    i, j = i[i != j], j[i != j]

    def slow(a, b):
        k = 0
        while max(a, b) + k < n and words[a + k] == words[b + k]:
            k += 1
        return k
    assert runs.Extensions(words).of(i, j).tolist() == [slow(a, b) for a, b in zip(i.tolist(), j.tolist())]


@pytest.mark.parametrize("seed", range(4))
def test_blocks_against_brute_force(seed):
    texts = [t.encode() for t in random_texts(seed, 40)]
    split, of, found, stays = runs.block_runs(texts)
    got = [[] for _ in texts]
    for k, (s, n, q) in zip(of.tolist(), found.tolist()):
        got[k].append((s, q, n))
    assert got == [slow_runs(t.split()) for t in texts]
    assert len(stays) == sum(map(len, split))


def test_pieces_of_the_grid(monkeypatch):
    texts = [t.encode() for t in random_texts(9, 30)]
    whole = runs.block_runs(texts)[2].tolist()
    monkeypatch.setattr(runs, "PAIRS", 50)
    assert runs.block_runs(texts)[2].tolist() == whole


def test_long_periodic_texts():
    for text, period in ((b"x " * 30_000, 1), (b"a b c d e " * 40_000, 5)):
        n = len(text.split())
        assert runs.block_runs([text])[2].tolist() == [[0, n, period]]


def test_collapse(spark):
    text = "so it goes " * 5 + "and then\nit ends"
    df = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (None, None, "y")], "runs int, text string, words string")
    rows = runs.collapse(df).orderBy(F.col("words").desc()).collect()
    assert [c for c in rows[0].asDict()] == ["text", "words", "runs", "collapsed"]
    assert [(r.words, [tuple(x) for x in r.runs], r.collapsed) for r in rows] == 2 * [
        (19, [(0, 15, 3)], "so it goes and then it ends")] + [(0, [], "")]


@pytest.mark.parametrize("case", ["odd", "real"])
def test_query_steps(spark, odd, case, tmp_path):
    docs = odd if case == "odd" else spark.read.parquet(SMALL)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    order = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = QUERIES["op13_periodic_runs"](spark, str(tmp_path))
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint"] * 6 + ["string"] * 2 and got.columns == order
    want = [slow_row(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_no_rows(spark, nothing):
    assert runs.collapse(nothing).count() == 0 and runs.with_planted_runs(nothing).count() == 0
