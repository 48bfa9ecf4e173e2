"""Rule counts, the isolation forest and its threshold against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.test_text_operators import BLANKS, SMALL
from tracewright.llm import rules
from tracewright.llm.queries import QUERIES

LABELS = SMALL.replace("documents", "labels")


def slow_counts(text):
    text = text or ""
    words = re.findall(BLANKS, text)
    lines = [x for x in text.split("\n") if re.search(BLANKS, x)]
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    again = {k for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for k in range(i, i + 8)}
    marks = [c for c in text if 33 <= ord(c) < 127 and not c.isalnum() and c not in "#*$%&|<>"]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again),
            sum("A" <= c <= "Z" for c in text), len(marks))


def slow_failed(c):
    return c[0] < 20 or 100 * c[4] > 30 * c[0]


@pytest.mark.parametrize("seed", range(5))
def test_repeated_words(seed):
    """Few and many different words, texts shorter than a window, repeats only across texts."""
    rng = random.Random(seed)
    texts = [[rng.randrange(rng.choice([1, 2, 5, 100])) for _ in range(rng.choice([0, 3, 7, 8, 9, 40, 150]))] for _ in range(30)]
    texts += [texts[-1], list(range(20)), list(range(20))]
    size = np.array([len(t) for t in texts])
    words = np.array([w for t in texts for w in t], np.int64)
    assert rules.repeated_words(words, size).tolist() == [slow_counts(" ".join(map(str, t)))[4] for t in texts]


@pytest.mark.parametrize("case", ["odd", "real"])
def test_statistics(spark, odd, case):
    docs = odd if case == "odd" else spark.read.parquet(SMALL)
    got = [tuple(r) for r in rules.statistics(docs, ["doc_id"]).collect()]
    assert sorted(got, key=repr) == sorted(((r.doc_id, *slow_counts(r.text)) for r in docs.collect()), key=repr)


def slow_path(tree, row):
    feature, cut, path = tree
    v = 0
    while feature[v] >= 0:
        v = 2 * v + (2 if row[feature[v]] > cut[v] else 1)
    return path[v]


def test_forest(spark):
    """Paths by walking each tree; far rows are told apart; no rows, one row and equal rows."""
    rng = np.random.default_rng(1)
    pool = rng.normal(size=(2000, rules.FEATURES))
    trees = rules.forest(spark, pool, 20)
    rows = np.concatenate([rng.normal(size=(50, rules.FEATURES)), rng.normal(size=(5, rules.FEATURES)) + 9])
    each = list(zip(trees.feature, trees.cut, trees.path))
    want = [2 ** (-np.mean([slow_path(t, r) for t in each]) / float(rules.search_length(256))) for r in rows]
    got = trees.scores(rows)
    assert np.allclose(got, want) and got[50:].min() > got[:50].max()
    again = rules.forest(spark, pool, 20)
    assert (again.cut == trees.cut).all()
    for few in (pool[:0], pool[:1], np.repeat(pool[:1], 9, axis=0)):
        assert len(np.unique(rules.forest(spark, few, 3).scores(rows))) == 1


def test_pool(spark):
    """The rows with the least hashes, by sorting all; rows that fail the base rules are not among them."""
    rows = spark.range(5000).selectExpr(
        "id as doc_id", "id % 60 as n_words", "id % 60 * 5 as word_chars", "id % 7 as n_symbols", "0L as n_dup_lines",
        "0L as n_repeat_words", "id % 11 as n_upper", "id % 13 as n_marks")
    keyed = rows.where("n_words >= 20").selectExpr(f"xxhash64({rules.SEED}, doc_id, {', '.join(rules.COUNTS)}) as key", *rules.COUNTS)
    for size in (10, 200, 3000, 9000):
        least = keyed.orderBy("key").limit(size).toPandas()
        want = rules.features({c: least[c].to_numpy() for c in rules.COUNTS})
        assert np.array_equal(rules.pool_of(rows, size), want) and len(want) == min(size, 3320)


def test_path_lengths_of_leaves():
    rows = np.random.default_rng(3).normal(size=(256, rules.FEATURES))
    feature, cut, path = rules.grow(rows, np.random.default_rng(4))
    inside = Counter()
    for row in rows:
        v, depth = 0, 0
        while feature[v] >= 0:
            v, depth = 2 * v + (2 if row[feature[v]] > cut[v] else 1), depth + 1
        inside[v, depth] += 1
    for (v, depth), n in inside.items():
        harmonic = np.log(n - 1) + 0.5772156649015329 if n > 1 else 0
        assert path[v] == pytest.approx(depth + (2 * harmonic - 2 * (n - 1) / n if n > 1 else 0)) and depth <= rules.DEPTH
    assert sum(inside.values()) == 256


def slow_threshold(good, bad, lost, prior):
    """Tries every bin edge."""
    best = (-2, 0)
    for b in range(rules.BINS + 1):
        g, x = sum(v > b for v in good) / len(good), sum(v > b for v in bad) / max(1, len(bad))
        if g <= lost and x - g > best[0]:
            best = (x - g, b)
    return (len(good) * (best[1] + 0.5) / rules.BINS + prior / lost) / (len(good) + 1 / lost)


@pytest.mark.parametrize("n_good,n_bad", [(400, 60), (3, 1), (50, 0)])
def test_threshold(n_good, n_bad, monkeypatch):
    monkeypatch.setattr(rules, "BINS", 64)
    rng = np.random.default_rng(n_good)
    good, bad = rng.integers(10, 40, n_good), rng.integers(25, 60, n_bad)
    counts = [np.bincount(x, minlength=65) for x in (good, bad)]
    assert rules.threshold_of(*counts, 0.05, 0.7) == pytest.approx(slow_threshold(good.tolist(), bad.tolist(), 0.05, 0.7))
    assert rules.threshold_of(counts[0] * 0, counts[1]) == rules.PRIOR


@pytest.mark.parametrize("case", ["odd", "real"])
def test_query(spark, odd, case, tmp_path):
    docs = odd if case == "odd" else spark.read.parquet(SMALL)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (9, 1, None), (None, 0, 0), (11, None, 1), (77, 0, 0)], "doc_id long, quality int, toxic int") \
        if case == "odd" else spark.read.parquet(LABELS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows = QUERIES["op12_quality_rules"](spark, str(tmp_path)).collect()
    assert len(rows) == docs.count() and len({r.threshold for r in rows}) == 1
    want = sorted(((r.doc_id, *slow_counts(r.text)[:5], slow_failed(slow_counts(r.text))) for r in docs.collect()), key=repr)
    assert sorted((tuple(r)[:7] for r in rows), key=repr) == want
    assert all(r.kept == (not r.base_failed and r.anomaly <= r.threshold) for r in rows)


def test_verdict_on_labelled_rows(spark):
    """Good rows stay, rows of quality 0 go: base rules and forest together, at the next larger scale."""
    docs, labels = (spark.read.parquet(p.replace("sf0.001", "sf0.01")) for p in (SMALL, LABELS))
    kept = {r.doc_id: r.kept for r in rules.classify(docs, labels).collect()}
    by = {r.doc_id: r for r in labels.collect()}
    good = [kept[i] for i, r in by.items() if r.quality == 1 and not r.toxic]
    bad = [kept[i] for i, r in by.items() if r.quality == 0]
    assert np.mean(good) > 0.93 and np.mean(bad) < 0.45


def test_no_rows(spark, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = rules.classify(nothing, none)
    assert out.count() == 0 and "kept" in out.columns
