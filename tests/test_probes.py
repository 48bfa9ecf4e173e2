from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewright.functions.arrow import vectors
from tracewright.operators import bow, pairout, pca, probes, splits
from tests.test_ranking import brute_auc


def fit(x, y, c):
    """Plain Newton for |w|^2 / 2 + c * logloss, free intercept."""
    a, w = np.c_[x, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    ridge = np.r_[np.ones(x.shape[1]), 0]
    for _ in range(60):
        mu = 1 / (1 + np.exp(-a @ w))
        w = w - np.linalg.solve(c * (a * (mu * (1 - mu))[:, None]).T @ a + np.diag(ridge), c * a.T @ (mu - y) + ridge * w)
    return w


def scaled(train, x):
    std = train.std(axis=0)
    return (x - train.mean(axis=0)) / np.where(std > 1e-12, std, 1)


def brute_pair_out(x, y, c=0.01):
    wins = 0.0
    for i in np.flatnonzero(y == 1):
        for j in np.flatnonzero(y == 0):
            keep = np.ones(len(x), bool)
            keep[[i, j]] = False
            w = fit(scaled(x[keep], x[keep]), y[keep], c)
            si, sj = scaled(x[keep], x[[i, j]]) @ w[:-1]
            wins += 1.0 if si - sj > 1e-12 else 0.5 if abs(si - sj) <= 1e-12 else 0.0
    return wins / (y.sum() * (1 - y).sum())


@pytest.mark.parametrize("n,d", [(14, 3), (11, 30), (9, 9)])
def test_pair_out(spark, n, d):
    rng = np.random.default_rng(n)
    y = np.r_[np.ones(n // 2, int), np.zeros(n - n // 2, int)]
    x = rng.normal(size=(n, d))
    x[:, 0] += y
    x[:, 1] = 1.0  # constant feature
    x[0] = x[-1]   # a tie across the classes
    rows = [(k, i, int(v), x[i].tolist()) for k in ("a", "b") for i, v in enumerate(y)] + [("one", 0, 1, [0.0]), ("one", 1, 1, [0.0])]
    df = spark.createDataFrame(rows, "cell string, id int, label int, vec array<double>")
    got = {r["cell"]: r["auc"] for r in pairout.pair_out_auc(df, ["cell"], ["id"], pairs_per_task=7).collect()}
    assert got["a"] == pytest.approx(brute_pair_out(x, y), abs=1e-9) and got["a"] == got["b"] and got["one"] is None


def refit_gaps(x, y, pairs, c):
    """Decision value of the positive minus the negative of every pair, refitted from scratch."""
    out = []
    for i, j in pairs:
        keep = np.ones(len(x), bool)
        keep[[i, j]] = False
        w = fit(scaled(x[keep], x[keep]), y[keep], c)
        si, sj = scaled(x[keep], x[[i, j]]) @ w[:-1]
        out.append(si - sj)
    return np.array(out)


@pytest.mark.parametrize("n,d,c,steps", [(16, 40, 0.01, 60), (24, 90, 0.1, 60), (20, 33, 1.0, 60), (18, 50, 0.1, 2)])
def test_pair_out_gaps(n, d, c, steps, monkeypatch):
    """Every decision value, dense and sparse, by mixed steps and (where they are cut short) by Newton's method."""
    monkeypatch.setattr(pairout, "STEPS", steps)
    monkeypatch.setattr(pairout, "BATCH_BYTES", 60_000)  # several batches of pairs
    rng = np.random.default_rng(d)
    x = rng.normal(size=(n, d)) * rng.uniform(0.1, 5, d) + rng.normal(size=d)
    x[rng.random((n, d)) < 0.4] = 0.0
    x[:, 0], x[3:, 1] = 1.5, 0.0  # constant, and constant but for rows that may go
    y = np.r_[np.ones(n // 2), np.zeros(n - n // 2)]
    pairs = np.array([(i, j) for i in np.flatnonzero(y == 1) for j in np.flatnonzero(y == 0)])
    want = refit_gaps(x, y, pairs, c)
    row, column = np.nonzero(x)
    sparse = pairout.SparseRows(row, 1_000_000_007 * column, x[row, column], n)
    for rows in (pairout.DenseRows(x), sparse):
        np.testing.assert_allclose(pairout._dual_gaps(rows, y, pairs, c), want, atol=1e-8)


def test_pair_out_of_sparse_rows(spark):
    """Sparse and dense rows win the same pairs; rows without an entry, and a token of one row only."""
    rng = np.random.default_rng(2)
    x = rng.poisson(0.3, (13, 60)).astype(float)
    x[4] = 0.0
    y = np.array([1, 0] * 6 + [1])
    dense = spark.createDataFrame([("c", i, int(y[i]), v.tolist()) for i, v in enumerate(x)], "cell string, id int, label int, vec array<double>")
    rows = [("c", i, int(y[i]), (np.flatnonzero(v).tolist(), v[v > 0].tolist())) for i, v in enumerate(x)]
    sparse = spark.createDataFrame(rows, "cell string, id int, label int, vec struct<idx:array<long>,val:array<double>>")
    got = [pairout.pair_out_auc(df, ["cell"], ["id"], pairs_per_task=11).first()["auc"] for df in (dense, sparse)]
    assert got[0] == got[1] == pytest.approx(brute_pair_out(x, y), abs=1e-9)


@pytest.mark.parametrize("n,d,c,few", [(40, 3, 0.01, 20), (60, 5, 1.0, 9), (50, 4, 20.0, 25), (45, 2, 0.01, 2), (50, 30, 0.1, 20)])
def test_screened_pairs(n, d, c, few):
    """Every gap lies within its bound, and the signs are those of refits; copies across the classes tie."""
    rng = np.random.default_rng(n + d)
    x = rng.normal(size=(n, d)) * rng.uniform(0.1, 5, d) + rng.normal(size=d)
    y = np.r_[np.ones(few), np.zeros(n - few)]
    x[0], x[1, 0] = x[-1], 80.0  # a copy, and a row that makes most of a spread
    pairs = np.array([(i, j) for i in np.flatnonzero(y == 1) for j in np.flatnonzero(y == 0)])
    want = refit_gaps(x, y, pairs, c)
    fits = pairout.Screened(x, y, c)
    for i in np.flatnonzero(y == 1):
        gap, error = fits.gaps(i, np.flatnonzero(y == 0))
        assert (np.abs(gap - want[pairs[:, 0] == i]) <= error + 1e-8).all()
    got = pairout._screened_gaps(pairout.DenseRows(x), y, pairs, c)
    clear = np.abs(want) > 1e-9
    assert clear.sum() == len(pairs) - 1 and (np.sign(got) == np.sign(want))[clear].all() and got[~clear] == 0
    row, column = np.nonzero(x)
    sparse = pairout.SparseRows(row, 7 * column, x[row, column], n)
    np.testing.assert_allclose(pairout._free_gaps(sparse, y, pairs[::9], c), want[::9], atol=1e-7)


def test_pair_out_of_large_cells(spark):
    """More rows than a matrix of rows by rows is made for; with one number a row the pairs' order is known."""
    n, few = pairout.MAX_ROWS + 200, 3
    x = np.random.default_rng(1).permutation(n).astype(float)
    x[:few] = [n - 1.5, n - 2.5, n / 2]
    rows = spark.createDataFrame([(i, int(i < few), [float(v)]) for i, v in enumerate(x)], "id int, label int, vec array<double>")
    got = pairout.pair_out_auc(rows.selectExpr("'c' as cell", "*"), ["cell"], ["id"]).first()
    wins = 0.0
    for i in range(few):
        kept = np.delete(x[:few], i).sum()
        way = np.sign(kept - (x.sum() - x[i] - x[few:]) * (few - 1) / (n - 2))
        wins += (way * (x[i] - x[few:]) > 0).sum() + 0.5 * (x[i] == x[few:]).sum()
    assert got["n_pos"] == few and got["auc"] == pytest.approx(wins / (few * (n - few)), abs=1e-12)


def test_pair_out_refuses_huge_cells(spark, monkeypatch):
    df = spark.createDataFrame([("a", i, i % 2, [0.0] * 3) for i in range(6)], "cell string, id int, label int, vec array<double>")
    with pytest.raises(Exception, match="use the k-fold sweep"):
        pairout.pair_out_auc(df, ["cell"], ["id"], max_rows=3).collect()


@pytest.mark.parametrize("components", [2, 50])
def test_cv_sweep(spark, components, monkeypatch):
    monkeypatch.setattr(probes, "BASIS_BYTES", 400)  # several chunks of layers
    rng = np.random.default_rng(5)
    n, d = 60, 6
    y = rng.integers(0, 2, n)
    x = rng.normal(size=(3, n, d)) * np.array([1, 5, 1, 1, 0.1, 3]) + 20
    x[1, :, 1] += 5 * y
    x[2, :, 2] = 7.0
    states = spark.createDataFrame([(i, k, x[k, i].tolist()) for k in range(3) for i in range(n)],
                                   "id int, layer int, vec array<double>")
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "id int, label int")
    folds = {r["id"]: r["fold"] for r in splits.stratified_folds(labels, ["id"]).collect()}
    fold = np.array([folds[i] for i in range(n)])
    got = {r["layer"]: r["auc"] for r in probes.cv_sweep(states, labels, ["id"], components=components).collect()}
    for k in range(3):
        aucs = []
        for f in range(5):
            tr, va = x[k][fold != f], x[k][fold == f]
            z, zv = scaled(tr, tr), scaled(tr, va)
            _, _, vt = np.linalg.svd(z, full_matrices=False)
            basis = vt[:min(components, d, len(tr) - 1)].T
            w = fit(z @ basis, y[fold != f], 1.0)
            aucs.append(brute_auc(zv @ basis @ w[:-1], y[fold == f]))
        assert got[k] == pytest.approx(np.mean(aucs), abs=1e-9)
    best = probes.best_cell(spark.createDataFrame([(0, 0.7), (1, None), (2, 0.9), (3, 0.9)], "layer int, auc double")).first()
    assert tuple(best) == (2, 0.9)


def test_projected_rows_are_packed():
    """What every Newton step reads is one row for a batch's rows of a cell, not one for each row and fold."""
    rng = np.random.default_rng(3)
    x, fold, label = rng.normal(size=(90, 2)), np.arange(90, dtype=np.int32) % 3, (np.arange(90) % 2).astype(np.int32)
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(90, np.int32)), pa.array(fold), pa.array(label), vectors(x)],
                                       ["layer", "fold", "label", "vec"])
    bases = {(0, f): rng.normal(size=(2, 3)) for f in range(3)}
    made = list(probes._project(SimpleNamespace(value=bases))(iter([batch])))
    assert sum(b.num_rows for b in made) == 6
    for b in made:
        (key, y, z), = probes._pieces(b)
        at = (fold == key[1]) == b.column("held_out")[0].as_py()
        assert (y == label[at]).all()
        np.testing.assert_allclose(z, np.hstack([np.ones((90, 1)), x])[at] @ bases[key].T)


def test_cv_sweep_classes(spark):
    states = spark.createDataFrame([(i, 0, [float(i)]) for i in range(6)], "id int, layer int, vec array<double>")
    one = spark.createDataFrame([(i, 1) for i in range(6)], "id int, label int")
    assert probes.cv_sweep(states, one, ["id"]).first()["auc"] is None
    lone = spark.createDataFrame([(i, int(i == 0)) for i in range(6)], "id int, label int")
    with pytest.raises(ValueError, match="two rows"):
        probes.cv_sweep(states, lone, ["id"])
    strangers = spark.createDataFrame([(i + 100, i % 2) for i in range(6)], "id int, label int")
    with pytest.raises(ValueError, match="no keys in common"):
        probes.cv_sweep(states, strangers, ["id"])


def test_probe(spark):
    rng = np.random.default_rng(8)
    rows, x, y = [], {}, {}
    for q in range(60):
        for s in range(3):
            v = rng.normal(size=4)
            x[q, s], y[q, s] = v, int(v[0] + rng.normal() > 0)
            rows.append((q, s, y[q, s], v.tolist()))
    df = spark.createDataFrame(rows, "qid int, sample_idx int, label int, features array<double>")
    keys = ["qid", "sample_idx"]
    pred = probes.probe_predictions(df, keys).collect()
    test = {(r["qid"], r["sample_idx"]): r["y_pred_prob"] for r in pred}
    assert len(test) == 36 and len({q for q, _ in test}) == 12
    train = [k for k in x if k not in test]
    w = fit(np.array([x[k] for k in train]), np.array([y[k] for k in train]), 1.0)
    for k, p in test.items():
        assert p == pytest.approx(1 / (1 + np.exp(-(x[k] @ w[:-1] + w[-1]))), abs=1e-4)
    summary = probes.probe_summary(probes.probe_predictions(df, keys)).first()
    score = np.array(list(test.values()))
    assert summary["auc"] == pytest.approx(brute_auc(score, np.array([y[k] for k in test])))


def test_pca(spark, tmp_path):
    x = np.random.default_rng(4).normal(size=(30, 5)) * [3, 1, 2, 0.5, 1] + 4
    states = spark.createDataFrame([(7, v.tolist()) for v in x] + [(6, [0.0] * 5)], "layer int, vec array<double>")
    basis = pca.fit_basis(states, 7, 3, "decode")
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert basis["n_fit_samples"] == 30
    np.testing.assert_allclose(basis["mean"], x.mean(0))
    np.testing.assert_allclose(basis["explained_variance_ratio"], (s ** 2 / (s ** 2).sum())[:3], atol=1e-9)
    np.testing.assert_allclose(np.abs(basis["components"]), np.abs(vt[:3]), atol=1e-8)
    path = str(tmp_path / "basis")
    pca.basis_frame(spark, basis).write.json(path)
    assert pca.read_basis(spark, path, 7, "decode")["components"] == basis["components"]
    for bad in ({"layer": 6}, {"source": "prefill"}):
        with pytest.warns(UserWarning, match="basis is for"):
            pca.read_basis(spark, path, **bad)
    from tracewright.functions.vectors import project
    got = states.where("layer = 7").select(project(F.col("vec"), basis["mean"], basis["components"]).alias("p")).collect()
    np.testing.assert_allclose([r["p"] for r in got], (x - x.mean(0)) @ np.array(basis["components"]).T, atol=1e-9)


@pytest.mark.parametrize("width,rank,k", [(60, 60, 4), (60, 6, 5), (300, 300, 3), (14, 14, 14)])
def test_leading_directions(width, rank, k):
    """Close values, values of zero, spaces that start again."""
    rng = np.random.default_rng(width + rank)
    q = np.linalg.qr(rng.normal(size=(width, width)))[0]
    values = np.concatenate([np.sort(1 + rng.random(rank))[::-1] ** 3, np.zeros(width - rank)])
    m = q @ np.diag(values) @ q.T
    got, columns = pca.leading_directions(lambda x: m @ x, width, k)
    np.testing.assert_allclose(got, values[:k], rtol=1e-9, atol=1e-9)
    np.testing.assert_allclose(np.abs((columns * q[:, :k]).sum(axis=0)), 1.0, atol=1e-6)


def test_pca_of_wide_vectors(spark):
    """Wider than a pass's block and than a chunk, fewer rows than elements; one spread over tasks."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 5000)) + rng.normal(size=(40, 3)) @ rng.normal(size=(3, 5000)) * 3 + 7
    states = spark.createDataFrame([(1, v.tolist()) for v in x], "layer int, vec array<double>").repartition(4)
    basis = pca.fit_basis(states, 1, 4)
    _, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    np.testing.assert_allclose(basis["explained_variance_ratio"], (s ** 2 / (s ** 2).sum())[:4], rtol=1e-9)
    np.testing.assert_allclose(np.abs((np.array(basis["components"]) * vt[:4]).sum(axis=1)), 1.0, atol=1e-6)


def test_bag_of_words(spark):
    docs = {"a": [1, 1, 2, 9], "b": [1, 3], "c": [1, 2, 2], "d": [8]}
    df = spark.createDataFrame([(q, t) for q, t in docs.items()], "qid string, tokens array<int>")
    counts = bow.token_counts(bow.explode_tokens(df))
    vocab = bow.vocabulary(counts, 2)
    assert [(r["token"], r["df"], r["idx"]) for r in vocab.orderBy("idx").collect()] == [(1, 3, 0), (2, 2, 1)]
    rows = {r["qid"]: r["vec"] for r in bow.sparse_rows(df.select("qid"), bow.log_counts(counts, vocab)).collect()}
    for q, tokens in docs.items():
        v = np.log1p([tokens.count(1), tokens.count(2)])
        got = dict(zip(rows[q]["idx"], rows[q]["val"]))
        assert got == pytest.approx({k: x / np.linalg.norm(v) for k, x in enumerate(v) if x}, abs=1e-12)


def test_cohorts(spark):
    schema = "layer int, auc double"
    first = spark.createDataFrame([(0, 0.7), (1, 0.9), (2, None)], schema)
    second = spark.createDataFrame([(0, 0.66), (1, 0.5), (2, 0.8)], schema)
    out = {r["layer"]: r["confirmed"] for r in pairout.compare_cohorts(first, second, ["layer"]).collect()}
    assert out == {0: True, 1: False, 2: False}
