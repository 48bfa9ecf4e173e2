import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.operators import bootstrap, ranking as R, splits


def brute_auc(score, y):
    pos, neg = score[y == 1], score[y == 0]
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


@pytest.mark.parametrize("levels", [3, 40, 100_000])
def test_auc_with_ties_and_a_hot_cell(spark, levels):
    rng = np.random.default_rng(levels)
    n = 4000
    cell = np.where(rng.random(n) < 0.6, 0, rng.integers(1, 5, n))
    score, y = rng.integers(0, levels, n) / 7.0, rng.integers(0, 2, n)
    df = spark.createDataFrame([(int(c), float(s), int(v)) for c, s, v in zip(cell, score, y)], "c int, s double, y int")
    got = {r["c"]: r for r in R.auc(df, ["c"], "s", "y", fan=3).collect()}
    for c in range(5):
        assert got[c]["auc"] == pytest.approx(brute_auc(score[cell == c], y[cell == c]), abs=1e-12)
    assert R.auc(df, [], "s", "y").first()["auc"] == pytest.approx(brute_auc(score, y), abs=1e-12)
    mirrored = df.withColumn("s", -F.col("s"))
    assert R.auc(mirrored, [], "s", "y").first()["auc"] == pytest.approx(1 - brute_auc(score, y), abs=1e-12)
    ties = R.pair_wins(df, [], "s", "y").first()["tie_term"]
    t = np.unique(score, return_counts=True)[1].astype(float)
    assert ties == pytest.approx((t ** 3 - t).sum())


def test_auc_edge_cases(spark):
    df = spark.createDataFrame([(0, 1.0, 1), (0, 2.0, 1), (1, float("nan"), 1), (1, 1.0, 0), (1, None, 1), (1, 2.0, 1)],
                               "c int, s double, y int")
    got = {r["c"]: (r["n_pos"], r["n_neg"], r["auc"]) for r in R.auc(df, ["c"], "s", "y").collect()}
    assert got == {0: (2, 0, None), 1: (1, 1, 1.0)}


def test_hash_row_number_is_dense(spark):
    df = spark.range(5000).select("id", (F.col("id") % 3 == 0).cast("int").alias("g"))
    rows = R.hash_row_number(df, ["id"], 5, within=["g"]).collect()
    for g, size in ((0, 3333), (1, 1667)):
        part = [r for r in rows if r["g"] == g]
        assert sorted(r["row_no"] for r in part) == list(range(size))
        assert {r["row_total"] for r in part} == {size}
    ordered = R.hash_row_number(df, ["id"], 5, order=["g"]).collect()
    assert max(r["row_no"] for r in ordered if r["g"] == 0) + 1 == min(r["row_no"] for r in ordered if r["g"] == 1)
    again = {r["id"]: r["row_no"] for r in R.hash_row_number(df.repartition(3), ["id"], 5, within=["g"]).collect()}
    assert again == {r["id"]: r["row_no"] for r in rows}


def test_ordered_index(spark):
    words = [f"w{i:04d}" for i in range(500)]
    df = spark.createDataFrame([(w,) for w in reversed(words)], "token string").repartition(5)
    assert [r["token"] for r in R.ordered_index(df, ["token"], parts=7).orderBy("idx").collect()] == words


def test_group_split(spark):
    df = spark.createDataFrame([(q, i) for q in range(23) for i in range(1 + 40 * (q == 3))], "qid int, i int")
    sides = splits.group_split(df, "qid", 0.2, 42).groupBy("qid").agg(
        F.count_distinct("is_test").alias("k"), F.max("is_test").alias("t")).collect()
    assert all(r["k"] == 1 for r in sides) and sum(r["t"] for r in sides) == 5
    one = df.where("qid = 3")
    assert splits.group_split(one, "qid", 0.2, 42, ["i"]).where("is_test").count() == 9
    with pytest.raises(ValueError):
        splits.group_split(one)


def test_folds(spark):
    df = spark.createDataFrame([(i, int(i < 4)) for i in range(40)], "id int, label int")
    counts = {(r["label"], r["fold"]): r["count"] for r in
              splits.stratified_folds(df, ["id"]).groupBy("label", "fold").count().collect()}
    assert counts == {(1, f): 1 for f in range(4)} | {(0, f): 9 for f in range(4)}


def plain_draw(rep, i, n, seed):
    m = (1 << 32) - 1

    def mix(x):
        x = ((x ^ x >> 16) * 0x21F0AAAD) & m
        x = ((x ^ x >> 15) * 0x735A2D97) & m
        return x ^ x >> 15
    first = mix((rep + seed * 1_000_003) & m)
    second = mix((first + rep + 1) & m)
    low = mix(mix((i + first) & m) ^ ((second + (i >> 32)) & m))
    return (((mix((low + 0x9E3779B9) & m) & (1 << 30) - 1) << 32) | low) % n


def test_draws(spark):
    """Tasks, SQL functions and plain numbers draw the same rows; all rows come up about equally often."""
    for n, reps, seed in ((7, 5, 0), (1000, 30, 7), (3, 400, 123_456)):
        want = [(r, plain_draw(r, i, n, seed)) for r in range(reps) for i in range(n)]
        at = np.repeat(np.arange(reps), n), np.tile(np.arange(n), reps)
        assert bootstrap.draw_rows(*at, n, seed).tolist() == [w for _, w in want]
        assert sorted(tuple(r) for r in bootstrap.draws(spark, n, reps, seed).collect()) == sorted(want)
    far = np.array([0, 1, 2, 3]) + (5 << 32)
    assert bootstrap.draw_rows(np.zeros(4, int), far, 10 ** 6, 1).tolist() == [plain_draw(0, int(i), 10 ** 6, 1) for i in far]
    rep, i = np.repeat(np.arange(2000), 50), np.tile(np.arange(50), 2000)
    counts = np.bincount(bootstrap.draw_rows(rep, i, 50, 3), minlength=50)
    assert ((counts - 2000) ** 2 / 2000).sum() < 90  # chi square, 49 degrees of freedom


def test_bootstrap_matches_plain_resampling(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 40)
    score = np.round(rng.normal(size=40) + y, 1)
    df = spark.createDataFrame([(i, float(s), int(v)) for i, (s, v) in enumerate(zip(score, y))], "id int, s double, y int")
    aucs = bootstrap.replicate_aucs(df, ["id"], "s", "y", 400, seed=1).collect()
    assert len(aucs) == 400
    order = {r["row_no"]: r["id"] for r in R.hash_row_number(df, ["id"], 1).collect()}
    drawn = {}
    for r in bootstrap.draws(spark, 40, 400, 1).collect():
        drawn.setdefault(r["rep"], []).append(order[r["row_no"]])
    for r in aucs:
        at = np.array(drawn[r["rep"]])
        assert len(at) == 40 and r["auc"] == pytest.approx(brute_auc(score[at], y[at]))
    ci = bootstrap.auc_interval(df, ["id"], "s", "y", 400, seed=1).first()
    assert (ci["ci_low"], ci["ci_high"]) == pytest.approx(np.percentile([r["auc"] for r in aucs], [2.5, 97.5]))
    assert ci["ci_low"] < brute_auc(score, y) < ci["ci_high"]


def test_bootstrap_one_class(spark):
    df = spark.createDataFrame([(i, float(i), 1) for i in range(5)], "id int, s double, y int")
    row = bootstrap.auc_interval(df, ["id"], "s", "y", 20).first()
    assert row["n_replicates"] == 0 and row["ci_low"] is None


def test_bootstrap_ways_agree(spark, monkeypatch):
    df = spark.createDataFrame([(i, float(i % 7), i % 3 % 2) for i in range(31)], "id int, s double, y int")
    here = {r["rep"]: r["auc"] for r in bootstrap.replicate_aucs(df, ["id"], "s", "y", 60, seed=4).collect()}
    monkeypatch.setattr(bootstrap, "BROADCAST_ROWS", 0)
    assert {r["rep"]: r["auc"] for r in bootstrap.replicate_aucs(df, ["id"], "s", "y", 60, seed=4).collect()} == pytest.approx(here)


def test_exact_medians(spark):
    rng = np.random.default_rng(9)
    rows = [("big", float(v)) for v in np.round(rng.normal(size=30_001), 3)] + [("even", float(v)) for v in rng.normal(size=2000)]
    rows += [("ties", 1.0)] * 50 + [("ties", 2.0)] * 50 + [("one", 5.0), ("none", None), ("two", 1.0), ("two", 4.0)]
    df = spark.createDataFrame(rows, "cell string, v double")
    got = {r["cell"]: r["median"] for r in R.exact_medians(df, ["cell"], "v").collect()}
    by = {}
    for c, v in rows:
        if v is not None:
            by.setdefault(c, []).append(v)
    assert got == {c: pytest.approx(float(np.median(v))) for c, v in by.items()}
