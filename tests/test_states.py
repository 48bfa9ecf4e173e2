import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright import schemas
from tracewright.operators import features as FE, states as S, trajectory as T


def test_explode_decode_resolves_layers(spark):
    rows = [("q", 0, "m", 9, 8, 0, "", 50, False, [[[1.0], [2.0]], [[3.0], [4.0]]], [0, 10], [-1, 2], 10, 2, [5])]
    out = S.explode_decode(spark.createDataFrame(rows, schemas.TRACE_DECODE)).orderBy("pos", "layer").collect()
    assert [(r["layer"], r["pos"], r["step_index"], r["vec"]) for r in out] == [
        (2, 0, 0, [2.0]), (7, 0, 0, [1.0]), (2, 1, 10, [4.0]), (7, 1, 10, [3.0])]


def test_explode_positions_and_pick(spark):
    rows = [("q", 0, "m", 9, 1, 0, "", 5, False, False, [0, 3, 90], [0, 3], [[[1.0]], [[2.0]]])]
    states = S.explode_positions(spark.createDataFrame(rows, schemas.TRACE_POSITIONS))
    pick = lambda *a: [r["step_index"] for r in S.pick_position(states, *a).orderBy("pos").collect()]
    assert pick("all") == [0, 3] and pick("first") == [0] and pick("last") == [3] and pick("list", [3, 4]) == [3]


def test_captured_index(spark):
    df = spark.createDataFrame([([0, -2, 7],)], "captured array<int>")
    at = lambda want: df.select(S.captured_index(F.col("captured"), F.lit(8), want)).first()[0]
    assert (at(0), at(6), at(-2), at(-1)) == (0, 1, 1, 2)
    with pytest.raises(Exception, match="layer 3 was not captured"):
        at(3)


def test_json_vectors(spark):
    df = spark.createDataFrame([("[[1,2],[3,4]]",), ("[[1,",), ("[]",), (None,), ('[["a"]]',)], "raw string")
    assert [r["parse_ok"] for r in S.decode_vectors(df, "raw").collect()] == [True, False, False, False, False]


def make_states(spark, lengths, seed=0, d=3, new_tokens=None):
    rng = np.random.default_rng(seed)
    rows, data = [], {}
    for q, n in enumerate(lengths):
        x = rng.normal(size=(n, d)).cumsum(axis=0)
        data[q] = x
        rows += [(q, 0, 0, i, 4 * i, n, new_tokens or 4 * n, x[i].tolist()) for i in range(n)]
    schema = "qid int, sample_idx int, layer int, pos int, step_index int, n_steps int, n_new_tokens int, vec array<double>"
    return spark.createDataFrame(rows, schema), data


@pytest.mark.parametrize("points", [1, 2, 11, 20])
def test_nearest_positions(spark, points):
    states, data = make_states(spark, [1, 2, 7, 30])
    got = {(r["qid"], r["grid_pos"]): r["pos"] for r in S.nearest_positions(states, points).collect()}
    want = {(q, p): int(i) for q, x in data.items()
            for p, i in enumerate(np.rint(np.linspace(0, 1, points) * (len(x) - 1)).astype(int))}
    assert got == want


@pytest.mark.parametrize("axis", ["sample", "step"])
def test_resample_matches_interpolation(spark, axis):
    states, data = make_states(spark, [1, 2, 5, 40], new_tokens=130)
    got = {}
    for r in T.resample(T.norm_series(states), 20, axis).orderBy("qid", "point").collect():
        got.setdefault(r["qid"], []).append(r["value"])
    for q, x in data.items():
        v = np.linalg.norm(x, axis=1)
        at = np.linspace(0, 1, len(v)) if axis == "sample" else 4 * np.arange(len(v)) / 129
        want = np.full(20, v[0]) if len(v) == 1 else np.interp(np.linspace(0, 1, 20), at, v)
        np.testing.assert_allclose(got[q], want, atol=1e-12)


def test_stride_and_prefix(spark):
    states, _ = make_states(spark, [10, 3])
    assert [r["pos"] for r in S.stride_samples(states, 3, 2).where("qid = 0").orderBy("pos").collect()] == [0, 3]
    assert S.stride_samples(states, 3, 0).count() == 5
    assert {r["qid"]: r["count"] for r in S.prefix(states, 0.25).groupBy("qid").count().collect()} == {0: 2, 1: 1}


@pytest.mark.parametrize("n_layers", [1, 3, 9])
def test_early_features(spark, n_layers):
    x = np.random.default_rng(1).normal(size=(n_layers, 4)).astype(np.float32)
    df = spark.createDataFrame([("q", 0, x.tolist())], "qid string, sample_idx int, hidden_all_layers array<array<float>>")
    got = FE.early_trace_features(df).first()["features"]
    early = x[:max(1, int(n_layers * 0.25))].astype(float)
    np.testing.assert_allclose(got, np.r_[early.mean(0), early.std(0), early.max(0), np.zeros(10)], atol=1e-12)


def test_vector_moments(spark):
    states, data = make_states(spark, [1, 12])
    for r in FE.vector_moments(states, ["qid"]).collect():
        x = data[r["qid"]]
        np.testing.assert_allclose(r["mean"], x.mean(0), atol=1e-12)
        np.testing.assert_allclose(r["std"], x.std(0), atol=1e-12)
        np.testing.assert_allclose(r["max"], x.max(0))
