"""All eight metrics against plain matrices, with blocks and tiles far smaller than the trajectories."""

import numpy as np
import pytest

from tracewright.functions import pvalues as PV
from tracewright.operators import dynamics as D, pairwise as PW
from tests.test_states import make_states


def norms(x):
    return np.sqrt((x * x).sum(axis=1))


def expected(x, theiler=5):
    n = len(x)
    out = dict.fromkeys(D.METRICS)
    if n < 3:
        return out
    step = np.diff(x, axis=0)
    length, size = norms(step), norms(x)
    out["mean_step_norm"] = length.mean() / size.mean()
    net = norms(x[[-1]] - x[[0]])[0]
    out["tortuosity"] = length.sum() / net if net > 0 else None
    both = length[:-1] * length[1:]
    if (both > 0).any():
        out["mean_consec_cos"] = ((step[:-1] * step[1:]).sum(axis=1)[both > 0] / both[both > 0]).mean()
    out["spread"] = norms(x - x.mean(axis=0)).mean() / size.mean()
    if (size > 0).all():
        cosines = (x / size[:, None]) @ (x / size[:, None]).T
        lag = max(1, int(n * 0.25))
        out["longrange_selfsim"] = np.mean([cosines[i, j] for i in range(n) for j in range(i + lag, n)])
        bad = np.flatnonzero(~(cosines[:, -1] > 0.9))
        out["settle_frac"] = min(n - 1, bad.max() + 1 if bad.size else 0) / (n - 1)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    far = [[d[i, j] for j in range(n) if abs(i - j) > theiler] for i in range(n)]
    pairs = [d[i, j] for i in range(n) for j in range(i + theiler + 1, n)]
    if pairs and np.median(pairs) > 0:
        out["nearest_revisit"] = np.mean([min(f) for f in far if f]) / np.median(pairs)
    two = [sorted(f)[:2] for f in far if len(f) > 1]
    ratio = np.array([b / a for a, b in two if a > 0 and b / a > 1])
    if ratio.size:
        out["intrinsic_dim"] = ratio.size / np.log(ratio).sum()
    return out


LENGTHS = [1, 2, 3, 4, 6, 7, 8, 9, 17, 41]


def check(rows, data, metrics, tol=1e-9):
    got = {r["qid"]: r.asDict() for r in rows}
    for q, x in data.items():
        want = expected(x)
        for m in metrics:
            value = got[q][m] if q in got else None
            assert (value is None) == (want[m] is None), (q, len(x), m, value, want[m])
            if value is not None:
                assert value == pytest.approx(want[m], rel=tol, abs=tol), (q, len(x), m)


@pytest.mark.parametrize("rows", [4, 7, 4096])
def test_linear(spark, rows):
    states, data = make_states(spark, LENGTHS)
    check(D.linear_metrics(states, rows=rows).collect(), data,
          ["mean_step_norm", "tortuosity", "mean_consec_cos", "settle_frac", "spread"])


@pytest.mark.parametrize("rows", [3, 8, 4096])
def test_selfsim(spark, rows):
    states, data = make_states(spark, LENGTHS)
    check(D.long_range_similarity(states, rows=rows).collect(), data, ["longrange_selfsim"])


@pytest.mark.parametrize("rows", [3, 10, 1024])
def test_pairwise(spark, rows):
    states, data = make_states(spark, LENGTHS)
    check(PW.pairwise_metrics(states, rows=rows).collect(), data, ["nearest_revisit", "intrinsic_dim"])


@pytest.mark.parametrize("rows", [4, 1024])
def test_pairwise_repeated_points(spark, rows):
    """A lattice walk: most distances tie, many nearest distances are zero."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2, size=(25, 2)).astype(float)
    states = spark.createDataFrame([(0, 0, 0, i, i, 25, 25, v.tolist()) for i, v in enumerate(x)], make_states(spark, [1])[0].schema)
    check(PW.pairwise_metrics(states, rows=rows).collect(), {0: x}, ["nearest_revisit", "intrinsic_dim"])


def clustered(n, seed=5, width=6):
    """Steps that jump between eight far centres."""
    rng = np.random.default_rng(seed)
    return rng.normal(size=(8, width))[rng.integers(0, 8, n)] * 40 + rng.normal(size=(n, width))


def one_trajectory(spark, x):
    return spark.createDataFrame([(0, 0, 0, i, i, len(x), len(x), v.tolist()) for i, v in enumerate(x)], make_states(spark, [1])[0].schema)


def test_pairwise_tiles(spark):
    """Bounds hold, every far pair is in one tile, and every tile that is not read could not have changed a neighbour."""
    x, theiler = clustered(300), 5
    states = one_trajectory(spark, x)
    placed = PW._placed(states, PW._ids(states), 20)
    tiles = PW._tiles(placed, theiler)
    block = {r["pos"]: r["block"] for r in placed.collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    inside = {}
    for i in range(300):
        for j in range(i + theiler + 1, 300):
            inside.setdefault(tuple(sorted((block[i], block[j]))), []).append(d[i, j])
    found = {(r["ta"], r["tb"]): r for r in tiles.collect()}
    assert {k: len(v) for k, v in inside.items()} == {k: r["pairs"] for k, r in found.items()}
    assert all(found[k]["low"] <= min(v) and max(v) <= found[k]["high"] for k, v in inside.items())
    two = [sorted(d[i, j] for j in range(300) if abs(i - j) > theiler)[:2] for i in range(300)]
    own = {}
    for i in range(300):
        near = sorted(d[i, j] for j in range(300) if block[j] == block[i] and abs(i - j) > theiler)[:2]
        own[block[i]] = max(own.get(block[i], 0.0), near[1] if len(near) > 1 else np.inf)
    reach = spark.createDataFrame([(0, 0, 0, b, float(r)) for b, r in own.items()],
                                  states.select("qid", "sample_idx", "layer").schema.add("block", "integer").add("reach", "double"))
    read = {(r["ta"], r["tb"]) for r in PW.needed(tiles, reach).collect()}
    apart = [k for k in found if k[0] < k[1]]
    assert len(read) < len(apart) / 2
    for a, b in set(apart) - read:
        worst = max(two[i][1] for i in range(300) if block[i] in (a, b))
        assert min(inside[a, b]) > worst
    check(PW.pairwise_metrics(states, theiler, rows=20).collect(), {0: x}, ["nearest_revisit", "intrinsic_dim"])


@pytest.mark.parametrize("n", [60, 500])
def test_pairwise_passes(spark, monkeypatch, n):
    """Four reads of tiles, two for neighbours and two for the median, whatever the length; coarse sketches."""
    reads, read = [], PW._read
    monkeypatch.setattr(PW, "_read", lambda *a: reads.append(1) or read(*a))
    monkeypatch.setattr(PW, "SLICES", 7)
    monkeypatch.setattr(PW, "BINS", 5)
    x = np.round(clustered(n, n), 0) if n == 60 else clustered(n, n)
    check(PW.pairwise_metrics(one_trajectory(spark, x), rows=25).collect(), {0: x}, ["nearest_revisit", "intrinsic_dim"])
    assert len(reads) == 4


def test_pairwise_equal_steps(spark):
    """Blocks of equal radii are dealt to parts; all distances are zero but for one step."""
    x = np.zeros((90, 3))
    x[40] = 2.0
    check(PW.pairwise_metrics(one_trajectory(spark, x), rows=10).collect(), {0: x}, ["nearest_revisit", "intrinsic_dim"])


def test_degenerate(spark):
    schema = make_states(spark, [1])[0].schema
    constant = np.ones((8, 2))
    loop = np.array([[1.0, 0], [0, 1], [1, 1], [1, 0]])
    with_zero = np.array([[0.0, 0], [1, 0], [0, 2], [3, 1]])
    rows = [(q, 0, 0, i, i, len(x), 9, v.tolist()) for q, x in enumerate([constant, loop, with_zero]) for i, v in enumerate(x)]
    states = spark.createDataFrame(rows, schema)
    linear = {r["qid"]: r for r in D.linear_metrics(states).collect()}
    assert linear[0]["tortuosity"] is None and linear[0]["mean_consec_cos"] is None and linear[0]["settle_frac"] == 0
    assert linear[1]["tortuosity"] is None
    assert linear[2]["settle_frac"] == pytest.approx(1.0)
    sims = {r["qid"]: r["longrange_selfsim"] for r in D.long_range_similarity(states).collect()}
    assert sims[0] == pytest.approx(1.0) and sims[2] is None
    pairs = {r["qid"]: r for r in PW.pairwise_metrics(states).collect()}
    assert pairs[0]["nearest_revisit"] is None and pairs[0]["intrinsic_dim"] is None


def test_all_metrics_and_tests(spark):
    states, data = make_states(spark, [9] * 12)
    metrics = D.trajectory_metrics(states, rows=4)
    check(metrics.collect(), data, D.METRICS)
    labels = spark.createDataFrame([(q, 0, q % 2) for q in data], "qid int, sample_idx int, label int")
    tests = D.with_p_values(D.group_tests(D.metrics_long(metrics), labels)).collect()
    assert {t["metric"] for t in tests} == set(D.METRICS)
    for t in tests:
        values = [[expected(x)[t["metric"]] for q, x in data.items() if q % 2 == k] for k in (0, 1)]
        wins = sum((a > b) + 0.5 * (a == b) for a in values[1] for b in values[0])
        assert t["mannwhitney_u"] == pytest.approx(wins)
        assert t["shared_hard_median"] == pytest.approx(np.median(values[1]))
        assert 0 <= t["p_value"] <= 1
    summary = D.chance_summary(D.with_p_values(D.group_tests(D.metrics_long(metrics), labels))).first()
    assert summary["n_tests"] == 8 and summary["expected_by_chance"] == pytest.approx(0.4)


def test_p_values():
    # textbook values
    assert PV.t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-8)
    assert PV.t_two_sided(0.0, 3) == pytest.approx(1.0)
    assert PV.t_two_sided(12.706204736, 1) == pytest.approx(0.05, abs=1e-9)
    # three against three, complete separation: 2 of 20 arrangements
    assert PV.mann_whitney_two_sided(9, 3, 3, 0) == pytest.approx(0.1)
    assert PV.mann_whitney_two_sided(0, 3, 3, 0) == pytest.approx(0.1)
    assert PV.mann_whitney_two_sided(8, 4, 4, 0) == pytest.approx(1.0)
    # exact and normal meet for larger groups
    assert PV.mann_whitney_two_sided(230, 8, 40, 0) == pytest.approx(PV.mann_whitney_two_sided(230, 8, 40, 6.0), abs=0.01)
    counts = np.diff([0, *(PV.u_share(u, 2, 3) for u in range(7))]) * 10
    assert counts == pytest.approx([1, 1, 2, 2, 2, 1, 1])


def test_exact_shares_for_any_group_size():
    """Against the full polynomial, and beyond the counts that are kept."""
    for k, m in ((1, 5), (3, 9), (8, 12)):
        poly = np.zeros(k * m + 1)
        poly[0] = 1
        for i in range(1, k + 1):
            shifted = poly.copy()
            if m + i <= k * m:
                shifted[m + i:] -= poly[:poly.size - m - i]
            for r in range(i):
                shifted[r::i] = np.cumsum(shifted[r::i])
            poly = shifted
        want = np.cumsum(poly) / poly.sum()
        assert [PV.u_share(u, k, m) for u in range(k * m + 1)] == pytest.approx(want, abs=1e-12)
    assert PV.u_share(10_000_000, 2, 20_000_000) == pytest.approx(0.125, abs=1e-6)
    assert PV.mann_whitney_two_sided(4e7 * 8 / 2, 8, 40_000_000, 0) == pytest.approx(1.0, abs=1e-6)
