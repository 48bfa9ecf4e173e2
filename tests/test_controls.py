import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from tracewright.operators import difficulty as DI, precedence as P, verdict as V
from tracewright.params import EvalParams
from tracewright.plans.evaluate import Evaluation, evaluate


def test_pass_at_k(spark):
    df = spark.createDataFrame([("a", v) for v in (1, 0, 1, 0, 0)] + [("b", 0), ("b", 0)], "qid string, correct int")
    row = {r["qid"]: r for r in DI.pass_at_k(df, (1, 3)).collect()}["a"]
    assert (row["total_samples"], row["successes"], row["pass_at_1"], row["difficulty"]) == (5, 2, 1.0, 0.0)
    assert row["pass_at_3"] == pytest.approx(2 / 3)
    unbiased = {r["qid"]: r for r in DI.pass_at_k(df, (3,), "unbiased").collect()}
    assert unbiased["a"]["pass_at_1"] == pytest.approx(0.4) and unbiased["a"]["pass_at_3"] == pytest.approx(0.9)
    assert unbiased["b"]["pass_at_3"] is None
    mean = {r["qid"]: r["pass_at_1"] for r in DI.pass_at_k(df, (1,), "mean").collect()}
    assert mean["a"] == pytest.approx(0.4)


@pytest.mark.parametrize("n,q", [(7, 2), (10, 2), (12, 5), (11, 5), (23, 4)])
def test_bins_match_quantile_cut(spark, n, q):
    stats = spark.createDataFrame([(i, 1.0, float(i)) for i in range(n)], "qid int, pass_at_1 double, difficulty double")
    test = spark.createDataFrame([(i, i % 2) for i in range(n)] + [(99, 1)], "qid int, label int")
    rows = DI.stratify(test, stats, ["qid"], q).collect()
    got = {r["qid"]: r["difficulty_bin"] for r in rows}
    edges = [1 + (n - 1) * i / q for i in range(1, q)]
    assert got == {i: sum(i + 1 > e + 1e-9 for e in edges) for i in range(n)} | {99: None}


def test_single_difficulty(spark):
    stats = spark.createDataFrame([(i, 0.0, 1.0) for i in range(6)], "qid int, pass_at_1 double, difficulty double")
    test = spark.createDataFrame([(i, i % 2, i / 10) for i in range(6)], "qid int, label int, y_pred_prob double")
    bins = DI.bin_aucs(DI.stratify(test, stats, ["qid"]))
    row = bins.first()
    assert (row["difficulty_bin"], row["n"], row["n_shared"], row["baseline_auc"]) == (0, 6, 3, 0.5)
    out = DI.with_t_test(DI.paired_comparison(bins)).first()
    assert out["status"] == "insufficient_bins" and out["delta_auc"] is None and out["significant"] is False


def test_paired_t(spark):
    probe, base = np.array([0.8, 0.7, 0.9, 0.6]), np.array([0.5, 0.55, 0.6, 0.58])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(probe, base)] + [(None, None)],
                               "probe_auc double, baseline_auc double")
    row = DI.with_t_test(DI.paired_comparison(df)).first()
    gap = probe - base
    assert row["usable_bins"] == 4 and row["t_stat"] == pytest.approx(gap.mean() / (gap.std(ddof=1) / 2))
    assert 0.03 < row["p_val"] < 0.1
    same = DI.with_t_test(DI.paired_comparison(spark.createDataFrame([(0.75, 0.5)] * 3, df.schema))).first()
    assert same["p_val"] == 0.0 and same["significant"]


def logits_frame(spark, traces):
    rows = [(q, 0, 0, tok, len(m), i, m[i].tolist()) for q, (m, tok) in traces.items() for i in range(len(m))]
    return spark.createDataFrame(rows, "qid int, sample_idx int, correct int, answer_token_id int, n_steps int, step int, "
                                       "logits array<double>")


@pytest.mark.parametrize("rows", [3, 65_536])
def test_precedence_against_pandas(spark, rows):
    rng = np.random.default_rng(6)
    traces = {q: (rng.normal(size=(n, 9)) * 2, q % 9) for q, n in enumerate([1, 2, 3, 5, 8, 9, 16, 33, 50])}
    scalars = P.step_scalars(logits_frame(spark, traces))
    rolled = {}
    for r in P.rolling_entropy(scalars, rows).collect():
        rolled.setdefault(r["qid"], {})[r["step"]] = r["rolling"]
    locks = {r["qid"]: r for r in P.failure_lock(P.rolling_entropy(scalars, rows), rows=rows).collect()}
    emerged = {r["qid"]: r["emergence_step"] for r in P.answer_emergence(scalars).collect()}
    for q, (m, tok) in traces.items():
        p = np.exp(m) / np.exp(m).sum(axis=1, keepdims=True)
        s = pd.Series(-(p * np.log(p)).sum(axis=1)).rolling(max(2, len(m) // 4), center=True).mean()
        assert rolled.get(q, {}) == pytest.approx(s.dropna().to_dict())
        above = np.flatnonzero((s > s.mean() + 0.5 * s.std()).to_numpy())
        assert (locks[q]["lock_step"] if q in locks else None) == (above[0] if above.size else None)
        close = np.flatnonzero(m.max(axis=1) - m[:, tok] < 1.0)
        assert emerged[q] == (close[0] if close.size else None)


def test_large_logits(spark):
    m = np.array([[1000.0, 0.0, 1000.0]] * 8)
    row = P.step_scalars(logits_frame(spark, {0: (m, 1)})).first()
    assert row["entropy"] == pytest.approx(np.log(2)) and row["gap"] == 1000.0


def test_check_results_and_verdict(spark):
    rows = [(i, r) for i, r in enumerate(["pass"] * 17 + ["suspicious"] * 2 + ["no_lock"])]
    checks = spark.createDataFrame(rows, "qid int, check_result string")
    row = P.precedence_verdict(checks).first()
    assert (row["verdict"], row["suspicious_rate"], row["n_checked"]) == ("pass", 0.1, 20)
    assert P.precedence_verdict(checks.where("qid > 1")).first()["verdict"] == "suspicious"
    assert P.precedence_verdict(checks.limit(0)).first()["verdict"] == "insufficient_data"
    assert P.precedence_verdict(checks, enabled=False).first()["verdict"] == "skipped"
    assert P.precedence_verdict(None, source=checks).first()["status"] == "insufficient_data"


def test_explode_logits(spark):
    df = spark.createDataFrame([("q", 0, [[1.0, 2.0], [3.0, 1.0]], 1)],
                               "qid string, correct int, logits_per_step array<array<float>>, answer_token_id int")
    assert [r["gap"] for r in P.step_scalars(P.explode_logits(df)).orderBy("step").collect()] == [0.0, 2.0]


@pytest.mark.parametrize("auc,significant,delta,leak,want", [
    (0.5, True, 0.2, "pass", "NO-GO"), (None, True, 0.2, "pass", "NO-GO"), (float("nan"), True, 0.2, "pass", "NO-GO"),
    (0.8, False, 0.2, "pass", "NO-GO (difficulty only)"), (0.8, True, 0.04, "pass", "NO-GO (difficulty only)"),
    (0.8, None, None, "pass", "NO-GO (difficulty only)"), (0.8, True, 0.05, "suspicious", "CONDITIONAL"),
    (0.8, True, 0.05, "insufficient_data", "GO"), (0.8, True, 0.3, None, "GO")])
def test_go_no_go(spark, auc, significant, delta, leak, want):
    core = spark.createDataFrame([(auc,)], V.CORE)
    control = spark.createDataFrame([("ok", delta, significant, 0.01)], V.CONTROL)
    assert V.go_no_go(core, control, spark.createDataFrame([("ok", leak)], V.PRECEDENCE)).first()["verdict"] == want


def test_failed_steps(spark):
    def broken():
        raise RuntimeError("no data")
    fine = V.isolated(spark, lambda: spark.createDataFrame([(0.9,)], V.CORE), V.CORE)
    leak = V.isolated(spark, broken, V.PRECEDENCE)
    control = V.isolated(spark, broken, V.CONTROL)
    assert control.first()["error"] == "no data"
    assert V.go_no_go(fine, control, leak).first()["verdict"] == "BLOCKED"
    assert V.go_no_go(V.isolated(spark, broken, V.CORE), control, leak).first()["verdict"] == "NO-GO"


def planted(spark, strength, n=160, layers=8, d=6):
    """Traces whose early layers carry the outcome, with an independent difficulty mix."""
    rng = np.random.default_rng(11)
    traces, samples = [], []
    for q in range(n):
        hard = int(rng.random() < 0.5)
        for s in range(4):
            x = rng.normal(size=(layers, d)).astype(np.float32)
            x[:2, 0] += strength * hard
            correct = int(s == 0 and q % 2 == 0)
            traces.append((q, s, correct, x.tolist()))
        samples += [(q, int(rng.random() < (0.1 if hard else 0.9))) for _ in range(9)]
    return (spark.createDataFrame(traces, "qid int, sample_idx int, correct int, hidden_all_layers array<array<float>>"),
            spark.createDataFrame(samples, "qid int, correct int"))


def test_evaluate_finds_planted_signal(spark):
    params = EvalParams(ci_resamples=200)
    traces, samples = planted(spark, 3.0)
    run = evaluate(traces, samples, None, params)
    core = run.core.first()
    assert core["auc"] > 0.9 and core["ci_low"] <= core["auc"] <= core["ci_high"]
    assert run.bins.count() == 2
    row = run.verdict.first()
    assert row["verdict"] in ("GO", "NO-GO (difficulty only)") and row["precedence_verdict"] == "skipped"
    assert row["verdict"] == ("GO" if row["control_significant"] and row["control_delta_auc"] >= 0.05 else "NO-GO (difficulty only)")


def test_evaluation_is_written_and_read(spark, tmp_path):
    """Text matrices give what arrays give; broken ones are counted; a run that ended early has no later parts."""
    traces, samples = planted(spark, 3.0, n=60)
    params = EvalParams(ci_resamples=50)
    as_text = traces.withColumn("hidden_all_layers", F.to_json("hidden_all_layers"))
    more = spark.createDataFrame([(q, 9, 0, t) for q, t in ((0, "[[1, 2"), (1, None), (2, "[]"), (3, "[[1, null]]"))], as_text.schema)
    runs = [evaluate(t, samples, None, params) for t in (traces, as_text.unionByName(more))]
    plain, text = (r.core.first() for r in runs)
    assert text["n_labelled"] == plain["n_labelled"] + 4 and (plain["n_unusable"], text["n_unusable"]) == (0, 4)
    assert text["auc"] == plain["auc"] and text["n_test"] == plain["n_test"]
    path = str(tmp_path / "run")
    runs[1].write(path)
    back = Evaluation.read(spark, path)
    for name in ("verdict", "core", "predictions", "bins", "control"):
        a, b = getattr(runs[1], name), getattr(back, name)
        assert a.schema.names == b.schema.names and sorted(map(repr, a.collect())) == sorted(map(repr, b.collect())), name
    assert back.checks is None and not (tmp_path / "run/documents/predictions").exists()
    assert spark.read.json(f"{path}/documents/core").first()["kind"] == "core"
    evaluate(traces.limit(10), samples, None, params).write(str(tmp_path / "short"))
    short = Evaluation.read(spark, str(tmp_path / "short"))
    assert short.predictions is None and "too few" in short.core.first()["error"]
    with pytest.raises(FileNotFoundError, match="no evaluation"):
        Evaluation.read(spark, str(tmp_path / "nowhere"))


def test_evaluate_stops_early(spark):
    traces, samples = planted(spark, 0.0, n=12)
    run = evaluate(traces.limit(10), samples, None, EvalParams(ci_resamples=20))
    assert "too few wrong traces" in run.core.first()["error"]
    assert run.verdict.first()["verdict"] == "NO-GO" and run.control.first()["status"] == "not_run"
    run = evaluate(traces, samples.withColumn("correct", F.lit(1)), None, EvalParams(ci_resamples=20))
    assert "only one outcome" in run.core.first()["error"]
