"""The full evaluation: probe, difficulty control, precedence control, verdict."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType

from ..operators import bootstrap, difficulty as DI, features as FE, labels as L, precedence as P, probes, states as S, verdict as V
from ..params import DEFAULTS, EvalParams
from ..session import cut_lineage
from ..sources import sinks, tables

KEYS = ["qid", "sample_idx"]


@dataclass
class Evaluation:
    """Result tables of one run; parts that were not reached are None."""
    verdict: DataFrame
    core: DataFrame
    predictions: DataFrame | None = None
    bins: DataFrame | None = None
    control: DataFrame | None = None
    checks: DataFrame | None = None

    def write(self, path: str, documents_without: tuple[str, ...] = ("predictions",)) -> None:
        """Every part as a table below `tables/`, and as JSON documents below `documents/` but for those named."""
        for part in fields(self):
            rows = getattr(self, part.name)
            if rows is not None:
                rows.write.mode("overwrite").parquet(f"{path}/tables/{part.name}")
                if part.name not in documents_without:
                    sinks.result_document(rows, part.name).write.mode("overwrite").json(f"{path}/documents/{part.name}")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Evaluation:
        """A run as it was written; parts that it did not reach are None."""
        found = set(tables.folders(spark, f"{path}/tables"))
        if "verdict" not in found:
            raise FileNotFoundError(f"no evaluation below {path}")
        return cls(**{f.name: spark.read.parquet(f"{path}/tables/{f.name}") if f.name in found else None for f in fields(cls)})


def labelled_features(traces: DataFrame, s_samples: DataFrame, params: EvalParams = DEFAULTS,
                      missing_s: str = "shared_hard") -> tuple[DataFrame, dict]:
    """Early-layer features of the wrong traces with their outcome label; the state of the sample-size gate, and how many
    labelled traces there are and how many of them are left out for want of a matrix.

    Matrices may be stored as JSON text; text that is none counts as missing.
    """
    if isinstance(traces.schema["hidden_all_layers"].dataType, StringType):
        traces = S.decode_vectors(traces, "hidden_all_layers").drop("parse_ok")
    # as a table the rates have a measured size: the planner need not shuffle the wide traces to learn it
    stats = cut_lineage(L.pass_stats(s_samples))
    labelled = L.label_outcomes(traces, stats, missing_s, threshold=params.pass_threshold)
    gate = L.require_samples(labelled.select("label"), params.min_w_wrong_samples, params.min_cell_size)
    count = FE.unusable_rows(labelled).first()
    state = {"gate": gate["status"], "n_labelled": count["n"], "n_unusable": count["n_unusable"]}
    return FE.early_trace_features(labelled, params.prefix_fraction), state


def evaluate(traces: DataFrame, s_samples: DataFrame, logit_steps: DataFrame | None = None,
             params: EvalParams = DEFAULTS, missing_s: str = "shared_hard", interval: bool = True) -> Evaluation:
    """Run the controls in order. A step that fails leaves a status row; without signal the run ends early.

    `traces` are single-position traces (qid, sample_idx, correct, hidden_all_layers as arrays or JSON text), `logit_steps` rows per step
    with logits and answer_token_id, or None to skip the precedence control.
    """
    spark = traces.sparkSession
    held: dict[str, DataFrame] = {}

    def core_step() -> DataFrame:
        features, state = labelled_features(traces, s_samples, params, missing_s)
        held["predictions"] = cut_lineage(probes.probe_predictions(
            features, KEYS, fraction=params.test_fraction, seed=params.seed))
        summary = probes.probe_summary(held["predictions"]).withColumns({k: F.lit(v) for k, v in state.items()}).withColumn(
            "few_shared_test_rows", F.col("n_shared_test") < params.min_shared_cell)
        if not interval:
            return summary.withColumn("ci_low", F.lit(None).cast("double")).withColumn("ci_high", F.lit(None).cast("double"))
        ci = bootstrap.auc_interval(held["predictions"], KEYS, "y_pred_prob", "label", params.ci_resamples, params.seed)
        low, high = ci.first()[:2]
        return summary.withColumn("ci_low", F.lit(low).cast("double")).withColumn("ci_high", F.lit(high).cast("double"))

    def control_step() -> DataFrame:
        stats = DI.pass_at_k(L.resolve_null_correct(traces), params.pass_at_k)
        held["bins"] = cut_lineage(DI.bin_aucs(DI.stratify(
            held["predictions"], stats, KEYS, params.difficulty_bins, params.seed)))
        return DI.with_t_test(DI.paired_comparison(held["bins"]))

    def precedence_step() -> DataFrame:
        wrong = logit_steps.where(F.col("correct") == 0)
        if params.trace_cap:
            # an operator of its own: a seeded sample of traces is checked, not all of them
            chosen = P.sample_traces(wrong.select(*KEYS).distinct(), params.trace_cap, params.seed)
            wrong = wrong.join(chosen, KEYS, "left_semi")
        held["checks"] = cut_lineage(P.check_traces(wrong, params.emergence_gap, params.lock_factor))
        return P.precedence_verdict(held["checks"], params.suspicious_rate)

    core = V.isolated(spark, core_step, V.CORE)
    if V.has_signal(core):
        control = V.isolated(spark, control_step, V.CONTROL)
        if logit_steps is None:
            leak = P.precedence_verdict(None, enabled=False, spark=spark)
        else:
            leak = V.isolated(spark, precedence_step, V.PRECEDENCE)
    else:
        control, leak = V.not_run(spark, V.CONTROL), V.not_run(spark, V.PRECEDENCE)
    decision = V.go_no_go(core, control, leak, params.min_auc_over_baseline)
    return Evaluation(decision, core, held.get("predictions"), held.get("bins"), control, held.get("checks"))
