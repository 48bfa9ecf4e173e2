"""Does the failure lock of a wrong trace come before its answer emerges?"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.vectors import entropy_of_logits, logit_gap
from ..session import cut_lineage
from .curation import require_columns
from .ranking import seeded_hash

TRACE = ["qid", "sample_idx"]
BLOCK_STEPS = 65_536


def explode_logits(traces: DataFrame) -> DataFrame:
    """(trace, step) -> logits from one nested matrix per trace."""
    sample = F.col("sample_idx") if "sample_idx" in traces.columns else F.lit(0).alias("sample_idx")
    return traces.select("qid", sample, "correct", "answer_token_id", F.size("logits_per_step").alias("n_steps"),
                         F.posexplode("logits_per_step").alias("step", "raw")).select(
        *TRACE, "correct", "answer_token_id", "n_steps", "step", F.col("raw").cast("array<double>").alias("logits"))


def sample_traces(traces: DataFrame, n: int, seed: int = 0, keys: list[str] | None = None) -> DataFrame:
    """A seeded random sample of at most n traces."""
    keys = keys or TRACE
    return traces.orderBy(seeded_hash(*[F.col(k) for k in keys], seed=seed), *keys).limit(n)


def step_scalars(steps: DataFrame) -> DataFrame:
    """Entropy and answer gap per step; the logits themselves travel no further."""
    return steps.select(*TRACE, "step", "n_steps", "correct", entropy_of_logits(F.col("logits")).alias("entropy"),
                        logit_gap(F.col("logits"), F.col("answer_token_id")).alias("gap"))


def answer_emergence(scalars: DataFrame, gap: float = 1.0) -> DataFrame:
    """First step whose answer logit is within `gap` of the top; NULL if there is none."""
    return scalars.groupBy(*TRACE).agg(
        F.max("correct").alias("correct"), F.max("n_steps").alias("n_steps"),
        F.min(F.when(F.col("gap") < gap, F.col("step"))).alias("emergence_step"))


def rolling_entropy(scalars: DataFrame, rows: int = BLOCK_STEPS) -> DataFrame:
    """Centred rolling mean over max(2, n // 4) steps, only where the window is complete.

    The window length differs per trace, so the mean is a difference of two running sums. Each running sum is
    sent to the two labels that need it; sums run inside blocks and are shifted by the totals of earlier blocks.
    """
    block = F.expr(f"cast(step div {int(rows)} as int)")
    steps = scalars.select(*TRACE, "step", "n_steps", "entropy", block.alias("block"))
    earlier = Window.partitionBy(*TRACE).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = steps.groupBy(*TRACE, "block").agg(F.sum("entropy").alias("_t")).select(
        *TRACE, "block", F.coalesce(F.sum("_t").over(earlier), F.lit(0.0)).alias("_offset"))
    inside = Window.partitionBy(*TRACE, "block").orderBy("step")
    width = F.greatest(F.lit(2), F.expr("cast(n_steps div 4 as int)"))
    sums = steps.join(offsets, [*TRACE, "block"]).withColumn(
        "cum", F.sum("entropy").over(inside) + F.col("_offset")).withColumn("w", width).withColumn(
        "o", F.expr("cast((w - 1) div 2 as int)"))
    uses = F.array(F.struct((F.col("step") - F.col("o")).alias("label"), F.col("cum").alias("part")),
                   F.struct((F.col("step") - F.col("o") + F.col("w")).alias("label"), (-F.col("cum")).alias("part")))
    spread = sums.select(*TRACE, "n_steps", "w", "o", F.explode(uses).alias("u")).select(
        *TRACE, "n_steps", "w", "o", "u.label", "u.part").where(
        (F.col("label") >= F.col("w") - 1 - F.col("o")) & (F.col("label") <= F.col("n_steps") - 1 - F.col("o")))
    return spread.groupBy(*TRACE, F.col("label").alias("step")).agg(
        (F.sum("part") / F.max("w")).alias("rolling"), F.max("n_steps").alias("n_steps"))


def failure_lock(rolling: DataFrame, factor: float = 0.5, rows: int = BLOCK_STEPS) -> DataFrame:
    """First step whose rolling entropy exceeds the trace's mean by `factor` sample deviations, and its value."""
    limits = rolling.groupBy(*TRACE).agg(
        (F.avg("rolling") + factor * F.stddev_samp("rolling")).alias("limit"), F.max("n_steps").alias("n_steps"))
    copies = limits.select(*TRACE, "limit", F.explode(
        F.expr(f"sequence(0, cast((n_steps - 1) div {int(rows)} as int))")).alias("block"))
    above = rolling.withColumn("block", F.expr(f"cast(step div {int(rows)} as int)")).join(
        copies, [*TRACE, "block"]).where((F.col("rolling") > F.col("limit")) & (F.col("step") < F.col("n_steps")))
    return above.groupBy(*TRACE).agg(F.min(F.struct("step", "rolling")).alias("_l")).select(
        *TRACE, F.col("_l.step").alias("lock_step"), F.col("_l.rolling").alias("divergence"))


def check_traces(steps: DataFrame, gap: float = 1.0, factor: float = 0.5) -> DataFrame:
    """Lock step, emergence step and check result of every trace.

    The two numbers per step are written out once: reading the logits again for each use would cost far more.
    """
    scalars = cut_lineage(step_scalars(steps))
    joined = answer_emergence(scalars, gap).join(
        failure_lock(rolling_entropy(scalars), factor), TRACE, "left")
    lock, emerged = F.col("lock_step"), F.col("emergence_step")
    # The words for a check's result.
    result = (F.when(F.col("correct") != 0, "not_applicable").when(lock.isNull(), "no_lock")
              .when(emerged.isNull(), "no_emergence").when(lock < emerged, "pass").otherwise("suspicious"))
    return joined.select(*TRACE, "correct", "emergence_step", "lock_step", "divergence", result.alias("check_result"))


def check_counts(checks: DataFrame) -> DataFrame:
    return checks.groupBy("check_result").agg(F.count(F.lit(1)).alias("n"))


def precedence_verdict(checks: DataFrame | None, max_rate: float = 0.1, enabled: bool = True,
                       source: DataFrame | None = None, spark=None) -> DataFrame:
    """One row with the rates and the verdict: pass, suspicious, insufficient_data or skipped.

    `source` is the raw trace table; without its logit columns there is nothing to check.
    """
    columns = "status string, n_checked bigint, pass_rate double, suspicious_rate double, verdict string"
    spark = spark or (checks.sparkSession if checks is not None else source.sparkSession)
    if not enabled:
        return spark.createDataFrame([("disabled", None, None, None, "skipped")], columns)
    if source is not None and require_columns(source, {"logits_per_step", "answer_token_id"}):
        return spark.createDataFrame([("insufficient_data", None, None, None, "insufficient_data")], columns)
    counted = checks.agg(
        F.count(F.lit(1)).alias("n_checked"),
        F.count_if(F.col("check_result") == "pass").alias("_p"),
        F.count_if(F.col("check_result") == "suspicious").alias("_s"))
    none = F.col("n_checked") == 0
    rate = F.try_divide(F.col("_s").cast("double"), F.col("n_checked").cast("double"))
    return counted.select(
        F.when(none, "no_valid_traces").otherwise("ok").alias("status"), "n_checked",
        F.try_divide(F.col("_p").cast("double"), F.col("n_checked").cast("double")).alias("pass_rate"),
        rate.alias("suspicious_rate"),
        F.when(none, "insufficient_data").when(rate <= max_rate, "pass").otherwise("suspicious").alias("verdict"))
