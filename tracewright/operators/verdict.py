"""The go/no-go decision from the probe, the difficulty control and the precedence control."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CORE = "auc double"
CORE_MORE = {"core_ci_low": "double", "core_ci_high": "double", "core_gate": "string", "core_few_shared_test_rows": "boolean"}
CONTROL = "status string, delta_auc double, significant boolean, p_val double"
PRECEDENCE = "status string, verdict string"


def isolated(spark: SparkSession, step: Callable[[], DataFrame], schema: str) -> DataFrame:
    """Run one step; what its checks refuse becomes a status row instead of ending the whole evaluation."""
    try:
        frame = step()
        rows = frame.limit(2).collect()
        if len(rows) != 1:
            raise ValueError(f"a step must yield one row, got {'none' if not rows else 'several'}")
        return spark.createDataFrame(rows, frame.schema).withColumn("error", F.lit(None).cast("string"))
    except (ValueError, RuntimeError) as e:  # the step's own checks; anything else ends the run
        fields = [f.strip().split(" ")[0] for f in schema.split(",")]
        return spark.createDataFrame([tuple(None for _ in fields)], schema).withColumn("error", F.lit(str(e)))


def not_run(spark: SparkSession, schema: str) -> DataFrame:
    """The row of a step that an earlier failure made pointless."""
    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    return spark.createDataFrame([tuple("not_run" if n == "status" else None for n in names)], schema)


def has_signal(core: DataFrame) -> bool:
    row = core.first()
    return row["error"] is None and row["auc"] is not None and row["auc"] > 0.5


def verdict_of(auc: Column, core_error: Column, control_error: Column, significant: Column, delta: Column,
               precedence: Column, min_margin: float = 0.05) -> Column:
    """The decision rule. An undefined AUC is no signal, so it can never lead to GO."""
    # The verdict words.
    beats = F.coalesce(significant & (delta >= min_margin), F.lit(False))
    return (F.when(core_error.isNotNull() | auc.isNull() | F.isnan(auc) | (auc <= 0.5), "NO-GO")
            .when(control_error.isNotNull(), "BLOCKED")
            .when(~beats, "NO-GO (difficulty only)")
            .when(precedence == "suspicious", "CONDITIONAL")
            .otherwise("GO"))


def go_no_go(core: DataFrame, control: DataFrame, precedence: DataFrame, min_margin: float = 0.05) -> DataFrame:
    """One row with the state of each step and the decision."""
    def named(df: DataFrame, prefix: str) -> DataFrame:
        present = df if "error" in df.columns else df.withColumn("error", F.lit(None).cast("string"))
        return present.select(*[F.col(c).alias(f"{prefix}_{c}") for c in present.columns])

    # three one-row tables side by side: stacked, then folded over their disjoint columns
    stacked = named(core, "core").unionByName(named(control, "control"), allowMissingColumns=True).unionByName(
        named(precedence, "precedence"), allowMissingColumns=True)
    row = stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
    verdict = verdict_of(F.col("core_auc"), F.col("core_error"), F.col("control_error"), F.col("control_significant"),
                         F.col("control_delta_auc"), F.col("precedence_verdict"), min_margin)
    status = (F.when(F.col("core_error").isNotNull(), "error").when(F.col("core_auc").isNull() | F.isnan("core_auc"), "undefined")
              .when(F.col("core_auc") <= 0.5, "fail").otherwise("pass"))
    more = [F.col(c) if c in row.columns else F.lit(None).cast(t).alias(c) for c, t in CORE_MORE.items()]
    return row.select(status.alias("core_status"), "core_auc", *more, "control_status", "control_delta_auc", "control_significant",
                      "precedence_verdict", verdict.alias("verdict"))
