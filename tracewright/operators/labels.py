"""Pass rates, outcome labels and sample-size gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, functions as F

MISSING_S = ("shared_hard", "salvageable", "error", "drop")
NULL_POLICIES = ("drop", "wrong", "right")


def pass_stats(samples: DataFrame, key: str = "qid") -> DataFrame:
    """Mean, sum and count of correctness per question (partial sums before the shuffle)."""
    return samples.groupBy(key).agg(
        F.avg("correct").alias("s_pass_rate"),
        F.sum("correct").cast("long").alias("s_correct_count"),
        F.count("correct").alias("s_total"))


def model_accuracy(labels: DataFrame) -> DataFrame:
    return labels.groupBy("model").agg(F.avg("correct").alias("accuracy"), F.count("correct").alias("n"))


def one_model(samples: DataFrame, model: str | None, require_name: bool = False) -> DataFrame:
    """Narrow a table to one model, only if it has a model column with several values."""
    if "model" not in samples.columns:
        return samples
    found = [r["model"] for r in samples.select("model").distinct().orderBy("model").collect()]
    if len(found) <= 1:
        return samples
    if model is None and require_name:
        raise ValueError(f"several models present, name one of {found}")
    if samples.where(F.col("model") == model).isEmpty():
        raise ValueError(f"model {model!r} not found, available: {found}")
    return samples.where(F.col("model") == model)


def resolve_null_correct(w: DataFrame, null_policy: str = "drop") -> DataFrame:
    """Decide what an unscored trace counts as."""
    if null_policy not in NULL_POLICIES:
        raise ValueError(f"null_policy must be one of {NULL_POLICIES}")
    if null_policy == "drop":
        return w.where(F.col("correct").isNotNull())
    return w.withColumn("correct", F.coalesce("correct", F.lit(int(null_policy == "right"))))


def outcome_label(pass_rate: Column, missing_s: str = "shared_hard", threshold: float = 0.5) -> Column:
    """1 = the strong model fails too, 0 = it succeeds (pass rate strictly above the threshold)."""
    if missing_s not in MISSING_S:
        raise ValueError(f"missing_s must be one of {MISSING_S}")
    label = (pass_rate <= threshold).cast("int")
    if missing_s == "shared_hard":
        return F.coalesce(label, F.lit(1))
    if missing_s == "salvageable":
        return F.coalesce(label, F.lit(0))
    if missing_s == "error":
        return F.coalesce(label, F.raise_error(F.lit("question without strong-model samples")).cast("int"))
    return label


def outcomes(w: DataFrame, s_stats: DataFrame, missing_s: str = "shared_hard",
             null_policy: str = "drop", threshold: float = 0.5) -> DataFrame:
    """All traces with the strong model's pass statistics and both outcome flags."""
    joined = resolve_null_correct(w, null_policy).join(s_stats, "qid", "left")
    if missing_s == "drop":
        joined = joined.where(F.col("s_pass_rate").isNotNull())
    fails = outcome_label(F.col("s_pass_rate"), missing_s, threshold)
    return joined.withColumn("s_wrong", fails).withColumn("w_correct", (F.col("correct") != 0).cast("int"))


def label_outcomes(w: DataFrame, s_stats: DataFrame, missing_s: str = "shared_hard",
                   null_policy: str = "drop", threshold: float = 0.5) -> DataFrame:
    """Only the traces the weak model got wrong, labelled shared-hard (1) or salvageable (0)."""
    wrong = resolve_null_correct(w, null_policy).where(F.col("correct") == 0)
    return outcomes(wrong, s_stats, missing_s, "drop", threshold).withColumnRenamed("s_wrong", "label") \
        .drop("w_correct")


def missing_strong_questions(w: DataFrame, s_stats: DataFrame) -> DataFrame:
    """Questions without any strong-model sample; must be empty for a strict lookup."""
    return w.select("qid").join(s_stats, "qid", "left_anti").distinct()


def outcome_cells(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def outcome_cube(all_outcomes: DataFrame) -> DataFrame:
    """Counts for each cell and margin of the 2x2 table."""
    return all_outcomes.cube("w_correct", "s_wrong").agg(F.count(F.lit(1)).alias("n"))


def sample_gates(labelled: DataFrame, min_rows: int = 30, min_cell: int = 10) -> DataFrame:
    """One row: do the labelled traces suffice to train a probe? A small cell is a warning, the others stop a run."""
    n1 = F.coalesce(F.sum(F.col("label")).cast("long"), F.lit(0).cast("long"))
    counted = labelled.agg(F.count(F.lit(1)).alias("n"), n1.alias("n_shared"),
                           (F.count(F.lit(1)) - n1).alias("n_salvageable"))
    status = (F.when(F.col("n") < min_rows, "too_few_rows")
              .when((F.col("n_shared") == 0) | (F.col("n_salvageable") == 0), "one_class")
              .when(F.least("n_shared", "n_salvageable") < min_cell, "small_cell")
              .otherwise("ok"))
    return counted.withColumn("status", status)


def require_samples(labelled: DataFrame, min_rows: int = 30, min_cell: int = 10) -> Row:
    """Stop an evaluation that has too few wrong traces or only one outcome; otherwise the gate's row."""
    gate = sample_gates(labelled, min_rows, min_cell).first()
    if gate["status"] == "too_few_rows":
        raise RuntimeError(f"too few wrong traces: {gate['n']} < {min_rows}")
    if gate["status"] == "one_class":
        raise RuntimeError("only one outcome among the wrong traces, no probe can be trained")
    return gate
