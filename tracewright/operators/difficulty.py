"""Difficulty control: does a probe beat plain pass-rate difficulty inside bins of equal difficulty?"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .ranking import auc, hash_row_number

ESTIMATORS = ("capped", "unbiased", "mean")


def pass_at_k(traces: DataFrame, ks: tuple[int, ...] = (1,), estimator: str = "capped") -> DataFrame:
    """Attempts, successes, pass@k and difficulty = 1 - pass@1 per question.

    "capped" is min(successes, k) / k; "unbiased" is 1 - C(n-c, k) / C(n, k); "mean" is the success rate.
    Unscored attempts are no successes and are not counted; a question with only such attempts has pass@k 0.
    """
    if estimator not in ESTIMATORS:
        raise ValueError(f"estimator must be one of {ESTIMATORS}")
    stats = traces.groupBy("qid").agg(
        F.count("correct").alias("total_samples"), F.coalesce(F.sum("correct"), F.lit(0)).cast("long").alias("successes"))
    n, s = F.col("total_samples"), F.col("successes")
    for k in sorted(set(ks) | {1}):
        if estimator == "capped":
            value = F.least(s, F.lit(k)) / F.lit(float(k))
        elif estimator == "mean":
            value = F.try_divide(s.cast("double"), n.cast("double"))
        else:
            # product over k draws without replacement, all failures
            miss = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda p, i: p * F.coalesce(
                F.try_divide(F.greatest(n - s - i, F.lit(0)).cast("double"), (n - i).cast("double")), F.lit(0.0)))
            value = F.when(n >= k, 1.0 - miss)
        stats = stats.withColumn(f"pass_at_{k}", value)
    return stats.withColumn("difficulty", 1.0 - F.col("pass_at_1"))


def stratify(test: DataFrame, stats: DataFrame, keys: list[str], n_bins: int = 5, seed: int = 0) -> DataFrame:
    """Adds pass_at_1, difficulty and an equal-sized `difficulty_bin` by rank of difficulty.

    Ties are broken by a seeded hash of the row keys. Rank r of n falls into the first of q = min(n_bins,
    distinct difficulties) bins whose right-closed edge 1 + (n-1) i/q is not below r, in whole numbers.
    Fewer than two difficulties give the single bin 0, an unknown difficulty gives no bin.
    """
    joined = cut_lineage(test.join(stats.select("qid", "pass_at_1", "difficulty"), "qid", "left"))
    known = joined.where(F.col("difficulty").isNotNull())
    levels = known.agg(F.least(F.lit(n_bins), F.count_distinct("difficulty")).cast("long").alias("q")).scalar()
    ranked = hash_row_number(known, keys, seed, order=["difficulty"]).withColumn("_q", levels)
    edge = F.expr("cast((row_no * _q + row_total - 2) div (row_total - 1) as int) - 1")
    binned = ranked.withColumn("difficulty_bin", F.when(F.col("_q") < 2, 0).when(F.col("row_total") < 2, 0)
                               .otherwise(F.greatest(F.lit(0), edge))).drop("_q", "row_no", "row_total")
    unknown = joined.where(F.col("difficulty").isNull()).withColumn("difficulty_bin", F.lit(None).cast("int"))
    return binned.unionByName(unknown)


def bin_aucs(stratified: DataFrame, score: str = "y_pred_prob", label: str = "label") -> DataFrame:
    """Probe AUC and difficulty AUC per bin; NULL in bins with one class, which stay listed."""
    rows = stratified.where(F.col("difficulty_bin").isNotNull()).withColumn("_base", 1.0 - F.col("pass_at_1"))
    ranges = rows.groupBy("difficulty_bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum(label).cast("long").alias("n_shared"),
        F.min("difficulty").alias("min_difficulty"), F.max("difficulty").alias("max_difficulty"))
    both = rows.select("difficulty_bin", label, F.explode(F.array(
        F.struct(F.lit("probe").alias("kind"), F.col(score).cast("double").alias("s")),
        F.struct(F.lit("baseline").alias("kind"), F.col("_base").alias("s")))).alias("e")).select(
        "difficulty_bin", label, "e.kind", "e.s")
    wide = auc(both, ["difficulty_bin", "kind"], "s", label).groupBy("difficulty_bin").agg(
        F.max(F.when(F.col("kind") == "probe", F.col("auc"))).alias("probe_auc"),
        F.max(F.when(F.col("kind") == "baseline", F.col("auc"))).alias("baseline_auc"))
    return ranges.join(wide, "difficulty_bin", "left")


def paired_comparison(bins: DataFrame) -> DataFrame:
    """One row: mean AUCs over usable bins, their difference and the paired t statistic."""
    gap = F.col("probe_auc") - F.col("baseline_auc")
    folded = bins.where(F.col("probe_auc").isNotNull() & F.col("baseline_auc").isNotNull()).agg(
        F.count(F.lit(1)).alias("usable_bins"), F.avg("probe_auc").alias("mean_probe_auc"),
        F.avg("baseline_auc").alias("mean_baseline_auc"), F.avg(gap).alias("_mean"), F.stddev_samp(gap).alias("_sd"))
    enough = F.col("usable_bins") >= 2
    sure = F.when(F.col("_mean") != 0, F.signum("_mean") * F.lit(float("inf")))
    t = F.when(F.col("_sd") == 0, sure).otherwise(F.col("_mean") / (F.col("_sd") / F.sqrt("usable_bins")))
    return folded.select(
        F.when(enough, "ok").otherwise("insufficient_bins").alias("status"), "usable_bins",
        *[F.when(enough, F.col(c)).alias(c) for c in ("mean_probe_auc", "mean_baseline_auc")],
        F.when(enough, F.col("mean_probe_auc") - F.col("mean_baseline_auc")).alias("delta_auc"),
        F.when(enough, t).alias("t_stat"))


def with_t_test(comparison: DataFrame, alpha: float = 0.05) -> DataFrame:
    from ..functions.pvalues import t_p_value
    tested = comparison.withColumn("p_val", t_p_value("t_stat", F.col("usable_bins") - 1))
    return tested.withColumn("significant", F.coalesce(F.col("p_val") < alpha, F.lit(False)))
