"""Train/test and fold assignment that never separates what must stay together."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .ranking import hash_row_number


def group_split(rows: DataFrame, group: str = "qid", fraction: float = 0.2, seed: int = 42,
                row_keys: list[str] | None = None) -> DataFrame:
    """Adds `is_test`: all rows of a group on one side, ceil(fraction * groups) groups in the test part.

    With a single group the rows themselves are split, which needs their unique keys.
    """
    groups = rows.select(group).distinct()
    single = groups.limit(2).count() == 1
    if single and not row_keys:
        raise ValueError("only one group: row_keys are needed to split its rows")
    keys = row_keys if single else [group]
    numbered = hash_row_number(rows.select(*keys) if single else groups, keys, seed)
    cut = F.ceil(F.col("row_total") * F.lit(float(fraction)))
    sides = numbered.select(*keys, (F.col("row_no") < cut).alias("is_test"))
    return rows.join(sides, keys)


def stratified_folds(rows: DataFrame, keys: list[str], label: str = "label", folds: int = 5,
                     seed: int = 3407) -> DataFrame:
    """(keys, label, fold, n_folds): every class is dealt evenly over min(folds, smallest class) folds."""
    slim = rows.select(*keys, label)
    smallest = slim.groupBy(label).count().agg(F.min("count").alias("smallest")).scalar()
    numbered = hash_row_number(slim, keys, seed, within=[label])
    numbered = numbered.withColumn("n_folds", F.least(F.lit(folds), smallest).cast("int"))
    return numbered.select(*keys, label, (F.col("row_no") % F.col("n_folds")).cast("int").alias("fold"), "n_folds")
