"""Bootstrap interval of an AUC by seeded multinomial resampling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .ranking import bucket_of, hash_row_number, score_counts, score_edges, wins_from_buckets

# Four small columns per row: at most about 40 MB travel to each executor.
BROADCAST_ROWS = 1 << 20
BLOCK = 1 << 20  # draws made at a time
MASK = (1 << 32) - 1
# Rounds of a 32-bit mixer (shift, then multiplier below 2^31, so that no product leaves 63 bits).
ROUNDS, LAST_SHIFT = ((16, 0x21F0AAAD), (15, 0x735A2D97)), 15
STEP = 0x9E3779B9


def _mixed(x):
    """Mixes numbers below 2^32, as a column or as unsigned 64-bit numbers of numpy."""
    if isinstance(x, Column):
        for shift, factor in ROUNDS:
            x = (x.bitwiseXOR(F.shiftright(x, shift)) * F.lit(factor)).bitwiseAND(F.lit(MASK))
        return x.bitwiseXOR(F.shiftright(x, LAST_SHIFT))
    for shift, factor in ROUNDS:
        x = ((x ^ (x >> np.uint64(shift))) * np.uint64(factor)) & np.uint64(MASK)
    return x ^ (x >> np.uint64(LAST_SHIFT))


def draw_rows(rep: np.ndarray, i: np.ndarray, n_rows: int, seed: int) -> np.ndarray:
    """Row numbers drawn: each depends on replicate, place and seed alone, so any task can make any of them."""
    mask, rep, i = np.uint64(MASK), rep.astype(np.uint64), i.astype(np.uint64)
    first = _mixed((rep + np.uint64(seed * 1_000_003 & MASK)) & mask)
    second = _mixed((first + rep + np.uint64(1)) & mask)
    low = _mixed(_mixed(((i & mask) + first) & mask) ^ ((second + (i >> np.uint64(32))) & mask))
    high = _mixed((low + np.uint64(STEP)) & mask) & np.uint64((1 << 30) - 1)
    return ((high << np.uint64(32) | low) % np.uint64(n_rows)).astype(np.int64)


def draws(spark, n_rows: int, replicates: int, seed: int = 0) -> DataFrame:
    """(rep, row_no): n_rows draws with replacement for every replicate, generated where they are used; as `draw_rows`."""
    def cut(x):
        return x.bitwiseAND(F.lit(MASK))
    out = spark.range(replicates * n_rows).select(F.expr(f"id div {n_rows}").alias("rep"), (F.col("id") % n_rows).alias("i"))
    # a column at a time: each number is used twice, and one expression of all would repeat what it is made of
    out = out.withColumn("first", _mixed(cut(F.col("rep") + F.lit(seed * 1_000_003 & MASK))))
    out = out.withColumn("second", _mixed(cut(F.col("first") + F.col("rep") + 1)))
    out = out.withColumn("low", _mixed(cut(cut(F.col("i")) + F.col("first"))))
    out = out.withColumn("low", _mixed(F.col("low").bitwiseXOR(cut(F.col("second") + F.shiftright("i", 32)))))
    out = out.withColumn("high", _mixed(cut(F.col("low") + F.lit(STEP))))
    high = F.shiftleft(F.col("high").bitwiseAND(F.lit((1 << 30) - 1)), 32)
    return out.select("rep", (high.bitwiseOR(F.col("low")) % n_rows).alias("row_no"))


def _replicates_in_tasks(numbered: DataFrame, n_rows: int, replicates: int, seed: int) -> DataFrame:
    spark = numbered.sparkSession
    base = numbered.select("row_no", "score", "label").toArrow()
    row, score, label = (base[c].to_numpy() for c in ("row_no", "score", "label"))
    usable = ~np.isnan(score)
    order = np.argsort(score[usable], kind="stable")
    row, score, label = row[usable][order], score[usable][order], label[usable][order] == 1
    starts = np.flatnonzero(np.concatenate([[True], score[1:] != score[:-1]])[:len(score)])
    shared = spark.sparkContext.broadcast((row, label, starts))

    def some(reps, row, label, starts):
        drawn = draw_rows(np.repeat(reps, n_rows), np.tile(np.arange(n_rows), len(reps)), n_rows, seed)
        drawn += np.repeat(np.arange(len(reps)), n_rows) * n_rows
        times = np.bincount(drawn, minlength=n_rows * len(reps)).reshape(len(reps), n_rows)[:, row]
        pos, neg = (np.add.reduceat(times * side, starts, axis=1).astype(float) for side in (label, ~label))
        both = pos.sum(axis=1) * neg.sum(axis=1)
        wins = (pos * (np.cumsum(neg, axis=1) - neg / 2)).sum(axis=1)
        drew_both = both > 0
        return pa.RecordBatch.from_arrays([pa.array(reps[drew_both]), pa.array(wins[drew_both] / both[drew_both])], ["rep", "auc"])

    def run(batches):
        row, label, starts = shared.value
        for batch in batches:
            reps = batch.column("id").to_numpy()
            step = max(1, BLOCK // max(1, n_rows))
            for at in range(0, len(reps) if len(starts) else 0, step):
                yield some(reps[at:at + step], row, label, starts)
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return spark.range(0, replicates, 1, parts).mapInArrow(run, "rep long, auc double")


def replicate_aucs(rows: DataFrame, keys: list[str], score: str, label: str, replicates: int = 10_000,
                   seed: int = 0) -> DataFrame:
    """(rep, auc) of every replicate that drew both classes.

    Up to `BROADCAST_ROWS` rows travel to the tasks, and each replicate is drawn and summed where it is made. Beyond,
    draws are looked up by row number and summed to counts per distinct score before anything is ordered. Both ways
    use the same draws.
    """
    one = cut_lineage(rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(
        *keys, F.col(score).cast("double").alias("score"), F.col(label).alias("label"), F.lit(0).alias("_all")))
    n_rows = one.count()
    if n_rows <= BROADCAST_ROWS:
        return _replicates_in_tasks(hash_row_number(one, keys, seed), n_rows, replicates, seed)
    edges = F.broadcast(score_edges(score_counts(one, ["_all"], "score", "label"), ["_all"]))  # one row
    numbered = hash_row_number(one, keys, seed).join(edges, "_all").select(
        "row_no", "score", "label", bucket_of(F.col("score"), F.col("_edges"), F.col("_coarse")).alias("_bucket"))
    # the size is known here; otherwise the planner might ship the draws instead
    numbered = numbered.hint("merge")
    # one shuffle by replicate, all equally large; every later step keeps this placement
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = draws(rows.sparkSession, n_rows, replicates, seed).join(numbered, "row_no").repartition(parts, "rep")
    counts = drawn.groupBy("rep", "_bucket", "score").agg(
        F.sum((F.col("label") == 1).cast("long")).alias("pos"), F.sum((F.col("label") != 1).cast("long")).alias("neg"))
    return wins_from_buckets(counts, ["rep"]).where((F.col("n_pos") > 0) & (F.col("n_neg") > 0)).select(
        "rep", (F.col("wins") / (F.col("n_pos").cast("double") * F.col("n_neg"))).alias("auc"))


def auc_interval(rows: DataFrame, keys: list[str], score: str, label: str, replicates: int = 10_000,
                 seed: int = 0) -> DataFrame:
    """One row: percentile interval (2.5, 97.5; linear) and the number of usable replicates."""
    aucs = replicate_aucs(rows, keys, score, label, replicates, seed)
    ends = F.percentile("auc", F.array(F.lit(0.025), F.lit(0.975)))
    return aucs.agg(ends.alias("_p"), F.count("auc").alias("n_replicates")).select(
        F.col("_p")[0].alias("ci_low"), F.col("_p")[1].alias("ci_high"), "n_replicates")
