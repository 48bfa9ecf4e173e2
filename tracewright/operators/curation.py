"""Question curation, key-list selection, work grids and sharding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import as_integer, non_empty
from .ranking import hash_row_number


def require_columns(df: DataFrame, needed: set[str]) -> list[str]:
    """Names that are missing from `df`, sorted."""
    return sorted(needed - set(df.columns))


def curate_raw_questions(raw: DataFrame, limit: int | None = None, prefix: str = "aime_") -> DataFrame:
    """Questions with an integer answer. The limit is taken before the answer filter, in id order."""
    missing = require_columns(raw, {"id", "problem", "answer"})
    if missing:
        raise ValueError(f"columns missing: {missing}")
    if limit is not None:
        raw = raw.orderBy("id").limit(limit)
    answer = F.trim(F.col("answer").cast("string"))
    return raw.where(as_integer(answer).isNotNull()).select(
        F.concat(F.lit(prefix), F.col("id").cast("string")).alias("qid"),
        F.col("problem").alias("query"), answer.alias("ground_truth"))


def as_score(score: Column) -> Column:
    """A stored score as a number: numbers, numbers as text, and truth values count; anything else is NULL."""
    text = F.lower(F.trim(score.cast("string")))
    return F.when(text == "true", 1.0).when(text == "false", 0.0).otherwise(text.try_cast("double"))


def _pool_fields(records: DataFrame) -> DataFrame:
    return records.select(
        "model", F.col("index").alias("qid"),
        F.coalesce(non_empty(F.col("prompt")), F.col("origin_query")).alias("query"),
        "ground_truth", as_score(F.col("score")).alias("score"))


def pool_records(records: DataFrame) -> DataFrame:
    """Usable benchmark records with the prompt fallback and a 0/1 score."""
    usable = F.col("qid").isNotNull() & F.col("query").isNotNull() & F.col("score").isNotNull()
    return _pool_fields(records).where(usable).select(
        "model", "qid", "query", "ground_truth", (F.col("score") > 0.5).cast("int").alias("correct"))


def unusable_records(records: DataFrame) -> DataFrame:
    """Per model: all records, and those left out for want of a key, a question or a score."""
    lost = [F.count_if(F.col(c).isNull()).alias(f"no_{c}") for c in ("qid", "query", "score")]
    return _pool_fields(records).groupBy("model").agg(F.count(F.lit(1)).alias("n"), *lost)


def pool_questions(records: DataFrame) -> DataFrame:
    """One row per question: the text the alphabetically first model saw."""
    pick = F.min_by(F.struct("query", "ground_truth"), F.struct("model", "query"))
    return records.groupBy("qid").agg(pick.alias("q")).select("qid", "q.query", "q.ground_truth")


def first_keys(df: DataFrame, n: int, key: str = "qid") -> DataFrame:
    """The first n distinct keys in sorted order."""
    return df.select(key).distinct().orderBy(key).limit(n)


def keep_keys(df: DataFrame, keys: DataFrame, on: str | list[str] = "qid") -> DataFrame:
    return df.join(keys, on, "left_semi")


def skip_keys(df: DataFrame, done: DataFrame, on: str | list[str] = "qid") -> DataFrame:
    return df.join(done, on, "left_anti")


def work_grid(questions: DataFrame, n_samples: int) -> DataFrame:
    """Every question with every sample number."""
    return questions.withColumn(
        "sample_idx", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1)))) if n_samples > 0 else \
        questions.withColumn("sample_idx", F.lit(0)).limit(0)


def pending_work(questions: DataFrame, n_samples: int, done: DataFrame,
                 keys: tuple[str, ...] = ("qid", "sample_idx")) -> DataFrame:
    return skip_keys(work_grid(questions, n_samples), done.select(*keys), list(keys))


def number_rows(df: DataFrame, keys: list[str], seed: int = 0) -> DataFrame:
    """Dense 0-based `row_no` in a fixed pseudo-random order of the (unique) keys."""
    return hash_row_number(df, keys, seed, out="row_no")


def shard(df: DataFrame, keys: list[str], n_shards: int, index: int | None = None) -> DataFrame:
    """Split rows into n shards whose sizes differ by at most one; optionally keep a single shard."""
    if n_shards < 1 or (index is not None and not 0 <= index < n_shards):
        raise ValueError(f"shard index must lie in 0..{n_shards - 1}")
    numbered = number_rows(df, keys).withColumn("shard", (F.col("row_no") % n_shards).cast("int")) \
        .drop("row_no", "row_total")
    return numbered if index is None else numbered.where(F.col("shard") == index).drop("shard")


def select_work(questions: DataFrame, wanted: DataFrame | None = None, n_shards: int = 1, index: int = 0,
                limit: int | None = None, done: DataFrame | None = None) -> DataFrame:
    """Key list, then shard, then limit, and only then drop what is already done."""
    out = questions if wanted is None else keep_keys(questions, wanted)
    if n_shards > 1:
        out = shard(out, ["qid"], n_shards, index)
    if limit is not None:
        out = out.orderBy("qid").limit(limit)
    return out if done is None else skip_keys(out, done)


def run_counters(attempts: DataFrame, done: DataFrame | None = None, keys: tuple[str, ...] = ("qid", "sample_idx")) -> DataFrame:
    """Succeeded, failed, truncated and processed attempts of a collection run, and those skipped as done before."""
    ok = F.col("error").isNull()
    skipped = F.lit(0).cast("long")
    if done is not None:
        skipped = attempts.join(done.select(*keys), list(keys), "left_semi").agg(F.count(F.lit(1)).alias("n")).scalar()
        attempts = skip_keys(attempts, done.select(*keys), list(keys))
    return attempts.agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if(ok).alias("succeeded"),
        F.count_if(~ok).alias("failed"),
        F.count_if(ok & (F.col("finish_reason") == "length")).alias("truncated")).withColumn("skipped", skipped)
