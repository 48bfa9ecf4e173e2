"""Bindings of the engine's input tables to the driver's parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.vectors import doubles

N_LAYERS, WIDTH = 8, 8
S_THRESHOLD = 34.59


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _layers() -> Column:
    cuts = [F.slice("embedding", WIDTH * l + 1, WIDTH) for l in range(N_LAYERS)]
    return F.array(*cuts)


def w_single(spark, sf_dir) -> DataFrame:
    """Weak-model traces with one stored position: five samples per question, 8 layers of width 8."""
    return table(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 5").alias("qid"), (F.col("vec_id") % 5).cast("int").alias("sample_idx"),
        (F.col("label") >= 7).cast("int").alias("correct"), _layers().alias("hidden_all_layers"))


def w_decode(spark, sf_dir) -> DataFrame:
    """One row per generation trace of at most 20 captured steps (scalars only)."""
    return table(spark, sf_dir, "embeddings").groupBy(F.expr("vec_id div 20").alias("qid")).agg(
        F.max(F.when(F.col("vec_id") % 20 == 0, (F.col("label") >= 7).cast("int"))).alias("correct"),
        F.count(F.lit(1)).cast("int").alias("n_steps"),
    ).select("qid", F.lit(0).alias("sample_idx"), "correct", "n_steps", F.lit(61).alias("n_new_tokens"))


def decode_steps(spark, sf_dir, only_wrong: bool = False) -> DataFrame:
    """Captured steps with all layers of a step in one row, and the outcome of their trace."""
    steps = table(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 20").alias("qid"), F.lit(0).alias("sample_idx"),
        (F.col("vec_id") % 20).cast("int").alias("pos"), F.col("embedding"), _layers().alias("layers"))
    traces = w_decode(spark, sf_dir).select("qid", "n_steps", "n_new_tokens", "correct")
    if only_wrong:
        traces = traces.where("correct = 0")
    return steps.join(traces, "qid").withColumn("step_index", F.col("pos") * 3)


def decode_states(spark, sf_dir, only_wrong: bool = False) -> DataFrame:
    return decode_steps(spark, sf_dir, only_wrong).select(
        "qid", "sample_idx", "pos", "step_index", "n_steps", "n_new_tokens",
        F.posexplode("layers").alias("layer", "raw")).select(
        "qid", "sample_idx", "layer", "pos", "step_index", "n_steps", "n_new_tokens", doubles(F.col("raw")).alias("vec"))


def decode_tokens(spark, sf_dir) -> DataFrame:
    """Generated token ids of each trace: vector entries on a grid of eighths."""
    return table(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 20").alias("qid"),
        F.explode("embedding").alias("x")).select("qid", F.floor(F.col("x").cast("double") * 64).cast("int").alias("token"))


def s_samples(spark, sf_dir, modulus: int = 100) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % modulus).alias("qid"), "event_id", F.col("event_type").alias("model"),
        (F.col("value") > S_THRESHOLD).cast("int").alias("correct"))


def questions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("item_"), F.col("item_id").cast("string")).alias("qid"), F.col("text").alias("query"),
        ((F.col("item_id") * 7) % 1000).cast("string").alias("ground_truth"))


def responses(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("qid"), F.col("text").alias("raw_generation"),
        (F.col("doc_id") % 10).cast("string").alias("truth_number"),
        F.substring(F.lit("ABCDEFGHJ"), (F.col("doc_id") % 9 + 1).cast("int"), F.lit(1)).alias("truth_letter"),
        F.when(F.col("n_chars") > 4000, "length").otherwise("stop").alias("finish_reason"),
        F.col("n_chars"), F.col("lang").alias("model"))


def token_traces(spark, sf_dir) -> DataFrame:
    """Labelled documents as token lists."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("qid"), F.split(F.lower("text"), " ").alias("tokens"))
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("qid"), (1 - F.col("quality")).alias("label"))
    return docs.join(labels, "qid")


def api_responses(spark, sf_dir, turns: DataFrame | None = None) -> DataFrame:
    """Chat turns as stored completion responses."""
    turns = table(spark, sf_dir, "conversations") if turns is None else turns
    message = F.struct(
        F.when(F.col("role") == "assistant", F.col("text")).alias("content"),
        F.when(F.col("role") == "user", F.col("text")).alias("reasoning_content"),
        F.lit(None).cast("string").alias("reasoning"))
    choice = F.struct(message.alias("message"), F.when(F.length("text") > 500, "length").otherwise("stop")
                      .alias("finish_reason"))
    return turns.select(
        F.col("conv_id").alias("qid"), F.col("turn").cast("int").alias("sample_idx"), F.lit("chat").alias("model"),
        F.element_at(F.array(*[F.lit(s) for s in (200, 429, 503, 401)]), (F.col("turn") % 4 + 1).cast("int"))
        .alias("status"),
        F.to_json(F.struct(F.array(choice).alias("choices"))).alias("body"))


def logits(spark, sf_dir) -> DataFrame:
    """Per-step logits: the raw vector of a step over a vocabulary of 64 entries."""
    return decode_steps(spark, sf_dir).select(
        "qid", "sample_idx", F.col("pos").alias("step"), "n_steps", "correct", doubles(F.col("embedding")).alias("logits"),
        (F.col("qid") % 64).cast("int").alias("answer_token_id"))
