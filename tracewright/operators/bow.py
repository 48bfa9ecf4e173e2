"""Bag-of-words control: token counts, vocabulary and length-normalised log counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ranking import ordered_index


def token_counts(tokens: DataFrame) -> DataFrame:
    """(qid, token) -> count."""
    return tokens.groupBy("qid", "token").agg(F.count(F.lit(1)).alias("n"))


def explode_tokens(traces: DataFrame, column: str = "tokens") -> DataFrame:
    return traces.select("qid", F.explode(column).alias("token"))


def document_frequency(counts: DataFrame, min_df: int = 3) -> DataFrame:
    """Tokens of at least `min_df` questions; counts hold one row per question and token.

    Reading `n` keeps the input identical to its other uses, so its shuffle is done once.
    """
    return counts.groupBy("token").agg(F.count_if(F.col("n") > 0).alias("df")).where(F.col("df") >= min_df)


def vocabulary(counts: DataFrame, min_df: int = 3) -> DataFrame:
    """(token, df, idx) with the index in token order."""
    return ordered_index(document_frequency(counts, min_df), ["token"])


def log_counts(counts: DataFrame, kept: DataFrame) -> DataFrame:
    """(qid, token, weight): log(1 + n) of vocabulary tokens, scaled to unit length per question."""
    weighted = counts.join(kept, "token").withColumn("raw", F.log1p(F.col("n").cast("double")))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("qid")))
    extra = [c for c in ("idx",) if c in kept.columns]
    return weighted.withColumn("norm", norm).select(
        "qid", "token", *extra, F.coalesce(F.try_divide("raw", "norm"), F.lit(0.0)).alias("weight"))


def sparse_rows(questions: DataFrame, weights: DataFrame) -> DataFrame:
    """One sparse vector `vec` (struct of `idx` and `val`) per question; none of its tokens in the vocabulary: no entries."""
    own = weights.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("idx", "weight"))).alias("_e"))
    none: Column = F.array().cast("array<struct<idx:bigint,weight:double>>")
    joined = questions.join(own, "qid", "left").withColumn("_e", F.coalesce("_e", none))
    return joined.withColumn("vec", F.struct(F.col("_e.idx").alias("idx"), F.col("_e.weight").alias("val"))).drop("_e")
