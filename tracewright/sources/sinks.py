"""Append-only result tables, the error side-car and result documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def append_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Add files to a parquet table; what is there is neither read nor rewritten."""
    df.write.mode("append").partitionBy(*(partition_by or [])).parquet(path)


def write_states(states: DataFrame, path: str, source: str) -> None:
    """The canonical vector table; a source and layer filter later prunes whole folders.

    Prompt and generation states (`source` "prefill" and "decode") follow different distributions and stay apart.
    """
    states.withColumn("source", F.lit(source)).write.mode("append").partitionBy("source", "layer").parquet(path)


def append_errors(errors: DataFrame, out_path: str) -> str:
    side_car = out_path.rstrip("/") + ".errors.jsonl"
    errors.write.mode("append").json(side_car)
    return side_car


def write_questions(questions: DataFrame, path: str) -> None:
    """JSON lines, non-ASCII text as it is."""
    questions.write.mode("overwrite").json(path)


def result_document(result: DataFrame, kind: str, exclude: list[str] | None = None) -> DataFrame:
    """Result rows as JSON documents of one kind, without the excluded columns."""
    keep = [c for c in result.columns if c not in set(exclude or [])]
    return result.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*keep)).alias("document"))


def write_result(result: DataFrame, path: str, exclude: list[str] | None = None) -> None:
    result.drop(*(exclude or [])).write.mode("overwrite").json(path)
