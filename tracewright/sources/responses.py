"""Stored chat-completion responses: text choice, status classes and the split into results and errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import non_empty, score_answer
from ..schemas import API_RESPONSE

# Status codes worth another attempt.
RETRYABLE = [429, 500, 502, 503, 504]


def status_class(status: Column) -> Column:
    return F.when(status == 200, "ok").when(status.isin(RETRYABLE), "retryable").otherwise("fatal")


def parse_responses(responses: DataFrame, body: str = "body", status: str = "status") -> DataFrame:
    """Adds raw_generation, finish_reason and error. Reasoning fields stand in for empty content."""
    first = F.try_element_at(F.from_json(F.col(body), API_RESPONSE)["choices"], F.lit(1))
    rows = responses.withColumn("_choice", first).withColumn("status_class", status_class(F.col(status)))
    message = F.col("_choice.message")
    text = F.coalesce(non_empty(message["content"]), non_empty(message["reasoning_content"]),
                      non_empty(message["reasoning"]))
    ok = F.col("status_class") == "ok"
    error = (F.when(~ok, F.concat(F.lit("HTTP "), F.col(status).cast("string")))
             .when(F.col("_choice").isNull(), F.lit("response without choices"))
             .when(text.isNull(), F.lit("response without text")))
    return rows.select(
        *responses.columns, "status_class", F.when(ok, text).alias("raw_generation"),
        F.when(ok & text.isNotNull(), F.col("_choice.finish_reason")).alias("finish_reason"), error.alias("error"))


def score_responses(parsed: DataFrame, questions: DataFrame, answer_type: str = "letter") -> DataFrame:
    """Correctness of each usable response; failed ones keep their error and a NULL score."""
    joined = parsed.join(questions.select("qid", "ground_truth"), "qid", "left")
    scored = score_answer(F.col("raw_generation"), F.col("ground_truth"), answer_type)
    return joined.withColumn("correct", F.when(F.col("error").isNull(), scored))


def split_errors(attempts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results, errors): two narrow tables of one attempt table."""
    failed = F.col("error").isNotNull()
    results = attempts.where(~failed).select(
        "qid", "sample_idx", "model", "correct", "raw_generation", "finish_reason")
    return results, attempts.where(failed).select("qid", "sample_idx", "error")
