import json

import pytest
from pyspark.sql import functions as F

from tracewright.functions import text as X
from tracewright.sources import responses as R


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values[n] for n in names)], ", ".join(f"{n} string" for n in names))
    return df.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text,want", [
    ("The answer is B.", "B"), ("I'm not sure.", None), ("I think A or I", "A"), ("ÀB is no choice", None),
    ("x_A A_x (C)", "C"), ("", None), (None, None), ("K L", None), ("I I J", "J")])
def test_choice_letter(spark, text, want):
    assert one(spark, X.choice_letter(F.col("t")), t=text) == want


@pytest.mark.parametrize("text,want", [
    (r"blah blah \boxed{116} done", "116"), ("So the answer is 42.", "42"),
    ("We had 3 cases, then 7, so total 10", "10"), ("no digits", None), (None, None),
    ("FINAL ANSWER: $-5$ and 9", "-5"), ("Answer: 7, not 8", "7"), (r"99 then \boxed{150}", "150"),
    (r"\boxed{1} \boxed{2}", "1"), (r"\boxed{x} 4", "4"), ("final answer 12 then 3", "12")])
def test_numeric_answer(spark, text, want):
    assert one(spark, X.numeric_answer(F.col("t")), t=text) == want


@pytest.mark.parametrize("text,truth,want", [
    (r"\boxed{756}", "756", 1), (r"\boxed{756}", "757", 0), ("no number at all", "150", 0),
    (r"99 then \boxed{150}", "150", 1), (None, "5", 0), ("5", None, 0), ("answer is 007", " 7 ", 1), ("5", "5.0", 0),
    ("answer is 123456789012345678901234567890", "123456789012345678901234567890", 1), ("5", "five", 0)])
def test_numeric_score(spark, text, truth, want):
    assert one(spark, X.score_answer(F.col("t"), F.col("g"), "numeric"), t=text, g=truth) == want


@pytest.mark.parametrize("text,truth,want", [
    ("The answer is C", "C", 1), ("The answer is C", "d", 0), ("no letter here", "A", 0), ("(B)", " b) because", 1),
    (None, "A", 0), ("A", None, 0), ("A", "", 0)])
def test_letter_score(spark, text, truth, want):
    assert one(spark, X.score_answer(F.col("t"), F.col("g")), t=text, g=truth) == want


def test_unknown_answer_type():
    with pytest.raises(ValueError):
        X.score_answer(None, None, "essay")


def test_responses(spark):
    def body(finish="stop", **message):
        return json.dumps({"choices": [{"message": message, "finish_reason": finish}]})
    rows = [
        ("content", 200, body(content="A")), ("reason", 200, body("length", content=None, reasoning_content="B")),
        ("third", 200, body(content="", reasoning="C")), ("nothing", 200, body(content=None)),
        ("no_choices", 200, json.dumps({"choices": []})), ("busy", 429, None), ("gone", 404, None), ("broken", 503, "x")]
    parsed = {r["qid"]: r for r in R.parse_responses(
        spark.createDataFrame(rows, "qid string, status int, body string")).collect()}
    assert (parsed["content"]["raw_generation"], parsed["content"]["error"]) == ("A", None)
    assert (parsed["reason"]["raw_generation"], parsed["reason"]["finish_reason"]) == ("B", "length")
    assert parsed["third"]["raw_generation"] == "C"
    assert parsed["nothing"]["error"] == "response without text" and parsed["nothing"]["finish_reason"] is None
    assert parsed["no_choices"]["error"] == "response without choices"
    assert [parsed[k]["status_class"] for k in ("content", "busy", "gone", "broken")] == ["ok", "retryable", "fatal", "retryable"]
    assert parsed["busy"]["error"] == "HTTP 429"
