"""Answer extraction and scoring as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .vectors import let

# The answer formats a scorer must recognise.
# A standalone choice letter A-J without I (which is also the English pronoun). The classes are spelled
# out because engines disagree on whether \b treats accented letters as word characters.
CHOICE_LETTER = r"(?<![\p{L}\p{N}_])([A-HJ])(?![\p{L}\p{N}_])"
BOXED = r"\\boxed\{(-?\d+)\}"
STATED = r"(?i)(?:answer is|answer:|final answer:?)\s*\$?(-?\d+)\$?"
INTEGER = r"(-?\d+)"


def _first(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def choice_letter(text: Column) -> Column:
    """First standalone choice letter, NULL when there is none."""
    return _first(text, CHOICE_LETTER)


def numeric_answer(text: Column) -> Column:
    """Boxed integer, else the stated answer, else the last integer of the text."""
    last = F.try_element_at(F.regexp_extract_all(text, F.lit(INTEGER), 1), F.lit(-1))
    return F.coalesce(_first(text, BOXED), _first(text, STATED), last)


def as_integer(text: Column) -> Column:
    """Exact integer value, NULL for anything else (also 1.5 and 1e3, which a plain cast accepts)."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(r"^[+-]?\d+$"), trimmed.try_cast("decimal(38,0)"))


def score_numeric(text: Column, truth: Column) -> Column:
    return F.coalesce((as_integer(numeric_answer(text)) == as_integer(truth)).cast("int"), F.lit(0))


def score_letter(text: Column, truth: Column) -> Column:
    wanted = F.nullif(F.substring(F.upper(F.trim(truth)), 1, 1), F.lit(""))
    return F.coalesce((choice_letter(text) == wanted).cast("int"), F.lit(0))


def extracted(text: Column, truth: Column, answer_type: str = "letter") -> Column:
    """Struct of the answer and its score; the text is searched once."""
    if answer_type not in ("numeric", "letter"):
        raise ValueError(f"unknown answer type {answer_type!r}")
    numeric = answer_type == "numeric"

    def pair(answer: Column) -> Column:
        if numeric:
            same = as_integer(answer) == as_integer(truth)
        else:
            same = answer == F.nullif(F.substring(F.upper(F.trim(truth)), 1, 1), F.lit(""))
        return F.struct(answer.alias("answer"), F.coalesce(same.cast("int"), F.lit(0)).alias("correct"))
    return let(numeric_answer(text) if numeric else choice_letter(text), pair)


def score_answer(text: Column, truth: Column, answer_type: str = "letter") -> Column:
    if answer_type == "numeric":
        return score_numeric(text, truth)
    if answer_type == "letter":
        return score_letter(text, truth)
    raise ValueError(f"unknown answer type {answer_type!r}")


def non_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def truncated(n_new_tokens: Column, max_new_tokens: Column) -> Column:
    return n_new_tokens >= max_new_tokens
