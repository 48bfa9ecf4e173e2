"""Arithmetic on array<double> columns. Everything stays inside the JVM."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and hand it to `use`.

    A column that is read inside a lambda is otherwise recomputed for every element once the optimizer has
    merged the projections.
    """
    return F.transform(F.array(value), use)[0]


def doubles(vec: Column) -> Column:
    return vec.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance by direct difference (no cancellation as in the Gram form)."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0),
                              lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """NULL when either vector has zero length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def literal_vector(values: Sequence[float]) -> Column:
    """A constant vector; one folded literal instead of one expression node per element."""
    return F.from_json(F.lit(json.dumps([float(v) for v in values])), "array<double>")


def literal_matrix(rows: Sequence[Sequence[float]]) -> Column:
    text = json.dumps([[float(v) for v in row] for row in rows])
    return F.from_json(F.lit(text), "array<array<double>>")


def project(vec: Column, mean: Sequence[float], components: Sequence[Sequence[float]]) -> Column:
    """Scores (vec - mean) . component for each component."""
    return let(subtract(vec, literal_vector(mean)),
               lambda centred: F.transform(literal_matrix(components), lambda c: dot(centred, c)))


def unit(vec: Column) -> Column:
    """Vector of length one; a zero vector stays zero."""
    return let(norm(vec), lambda n: F.transform(vec, lambda x: F.coalesce(F.try_divide(x, n), F.lit(0.0))))


def element(values: Column, index: Column) -> Column:
    """Python-style access: 0-based, negative counts from the end, NULL outside."""
    return F.try_element_at(values, F.when(index < 0, index).otherwise(index + 1).cast("int"))


def entropy_of_logits(logits: Column) -> Column:
    """Shannon entropy (nats) of softmax(logits), shifted by the maximum so that nothing overflows."""
    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)

    # ln(sum e) - sum(e * (l - top)) / sum(e) with e = exp(l - top)
    return let(F.array_max(logits), lambda top: let(
        F.transform(logits, lambda x: F.exp(x - top)), lambda e: let(
            total(e), lambda z: F.ln(z) - total(F.zip_with(e, logits, lambda p, x: p * (x - top))) / z)))


def logit_gap(logits: Column, answer_token: Column) -> Column:
    """Distance of the answer token's logit to the top logit."""
    return F.array_max(logits) - element(logits, answer_token)
