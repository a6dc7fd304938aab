"""Vector arithmetic as column expressions: no Python in the hot path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector_literal(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in values)) if len(values) else F.array().cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, added up in order; null if the lengths differ.

    On unit vectors this is the cosine similarity.
    """
    a, b = a.cast("array<double>"), b.cast("array<double>")
    folded = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), folded)


def euclidean(a: Column, b: Column) -> Column:
    """Euclidean distance; null if the lengths differ."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    folded = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), F.sqrt(folded))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v: Column) -> Column:
    """The vector over its norm; a zero vector stays as it is."""
    d = v.cast("array<double>")
    return F.when(norm(v) > 0, F.transform(d, lambda x: x / norm(v))).otherwise(d)


def is_zero(v: Column) -> Column:
    """Null, or every component 0: what stands for an image that couldn't be decoded."""
    return v.isNull() | F.coalesce(F.forall(v, lambda x: x == 0), F.lit(False))


def arg_max(v: Column) -> Column:
    """Zero-based position of the first largest component."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def best_label(v: Column, labels: Sequence[str]) -> Column:
    """Label of the first largest component; beyond the labels it is Unknown."""
    names = F.array(*(F.lit(x) for x in labels))
    return F.when(arg_max(v) < len(labels), F.get(names, arg_max(v))).otherwise(F.when(v.isNotNull(), F.lit("Unknown")))


def softmax(v: Column) -> Column:
    d = v.cast("array<double>")
    powers = F.transform(d, lambda x: F.exp(x - F.array_max(d)))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda s, y: s + y))
