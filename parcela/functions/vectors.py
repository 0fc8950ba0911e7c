"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def vector_literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def dot(a: Column | str, b: Column | str) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; null if a vector is all zeros."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def flat_vector(c: Column | str) -> Column:
    """A vector that arrived wrapped in a one-element list."""
    return F.flatten(c)
