"""Similarity of two array columns, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(vector) -> Column:
    return F.col(vector) if isinstance(vector, str) else vector


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def _paired(a, b, combine) -> Column:
    """Sum of ``combine`` over the positions of ``a``.

    Further positions of ``b`` are ignored; a ``b`` shorter than ``a`` raises.
    Two empty vectors give 0.0.
    """
    a, b = _column(a), _column(b)
    aligned = F.when(F.size(a) == F.size(b), b).otherwise(F.slice(b, F.lit(1), F.size(a)))
    short = F.raise_error(F.lit("second vector is shorter than the first")).cast("double")
    products = F.zip_with(a, aligned, lambda x, y: combine(x.cast("double"), y.cast("double")))
    return F.when(F.size(b) < F.size(a), short).otherwise(_total(products))


def dot(a, b) -> Column:
    return _paired(a, b, lambda x, y: x * y)


def norm(a) -> Column:
    return F.sqrt(_total(F.transform(_column(a), lambda x: x.cast("double") * x.cast("double"))))


def cosine(a, b) -> Column:
    """Cosine similarity; NULL when a vector has length zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def l2(a, b) -> Column:
    return F.sqrt(_paired(a, b, lambda x, y: (x - y) * (x - y)))
