"""Vector arithmetic on array columns (double precision)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    total = F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)
    same = F.assert_true(F.size(a) == F.size(b), F.lit("vectors differ in dimension"))
    return F.when(same.isNull(), total)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda acc, x: acc + x * x))


def normalize(v: Column) -> Column:
    """Unit vector; the zero vector stays as it is."""
    length = norm(v)
    return F.when(length == 0, as_double(v)).otherwise(F.transform(as_double(v), lambda x: x / length))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 when either vector is zero; differing dimensions raise."""
    size = norm(a) * norm(b)
    product = dot(a, b)
    return F.when(size == 0, F.when(product.isNotNull(), F.lit(0.0))).otherwise(product / size)


def euclidean(a: Column, b: Column) -> Column:
    squares = F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y))
    total = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))
    same = F.assert_true(F.size(a) == F.size(b), F.lit("vectors differ in dimension"))
    return F.when(same.isNull(), total)
