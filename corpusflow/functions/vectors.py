"""Vector expressions over arrays; computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow.functions.text import let

EPSILON = 1e-9


def rounded(x: Column, digits: int) -> Column:
    """``x`` rounded in binary, halves away from zero, as DuckDB does; what rounds to zero keeps its sign."""
    scale = 10.0**digits
    size = F.abs(x * scale)
    down = F.rint(size)
    near = F.signum(x) * F.when(size - down == 0.5, down + 1).otherwise(down) / scale
    return F.when(F.abs(near) < float("inf"), near).otherwise(x)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(doubles(a), doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalise(v: Column) -> Column:
    """v / (|v| + 1e-9)."""
    return let(l2_norm(v), lambda norm: F.transform(doubles(v), lambda x: x / (norm + EPSILON)))


def mean_pool(vectors: Column) -> Column:
    """The mean of an array of vectors of equal length; empty for none."""
    total = F.aggregate(F.slice(vectors, 2, F.greatest(F.size(vectors) - 1, F.lit(0))), doubles(F.element_at(vectors, 1)), lambda s, v: F.zip_with(s, doubles(v), lambda x, y: x + y))
    return F.when(F.size(vectors) > 0, F.transform(total, lambda x: x / F.size(vectors))).otherwise(F.array().cast("array<double>"))


def max_sim(query: Column, document: Column) -> Column:
    """Late interaction: for every query vector the best dot product with a document vector, summed."""
    best = F.transform(query, lambda q: F.array_max(F.transform(document, lambda d: dot(q, d))))
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + x)
