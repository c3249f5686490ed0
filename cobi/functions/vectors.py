"""Array-of-double helpers (FN9-FN15, MAT5) as higher-order built-in functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def log2(x: float) -> float:
    """FN9 on the driver (scalar parameters such as the embedding width)."""
    return math.log(x) / math.log(2.0)


def embedding_width(k: int) -> int:
    """MAT5: number of singular triplets requested, r = 1 + ceil(log2 k)."""
    if k < 1:
        raise ValueError("k must be >= 1")
    return 1 + int(math.ceil(log2(k)))


def scale(v: Column, s: Column) -> Column:
    """FN11: vector times scalar."""
    return F.transform(v, lambda x: x * s)


def hadamard(v: Column, w: Column) -> Column:
    """FN12: element-wise product of two equal-length vectors."""
    return F.zip_with(v, w, lambda a, b: a * b)


def const_vector(value: Column | float, n: int) -> Column:
    """FN13: a vector of ``n`` copies of ``value``."""
    if not isinstance(value, Column):
        value = F.lit(float(value))
    return F.array_repeat(value, n)


def prefix(v: Column, drop_last: int) -> Column:
    """FN14: the vector without its last ``drop_last`` entries."""
    return F.slice(v, 1, F.greatest(F.size(v) - drop_last, F.lit(0)))


def vector_sum(v: Column) -> Column:
    """FN15: sum of the entries."""
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)
