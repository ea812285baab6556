"""Vectors as arrays of doubles, kept as scalar columns wherever they are aggregated so that Spark combines them before a shuffle."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parts(v: Column, dims: int) -> list[Column]:
    return [v[i] for i in range(dims)]


def aggregate(how, v: Column, dims: int) -> Column:
    """Elementwise how (F.sum, F.max, ...) as one array column."""
    return F.array(*[how(x) for x in parts(v, dims)])


def zeros(dims: int) -> Column:
    return F.array(*[F.lit(0.0)] * dims)


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def times(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def scale(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)


def dot(a: Column, b: list[float]) -> Column:
    return reduce(add, [a[i] * F.lit(float(w)) for i, w in enumerate(b)])


def relu(a: Column) -> Column:
    return F.transform(a, lambda x: F.greatest(x, F.lit(0.0)))


def leaky_relu(x: Column, slope: float = 0.2) -> Column:
    return F.when(x > 0, x).otherwise(x * slope)


def linear(x: Column, w: list[list[float]], b: list[float] | None = None) -> Column:
    """x W + b, W given row by row; small W only, as it becomes part of the plan."""
    return F.array(*[dot(x, [row[k] for row in w]) + F.lit(float(b[k] if b else 0.0)) for k in range(len(w[0]))])


def long_form(df: DataFrame, keys: list[str], vec: str = "vec", digits: int = 6) -> DataFrame:
    """keys, dim, value with rounded values."""
    out = df.select(*keys, F.posexplode(vec).alias("dim", "value"))
    return out.select(*keys, F.col("dim").cast("bigint").alias("dim"), F.round("value", digits).alias("value"))


def sums(df: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    """keys, total, weighted: a row each instead of one a number; the weights 1, 2, ... tell orders apart."""
    add_ = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return df.select(*keys, F.round(add_(vec), 6).alias("total"), F.round(add_(F.transform(vec, lambda x, i: x * (i + 1))), 4).alias("weighted"))
