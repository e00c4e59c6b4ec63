"""Vector expressions on ARRAY<FLOAT> columns, accumulated in double."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ZERO = 0.0


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(ZERO), lambda total, x: total + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_distance(a: Column, b: Column) -> Column:
    def gap(x, y):
        d = x.cast("double") - y.cast("double")
        return d * d

    return _total(F.zip_with(a, b, gap))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column) -> Column:
    length = norm(a)
    return F.transform(a, lambda x: x.cast("double") / length)
