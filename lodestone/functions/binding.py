"""Evaluate a sub-expression once and use it many times in one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(body: Callable[[Column], Column], **values: Column) -> Column:
    """``body`` of a struct that holds each value, computed once per row.

    A column used inside a higher-order function is otherwise evaluated again
    for every element, which turns a linear pass into a quadratic one.
    """
    bound = F.array(F.struct(*[value.alias(name) for name, value in values.items()]))
    return F.get(F.transform(bound, body), F.lit(0))
