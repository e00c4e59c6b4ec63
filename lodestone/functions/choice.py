"""Seeded, reproducible choices and orders computed from a row's own key."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(str(value))


def digest(*parts) -> Column:
    """md5 over the parts joined by a colon (hex string)."""
    return F.md5(F.concat_ws(":", *[_as_column(p).cast("string") for p in parts]))


def leading_bits(hex_digest: Column, digits: int) -> Column:
    """The first hex digits of a digest as a number: an order-keeping bucket."""
    return F.conv(F.substring(hex_digest, 1, digits), 16, 10).cast("bigint")


def pick_index(seed, key: Column, n: int) -> Column:
    """A uniform number in [0, n) that depends on seed and key only."""
    return F.pmod(leading_bits(digest(seed, key), 8), F.lit(n)).cast("int")


def pick(options: list[str], seed, key: Column) -> Column:
    """One of ``options`` chosen by seed and key."""
    if len(options) == 1:
        return F.lit(options[0])
    literals = F.array(*[F.lit(option) for option in options])
    return F.element_at(literals, pick_index(seed, key, len(options)) + 1)


def fill(template: Column, **values: Column) -> Column:
    """Replace ``{name}`` by a value for every name given, in that order."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template
