"""Digits and positions by decimal place, least significant first.

All functions take and return Columns and stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDEST = "decimal(38,0)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once a row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def as_digits(n: Column) -> Column:
    """An integer or a run of ASCII digits as digits without leading zeros; null for anything else."""
    s = F.regexp_replace(n.cast("string"), "^0+(?=.)", "")
    return F.when(s.rlike("^[0-9]+$"), s)


def natural_digits(n: Column) -> Column:
    """The decimal digits of a non-negative integer, as many as it has."""
    return F.transform(F.split(F.reverse(as_digits(n)), ""), lambda c: c.cast("bigint"))


def padded(digits: Column, width: int) -> Column:
    """digits with zeros up to `width` places."""
    return F.concat(digits, F.array_repeat(F.lit(0).cast("bigint"), F.greatest(F.lit(width) - F.size(digits), F.lit(0))))


def digits_lsd(n: Column, width: int) -> Column:
    """`width` digits of a non-negative integer; null where it has more or is negative."""
    return let(natural_digits(n), lambda own: F.when(F.size(own) <= width, padded(own, width)))


def lanes_lsd(start: Column, length: Column, dmax: int) -> Column:
    """Positions of a run, the units' first, then -1 up to `dmax` lanes; null where the run is longer."""
    lane = lambda k: F.when(k < length, start + length - 1 - k).otherwise(F.lit(-1)).cast("int")
    return F.when(length <= dmax, F.transform(F.sequence(F.lit(0), F.lit(dmax - 1)), lane))


def decode_places(digits: Column) -> Column:
    """The number that digits stand for, as digits without leading zeros."""
    return F.regexp_replace(F.array_join(F.reverse(digits), ""), "^0+(?=.)", "")


def hard_digits(distributions: Column) -> Column:
    """The digit each distribution peaks at; the first of several."""
    return F.transform(distributions, lambda d: (F.array_position(d, F.array_max(d)) - 1).cast("bigint"))
