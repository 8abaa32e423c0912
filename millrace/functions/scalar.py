"""Scalar functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def itoa(v: Column) -> Column:
    return v.cast("string")


def atoi(s: Column) -> Column:
    """A decimal number with an optional sign, as a long; what isn't one is 0, what is too large the largest or smallest."""
    edge = F.when(s.startswith("-"), F.lit(-(2**63))).otherwise(F.lit(2**63 - 1))
    return F.when(s.rlike(r"\A[+-]?[0-9]+\z"), F.coalesce(s.try_cast("long"), edge)).otherwise(F.lit(0)).cast("long")


def square(v: Column) -> Column:
    return v * v


def truncate(v: Column) -> Column:
    """Toward zero."""
    return v.cast("long")


def tone_mapped(total: Column, samples: Column | int) -> Column:
    """The mean over the configured samples plus 14/241, compressed by c / (c + 1), times 255."""
    mean = total / samples + 14 / 241
    return mean / (mean + 1) * 255


def toi(letter: Column) -> Column:
    """A coordinate from the code of its letter: 79 is the middle, two codes a unit, cut towards zero."""
    return ((F.ascii(letter) - 79) / 2).cast("int")
