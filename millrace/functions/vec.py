"""Vectors of three doubles as structs x, y, z."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vec(x: Column | float, y: Column | float, z: Column | float) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(float(v))).cast("double").alias(n) for n, v in (("x", x), ("y", y), ("z", z))])


def _each(f):
    return lambda a, b: vec(*(f(a[n], b[n]) for n in "xyz"))


plus = _each(lambda a, b: a + b)
minus = _each(lambda a, b: a - b)
times = _each(lambda a, b: a * b)


def scaled(a: Column, k: Column | float) -> Column:
    return vec(*(a[n] * k for n in "xyz"))


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return vec(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def normalised(a: Column) -> Column:
    """a by its length; the zero vector gives NaN."""
    size = F.sqrt(dot(a, a))
    nan = F.lit(float("nan"))
    return vec(*(F.when(size == 0, nan).otherwise(a[n] / F.nullif(size, F.lit(0.0))) for n in "xyz"))


def smaller(a: Column, b: Column) -> Column:
    """a if it is below b, else b; with NaN in either, b."""
    return F.when(F.isnan(a) | F.isnan(b), b).when(a < b, a).otherwise(b)


def larger(a: Column, b: Column) -> Column:
    return F.when(F.isnan(a) | F.isnan(b), b).when(a > b, a).otherwise(b)


def clamped(v: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(v, F.lit(high)))
