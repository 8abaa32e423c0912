"""Grouping and combining. A combiner is its accumulators, as aggregates that Spark splits into partial and final ones, and what is extracted from them."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalar import tone_mapped


@dataclass(frozen=True)
class Combiner:
    accumulate: Mapping[str, Column]
    extract: Mapping[str, Column]


def combine_per_key(df: DataFrame, keys: list[str], combiner: Combiner) -> DataFrame:
    """Partial sums before the shuffle, final ones after it, then the extraction as a projection."""
    acc = df.groupBy(*keys).agg(*[c.alias(n) for n, c in combiner.accumulate.items()])
    return acc.select(*keys, *[c.alias(n) for n, c in combiner.extract.items()])


def combine_globally(df: DataFrame, combiner: Combiner) -> DataFrame:
    return combine_per_key(df, [], combiner)


def group_by_key(df: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """key, values: those of a key, in ascending order (the order of a group is otherwise undefined)."""
    return df.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("values"))


def add_fixed_key(df: DataFrame, key: int = 0) -> DataFrame:
    return df.select(F.lit(key).alias("key"), F.struct(*df.columns).alias("value"))


def pixels(samples: Column | int) -> Combiner:
    """Sums of colours by component, then tone mapping by the configured number of samples."""
    return Combiner({c: F.sum(c) for c in "xyz"}, {n: tone_mapped(F.col(c), samples) for n, c in zip("rgb", "xyz", strict=True)})


def bounding_box(x: str, y: str, pad: float = 0.0) -> Combiner:
    return Combiner(
        {"x0": F.min(x), "x1": F.max(x), "y0": F.min(y), "y1": F.max(y)},
        {"x_min": F.col("x0") - pad, "x_max": F.col("x1") + pad, "y_min": F.col("y0") - pad, "y_max": F.col("y1") + pad},
    )
