"""Side inputs. What every row gets is reduced to one row first; a keyed side is reduced to a row for each key and joined, and Spark broadcasts it only where its size allows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_of(side: DataFrame, value: str, order: str) -> DataFrame:
    """The value with the smallest order key, as a table of one row (null if the side is empty)."""
    return side.agg(F.min_by(value, order).alias("first"))


def with_first(df: DataFrame, side: DataFrame, value: str, order: str, name: str, default: Column) -> DataFrame:
    """Each row with the side's first value, or the default if it is empty: one row of the side, whatever its size."""
    return df.crossJoin(F.broadcast(first_of(side, value, order))).withColumn(name, F.coalesce("first", default)).drop("first")


def with_scalars(df: DataFrame, **sides: tuple[DataFrame, str, str]) -> DataFrame:
    """Each row with the first values of several tagged sides, each read once; tag=(side, value, order)."""
    for tag, (side, value, order) in sides.items():
        df = df.crossJoin(F.broadcast(first_of(side, value, order).withColumnRenamed("first", tag)))
    return df


def lookup_first(df: DataFrame, key: str, side: DataFrame, side_key: str, value: str, name: str, default: Column) -> DataFrame:
    """Each row with its key's smallest value in the side, or the default."""
    smallest = side.groupBy(F.col(side_key).alias("__key")).agg(F.min(value).alias("__value"))
    return df.join(smallest, F.col(key) == F.col("__key"), "left").withColumn(name, F.coalesce("__value", default)).drop("__key", "__value")


def iterate_side(df: DataFrame, side: DataFrame, name: str, most: int = 10_000) -> DataFrame:
    """Each row with the whole side as an array; the side is counted first, and refused beyond most rows."""
    n = side.limit(most + 1).count()
    if n > most:
        raise ValueError(f"a side input of more than {most} rows; join it by a key instead")
    rows = side.agg(F.array_sort(F.collect_list(F.struct(*side.columns))).alias(name))
    return df.crossJoin(F.broadcast(rows))
