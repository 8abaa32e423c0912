"""Element-wise transforms: projections that Catalyst fuses, flat maps, and functions on batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def map_to(df: DataFrame, **columns: Column) -> DataFrame:
    """One row for each row: exactly these columns."""
    return df.select(*[c.alias(n) for n, c in columns.items()])


def flat_map(df: DataFrame, name: str, values: Column, *keep: str) -> DataFrame:
    """A row for each value of an array column; none for a null or empty one."""
    return df.select(*keep, F.explode(values).alias(name))


def emit_if(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(condition)


def par_do(df: DataFrame, process: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """A function on the batches of a part, for what columns can't express."""
    return df.mapInArrow(process, schema)


def increment(df: DataFrame, name: str, by: int = 1) -> DataFrame:
    return df.withColumn(name, F.col(name) + F.lit(by).cast("long"))


def identity(df: DataFrame, stages: int = 1) -> DataFrame:
    """So many projections that change nothing; they cost one."""
    for _ in range(stages):
        df = df.select("*")
    return df


def to_kv(df: DataFrame, key: Column, value: Column) -> DataFrame:
    return df.select(key.alias("key"), value.alias("value"))


def flatten_kv(df: DataFrame, name: str = "kv") -> DataFrame:
    return df.select(F.struct("key", "value").alias(name))


def with_event_time(df: DataFrame, at: Column) -> DataFrame:
    """Rows with an event time; windows and pane are unset: one global window."""
    return df.withColumns({"event_time": at.cast("timestamp"), "windows": F.lit(None).cast("array<timestamp>"), "pane": F.lit(None).cast("string")})


def reshuffled(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """The same rows dealt anew, by keys or in turn: ends a fused stage, and evens out parts."""
    return df.repartition(parts, *keys)
