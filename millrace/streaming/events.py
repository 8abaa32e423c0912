"""Event time on streams: watermarks, windows, keyed state, and a sink that finishes each batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def from_files(spark: SparkSession, path: str, files_at_once: int = 1) -> DataFrame:
    """A stream of the rows of parquet files as they come; the schema is that of the files there now."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern, since that may match one file as well as a folder; it matches this path alone


def timed(df: DataFrame, at: Column, late: str | None = None) -> DataFrame:
    """Rows with event_time, as a timestamp with zone (a watermark takes no other); late: how long late rows are waited for."""
    out = df.withColumn("event_time", at.cast("timestamp"))
    return out.withWatermark("event_time", late) if late else out


def tumbling(df: DataFrame, size: str, keys: list[str], **aggregates: Column) -> DataFrame:
    return sliding(df, size, size, keys, **aggregates)


def sliding(df: DataFrame, size: str, every: str, keys: list[str], **aggregates: Column) -> DataFrame:
    """window_start, window_end, keys and aggregates, for batches and streams alike."""
    out = df.groupBy(F.window("event_time", size, every).alias("w"), *keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *aggregates)


def sessions(df: DataFrame, gap: str, keys: list[str], **aggregates: Column) -> DataFrame:
    out = df.groupBy(F.session_window("event_time", gap).alias("w"), *keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, *aggregates)


def running_counts(df: DataFrame, key: str, timeout_ms: int | None = None) -> DataFrame:
    """key, n: elements of each key so far, kept as state; with a timeout a key that stays away is told once more, and forgotten."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (n,) = state.get
            state.remove()
            yield pd.DataFrame({key: [k[0]], "n": [n], "done": [True]})
            return
        n = (state.get[0] if state.exists else 0) + sum(len(b) for b in batches)
        state.update((n,))
        if timeout_ms:
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame({key: [k[0]], "n": [n], "done": [False]})

    kind = df.schema[key].dataType.simpleString()
    wait = GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout
    return df.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, n long, done boolean", "n long", "update", wait)


def finish_batches(df: DataFrame, finish: Callable[[DataFrame, int], None], mode: str = "append"):
    """Starts a query that calls finish with each batch and its number."""
    return df.writeStream.outputMode(mode).foreachBatch(finish)
