"""Sources that make their rows: one impulse, literals, counts, and the ray indexes of an image."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most parts that a range is split into.
MOST_SPLITS = 1024
#: Rays of a part, where no number of parts is given: enough that stepping them together pays.
RAYS_A_PART = 1 << 17


def impulse(spark: SparkSession, at: datetime | None = None) -> DataFrame:
    """One row: an empty value, and the event time it is given (none: null)."""
    return spark.range(1).select(F.lit(b"").alias("value"), F.lit(at).cast("timestamp").alias("event_time"))


def literal(spark: SparkSession, rows: Sequence, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def count_up(spark: SparkSession, n: int, parts: int | None = None) -> DataFrame:
    """v: 0 to n - 1, made where it is used."""
    return spark.range(0, max(0, n), 1, *([parts] if parts else [])).select(F.col("id").alias("v"))


def fan_out(df: DataFrame, n: int) -> DataFrame:
    """0 to n - 1 for each row of df."""
    return df.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("v")) if n > 0 else df.select(F.lit(0).cast("long").alias("v")).limit(0)


def ray_indexes(spark: SparkSession, width: int, height: int, samples: int, parts: int | None = None, include_origin: bool = False) -> DataFrame:
    """i, px, py of each sample of each pixel. The samples of a pixel follow each other, so that sums by pixel are mostly done before any shuffle.

    The index 0 is left out unless include_origin is set: the first pixel then has a sample less.
    """
    total = width * height * samples
    parts = max(1, min(MOST_SPLITS, parts or max(spark.sparkContext.defaultParallelism, total // RAYS_A_PART), total))
    stride = width * samples
    i = F.col("id")
    return spark.range(0 if include_origin else 1, total, 1, parts).select(
        i.alias("i"), F.floor(i % stride / samples).cast("int").alias("px"), F.floor(i / stride).cast("int").alias("py")
    )
