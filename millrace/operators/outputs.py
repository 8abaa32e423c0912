"""Several outputs of one transform: a table of tagged rows, read once and split by tag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tagged(df: DataFrame, **outputs: Column) -> DataFrame:
    """A row for each output whose condition holds: tag, and the columns of df; a row may go to several outputs, or none."""
    tags = F.filter(F.array(*[F.when(c, F.lit(t)) for t, c in outputs.items()]), lambda t: t.isNotNull())
    return df.select(F.explode(tags).alias("tag"), *df.columns)


def output(rows: DataFrame, tag: str) -> DataFrame:
    return rows.where(F.col("tag") == tag).drop("tag")


def routed(df: DataFrame, by: Column, *known: str, rest: str = "rest") -> DataFrame:
    """Each row under one tag: the value of by, or rest if it isn't a known one."""
    return df.select(F.when(by.isin(*known), by).otherwise(F.lit(rest)).alias("tag"), *df.columns)
