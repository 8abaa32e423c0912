"""Builds a plan, runs it under a name, waits, and returns its counters or what it raised."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from millrace.operators.metrics import Run
from millrace.operators.sinks import discard

log = logging.getLogger("millrace")


@dataclass(frozen=True)
class Result:
    name: str
    elements: dict[str, int]
    counters: dict[str, int]


def launch_and_wait(spark: SparkSession, build: Callable[[SparkSession, Run], dict[str, DataFrame]], name: str) -> Result:
    """build returns its outputs by step name; each is run to its end and counted. The name shows in Spark's UI and log."""
    run, elements = Run(), {}
    for step, df in build(spark, run).items():
        spark.sparkContext.setJobDescription(f"{name}: {step}")
        try:
            elements[step] = discard(df)
        finally:
            spark.sparkContext.setJobDescription(None)
        log.info("%s: %s had %d elements", name, step, elements[step])
    return Result(name, elements, run.counters)
