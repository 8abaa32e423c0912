"""Bundle lifecycle: a stage sees the batches of a part between a start and a finish, and counts what it saw."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Enough(Exception):
    """Raised by a stage's process to end its bundle: no further input is read, what the exception carries is emitted, and finishes run."""

    def __init__(self, last: pa.RecordBatch | None = None) -> None:
        self.last = last


@dataclass
class Stage:
    """Hooks of a transform; each may give a batch to emit. setup runs once for each worker's part, before the first batch."""

    process: Callable[[pa.RecordBatch], pa.RecordBatch | None]
    start: Callable[[], pa.RecordBatch | None] = lambda: None
    finish: Callable[[], pa.RecordBatch | None] = lambda: None
    setup: Callable[[], None] = lambda: None


def run_bundles(df: DataFrame, stages: Sequence[Stage], schema: str) -> DataFrame:
    """The stages in line, in one pass. A stage that has Enough ends the bundle's input. Starts and finishes go parent first; what a parent emits in either still passes through its children."""
    stages = list(stages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = [False]

        def through(batch: pa.RecordBatch | None, i: int) -> Iterator[pa.RecordBatch]:
            for stage in stages[i:]:
                if batch is None or not batch.num_rows:
                    return
                try:
                    batch = stage.process(batch)
                except Enough as e:
                    batch, done[0] = e.last, True
            if batch is not None and batch.num_rows:
                yield batch

        for stage in stages:
            stage.setup()
        for i, stage in enumerate(stages):
            yield from through(stage.start(), i + 1)
        for batch in () if done[0] else batches:
            yield from through(batch, 0)
            if done[0]:
                break
        for i, stage in enumerate(stages):
            yield from through(stage.finish(), i + 1)

    return df.mapInArrow(run, schema)


def bundle_counts(df: DataFrame, bundle: Column) -> DataFrame:
    """Elements of each bundle; an explicit bundle number makes the counts the same in every run."""
    return df.groupBy(bundle.alias("bundle_id")).agg(F.count("*").alias("n"))


def at_time(batch: pa.RecordBatch, seconds: int) -> pa.RecordBatch:
    """A batch that a bundle's start or finish emits, with an event time of its own; windows and pane stay unset."""
    own = pa.array([seconds * 1_000_000] * batch.num_rows, pa.timestamp("us", tz="UTC"))
    return pa.RecordBatch.from_arrays([*batch.columns, own], names=[*batch.schema.names, "event_time"])
