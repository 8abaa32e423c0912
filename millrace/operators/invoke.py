"""Calls a function with what its parameters ask for: the element, its event time, side inputs and outputs, bound by name."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of a side input that is given to a function whole.
MOST_SIDE_ROWS = 10_000


def _values(side: DataFrame, tag: str) -> list:
    rows = side.limit(MOST_SIDE_ROWS + 1).collect()
    if len(rows) > MOST_SIDE_ROWS:
        raise ValueError(f"side input {tag!r} has more than {MOST_SIDE_ROWS} rows; join it by a key instead")
    return [r[0] for r in rows]


def call_with(df: DataFrame, function: Callable, outputs: Sequence[str], schema: str, sides: Mapping[str, DataFrame] | None = None, event_time: int | None = None) -> DataFrame:
    """A row (tag, and the columns of schema) for each call of an output.

    The function's parameters are named element (a dict of the row), event_time, a side's tag (an
    iterator over its values, anew for each element) or an output's tag (a function that takes a
    dict). Names that bind to nothing are refused before anything runs; what the function raises
    fails the job.
    """
    sides = sides or {}
    asked = list(inspect.signature(function).parameters)
    if unknown := [p for p in asked if p not in {"element", "event_time", *sides, *outputs}]:
        raise TypeError(f"{function.__name__} asks for {', '.join(unknown)}, which is no element, event_time, side input or output")
    held = {tag: _values(side, tag) for tag, side in sides.items() if tag in asked}
    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], f"tag string, {schema}").schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            emitters = {t: (lambda row, t=t: out.append({"tag": t, **row})) for t in outputs if t in asked}
            for element in batch.to_pylist():
                given = {"element": element, "event_time": event_time, **emitters, **{t: iter(v) for t, v in held.items()}}
                function(**{p: given[p] for p in asked})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return df.mapInArrow(run, f"tag string, {schema}").where(F.col("tag").isNotNull())
