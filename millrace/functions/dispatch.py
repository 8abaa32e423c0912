"""Pipelines of scalar functions, and a registry of how to call them, keyed by signature."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.scalar import itoa, square, truncate


@dataclass(frozen=True)
class Scalar:
    """A function in its forms: on columns, in SQL, on pandas series, on one value."""

    name: str
    takes: str
    gives: str
    column: Callable[[Column], Column]
    sql: str
    series: Callable[[pd.Series], pd.Series]
    value: Callable

    @property
    def signature(self) -> tuple[str, str]:
        return self.takes, self.gives


SQUARE = Scalar("square", "double", "double", square, "({0} * {0})", lambda s: s * s, lambda v: v * v)
TRUNCATE = Scalar("truncate", "double", "bigint", truncate, "CAST({0} AS BIGINT)", lambda s: s.astype("int64"), int)
FORMAT = Scalar("format", "bigint", "string", itoa, "CAST({0} AS STRING)", lambda s: s.astype(str), str)
PIPELINE = (SQUARE, TRUNCATE, FORMAT)


class UnknownSignature(LookupError):
    pass


@dataclass
class Registry:
    """Adapters by signature: each makes, for a function, what applies it to a column."""

    adapters: dict[tuple[str, str], Callable[[Scalar], Callable[[Column], Column]]] = field(default_factory=dict)
    fallback: Callable[[Scalar], Callable[[Column], Column]] | None = None

    def register(self, takes: str, gives: str, adapter: Callable[[Scalar], Callable[[Column], Column]]) -> None:
        self.adapters[takes, gives] = adapter

    def caller(self, f: Scalar) -> Callable[[Column], Column]:
        make = self.adapters.get(f.signature, self.fallback)
        if make is None:
            raise UnknownSignature(f"no adapter for {f.name}: {f.takes} -> {f.gives}; register({f.takes!r}, {f.gives!r}, adapter) adds one")
        return make(f)


def fold(column: Column, calls: Sequence[Callable[[Column], Column]]) -> Column:
    """The calls one after the other, the first on column."""
    return functools.reduce(lambda c, call: call(c), calls, column)


def _checked(fs: Sequence[Scalar]) -> Sequence[Scalar]:
    for a, b in zip(fs, fs[1:], strict=False):
        if a.gives != b.takes:
            raise TypeError(f"{a.name} gives {a.gives}, but {b.name} takes {b.takes}")
    return fs


def by_columns(column: Column, fs: Sequence[Scalar] = PIPELINE) -> Column:
    return fold(column, [f.column for f in _checked(fs)])


def by_sql(name: str, fs: Sequence[Scalar] = PIPELINE) -> Column:
    return F.expr(functools.reduce(lambda e, f: f.sql.format(e), _checked(fs), name))


def by_switch(column: Column, fs: Sequence[Scalar] = PIPELINE) -> Column:
    """By the signature alone, each known one written out."""

    def call(c: Column, f: Scalar) -> Column:
        match f.signature:
            case ("double", "double") | ("double", "bigint") | ("bigint", "string"):
                return f.column(c)
            case _:
                raise UnknownSignature(f"{f.takes} -> {f.gives}")

    return functools.reduce(call, _checked(fs), column)


def by_registry(column: Column, registry: Registry, fs: Sequence[Scalar] = PIPELINE) -> Column:
    return fold(column, [registry.caller(f) for f in _checked(fs)])


def series_adapter(f: Scalar) -> Callable[[Column], Column]:
    """Calls a function on Arrow batches; the form for what has no form on columns."""
    run = f.series

    def call(s: pd.Series) -> pd.Series:
        return run(s)

    call.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(call, f.gives)


def by_fused_series(fs: Sequence[Scalar] = PIPELINE) -> Callable[[Column], Column]:
    """All functions in one pass over each batch."""
    runs = [f.series for f in _checked(fs)]

    def call(s: pd.Series) -> pd.Series:
        for run in runs:
            s = run(s)
        return s

    call.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(call, fs[-1].gives)


def standard_registry() -> Registry:
    out = Registry()
    for f in PIPELINE:
        out.register(*f.signature, lambda f: f.column)
    return out
