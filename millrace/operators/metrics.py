"""Named counters, read after a run."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass
class Run:
    """Counters of one run: attach them with counted(), act on the table, then read counters."""

    observed: dict[str, Observation] = field(default_factory=dict)

    def counted(self, df: DataFrame, name: str, **counters: Column) -> DataFrame:
        seen = Observation(name)
        self.observed[name] = seen
        return df.observe(seen, F.count(F.lit(1)).alias("elements"), *[F.sum(F.when(c, 1).otherwise(0)).alias(n) for n, c in counters.items()])

    @property
    def counters(self) -> dict[str, int]:
        return {f"{name}.{k}": v for name, seen in self.observed.items() for k, v in seen.get.items()}
