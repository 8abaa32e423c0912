"""Connected components of a table of links, by alternating large and small stars.

Links are first reduced where they are: each task joins what it holds, a bounded number of links at a
time, and passes on a star for each component that it sees. Every round is a few joins and aggregates
over the links; nothing is gathered on the driver but a count and a checksum, and each round is a table
in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import discard, written

#: Links that a task joins at a time.
HELD = 1 << 20


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components by fewer links: from each node to the smallest one that links reach."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        new = root.copy()
        least = np.minimum(root[x], root[y])
        for end in (x, y):  # a root goes under the least that a link of its tree leads to
            np.minimum.at(new, root[end], least)
            np.minimum.at(new, end, least)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    far = root != np.arange(len(nodes))
    return nodes[far], nodes[root[far]]


def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a task passes on: fewer links that join the same nodes."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def out() -> pa.RecordBatch:
        a, b = stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        if batch.num_rows:
            held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
            size += batch.num_rows
        if size > HELD:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    rest = down.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return rest.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(links: DataFrame, are_reduced: bool = False) -> DataFrame:
    """links: a long, b long. Returns (node, root) for each node with a link that isn't the root itself.

    are_reduced: the worker that made the links has reduced() them, so that no second one is needed beside it.
    """
    if not are_reduced:
        links = links.where("a <> b").mapInArrow(reduced, "a long, b long")
    links = written(links.distinct(), "links")
    sign = lambda x: tuple(x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    was = sign(links)
    while was[0]:
        new = written(_small_star(_large_star(links)), "links")
        now = sign(new)
        discard(links)
        links = new
        if now == was:
            break
        was = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
