"""Exact dedup: a tree-merge of sorted digest runs.

Each partition of the input makes one sorted run of (digest, smallest identifier, count). In each
round, groups of FAN_IN nodes exchange their runs by digest and merge them; an entry that survives a
merge has the full 256-bit digest, the byte length and a second hash of its text compared, and keeps
the smallest identifier seen so far. After ROUNDS rounds a single node, spread over the digest
space, has one entry for each text. A copy never travels past the first run that holds it, so a text
that a third of the rows share costs one entry a run.

Defined results: a null text counts as empty; null identifiers come after all others; of repeated
rows (same identifier and text) exactly one stays; an empty table gives an empty result; further
columns take no part in the digests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import SPACE, row_key, spread_join, without, written

FAN_IN, ROUNDS = 16, 2
_SCHEMA = pa.schema([(x, pa.string() if x == "digest" else pa.int64()) for x in ("node", "digest", "n_bytes", "check", "keep_id", "keep_row", "group_size")])
_RUN = "node long, digest string, n_bytes long, check long, keep_id long, keep_row long, group_size long"


def digests(docs: DataFrame) -> DataFrame:
    """A row for each document, with a number of its own and what identifies its normalised text; id and hash: its row_key()."""
    norm = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), SPACE, " ")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[c.alias(n) for c, n in zip(row_key(), ("id", "hash"), strict=True)], norm.alias("text"))
    return own.select(
        "doc_id", "id", "hash", F.monotonically_increasing_id().alias("row_no"), F.spark_partition_id().cast("long").alias("node"),
        F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"), F.xxhash64("text").alias("check"),
    )


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One entry for each text and node of rows that come sorted; the first of equal entries has the smallest identifier."""
    carry = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]).cast(_SCHEMA)
        if carry is not None:
            rows = pa.concat_tables([carry, rows])
        n = rows.num_rows
        if not n:
            continue
        rows = rows.combine_chunks()
        new = np.zeros(n, dtype=bool)
        new[0] = True
        for name in ("node", "digest", "n_bytes", "check"):
            col = rows.column(name)
            new[1:] |= pc.not_equal(col.slice(1), col.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(new)
        sizes = np.add.reduceat(rows.column("group_size").to_numpy(), first)
        out = rows.take(pa.array(first))
        out = out.set_column(out.schema.get_field_index("group_size"), "group_size", pa.array(sizes, pa.int64()))
        carry = out.slice(out.num_rows - 1)
        yield from out.slice(0, out.num_rows - 1).combine_chunks().to_batches()
    if carry is not None:
        yield from carry.combine_chunks().to_batches()


def _run(rows: DataFrame) -> DataFrame:
    order = ["node", "digest", "n_bytes", "check", F.col("keep_id").asc_nulls_last(), "keep_row"]
    return rows.sortWithinPartitions(*order).mapInArrow(_merged, _RUN)


def tree_merge(rows: DataFrame, fan_in: int = FAN_IN, rounds: int = ROUNDS) -> DataFrame:
    """The entries of digests(), merged: one for each text, with keep_id, keep_row and group_size."""
    run = _run(rows.select((F.col("node") % fan_in**rounds).alias("node"), "digest", "n_bytes", "check",
                           F.col("doc_id").alias("keep_id"), F.col("row_no").alias("keep_row"), F.lit(1).cast("long").alias("group_size")))
    for _ in range(rounds):
        run = _run(run.withColumn("node", F.floor(F.col("node") / fan_in)).repartition("node", F.substring("digest", 1, 6)))
    return run.drop("node")


_SAME = ["digest", "n_bytes", "check"]


def exact_dedup(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, keep_id, group_size, kept, text_sha256."""
    own = written(digests(docs), "digests")
    kept = written(tree_merge(own), "kept")
    return spread_join(own, kept, _SAME, "group_size").select(
        "doc_id", "keep_id", "group_size", (F.col("row_no") == F.col("keep_row")).alias("kept"), F.col("digest").alias("text_sha256")
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns; only keys of texts with copies meet the texts again."""
    own = written(digests(docs), "digests")
    several = written(tree_merge(own).where("group_size > 1"), "kept")
    seen = spread_join(own, several, _SAME, "group_size")
    return without(docs, seen.select("id", "hash", (F.col("row_no") == F.col("keep_row")).alias("stays")))
