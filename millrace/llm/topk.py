"""Exact top-k search by inner product, with a KD-tree for each shard.

Shards are cells of space: a tree of median splits, fitted on at most about SAMPLE rows chosen by hash,
says for every row which cell it is in, and a cell with more than a shard's rows, such as one of many
equal vectors, is dealt by hash into several shards. A shard has its own KD-tree: split at the median of
the widest dimension until leaves hold at most LEAF rows, with a tight bounding box for each node. A
query walks a tree best first, by the largest score that a node's box allows, and stops at the first node
that can't reach its k-th score. A first round in each query's own shard gives a k-th score, and gives
each shard's box. The second round starts from that score and goes only to shards whose box can reach
it. Shards hold their tree while the queries, in batches, stream past it: no more than a shard and a
batch are in memory, and no pair is made that isn't a result of a shard. The boxes that all queries are
compared with, in blocks, are MOST_SHARDS times the vectors' length at most and a half; with more rows, shards grow.

Defined results: vectors that are null, or hold a null or a number that isn't finite, take no part; every
other row does, repeated identifiers and null ones too, and a query leaves out only its own row;
vectors meet only vectors of their own length; ties go to the smaller identifier, null last; a component
whose multiple doesn't fit a long, or a score that doesn't, is an error; an empty table gives an empty
result; further columns take no part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import LAST, written

SHARD, LEAF, MOST_SHARDS, SAMPLE = 4096, 128, 1 << 16, 1 << 14
_NONE = -(2**63)


class KdTree:
    """Nodes with tight boxes; the rows of a node lie together, those of an inner node's halves one after the other."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        order, spans, halves = np.arange(len(ids)), [(0, len(ids))], [0]
        at = 0
        while at < len(spans):
            a, b = spans[at]
            own = vectors[order[a:b]]
            wide = own.max(axis=0) - own.min(axis=0) if b > a and own.shape[1] else np.zeros(1)
            if b - a > LEAF:
                # where all are equal, halves by identifier leave ties to the smaller ones
                key = own[:, int(wide.argmax())] if wide.any() else ids[order[a:b]]
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(key, half)]
                halves[at] = len(spans)
                spans += [(a, a + half), (a + half, b)]
                halves += [0, 0]
            at += 1
        self.rows, self.ids, self.vectors, self.spans, self.halves = rows[order], ids[order], vectors[order], spans, halves
        none = np.zeros(vectors.shape[1], dtype=vectors.dtype)
        self.low = np.stack([self.vectors[a:b].min(axis=0) if b > a else none for a, b in spans])
        self.high = np.stack([self.vectors[a:b].max(axis=0) if b > a else none for a, b in spans])
        self.least = [int(self.ids[a:b].min()) if b > a else LAST for a, b in spans]

    def search(self, row: np.ndarray, queries: np.ndarray, k: int, known: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions of queries, identifiers and scores of what may be among the k best.

        row: the queries' own rows; known and last: score and identifier of their k-th best so far.
        """
        bounds = box_bounds(queries, self.low, self.high)
        out: tuple[list, list, list] = ([], [], [])
        for q in range(len(row)):
            bound, floor, tie = bounds[q].tolist(), known[q], last[q]
            score, found = np.empty(0, dtype=queries.dtype), np.empty(0, dtype=np.int64)
            heap = [(-bound[0], 0)]
            while heap:
                reach, node = heapq.heappop(heap)
                if -reach < floor:
                    break
                if -reach == floor and self.least[node] > tie:
                    continue
                if half := self.halves[node]:
                    for x in (half, half + 1):
                        if bound[x] >= floor:
                            heapq.heappush(heap, (-bound[x], x))
                    continue
                a, b = self.spans[node]
                new = self.vectors[a:b] @ queries[q]
                ok = np.flatnonzero((new >= floor) & (self.rows[a:b] != row[q]))
                if len(ok):
                    score, found = np.append(score, new[ok]), np.append(found, self.ids[a:b][ok])
                    top = np.lexsort((found, -score))[:k]
                    score, found = score[top], found[top]
                    if len(top) == k and (score[-1], -found[-1]) > (floor, -tie):
                        floor, tie = score[-1], found[-1]
            out[0].append(np.full(len(found), q))
            out[1].append(found)
            out[2].append(score)
        return tuple(np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in out)


def box_bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The largest inner product of each query with a point of each box."""
    zero = queries.dtype.type(0) if queries.dtype != object else 0
    return np.maximum(queries, zero) @ high.T + np.minimum(queries, zero) @ low.T


def fitting(most: float, other: float, dim: int) -> type:
    """The numbers in which inner products of so large components are exact."""
    size = most * other * max(1, dim)
    return np.float64 if size < 2**52 else np.int64 if size < 2**62 else object


def _most(x: np.ndarray) -> float:
    return max(abs(float(x.max(initial=0))), abs(float(x.min(initial=0))))


# ---------------------------------------------------------------- cells of space


def cells(sample: np.ndarray, most: float) -> list[tuple[int, int, int]]:
    """Median splits of a sample until a cell has at most so many of its rows.

    Rows of (dimension, cut, next): a vector at or below the cut goes to node next, else to the one after; dimension -1: a cell.
    """
    nodes, todo, at = [(-1, 0, 0)], [np.arange(len(sample))], 0
    while at < len(nodes):
        rows = todo[at]
        own = sample[rows]
        wide = own.max(axis=0).astype(float) - own.min(axis=0) if len(rows) and own.shape[1] else np.zeros(1)
        if len(rows) > most and wide.any():
            dim = int(wide.argmax())
            values = np.sort(own[:, dim])
            cut = int(values[(len(values) - 1) // 2])
            if cut == values[-1]:  # more than half have the largest value
                cut = int(values[values < cut][-1])
            nodes[at] = (dim, cut, len(nodes))
            nodes += [(-1, 0, 0)] * 2
            below = own[:, dim] <= cut
            todo += [rows[below], rows[~below]]
        at += 1
    return nodes


def cell_of(nodes: list[tuple[int, int, int]], vectors: np.ndarray) -> np.ndarray:
    dim, cut, after = (np.array(x) for x in zip(*nodes, strict=True))
    at, rows = np.zeros(len(vectors), dtype=np.int64), np.arange(len(vectors))
    while len(rows := rows[dim[at[rows]] >= 0]):
        own = at[rows]
        at[rows] = after[own] + (vectors[rows, dim[own]] > cut[own])
    return at


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    col = batch.column("v")
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1) if len(flat) else np.zeros((len(col), 0), dtype=np.int64)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    lengths = batch.column("v").value_lengths().to_numpy()
    for n in np.unique(lengths).tolist():
        yield n, batch.take(pa.array(np.flatnonzero(lengths == n)))


def _celled(trees: dict[int, list]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, part in _by_length(batch):
                cell = cell_of(trees[n], _matrix(part)) if n in trees else np.zeros(part.num_rows, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row", "vec_id", "query", "v")), pa.array([n] * part.num_rows, pa.int32()), pa.array(cell.astype(np.int32))], names=["row", "vec_id", "query", "v", "dim", "cell"])

    return run


# ---------------------------------------------------------------- rounds

_FOUND = "query_row long, query_id long, vec_id long, score long, dim int, shard long, low array<long>, high array<long>, least long"


def _searched(k: int, with_boxes: bool):
    names = ["query_row", "query_id", "vec_id", "score", "dim", "shard", "low", "high", "least"]
    kinds = [pa.int64()] * 4 + [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()]

    def table(n: int, **known) -> pa.RecordBatch:
        cols = [pa.array(known[c], t) if c in known else pa.nulls(n, t) for c, t in zip(names, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(cols, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, tree, kind = None, [], None, None

        def planted() -> tuple[KdTree, type]:
            vectors = np.concatenate([_matrix(p) for p in parts])
            kind = fitting(_most(vectors), _most(vectors), vectors.shape[1])
            return KdTree(*(np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("row", "vec_id")), vectors.astype(kind)), kind

        def box() -> Iterator[pa.RecordBatch]:
            if with_boxes and parts:
                t = tree or planted()[0]
                yield table(1, dim=[shard[0]], shard=[shard[1]], low=[[int(x) for x in t.low[0]]], high=[[int(x) for x in t.high[0]]], least=[t.least[0]])

        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("dim", "shard", "ask")])
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                part, own = batch.slice(a, b - a), tuple(key[:2, a].tolist())
                if own != shard:
                    yield from box()
                    shard, parts, tree = own, [], None
                if not key[2, a]:
                    parts.append(part)
                elif parts:
                    if tree is None:
                        tree, kind = planted()
                    asked = _matrix(part)
                    need = fitting(max(_most(tree.low), _most(tree.high)), _most(asked), asked.shape[1])
                    if need != kind:  # longer numbers only ever replace shorter ones
                        kind = max(kind, need, key=[np.float64, np.int64, object].index)
                        to = np.int64 if kind is object else kind
                        for x in ("vectors", "low", "high"):
                            setattr(tree, x, getattr(tree, x).astype(to).astype(kind))
                    row, known, last = (part.column(c).to_numpy() for c in ("row", "known", "last"))
                    q, found, score = tree.search(row, asked.astype(kind), k, known.astype(kind), last)
                    if kind is object and any(not -(2**63) <= x < 2**63 for x in score):
                        raise OverflowError("a score does not fit a long")
                    yield table(len(q), query_row=row[q], query_id=part.column("vec_id").to_numpy()[q], vec_id=found, score=score.astype(np.int64))
        yield from box()

    return run


def _routed(boxes: dict[int, tuple[np.ndarray, ...]]):
    """Queries for every shard but their own whose box reaches their k-th score, or ties with it and has a smaller identifier."""
    names = ["row", "vec_id", "v", "dim", "known", "last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                for n, part in _by_length(batch.slice(at, 1024)):
                    shards, low, high, least = boxes[n]
                    asked = _matrix(part)
                    kind = fitting(max(_most(low), _most(high)), _most(asked), n)
                    bounds = box_bounds(asked.astype(kind), low.astype(kind), high.astype(kind))
                    known, last, own = (part.column(c).to_numpy() for c in ("known", "last", "shard"))
                    floor = known.astype(kind)[:, None]
                    reach = (bounds > floor) | (bounds == floor) & (least[None, :] < last[:, None])
                    reach &= shards[None, :] != own[:, None]
                    q, s = np.nonzero(reach)
                    for i in range(0, len(q), 4096):
                        sent = part.take(pa.array(q[i : i + 4096]))
                        yield pa.RecordBatch.from_arrays([*(sent.column(c) for c in names), pa.array(shards[s[i : i + 4096]])], names=[*names, "shard"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score of the k vectors with the largest integer inner product with each query."""
    spark = vectors.sparkSession
    real = F.transform("embedding", lambda x: x.cast("double"))
    good = F.col("embedding").isNotNull() & F.forall(real, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform(real, lambda x: F.when(F.abs(x * scale) < 2.0**63, F.floor(x * scale).cast("long")).otherwise(F.raise_error(F.lit("a component does not fit a long"))))
    named = F.coalesce(F.col("vec_id").cast("long"), F.lit(LAST))
    own = vectors.where(good).select(F.monotonically_increasing_id().alias("row"), named.alias("vec_id"), (F.col("vec_id").isNotNull() & F.coalesce(is_query, F.lit(False))).alias("query"), whole.alias("v"))
    own = written(own, "vectors")
    n = own.count()
    most = max(SHARD, -(-n // MOST_SHARDS))
    part = min(1.0, SAMPLE / max(1, n))
    sample = own.where(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < int(part * (1 << 30))).select("v").toArrow().combine_chunks().to_batches()
    trees = {d: cells(_matrix(b), most * part) for batch in sample for d, b in _by_length(batch)}
    own = own.mapInArrow(_celled(trees), "row long, vec_id long, query boolean, v array<long>, dim int, cell int")
    sizes = written(own.groupBy("dim", "cell").agg(F.ceil(F.count("*") / most).cast("int").alias("parts")), "cells")
    # a row for each cell, fewer than two for each shard's worth of rows
    shard = F.col("cell").cast("long") * F.lit(1 << 31) + F.pmod(F.xxhash64("row"), F.col("parts"))
    own = written(own.join(F.broadcast(sizes), ["dim", "cell"]).withColumn("shard", shard).drop("cell", "parts"), "shards")
    shards = max(1, sizes.agg(F.sum("parts")).first()[0] or 0)

    rows = own.select("dim", "shard", F.lit(0).alias("ask"), "row", "vec_id", "v", F.lit(_NONE).alias("known"), F.lit(LAST).alias("last"))

    def round_of(queries: DataFrame, with_boxes: bool) -> DataFrame:
        both = rows.unionByName(queries.withColumn("ask", F.lit(1))).repartition(shards, "dim", "shard").sortWithinPartitions("dim", "shard", "ask")
        return written(both.mapInArrow(_searched(k, with_boxes), _FOUND), "found")

    asked = own.where("query").drop("query")
    first = round_of(asked.withColumns({"known": F.lit(_NONE), "last": F.lit(LAST)}), True)
    found = first.where("query_row IS NOT NULL")
    if shards > 1:
        boxes: dict[int, tuple] = {}
        for r in first.where("query_row IS NULL").select("dim", "shard", "low", "high", "least").collect():
            boxes.setdefault(r["dim"], []).append(r)
        for d, b in boxes.items():
            boxes[d] = (np.array([r["shard"] for r in b]), *(np.array([r[c] for r in b], dtype=np.int64).reshape(len(b), -1) for c in ("low", "high")), np.array([r["least"] for r in b]))
        worst = F.struct("score", (-F.col("vec_id")).alias("id"))
        reached = found.groupBy(F.col("query_row").alias("row")).agg(F.count("*").alias("n"), F.min(worst).alias("worst")).where(F.col("n") == k)
        reached = reached.select("row", F.col("worst.score").alias("known"), (-F.col("worst.id")).alias("last"))
        elsewhere = asked.join(reached, "row", "left").withColumns({"known": F.coalesce("known", F.lit(_NONE)), "last": F.coalesce("last", F.lit(LAST))})
        routed = elsewhere.mapInArrow(_routed(boxes), "row long, vec_id long, v array<long>, dim int, known long, last long, shard long")
        found = found.unionByName(round_of(routed, False))
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.nullif("vec_id", F.lit(LAST)).alias("vec_id"), "score")
