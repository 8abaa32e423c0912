"""Mixing sources to target weights, by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that a document belongs to). A
flow carries words from the patterns to the sources' quotas: a pattern's words may be used once at no
cost, a second and a third time at rising costs, so that as little as possible is repeated. Then each
pattern's flow is taken from its documents: all of them as many whole times as it holds, and the rest
from the first ones in a seeded order. Where the rest ends is found by sums over ranges of the seeded
hash and then within the one range, so each document's share follows from its own place in the order.

What reaches the driver is one row for each pattern: labels of sources, not documents. Defined
results: a null text has size 0; documents without a source form a source of their own, listed last;
repeated rows count each for itself; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from itertools import cycle

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import LAST, written

MOST_REPEATS, BUCKET_BITS = 3, 12
#: Patterns up to which their plan is broadcast; with more it is joined by pattern.
MOST_BROADCAST = 10_000


def targets(sizes: Sequence[int], weights: Sequence[float] | None = None, most: int = MOST_REPEATS) -> list[float]:
    """Shares of the sum of sizes by weight; what goes beyond most times a size is shared again by weight until nothing does."""
    weights = list(weights) if weights is not None else [w for w, _ in zip(cycle((1, 2, 3)), sizes, strict=False)]
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(most * sizes[i])
            free.discard(i)
        left -= sum(out[i] for i in over)
    return out


def min_cost_flow(patterns: Sequence[tuple[int, Sequence[int]]], quotas: Sequence[int], costs: Sequence[int]) -> list[dict[int, int]]:
    """patterns: (words, sources). costs: of the first use of a word, the second and so on, rising.

    Returns for each pattern the words that it gives to each source: the most that quotas and
    patterns allow, at the least cost. Successive shortest paths with potentials.
    """
    n, m = len(patterns), len(quotas)
    start, end = n + m, n + m + 1
    graph: list[list[list[int]]] = [[] for _ in range(n + m + 2)]

    def arc(a: int, b: int, room: int, cost: int) -> None:
        graph[a].append([b, room, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])

    for p, (words, sources) in enumerate(patterns):
        for c in costs:
            arc(start, p, words, c)
        for s in sources:
            arc(p, n + s, words * len(costs), 0)
    for s, q in enumerate(quotas):
        arc(n + s, end, q, 0)
    height = [0] * len(graph)
    while True:
        far, came = [None] * len(graph), [None] * len(graph)
        far[start], heap = 0, [(0, start)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for i, (b, room, cost, _) in enumerate(graph[a]):
                to = d + cost + height[a] - height[b]
                if room > 0 and (far[b] is None or to < far[b]):
                    far[b], came[b] = to, (a, i)
                    heapq.heappush(heap, (to, b))
        if far[end] is None:
            break
        height = [h + (d if d is not None else far[end]) for h, d in zip(height, far, strict=True)]
        path, b = [], end
        while b != start:
            a, i = came[b]
            path.append((a, i))
            b = a
        flow = min(graph[a][i][1] for a, i in path)
        for a, i in path:
            graph[a][i][1] -= flow
            graph[graph[a][i][0]][graph[a][i][3]][1] += flow
    return [{b - n: graph[b][back][1] for b, _, _, back in graph[p] if n <= b < n + m and graph[b][back][1]} for p in range(n)]


def _ordered(labels: set) -> list:
    return sorted((x for x in labels if x is not None), key=lambda x: [*map(ord, x)]) + [None] * (None in labels)


def _labels(docs: DataFrame, sources: str) -> Column:
    many = isinstance(docs.schema[sources].dataType, T.ArrayType)
    labels = F.array_sort(F.array_distinct(F.col(sources))) if many else F.array(F.col(sources).cast("string"))
    return F.when(F.size(labels) > 0, labels).otherwise(F.array(F.lit(None).cast("string")))


def _place(seed: int) -> tuple[Column, Column]:
    """The seeded order of documents: a hash, then the identifier; only repeated rows share a place."""
    return F.xxhash64(F.lit(seed), "doc_id", "text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))


def _size() -> Column:
    return F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


_PLAN = "labels array<string>, source_size long, target double, times long, rest long"


def _planned(own: DataFrame, weights: dict | None, most: int) -> DataFrame:
    """own: labels, size, draw, id of each document. Returns a row for each pattern: _PLAN, and the place where the rest ends.

    Documents before (cut_draw, cut_id) are taken once more than the others, the one there in part: cut_rest words, over
    cut_rows repeated rows.
    """
    found = [(r["labels"], r["words"]) for r in own.groupBy("labels").agg(F.sum("size").alias("words")).collect()]
    names = _ordered({x for ls, _ in found for x in ls})
    place = {x: i for i, x in enumerate(names)}
    sizes = [0] * len(names)
    for ls, w in found:
        for x in ls:
            sizes[place[x]] += w
    goal = targets(sizes, [weights[x] for x in names] if weights else None, most)
    flows = min_cost_flow([(w, [place[x] for x in ls]) for ls, w in found], [round(g) for g in goal], [i * i for i in range(most)])
    told = []
    for (ls, w), flow in zip(found, flows, strict=True):
        s, total = place[ls[0]], sum(flow.values())
        told.append((ls, sizes[s], goal[s], total // w if w else 0, total % w if w else 0))
    plan = written(own.sparkSession.createDataFrame(told, _PLAN), "flows")
    # the range of the hash in which the rest of a pattern ends, then the document in it
    near = lambda a, b: a["labels"].eqNullSafe(b["labels"])
    own = own.withColumn("bucket", F.shiftright("draw", 64 - BUCKET_BITS))
    sums = own.groupBy("labels", "bucket").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("after", F.sum("words").over(Window.partitionBy("labels").orderBy("bucket")))
    ends = sums.join(plan, near(sums, plan)).where("after > rest").groupBy(sums["labels"]).agg(F.min(F.struct("bucket", (F.col("after") - F.col("words")).alias("before"), "rest")).alias("end"))
    ends = written(ends.select("labels", "end.*"), "ranges")
    inside = own.join(ends, near(own, ends) & (own["bucket"] == ends["bucket"])).groupBy(own["labels"], "draw", "id", "size", "before", "rest").agg(F.count("*").alias("rows"))
    inside = inside.withColumn("to", F.sum(F.col("size") * F.col("rows")).over(Window.partitionBy("labels").orderBy("draw", "id").rowsBetween(Window.unboundedPreceding, 0)) + F.col("before"))
    cut = F.struct("draw", "id", (F.col("rest") - F.col("to") + F.col("size") * F.col("rows")).alias("left"), "rows")
    cuts = inside.where("to > rest").groupBy("labels").agg(F.min(cut).alias("cut"))
    cuts = cuts.select(F.col("labels").alias("of"), F.col("cut.draw").alias("cut_draw"), F.col("cut.id").alias("cut_id"), F.col("cut.left").alias("cut_rest"), F.col("cut.rows").alias("cut_rows"))
    whole = written(plan.join(cuts, plan["labels"].eqNullSafe(cuts["of"]), "left").drop("of").withColumnRenamed("labels", "pattern"), "plan")
    return F.broadcast(whole) if len(told) <= MOST_BROADCAST else whole


def _matched(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (labels, draw, id, ...) with the plan of their pattern; before: taken once more; at: at the cut."""
    here, cut = F.struct("draw", "id"), F.struct(F.col("cut_draw").alias("draw"), F.col("cut_id").alias("id"))
    none = F.lit(False)
    both = rows.join(plan, rows["labels"].eqNullSafe(plan["pattern"]))
    return both.withColumns({"before": F.coalesce(here < cut, none), "at": F.coalesce(here == cut, none)})


def mix(docs: DataFrame, sources: str = "source", weights: dict | None = None, seed: int = 7, most: int = MOST_REPEATS) -> DataFrame:
    """A row for each document: doc_id, size, source_size and target (of the first of its sources), taken.

    sources: a column with a label, or with an array of labels where sources overlap.
    """
    draw, id_ = _place(seed)
    own = written(docs.select("doc_id", _labels(docs, sources).alias("labels"), _size().alias("size"), draw.alias("draw"), id_.alias("id")), "sizes")
    rows = _matched(own, _planned(own, weights, most))
    full = rows.where("NOT at").withColumn("taken", (F.col("times") + F.col("before").cast("long")) * F.col("size"))
    # the rows at a cut, which are repeated rows of one document, share what is left
    cut = rows.where("at").groupBy("doc_id", "labels", "size", "source_size", "target", "times", "cut_rest").agg(F.count("*").alias("n"))
    cut = cut.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    part = F.greatest(F.lit(0), F.least(F.col("cut_rest") - F.col("i") * F.col("size"), F.col("size")))
    cut = cut.withColumn("taken", F.col("times") * F.col("size") + part)
    cols = ["doc_id", "size", "source_size", "target", "taken"]
    return full.select(*cols).unionByName(cut.select(*cols))


def mixed(docs: DataFrame, sources: str = "source", weights: dict | None = None, seed: int = 7, most: int = MOST_REPEATS) -> DataFrame:
    """The rows of docs, each as many whole times as the mix takes it.

    A copy that the mix would cut is left out; a document without words weighs nothing and stays once.
    Whether a row is taken again shows in its own place in the seeded order, so no row is looked up.
    """
    draw, id_ = _place(seed)
    named = {"labels": _labels(docs, sources), "size": _size(), "draw": draw, "id": id_}
    narrow = written(docs.select(*[c.alias(k) for k, c in named.items()]), "sizes")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *[c.alias(k) for k, c in named.items()])
    rows = _matched(rows, _planned(narrow, weights, most))
    again = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("times") + F.col("before").cast("int"))
    full = rows.where("NOT at").select("doc", again.cast("int").alias("copies"))
    # repeated rows at a cut: one stands for all, as often as they are taken together
    cut = rows.where("at").groupBy("labels", "draw", "id").agg(F.first("doc").alias("doc"), F.first("size").alias("size"), F.first("times").alias("times"), F.first("cut_rest").alias("left"), F.count("*").alias("n"))
    cut = cut.select("doc", (F.col("times") * F.col("n") + F.least(F.col("n"), F.floor(F.col("left") / F.col("size")))).cast("int").alias("copies"))
    every = full.unionByName(cut).where("copies > 0")
    return every.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")
