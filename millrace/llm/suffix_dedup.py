"""Suffix-array dedup: passages of LENGTH bytes that occur again, found by longest previous factors.

Text is only compared where it can match. Winnowing picks, in every window of LENGTH bytes, the gram
of GRAM bytes with the smallest hash, so that equal windows have equal anchors at equal places. Only
windows at anchors that occur again are kept, as segments. Segments with the same anchor are brought
together and put into a suffix array; equal windows are neighbours there, and the previous and next
smaller positions in suffix order say whether a window occurs earlier (its longest previous factor
reaches LENGTH) or later. Bytes under such windows are removed: all of them, or, with keep_first, only
those of later copies.

An anchor on HOT or more texts isn't brought together. Its windows are cut into blocks of RUN, by their
distance from the anchor; a block's core is what all windows at such distances hold. Equal windows
have equal cores, so a block whose core no other has is settled. Blocks that are equal, by the SHA-256
of their bytes (128 bits of it, as for whole texts), are copies, and one of them stands for the rest;
where a core has fewer than HOT different blocks, they go to a suffix array by their core instead of
their anchor. Only the windows of those left are counted one by one by SHA-256, which pre-aggregates
and spreads.
Equal texts count as one and meet no one else's task; windows that repeat within a text, found by hash
and compared byte by byte, are settled there, and one of them stands for the rest.

What is shuffled for it is numbers and hashes but for the segments: a text gets a number, which stands
for it wherever its windows go, and only texts that a filter takes for ones with segments, and at the
end for ones that lose bytes, are shuffled themselves.

Defined results: a null text counts as empty; repeated rows and equal texts are copies of each other;
texts shorter than LENGTH lose nothing; an empty table gives an empty result; further columns take no
part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import LAST, discard, id_and_text, key_filter, maybe_in, spread_join, written

LENGTH, GRAM, HOT, RUN = 200, 32, 256, 16
#: Bytes of a text that are looked at together, and of segments that share a suffix array.
STRETCH, ARRAY = 1 << 20, 1 << 18
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

# ---------------------------------------------------------------- windows and anchors


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * _A) ^ (b * _B + (b >> np.uint64(31)))
    x ^= x >> np.uint64(29)
    return x * _A


def _hashes(data: np.ndarray, *lengths: int) -> list[np.ndarray]:
    """Hashes of all substrings of the given lengths, each from two of a power of two that overlap."""
    h, size, out = _mixed(data.astype(np.uint64) + np.uint64(1), data.astype(np.uint64)), 1, {}
    while True:
        for n in lengths:
            if size <= n < 2 * size:
                count = len(data) - n + 1
                out[n] = _mixed(h[:count], h[n - size : n - size + count])
        if 2 * size > max(lengths):
            return [out[n] for n in lengths]
        h, size = _mixed(h[:-size], h[size:]), 2 * size


def _first_least(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of so many values, the place of the first of its least ones."""
    at, size = np.arange(len(h)), 1
    while True:
        step = min(size, width - size)
        if not step:
            return at
        left, right = at[:-step], at[step:]
        at, size = np.where(h[right] < h[left], right, left), size + step


def anchored(data: np.ndarray, length: int = LENGTH, gram: int = GRAM, whole: bool = True) -> Iterator[tuple[np.ndarray, ...]]:
    """By stretches: hashes of anchors, their places, first window of each, number of its windows; and, if asked for, the hashes of all windows of the stretch."""
    for at in range(0, len(data) - length + 1, STRETCH):
        part = data[at : at + STRETCH + length - 1]
        grams, *windows = _hashes(part, gram, *[length] * whole)
        least = _first_least(grams, length - gram + 1)
        start = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
        yield grams[least[start]].view(np.int64), least[start] + at, start + at, np.diff(np.append(start, len(least))), *[x.view(np.int64) for x in windows]


def _key(of):
    return F.unhex(F.substring(F.sha2(of, 256), 1, 32))


def _read(docs: DataFrame, length: int) -> DataFrame:
    """For each document: doc_id, key (of its text), n_bytes, its distinct anchors and whether it has them more than once."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, anchors, again = [], [], []
            for x in batch.column("text"):
                data = np.frombuffer(x.as_buffer(), dtype=np.uint8)
                found = [a for a, *_ in anchored(data, length, whole=False)]
                a, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.int64), np.empty(0, np.int64))
                sizes.append(len(data))
                anchors.append(a)
                again.append(n > 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(sizes, pa.int64()), pa.array(anchors, pa.list_(pa.int64())), pa.array(again, pa.list_(pa.bool_()))],
                names=["doc_id", "key", "n_bytes", "anchors", "again"],
            )

    return id_and_text(docs).withColumn("key", _key("text")).mapInArrow(each, "doc_id long, key binary, n_bytes long, anchors array<long>, again array<boolean>")


# ---------------------------------------------------------------- candidates of a text

_SEGMENT = pa.schema([("kind", pa.string()), ("anchor", pa.int64()), ("least", pa.int64()), ("no", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("bytes", pa.binary())])
_SEGMENT_DDL = "kind string, anchor long, least long, no long, start long, n long, bytes binary"


def _repeats(data: np.ndarray, starts: np.ndarray, hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which windows stand for themselves (the first with its bytes), and which of these are there again; equal hashes count once the bytes are equal."""
    stands, many = np.ones(len(starts), dtype=bool), np.zeros(len(starts), dtype=bool)
    left, raw = np.arange(len(starts)), data.tobytes()
    while len(left):
        _, first, of = np.unique(hashes[left], return_index=True, return_inverse=True)
        of = left[first][of]
        again = np.flatnonzero(of != left)
        if not len(again):
            break
        same = np.ones(len(again), dtype=bool)
        a, b = starts[left[again]], starts[of[again]]
        # windows that follow each other, like those they are equal to, are compared as one stretch of bytes
        edge = np.flatnonzero(np.append(True, (np.diff(a) != 1) | (np.diff(b) != 1)))
        for i, x, y, n in zip(edge.tolist(), a[edge].tolist(), b[edge].tolist(), np.diff(np.append(edge, len(a))).tolist(), strict=True):
            if raw[x : x + n - 1 + length] != raw[y : y + n - 1 + length]:  # rare: hashes that are equal by chance
                same[i : i + n] = [raw[x + k : x + k + length] == raw[y + k : y + k + length] for k in range(n)]
        stands[left[again[same]]], many[of[again[same]]] = False, True
        left = left[again[~same]]
    return stands, many


def _number(data: bytes) -> int:
    return int.from_bytes(hashlib.sha256(data).digest()[:8], "little", signed=True)


def _segments_of(data: np.ndarray, anchors: np.ndarray, hot: np.ndarray, length: int) -> Iterator[tuple]:
    """(kind, anchor, start, n): settled within the text ('local', 'first'), for the suffix array ('segment') or to be counted ('hot', by blocks)."""
    order = np.argsort(anchors)
    anchors, hot = anchors[order], hot[order]
    starts, tags, hashes, places, cores = [], [], [], [], []
    for a, place, start, n, windows in anchored(data, length):
        i = np.minimum(np.searchsorted(anchors, a), len(anchors) - 1)
        ok = anchors[i] == a
        place, start, n, i = place[ok], start[ok], n[ok], i[ok]
        if len(start):
            each = np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            starts.append(each)
            tags.append(np.repeat(i, n))
            place = np.repeat(place, n)
            places.append(place)
            cores.append(place - (place - each) // RUN * RUN)  # where the last window at such distances from the anchor starts
            hashes.append(windows[each - start[0] // STRETCH * STRETCH])
    if not starts:
        return
    starts, tags, hashes, places, cores = map(np.concatenate, (starts, tags, hashes, places, cores))
    stands, many = _repeats(data, starts, hashes, length)

    def runs(of: np.ndarray, which: np.ndarray, *by: np.ndarray) -> Iterator[tuple[int, int, int]]:
        at = np.flatnonzero(which)
        if len(at):
            cut = np.diff(starts[at]) != 1
            for x in by:
                cut |= x[at[1:]] != x[at[:-1]]
            edge = np.flatnonzero(np.append(True, cut))
            yield from zip(of[at[edge]].tolist(), starts[at[edge]].tolist(), np.diff(np.append(edge, len(at))).tolist(), strict=True)

    for kind, which in (("local", ~stands), ("first", many)):
        for _, start, n in runs(tags, which):
            yield kind, 0, start, n
    for t, start, n in runs(tags, stands & ~hot[tags], tags):
        yield "segment", int(anchors[t]), start, n
    raw = data.data
    for core, start, n in runs(cores, stands & hot[tags], places, cores):
        yield "hot", _number(raw[core : core + length - RUN + 1]), start, n


def _candidates(texts: DataFrame, length: int) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in _SEGMENT]
        size = 0
        for batch in batches:
            for no, least, text, anchors in zip(batch.column("no"), batch.column("least"), batch.column("text"), batch.column("anchors"), strict=True):
                raw, found = text.as_buffer(), anchors.values
                data, view = np.frombuffer(raw, dtype=np.uint8), memoryview(raw)
                for kind, anchor, start, n in _segments_of(data, found.field("anchor").to_numpy(), found.field("hot").to_numpy(zero_copy_only=False), length):
                    own = bytes(view[start : start + n - 1 + length]) if kind in ("segment", "hot") else None
                    size += 64 + (len(own) if own else 0)
                    for col, x in zip(out, (kind, anchor, least.as_py(), no.as_py(), start, n, own), strict=True):
                        col.append(x)
                    if size > STRETCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _SEGMENT, strict=True)], schema=_SEGMENT)
                        out, size = [[] for _ in _SEGMENT], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _SEGMENT, strict=True)], schema=_SEGMENT)

    return texts.mapInArrow(each, _SEGMENT_DDL)


# ---------------------------------------------------------------- suffix array and previous factors


def _ranked(values: np.ndarray) -> np.ndarray:
    """The rank of each value among the different ones."""
    order = np.argsort(values)
    found = values[order]
    out = np.empty(len(values), dtype=np.int64)
    out[order] = np.cumsum(np.append(False, found[1:] != found[:-1]))[: len(values)]
    return out


def suffix_classes(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that start at the given places, in the order of their first length bytes, and the number of the class of equal ones for each in that order.

    Ranks by 8 bytes are doubled to the largest power of two below length; two of these that overlap rank length bytes.
    """
    padded = np.append(data, np.zeros(length + 8, dtype=np.uint8))
    n, size = len(data), 8
    word = np.zeros(n, dtype=np.uint64)
    for i in range(8):
        word = (word << np.uint64(8)) | padded[i : i + n]
    rank = _ranked(word)
    if length < size:
        raise ValueError("length is 8 at least")
    while 2 * size <= length:
        after = np.append(rank[size:], np.full(min(size, n), -1))[:n] + 1
        rank = _ranked(rank * (n + 1) + after)
        size *= 2
    key = rank[at] * (n + 1) + rank[at + length - size]
    order = np.argsort(key, kind="stable")
    return order, np.cumsum(np.append(False, key[order][1:] != key[order][:-1]))


def longest_previous(position: np.ndarray, order: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix, whether its previous factor, and whether a later one, reaches the length of the classes.

    In suffix order, a suffix has an equal one earlier in the text if and only if a smaller position
    stands before it (previous smaller value) or after it (next smaller value) within its class.
    """
    own, n = position[order], len(order)
    first = np.append(True, group[1:] != group[:-1])
    base = group * (int(own.max(initial=0)) + 1)
    before = np.minimum.accumulate(own - base) + base  # classes descend, so that none reaches into the next
    before = np.append(own.max(initial=0) + 1, before[:-1])
    before[first] = own.max(initial=0) + 1
    last = np.append(first[1:], True)
    after = (np.minimum.accumulate((own + base)[::-1]) - base[::-1])[::-1]
    after = np.append(after[1:], own.max(initial=0) + 1)
    after[last] = own.max(initial=0) + 1
    earlier = (before < own) | (after < own)
    size = np.diff(np.append(np.flatnonzero(first), n))
    several = np.repeat(size > 1, size)
    out = np.zeros((2, n), dtype=bool)
    out[0, order], out[1, order] = earlier, several & ~earlier
    return out[0], out[1]


def _settled(length: int, keep_first: bool):
    names = ["no", "start", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, int, bytes]] = []

        def of(rows: list) -> Iterator[pa.RecordBatch]:
            blob = np.frombuffer(b"".join(r[4] for r in rows), dtype=np.uint8)
            sizes, n = np.array([len(r[4]) for r in rows]), np.array([r[3] for r in rows])
            base = np.cumsum(sizes) - sizes
            own = np.repeat(np.arange(len(rows)), n)
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            order, group = suffix_classes(blob, base[own] + inner, length)
            earlier, later = longest_previous(np.arange(len(own)), order, group)  # rows come in the order of their documents
            found = np.flatnonzero(earlier if keep_first else earlier | later)
            if len(found):
                edge = np.flatnonzero(np.append(True, (np.diff(found) != 1) | (own[found[1:]] != own[found[:-1]])))
                at = found[edge]
                texts = np.array([r[1] for r in rows])[own[at]]
                starts = np.array([r[2] for r in rows])[own[at]] + inner[at]
                yield pa.RecordBatch.from_arrays([pa.array(texts), pa.array(starts), pa.array(np.diff(np.append(edge, len(found))))], names=names)

        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "no", "start", "n", "bytes")), strict=True):
                if size > ARRAY and row[0] != held[-1][0]:
                    yield from of(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield from of(held)

    return run


# ---------------------------------------------------------------- the operator


def spans(docs: DataFrame, length: int = LENGTH, keep_first: bool = False) -> DataFrame:
    """For each text: its key, least identifier, number of copies, and the spans (start, end) to remove, null for none, which may overlap."""
    read = written(_read(docs, length), "anchors")
    by_text = read.groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("n_bytes", "anchors", "again")])
    by_text = written(by_text.withColumn("no", F.monotonically_increasing_id()), "texts")
    discard(read)
    each = by_text.select("no", F.explode(F.arrays_zip("anchors", "again")).alias("a")).select("no", F.col("a.anchors").alias("anchor"), F.col("a.again").alias("again"))
    meets = each.groupBy("anchor").agg(F.sum(F.when(F.col("again"), 2).otherwise(1)).alias("n")).where("n > 1")
    lists = each.select("no", "anchor").join(meets.select("anchor", (F.col("n") >= HOT).alias("hot")), "anchor").groupBy("no").agg(F.collect_list(F.struct("anchor", "hot")).alias("anchors"))
    least = F.coalesce("least", F.lit(LAST)).alias("least")
    lists = written(lists.join(by_text.select("no", "key", least), "no"), "lists")  # so that Spark knows its size
    found = written(_candidates(_of_least(docs, lists).select("no", "least", "text", "anchors"), length), "candidates")
    discard(lists)

    hot = found.where("kind = 'hot'").select(F.col("anchor").alias("core"), _key("bytes").alias("of"), "least", "no", "start", "n", "bytes")
    place, rows = F.struct("least", "no", "start"), F.count("*").alias("rows")
    ends = [F.min("place").alias("low"), F.max("place").alias("high")]
    met = written(hot.withColumn("place", place).groupBy("of").agg(F.first("core").alias("core"), *ends, rows), "met")
    alike = written(met.where("rows > 1").drop("core", "high"), "alike")
    whole = maybe_in(hot.select("of", "least", "no", "start", "n"), key_filter(alike, ["of"]), ["of"])
    whole = spread_join(whole, alike, ["of"], "rows").where(F.lit(not keep_first) | (place != F.col("low"))).select("no", "start", "n")
    # one of each block whose core others have
    cores = written(met.groupBy("core").agg(F.count("*").alias("blocks")).where("blocks > 1"), "cores")
    lows = written(spread_join(met, cores, ["core"], "blocks").select("low.no", "low.start", "blocks"), "lows")
    ones = maybe_in(hot.drop("of"), key_filter(lows, ["no", "start"]), ["no", "start"]).join(lows, ["no", "start"])
    ones = written(ones, "blocks")

    cols = ["anchor", "least", "no", "start", "n", "bytes"]
    together = found.where("kind = 'segment'").select(*cols).unionByName(ones.where(F.col("blocks") < HOT).withColumnRenamed("core", "anchor").select(*cols))
    together = together.repartition("anchor").sortWithinPartitions("anchor", "least", "no", "start")
    cold = together.mapInArrow(_settled(length, keep_first), "no long, start long, n long")

    single = ones.where(F.col("blocks") >= HOT).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    single = single.select(_key(F.col("bytes").substr(F.col("i").cast("int") + 1, F.lit(length))).alias("of"), F.struct("least", "no", (F.col("start") + F.col("i")).alias("start")).alias("place"))
    single = written(single, "windows")
    many = written(single.groupBy("of").agg(*ends, rows).where("rows > 1").drop("high"), "many")
    again = spread_join(single, many, ["of"], "rows").where(F.lit(not keep_first) | (F.col("place") != F.col("low"))).select("place.no", "place.start")
    counted = whole.unionByName(again.withColumn("n", F.lit(1).cast("long")))

    within = found.where("kind = 'local'" if keep_first else "kind IN ('local', 'first')").select("no", "start", "n")
    copies = by_text.where(f"copies > 1 AND n_bytes >= {length}").where(F.lit(not keep_first)).select("no", F.lit(0).cast("long").alias("start"), (F.col("n_bytes") - length + 1).alias("n"))
    every = cold.unionByName(counted).unionByName(within).unionByName(copies)
    spans = every.groupBy("no").agg(F.collect_list(F.struct("start", (F.col("start") + F.col("n") - 1 + length).alias("end"))).alias("spans"))
    out = written(by_text.select("no", "key", "least", "copies").join(spans, "no", "left").select("key", "least", "copies", "spans"), "spans")
    discard(by_text, found, met, alike, cores, lows, ones, single, many)
    return out


def _of_least(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """lists with the text of each, from its row with the least identifier; other rows that certainly aren't such ones aren't shuffled."""
    rows = id_and_text(docs).withColumn("key", _key("text")).withColumn("least", F.coalesce("doc_id", F.lit(LAST)))
    return maybe_in(rows, key_filter(lists, ["key", "least"]), ["key", "least"]).join(lists, ["key", "least"])


def merged(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def suffix_dedup(docs: DataFrame, length: int = LENGTH, keep_first: bool = False, with_text: bool = False) -> DataFrame:
    """A row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with_text: and kept, the bytes that stay.

    keep_first: the copy in the document with the smallest identifier stays, of equal texts that document's own.
    """
    found = spans(docs, length, keep_first)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    texts = id_and_text(docs).withColumn("key", _key("text"))
    bits = key_filter(found.where(F.col("spans").isNotNull() | (F.lit(keep_first) & (F.col("copies") > 1))), ["key"])
    # texts that certainly lose nothing don't meet their spans
    whole = maybe_in(texts, bits, ["key"], inside=False)
    whole = whole.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), *[F.lit(0).cast("long").alias(c) for c in ("n_removed", "n_spans")], F.sha2("text", 256).alias("kept_sha256"), *[F.col("text").cast("binary").alias("kept")] * with_text)
    own = spread_join(maybe_in(texts, bits, ["key"]), found, ["key"], "copies")
    # with keep_first, of equal texts all but one go entirely
    own = own.withColumn("copy", F.lit(keep_first) & (F.col("copies") > 1) & ~F.col("doc_id").eqNullSafe(F.col("least")))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text, copy, own in zip(batch.column("doc_id"), batch.column("text"), batch.column("copy"), batch.column("spans"), strict=True):
                raw = memoryview(text.as_buffer())
                n = len(raw)
                runs = [(0, n)] if copy.as_py() and n >= length else merged([(x["start"], x["end"]) for x in own.as_py() or ()])
                kept, at = [], 0
                for a, b in [*runs, (n, n)]:
                    kept.append(raw[at:a])
                    at = b
                left = b"".join(kept)
                out.append((doc_id.as_py(), n, n - len(left), len(runs), hashlib.sha256(left).hexdigest(), *[left] * with_text))
            yield pa.RecordBatch.from_pydict({k: list(v) for k, v in zip(names, zip(*out, strict=True), strict=True)}, schema=schema) if out else pa.RecordBatch.from_pylist([], schema=schema)

    schema = pa.schema([(k, pa.binary() if k == "kept" else pa.string() if k == "kept_sha256" else pa.int64()) for k in names])
    return own.select("doc_id", "text", "copy", "spans").mapInArrow(each, ddl).unionByName(whole)
