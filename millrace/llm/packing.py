"""Packing documents into fixed windows of tokens, planned by non-negative least squares.

A document's ids are cut into pieces of WINDOW ids and a shorter rest. The counts of pieces by length
(at most WINDOW numbers, whatever the input) are the histogram. Shallow combinations of lengths that
fill a window are enumerated; non-negative least squares gives how often to repeat each so that they
use up the histogram; the counts are rounded, what rounding leaves is solved for again, and the rest, a
small share, is packed greedily, largest first. The plan says, for the pieces of a length in a fixed order, which sequence and offset the n-th
one gets; a piece finds its number from counts by (length, part of the input), so that no task sees
all the pieces of a length.

Defined results: a null text counts as empty, and an empty document is the end id alone; repeated
rows are packed each for itself; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import json
import re
import struct
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import id_and_text, written

WINDOW, END_ID = 4096, 2
#: Limits of the planner, whatever the input: unused ids in a combination, its runs, choices of the second and third.
SLACK, DEPTH, SPREAD = 8, 4, (0, 6, 3)
#: Steps and least gain of a step of the least squares; how often it is solved, and the share that it must place for one more time.
STEPS, LEAST, ROUNDS, SHARE = 40_000, 0.5, 3, 0.05
#: Entries of a worker's cache of words.
CACHED = 100_000

# ---------------------------------------------------------------- ids of a text


def _by_word(config: dict) -> bool:
    """Whether the tokenizer folds case, drops white space, and treats runs of letters apart from all else."""
    split = (config.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    kinds = [x["type"] for x in (config.get("normalizer") or {}).get("normalizers", [])]
    return kinds == ["NFC", "Replace", "Lowercase"] and split[0].get("pattern", {}).get("Regex", "").endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") and not split[-1].get("add_prefix_space", True)


def _byte_letters() -> list[str]:
    """Byte-level vocabularies write printable bytes as themselves and the rest, in order, from code point 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


@lru_cache(maxsize=4)
def encoder(path: str) -> Callable[[str], bytes]:
    """Text to its ids as little-endian 32-bit numbers, the same as encode(text, add_special_tokens=False).ids.

    Where the tokenizer works by word, ids of words are kept, and words of letters go straight to its model.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    packed = lambda ids: struct.pack(f"<{len(ids)}I", *ids)
    whole = lambda text: packed(tokenizer.encode(text, add_special_tokens=False).ids)
    with open(path) as f:
        if not _by_word(json.load(f)):
            return whole
    model, letters = tokenizer.model, _byte_letters()
    marked = re.compile(r"(.*?)([!-&(-/:-@\[-`{-~]+)", re.DOTALL)

    class Known(dict):
        def __missing__(self, word: str) -> bytes:
            if len(self) > CACHED:
                self.clear()
            self[word] = ids = self.ids(word)
            return ids

        def ids(self, word: str) -> bytes:
            if word.isalpha() and "Σ" not in word and (word.isascii() or unicodedata.is_normalized("NFC", word)):
                low = word.lower()
                if low != word and low.isalpha():
                    return self[low]
                if low.isalpha() and unicodedata.is_normalized("NFC", low):
                    return packed([x.id for x in model.tokenize("".join([letters[b] for b in low.encode()]))])
            elif (m := marked.fullmatch(word)) and m[1].isalpha():
                return self[m[1]] + self[m[2]]
            return whole(word)

    known = Known()

    def ids(text: str) -> bytes:
        return b"".join(map(known.__getitem__, text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))

    return ids


_PIECE = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("part", pa.int64()), ("nth", pa.int64())]


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row for each piece; nth: its number among those of its length in this part of the input."""
    schema = pa.schema(_PIECE + [("ids", pa.binary())] * with_ids)
    end, wide = np.array([end_id], dtype="<u4").tobytes(), 4 * window

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, counts = encoder(tokenizer), {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                out = [[] for _ in schema]
                for doc_id, text, row_no in zip(*(some.column(i).to_pylist() for i in range(3)), strict=True):
                    ids = ids_of(text) + end
                    n = len(ids) // 4
                    for start in range(0, n, window):
                        own = ids[4 * start : 4 * start + wide]
                        length = len(own) // 4
                        counts[length] = nth = counts.get(length, -1) + 1
                        row = (doc_id, start, length, zlib.crc32(own), n, row_no >> 33, nth, own)
                        for col, x in zip(out, row, strict=False):
                            col.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    kinds = ", ".join(f"{f.name} {'binary' if f.name == 'ids' else 'long'}" for f in schema)
    return id_and_text(docs).withColumn("row_no", F.monotonically_increasing_id()).mapInArrow(cut, kinds)


# ---------------------------------------------------------------- the plan


def combinations(counts: dict[int, int], window: int) -> list[dict[int, int]]:
    """Combinations of at most DEPTH runs of lengths that leave at most SLACK of a window unused, each used once at least by what counts has."""
    lengths = sorted(counts)
    found: dict[tuple, dict[int, int]] = {}

    def spread(room: int, n: int) -> list[int]:
        i = bisect.bisect_right(lengths, room)
        return [lengths[j] for j in sorted({round(k * (i - 1) / max(1, n - 1)) for k in range(n)})] if i else []

    def extended(made: dict[int, int], room: int, depth: int) -> None:
        i = bisect.bisect_right(lengths, room)
        last = lengths[i - 1] if i else 0
        whole = made | {last: made.get(last, 0) + 1} if last else made
        if room - last <= SLACK and whole.get(last, 0) <= counts.get(last, 0):
            found.setdefault(tuple(sorted(whole.items())), whole)
        if depth < DEPTH:
            for length in spread(room, SPREAD[depth]) if depth < len(SPREAD) else [last] * (last > 0):
                free = counts[length] - made.get(length, 0)
                if free > 0:
                    run = min(free, room // length)
                    for n in {1, run} if depth < 2 else {run}:
                        extended(made | {length: made.get(length, 0) + n}, room - n * length, depth + 1)

    for length in lengths:
        for n in {1, min(counts[length], window // length)}:
            extended({length: n}, window - n * length, 1)
    return list(found.values())


def nonnegative_least_squares(made: list[dict[int, int]], counts: dict[int, int]) -> np.ndarray:
    """x >= 0 that brings the sum of x times the combinations near the counts.

    Steps enter the one combination that lessens the squared error most, or take from one that is in
    too often, by the exact amount, until none lessens it by LEAST. So few combinations are in, with
    counts worth rounding, where steps along the gradient of all would spread the counts over all.
    """
    place = {k: i for i, k in enumerate(sorted(counts))}
    goal = np.array([counts[k] for k in place], dtype=float)
    size = np.array([len(m) for m in made])
    row, col = np.array([place[k] for m in made for k in m]), np.repeat(np.arange(len(made)), size)
    val, first = np.array([v for m in made for v in m.values()], dtype=float), np.append(0, np.cumsum(size))
    norm = np.bincount(col, val * val, len(made))
    by_row = np.argsort(row, kind="stable")
    of, weight, since = col[by_row], val[by_row], np.searchsorted(row[by_row], np.arange(len(place) + 1))
    x, slope = np.zeros(len(made)), np.bincount(col, val * goal[row], len(made))
    gain = slope * slope / norm
    for _ in range(STEPS):
        j = int(gain.argmax())
        if gain[j] < LEAST:
            break
        step = max(-x[j], slope[j] / norm[j])
        x[j] += step
        own = slice(first[j], first[j + 1])
        touched = [slice(since[i], since[i + 1]) for i in row[own].tolist()]
        for at, v in zip(touched, val[own].tolist(), strict=True):
            slope[of[at]] -= weight[at] * (v * step)
        near = np.concatenate([of[at] for at in touched])
        by = np.maximum(-x[near], slope[near] / norm[near])
        gain[near] = by * (2 * slope[near] - by * norm[near])
    return x


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, dict[int, int]]]:
    """(times, combination) that together use the histogram exactly."""
    left = {k: v for k, v in histogram.items() if v > 0}
    out = []

    def use(made: dict[int, int], times: int) -> None:
        out.append((times, made))
        for k, v in made.items():
            left[k] -= v * times

    if window in left:
        use({window: 1}, left[window])
        del left[window]
    # what rounding leaves is solved for again while that places a share worth the while
    for _ in range(ROUNDS):
        left = {k: v for k, v in left.items() if v}
        before = sum(left.values())
        made = combinations(left, window)
        if not made:
            break
        x = nonnegative_least_squares(made, left)
        for j in np.argsort(-x, kind="stable").tolist():
            if x[j] < 0.5:
                break
            if times := min(round(x[j]), *(left[k] // v for k, v in made[j].items())):
                use(made[j], times)
        if before - sum(left.values()) < SHARE * before:
            break
    present = sorted(k for k, v in left.items() if v)
    while present:
        room, made = window, {}
        i = len(present)
        while room and i:
            i = bisect.bisect_right(present, room, 0, i)
            if i:
                k = present[i - 1]
                made[k] = n = min(room // k, left[k])
                room -= n * k
                i -= 1
        use(made, min(left[k] // v for k, v in made.items()))
        present = [k for k in present if left[k]]
    return out


def places(planned: list[tuple[int, dict[int, int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: from which number on, which first sequence, first offset and pieces in a sequence hold."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for times, made in planned:
        offset = 0
        for k, v in sorted(made.items(), reverse=True):
            rows.setdefault(k, []).append((used.get(k, 0), first, offset, v))
            used[k] = used.get(k, 0) + times * v
            offset += k * v
        first += times
    return {k: tuple(np.array(c, dtype=np.int64) for c in zip(*v, strict=True)) for k, v in rows.items()}


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with_ids: and its ids as bytes."""
    own = written(pieces(docs, tokenizer, window, end_id, with_ids), "pieces")
    counts = own.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = written(counts, "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = places(plan(histogram, window))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    numbered = own.join(counts.select("length", "part", before.alias("before")), ["length", "part"])
    numbered = numbered.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("nth")).alias("n"), *["ids"] * with_ids)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, n = batch.column("length").to_numpy(), batch.column("n").to_numpy()
            sequence, offset = np.zeros_like(n), np.zeros_like(n)
            for k in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == k)
                since, first, shift, each = where[k]
                i = np.searchsorted(since, n[at], side="right") - 1
                own = n[at] - since[i]
                sequence[at], offset[at] = first[i] + own // each[i], shift[i] + own % each[i] * k
            cols = [batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")] + [pa.array(sequence), pa.array(offset)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays(cols + [batch.column(c) for c in ["ids"] * with_ids], names=names + ["ids"] * with_ids)

    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return numbered.mapInArrow(placed, kinds + ", ids binary" * with_ids)
