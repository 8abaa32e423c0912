"""SimHash near-dedup by the generalised pigeonhole principle.

A text's fingerprint has 64 bits, each the majority among the hashes of its shingles. Two
fingerprints that differ in at most a radius of bits must, for any split of the bits into partitions with
thresholds whose (threshold + 1) add up to the radius and one, agree in some partition up to its threshold.
Bits that go together are put into the same partition; the number of partitions and their unequal
thresholds come from a dynamic programme over estimated candidate counts, which grow with the number
of fingerprints: the larger the table, the fewer and longer the keys. Each distinct fingerprint is
listed under its bits in each partition, probes all keys within the threshold, and what meets is
verified on all 64 bits.

Texts with equal fingerprints are one node. A key under which many fingerprints meet is split into
blocks, and pairs of blocks are compared in tasks of their own, which report only links that join
what they have not joined yet; so no group, however large, ends in one task or makes all its pairs.
Components are found on the links as a table.

Defined results: a null text, or one without words, has fingerprint zero and links like any other;
texts with fewer words than a shingle are one shingle; null identifiers take part, and a component
of nulls alone has a null identifier; an empty table gives an empty result; further columns and
repeated rows do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial
from itertools import combinations, islice
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import LAST, id_and_text, written
from millrace.llm.components import components

BITS, RADIUS, SEED = 64, 3, 42
#: Fingerprints of a block, where a key has more; members up to which a group's links are all reported.
BLOCK, SMALL = 1024, 24
#: What listing or probing a key costs, in candidates verified: microseconds of shuffling and sorting, against nanoseconds in an array.
ROW = 500
_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_digest = partial(xxhash.xxh64_digest, seed=SEED)

# ---------------------------------------------------------------- fingerprints


def fingerprint(text: str, words: int = 3) -> int:
    """Lower-cases A-Z, splits at ASCII white space; a bit is set if more than half of the shingles' hashes have it."""
    found = text.encode().lower().split()
    if not found:
        return 0
    shingles = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False)) if len(found) > words else iter([b" ".join(found)])
    total, counts = 0, np.zeros(BITS, dtype=np.int64)
    while block := b"".join(map(_digest, islice(shingles, 65536))):
        hashes = np.frombuffer(block, dtype=np.uint8).reshape(-1, 8)
        total += len(hashes)
        if len(hashes) < 256:
            counts += np.unpackbits(hashes, axis=1).sum(axis=0, dtype=np.int64)
        else:
            counts += np.concatenate([np.bincount(hashes[:, i], minlength=256) @ _OF_BYTE for i in range(8)])
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def fingerprints(docs: DataFrame, *words: int) -> DataFrame:
    """doc_id, text_hash and fps: a fingerprint for each length of shingles, as a signed long."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([[fingerprint(text, w) for w in words] for text in (x.as_py() for x in batch.column("text"))], dtype=np.uint64).reshape(-1)
            fps = pa.FixedSizeListArray.from_arrays(pa.array(found.view(np.int64)), len(words)).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), fps], names=["doc_id", "text_hash", "fps"])

    return id_and_text(docs).withColumn("text_hash", F.xxhash64("text")).mapInArrow(each, "doc_id long, text_hash long, fps array<long>")


# ---------------------------------------------------------------- partitions and thresholds


def joint(rows: DataFrame, fingerprints: int = 1) -> list[tuple[int, np.ndarray]]:
    """rows: fps. For each fingerprint over all rows: their number, and how many have both bits i and j, from sums over parts of the table."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((fingerprints, BITS, BITS), dtype=np.int64)
        for batch in batches:
            fps = batch.column("fps").flatten().to_numpy().reshape(-1, fingerprints)
            for k in range(fingerprints):
                bits = np.unpackbits(fps[:, k].astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
                both[k] += (bits.T @ bits).astype(np.int64)
            n += len(fps)
        if n:
            i, j = np.triu_indices(BITS)
            for k in range(fingerprints):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i) + 1, k)), pa.array(np.append(i, -1)), pa.array(np.append(j, -1)), pa.array(np.append(both[k][i, j], n))], names=["k", "i", "j", "n"])

    both, n = np.zeros((fingerprints, BITS, BITS)), 0
    for r in rows.select("fps").mapInArrow(counted, "k long, i long, j long, n long").groupBy("k", "i", "j").agg(F.sum("n").alias("n")).collect():
        if r["i"] < 0:
            n = r["n"]
        else:
            both[r["k"], r["i"], r["j"]] = both[r["k"], r["j"], r["i"]] = r["n"]
    return [(n, x) for x in both]


def grouped_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """The bits in so many partitions of equal width, bits that correlate together."""
    share = np.diag(both) / n
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    together = np.abs((both / n - np.outer(share, share)) / np.outer(spread, spread))
    free, out = list(range(BITS)), []
    for k in range(parts, 0, -1):
        width = len(free) // k
        group = [max(free, key=lambda b: sum(together[b, x] for x in free if x != b))]
        while len(group) < width:
            group.append(max((b for b in free if b not in group), key=lambda b: sum(together[b, x] for x in group)))
        free = [b for b in free if b not in group]
        out.append(sorted(group))
    return out


def thresholds(n: int, share: np.ndarray, groups: list[list[int]], radius: int = RADIUS, row: float = ROW) -> tuple[float, list[int]]:
    """The cost and thresholds, -1 for none, of a split of the bits: rows listed and probed and candidates verified, as estimated."""
    differ = 2 * share * (1 - share)
    costs = []
    for group in groups:
        near = np.array([1.0])  # chances that two fingerprints differ in 0, 1, ... bits of the group
        for b in group:
            near = np.append(near * (1 - differ[b]), 0) + np.append(0, near * differ[b])
        ball = [sum(comb(len(group), k) for k in range(t + 1)) for t in range(radius + 1)]
        costs.append([0.0] + [row * n * ball[t] + n * n / 2 * near[: t + 1].sum() for t in range(radius + 1)])  # by threshold + 1
    best = {0: (0.0, [])}
    for by_limit in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for extra in range(radius + 2 - used):
                if used + extra not in new or cost + by_limit[extra] < new[used + extra][0]:
                    new[used + extra] = (cost + by_limit[extra], [*chosen, extra - 1])
        best = new
    return best[radius + 1]


def chosen(n: int, both: np.ndarray, radius: int = RADIUS, row: float = ROW) -> list[tuple[list[int], int]]:
    """The partitions that are used, with their thresholds."""
    splits = []
    for parts in range(1, radius + 2):
        groups = grouped_bits(n, both, parts)
        cost, limits = thresholds(n, np.diag(both) / n, groups, radius, row)
        splits.append((cost, parts, groups, limits))
    _, _, groups, limits = min(splits, key=lambda x: x[:2])
    return [(g, t) for g, t in zip(groups, limits, strict=True) if t >= 0]


# ---------------------------------------------------------------- probe and verify


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _key(part: int, sig):
    return lambda flip: F.struct(F.lit(part).alias("part"), sig.bitwiseXOR(flip).alias("sig"), (flip != 0).alias("probe"))


def keys(fp, split: list[tuple[list[int], int]]):
    """An array of the keys of a column of fingerprints: part, sig; probe: whether the key is one that it looks up and isn't listed under."""
    each = []
    for i, (bits, limit) in enumerate(split):
        masks = [1 << (BITS - 1 - b) for b in bits]
        flips = [sum(c) for k in range(limit + 1) for c in combinations(masks, k)]
        own = F.array(*[F.lit(_signed(x)).cast("long") for x in flips])
        each.append(F.transform(own, _key(i, fp.bitwiseAND(F.lit(_signed(sum(masks)))))))
    return F.concat(*each)


def _joined(rows: np.ndarray, fp: np.ndarray, probe: np.ndarray, block: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one large group that connect all that its links connect, one for each member at most."""
    fp, probe, block = fp[rows], probe[rows], block[rows]
    apart = (block[:, None] != block[None, :]) if (block != block[0]).any() else True
    near = (np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius) & ~(probe[:, None] & probe[None, :]) & apart
    np.fill_diagonal(near, False)
    free, a, b = np.ones(len(rows), dtype=bool), [], []
    for s in range(len(rows)):
        if not free[s]:
            continue
        free[s], edge = False, np.array([s])
        while len(edge):
            edge = np.flatnonzero(near[edge].any(axis=0) & free)
            free[edge] = False
            a.append(np.full(len(edge), fp[s]))
            b.append(fp[edge])
    return np.concatenate(a), np.concatenate(b)


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    names = ["part", "sig", "low", "high", "block", "probe", "fp"]

    def of(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        part, sig, low, high, block, probe, fp = cols
        fp, probe = fp.view(np.uint64), probe.astype(bool)
        n = len(fp)
        new = np.append(True, (part[1:] != part[:-1]) | (sig[1:] != sig[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]))
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, n))
        end, last = np.repeat(start + size, size), np.repeat(size, size)
        a, b = [], []
        at = np.flatnonzero(last <= SMALL)
        for d in range(1, SMALL):
            at = at[at + d < end[at]]
            if not len(at):
                break
            to = at + d
            ok = (np.bitwise_count(fp[at] ^ fp[to]) <= radius) & ~(probe[at] & probe[to]) & ((low[at] == high[at]) | (block[at] != block[to]))
            a.append(fp[at[ok]])
            b.append(fp[to[ok]])
        for s, k in zip(start[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
            x, y = _joined(np.arange(s, s + k), fp, probe, block, radius)
            a.append(x)
            b.append(y)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.uint64).view(np.int64)) for x in (a, b)], names=["a", "b"])

    carry = None
    for batch in batches:
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        if carry is not None:
            cols = [np.concatenate(x) for x in zip(carry, cols, strict=True)]
        n = len(cols[0])
        if not n:
            continue
        other = (cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]) | (cols[2] != cols[2][-1]) | (cols[3] != cols[3][-1])
        cut = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
        carry = [c[cut:] for c in cols]
        if cut:
            yield from of([c[:cut] for c in cols])
    if carry is not None and len(carry[0]):
        yield from of(carry)


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all that differ in at most radius bits."""
    ((n, both),) = joint(fps.select(F.array("fp").alias("fps")))
    if not n:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    listed = fps.select("fp", F.explode(keys(F.col("fp"), chosen(n, both, radius))).alias("k")).select("fp", "k.*")
    large = listed.groupBy("part", "sig").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    blocks = F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("int")
    rows = listed.join(large, ["part", "sig"], "left").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("part", "sig", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "probe", "fp")
    return rows.repartition("part", "sig", "low", "high").sortWithinPartitions("part", "sig", "low", "high").mapInArrow(partial(_links, radius=radius), "a long, b long")


def grouped(docs: DataFrame, rules: Sequence[tuple[int, int]]) -> tuple[DataFrame, DataFrame]:
    """By rules (words of a shingle, radius), of which any one links two texts.

    Returns the documents (doc_id, text_hash, fps, node) and, for each node, the identifier and text
    hash of its component's first document.
    """
    own = written(fingerprints(docs, *[w for w, _ in rules]), "fingerprints")
    # with several rules, each has nodes of its own, and a document ties its nodes together
    node = lambda i: F.concat(F.lit(f"{i}:"), F.col("fps")[i].cast("string")) if len(rules) > 1 else F.col("fps")[i]
    found = None
    for i, (_, radius) in enumerate(rules):
        fps = written(own.select(F.col("fps")[i].alias("fp")).distinct(), "nodes")
        new = links(fps, radius)
        if len(rules) > 1:
            new = new.select(*[F.concat(F.lit(f"{i}:"), F.col(c).cast("string")).alias(c) for c in ("a", "b")])
        if i:
            new = new.unionByName(own.select(node(0).alias("a"), node(i).alias("b")).distinct())
        found = new if found is None else found.unionByName(new)
    of = components(found)
    own = own.withColumn("node", node(0))
    first = own.groupBy(F.col("node").alias("own")).agg(F.min(F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("id"), F.col("text_hash").alias("hash"))).alias("first"))
    rooted = written(first.join(of, first["own"] == of["node"], "left").select("own", "first", F.coalesce("root", "own").alias("root")), "rooted")
    return own, rooted.select("own", "root").join(rooted.groupBy("root").agg(F.min("first").alias("first")), "root").select(F.col("own").alias("node"), "first")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = RADIUS) -> DataFrame:
    """A row for each document: doc_id, fingerprint (hexadecimal), component_id, the smallest doc_id that links reach."""
    own, of = grouped(docs, [(words, radius)])
    return own.join(of, "node").select("doc_id", F.lower(F.lpad(F.hex(F.col("fps")[0]), 16, "0")).alias("fingerprint"), F.nullif(F.col("first.id"), F.lit(LAST)).alias("component_id"))
