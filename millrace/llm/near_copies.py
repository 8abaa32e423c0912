"""Near copies: operator 1's split of several SimHash fingerprints finds candidates, exact similarity decides.

A text is the set of its five-word shingles; two texts are near copies if their sets have a Jaccard
similarity of at least LEAST, and near copies of near copies go together. A set has some 64-bit SimHash
fingerprints. Each is split by the generalised pigeonhole principle as in operator 1: bits that go
together are put into the same partition, and thresholds come from its dynamic programme over estimated
candidate counts. A text is listed under its bits in each partition and probes the keys within the
threshold. Fingerprints that differ in at most the radius of the split must meet; those of near copies
often differ in more and meet by chance in some partition of some fingerprint, so there are as many
fingerprints as keep the chance that they never meet to MISSED: a pair of similarity LEAST differs in a
share DIFFER of its bits; the more alike, the rarer. What meets is verified on all bits of the first
PROBED fingerprints, and is a candidate at RADIUS or less. The components of candidates bound where near
copies can be: within each of these the similarity of every pair is computed on the shingles themselves,
and only pairs that reach LEAST are links.

Texts with equal sets are one node. Keys and components with many nodes are split into blocks, and
pairs of blocks are compared in tasks of their own, which report only links that join what they have
not joined yet.

Defined results: words are split at ASCII white space, A-Z in lower case; texts with fewer words than a
shingle are one shingle; null texts and those without words are alike; null identifiers come last; an
empty table gives an empty result; further columns and repeated rows do no harm.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import key_filter, maybe_in, row_key, spread_join, without, written
from millrace.llm.components import components, reduced
from millrace.llm.simhash import BITS, chosen, joint, keys, thresholds

LEAST, SHINGLE, SEED = 0.8, 5, 42
#: Share of bits in which texts at LEAST differ, and chance that they meet under no key.
DIFFER, MISSED = 0.15, 0.0075
#: Texts for which keys are planned at least, so that smaller tables don't get others, and what a row costs, in candidates verified.
PLANNED, ROW = 1 << 18, 100
#: Fingerprints of which a candidate may differ in RADIUS bits.
PROBED, RADIUS = 3, 56
#: Nodes of a block, of a key and of a component; shingles that are compared at once; nodes up to which all groups are compared together.
BLOCK, EXACT_BLOCK, AT_ONCE, SMALL = 1024, 256, 4096, 128

Split = list[tuple[list[int], int]]


def missed(split: Split) -> float:
    """The chance that fingerprints of texts at LEAST meet in no partition of a split."""
    return math.prod(1 - sum(math.comb(len(g), k) * DIFFER**k * (1 - DIFFER) ** (len(g) - k) for k in range(limit + 1)) for g, limit in split)


def shape(n: int) -> tuple[int, int]:
    """Fingerprints of a text and the radius of their splits, for so many texts: what costs least, were bits independent."""
    found = []
    for radius in range(1, 8):
        ways = []
        for parts in range(1, radius + 2):
            groups = [x.tolist() for x in np.array_split(np.arange(BITS), parts)]
            cost, limits = thresholds(max(n, PLANNED), np.full(BITS, 0.5), groups, radius, ROW)
            ways.append((cost, [(g, t) for g, t in zip(groups, limits, strict=True) if t >= 0]))
        cost, split = min(ways, key=lambda x: x[0])
        fingerprints = max(PROBED, math.ceil(math.log(MISSED) / math.log(missed(split))))
        found.append((fingerprints * cost, fingerprints, radius))
    return min(found)[1:]


def splits(counts: list[tuple[int, np.ndarray]], radius: int) -> list[Split]:
    """Operator 1's split for each fingerprint; a larger radius where those found would miss more than MISSED."""
    times = max(1, PLANNED / counts[0][0])
    while True:
        found = [chosen(n * times, both * times, radius, ROW) for n, both in counts]
        if math.prod(map(missed, found)) <= MISSED:
            return found
        radius += 1


def shingles(text: str) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    words = text.encode().lower().split()
    runs = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)) if len(words) > SHINGLE else [b" ".join(words)]
    return np.unique(np.frombuffer(b"".join(xxhash.xxh64_digest(x, seed=SEED) for x in runs), dtype=">u8").astype(np.uint64))


def _bits(hashes: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """64 bits for each hash and salt."""
    x = hashes[:, None] + salts
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.unpackbits((x ^ (x >> np.uint64(31))).view(np.uint8), axis=1)


def sketch(hashes: np.ndarray, fingerprints: int) -> np.ndarray:
    """The bits that more than half of the hashes have; the smallest hash decides ties."""
    salts = (np.arange(fingerprints, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
    counts = np.zeros(64 * fingerprints, dtype=np.int64)
    for i in range(0, len(hashes), 255):
        counts += _bits(hashes[i : i + 255], salts).sum(axis=0, dtype=np.uint8)
    return 2 * counts + _bits(hashes[:1], salts)[0] > len(hashes)


def _sketches(fingerprints: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, fps = [], [np.zeros(0, np.int64)]
            for text in batch.column("text"):
                own = shingles(text.as_py())
                nodes.append(xxhash.xxh64_intdigest(own.tobytes()) - 2**63)
                fps.append(np.packbits(sketch(own, fingerprints)).view(np.int64))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(fps)), fingerprints).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("hash"), pa.array(nodes, pa.int64()), lists], names=["id", "hash", "node", "fps"])

    return run


def _keyed(first: DataFrame, found: list[Split]) -> DataFrame:
    """Each node under the keys of all its fingerprints; the same hash for two keys only adds candidates."""

    def own(i: int):
        return F.transform(keys(F.col("fps")[i], found[i]), lambda k: F.struct(F.xxhash64(F.lit(i), k["part"], k["sig"]).alias("key"), k["probe"].alias("probe")))

    every = first.select("node", *[F.col("fps")[i].alias(f"f{i}") for i in range(PROBED)], F.explode(F.concat(*map(own, range(len(found))))).alias("k"))
    return every.select("k.key", "node", "k.probe", *[f"f{i}" for i in range(PROBED)])


def _spanning(near: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all that near connects: from each node to the least of what it is connected to, so that groups with the same members give the same links."""
    order = np.argsort(nodes, kind="stable")
    near = near[order][:, order]
    free, a, b = near.any(axis=1), [], []
    for s in np.flatnonzero(free).tolist():
        if free[s]:
            free[s], edge = False, np.array([s])
            while len(edge):
                edge = np.flatnonzero(near[edge].any(axis=0) & free)
                free[edge] = False
                a.append(edge)
                b.append(np.full(len(edge), s))
    none = [np.zeros(0, np.int64)]
    return nodes[order][np.concatenate(a or none)], nodes[order][np.concatenate(b or none)]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each (key, low, high), from rows sorted by these."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy() for c in ("key", "low", "high")])
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and tuple(key[:, a]) != last:
                yield pa.concat_batches(held)
                held = []
            last = tuple(key[:, a])
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.concat_batches(held)


def _key_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between nodes of a (key, low, high), of which one is listed, that differ in at most RADIUS bits, from rows sorted by these; of a group of up to SMALL nodes all at once for all groups."""
    names = ["key", "low", "high", "block", "probe", "node", *[f"f{i}" for i in range(PROBED)]]

    def of(key, low, high, block, probe, node, *fps) -> pa.RecordBatch:
        fps = [x.view(np.uint64) for x in fps]
        new = np.append(True, (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]))
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(key)))
        end, last = np.repeat(start + size, size), np.repeat(size, size)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        at = np.flatnonzero(last <= SMALL)
        for d in range(1, SMALL):
            at = at[at + d < end[at]]
            if not len(at):
                break
            differ = sum(np.bitwise_count(x[at] ^ x[at + d]).astype(np.int16) for x in fps)
            ok = at[(differ <= RADIUS) & ((low[at] == high[at]) | (block[at] != block[at + d])) & ~(probe[at] & probe[at + d])]
            a.append(node[ok])
            b.append(node[ok + d])
        for s, k in zip(start[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
            own = slice(s, s + k)
            near = sum(np.bitwise_count(x[own][:, None] ^ x[own][None, :]).astype(np.int16) for x in fps) <= RADIUS
            near &= ~(probe[own][:, None] & probe[own][None, :])
            np.fill_diagonal(near, False)
            if low[s] != high[s]:
                near &= block[own][:, None] != block[own][None, :]
            for out, x in zip((a, b), _spanning(near, node[own]), strict=True):
                out.append(x)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b)], names=["a", "b"])

    carry = None
    for batch in batches:
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        if carry is not None:
            cols = [np.concatenate(x) for x in zip(carry, cols, strict=True)]
        if len(cols[0]):
            other = (cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]) | (cols[2] != cols[2][-1])
            cut = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
            carry = [c[cut:] for c in cols]
            if cut:
                yield of(*(c[:cut] for c in cols))
    if carry is not None and len(carry[0]):
        yield of(*carry)


def _near_sets(group: pa.RecordBatch) -> np.ndarray:
    col = group.column("shingles")
    flat, sizes = col.flatten().to_numpy(), col.value_lengths().to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    rank = np.cumsum(np.append(False, flat[1:] != flat[:-1]))
    both = np.zeros((len(sizes), len(sizes)))
    for k in range(0, int(rank[-1]) + 1, AT_ONCE):
        x, y = np.searchsorted(rank, [k, k + AT_ONCE])
        has = np.zeros((len(sizes), min(AT_ONCE, int(rank[-1]) + 1 - k)), dtype=np.float32)
        has[owner[x:y], rank[x:y] - k] = 1
        both += has @ has.T
    return both >= LEAST * (sizes[:, None] + sizes[None, :] - both) - 1e-9


def _set_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the nodes of a (key, low, high) whose sets are near."""
    for group in _groups(batches):
        if group.num_rows > 1:
            near, block = _near_sets(group), group.column("block").to_numpy()
            np.fill_diagonal(near, False)
            if (block != block[0]).any():
                near &= block[:, None] != block[None, :]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _spanning(near, group.column("node").to_numpy())], names=["a", "b"])


def _links(rows: DataFrame, size: int, linked) -> DataFrame:
    """rows: key, node and what linked reads. Links (a, b) that join the nodes of a key that it finds near, reduced by tasks."""
    # written, so that Spark knows how few these are, and where they are few doesn't shuffle the rows to find their blocks
    large = written(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > size), "large")
    blocks = F.coalesce(F.ceil(F.col("n") / size), F.lit(1)).cast("int")
    rest = [c for c in rows.columns if c != "key"]
    dealt = rows.join(large, "key", "left").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(F.col("key").cast("long").alias("key"), F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", *rest)
    return dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(lambda batches: reduced(linked(batches)), "a long, b long")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = pa.array([shingles(t.as_py()).view(np.int64) for t in batch.column("text")], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("node"), own], names=["key", "node", "shingles"])


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs that come first among their near copies, one of each, with all their columns."""
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = docs.select(*[c.alias(n) for c, n in zip(row_key(), ("id", "hash"), strict=True)], text.alias("text"))
    fingerprints, radius = shape(docs.count())
    own = written(plain.mapInArrow(_sketches(fingerprints), "id long, hash long, node long, fps array<long>"), "sketches")
    first = own.groupBy("node").agg(F.min(F.struct("id", "hash")).alias("first"), F.count("*").alias("n"), F.first("fps").alias("fps"))
    first = written(first, "nodes")
    counts = joint(first, fingerprints)
    if not counts[0][0]:
        return docs
    near = components(_links(_keyed(first, splits(counts, radius)), BLOCK, _key_links), are_reduced=True)
    near = near.unionByName(near.select(F.col("root").alias("node"), "root").distinct())
    # of each node, a text to take its shingles from
    asked = written(first.join(near, "node").select(F.col("root").alias("key"), "node", "first.id", "first.hash"), "candidates")
    sets = maybe_in(plain, key_filter(asked, ["id", "hash"]), ["id", "hash"]).join(asked, ["id", "hash"]).select("key", "node", "text").dropDuplicates(["node"]).mapInArrow(_hashed, "key long, node long, shingles array<long>")
    copies = components(_links(written(sets, "shingles"), EXACT_BLOCK, _set_links), are_reduced=True)
    # the groups of several rows: nodes that are linked, and nodes of several rows
    root = first.join(copies, "node", "left").select("node", "first", "n", F.coalesce("root", "node").alias("root"))
    groups = root.groupBy("root").agg(F.min("first").alias("least"), F.sum("n").alias("rows")).where("rows > 1")
    several = written(root.join(groups, "root").select("node", "n", F.col("least.id").alias("least_id"), F.col("least.hash").alias("least_hash")), "groups")
    seen = spread_join(own.select("id", "hash", "node"), several, ["node"], "n")
    return without(docs, seen.select("id", "hash", (F.col("id").eqNullSafe(F.col("least_id")) & (F.col("hash") == F.col("least_hash"))).alias("stays")))
