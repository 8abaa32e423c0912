"""Toxicity: cumulative-link ordinal regression on sparse text features.

Features are word beginnings and whole words, by whether they occur once and more than once, chosen
by their association with the label. Grades are ordered: 0 not toxic, then toxic documents by how
dense their markers are. All thresholds share the weights: P(grade <= k) = s(threshold_k - w x). A
document gets its expected severity, its grade and whether it is toxic at all.

The fit takes at most MOST_LABELS labelled rows, chosen by hash of the identifier, and the MOST_FEATURES
word features that go most with the label, three numbers each; every document is scored, on its whole
text. Defined results: a null text counts as empty; repeated rows score alike;
labels that are null count as missing; without labels of both kinds no document is toxic; an empty
table gives an empty result; further columns take no part.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import id_and_text
from millrace.llm.quality import labelled

#: Bounds of the fit: labelled rows, and the word features taken of all that go with the label; a feature's least documents, and its least association for each toxic one.
MOST_LABELS, MOST_FEATURES, LEAST_DOCS, LEAST_LIFT = 8_000, 512, 3, 0.02
#: Lengths of word beginnings; the ridge; words whose features a worker remembers, and keys that it counts before it passes them on.
BEGINNINGS, RIDGE, REMEMBERED, HELD = range(3, 9), 0.02, 300_000, 100_000
_WORD = re.compile(r"\w+")


def keys(word: str) -> list[str]:
    """The features of a word: its beginnings and, marked, itself."""
    return [word[:k] for k in BEGINNINGS if len(word) >= k] + [f"{word}$"]


class Scan:
    """Counts of chosen keys in a text, remembering the keys of each word."""

    def __init__(self, place: dict[str, int]) -> None:
        class Known(dict):
            def __missing__(self, word: str) -> tuple[int, ...]:
                if len(self) > REMEMBERED:
                    self.clear()
                self[word] = found = tuple(place[k] for k in keys(word) if k in place)
                return found

        self.known = Known()

    def __call__(self, text: str) -> tuple[Counter, int]:
        words = _WORD.findall(text.lower())
        return Counter(i for found in map(self.known.__getitem__, words) if found for i in found), len(words)


def _values(count: int, words: int) -> tuple[float, float, float]:
    """The features of a key: that it occurs, how often beyond once, and its share of the words, in hundredths, up to 5."""
    return 1.0, math.log2(count), min(5.0, 100 * count / words)


def _row(counts: Counter, words: int, size: int) -> np.ndarray:
    x = np.zeros(3 * size, dtype=np.float32)
    for i, c in counts.items():
        x[i], x[size + i], x[2 * size + i] = _values(c, words)
    return x


def fit(x: np.ndarray, y: np.ndarray, grades: int, ridge: float = RIDGE, steps: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """Weights and rising thresholds, by accelerated gradient steps on the mean negative log likelihood."""
    n, d = x.shape
    share = np.clip(np.array([(y <= k).mean() for k in range(grades - 1)]), 1e-3, 1 - 1e-3)
    cuts = np.log(share / (1 - share))
    # thresholds as the first one and logarithms of the gaps
    z = np.concatenate([np.zeros(d), cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-2))])
    s = lambda v: 1 / (1 + np.exp(-np.clip(v, -30, 30)))
    v = np.ones(d, dtype=x.dtype)
    for _ in range(20):  # the largest curvature of the features
        v = x.T @ (x @ (v / max(1e-9, float(np.linalg.norm(v)))))
    rate = 1.0 / (1.0 + float(np.linalg.norm(v)) / n)  # the thresholds have a curvature of their own
    old, momentum = z.copy(), 0.9
    low, high = y - 1, y
    for _ in range(steps):
        look = z + momentum * (z - old)
        w, gaps = look[:d], np.exp(np.clip(look[d + 1 :], -10, 5))
        cuts = np.concatenate([[-np.inf], look[d] + np.append(0, np.cumsum(gaps)), [np.inf]])
        score = (x @ w.astype(x.dtype)).astype(float)
        a, b = s(cuts[low + 1] - score), s(cuts[high + 1] - score)
        p = np.maximum(b - a, 1e-9)
        da, db = -a * (1 - a) / p, b * (1 - b) / p
        by_cut = np.bincount(low + 1, da, grades + 1) + np.bincount(high + 1, db, grades + 1)
        inner = by_cut[1:grades]
        grad = np.concatenate([x.T @ (-(da + db)).astype(x.dtype), [inner.sum()], gaps * np.cumsum(inner[::-1])[::-1][1:]]) / n
        grad[:d] -= ridge / math.sqrt(n) * look[:d]
        old, z = z, look + rate * grad
    return z[:d], z[d] + np.append(0, np.cumsum(np.exp(np.clip(z[d + 1 :], -10, 5))))


def _association(sample: DataFrame) -> list[str]:
    """The keys whose presence, or repeated presence, goes most with the label."""

    def told(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["key", "n0", "n1", "m0", "m1"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, list[int]] = {}
        docs = [0, 0]
        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("y").to_pylist(), strict=True):
                y = int(label > 0)
                docs[y] += 1
                for key, c in Counter(k for w in _WORD.findall(text.as_py().lower()) for k in keys(w)).items():
                    row = totals.setdefault(key, [0, 0, 0, 0])
                    row[y] += 1
                    row[2 + y] += c > 1
                if len(totals) > HELD:
                    yield told([(k, *v) for k, v in totals.items()])
                    totals.clear()
        yield told([("", *docs, *docs)] + [(k, *v) for k, v in totals.items()])

    sums = sample.mapInArrow(counted, "key string, n0 long, n1 long, m0 long, m1 long").groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "m0", "m1")])
    sums = sums.where((F.col("n1") >= LEAST_DOCS) | (F.col("key") == "")).persist()
    total = sums.where("key = ''").first()
    if not total or not total["n0"] or not total["n1"]:
        sums.unpersist()
        return []

    def lift(pos: str, neg: str):
        return F.col(pos) * (F.log((F.col(pos) + 0.5) / (total["n1"] + 1)) - F.log((F.col(neg) + 0.5) / (total["n0"] + 1)))

    best = sums.where("key <> ''").select("key", F.greatest(lift("n1", "n0"), lift("m1", "m0")).alias("lift")).where(F.col("lift") > LEAST_LIFT * total["n1"])
    out = [r["key"] for r in best.orderBy(F.desc("lift"), "key").limit(MOST_FEATURES).collect()]
    sums.unpersist()
    return out


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """A row for each document: doc_id, toxic, severity (expected grade), grade, p_toxic."""
    own = id_and_text(docs)
    sample = own.join(F.broadcast(labelled(labels, label, MOST_LABELS)), "doc_id").select("text", "y")
    chosen = _association(sample)
    place = {k: i for i, k in enumerate(chosen)}
    weights, cuts = np.zeros(3 * len(chosen)), np.array([np.inf])
    if chosen:

        def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scan = Scan(place)
            for batch in batches:
                found = [scan(x.as_py()) for x in batch.column("text")]
                yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array([n for _, n in found], pa.int64()), pa.array([[*c.keys()] for c, _ in found], pa.list_(pa.int64())), pa.array([[*c.values()] for c, _ in found], pa.list_(pa.int64()))], names=["y", "n", "at", "c"])

        rows = sample.mapInArrow(scanned, "y int, n long, at array<long>, c array<long>").toPandas()
        counts = [Counter(dict(zip(a, c, strict=True))) for a, c in zip(rows["at"], rows["c"], strict=True)]
        x = np.stack([_row(c, n, len(chosen)) for c, n in zip(counts, rows["n"], strict=True)])
        y = (rows["y"].to_numpy() > 0).astype(int)
        dense = np.array([sum(c.values()) / max(1, n) for c, n in zip(counts, rows["n"], strict=True)])
        y[(y > 0) & (dense > np.median(dense[y > 0]))] = 2
        weights, cuts = fit(x, y, int(y.max()) + 1)

    def graded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, size = Scan(place), len(place)
        for batch in batches:
            raw = np.zeros(batch.num_rows)
            for j, text in enumerate(batch.column("text")):
                counts, n = scan(text.as_py())
                raw[j] = sum(float(weights[i::size] @ _values(c, n)) for i, c in counts.items())
            above = 1 - 1 / (1 + np.exp(-np.clip(cuts[None, :] - raw[:, None], -30, 30))) if np.isfinite(cuts).all() else np.zeros((len(raw), 1))
            cols = [above[:, 0] >= 0.5, above.sum(axis=1), (above >= 0.5).sum(axis=1).astype(np.int32), above[:, 0]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, cols)], names=["doc_id", "toxic", "severity", "grade", "p_toxic"])

    return own.mapInArrow(graded, "doc_id long, toxic boolean, severity double, grade int, p_toxic double")
