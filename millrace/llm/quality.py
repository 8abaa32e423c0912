"""Quality classifier: a document's own evidence, and its site's, by hierarchical empirical Bayes.

A logistic regression on a few shares of a text (capitals, marked words, repeats and the like) is
fitted on labelled documents. Its probabilities are summed by host and by path within host; a host's
share of good documents is shrunk to the global share, a path's to its host's, the more the fewer
documents there are, with prior strengths estimated from how much sites differ. A document's score is
its own logit plus a part of its path's posterior logit, itself left out, against the global one.

The fit takes at most MOST_LABELS labelled rows, chosen by hash of the identifier; all sums cover all
documents. Defined results: a null text counts as empty; null hosts and paths are sites of their own;
repeated rows score alike; labels that are null count as missing, and of several the smallest holds;
without labels of both kinds every document is kept, at score 1; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import written

MOST_LABELS, RIDGE, SITE_WEIGHT, KEEP = 20_000, 1.0, 0.5, 0.5
FEATURES = ("capitals", "marked", "bars", "digits", "other", "repeats", "fresh", "lines_again", "width", "words")

_CAPITALS, _SMALL, _DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
_COMMON = _CAPITALS + _SMALL + _DIGITS + b" \t\n\r\x0b\x0c.,;:'\"()-?" + bytes(range(128, 256))
_MARKED = re.compile(rb"[!$%&*#@^~=+<>|\\/]+(?=[.,]?(?:[\x20\x09-\x0D]|\Z))")


def features(text: bytes) -> tuple[float, ...]:
    words = text.split()
    n = max(1, len(words))
    without = lambda drop: len(text) - len(text.translate(None, drop))
    capitals, small = without(_CAPITALS), without(_SMALL)
    lines = [x for x in text.split(b"\n") if x]
    return (
        capitals / max(1, capitals + small),
        math.sqrt(len(_MARKED.findall(text)) / n),
        math.sqrt(text.count(b"|") / n),
        without(_DIGITS) / max(1, len(text)),
        math.sqrt((len(text) - without(_COMMON)) / max(1, len(text))),
        math.sqrt(sum(map(eq, words, words[1:])) / n),
        len(set(words)) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        min(20.0, len(text) / n) / 10,
        math.log1p(len(words)) / 10,
    )


def _measured(docs: DataFrame, host: str, path: str, whole: bool) -> DataFrame:
    """doc_id, host, path and the features x of each document; whole: and doc, all its columns."""
    kinds = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("host", T.StringType()), T.StructField("path", T.StringType())])
    if whole:
        kinds.add("doc", docs.schema)
    names = [f.name for f in kinds]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("doc").field("text") if whole else batch.column("text")
            found = np.array([features(memoryview(x.as_buffer()).tobytes() if x.is_valid else b"") for x in texts], dtype=np.float64).reshape(-1, len(FEATURES))
            own = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), own], names=[*names, "x"])

    text = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc") if whole else F.col("text")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), text)
    return own.mapInArrow(each, T.StructType([*kinds.fields, T.StructField("x", T.ArrayType(T.DoubleType()))]))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights of the features and, last, the constant, by iterated least squares."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, pull = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, ridge), 1e-6)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull + 1e-9), x.T @ (y - p) - pull * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def labelled(labels: DataFrame, column: str, most: int) -> DataFrame:
    """doc_id and y of at most about so many labelled rows, chosen by hash."""
    own = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col(column).cast("int")).alias("y"))
    n = own.count()
    return own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, most / max(1, n))))


def _strength(groups: DataFrame, mean: str) -> float:
    """The weight of the prior, in documents, from how far the groups' shares are from what they are shrunk to."""
    off = F.col("good") / F.col("n") - F.col(mean)
    within = F.col(mean) * (1 - F.col(mean)) / F.col("n")
    r = groups.agg(F.sum(F.col("n") * (off * off - within)).alias("v"), F.sum(F.col("n") * F.col(mean) * (1 - F.col(mean))).alias("w")).first()
    if not r["w"]:
        return 1.0
    between = max(r["v"], 1e-4 * r["w"])
    return min(1e4, max(1.0, r["w"] / between - 1))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", host: str = "source", path: str = "lang", whole: bool = False) -> DataFrame:
    """A row for each document: doc_id, score (the probability that it is good), own_score, site_score, kept; whole: and doc, a struct of all its columns."""
    ids = ["doc_id"] + ["doc"] * whole
    own = written(_measured(docs, host, path, whole), "features")
    sample = own.join(F.broadcast(labelled(labels, label, MOST_LABELS)), "doc_id").select("x", "y").dropDuplicates().toPandas()
    if sample["y"].nunique() < 2:
        one = F.lit(1.0)
        return own.select(*ids, one.alias("score"), one.alias("own_score"), one.alias("site_score"), F.lit(True).alias("kept"))
    w = fit(np.stack(sample["x"].to_list()), (sample["y"].to_numpy() > 0).astype(float))
    logit = sum((F.get("x", F.lit(i)) * float(v) for i, v in enumerate(w[:-1])), F.lit(float(w[-1])))
    clipped = F.greatest(F.lit(-12.0), F.least(F.lit(12.0), logit))
    own = own.select(*ids, "host", "path", (1 / (1 + F.exp(-clipped))).alias("p"))
    paths = written(own.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("good")), "paths")
    r = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    if not r["n"]:
        return own.select(*ids, F.col("p").alias("score"), F.col("p").alias("own_score"), F.col("p").alias("site_score"), F.lit(True).alias("kept"))
    share = min(1 - 1e-6, max(1e-6, r["good"] / r["n"]))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("prior", F.lit(share))
    k = _strength(hosts, "prior")
    hosts = hosts.select(F.col("host").alias("__host"), ((k * share + F.col("good")) / (k + F.col("n"))).alias("prior"))
    nested = paths.join(hosts, F.col("host").eqNullSafe(F.col("__host")))
    k = _strength(nested, "prior")
    sites = nested.select(F.col("host").alias("__host"), F.col("path").alias("__path"), "n", "good", "prior")
    both = own.join(written(sites, "sites"), F.col("host").eqNullSafe(F.col("__host")) & F.col("path").eqNullSafe(F.col("__path")))
    odds = lambda p: F.log(p / (1 - p))
    site = (k * F.col("prior") + F.col("good") - F.col("p")) / (k + F.col("n") - 1)
    site = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), site))
    both = both.withColumn("site_score", site)
    score = 1 / (1 + F.exp(-(odds(F.col("p")) + SITE_WEIGHT * (odds(F.col("site_score")) - math.log(share / (1 - share))))))
    return both.select(*ids, score.alias("score"), F.col("p").alias("own_score"), "site_score", (score >= KEEP).alias("kept"))


def kept(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that the classifier keeps, with all their columns; a row carries its columns along, so none is looked up again."""
    return classify(docs, labels, whole=True, **options).where("kept").select("doc.*")
