"""The near-copy stage of the pipeline, against all pairs by exact similarity."""

import math
import random
import re

import corpus_pipeline
import numpy as np
import pytest
from llm_rows import DOCUMENTS, prose, row
from pyspark.sql import functions as F

from millrace.llm import common, near_copies, simhash


def _set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def first_of_near(rows):
    """The first row of each component of pairs at 0.8 or more; rows by identifier."""
    rows = sorted(rows)
    sets, label = [_set(r[1]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if label[i] != label[j] and n >= 0.8 * (len(sets[i]) + len(sets[j]) - n) - 1e-9:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return [r for i, r in enumerate(rows) if label[i] == i]


def planted():
    """Texts of their own; copies with 1 to 6 of 200 words changed, similarities from 0.74 to 0.95; a large group of copies; short and empty ones."""
    rows, r = [row(i, prose(200, f"own{i}"))[:5] for i in range(40)], random.Random(3)
    for i in range(40):
        for c in range(1, 7):
            words = rows[i][1].split()
            for at in range(c):
                words[20 + at * 30] = f"new{i}x{c}x{at}"
            if r.random() < 0.4:
                rows.append(row(100 + 10 * i + c, " ".join(words))[:5])
    for k in range(60):
        words = prose(150, "many").split()
        words[r.randrange(150)] = f"other{k}"
        rows.append(row(1000 + k, " ".join(words))[:5])
    return rows + [row(2000 + i, t)[:5] for i, t in enumerate([None, "", " \n", "one", "ONE", "one two", prose(6, 1), prose(6, 2), prose(7, 1)])]


@pytest.mark.parametrize("block", [None, 8])
def test_near_copies_go_and_others_stay(spark, block, monkeypatch):
    if block:
        monkeypatch.setattr(near_copies, "BLOCK", block)
        monkeypatch.setattr(near_copies, "EXACT_BLOCK", block)
        monkeypatch.setattr(near_copies, "AT_ONCE", 50)
    rows = planted()
    docs = spark.createDataFrame([*rows, rows[5]], DOCUMENTS).repartition(3)
    got = corpus_pipeline.one_of_near(spark, docs, "")
    want = first_of_near(rows)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == want and 60 < len(want) < 150
    assert corpus_pipeline.one_of_near(spark, docs.limit(0), "").count() == 0


def test_a_key_filter_passes_all_its_keys_and_parts_the_rows(spark, monkeypatch):
    rows = spark.range(2000).withColumn("bits", F.lit("x"))
    keyed = spark.range(0, 2000, 7)
    for words in (1, common.FILTER_WORDS):  # one that is full, and one that is nearly empty
        monkeypatch.setattr(common, "FILTER_WORDS", words)
        bits = common.key_filter(keyed, ["id"])
        inside, outside = ({r.id for r in common.maybe_in(rows, bits, ["id"], x).collect()} for x in (True, False))
        assert {*range(0, 2000, 7)} <= inside and not inside & outside and inside | outside == {*range(2000)}
        assert common.maybe_in(rows, bits, ["id"]).columns == rows.columns
    assert len(inside) < 400


def test_candidates_come_by_the_split_of_operator_1(spark, monkeypatch):
    """Bits that go together share a partition, thresholds add up, what is within the radius meets with one side listed, and near copies are missed as seldom as told."""
    monkeypatch.setattr(near_copies, "PLANNED", 1)
    rng = np.random.default_rng(4)
    half = rng.integers(0, 2, (3, 400, 32)).astype(bool)
    bits = np.stack([half, half ^ (rng.random(half.shape) < 0.02)], axis=-1).reshape(3, 400, 64)  # bits 2k and 2k + 1 go together
    for i in range(0, 400, 2):
        bits[:, i + 1] = bits[:, i]
        bits[:, i + 1, rng.choice(64, 2, replace=False)] ^= True
    fps = np.packbits(bits, axis=-1).view(">i8")[..., 0].T.tolist()
    first = spark.createDataFrame([(i, x) for i, x in enumerate(fps)], "node long, fps array<long>")
    counts = simhash.joint(first, 3)
    assert all(n == 400 and np.array_equal(both, b.T.astype(int) @ b.astype(int)) for (n, both), b in zip(counts, bits, strict=True))
    found = near_copies.splits(counts, 2)
    assert math.prod(map(near_copies.missed, found)) <= near_copies.MISSED
    for split in found:
        assert sum(limit + 1 for _, limit in split) >= 3 and len({b for g, _ in split for b in g}) == sum(len(g) for g, _ in split)
        assert sum(b + 1 in g for g, _ in split for b in g if b % 2 == 0) >= 0.8 * sum(b % 2 == 0 for g, _ in split for b in g)
    by = {}
    for r in near_copies._keyed(first, found).collect():
        by.setdefault(r.key, []).append((r.node, r.probe))
    met = {(a, b) for rows in by.values() for a, x in rows for b, y in rows if a < b and not (x and y)}
    assert {(i, i + 1) for i in range(0, 400, 2)} <= met


def test_as_many_fingerprints_as_near_copies_need():
    for n in (0, 10**5, 10**7):
        fingerprints, radius = near_copies.shape(n)
        assert fingerprints >= near_copies.PROBED and radius >= 1
    assert near_copies.missed([([*range(64)], 64)]) < 1e-9 and abs(near_copies.missed([([0, 1], 0)]) - (1 - 0.85**2)) < 1e-9
