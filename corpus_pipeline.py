"""The corpus pipeline: a classifier keeps good documents, exact and near copies go, the sources are mixed to their targets, and what is left is packed.

Each stage takes (spark, docs, sf_dir) and returns a table; run() writes it to the shared folder and
hands it, read again, to the next. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import exact_dedup, mixing, near_copies, packing, quality
from millrace.llm.common import table, written


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6; documents that the classifier rejects go."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def one_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4; of equal texts the row with the smallest identifier stays."""
    return exact_dedup.deduplicated(docs)


def one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1's partitions, thresholds and probes of SimHash fingerprints find candidates; of texts linked by a similarity of 0.8 or more in five-word shingles the first stays."""
    return near_copies.deduplicated(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5; a document comes as often as the mix takes it whole."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3; a row for each piece of a document in a sequence of tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", good_documents),
    ("exact dedup", one_of_equal),
    ("SimHash near-dedup", one_of_near),
    ("mixing sources", mixed_sources),
    ("packing", packed),
]

#: SQL can't express the classifier, the fingerprints, the seeded draw or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs
