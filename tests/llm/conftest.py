import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from llm_rows import DOCUMENTS, SCHEMA, all_rows  # noqa: E402


@pytest.fixture(scope="session")
def rows():
    return all_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def unique(rows):
    """Rows whose identifier is there, once."""
    return [r for r in rows if r[0] not in (None, 80)]


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
