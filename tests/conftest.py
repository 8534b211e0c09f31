import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpusmill.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, shuffle_partitions=4, memory="6g")


@pytest.fixture
def docs(spark):
    """Documents from a list of texts, numbered from 0, in several partitions."""

    def build(texts, partitions=3):
        rows = [(i, text, f"ref{i}") for i, text in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, content string, source_ref string").repartition(partitions)

    return build
