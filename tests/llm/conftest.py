import uuid

import pytest

from hoopspark.llm import shared

EXTRA = "source string, shard string, word string, key long"


@pytest.fixture()
def frame(spark):
    """A documents table from (doc_id, text) rows, with further columns whose names operators use inside."""
    def make(rows, parts=3):
        return spark.createDataFrame([(i, t, "s", "x", "w", 1) for i, t in rows], f"doc_id long, text string, {EXTRA}").repartition(parts)
    return make


@pytest.fixture(autouse=True)
def fresh_tables(request, monkeypatch):
    """Tests of what a task leaves behind begin without the tables of earlier tests, here and in workers of their own."""
    if request.module.__name__.endswith("test_shared"):
        shared._grown.clear()
        spark = request.getfixturevalue("spark")
        monkeypatch.setitem(spark.sparkContext.environment, "FRESH_WORKERS", uuid.uuid4().hex)
