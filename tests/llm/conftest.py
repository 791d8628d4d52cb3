import pytest

from .cases import SCHEMA, table


@pytest.fixture(scope="session")
def rows():
    return table()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def wide(docs):
    """The same documents with columns whose names operators use inside."""
    from pyspark.sql import functions as F

    names = ["fp", "key", "root", "n", "k", "k1", "k2", "_k1", "_k2", "row", "_row", "range", "tie", "bucket", "batch", "name", "block", "passes", "begin", "size", "lines", "gone", "score", "u", "v", "start", "text_", "guest", "did", "n_tokens"]
    return docs.select("*", *(F.lit(f"x-{c}").alias(c) for c in names))
