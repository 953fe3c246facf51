import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("id", T.StringType()), T.StructField("t", T.StringType())])


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (id, text) pairs, with extra columns whose names clash with the operators' own."""

    def f(rows):
        return spark.createDataFrame([(i, t, None if i == 2 else "en", "s", None if t is None else len(t), "x", "y") for i, t in rows], SCHEMA)

    return f


@pytest.fixture(scope="session")
def edge():
    """Nulls, empty and blank texts, repeated rows, ties, non-ASCII and a very long text."""
    words = " ".join(f"w{i * 7919 % 3001}" for i in range(9000))
    copy = "the same passage of text stands here and there and it is long enough to be found again by every operator of the package"
    return [(1, None), (2, ""), (3, "  \n\t "), (4, copy), (4, copy), (5, copy), (6, copy + " x"), (7, "é" * 300), (8, words), (9, words + " end"), (10, "a" * 5000), (11, "A b C"), (12, "a B c")]
