import pytest
from pyspark.sql import types as T

LONG = "x y z " * 30_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names may clash."""
    names = ["doc_id", "text", "lang", "source", "n_chars", "size", "shard", "node", "score", "spans", "ids", "words", "root"]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())] + [T.StructField(n, T.StringType()) for n in names[5:]])
    base = "The quick brown fox jumps over the lazy dog while the other dogs look on and wonder what it is all about today."
    texts = [None, "", " ", "\n\n", LONG, base, base, base + " Twice.", "a", "a", "ü 漢字 🙂 token", base.upper()]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, base), (None, base), (None, None), (None, "alone in the world")]
    return spark.createDataFrame([(i, t, None, "s", None, *["c"] * 8) for i, t in rows], schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
