import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType()), T.StructField("_k", T.StringType()),
                     T.StructField("score", T.StringType()), T.StructField("spans", T.StringType())])


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts, with extra columns that clash with inner names."""
    def made(texts, ids=None, lang="en"):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, lang, None, None if t is None else len(t), "k", "s", None) for i, t in zip(ids, texts)]
        return spark.createDataFrame(rows, DOCS)
    return made


@pytest.fixture(scope="session")
def odd():
    """Null, empty, blank, repeated and very long texts."""
    long = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
    return [None, "", " \n\t", "one", "same text again", "same text again", long, long, "é ñ ü ß", None]
