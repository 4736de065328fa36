import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that the operators use themselves.
        *(T.StructField(n, T.StringType()) for n in ("row", "content", "score", "component_id", "size", "part")),
    ]
)

LONG = "word " * 40_000 + "1" * 100_000 + "@" * 1000 + "a" * 100_000


def document(doc_id, text, lang="en", source="s1"):
    return (doc_id, text, lang, source, len(text or ""), "r", "c", "s", "k", "z", "p")


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, extra columns."""
    rows = [
        document(1, "the cat sat on the mat and looked at the dog"),
        document(1, "the cat sat on the mat and looked at the dog"),
        document(2, "the cat sat on the mat and looked at the dog", None, None),
        document(2, "another text under the same number, though", "en", "s2"),
        document(None, "a text without a number", "en", "s2"),
        document(None, None, None, None),
        document(3, None),
        document(4, ""),
        document(5, " \n\t "),
        document(6, LONG),
        document(7, "日本語 ñandú 🙂   ok"),
        (8, None, None, None, None, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, DOCUMENTS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(1, 1, 0), (2, 0, 1), (None, 1, 1), (3, None, None), (1, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")
