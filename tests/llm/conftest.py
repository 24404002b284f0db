import pytest
from pyspark.sql import types as T

DOCUMENT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Names that operators use inside, to see that they do not clash.
    T.StructField("bucket", T.StringType()), T.StructField("score", T.StringType()), T.StructField("size", T.StringType()),
])


@pytest.fixture(scope="session")
def documents(spark):
    def make(rows):
        full = [(i, t, "en", s, None if t is None else len(t), "b", None, "z") for i, t, s in rows]
        return spark.createDataFrame(full, DOCUMENT)

    return make


LONG = "lorem ipsum dolor sit amet " * 20000
#: Nulls, empty and very long texts, repeated rows, repeated ids, no id.
ODD = [
    (1, None, "a"), (2, "", "a"), (3, "   \n\t ", None), (4, LONG, "b"), (5, "one", "b"), (5, "one", "b"),
    (6, "two words", None), (None, "no id at all here", "a"), (7, "one", "c"), (8, "ÄÖ ñ 日本語 \x00 é́", "c"),
    (9, "one two three four five six seven", "a"), (9, "other text with the same id", "a"),
]


@pytest.fixture(scope="session")
def odd(documents):
    return documents(ODD)


@pytest.fixture(scope="session")
def nothing(documents):
    return documents([])
