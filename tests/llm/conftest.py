import pytest
from pyspark.sql import types as T

# One extra column, with a name that the operators use for columns of their own.
DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("size", T.StringType())])


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text[, lang[, source]])."""
    def make(*rows):
        full = [(*row, *[None] * (4 - len(row))) for row in rows]
        return spark.createDataFrame([(i, t, l, s, None if t is None else len(t), "x") for i, t, l, s in full], DOCUMENTS)
    return make


@pytest.fixture
def awkward(documents):
    """NULLs, empty and blank texts, a very long one, repeated rows and ids."""
    long = " ".join(f"wörd{i % 997} und" for i in range(40_000))
    return documents((1, None), (2, ""), (3, " \n\t "), (4, long, "de", "a"), (5, "a b c", None, None), (5, "a b c", None, None),
                     (None, "a b c", "en", "b"), (None, None), (6, "one\n\ntwo, three.", "en", "b"))
