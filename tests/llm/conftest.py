import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) pairs, with columns whose names clash with results and helper columns."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                           T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_words", T.StringType()),
                           T.StructField("fp", T.StringType()), T.StructField("_row", T.StringType()), T.StructField("score", T.StringType()),
                           T.StructField("a b.c", T.StringType())])

    def make(pairs, parts=3):
        rows = [(i, t, None, "s", None if t is None else len(t), "x", "y", "z", None, "q") for i, t in pairs]
        return spark.createDataFrame(rows, schema).repartition(parts)

    return make
