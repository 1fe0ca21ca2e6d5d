import pytest

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Names that the operators use themselves.
    T.StructField("_row", T.StringType()), T.StructField("_key", T.LongType()), T.StructField("row", T.LongType()),
    T.StructField("score", T.StringType()), T.StructField("kept", T.LongType()), T.StructField("count", T.LongType()),
])
LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(60_000))
ROWS = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", None, "a", 4), (4, "42 !!! 17", "en", "b", 9),
    (5, "the same text twice over", "en", "b", 24), (6, "the same text twice over", "de", None, 24),
    (6, "the same text twice over", "de", None, 24), (7, "the same text twice over", None, "c", 24),
    (8, LONG, "en", "c", len(LONG)), (None, "a row without an id and some words", "en", "c", 34),
    (None, None, None, None, None), (9, "naïve Ünïcode ½ and 中文字 🙂 too", "fr", "d", 31),
    (10, "x" * 30_000, "en", "d", 30_000), (11, "one", "en", "d", 3),
]


@pytest.fixture(scope="session")
def odd_rows():
    return ROWS


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows and clashing columns."""
    rows = [(*r, "r", i, -i, "s", i, 0) for i, r in enumerate(ROWS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "source").cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text or "" for r in documents.select("doc_id", "text").collect()}
