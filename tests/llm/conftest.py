import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, "en", "a", None), (None, "some words of text here again", None, None, 3), (2, "", "en", "a", 0), (3, "word " * 3000, "en", "a", 1), (3, "word " * 3000, "en", "a", 1), (4, "it's 12½ 日本語  x\n\n  end ", None, "b", 2)]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, an empty and a long text, repeated rows, and a column with a clashing name."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(ODD, DOCS).withColumns({"key": F.lit("x"), "bucket": F.lit(7), "keep": F.lit(1), "c0": F.lit("y")})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"
