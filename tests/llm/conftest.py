import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty and repeated rows, a long text, and columns whose names clash with the operators' own."""
    rows = [(1, None, None, "a", 1), (2, "", "en", None, 2), (3, "one two", "en", "a", 3), (3, "one two", "en", "a", 3),
            (None, "alpha beta gamma delta epsilon zeta", "de", "b", 4), (None, None, "de", "b", 4),
            (5, "word " * 60_000, "en", "a", 5), (6, "alpha beta gamma delta epsilon zeta", "de", "b", 6)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, key int")
