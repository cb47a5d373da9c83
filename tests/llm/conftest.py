import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"

#: Nulls in every column, empty and blank texts, repeated rows, ties, other scripts, control signs.
ODD_ROWS = [
    (None, None, None, None, None),
    (1, None, "en", "a", 0),
    (2, "", "en", "a", 0),
    (3, " \t\n ", None, "a", 3),
    (4, "one", "en", None, 3),
    (5, "one two", "en", "b", 7),
    (5, "one two", "en", "b", 7),
    (6, "ONE\x0bTwo", "en", "b", 7),
    (7, "schön 你好 \U0001f600 \x00 end", "de", "\U0001f600", 14),
    (None, "one two", "en", "b", 7),
    (8, "a b c d e f g " * 9000, "en", "c", 126000),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD_ROWS, DOC)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_docs(spark, sf):
    """All rows of the small documents table as (doc_id, text)."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    return [(r[0], r[1]) for r in rows]


def clash(df, *names):
    """The table with extra columns named like the operators' own."""
    from pyspark.sql import functions as F
    return df.withColumns({n: F.lit("x") for n in names})
