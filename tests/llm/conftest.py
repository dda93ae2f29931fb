import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, name string, kept string, block string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and columns that clash."""
    long = " ".join(f"word{i % 977} of{i % 13}." for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "   \n\t "), (None, "a b c d e f g"), (5, "a b c d e f g"), (6, "a b c d e f g"), (6, "a b c d e f g"), (7, long), (8, long), (9, long + " end"), (10, "x" * 50_000), (11, "Zeile eins\nZeile eins\nzwei é 🙂")]
    return spark.createDataFrame([(i, t, None, None if i == 5 else "s", None, "n", "k", "b") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
