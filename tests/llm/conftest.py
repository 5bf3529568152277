import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

#: Nulls, empty and short texts, control characters, repeated rows, copies, one long text.
ODD = [
    (1, "the quick brown fox jumps over the lazy dog near the river bank", "en", "s", 1),
    (2, "the quick brown fox jumps over the lazy dog near the river bank", "en", "s", 1),
    (2, "the quick brown fox jumps over the lazy dog near the river bank", "en", "s", 1),
    (3, None, None, None, None),
    (4, "", "en", "s", 0),
    (5, " \t\n\x0b\x0c\r ", "de", "s", 7),
    (6, "one", None, "s", 3),
    (7, "One two", "en", None, 7),
    (8, "ÉCOLE école  straße\u00a0x 東京 \U0001f600 İ", "fr", "s", 5),
    (9, "word " * 30_000, "en", "s", 150_000),
    (10, "\x00\x01 12345 !!!", "en", "s", 9),
    (None, "no id here", "en", "s", 9),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with a column more, whose name an operator could use itself."""
    return spark.createDataFrame([(*r, 7, "x") for r in ODD], DOCS + ", shard int, digest string")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
