import pytest

NASTY = [
    (1, None, "x"), (2, "", "x"), (3, "  \n\t ", "y"), (4, "one", None), (5, "Émile ÉCRIT à Σίσυφος ΟΔΟΣ x", "z"),
    (6, "a b c d e f", "k"), (6, "a b c d e f", "k"), (7, "a  b\tc\nd e f", "k"), (None, "a b c d e f", "k"),
    (None, "lonely words here", "k"), (8, "word " * 30_000, "long"), (9, "x" * 20_000, "long"), (10, "<|endoftext|> it's 42", "s"),
]


@pytest.fixture
def nasty(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names clash with results."""
    names = "doc_id long, text string, digest string, hits string, keep_id string, fp string, score string, w string, row string"
    return spark.createDataFrame([(*r, "h", "k", "f", "s", "w", "r") for r in NASTY], names)


@pytest.fixture
def empty(nasty):
    return nasty.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
