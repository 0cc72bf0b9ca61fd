import pytest

LONG = "word " * 40_000 + "ende"
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away.\nA second line, with more words in it.", "en", "s", 10),
    (2, None, None, None, None),
    (3, "", "en", "s", 0),
    (4, LONG, "de", "s", 5),
    (5, "The quick brown fox jumps over the lazy dog and runs away.\nA second line, with more words in it.", "en", "s", 10),
    (5, "The quick brown fox jumps over the lazy dog and runs away.\nA second line, with more words in it.", "en", "s", 10),
    (None, "no id here, password=abcdef123456 and mail bob.smith@mail.example.com", "en", None, 1),
    (6, "   \n\n \t ", "fr", "s", 1),
    (7, "ÀÉß Σας 日本語 👍🏽 naïve café", "fr", "s", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls, empty and long texts, repeats, and columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    names = ["fp", "node", "score", "key", "bucket", "label", "features", "hash"]
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({n: F.lit("x") for n in names}).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    """The driver's smallest tables."""
    return "/root/testdata/sf0.001"
