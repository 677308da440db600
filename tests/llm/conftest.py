import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Rows that any stage must take: nulls in every column, empty and blank texts, repeats, ties, odd characters.
HARD = [
    (None, None, None, None, None),
    (None, "the cat sat on the mat and looked at the dog", "en", None, None),
    (1, "", "en", "a", 0),
    (2, " \t\n\x0b\x0c\r ", None, "a", 7),
    (3, "one", "en", "b", 3),
    (3, "one", "en", "b", 3),
    (4, "1234 5678 !!! ###", "de", "b", 17),
    (5, "a\x1cb\x85c\xa0d e <|endoftext|> Éé \U0001f600", "fr", "", 20),
    (5, "another text of the same id", "en", "a", 27),
    (-7, "negative id", "en", "a", 11),
]


@pytest.fixture(scope="session")
def hard(spark):
    return spark.createDataFrame(HARD + [(9, "word " * 40_000, "en", "a", 200_000)], DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def wider():
    """Adds columns whose names an operator may use itself."""
    from pyspark.sql import functions as F

    return lambda df: df.select("*", *[F.lit("x").alias(c) for c in ("key", "c", "v", "th", "crc", "size", "place", "shard", "block", "target", "score", "lang_pred", "spans", "cover", "rep")])
