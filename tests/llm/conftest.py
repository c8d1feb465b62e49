import pytest

ROWS = [
    (1, "Released under the MIT License. All rights reserved.", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "b"),
    (4, " \n\t ", "en", "b"),
    (None, "no id here but some words to count", "en", "a"),
    (5, "Straße größer naïve 中文 \U0001f600 words and more words to see", "de", "c"),
    (6, "same text for two rows that is long enough to be more than fifty bytes in all", "en", "a"),
    (7, "same text for two rows that is long enough to be more than fifty bytes in all", "en", "c"),
    (7, "same text for two rows that is long enough to be more than fifty bytes in all", "en", "c"),
    (8, "word " * 9000, "en", None),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns whose names clash with the operators' own."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").repartition(3)
    return rows.withColumns({"n_chars": F.char_length("text").cast("long"), "size": F.lit("x"), "key": F.lit(1), "block": F.lit("y"), "node": F.lit(None).cast("string"), "rank": F.lit(0), "label": F.lit("z"), "length": F.lit("q"), "range": F.lit(0.5)})


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
