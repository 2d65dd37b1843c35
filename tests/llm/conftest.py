import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def awkward(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns named like the operators' own."""
    long = " ".join(f"w{i % 977}x{i // 7}" for i in range(30_000))
    rows = [
        (1, "one two three four five six seven", "en", "a", 5),
        (1, "one two three four five six seven", "en", "a", 5),
        (2, None, None, None, None),
        (3, "", "en", "b", 0),
        (None, "a text without an id that is long enough to have shingles", "en", "b", 1),
        (None, None, None, None, None),
        (4, " \t\n ", "en", "a", 4),
        (5, long, "en", "c", len(long)),
        (6, long + " end", "de", "c", len(long)),
        (7, "wörter 日本語 \x00 ümläut", "de", None, 9),
        (7, "another text under the same id, with some more words to it", "de", None, 9),
    ]
    names = ("id", "t", "c", "n", "p", "v", "h", "key", "row", "_size", "_row", "_text", "_id", "_doc", "_cuts", "_more", "words", "f", "score", "doc", "pos", "src")
    df = spark.createDataFrame(rows, DOCS)
    for i, name in enumerate(names):
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit(i))
    return df


@pytest.fixture
def none(awkward):
    return awkward.limit(0)


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(1, 40)] + [(None, 1, None), (5, None, 0), (None, None, None)], "doc_id long, quality int, toxic int")
