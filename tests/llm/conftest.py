import pytest

from pyspark.sql.types import LongType, StringType, StructField, StructType

DOC = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("source", StringType())])


@pytest.fixture(scope="session")
def make(spark):
    """Documents of (doc_id, text[, source]) rows in several partitions."""

    def docs(rows, parts=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "s") for r in rows]
        return spark.createDataFrame(full, DOC).repartition(parts)

    return docs


@pytest.fixture(scope="session")
def odd_rows():
    """Null ids and texts, empty and blank texts, repeated rows, a long word, a long text, text of another script."""
    long_text = " ".join(f"w{i % 997}x{i % 89}" for i in range(20_000))
    return [
        (1, None), (2, ""), (3, " \t\n "), (4, "alpha beta gamma"), (4, "alpha beta gamma"), (5, "ALPHA  beta\ngamma"),
        (6, "x" * 50_000), (7, long_text), (8, long_text + " tail"), (9, "日本語 テキスト   é"), (None, "alpha beta gamma"), (None, None),
        (10, "one"), (11, "one"), (12, "the end <|endoftext|> it's"),
    ]
