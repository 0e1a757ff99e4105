import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, shard int, rank int, h string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns whose names operators use inside."""
    long_text = "".join(f"word{i} the and of " for i in range(30_000))
    rows = [
        (1, "The cat sat on the mat and then it slept.", "en"), (2, "The cat sat  on the mat\nand then it slept.", "en"), (2, "The cat sat  on the mat\nand then it slept.", "en"),
        (3, None, "en"), (4, "", None), (5, "   ", "fr"), (6, "?!", "fr"), (None, "Le chat dort sur le tapis.", "fr"), (None, None, None),
        (7, long_text, "en"), (8, long_text + "more", "en"), (9, "a" * 200_000, "en"), (10, "Le chat dort sur le tapis.", "fr"), (11, "日本語 \U0001f600 ñ\x85x", "es"),
    ]
    return spark.createDataFrame([(i, t, lang, "s", 1, 7, 3, 2, "x") for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
