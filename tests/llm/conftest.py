import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture
def docs(spark):
    """documents with nulls, empty and very long texts, repeated rows and an extra column with a clashing name."""
    long = "".join(f"word{i} " for i in range(20_000))
    rows = [
        (1, "one two three", "en", "x"), (2, " one\ttwo\n three ", None, None), (3, None, "en", "x"), (4, "", None, "x"),
        (5, long, "en", None), (6, long.replace(" ", "\n"), "en", "x"), (6, long.replace(" ", "\n"), "en", "x"),
        (None, "one two three", "fr", "x"), (7, "één 中文 😀 \x1c\u0085x", "nl", "x"), (8, "   \n\n  a  b \t c", "en", "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.selectExpr("doc_id", "text", "lang", "source", "'h' AS h", "1 AS name", "2 AS pos", "length(text) AS n_chars")
