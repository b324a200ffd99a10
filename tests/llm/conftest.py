import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `class` string, n long, part int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns with clashing names."""
    passage = " ".join(f"passage{k} of words that repeat" for k in range(12))
    long = " ".join(f"w{k % 997}" for k in range(60_000))
    texts = [None, "", "   \n\t", "word", "a b c d", "é ñ ß <|endoftext|> \x00 x", passage, passage, f"start {passage} end", long, "Licensed under the Apache License, Version 2.0.\n" + passage, "12 34 !!"]
    rows = [(k, t, ["en", None, "fr"][k % 3], [None, "", "s1"][k % 3], None if t is None else len(t), "x", 7, 9) for k, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, passage, "en", "s1", 3, "x", 7, 9), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
