from __future__ import annotations

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # columns are built faster
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, n_words string, rank string, fp string"


@pytest.fixture(scope="session")
def odd_rows():
    """Rows with nulls, empty and long texts, ties and repeats; the last columns clash with names that operators use."""
    clean = "The quick brown fox jumps over the lazy dog while seven wise owls watch from old trees near a calm lake. "
    rows = [
        (1, clean * 4, "en", "a"),
        (1, clean * 4, "en", "a"),
        (2, None, "en", "a"),
        (3, "", None, None),
        (4, " \n\t ", "de", "b"),
        (None, "mail me at bob@example.com or +1 (555) 123-4567 now", "en", None),
        (None, None, None, None),
        (5, "word " * 60_000, "en", "b"),
        (6, "one", "en", "c"),
        (7, "card 4111 1111 1111 1111 ip 10.0.0.1 and 1.2.3.999", "en", "a"),
        (8, "a" * 200_000, "fr", "a"),
        (9, "1" * 50_000 + "." + "+" * 1000, "fr", "c"),
        (10, "é́ \U0001f600 Σς <|endoftext|> İ \x1c\x85", "es", "c"),
        (10, "another text of the same id", "es", "c"),
        (11, "\n".join(f"line {k} " + clean for k in range(40)), "en", "d"),
    ]
    return [(*r, len(r[1] or ""), "x", "y", "z", "w") for r in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """The odd rows with columns named as the operators name their own, and as Spark names a file's."""
    names = ["__file", "__row", "__n", "__s", "__t", "__c", "__a", "__id", "__key", "__times", "__best", "_metadata", "file", "at", "row", "same", "c", "cands", "spans", "first", "prefix", "times", "part", "n", "component", "a.b"]
    return odd.select("*", *[odd["doc_id"].alias(c) for c in names])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
