import numpy as np
import pytest
from corpus import DOC, prose
from pyspark.sql import functions as F


@pytest.fixture
def rng():
    return np.random.default_rng(5)


@pytest.fixture
def odd(spark, rng):
    """Nulls in every column, empty, very long, tied and repeated rows, and extra columns whose names clash."""
    long = prose(rng, 30_000)
    rows = [(1, "the cat sat on the mat", "en", "a", 22), (2, None, None, None, None), (None, "the cat sat on the mat", "en", "a", 22), (3, "", "en", "a", 0), (4, " \n\t ", "fr", "b", 4)]
    rows += [(5, long, "en", "a", len(long)), (6, "x" * 100_000, "de", "b", 100_000), (7, "12 34 !!", None, "b", 8), (1, "the cat sat on the mat", "en", "a", 22), (8, "der Hund und die Katze", "de", "b", 22), (9, "a\x00b é 中文 🙂 it's we'll", "fr", "a", 0)]
    df = spark.createDataFrame(rows, DOC)

    clash = ("id", "piece", "n", "ids", "fp", "line", "lines", "host", "words", "score", "row", "bucket", "page", "__text")
    return df.withColumns({c: F.lit(c) for c in clash})
