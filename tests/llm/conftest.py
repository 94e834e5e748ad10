import pytest
from pyspark.sql import functions as F

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "alpha beta gamma delta " * 30_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns whose names clash with results."""
    texts = [None, "", " \t\n", "one", "One TWO three", "é ü ñ", LONG, "same text here now " * 3, "same text here now " * 3, "same text here now " * 3, "x" * 50_000, "%%% 123 $$$"]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else f"s{i % 2}", i) for i, t in enumerate(texts)]
    rows += [rows[4], (None, "no id at all", None, None, None)]
    df = spark.createDataFrame(rows, SHAPE)
    return df.withColumns({c: F.lit(7) for c in ("score", "uid", "id", "n_tokens", "fingerprint", "component_id", "part", "length", "spans", "digest", "predicted")})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SHAPE)
