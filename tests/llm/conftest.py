import os
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"
DOCS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])


@pytest.fixture(scope="session")
def docs(spark):
    """A table of documents from texts, or from (doc_id, text) pairs."""

    def make(*texts):
        rows = [t if isinstance(t, tuple) else (k, t) for k, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def awkward(docs):
    """Nulls, empty and long texts, repeated rows, clashing extra columns."""
    from pyspark.sql import functions as F

    long = "word " * 30_000
    rows = docs((1, None), (2, ""), (3, "one two"), (3, "one two"), (4, long), (5, long), (6, "  \n\t "), (7, "é" * 5000), (8, "a b c d e f g"))
    return rows.withColumns({"node": F.lit(1), "sig": F.lit("x"), "n": F.lit(2), "k": F.lit(3), "probability": F.lit("p"), "text2": F.lit(None).cast("string")})
