import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, source)."""

    def make(rows):
        full = [(i, t, "en", (more or ["s0"])[0], None if t is None else len(t)) for i, t, *more in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls, empty and blank texts, repeated rows, ties, a very long text, and clashing column names."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(40_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "same text here now"), (5, "same text here now"), (4, "same text here now"), (6, long), (None, "no id on this row"), (7, "x"), (8, "ünï ▁ 日本 \U0001f600 a  b\n\nc ")]
    docs = make_docs(rows).withColumn("source", F.when(F.col("doc_id") == 7, None).otherwise(F.col("source")))
    for clash in ("fp", "score", "ids", "epoch", "row_key", "key", "fingerprint", "exact", "block", "added_spans"):
        docs = docs.withColumn(clash, F.lit("kept"))
    return docs
