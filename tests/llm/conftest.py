import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def docs(spark):
    """Small documents with nulls, empties, repeats, ties and a column whose name clashes."""
    rows = [(k, f"Line {k % 3} of text number {k}.\nshared line\n" + "word " * (k % 7), "en" if k % 2 else "fr", f"s{k % 2}") for k in range(40)]
    rows += [(40, None, None, None), (41, "", "en", "s0"), (42, "  \n\t", "en", None), (5, rows[5][1], "en", "s1"), (43, rows[6][1], "en", "s0"), (None, "no id here", "en", "s0")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("score", F.lit(1)).withColumn("n", F.lit("x"))
