import pytest


@pytest.fixture(scope="session")
def make(spark):
    """Tables of documents: rows (doc_id, text, lang, source), n_chars added."""

    def table(rows):
        from pyspark.sql import functions as F

        d = spark.createDataFrame([tuple(r) + (None,) * (4 - len(r)) for r in rows], "doc_id long, text string, lang string, source string")
        return d.withColumn("n_chars", F.length("text").cast("long"))

    return table
