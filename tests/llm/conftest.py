import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts or (id, text) pairs."""

    def build(*rows, schema=SCHEMA):
        out = []
        for i, r in enumerate(rows):
            key, text = r if isinstance(r, tuple) else (i, r)
            out.append((key, text, "en", "s", None if text is None else len(text)))
        return spark.createDataFrame(out, schema)

    return build


@pytest.fixture(scope="session")
def messy(make):
    """Nulls, empty and long texts, repeated rows and a column whose name clashes with results."""
    long = "".join(f"word{i} other{i % 97}\n" for i in range(30_000))
    rows = [(1, None), (2, ""), (None, "a b c"), (3, long), (4, long), (4, long), (5, "x"), (6, " \n\t "), (None, None)]
    from pyspark.sql import functions as F

    return make(*rows).withColumn("k", F.lit("clash")).withColumn("flags", F.lit(1)).withColumn("kept", F.lit(True)).withColumn("fp", F.lit(0))
