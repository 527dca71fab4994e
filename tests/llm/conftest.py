import pytest


def frame(spark, texts, schema="doc_id long, text string"):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], schema)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, an empty text, white space, repeated rows, a very long text, columns with clashing names."""
    long = "Ein langer Satz steht hier. " * 20000
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one two three four."), (4, "one two three four."), (None, "one two three four."), (5, long), (6, "é" * 1000)]
    schema = "doc_id long, text string, kept string, fp string, ids string, secrets string, removed string, th string, licenses string"
    return spark.createDataFrame([(*r, *["x"] * 7) for r in rows], schema)
