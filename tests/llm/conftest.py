import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents from (id, text) pairs, with columns of clashing names beside them."""

    def make(pairs):
        rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in pairs]
        frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
        names = "fp slice n sig1 size token label pos key word bits band batch kept_text low doc a b _keep"
        return frame.selectExpr("*", *(f"'x' as {c}" for c in names.split()))

    return make


ODD = [None, "", " ", "\n", "\n\n \n", "?!", "a", "Ünïcode  \t ñ 漢字 🎉", "word " * 30_000, "x" * 50_000]


@pytest.fixture
def odd_docs(docs):
    """Nulls, empty and very long texts, repeated rows, a null id."""
    return docs([*enumerate(ODD), (3, ODD[3]), (8, ODD[8]), (None, "no id here"), (None, None)])
